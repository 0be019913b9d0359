"""Options of a run, their validation and the operating modes."""

from __future__ import annotations

import argparse
import enum
from dataclasses import dataclass


class Mode(enum.IntFlag):
    NOTHING = 0
    GENERAL = 1
    CDBG = 2
    GENOMES = 4
    OUTLIERS = 8


@dataclass(frozen=True)
class Options:
    """All settings; None stands for "not given" or "no limit"."""

    edges: str | None = None
    unitigs: str | None = None
    k: int = 0
    genomes: str | None = None
    genomes_only: bool = False
    queries: str | None = None
    n_queries: int | None = None
    queries_format: int | None = None
    max_distance: float | None = None
    partitions: int = 1
    outliers: bool = False
    count_threshold: int = 10
    ld_distance: int | None = None
    ld_min: int = 1000
    ld_score: float = 0.8
    ld_nth: int = 10
    outlier_threshold: float | None = None
    graph_one_based: bool = False
    queries_one_based: bool = False
    output_one_based: bool = False
    output: str = "out"
    verbose: bool = False
    compat: bool = False

    @property
    def mode(self) -> Mode:
        mode = Mode.OUTLIERS if self.outliers else Mode.NOTHING
        if self.edges:
            if self.unitigs:
                mode |= Mode.CDBG
                if self.genomes:
                    mode |= Mode.GENOMES
            else:
                mode |= Mode.GENERAL
        return mode

    @property
    def outliers_only(self) -> bool:
        return self.mode == Mode.OUTLIERS

    @property
    def counted(self) -> int:
        """The count threshold in force. Without genomes the compatible setting is none, else what the user asked for where counts exist."""
        return 0 if self.compat and not self.genomes else self.count_threshold

    def check(self) -> Options:
        """Raises ValueError for what cannot be run."""
        if not self.queries:
            raise ValueError("a queries file is required")
        if self.queries_format is not None and not 0 <= self.queries_format < 6:
            raise ValueError("queries formats are 0 to 5")
        if not self.edges and not self.outliers:
            raise ValueError("an edges file is required")
        if self.edges and self.unitigs and self.k <= 0:
            raise ValueError("a k-mer length over 0 is required with unitigs")
        if self.outliers_only and self.queries_format not in (None, 4, 5):
            raise ValueError("outliers alone need queries of format 4 or 5")
        if self.partitions <= 0:
            raise ValueError("at least one thread is required")
        if self.max_distance is not None and self.max_distance <= 0:
            raise ValueError("the maximum distance must be over 0")
        return self

    def path(self, genomes: bool = False, outliers: bool = False, stats: bool = False) -> str:
        """Output names. The suffixes of the text format."""
        name = self.output + ".ud" + "_sgg" * genomes + "_outliers" * outliers
        return f"{name}_stats" if stats else f"{name}_{int(self.output_one_based)}_based"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hopwise", description="Distances between pairs of vertices of a large graph.")
    add = p.add_argument
    add("-E", "--edges-file", dest="edges")
    add("-U", "--unitigs-file", dest="unitigs")
    add("-k", "--k-mer-length", dest="k", type=int, default=0)
    add("-S", "--sgg-paths-file", dest="genomes")
    add("-r", "--run-sggs-only", dest="genomes_only", action="store_true")
    add("-Q", "--queries-file", dest="queries")
    add("-n", "--n-queries", dest="n_queries", type=int)
    add("-q", "--queries-format", dest="queries_format", type=int)
    add("-d", "--max-distance", dest="max_distance", type=float)
    add("-t", "--threads", dest="partitions", type=int, default=1)
    add("-x", "--output-outliers", dest="outliers", action="store_true")
    add("-Cc", "--sgg-count-threshold", dest="count_threshold", type=int, default=10)
    add("-l", "--ld-distance", dest="ld_distance", type=int)
    add("-lm", "--ld-distance-min", dest="ld_min", type=int, default=1000)
    add("-ls", "--ld-distance-score", dest="ld_score", type=float, default=0.8)
    add("-ln", "--ld-distance-nth-score", dest="ld_nth", type=int, default=10)
    add("-ot", "--outlier-threshold", dest="outlier_threshold", type=float)
    add("-1g", "--graphs-one-based", dest="graph_one_based", action="store_true")
    add("-1q", "--queries-one-based", dest="queries_one_based", action="store_true")
    add("-1o", "--output-one-based", dest="output_one_based", action="store_true")
    add("-1", "--all-one-based", dest="all_one_based", action="store_true")
    add("-o", "--output-stem", dest="output", default="out")
    add("-v", "--verbose", dest="verbose", action="store_true")
    add("--compat", dest="compat", action="store_true", help="keep the quirks of the format's first program")
    return p


def parse(argv: list[str]) -> Options:
    """An option's value may be a negative number, although -1 is an option too."""
    p, words, i = parser(), [], 0
    valued = {o for a in p._actions if a.nargs is None and a.option_strings for o in a.option_strings}
    while i < len(argv):
        if argv[i] in valued and i + 1 < len(argv):
            words.append(f"{argv[i]}={argv[i + 1]}")
            i += 1
        else:
            words.append(argv[i])
        i += 1
    a = vars(p.parse_args(words))
    if a.pop("all_one_based"):
        a |= {"graph_one_based": True, "queries_one_based": True, "output_one_based": True}
    if a["n_queries"] is not None and a["n_queries"] <= 0:
        a["n_queries"] = None
    if a["ld_distance"] is not None and a["ld_distance"] < 0:
        a["ld_distance"] = None
    if a["outlier_threshold"] is not None and a["outlier_threshold"] < 0:
        a["outlier_threshold"] = None
    return Options(**a).check()
