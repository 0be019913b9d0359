"""A whole run: queries, graph, distances, genomes, outliers, files."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from hopwise.operators import distances, graph, outliers
from hopwise.operators.chains import contracted, contracted_edges
from hopwise.plans.jobs import plan_jobs
from hopwise.plans.log import RunLog
from hopwise.plans.options import Mode, Options
from hopwise.sources import readers, writers

log = logging.getLogger(__name__)


def _outliers(rows: DataFrame, o: Options, genomes: bool, files: dict[str, str]) -> None:
    if "score" not in rows.columns:
        log.warning("the queries have no scores; no outliers are sought")
        return
    bound = o.max_distance if o.compat and not genomes else None
    p = outliers.parameters(rows, o.ld_distance, o.ld_min, o.ld_score, o.ld_nth, o.outlier_threshold, o.counted if "count" in rows.columns else 0, bound)
    name, stats = o.path(genomes, True), o.path(genomes, True, True)
    if writers.write_outliers(outliers.collected(rows, p, bound), p, name, stats, o.output_one_based):
        files |= {"genome_outliers" if genomes else "outliers": name, "genome_stats" if genomes else "stats": stats}


def run(spark: SparkSession, options: Options) -> dict[str, str]:
    """Runs what the options ask for; returns the paths written."""
    o, files = options.check(), {}
    told = RunLog(o.verbose)
    told.options(o)
    for path in filter(None, [o.queries, None if o.outliers_only else o.edges, None if o.outliers_only else o.unitigs, o.genomes if Mode.GENOMES in o.mode else None]):
        readers.check_file(spark, path)
    if o.genomes and Mode.GENOMES not in o.mode:
        log.warning("genomes are left out: they need edges and unitigs")
    queries = readers.read_queries(spark, o.queries, o.queries_format, o.queries_one_based, o.n_queries, o.outliers_only).cache()
    try:
        told.step("read {} queries", queries.count)
        if o.outliers_only:
            _outliers(queries, o, False, files)
            told.step("sought outliers")
            return files
        told.step("planned searches from {} vertices", plan_jobs(queries).select("source").distinct().count)
        two_sided = Mode.CDBG in o.mode
        if two_sided:
            unitigs, edges = readers.read_unitigs(spark, o.unitigs, o.k), readers.read_cdbg_edges(spark, o.edges, o.graph_one_based)
            n = unitigs.count()
            if edges.where(f"v >= {n} or w >= {n}").limit(1).count():
                raise readers.FormatError("an edge of a unitig that is not there")
            whole = graph.cdbg(unitigs, edges).cache()
        else:
            whole = graph.normalised(readers.read_general_edges(spark, o.edges, o.graph_one_based)).cache()
        try:
            if o.verbose:
                p = graph.profile(whole, two_sided).first()
                told.step("built the graph: {} connected vertices, {} edges, at most {} at one", p["connected_nodes"], p["edges"], p["max_degree"])
            if Mode.GENOMES in o.mode:
                paths = readers.read_genome_paths(spark, o.genomes)
                links = readers.read_genome_edges(spark, paths, o.graph_one_based).cache()
                if graph.genome_members(links).select("genome_id").distinct().count() < len(paths):
                    raise readers.FormatError("a genome without edges")
                genomes = graph.genome_graphs(unitigs, links)
                if o.verbose:
                    sizes = distances.average_sizes(contracted_edges(contracted(genomes))).first()
                    told.step("contracted {} genomes: {} vertices and {} edges on average", len(paths), sizes["avg_nodes"] or 0, sizes["avg_edges"] or 0)
                rows = distances.genome_distances(genomes, links, queries, o.max_distance).cache()
                files["genome_distances"] = o.path(True)
                writers.write_results(rows, files["genome_distances"], o.output_one_based)
                told.step("wrote distances over {} genomes", len(paths))
                if o.outliers:
                    _outliers(rows, o, True, files)
                    told.step("sought outliers over genomes")
                rows.unpersist()
                links.unpersist()
            if not o.genomes_only:
                rows = distances.graph_distances(whole, queries, o.max_distance, two_sided).cache()
                files["distances"] = o.path()
                writers.write_results(rows, files["distances"], o.output_one_based, o.max_distance)
                told.step("wrote distances in the whole graph")
                if o.outliers:
                    _outliers(rows, o, False, files)
                    told.step("sought outliers")
                rows.unpersist()
        finally:
            whole.unpersist()
    finally:
        queries.unpersist()
    return files
