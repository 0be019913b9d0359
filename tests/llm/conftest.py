import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names used inside.
CLASHES = "kept string, run int, fp long, k long, row string, digest string, spans string, __rid string, __spans string, part double, stratum string, label int, held_out string"


def sentence(r, n):
    return " ".join("".join(r.choice("abcdeéghilmnorstu") for _ in range(r.randint(1, 9))) for _ in range(n)) + "."


def corpus(seed=0, n=60):
    """Texts with copies, near copies, shared passages, repeated words, junk, nulls, empty and long ones."""
    r = random.Random(seed)
    texts = ["\n".join(sentence(r, r.randint(4, 60)) for _ in range(r.randint(1, 6))) for _ in range(n)]
    shared = sentence(r, 70)
    for i in range(0, n, 5):
        texts[i] += "\n" + shared
    for i in range(3, n, 7):
        w = texts[i].split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [texts[1], texts[1].replace(" ", "  \n"), texts[2] + " ", "", None, " \t\n ", "a", "a b c", "word " * 400, "ab" * 900, "x" * 500, "\n".join(["same line here " * 8] * 9)]
    texts += ["%%% ".join(sentence(r, 40).split()) for _ in range(4)] + [sentence(r, 9000), "ünï çödé   \xa0 ́x 😀 " * 30, "<|endoftext|> it's 12 Ⅷ"]
    return [(i, t, r.choice(["en", "fr", None]), r.choice(["s0", "s0", "s1", None]), None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(5).cache()


@pytest.fixture(scope="session")
def odd(spark, rows):
    """Nulls in every column, repeated rows, shared ids, clashing columns."""
    some = rows[:12] + [rows[1], rows[1], (None, rows[2][1], None, None, None), (None, None, None, None, None), (3, rows[4][1], "en", "s1", 5), (3, "", "", "", -1)]
    n = len(CLASHES.split(","))
    return spark.createDataFrame([x + (None,) * n for x in some], f"{COLUMNS}, {CLASHES}").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark, rows):
    said = [(i, 0 if t and ("%%%" in t or t.startswith("word word")) else 1, 0) for i, t, *_ in rows if i % 3 or (t and "%%%" in t)]
    return spark.createDataFrame([*said, (None, 1, 0), (5, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
