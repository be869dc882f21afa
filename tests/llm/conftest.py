import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "se", "ti") for b in ("ban", "dor", "fel", "gis", "hum", "jat")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, a null id, and columns with names that operators use."""
    rng = random.Random(4)
    base = [prose(rng, rng.randint(12, 120)) for _ in range(60)]
    near = base[5].split()
    near[3] = "other"
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t)) for i, t in enumerate(base)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n\t ", "en", "s1", 4), (103, base[5], "en", "s1", 5), (104, " ".join(near), "en", "s2", 5)]
    rows += [(105, prose(rng, 4), "en", "s0", 4), (None, base[6], "en", "s0", 6), (None, prose(rng, 30), "en", "s9", 6), (7, base[7], "en", "s1", len(base[7])), (7, base[7], "en", "s1", len(base[7])), (106, prose(rng, 6000), "en", "s0", 9), (107, "Größe ÉTÉ \x1f\x85 naïve 12", "de", "s0", 9), (107, "another text under one id", "de", "s0", 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.selectExpr("*", "'x' as n", "1 as key", "2 as size", "3 as score", "doc_id as _u", "4 as cid", "5 as part")


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
