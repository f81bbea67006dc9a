import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

WORDS = "the river stone walks under quiet copper light and seven birds carry old letters over cold water while bread turns brown".split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ly", "er", "en"]) for _ in range(words))


@pytest.fixture(scope="session")
def make_prose():
    return prose


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): nulls, empty and long texts, ties, repeated rows, near copies."""
    long = prose(1, 9000)
    base = prose(2, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base),
        (2, None),
        (3, ""),
        (4, " \t\n "),
        (5, long),
        (6, long),
        (7, " ".join(near)),
        (8, base.replace(" ", "  \n", 3)),
        (9, prose(3, 60) + " " + base),
        (10, "two words"),
        (11, "Two  WORDS"),
        (12, "é" * 150 + base[:150] + "日本" * 60),
        (12, "é" * 150 + base[:150] + "日本" * 60),
        (13, "x" * 400),
        (14, prose(4, 200)),
        (15, prose(4, 199) + " " + prose(5, 1)),
        (16, "\x1c\x85 　 odd blanks"),
    ]


CLASHES = "part kind node shared token n used label rank place size shard slot start length sequence_id offset score words x y h window block blocks root ord tag z edge first"


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows above with extra columns whose names the operators use inside, one row without an id."""
    names = [c for c in CLASHES.split()]
    rows = [(i, t, "en", "s", len(t or ""), *["clash"] * len(names)) for i, t in [*edge_rows, (None, "no id " + prose(6, 40))]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, edge_docs):
    return spark.createDataFrame([], edge_docs.schema)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def pairs(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
