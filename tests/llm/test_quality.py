import random

import numpy as np
from pyspark.sql import functions as F

from convoy.llm.quality import BUCKETS, QualityModel, _Tokens, fit_quality, keep_quality, quality_scores, token_buckets, train_network, word_vectors
from convoy.llm.common import texts


def corpus(make_prose, n=240):
    """Clean prose against capitals, signs and repeats; every third row is junk."""
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        text, bad = make_prose(i + 50, rng.randint(20, 150)), i % 3 == 0
        if bad:
            kind = rng.randrange(3)
            text = text.upper() + "!!" if kind == 0 else " ".join(w + "***" for w in text.split()) if kind == 1 else " ".join(f"{w} {w} {w}" for w in text.split())
        rows.append((i, text))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_held_out_accuracy(spark, make_prose):
    rows, labels = corpus(make_prose)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    found = {r.doc_id: r for r in quality_scores(docs, marks).collect()}
    held = {i for i, r in found.items() if r.held_out}
    assert held and held == {i for i, _ in rows if __import__("zlib").crc32(str(i).encode()) % 4 == 2}
    assert np.mean([found[i].predicted == y for i, y in labels if i in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found.values())
    # Labels of the held-out rows change nothing.
    flipped = spark.createDataFrame([(i, 1 - y if i in held else y) for i, y in labels], "doc_id long, quality int")
    assert {r.doc_id: r.score for r in quality_scores(docs, flipped).collect()} == {i: r.score for i, r in found.items()}
    kept = {r.doc_id for r in keep_quality(docs, marks).collect()}
    assert kept == {i for i, r in found.items() if r.predicted}


def test_word_vectors_count_every_word(spark):
    """The table is the same however the rows are dealt, and words in like contexts are alike."""
    rows = [(i, f"the {a} eats bread daily") for i, a in enumerate(["cat", "dog"] * 40)] + [(200 + i, "cold stone wall stands") for i in range(40)]
    docs = texts(spark.createDataFrame(rows, "doc_id long, text string"))
    table = word_vectors(docs.repartition(1))
    assert np.array_equal(table, word_vectors(docs.repartition(7)))
    cat, dog, wall = (table[token_buckets(w, _Tokens())[0]] for w in ("cat", "dog", "wall"))
    assert cat @ dog > 0.9 > cat @ wall
    assert table.shape[0] == BUCKETS


def test_temperature_softens():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] + rng.normal(0, 1.0, 600)) > 0).astype(float)
    net = train_network(x, y, epochs=40)
    assert net.temperature >= 1
    shares = [(net.scores(x)[(net.scores(x) > a) & (net.scores(x) <= a + 0.25)].mean(), y[(net.scores(x) > a) & (net.scores(x) <= a + 0.25)].mean()) for a in (0, 0.25, 0.5, 0.75)]
    assert all(abs(p - t) < 0.15 for p, t in shares)


def test_edges(spark, edge_docs, no_docs):
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (5, 1, 1), (13, 0, 0), (13, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality_scores(edge_docs, marks).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert len({r.score for r in rows if r.doc_id == 12}) == 1
    none = spark.createDataFrame([], marks.schema)
    assert {r.score for r in quality_scores(edge_docs, none).collect()} == {0.5}
    one_class = marks.filter(F.col("quality") == 1)
    assert all(r.predicted for r in quality_scores(edge_docs, one_class).collect())
    assert quality_scores(no_docs, marks).count() == 0
    kept = keep_quality(edge_docs, one_class)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()
    assert isinstance(fit_quality(texts(no_docs), marks), QualityModel)
