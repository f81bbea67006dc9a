import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from convoy.llm.line_dedup import LineRuns, drop_repeated_lines, line_keys, long_keys

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_chars=40, min_docs=5):
    held, last = Counter(), {}
    for i, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            held[k] += 1
            known = [x for x in (last.get(k), i) if x is not None]
            last[k] = max(known) if known else None
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or held[key(x)] < min_docs or last[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def got(df, **options):
    return sorted((tuple(r) for r in drop_repeated_lines(df, **options).collect()), key=str)


def test_documents(documents, pairs):
    want = brute(pairs)
    assert got(documents) == want
    assert sum(r[3] for r in want) > 0


@pytest.mark.parametrize("fanout", [2, 3, 9])
def test_any_number_of_levels(documents, pairs, fanout):
    assert got(documents, batches=6, fanout=fanout) == brute(pairs)


def test_edges(spark, edge_docs, no_docs):
    rows = [tuple(r) for r in edge_docs.select("doc_id", "text").collect()]
    assert got(edge_docs, min_chars=1, min_docs=2) == brute(rows, 1, 2)
    assert got(edge_docs) == brute(rows)
    assert drop_repeated_lines(no_docs).count() == 0


def test_null_ids_repeated_rows_and_line_ends(spark):
    line = "A Line that is repeated across documents, é and all"
    rows = [(i, f"own {i}\n \t{line}\r\n\n{line.lower()}") for i in range(6)]
    rows += [(None, line), (None, f"{line}\n{line}"), (5, f"other\n{line}"), (5, f"other\n{line}"), (7, "É" * 40), (8, "é" * 40), (9, None), (10, "\n\n")]
    rows += [(None, "held by rows without an id only, " + "x" * 20)] * 6
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)
    named = spark.createDataFrame([(f"n{i}", line) for i in range(12)], "doc_id string, text string")
    assert [r.doc_id for r in drop_repeated_lines(named).filter("text <> ''").collect()] == ["n9"]


def test_hot_lines_and_borders_of_counts(spark):
    """One line in every document, others in 4 and 5, and a document of very many lines."""
    rng = random.Random(5)
    hot, four, five = ("hot " * 15), ("in four documents " * 3), ("in five documents " * 3)
    rows = []
    for i in range(900):
        lines = [f"only here {i} " + "abc " * 10, hot] + [four] * (i in (3, 30, 300, 600)) + [five] * (i in (3, 30, 300, 600, 700))
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows.append((1000, "\n".join(f"line {k % 700} of a long text {'z' * 30}" for k in range(30_000))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute(rows)
    assert got(df) == want
    assert sum(r[3] for r in want) == 900 - 0 - 1 + 4


def test_a_key_is_in_one_run_and_few_runs_stay(spark):
    runs = LineRuns(spark, fanout=2, buckets=3)
    for b in range(7):
        rows = [(k, k * 7, 1, b) for k in range(b * 10, b * 10 + 30)]
        runs.add(spark.createDataFrame(rows, "h1 long, h2 long, docs long, last long"))
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    stored = [r.h1 for level in runs.levels for name in level for r in runs.run(name).collect()]
    assert sorted(stored) == list(range(90))
    totals = {r.h1: (r.docs, r["last"]) for r in runs.totals().collect()}
    assert totals == {k: (sum(b * 10 <= k < b * 10 + 30 for b in range(7)), max(b for b in range(7) if b * 10 <= k < b * 10 + 30)) for k in range(90)}
    plan = spark.table(runs.again[-1]).join(runs.run(runs.levels[0][0]).hint("merge"), ["h1", "h2"], "left")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    names = list(runs._paths)
    runs.close()
    assert not any(spark.catalog.tableExists(name) for name in names)


def test_keys():
    assert line_keys("A b \n\tÉC\r") == ["a b".encode(), "Éc".encode()]
    assert [k for k, _ in long_keys("é" * 39 + "\n" + "é" * 40 + "\n" + "a" * 40, 40)] == [1, 2]
