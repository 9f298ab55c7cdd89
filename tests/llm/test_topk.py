import math
import random

import pytest

from tidewater.llm import topk


def slow(rows, every, k):
    ok = [(n, d, [math.floor(1024 * x) for x in v]) for n, (d, v) in enumerate(rows) if d is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, d, q in ok:
        if d % every == 0:
            found = sorted((-max(min(sum(a * b for a, b in zip(q, v)), 2**63 - 1), -(2**63)), e) for m, e, v in ok if m != n)[:k]  # noqa: B905
            out += [(d, r, e, -s) for r, (s, e) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, every=5, k=4):
    return sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every, k).collect()))


@pytest.mark.parametrize("scale", [1.0, 0.01, 1e7, 1e12])
def test_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "TILE", 3)
    monkeypatch.setattr(topk, "ROOT", 4)
    monkeypatch.setattr(topk, "ROWS", 16)
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, scale) for _ in range(40)]) for i in range(130)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (200, None), (None, rows[0][1]), (205, [None] * 40), (210, [float("nan")] * 40), (215, [float("inf")] + [0.0] * 39), (220, [scale] * 3), (225, []), (230, [0.0] * 40), (231, [0.0] * 40)]
    assert run(spark, rows) == slow(rows, 5, 4)


def test_few_and_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (3, [0.5]), (1, [0.5])]) == [(0, 1, 1, 1024 * 512), (0, 2, 3, 1024 * 512)]


def test_rows_are_not_shuffled(spark, monkeypatch):
    """What is handed on is a few rows per query and task, and columns that clash are ignored."""
    handed = []
    stored = topk.stored
    monkeypatch.setattr(topk, "stored", lambda df, what: handed.append((what, df, stored(df, what))) or handed[-1][2])
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], i, i) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long, q long").repartition(4)
    out = topk.top_k(df, 20, 3)
    assert sorted(map(tuple, out.collect())) == slow([r[:2] for r in rows], 20, 3)
    found = [x[1:] for x in handed if x[0] == "found"]
    assert len(found) == 1 and found[0][1].count() <= 4 * 20 * 4
    plan = found[0][0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1  # this test's own
