"""The overlap join against all pairs, and its rows on one long paper."""

import random

import numpy as np
import pytest

from quill.operators import layout, overlap


def plain(intervals, spans):
    out = {}
    for k, a, b in intervals:
        hit = [v for p, s, e, v in spans if None not in (k, a, b, s, e, v) and p == k and s < b and e > a and a <= b and s <= e]
        if hit:
            out[k, a, b] = (min(hit), max(hit))
    return out


@pytest.mark.parametrize("bin_rows", [1, 8, 512])
def test_every_bin_width_gives_the_same(spark, bin_rows):
    rng = random.Random(bin_rows)
    cut = lambda most: (s := rng.randint(0, 400), s + rng.choice([0, 1, 3, rng.randint(0, most)]))
    spans = [(rng.choice("aab"), *cut(300), rng.randint(-5, 50)) for _ in range(150)] + [("a", None, 3, 1), ("a", 1, None, 1), (None, 1, 9, 1), ("a", 1, 9, None), ("c", 5, 5, 7), ("c", 0, 10**9, 8)]
    intervals = [(rng.choice("aabc"), *cut(400)) for _ in range(150)] + [("c", 3, 8), ("c", 5, 5), ("c", 10**9, 10**9 + 5), ("c", 10**9 - 1, 10**9), (None, 1, 2), ("a", None, 2), ("d", 1, 9), ("a", 9, 1)]
    got = overlap.overlap_range(spark.createDataFrame(intervals, "p string, s long, e long"), spark.createDataFrame(spans, "p string, s long, e long, v int"), "p", "s", "e", "v", bin_rows)
    assert {(r.p, r.s, r.e): (r.low, r.high) for r in got.collect()} == plain(intervals, spans)


def test_sweep_of_one_bin():
    rng = np.random.default_rng(5)
    a, s = rng.integers(0, 60, 200), rng.integers(0, 60, 300)
    b, e, v = a + rng.integers(0, 20, 200), s + rng.integers(0, 20, 300), rng.integers(0, 9, 300)
    low, high = overlap.swept(a, b, s, e, v)
    for i in range(200):
        hit = v[(s < b[i]) & (e > a[i])]
        assert (low[i], high[i]) == ((hit.min(), hit.max()) if len(hit) else (np.inf, -np.inf))


def test_one_paper_of_many_spans(spark):
    n = 100_000
    spans = spark.range(n).selectExpr("'p' AS paper_id", "id * 10 AS char_start", "id * 10 + 9 AS char_end", "cast(id / 50 AS int) + 1 AS page")
    intervals = spark.range(2000).selectExpr("'p' AS paper_id", "id * 500 AS char_start", "id * 500 + 300000 AS char_end", "id AS tag")
    got = layout.page_range(intervals, spans)
    rows = {r.tag: (r.page_start, r.page_end) for r in got.collect()}
    assert rows[0] == (1, 600) and rows[1999] == (1 + 1999 * 50 // 50, 2000) and len(rows) == 2000
    metrics = got._jdf.queryExecution().executedPlan()
    made, todo = [], [metrics]
    while todo:
        node = todo.pop()
        if node.metrics().contains("numOutputRows"):
            made.append(node.metrics().apply("numOutputRows").value())
        inner = node.executedPlan() if node.nodeName().startswith("AdaptiveSparkPlan") else node.plan() if "QueryStage" in node.nodeName() else None
        kids = node.children()
        todo.extend([kids.apply(i) for i in range(kids.size())] + ([inner] if inner is not None else []))
    assert max(made) < 4 * n  # pairs would be thirty thousand for each interval
