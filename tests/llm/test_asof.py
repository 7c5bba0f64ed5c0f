"""The point-in-time join against a plain scan of all versions."""

import random
from collections import Counter

import numpy as np
import pytest

from quill.llm import asof


def plain(asks, versions):
    out = Counter()
    for k, t, tag in asks:
        fit = [(e, a, i) for key, e, a, x, i in versions if None not in (key, e, a, x, k, t) and key == k and e <= t and a <= t < x]
        out[(k, t, tag, max(fit, default=None))] += 1
    return out


def solved(spark, asks, versions, slice_rows):
    q = spark.createDataFrame(asks, "key string, t long, version string")
    v = spark.createDataFrame(versions, "key string, event long, arrival long, expiry long, i long")
    got = asof.point_in_time(q, v, ties=("i",), slice_rows=slice_rows)
    assert got.columns == ["key", "t", "version", "version_"]
    return Counter((r[0], r[1], r[2], tuple(r[3]) if r[3] else None) for r in got.collect())


@pytest.mark.parametrize("slice_rows", [1, 6, 64, 10**6])
def test_every_slicing_gives_the_same(spark, slice_rows):
    rng = random.Random(slice_rows)
    versions = []
    for i in range(400):
        event = rng.randint(-50, 300)
        long = rng.choice([1, 5, 40, 400])
        versions.append((rng.choice("aaaab"), event, event + rng.randint(-30, 30), event + rng.randint(0, long), i // 2))
    versions += [versions[0]] * 5 + [(None, 1, 1, 9, 1), ("a", None, 1, 9, 1), ("a", 1, None, 9, 1), ("a", 1, 1, None, 1), ("a", 5, 5, 5, 7), ("a", 5, 9, 7, 8), ("b", -(10**9), -(10**9), 10**9, 3)]
    asks = [(rng.choice("aaabc"), rng.randint(-60, 350), str(i)) for i in range(300)]
    asks += [("a", 17, "twice")] * 4 + [(None, 3, "x"), ("a", None, "y"), (None, None, None), ("b", 10**9, "end"), ("b", 10**9 - 1, "last"), ("b", -(10**9), "first")]
    assert solved(spark, asks, versions, slice_rows) == plain(asks, versions)


def test_one_key_at_one_second(spark):
    versions = [("k", 7, 7, 8 + i % 5, i) for i in range(3000)]
    asks = [("k", t, "") for t in range(5, 15) for _ in range(3)]
    assert solved(spark, asks, versions, 10) == plain(asks, versions)


def test_empty_sides(spark):
    assert solved(spark, [], [("a", 1, 1, 2, 1)], 5) == Counter()
    assert solved(spark, [("a", 1, "q")], [], 5) == Counter({("a", 1, "q", None): 1})


def test_roots_stay_and_share_their_nodes():
    rng = np.random.default_rng(3)
    group = np.sort(rng.integers(0, 3, 200))
    place = np.concatenate([np.arange(n) for n in np.bincount(group)]) % 37
    time, value = rng.integers(0, 50, 200), np.where(rng.random(200) < 0.3, -1, place)
    value = np.where(value >= 0, place, -1)
    forest = asof.Forest(group, place, time, value)
    order = np.lexsort((time, group))
    for g in range(3):
        own = [i for i in order if group[i] == g]
        for t in range(-1, 51):
            leaves = {}
            for i in own:
                if time[i] <= t:
                    leaves[place[i]] = value[i]
            assert forest.best(g, np.array([t]))[0] == max(leaves.values(), default=-1)
    # Each edit makes one node a level, and the children it doesn't write are older nodes.
    for left, right in forest.children:
        n = np.arange(len(left))
        assert ((left == n) ^ (right == n)).all()
        assert (left <= len(n)).all() and (right <= len(n)).all()


def test_features_of_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, "s", 10 * i, "en", 1) for i in range(2000)] + [(3, "s", 31, "fr", 1), (5, None, 1, "de", 1), (None, "s", 1, "en", 1), (7000, None, 1, None, 1), (8000, "s", None, None, 1)],
        "doc_id long, source string, n_chars long, lang string, t int",
    )
    labels = spark.createDataFrame([(i % 1000,) for i in range(3000)] + [(None,), (None,), (7000,), (99999,), (8000,)], "doc_id long")
    got = asof.features(docs, labels).collect()
    assert len(got) == 3005
    assert Counter(r.doc_id for r in got) == Counter([i % 1000 for i in range(3000)] + [None, None, 7000, 99999, 8000])
    of = {r.doc_id: r for r in got}
    assert [of[k].status for k in (None, 7000, 99999)] == ["none"] * 3 and of[None].t is None and of[99999].t is not None
    assert all((r.n_chars is None) == (r.status != "fresh") or r.version_id == 8000 for r in got)
    assert any(r.status == "fresh" for r in got)
