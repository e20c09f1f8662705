"""Calibration, thresholds and routing against plain loops in fractions."""

import random
from fractions import Fraction

import pytest

from specmill.operators import calibration as C

REVIEWS = "group string, confidence double, correct boolean, extra int"


def fitted(points):
    """(value, share) of {value: (n, k)}: the largest, over starts at or below, of the smallest mean to ends at or above."""
    at = sorted(points)
    mean = lambda i, j: Fraction(sum(points[x][1] for x in at[i : j + 1]), sum(points[x][0] for x in at[i : j + 1]))
    return {at[i]: max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))}


def made(seed):
    rng = random.Random(seed)
    rows = [(g, float(c), rng.random() * 100 < c + rng.choice([-20, 0, 10]), 1) for g in ("a", "b", "hot", "hot", "hot") for c in (rng.choice([rng.randint(0, 100), rng.randint(90, 140), -5]) for _ in range(120))]
    rows += [(None, 3.0, True, 1), ("a", None, True, 1), ("a", 5.0, None, 1), ("a", float("nan"), True, 1), ("one", 7.0, False, 1), ("b", -0.0, True, 1), ("b", 0.0, False, 1)]
    return rows * 2


def counted(rows):
    out = {}
    for g, c, ok, _ in rows:
        if g is not None and ok is not None and c is not None and c == c:
            n, k = out.setdefault(g, {}).get(c, (0, 0))
            out[g][c] = n + 1, k + ok
    return out


@pytest.mark.parametrize("seed, fan, parts", [(1, 2, "7"), (2, 32, "1"), (3, 3, "8")])
def test_blocks_are_the_isotonic_fit(spark, monkeypatch, seed, fan, parts):
    monkeypatch.setattr(C, "FAN", fan)
    rows, before = made(seed), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = C.isotonic_blocks(spark.createDataFrame(rows, REVIEWS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for g, points in counted(rows).items():
        fit = fitted(points)
        want = [(min(vs), max(vs), sum(points[v][0] for v in vs), sum(points[v][1] for v in vs)) for p in sorted(set(fit.values())) for vs in [[v for v in fit if fit[v] == p]]]
        assert sorted((r.low, r.high, r.n, r.n_correct) for r in got if r.group == g) == want
    assert {r.group for r in got} == {"a", "b", "hot", "one"}


def test_thresholds_and_routes_are_those_of_a_plain_search(spark):
    rows = made(4) + [("good", float(c), c > 20, 1) for c in range(100)]
    blocks = C.isotonic_blocks(spark.createDataFrame(rows, REVIEWS))
    limits = C.thresholds(blocks, most_wrong=100)
    asked = [(g, c, i) for i, (g, c) in enumerate((g, c) for g in ("a", "b", "hot", "one", "good", "new", None) for c in (None, float("nan"), float("-inf"), -7.0, 0.0, 20.5, 55.0, 99.0, 130.5, float("inf")))]
    frame = spark.createDataFrame(asked, "group string, confidence double, p int").withColumnRenamed("p", "id")
    got = {r.id: (r.p, r.route) for r in C.routed(frame, blocks, limits).collect()}
    steps = {g: fitted(points) for g, points in counted(rows).items()}
    limit = {}
    for g, points in counted(rows).items():
        values = sorted(set(steps[g].values()))
        lows = [min(v for v in steps[g] if steps[g][v] == p) for p in values]
        ok = [t for t in lows if 1000 * sum(n - k for v, (n, k) in points.items() if v >= t) <= 100 * sum(n for v, (n, _) in points.items() if v >= t)]
        limit[g] = min(ok, default=None)
    assert {r.group: r.threshold for r in limits.collect()} == limit
    assert limit["good"] is not None and limit["one"] is None
    assert len(got) == len(asked)
    for g, c, i in asked:
        if g not in steps or c is None or c != c:
            assert got[i] == (None, "unscored")
            continue
        below = [v for v in steps[g] if v <= c]
        assert got[i][0] == float(steps[g][max(below) if below else min(steps[g])])
        assert got[i][1] == ("auto" if limit[g] is not None and c >= limit[g] else "review")


def test_nothing_in_nothing_out(spark):
    empty = spark.createDataFrame([], REVIEWS)
    blocks = C.isotonic_blocks(empty)
    assert blocks.count() == 0
    assert C.thresholds(blocks).count() == 0
    assert [r.route for r in C.routed(spark.createDataFrame([("a", 1.0)], "group string, confidence double"), blocks, C.thresholds(blocks)).collect()] == ["unscored"]
