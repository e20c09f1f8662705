"""Checks of extracted lines against plain loops."""

import random

from specmill.operators import validators as V
from specmill.sources.scratch import Steps

LINES = "line_id long, inherit_from long, attributes map<string,string>"


def resolved(rows):
    by_id = {i: (up, {k: v for k, v in (bag or {}).items() if v is not None}) for i, up, bag in rows}
    out = {}
    for i, (up, own) in by_id.items():
        seen, bag, status = {i}, dict(own), "own" if up is None else "inherited"
        while up is not None:
            if up in seen:
                bag, status = own, "cycle"
                break
            if up not in by_id:
                status = "missing_parent"
                break
            seen.add(up)
            up, above = by_id[up]
            bag = {**above, **bag}
        out[i] = bag, status
    return out


def test_inheritance_is_that_of_walking_up(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, rng.randrange(150), i - 1 if i else None, 9999 if rng.random() < 0.2 else None]), rng.choice([None, {}, {rng.choice("abcd"): rng.choice(["1", "2", None]) for _ in range(3)}])) for i in range(150)]
    rows += [(200, 200, {"a": "x"}), (201, 202, {"a": "1"}), (202, 201, {"b": "2"}), (203, 201, {"c": "3"})]
    rows += [(1000 + i, 999 + i if i else None, {f"k{i % 7}": str(i)}) for i in range(700)]  # a long chain
    steps = Steps(spark, "test")
    got = {r.line_id: (r.attributes, r.status) for r in V.inherited(steps, spark.createDataFrame(rows, LINES)).collect()}
    assert got == resolved(rows)
    assert {s for _, s in got.values()} == {"own", "inherited", "missing_parent", "cycle"}
    assert steps.n <= 2 + 10 + 1  # the first state, log2 of the chain, and the round in which nothing ends


def test_nothing_inherits_from_nothing(spark):
    assert V.inherited(Steps(spark, "test"), spark.createDataFrame([], LINES)).count() == 0


def test_gaps_are_those_of_counting(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(4), ".".join(str(rng.randint(1, 6)) for _ in range(rng.randint(1, 3)))) for _ in range(60)] + [(0, None), (0, "A.1"), (0, ""), (1, "7."), (1, " 7 "), (9, "3"), (0, "1.2.3.4.5")]
    nodes = {}
    for t, n in rows:
        p = (n or "").strip().rstrip(".").split(".")
        if all(x.isdigit() for x in p):
            for k in range(len(p)):
                nodes.setdefault((t, ".".join(str(int(x)) for x in p[:k])), set()).add(int(p[k]))
    wanted = set()
    for (t, parent), own in nodes.items():
        missing = [x for x in range(1, max(own)) if x not in own]
        for b in own:
            if b - 1 in missing:
                a = max((x for x in own if x < b), default=0)
                wanted.add((t, parent, a, b, b - a - 1))
    got = V.numbering_gaps(spark.createDataFrame(rows, "tender_id long, line_no string")).collect()
    assert {tuple(r) for r in got} == wanted and len(got) == len(wanted) > 5


def test_counts_that_are_not_as_stated(spark):
    lines = spark.createDataFrame([(1, "3.1"), (1, "3.2"), (1, "3"), (1, "x"), (1, "4.1"), (2, "3.1")], "tender_id long, line_no string")
    sections = spark.createDataFrame([(1, 3, 2), (1, 4, 5), (1, 5, 0), (1, 6, 1), (2, 3, None)], "tender_id long, section long, stated long")
    assert {tuple(r) for r in V.stated_counts(sections, lines).collect()} == {(1, 4, 5, 1), (1, 6, 1, 0), (2, 3, None, 1)}
