"""The hard filter and its ladder against plain evaluation of every pair."""

import json
import random

from pyspark.sql import functions as F

from specmill.functions.numbers import verdict
from specmill.operators import hardfilter as H
from specmill.sources.scratch import Steps

OPS = {"volts": "gte", "weight": "lte", "poles": "eq", "colour": "eq", "rating": "range_contains", "marks": "superset"}


def fits(n, o):
    if o is None:
        return None
    if n["op"] == "gte":
        return o["lo"] >= n["num"]
    if n["op"] == "lte":
        return o["lo"] <= n["num"]
    if n["op"] == "range_contains":
        return o["lo"] <= n["num"] <= o["hi"]
    if n["op"] == "superset":
        return set(n["members"]) <= set(o["members"])
    return n["txt"].strip().lower() == o["txt"].strip().lower() if n["txt"] is not None else n["num"] == o["lo"]


def plain(lines, products, crosswalk):
    out = {}
    for line, cls, needs in lines:
        needs = needs or []
        order = [n["attr"] for n in sorted((n for n in needs if n["place"] is not None), key=lambda n: n["place"])]
        found, n_open = None, 0
        for level in range(len(order) + 2):
            if cls is None:
                break
            dropped, wide = order[:level], level > len(order)
            classes = {cls} | ({b for a, b in crosswalk if a == cls} if wide else set())
            active = [n for n in needs if n["attr"] not in dropped]
            verdicts = [(p, [fits(n, has.get(n["attr"])) for n in active]) for p, c, has in products if c in classes]
            sure = [p for p, v in verdicts if all(v)]
            if level == 0:
                n_open = sum(1 for _, v in verdicts if None in v and False not in v)
            if sure:
                found = level, dropped, wide, len(sure), min(sure)
                break
        out[line] = (*(found or (None, [], False, 0, None)), n_open)
    return out


def random_case(seed):
    rng = random.Random(seed)
    classes = ["a", "b", "c", None]

    def has():
        out = {}
        value = lambda **x: {"lo": None, "hi": None, "txt": None, "members": None} | x
        for attr in OPS:
            if rng.random() < 0.15:
                continue
            x = float(rng.choice([0, 1, 2, 5, 10, 100, -3, 0.5]))
            if attr in ("volts", "weight", "poles"):
                out[attr] = value(lo=x, hi=x)
            elif attr == "colour":
                out[attr] = value(txt=rng.choice(["Red", " red", "blue", "green"]))
            elif attr == "rating":
                out[attr] = value(lo=x, hi=x + rng.choice([0, 0.25, 1, 7, 1000]))
            else:
                out[attr] = value(members=[m for m in "wxyz" if rng.random() < 0.6])
        return out

    def needs():
        out = []
        for k, (attr, op) in enumerate(OPS.items()):
            if rng.random() < 0.5:
                continue
            n = {"attr": attr, "op": op, "num": None, "txt": None, "members": None, "place": k if attr not in ("rating", "poles") and rng.random() < 0.8 else None}
            if attr == "colour":
                n["txt"] = rng.choice(["RED", "blue ", "black"])
            elif attr == "marks":
                n["members"] = [m for m in "wxyzq" if rng.random() < 0.4]
            else:
                n["num"] = float(rng.choice([0, 1, 2, 5, 10, 0.5, -3, 7, 101]))
            out.append(n)
        return out

    products = [(i, rng.choice(classes), has()) for i in range(60)] + [(100, "lonely", {})]
    lines = [(i, rng.choice(classes), needs()) for i in range(90)] + [(200, "lonely", needs()), (201, "a", None), (202, "a", []), (203, "nowhere", needs()), (204, None, None)]
    return lines + [(300, *lines[0][1:])], products, [("a", "b"), ("b", "a"), ("b", "c"), ("lonely", "a")]


def test_the_ladder_is_that_of_all_pairs(spark):
    for seed in (1, 2):
        lines, products, crosswalk = random_case(seed)
        rows = spark.createDataFrame([(i, c, json.dumps(n) if n is not None else None) for i, c, n in lines], "line_id long, class_id string, n string").select("line_id", "class_id", F.from_json("n", f"array<{H.NEED}>").alias("needs"))
        stock = spark.createDataFrame([(i, c, json.dumps(h)) for i, c, h in products], "product_id long, class_id string, h string").select("product_id", "class_id", F.from_json("h", f"map<string,{H.OFFER}>").alias("has"))
        got = H.hard_filter(Steps(spark, "test"), rows, stock, spark.createDataFrame(crosswalk, "from_class string, to_class string")).collect()
        assert {r.line_id: (r.level, r.dropped, r.widened, r.n_eligible, r.first_product, r.n_unverifiable) for r in got} == plain(lines, products, crosswalk)
        assert len(got) == len(lines)


def test_an_interval_has_two_keys_at_most_and_a_point_finds_it(spark):
    rng = random.Random(4)
    spans = [(i, "c", lo := rng.uniform(-50, 50), lo + rng.choice([0, 1e-9, 0.3, 4, 90, 1e6])) for i in range(200)]
    stock = spark.createDataFrame(spans, "product_id long, class_id string, lo double, hi double").select("product_id", "class_id", F.create_map(F.lit("r"), H.offer(F.col("lo"), F.col("hi"))).alias("has"))
    keys = H.lookup(stock, spark.createDataFrame([("c", "r")], "class_id string, attr string")).where("kind = 'iv'")
    assert keys.count() <= 2 * len(spans)
    points = [spans[i][2] for i in range(0, 200, 20)] + [0.0, 1e5]
    needs = F.array(H.need("r", "range_contains", num=F.col("x")))
    asked = spark.createDataFrame([(i, "c", x) for i, x in enumerate(points)], "line_id long, class_id string, x double").select("line_id", "class_id", needs.alias("needs"))
    got = {r.line_id: r.n_eligible for r in H.hard_filter(Steps(spark, "test"), asked, stock, spark.createDataFrame([], "from_class string, to_class string")).collect()}
    assert got == {i: sum(lo <= x <= hi for _, _, lo, hi in spans) for i, x in enumerate(points)}


def test_no_rows(spark):
    none = spark.createDataFrame([], f"line_id long, class_id string, needs array<{H.NEED}>")
    stock = spark.createDataFrame([], f"product_id long, class_id string, has map<string,{H.OFFER}>")
    ways = spark.createDataFrame([], "from_class string, to_class string")
    assert H.hard_filter(Steps(spark, "test"), none, stock, ways).count() == 0
    lines = spark.createDataFrame([(1, "a", [])], none.schema)
    assert H.hard_filter(Steps(spark, "test"), lines, stock, ways).first().level is None


def test_verdicts_on_ranges_and_sets(spark):
    rows = [
        ("range_contains", "80", "63–100 A adjustable", "COMPLIANT"), ("range_contains", "101", "63–100 A", "DEVIATION"), ("range_contains", "5", "≥ 3", "COMPLIANT"), ("range_contains", "x", "1-2", "UNVERIFIABLE"),
        ("superset", "CE, ul", "UL,CE,GS", "COMPLIANT"), ("superset", "CE,IEC", "CE", "DEVIATION"), ("superset", "CE", None, "UNVERIFIABLE"),
    ]
    frame = spark.createDataFrame(rows, "op string, required string, offered string, wanted string")
    got = frame.select("wanted", verdict(F.lit("rating"), F.lit("text"), F.col("op"), F.col("required"), F.col("offered")).alias("v")).collect()
    assert [r.v for r in got] == [r.wanted for r in got]
