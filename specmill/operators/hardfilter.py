"""Hard filter of products by what a line requires, and the ladder of relaxations for lines that nothing fulfils."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import TOLERANCE
from ..sources.scratch import Steps

#: A requirement: ``place`` is its turn in the documented order of relaxation, null if it is never relaxed.
NEED = "struct<attr:string,op:string,num:double,txt:string,members:array<string>,place:int>"
#: A product's value: a number is the interval [lo, lo].
OFFER = "struct<lo:double,hi:double,txt:string,members:array<string>>"
#: The narrowest intervals share one width, 2 to this power.
LEAST_LEVEL = -20
#: How an attribute is looked up.
EQUAL, MEMBER, INSIDE, MISSING, ALL = "eq", "in", "iv", "no", "all"


def need(attr: str, op: str, num: Column | None = None, txt: Column | None = None, members: Column | None = None, place: int | None = None) -> Column:
    null = F.lit(None)
    return F.struct(F.lit(attr), F.lit(op), *(null if c is None else c for c in (num, txt, members)), F.lit(place)).cast(NEED)


def offer(lo: Column | None = None, hi: Column | None = None, txt: Column | None = None, members: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(*(null if c is None else c for c in (lo, lo if hi is None else hi, txt, members))).cast(OFFER)


def holds(n: Column, o: Column) -> Column:
    """SCA-3 with intervals and sets: whether an offer meets a requirement, null where the product has no value.

    ``range_contains``: the required point is within the offered interval; ``superset``: all required members are offered.
    """
    return (
        F.when(n["op"] == "gte", o["lo"] >= n["num"])
        .when(n["op"] == "lte", o["lo"] <= n["num"])
        .when(n["op"] == "range_contains", (o["lo"] <= n["num"]) & (n["num"] <= o["hi"]))
        .when(n["op"] == "superset", F.size(F.array_except(n["members"], o["members"])) == 0)
        .when(n["txt"].isNotNull(), F.lower(F.trim(n["txt"])) == F.lower(F.trim(o["txt"])))
        .otherwise(F.abs(n["num"] - o["lo"]) < TOLERANCE)
    )


def _level(width: Column) -> Column:
    return F.greatest(F.lit(LEAST_LEVEL), F.ceil(F.log2(F.when(width > 0, width)))).cast("int")


def _bin(x: Column, level: Column) -> Column:
    return F.concat_ws(":", level.cast("string"), F.floor(x / F.pow(F.lit(2.0), level)).cast("string"))


def lookup(products: DataFrame, asked: DataFrame) -> DataFrame:
    """(class_id, attr, kind, key, product_id) over (product_id, class_id, has): what a requirement can be looked up by. ``asked`` has the (class_id, attr) of requirements.

    Text by its value, a set by each member, an interval by the one or two bins of its own width that it touches, so that wide and narrow intervals of one
    attribute each have few keys; a product by each attribute asked of its class that it lacks.
    """
    each = products.select("product_id", "class_id", F.explode("has").alias("attr", "o"))
    keyed = lambda rows, kind, key: rows.select("class_id", "attr", F.lit(kind).alias("kind"), key.alias("key"), "product_id")
    level = F.coalesce(_level(F.col("o.hi") - F.col("o.lo")), F.lit(LEAST_LEVEL))
    bins = F.explode(F.array_distinct(F.array(_bin(F.col("o.lo"), level), _bin(F.col("o.hi"), level))))
    known = asked.groupBy("class_id").agg(F.collect_set("attr").alias("attrs"))  # as many as a class has attributes
    lacking = products.join(known, "class_id").select("product_id", "class_id", F.explode(F.array_except("attrs", F.map_keys("has"))).alias("attr"))
    parts = [
        keyed(each.where("o.txt is not null"), EQUAL, F.lower(F.trim(F.col("o.txt")))),
        keyed(each.where("o.members is not null").select("class_id", "attr", "product_id", F.explode("o.members").alias("m")), MEMBER, F.col("m")).distinct(),
        keyed(each.where("o.lo is not null and o.hi is not null").select("class_id", "attr", "product_id", bins.alias("b")), INSIDE, F.col("b")),
        keyed(lacking, MISSING, F.lit("")),
        keyed(products.select("class_id", "product_id", F.lit("").alias("attr")), ALL, F.lit("")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _paths(specs: DataFrame, keys: DataFrame) -> DataFrame:
    """(spec, class_id, attr, kind, key): of each spec the requirement that fewest products share, and the keys to look it up by. A spec without one that can be looked up has its whole class."""
    counts = keys.where(F.col("kind") != MISSING).groupBy("class_id", "attr", "kind", "key").agg(F.count("*").alias("n"))
    levels = counts.where(F.col("kind") == INSIDE).select("class_id", "attr", F.substring_index("key", ":", 1).cast("int").alias("level")).distinct()
    levels = levels.groupBy("class_id", "attr").agg(F.collect_set("level").alias("levels"))
    each = specs.select("spec", "class_id", F.explode("active").alias("n")).select("spec", "class_id", "n", F.col("n.attr").alias("attr"))
    probe = lambda rows, kind, path, key: rows.select("spec", "class_id", "attr", F.lit(kind).alias("kind"), path.alias("path"), key.alias("key"))
    text = each.where("n.op = 'eq' and n.txt is not null")
    sets = each.where("n.op = 'superset' and size(n.members) > 0").select("spec", "class_id", "attr", F.explode("n.members").alias("m"))
    points = each.where("n.op = 'range_contains'").join(levels, ["class_id", "attr"]).select("spec", "class_id", "attr", "n", F.explode("levels").alias("level"))
    whole = specs.select("spec", "class_id", F.lit("").alias("attr"))
    probes = [
        probe(text, EQUAL, F.lit(""), F.lower(F.trim(F.col("n.txt")))),
        probe(sets, MEMBER, F.col("m"), F.col("m")),
        probe(points, INSIDE, F.lit(""), _bin(F.col("n.num"), F.col("level"))),
        probe(whole, ALL, F.lit(""), F.lit("")),
    ]
    sized = reduce(DataFrame.unionByName, probes).join(counts, ["class_id", "attr", "kind", "key"], "left")
    each_path = sized.groupBy("spec", "class_id", "attr", "kind", "path").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.collect_list("key").alias("keys"))
    # by class: a widened spec has several
    best = each_path.groupBy("spec", "class_id").agg(F.min(F.struct("n", "kind", "attr", "path", "keys")).alias("b"))
    return best.select("spec", "class_id", "b.attr", "b.kind", F.explode("b.keys").alias("key"))


def _judged(specs: DataFrame, products: DataFrame, keys: DataFrame, unverifiable: bool) -> DataFrame:
    """(spec, n_eligible, first_product, n_unverifiable) of the specs (spec, class_id, active) that some product fulfils, or may fulfil if its missing values were known."""
    path = _paths(specs, keys)
    if unverifiable:  # products that lack what the look-up is by
        path = path.unionByName(path.where(F.col("kind") != ALL).select("spec", "class_id", "attr", F.lit(MISSING).alias("kind"), F.lit("").alias("key")).distinct())
    met = path.join(keys, ["class_id", "attr", "kind", "key"]).select("spec", "class_id", "product_id")
    met = met.join(products.select("product_id", "has").hint("merge"), "product_id").join(specs.select("spec", "class_id", "active"), ["spec", "class_id"])
    verdicts = F.transform("active", lambda n: holds(n, F.element_at("has", n["attr"])))
    open_ = F.size(F.filter("v", lambda v: v.isNull()))
    fits = met.select("spec", "product_id", verdicts.alias("v")).where(~F.exists("v", lambda v: F.coalesce(~v, F.lit(False)))).select("spec", "product_id", (open_ == 0).alias("sure"))
    out = fits.groupBy("spec").agg(F.count_if("sure").alias("n_eligible"), F.min(F.when(F.col("sure"), F.col("product_id"))).alias("first_product"), F.count_if(~F.col("sure")).alias("n_unverifiable"))
    return out


def hard_filter(steps: Steps, lines: DataFrame, products: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """line_id, level, dropped, widened, n_eligible, first_product, n_unverifiable of every line (line_id, class_id, needs).

    ``products`` (product_id, class_id, has), ``crosswalk`` (from_class, to_class). A product is eligible if it meets every requirement with a known
    value; one that lacks values but violates nothing is unverifiable, and counted for the unrelaxed requirements. Where nothing is
    eligible, requirements with a ``place`` are dropped one after the other in that order, and at last the classes that the crosswalk leads to are added. level
    is the number of these steps, dropped names them; requirements without a place (required or safety-critical ones) hold at every level. After the
    last level: level and first_product null, n_eligible 0. A line without a class, or without requirements, is judged as it stands: no class, no product; no requirement, any product.

    Lines that ask the same are judged once; a level sees only those without a product so far; each looks products up by its
    rarest requirement (value, member or interval bin) before all others are checked.
    """
    keyed = lines.withColumn("needs", F.coalesce("needs", F.array().cast(f"array<{NEED}>"))).withColumn("spec", F.sha2(F.to_json(F.struct("class_id", "needs")), 256))
    keyed = steps.write(keyed.select("line_id", "class_id", "needs", "spec"))
    places = F.array_sort(F.transform(F.filter("needs", lambda n: n["place"].isNotNull()), lambda n: F.struct(n["place"].alias("place"), n["attr"].alias("attr"))))
    specs = keyed.groupBy("spec").agg(F.first("class_id").alias("class_id"), F.first("needs").alias("needs"))
    specs = steps.write(specs.select("spec", "class_id", "needs", F.transform(places, lambda x: x["attr"]).alias("order")))
    products = products.where("class_id is not null")
    asked = specs.select("class_id", F.explode("needs.attr").alias("attr")).distinct()
    keys = steps.write(lookup(products, asked))
    last = (specs.agg(F.max(F.size("order"))).first()[0] or 0) + 1
    left, done, open_counts = specs.where("class_id is not null"), [], None
    for level in range(last + 1):
        steps_left = F.size("order")
        # the ladder of a spec: its own number of drops, then the crosswalk
        now = left.where(F.lit(level) <= steps_left + 1)
        dropped = F.slice("order", 1, F.least(F.lit(level), steps_left))
        widened = F.lit(level) > steps_left
        now = now.select("spec", "class_id", dropped.alias("dropped"), widened.alias("widened"), F.filter("needs", lambda n: ~F.array_contains(dropped, n["attr"])).alias("active"))
        now = steps.write(now)
        wider = now.where("widened").join(crosswalk.select(F.col("from_class").alias("class_id"), "to_class"), "class_id").select("spec", F.col("to_class").alias("class_id"), "dropped", "widened", "active")
        judged = steps.write(_judged(now.unionByName(wider), products, keys, level == 0))
        if level == 0:
            open_counts = judged.select("spec", "n_unverifiable")
        good = judged.where("n_eligible > 0").select("spec", "n_eligible", "first_product")
        done.append(good.join(now.select("spec", "dropped", "widened"), "spec").withColumn("level", F.lit(level)))
        left = steps.write(left.join(good.select("spec"), "spec", "left_anti"))
    found = reduce(DataFrame.unionByName, done)
    empty = F.array().cast("array<string>")
    out = keyed.select("line_id", "spec").join(found, "spec", "left").join(open_counts, "spec", "left")
    return out.select("line_id", "level", F.coalesce("dropped", empty).alias("dropped"), F.coalesce("widened", F.lit(False)).alias("widened"), F.coalesce("n_eligible", F.lit(0)).alias("n_eligible"), "first_product", F.coalesce("n_unverifiable", F.lit(0)).alias("n_unverifiable"))

