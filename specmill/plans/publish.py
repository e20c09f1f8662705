"""Queries on publishing and on class scoping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import publish as P
from ..operators import scoping as S
from . import adapter as A
from .registry import register
from .retrieval import WORDS

# what a run says of a cell: the strongest source, of equal ones the smallest value
CELLS = """o as (select l_partkey as product_id, date_trunc('month', l_shipdate)::date as run, l_linenumber % 6 as k, unnest([
    {'field': 'tax', 'value': printf('%.2f', l_tax)}, {'field': 'discount', 'value': printf('%.2f', l_discount)}, {'field': 'flag', 'value': l_returnflag}], recursive := true) from lineitem),
  s as (select product_id, field, run, k + 1 as strength, min(value) as value from o where k = (select min(k) from o x where x.product_id = o.product_id and x.field = o.field and x.run = o.run) group by all)"""
SOURCES = "['human', 'feed', 'decoder', 'cert_registry', 'llm_parse', 'scrape']"


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax, discount and flag of each part, as the lines that ship in a month say; the line's number stands for the source."""
    item = A.table(spark, sf_dir, "lineitem")
    cell = lambda name, v: F.struct(F.lit(name).alias("field"), v.alias("value"))
    cells = F.explode(F.array(cell("tax", F.format_string("%.2f", "l_tax")), cell("discount", F.format_string("%.2f", "l_discount")), cell("flag", F.col("l_returnflag"))))
    source = F.element_at(F.array(*map(F.lit, P.PRECEDENCE)), (F.col("l_linenumber") % 6 + 1).cast("int"))
    rows = item.select(F.col("l_partkey").alias("product_id"), F.trunc("l_shipdate", "month").alias("run"), source.alias("provenance"), cells.alias("c"))
    return rows.select("product_id", "run", "provenance", "c.field", "c.value")


@register(
    "field_history",
    f"""with {CELLS},
    r as (select a.product_id, a.field, a.run, min(b.strength) as strength from s a join s b on a.product_id = b.product_id and a.field = b.field and b.run <= a.run group by all),
    v as (select r.product_id, r.field, r.run, r.strength, arg_max(s.value, s.run) as value from r join s on s.product_id = r.product_id and s.field = r.field and s.strength = r.strength and s.run <= r.run group by all),
    c as (select *, lag(value) over w is not distinct from value and lag(strength) over w is not distinct from strength as same from v window w as (partition by product_id, field order by run))
    select product_id, field, value, {SOURCES}[strength] as provenance, run::varchar as valid_from, (lead(run) over (partition by product_id, field order by run))::varchar as valid_to from c where not same""",
)
def field_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.history(_observations(spark, sf_dir)).withColumn("valid_from", F.col("valid_from").cast("string")).withColumn("valid_to", F.col("valid_to").cast("string"))


LIVE = """live as (select a.product_id, a.field, a.strength, arg_max(a.value, a.run) as value from s a join (select product_id, field, min(strength) as strength from s where run < date '2000-01-01' group by all) m
    on m.product_id = a.product_id and m.field = a.field and m.strength = a.strength where a.run < date '2000-01-01' group by all),
  staged as (select * from s where run = date '2000-01-01')"""


@register(
    "field_diff",
    f"""with {CELLS}, {LIVE},
    x as (select n.product_id, n.field, l.value as old_value, n.value as new_value, l.strength as ls, n.strength as ns, exists (select 1 from live k where k.product_id = n.product_id) as known
      from staged n left join live l on l.product_id = n.product_id and l.field = n.field where l.value is distinct from n.value)
    select product_id, case when not known then 'new' when ns > ls and ls = 1 then 'conflict_with_verified' else 'field_changed' end as change, field, old_value, new_value, not coalesce(ns > ls, false) as applied from x
    union all select distinct product_id, 'disappeared', null::varchar, null::varchar, null::varchar, false from live where product_id not in (select product_id from staged)""",
)
def field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the run of January 2000 would change in the state before it."""
    rows = _observations(spark, sf_dir)
    live = P.state_at(P.history(rows.where("run < date '2000-01-01'")), F.lit("1999-12-31").cast("date"))
    return P.field_diff(live, rows.where("run = date '2000-01-01'"))


@register(
    "field_as_of",
    f"""with {CELLS}, q as (select l_orderkey, l_linenumber, l_partkey, o_orderdate::date as day, row_number() over () as n from lineitem join orders on l_orderkey = o_orderkey),
    m as (select n, min(strength) as strength from q join s on s.product_id = l_partkey and field = 'tax' and run <= day group by n),
    v as (select q.n, arg_max(s.value, s.run) as value, any_value(m.strength) as strength from q join m using (n) join s on s.product_id = l_partkey and field = 'tax' and s.strength = m.strength and run <= day group by q.n)
    select l_orderkey, l_linenumber, l_partkey as product_id, day::varchar as day, value, {SOURCES}[strength] as provenance from q left join v using (n)""",
)
def field_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tax of every line's product as it was known on the day of its order."""
    item, orders = A.table(spark, sf_dir, "lineitem"), A.table(spark, sf_dir, "orders")
    rows = item.join(orders, item.l_orderkey == orders.o_orderkey).select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("product_id"), F.to_date("o_orderdate").alias("day"))
    return P.as_of(rows, P.history(_observations(spark, sf_dir)), "tax", "day").withColumn("day", F.col("day").cast("string"))


DIMS = 64


@register(
    "class_scope_vectors",
    """with g as (select vec_id, label, list_transform(embedding, lambda x: round(x::double * 1048576)::bigint) as g from embeddings),
    e as (select vec_id, label, unnest(g) as x, unnest(range(len(g))) as i from g),
    c as (select label as class_id, i, floor(sum(x)::double / count(*))::bigint as c from e where label is not null group by label, i),
    n as (select class_id, sqrt(sum(c::double * c)) as cn from c group by class_id), vn as (select vec_id, sqrt(sum(x::double * x)) as xn from e group by vec_id),
    d as (select vec_id, class_id, sum(x::double * c) as dot from e join c using (i) group by all),
    s as (select vec_id, class_id, dot / (xn * cn) as score from d join n using (class_id) join vn using (vec_id)),
    r as (select *, row_number() over w as rank, score - lead(score) over w as margin from s window w as (partition by vec_id order by score desc, class_id))
    select vec_id, rank::int as rank, class_id, score, margin from r where rank <= 3""",
)
def class_scope_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest classes of every vector, by the centroids of the labels, with margins."""
    rows = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("class_id"), F.col("embedding").alias("v"))
    near = S.nearest_classes(rows.select("id", "v"), S.centroids(rows.select("class_id", "v"), DIMS), DIMS)
    return near.select(F.col("id").alias("vec_id"), "rank", "class_id", "score", "margin")


SAID = "' ' || array_to_string({0}, ' ') || ' '".format(WORDS)


@register(
    "alias_classes",
    f"""with {A.LINES}, a as (select {SAID.format("alias")} as alias, min(target) as target, count(distinct target) as n_targets
      from (select p_name as alias, p_type as target from part union all select p_brand || '-' || p_partkey, p_type from part union all select p_brand, 'BRAND' from part) group by all),
    t as (select distinct description, {SAID.format("description")} as text from lines_v),
    h as (select description, a.*, strpos(text, alias) - 1 as start from t join a on contains(text, alias)),
    b as (select *, row_number() over (partition by description order by length(alias) desc, start, alias) as k from h)
    select line_id, trim(alias) as alias, start::bigint as start, target, n_targets from lines_v join b using (description) where k = 1""",
)
def alias_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class that a name, part number or brand in a line's description stands for."""
    p = A.products(spark, sf_dir)
    aliases = p.select(F.col("name").alias("alias"), F.col("class_id").alias("target")).unionByName(p.select(F.col("mpn").alias("alias"), F.col("class_id").alias("target")))
    aliases = aliases.unionByName(p.select(F.element_at("attributes", "brand").alias("alias"), F.lit("BRAND").alias("target")))
    lines = A.lines(spark, sf_dir)
    found = S.alias_lookup(lines.select("description").distinct().select(F.col("description").alias("id"), F.col("description").alias("text")), aliases)
    return lines.join(found.withColumnRenamed("id", "description"), "description").select("line_id", "alias", "start", "target", "n_targets")
