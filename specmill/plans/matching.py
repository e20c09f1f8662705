"""Queries on matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching as M
from . import adapter as A
from .registry import register


def matched(spark: SparkSession, sf_dir: str, spelled: bool = False, lines: DataFrame | None = None, scope: M.Scope | None = None, **more) -> DataFrame:
    scope = A.scope(spark, sf_dir) if scope is None else scope
    lines = A.lines(spark, sf_dir, scope) if lines is None else lines
    return M.match_lines(lines, scope, A.products(spark, sf_dir), A.definitions(spark, sf_dir), spelled, **more)


@register("match_lines", f"{A.ALL} select line_id, product_id, match_type, score::int as score, case when score = 100 then 'matched' when score >= 40 then 'partial' else 'not_found' end as status from match_v")
def match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir, most=0).select("line_id", "product_id", "match_type", "score", "status")


@register("exact_match_name_mpn", f"with {A.PRODUCTS}, {A.SCOPE}, {A.LINES}, {A.EXACT} select line_id, product_id from exact_v")
def exact_match_name_mpn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.exact_matches(A.lines(spark, sf_dir), A.scope(spark, sf_dir), A.products(spark, sf_dir))


@register("alternatives_top5", f"{A.ALL} select t.line_id, (place - 1)::int as pos, t.product_id, p.name, p.mpn, t.score::int as score, p.price, 'JOD' as currency, s.name as supplier_name from top_v t join products_v p using (product_id) join suppliers_v s using (supplier_id) where place > 1")
def alternatives_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.enriched_alternatives(matched(spark, sf_dir), A.products(spark, sf_dir), A.prices(spark, sf_dir), A.suppliers(spark, sf_dir))
    return found.select("line_id", "pos", "product_id", "name", "mpn", "score", "price", "currency", "supplier_name")


@register(
    "attribute_verdicts",
    f"""{A.ALL} select line_id, sum(ok_size)::bigint as n_size, sum(ok_brand)::bigint as n_brand, sum(ok_class)::bigint as n_class, count(*) as n_pairs, max(score)::int as best
    from pairs_v group by line_id""",
)
def attribute_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all candidate pairs, counted by line and attribute."""
    names = ["size", "brand", "insulation_class"]
    counts = M.verdict_counts(A.lines(spark, sf_dir), A.scope(spark, sf_dir), A.products(spark, sf_dir), A.definitions(spark, sf_dir), names)
    hits = [F.get("hits", F.lit(i)).alias(n) for i, n in enumerate(("n_size", "n_brand", "n_class"))]
    return counts.select("line_id", *hits, "n_pairs", "best")


@register(
    "line_search_top10",
    f"""with {A.PRODUCTS}, {A.SCOPE}, {A.LINES}, h as (
      select l.line_id, p.product_id, p.name, p.mpn, p.price, (100 * ((p.p_size >= l.qty)::int + (lower(p.p_brand) = lower(l.brand))::int)) // 3 as score
      from lines_v l join scope_v s using (tender_id) join products_v p on p.supplier_id = s.supplier_id where l.class_id is not null and lower(p.name) like '%red%'),
    r as (select *, row_number() over (partition by line_id order by score desc, product_id) as place from h)
    select line_id, place::int as place, product_id, name, mpn, score::int as score, price, 'JOD' as currency from r where place <= 10""",
)
def line_search_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = A.scope(spark, sf_dir)
    lines = A.lines(spark, sf_dir, scope).where("class_id is not null")
    return M.line_search(lines, "red", scope, A.products(spark, sf_dir), A.definitions(spark, sf_dir), A.prices(spark, sf_dir))
