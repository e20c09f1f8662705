"""Queries on scalar functions, over values made from whole tables; their SQL says what must come out in another way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attrs, identity, numbers, text, url
from . import adapter as A
from .registry import register


def _pick(key: str, *values: str):
    """One of the values by key."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


@register(
    "spec_number_parse",
    """select p_partkey, case p_partkey % 8 when 0 then p_size + 0.375 when 1 then 0.625 when 2 then p_size + 0.875 when 3 then p_size when 4 then 56.0 when 5 then p_size * 1000.0 end as value from part""",
)
def spec_number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    s = F.element_at(F.array(F.concat(size, F.lit(" 3/8 ")), F.lit("5⁄8"), F.concat(size, F.lit("-7/8")), F.concat(F.lit("\t"), size), F.lit("56D"), F.concat(size, F.lit("e3")), F.lit("115/230"), F.lit("56H")), (F.col("p_partkey") % 8 + 1).cast("int"))
    return A.table(spark, sf_dir, "part").select("p_partkey", numbers.spec_number(s).alias("value"))


@register("scale_rank", "select p_partkey, case p_partkey % 6 when 0 then 155.0 when 1 then 180.0 when 2 then 155.0 when 4 then 3.0 end::double as rank from part")
def scale_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = _pick("p_partkey", "insulation_class", "Insulation_Class", "insulation_class", "insulation_class", "efficiency_group", "brand")
    return A.table(spark, sf_dir, "part").select("p_partkey", numbers.scale_rank(spec, _pick("p_partkey", " Class F", "h", "155 °C", "150", "IE3", "f")).alias("rank"))


@register("unit_normalize", "select p_partkey, case p_partkey % 4 when 0 then p_retailprice * 1000.0 + 0.0 when 1 then p_retailprice * 0.5556 + -17.778 else p_retailprice end as value from part")
def unit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = numbers.to_unit(F.col("p_retailprice"), _pick("p_partkey", "kV", "°F", "V", "parsec"), _pick("p_partkey", "V", "°C", "V", "m"))
    return A.table(spark, sf_dir, "part").select("p_partkey", out.alias("value"))


@register("key_unit_suffix", "select p_partkey, case p_partkey % 5 when 0 then 'rpm' when 1 then 'kW' when 2 then '°C' when 3 then 'µF' end as unit, case p_partkey % 5 when 0 then 'Max Speed Rpm' when 1 then 'Input kw' when 2 then 'Ambient C' when 3 then 'Cap Mfd' else 'Rpm' end as label from part")
def key_unit_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = _pick("p_partkey", "max_speed_rpm", "input_kw", "ambient_c", "cap_mfd", "rpm")
    label = _pick("p_partkey", "max_speed_rpm", "Input kw", "ambient_c", "cap_mfd", "rpm")
    return A.table(spark, sf_dir, "part").select("p_partkey", numbers.unit_of_key(key).alias("unit"), attrs.humanize(label).alias("label"))


@register(
    "accessory_split",
    """select p_partkey, case p_partkey % 5 when 0 then 'true' when 1 then 'false' when 4 then 'false' end as included, case p_partkey % 5 when 2 then 'true' when 3 then 'false' end as required,
    case when p_partkey % 5 = 4 then '2MDV' || p_partkey end as item_no, p_brand as brand from part""",
)
def accessory_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(F.lit("Capacitor Included"), F.lit("Not Included"), F.lit("Yes"), F.lit("None"), F.concat(F.lit("2MDV"), F.col("p_partkey").cast("string"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    bag = attrs.split_accessories(F.create_map(F.lit("requires_capacitor"), said, F.lit("brand"), F.col("p_brand")))
    at = lambda k: F.element_at("bag", k)
    return A.table(spark, sf_dir, "part").select("p_partkey", bag.alias("bag")).select("p_partkey", at("capacitor_included").alias("included"), at("capacitor_required").alias("required"), at("capacitor_item_no").alias("item_no"), at("brand").alias("brand"))


@register("canonicalize_attrs", "select p_partkey, case when p_partkey % 2 = 0 then '1' else 'three' end as phase, 2::bigint as n_keys, p_size::varchar as size from part")
def canonicalize_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bag = F.create_map(F.lit("phases"), F.when(F.col("p_partkey") % 2 == 0, " Single").otherwise("three"), F.lit("size"), F.col("p_size").cast("string"))
    out = attrs.canonicalize(bag, numbers.literal_map({"phases": "phase"}), F.create_map(F.lit("phase"), numbers.literal_map({"single": "1"})))
    return A.table(spark, sf_dir, "part").select("p_partkey", out.alias("b")).select("p_partkey", F.element_at("b", "phase").alias("phase"), F.size("b").cast("long").alias("n_keys"), F.element_at("b", "size").alias("size"))


@register("value_merge_veto", "select p_partkey, p_partkey % 6 in (0, 2, 5) as allowed from part")
def value_merge_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _pick("p_partkey", "Cast-iron", "CW", "90V", "230 V", "Baldor Electric", "PSC")
    b = _pick("p_partkey", "Cast Iron", "CW/CCW", "90", "115 V", "Baldor", "Permanent Split Capacitor")
    return A.table(spark, sf_dir, "part").select("p_partkey", attrs.may_merge(a, b).alias("allowed"))


@register(
    "identity_key",
    """select event_id, case when user_id % 3 <> 0 then 'mpn:DMM' || user_id else 'fallback:' || sha256('meter ' || (user_id % 50) || '||https://shop.example.com/p') end as identity_key from events""",
)
def identity_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.observations(spark, sf_dir)
    return o.select(F.col("id").alias("event_id"), identity.crawl_identity(F.col("product_name"), F.col("mpn"), F.lit(None).cast("string"), F.col("source_url")).alias("identity_key"))


@register(
    "offer_select",
    """select p_partkey, case when p_partkey % 3 = 0 then p_retailprice when p_partkey % 3 = 1 then 12.5 end as price, case p_partkey % 3 when 0 then 'EUR' when 1 then 'JOD' end as currency from part""",
)
def offer_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    offer = lambda p, c: F.struct(p.alias("price"), c.alias("currency"))
    first = offer(F.col("p_retailprice").cast("string"), _pick("p_partkey", "eur ", "XXX", "euro"))
    second = offer(_pick("p_partkey", "1", "12.50", "-3"), F.lit("jod"))
    o = F.col("o")
    rows = A.table(spark, sf_dir, "part").select("p_partkey", identity.first_offer(F.array(first, second)).alias("o"))
    return rows.select("p_partkey", identity.page_price(o["price"]).cast("double").alias("price"), identity.currency(o["currency"]).alias("currency"))


@register(
    "url_canonical",
    r"""with u as (select page_id, regexp_extract(url, '^(\w+)://([^/?#]*)([^?#]*)(\?[^#]*)?', ['scheme', 'host', 'path', 'query']) as u from pages),
    q as (select page_id, u, array_to_string(list_filter(string_split(substr(u.query, 2), '&'), lambda p: not starts_with(lower(p), 'utm_') and lower(split_part(p, '=', 1)) not in ('gclid', 'fbclid')), '&') as rest from u)
    select page_id, lower(u.scheme) || '://' || lower(u.host) || u.path || case when rest = '' then '' else '?' || rest end as url, lower(u.host) as host,
      case when rtrim(u.path, '/') = '' then '/' else rtrim(u.path, '/') end as partition from q""",
)
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = A.table(spark, sf_dir, "pages").select("page_id", url.canonical_absolute(F.col("url")).alias("url"))
    return pages.select("page_id", "url", url.url_host(F.col("url")).alias("host"), url.partition_key(F.col("url"), F.lit(False)).alias("partition"))


@register(
    "html_strip",
    r"""select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'),
    '(?s)<[^>]+>', ' ', 'g'), '&[a-zA-Z]+;', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g') as text from pages""",
)
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@register(
    "page_links",
    r"""with l as (select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) as origin, list_zip(regexp_extract_all(html, '<a href="([^"#]+)">([^<]*)</a>', 1), regexp_extract_all(html, '<a href="([^"#]+)">([^<]*)</a>', 2)) as z from pages)
    select page_id, len(z)::bigint as n_links, array_to_string(list_transform(z, lambda x: x[2] || ' -> ' || origin || x[1]), chr(10)) as links from l""",
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = A.table(spark, sf_dir, "pages").select("page_id", text.navigation(F.col("html"), F.col("url")).alias("l"))
    return links.select("page_id", F.size("l").cast("long").alias("n_links"), F.array_join("l", "\n").alias("links"))


@register(
    "page_classify",
    r"""with p as (select page_id, lower(regexp_extract(url, '^\w+://[^/?#]*([^?#]*)', 1)) as path from pages)
    select page_id, case when page_id % 5 = 0 then 'PRODUCT' when page_id % 5 = 1 then 'LISTING' when page_id % 5 = 2 then 'LISTING' when page_id % 5 = 3 then 'CATEGORY' else 'OTHER' end as page_type,
      case page_id % 5 when 0 then 100 when 1 then 95 when 2 then 85 when 3 then 65 else 10 end as priority from p""",
)
def page_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    kind = text.classify_page(url.url_path(F.col("url")), F.when(k == 0, 1).when(k == 1, 2).otherwise(0), F.lit(0), F.when(k == 2, 1).otherwise(0), F.when(k == 3, 2).otherwise(0), F.lit(0))
    return A.table(spark, sf_dir, "pages").select("page_id", kind.alias("c")).select("page_id", "c.page_type", "c.priority")


@register("config_ceiling", "select o_orderkey, least(100, case when o_custkey % 3 = 0 then 50 end, case when o_orderkey % 2 = 0 then 80 end) as batch, greatest(2000, case when o_custkey % 3 = 0 then 500 end, case when o_orderkey % 2 = 0 then 4000 end) as throttle from orders")
def config_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda v: F.when(F.col("o_custkey") % 3 == 0, v)
    asked = lambda v: F.when(F.col("o_orderkey") % 2 == 0, v)
    return A.table(spark, sf_dir, "orders").select("o_orderkey", text.ceiling(F.lit(100), own(50), asked(80)).alias("batch"), text.throttle(F.lit(2000), own(500), asked(4000)).alias("throttle"))


@register("retry_backoff", "select event_id, greatest(30.0, 30.0 * pow(2.0, least(event_id % 15, 10)))::double as seconds, least(2000.0, case when user_id % 4 = 0 then (user_id % 5) * 1000.0 else 100.0 * pow(2.0, least(event_id % 15, 20)) end)::double as robots_ms from events")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 15
    asked = F.when(F.col("user_id") % 4 == 0, F.col("user_id") % 5)
    return A.table(spark, sf_dir, "events").select("event_id", text.backoff_seconds(n + 1).alias("seconds"), text.robots_backoff_ms(n, asked).alias("robots_ms"))


@register(
    "document_formats",
    "select p_partkey, case p_partkey % 6 when 0 then 'PDF' when 1 then 'DOCX' when 2 then 'TYPE_MISMATCH' when 3 then 'HTML' when 4 then 'TYPE_MISMATCH' else 'UNKNOWN' end as kind from part",
)
def document_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = F.when(F.col("p_partkey") % 6 == 4, "application/pdf").when(F.col("p_partkey") % 6 == 3, "text/html; charset=utf-8")
    path = _pick("p_partkey", "a.pdf", "b.docx?x=1", "c.pdf", "d.html", "e.docx", "f.bin")
    head = F.unhex(_pick("p_partkey", "255044462D312E37", "504B030414000600", "504B030414000600", "3C68746D6C3E", "504B0304", "00"))
    return A.table(spark, sf_dir, "part").select("p_partkey", text.agreed_kind(media, path, head).alias("kind"))


@register(
    "chunk_documents",
    """with recursive d as (select doc_id, list_filter(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10)), lambda x: regexp_replace(x, '\\s', '', 'g') <> '') as lines,
      regexp_replace(text, '^\\s+|\\s+$', '', 'g') as whole from documents where text is not null),
    u as (select doc_id, unnest(case when length(whole) <= 12000 then [whole] else lines end) as unit, generate_subscripts(case when length(whole) <= 12000 then [whole] else lines end, 1) as k from d where whole <> ''),
    c as (select doc_id, flatten([list_transform(range(0, greatest(1, ((length(unit) - 1) // 12000 + 1))), lambda i: substr(unit, i * 12000 + 1, 12000))]) as parts, k from u),
    f as (select doc_id, flatten(list(parts order by k)) as parts from c group by doc_id),
    s as (
      select doc_id, parts, 2 as i, parts[1] as open, 0 as chunk_no from f
      union all
      select doc_id, parts, i + 1, case when length(open) + 1 + length(parts[i]) <= 12000 then open || chr(10) || parts[i] else parts[i] end, case when length(open) + 1 + length(parts[i]) <= 12000 then chunk_no else chunk_no + 1 end
      from s where i <= len(parts))
    select doc_id, chunk_no::int as chunk_no, max(length(open))::bigint as n, md5(arg_max(open, i)) as digest from s group by doc_id, chunk_no""",
)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ingest import chunk_documents as chunked

    rows = chunked(A.table(spark, sf_dir, "documents").where("text is not null"), keep=1 << 30)
    return rows.select("doc_id", "chunk_no", F.length("chunk").cast("long").alias("n"), F.md5(F.col("chunk").cast("binary")).alias("digest"))
