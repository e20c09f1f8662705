"""Queries on documents, reports as files, site maps, robots files, admission of addresses, and the driver of uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url
from ..operators import flows, ingest
from ..operators import proposals as P
from ..sources import documents, reports, sitemaps
from . import adapter as A
from .proposals import report_export_rows
from .registry import register


def _pick(key: str, *values: str | None):
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.col(key) % len(values) + 1).cast("int"))


@register(
    "document_fragments",
    """select doc_id, v.page, v.section, v.text || case when v.error is null then doc_id::varchar else '' end as text, v.error from documents, (values
      (0, 1, null, 'first ', null), (0, 2, null, 'second ', null), (1, null, null, 'intro', null), (1, null, 'Head', 'body ', null), (2, null, null, 'line' || chr(10) || 'é ', null), (3, null, null, null, 'ValueError: control characters')) v(k, page, section, text, error)
    where doc_id % 4 = v.k and not (v.k = 1 and v.section is null)
    union all select doc_id, null, null, 'intro', null from documents where doc_id % 4 = 1""",
)
def document_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1, SRC-2c, SRC-2e, SRC-2f, SRC-5: pages of texts, sections of markup, RTF, and a text with a control character."""
    k, number = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    path = F.concat(number, F.when(k == 1, ".html").when(k == 2, ".rtf").otherwise(".txt"))
    said = (
        F.when(k == 0, F.concat(F.lit("first "), number, F.lit("\fsecond "), number))
        .when(k == 1, F.concat(F.lit("<p>intro<script>x()</script><h2>Head</h2><p>body "), number))
        .when(k == 2, F.concat(F.lit(r"{\rtf1{\fonttbl{\f0 Arial;}}line\par \'e9 "), number, F.lit("}")))
        .otherwise(F.concat(F.lit("a\u0001"), number))
    )
    files = A.table(spark, sf_dir, "documents").select(path.alias("path"), F.lit(None).cast("string").alias("media_type"), F.encode(said, "utf-8").alias("content"))
    return documents.fragments(files).select(F.regexp_extract("path", r"^\d+", 0).cast("long").alias("doc_id"), "page", "section", "text", "error")


@register(
    "report_workbooks",
    f"""{A.ALL}, n as (select l.*, m.product_id, m.match_type, m.score, row_number() over (partition by l.tender_id order by l.line_id) as place from lines_v l join match_v m using (line_id))
    select tender_id, place::int as place, ln || chr(9) || description || chr(9) || qty::double || chr(9) || coalesce(p.name, '') || chr(9) || coalesce(p.mpn, '') || chr(9) || coalesce(match_type, '') || chr(9) || n.score::int || chr(9) ||
      case when n.score = 100 then 'matched' when n.score >= 40 then 'partial' else 'not_found' end || chr(9) || chr(9) || 'JOD' as value from n left join products_v p using (product_id)
    union all select distinct tender_id, 0, replace('Line,Description,Qty,Matched Product,MPN,Match Type,Score,Status,Price,Currency,Alternatives Count', ',', chr(9)) from lines_v""",
)
def report_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2, SRC-2d: reports written as XLSX files, which are read again."""
    return _lines_of(reports.xlsx_files(report_export_rows(spark, sf_dir)), "xlsx", F.lit(0))


@register(
    "report_pdfs",
    f"""{A.ALL}, n as (select l.*, m.product_id, m.score, row_number() over (partition by l.tender_id order by l.line_id) as place from lines_v l join match_v m using (line_id))
    select tender_id, place::int as place, rpad(substr(description, 1, 40), 40, ' ') || ' | ' || rpad(substr(coalesce(p.name, 'NOT FOUND'), 1, 30), 30, ' ') || ' | ' || n.score::int || '/100 | ' ||
      case when n.score = 100 then 'matched' when n.score >= 40 then 'partial' else 'not_found' end as value from n left join products_v p using (product_id)
    union all select distinct tender_id, 0, 'Matching report #' || tender_id from lines_v""",
)
def report_pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3, SRC-2a: reports written as PDF files, which are read again; no report here is longer than a page."""
    return _lines_of(reports.pdf_files(P.text_report(report_export_rows(spark, sf_dir))), "pdf", (F.coalesce("page", F.lit(1)) - 1) * 1000)


def _lines_of(files: DataFrame, ending: str, offset) -> DataFrame:
    named = files.select(F.concat(F.col("tender_id").cast("string"), F.lit(f".{ending}")).alias("path"), F.lit(None).cast("string").alias("media_type"), "content")
    read = documents.fragments(named).select(F.regexp_extract("path", r"^\d+", 0).cast("long").alias("tender_id"), offset.alias("offset"), F.posexplode(F.split("text", "\n")).alias("n", "value"))
    return read.select("tender_id", (F.col("offset") + F.col("n")).cast("int").alias("place"), "value")


@register(
    "sitemap_urls",
    """select doc_id as file_id, v.kind, v.loc || doc_id || v.tail as loc, v.lastmod, v.priority::double as priority from documents, (values
      (0, 'url', 'https://a.example.com/', '?x=1&y=2', '2024-05-01', 0.5), (0, 'url', 'https://a.example.com/b', '', null, null), (1, 'index', 'https://a.example.com/map', '.xml', null, null)) v(k, kind, loc, tail, lastmod, priority) where doc_id % 4 = v.k""",
)
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11: entries, an index, a file with a bad address, and one with a document type."""
    n = F.col("doc_id").cast("string")
    xml = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("<urlset xmlns='x'><url><loc> https://a.example.com/"), n, F.lit("?x=1&amp;y=2 </loc><lastmod>2024-05-01</lastmod><priority>0.5</priority></url><url><loc>https://a.example.com/b"), n, F.lit("</loc></url></urlset>")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("<s:sitemapindex><s:sitemap><s:loc>https://a.example.com/map"), n, F.lit(".xml</s:loc></s:sitemap></s:sitemapindex>")))
        .when(F.col("doc_id") % 4 == 2, F.lit("<urlset><url><loc>https://a.example.com/1</loc></url><url><loc>nowhere</loc></url></urlset>"))
        .otherwise(F.lit("<!DOCTYPE x><urlset><url><loc>https://a.example.com/1</loc></url></urlset>"))
    )
    return sitemaps.sitemap_entries(A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), xml.alias("xml"))).select("file_id", "kind", "loc", "lastmod", "priority")


@register(
    "robots_allowed",
    """select 'h' || s_suppkey as host, v.path, case s_suppkey % 3 when 0 then v.own when 1 then v.everyone else true end as allowed from supplier, (values ('/private/a', false, false), ('/private/open/b', true, false), ('/c', true, true), ('/shop', true, false)) v(path, own, everyone)""",
)
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10: rules of the agent, rules of all, and a host without a file."""
    host = F.concat(F.lit("h"), F.col("s_suppkey").cast("string"))
    rest = "User-agent: *\nDisallow: /private # all\nDisallow: /shop\n"
    suppliers = A.table(spark, sf_dir, "supplier")
    own = f"{rest}\r\nUser-Agent: other\nUser-agent: Mill\nDisallow: /private/\nAllow: /private/open\nDisallow:\n"
    files = suppliers.where("s_suppkey % 3 <> 2").select(host.alias("host"), F.when(F.col("s_suppkey") % 3 == 0, own).otherwise(rest).alias("body"))
    urls = suppliers.select(host.alias("host"), F.explode(F.array(*map(F.lit, ("/private/a", "/private/open/b", "/c", "/shop")))).alias("path"))
    return sitemaps.may_fetch(urls, sitemaps.robots_rules(files), "mill")


@register(
    "fetch_admission",
    """select event_id, case event_id % 12 when 1 then 'UNSUPPORTED_SCHEME' when 2 then 'INVALID_HOST' when 3 then 'INVALID_HOST' when 4 then 'HOST_NOT_ALLOWED' when 6 then 'HOST_NOT_ALLOWED' when 7 then 'DNS_RESOLUTION_FAILED' when 8 then 'NON_PUBLIC_ADDRESS' when 9 then 'NON_PUBLIC_ADDRESS' when 10 then 'NON_PUBLIC_ADDRESS' end as refusal from events""",
)
def fetch_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-9: hosts below the supplier's domain, hosts named, and everything that is refused."""
    own = "https://www.shop.example.com/"
    address = _pick("event_id", own, "ftp://shop.example.com/", "https://me@shop.example.com/", "https://shop.example.com:99999/", "https://example.com.evil.org/", "https://CDN.partner.org:8443/x", "https://a.cdn.partner.org/", *[own] * 4, "https://Example.com./")
    resolved = _pick("event_id", "93.184.216.34", *["8.8.8.8"] * 6, None, "8.8.8.8 10.1.2.3", "2001:db8::1", "fe80::1", "2606:4700::1111")
    events = A.table(spark, sf_dir, "events")
    refusal = url.fetch_refusal(address, F.lit("shop.example.com"), F.array(F.lit("cdn.partner.org")), F.split(resolved, " "))
    return events.select("event_id", refusal.alias("refusal"))


def _mill(task: str, chunk: str) -> tuple[str, bool]:
    """A client that fails on bad chunks, is refused on fatal ones, and is cut off on others."""
    if chunk.startswith("bad"):
        raise RuntimeError("no answer")
    if chunk.startswith("fatal"):
        raise RuntimeError("LLM API error 401: no credit")
    return '{"products":[]}', chunk.startswith("cut")


@register(
    "upload_waves",
    """select doc_id, v.status, v.n_ok::bigint as n_ok, v.n_incomplete::bigint as n_incomplete, v.n_failed::bigint as n_failed, v.n_stopped::bigint as n_stopped, v.marks_stale from documents, (values
      (0, 'DONE', 3, 0, 0, 0, true), (1, 'FAILED', 1, 0, 1, 2, false), (2, 'FAILED', 0, 0, 3, 1, false), (3, 'DONE', 1, 1, 1, 0, false), (4, 'FAILED', 0, 0, 2, 0, false), (5, 'FAILED', 0, 0, 0, 0, false), (6, 'DONE', 4, 0, 0, 0, false))
      v(k, status, n_ok, n_incomplete, n_failed, n_stopped, marks_stale) where doc_id % 7 = v.k""",
)
def upload_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-6, WIN-7, SRT-10: whole and partial runs, a fatal failure, failures in a row, no chunk that was read, no text, and more chunks than are kept."""
    text = _pick("doc_id", "ok 1\fok 2\fok 3", "ok 1\ffatal\fok 3\fok 4", "bad 1\fbad 2\fbad 3\fbad 4", "ok 1\fcut 2\fbad 3", "bad 1\fbad 2", " \f ", "ok 1\fok 2\fok 3\fok 4\fok 5")
    docs = A.table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    chunks = ingest.chunk_documents(docs, 6, 4)
    return flows.upload_status(docs, chunks, flows.ask_in_waves(chunks, _mill, parallelism=2))
