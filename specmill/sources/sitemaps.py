"""Site maps and robots files by expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import strip

MOST_BYTES = 2 << 20


def sitemap_entries(files: DataFrame) -> DataFrame:
    """SRC-11: (file_id, xml) as (file_id, kind, loc, lastmod, changefreq, priority); kind is ``index`` or ``url``.

    Files with a document type, files too large, and files with a bad address give nothing.
    """
    good = files.where((F.octet_length("xml") <= MOST_BYTES) & ~F.lower("xml").contains("<!doctype"))
    kind = F.when(good.xml.rlike(r"<(\w+:)?sitemapindex[\s>]"), "index").when(good.xml.rlike(r"<(\w+:)?urlset[\s>]"), "url")
    each = F.regexp_extract_all("xml", F.lit(r"(?s)<(?:\w+:)?(?:url|sitemap)(?:\s[^>]*)?>(.*?)</(?:\w+:)?(?:url|sitemap)>"), 1)
    tag = lambda c, name: F.nullif(strip(F.regexp_extract(c, rf"(?s)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{name}>", 1)), F.lit(""))
    unescaped = lambda c: F.replace(c, F.lit("&amp;"), F.lit("&"))
    rows = good.select("file_id", kind.alias("kind"), each.alias("each")).where("kind is not null")
    whole = rows.where(F.forall("each", lambda e: F.coalesce(tag(e, "loc").rlike(r"^https?://[^\s/]+"), F.lit(False))))
    e = whole.select("file_id", "kind", F.explode("each").alias("e"))
    return e.select("file_id", "kind", unescaped(tag(F.col("e"), "loc")).alias("loc"), tag(F.col("e"), "lastmod").alias("lastmod"), tag(F.col("e"), "changefreq").alias("changefreq"), tag(F.col("e"), "priority").try_cast("double").alias("priority"))


def robots_rules(files: DataFrame) -> DataFrame:
    """SRC-10: (host, body) as rules (host, agent, allow, path), one a row. Consecutive agent lines share the rules that follow."""
    lines = files.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("n", "line"))
    clean = lines.withColumn("line", strip(F.regexp_replace("line", r"#.*$", ""))).where("line <> ''")
    parts = clean.select("host", "n", F.lower(strip(F.substring_index("line", ":", 1))).alias("field"), strip(F.regexp_replace("line", r"^[^:]*:", "")).alias("value"))
    from pyspark.sql import Window

    order = Window.partitionBy("host").orderBy("n")
    is_agent = (F.col("field") == "user-agent").cast("int")
    starts = parts.withColumn("opens", ((is_agent == 1) & (F.coalesce(F.lag(is_agent).over(order), F.lit(0)) == 0)).cast("int"))
    group = starts.withColumn("grp", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    agents = group.where("field = 'user-agent'").select("host", "grp", F.lower("value").alias("agent"))
    rules = group.where("field in ('allow', 'disallow') and value <> ''").select("host", "grp", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"))
    return agents.join(rules, ["host", "grp"]).select("host", "agent", "allow", "path")


def may_fetch(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """(host, path) with ``allowed``: the longest rule that fits decides, allow before disallow; rules of the agent stand before those of all."""
    own = rules.where(F.col("agent").isin(agent.lower(), "*")).withColumn("own", F.col("agent") != "*")
    best = own.groupBy("host").agg(F.max("own").alias("has_own"))
    use = own.join(best, "host").where(F.col("own") == F.col("has_own")).select("host", "allow", F.col("path").alias("rule"))
    met = urls.join(use, "host", "left").where(F.col("rule").isNull() | F.col("path").startswith(F.col("rule")))
    decided = met.groupBy("host", "path").agg(F.max_by("allow", F.struct(F.length("rule"), "allow")).alias("allow"))
    return urls.join(decided, ["host", "path"], "left").select("host", "path", F.coalesce("allow", F.lit(True)).alias("allowed"))
