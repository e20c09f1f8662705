"""How the terms of the sources of a language differ: exact integer divergences of smoothed shares, by joins, groups and windows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: A term is a run of letters A-Z, a-z and characters beyond ASCII; this is what stands between two of them.
TERM, BETWEEN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that hold a kept term, at least; whole shares; terms that are reported of a group.
LEAST_DOCS, SCALE, MOST_TERMS = 10, 1_000_000_000, 10
#: Characters of a text whose terms are taken together, and a piece of a longer one: it ends where a term does.
PIECE = 1 << 20
#: Parts of a language's vocabulary.
SALTS = 64
_PIECES = r"(?s).{1," + str(PIECE) + r"}[^\x00-\x40\x5B-\x60\x7B-\x7F]*+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """All matches of TERM. Found by splitting at what is between: a matcher that returns each match copies the whole text for it."""
    return F.array_remove(F.split(text, BETWEEN), "")


def text_pieces(text: Column) -> Column:
    """A text as an array of pieces that cut no term."""
    return F.when(F.length(text) <= PIECE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)))


def group_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, in_docs): occurrences of each term in each group, and the rows that hold it, in one aggregate.

    A text's terms go out twice, as they stand and once each. Of a long text they stand by pieces, and the distinct terms of its pieces are put together.
    """
    lower = F.translate("text", _UPPER, _LOWER)
    short = docs.where(F.length("text") <= PIECE).select("lang", "source", terms(lower).alias("t"))
    lists = F.array(F.struct(F.lit(0).alias("once"), F.col("t").alias("t")), F.struct(F.lit(1).alias("once"), F.array_distinct("t").alias("t")))
    short = short.select("lang", "source", F.explode(lists).alias("x")).select("lang", "source", "x.once", F.explode("x.t").alias("term"))
    long = docs.where(F.length("text") > PIECE).select("lang", "source", text_pieces(lower).alias("pieces"))
    stand = long.select("lang", "source", F.explode("pieces").alias("piece")).select("lang", "source", F.lit(0).alias("once"), F.explode(terms(F.col("piece"))).alias("term"))
    distinct = F.array_distinct(F.flatten(F.transform("pieces", lambda p: F.array_distinct(terms(p)))))
    each = short.unionByName(stand).unionByName(long.select("lang", "source", F.lit(1).alias("once"), F.explode(distinct).alias("term")))
    return each.groupBy("lang", "source", "term").agg(F.count_if(F.col("once") == 0).alias("count"), F.count_if(F.col("once") == 1).alias("in_docs"))


def share(count: Column, total: Column, kept: Column, scale: int = SCALE) -> Column:
    """1 + floor(scale * (count + 2) / (total + 2 * kept)), exact for counts of any size."""
    wide = lambda c: c.cast("decimal(27,0)")
    return F.lit(1) + F.call_function("div", wide(F.lit(scale)).cast("decimal(10,0)") * wide(count + 2), wide(total + 2 * kept))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are below 2 * SCALE, so that the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(spark: SparkSession, docs: DataFrame, least: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank over ``docs`` (text, lang, source).

    Part ``pair``: every other source of the language, by the divergence summed over all kept terms of the language. Part ``term``: the
    ``most_terms`` terms that the group uses more than its language does, by their divergence. Counts of a group are partial sums
    before anything is shuffled, so that a group or language may hold any share of the rows; what is joined by language alone is
    the list of its groups with its kept terms, and pairs of sources meet on language and term, each once.

    Null texts, languages and sources are read as ''. A group without terms takes part with zeros; a language without kept terms has pairs
    of value 0 and no terms. Values that tie are ranked by item in the order of UTF-8 bytes. Repeated rows count each; an empty table gives no rows.
    Very long texts are taken in pieces that cut no term. Other columns, doc_id among them, are ignored.
    """
    scratch = Scratch(spark, "divergence")
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain("lang").alias("lang"), plain("source").alias("source"), plain("text").alias("text"))
    groups = scratch.write(rows.select("lang", "source").distinct())
    counts = scratch.write(group_counts(rows))
    kept = counts.groupBy("lang", "term").agg(F.sum("in_docs").alias("docs"), F.sum("count").alias("lang_count")).where(F.col("docs") >= least)
    kept = scratch.write(kept.select("lang", "term", "lang_count", F.pmod(F.xxhash64("term"), F.lit(SALTS)).alias("salt")))
    counts = scratch.write(counts.select("lang", "source", "term", "count").join(kept.select("lang", "term"), ["lang", "term"], "left_semi"))

    # what is known of a language and a group goes to each of its parts of the vocabulary, so that no language is one key
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_count").alias("lang_n"))
    known = groups.join(counts.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left").join(of_lang, "lang")
    known = known.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), "v", "lang_n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    dense = known.join(kept, ["lang", "salt"]).join(counts, ["lang", "source", "term"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    p, q = share(F.col("count"), F.col("n"), F.col("v")), share(F.col("lang_count"), F.col("lang_n"), F.col("v"))
    dense = scratch.write(dense.select("lang", "source", "term", "count", p.alias("p"), q.alias("q")))

    one, other = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    once = one.join(other, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(divergence(F.col("p"), F.col("q"))).alias("value"))
    once = scratch.write(once)
    both = once.unionByName(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    marked = dense.where("count > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    return pairs.withColumn("rank", place).unionByName(marked.withColumn("rank", place).where(F.col("rank") <= most_terms))


ORACLE = r"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as t
  from documents),
g as (select distinct lang, source from d),
kept as (select lang, term from (select lang, unnest(list_distinct(t)) as term from d) group by lang, term having count(*) >= 10),
v as (select lang, count(*)::hugeint as v from kept group by lang),
c as (select lang, source, term, count(*)::hugeint as n from (select lang, source, unnest(t) as term from d) join kept using (lang, term) group by all),
dense as (select g.lang, g.source, kept.term, coalesce(c.n, 0)::hugeint as n from g join kept using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
p as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang, source)::hugeint + 2 * v) as p from dense join v using (lang)),
l as (select lang, term, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang)::hugeint + 2 * v) as q from (select lang, term, sum(n)::hugeint as n from dense group by all) join v using (lang)),
pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) as f from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) s
    on s.lang = a.lang and s.source = a.source and s.item = b.source),
term as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from p join l using (lang, term) where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from (from pair union all from term))
select lang, source, part, item, value, rank::int as rank from r where part = 'pair' or rank <= 10
"""
