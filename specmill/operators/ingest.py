"""Upload of catalogues: chunks and their cache, identity, upsert, price history, staleness, class inference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.attrs import from_ranked, is_identifier, map_union, may_merge
from ..functions.identity import DEFAULT_CURRENCY, blank_to_null, chunk_key
from ..functions.numbers import is_ordered, match_op, same_value, spec_number, strip, unit_of_key
from ..functions.text import MAX_CHUNK, chunks

LEAST_SHARE, SAMPLES, MOST_SPELLINGS, MOST_PASSES = 0.05, 8, 40, 3
MOST_CHUNKS, FATAL_STREAK = 150, 3


def chunk_documents(docs: DataFrame, most: int = MAX_CHUNK, keep: int = MOST_CHUNKS) -> DataFrame:
    """SCA-38, SRT-10: (doc_id, capped, chunk_no, chunk); at most ``keep`` chunks a document, which is ``capped`` if it has more: its products that were not seen are then not stale."""
    cut = docs.select("doc_id", chunks(F.col("text"), most).alias("chunks"))
    return cut.select("doc_id", (F.size("chunks") > keep).alias("capped"), F.posexplode(F.slice("chunks", 1, keep)).alias("chunk_no", "chunk"))


def cache_lookup(requests: DataFrame, cache: DataFrame, version: str, model: str) -> tuple[DataFrame, DataFrame]:
    """SRC-16, SRC-17: answered requests, and the distinct ones still to be asked."""
    keyed = requests.withColumn("cache_key", chunk_key(F.lit(version), F.lit(model), F.col("chunk")))
    return keyed.join(cache.select("cache_key", "response"), "cache_key"), keyed.join(cache.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])


def last_of_each(parsed: DataFrame) -> DataFrame:
    """WIN-6: of rows of one supplier and identity (item number, else part number, else name) the last by position, with the last part number that is not blank."""
    parsed = parsed.withColumn("item_no", F.upper(blank_to_null(F.col("item_no")))).withColumn("mpn", blank_to_null(F.col("mpn")))
    key = F.when(F.col("item_no").isNotNull(), F.concat(F.lit("i:"), "item_no")).when(F.col("mpn").isNotNull(), F.concat(F.lit("m:"), F.upper("mpn"))).otherwise(F.concat(F.lit("n:"), F.upper("name")))
    by = parsed.withColumn("identity", key)
    known = F.max_by("mpn", F.when(F.col("mpn").isNotNull(), F.col("pos"))).alias("last_mpn")
    last = by.groupBy("supplier_id", "identity").agg(F.max_by(F.struct(*[c for c in by.columns if c not in ("supplier_id", "identity")]), "pos").alias("r"), known)
    rest = [F.col(f"r.{c}").alias(c) for c in by.columns if c not in ("supplier_id", "identity", "mpn")]
    return last.select("supplier_id", "identity", *rest, F.coalesce("r.mpn", "last_mpn").alias("mpn"))


def resolve_identity(parsed: DataFrame, products: DataFrame) -> DataFrame:
    """JN-9: each parsed row with ``product_id`` of the stored one it is, or null.

    By item number; else by part number, but only with a row whose item number is missing or the same, and without
    a way back to names; by name only if it has neither. Of several the smallest id. The three joins are on supplier and key.
    """
    stored = products.withColumn("stored_item", F.upper(blank_to_null(F.element_at("attributes", "item_no"))))
    first = lambda c: stored.where(f"{c} is not null").groupBy("supplier_id", F.col(c).alias("key")).agg(F.min("product_id").alias("found"))
    item = first("stored_item").select("supplier_id", F.col("key").alias("item_no"), F.col("found").alias("by_item"))
    name = stored.groupBy("supplier_id", F.upper("name").alias("upper_name")).agg(F.min("product_id").alias("by_name"))
    numbers = stored.where("mpn is not null").groupBy("supplier_id", F.upper(F.trim("mpn")).alias("upper_mpn"), "stored_item").agg(F.min("product_id").alias("id"))
    # by number of parts: any row if the new one has no item number, else rows without one or with the same
    free = numbers.groupBy("supplier_id", "upper_mpn").agg(F.min("id").alias("by_any"), F.min(F.when(F.col("stored_item").isNull(), F.col("id"))).alias("by_free"))
    same = numbers.where("stored_item is not null").select("supplier_id", "upper_mpn", F.col("stored_item").alias("item_no"), F.col("id").alias("by_same"))
    rows = parsed.withColumn("upper_mpn", F.upper("mpn")).withColumn("upper_name", F.upper("name"))
    rows = rows.join(item, ["supplier_id", "item_no"], "left").join(free, ["supplier_id", "upper_mpn"], "left").join(same, ["supplier_id", "upper_mpn", "item_no"], "left").join(name, ["supplier_id", "upper_name"], "left")
    with_mpn = F.when(F.col("item_no").isNull(), F.col("by_any")).otherwise(F.least("by_free", "by_same"))
    found = F.coalesce("by_item", F.when(F.col("mpn").isNotNull(), with_mpn), F.when(F.col("mpn").isNull() & F.col("item_no").isNull(), F.col("by_name")))
    return rows.withColumn("product_id", found).drop("upper_mpn", "upper_name", "by_item", "by_any", "by_free", "by_same", "by_name")


def upsert(parsed: DataFrame, products: DataFrame) -> DataFrame:
    """DML-3: the catalogue after an upload, with ``outcome`` (updated, inserted, untouched).

    Updates replace name, class and the whole bag, clear staleness and keep the old part number if the new one is blank. New
    rows get an id from a hash of supplier and identity. Several rows that resolve to one product count once, the last by position.
    """
    fresh = resolve_identity(last_of_each(parsed), products)
    last = F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("pos")))
    known = fresh.where("product_id is not null").withColumn("n", last).where("n = 1").drop("n")
    old = products.select("product_id", F.col("mpn").alias("old_mpn"))
    updated = known.join(old, "product_id").select("product_id", "supplier_id", "class_id", "name", F.coalesce("mpn", "old_mpn").alias("mpn"), "attributes", F.lit(False).alias("is_stale"), F.lit("updated").alias("outcome"))
    new_id = F.xxhash64(F.col("supplier_id").cast("string"), "identity")
    inserted = fresh.where("product_id is null").select(new_id.alias("product_id"), "supplier_id", "class_id", "name", "mpn", "attributes", F.lit(False).alias("is_stale"), F.lit("inserted").alias("outcome"))
    rest = products.join(known.select("product_id"), "product_id", "left_anti").select("product_id", "supplier_id", "class_id", "name", "mpn", "attributes", "is_stale", F.lit("untouched").alias("outcome"))
    return updated.unionByName(inserted).unionByName(rest)


def price_upsert(prices: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DML-4: current prices, and the old ones that gave way to another, with where they came from. A row without a price changes nothing."""
    new = seen.where("price is not null").select("product_id", F.col("price").alias("new_price"), F.col("currency").alias("new_currency"), F.col("observed_at").alias("new_observed_at"))
    both = prices.join(new, "product_id", "full_outer")
    current = both.select("product_id", F.coalesce("new_price", "price").alias("price"), F.coalesce("new_currency", "currency", F.lit(DEFAULT_CURRENCY)).alias("currency"), F.coalesce("new_observed_at", "observed_at").alias("observed_at"))
    history = both.where("price is not null and new_price is not null and price <> new_price").select("product_id", "price", "currency", "observed_at")
    return current, history


def price_changes(observed: DataFrame) -> DataFrame:
    """WIN-4: replay of a price log: the old price at each change."""
    order = Window.partitionBy("product_id").orderBy("observed_at", "id")
    return observed.where("price is not null").withColumn("old", F.lag("price").over(order)).where("old is not null and old <> price").select("product_id", "id", F.col("old").alias("price"), F.col("price").alias("new_price"))


def mark_unseen(products: DataFrame, seen: DataFrame, complete: Column) -> DataFrame:
    """JN-10, DML-5: after a whole upload, products that it does not have are stale, but for those that a crawl found."""
    gone = products.join(seen.select("product_id").distinct().withColumn("was_seen", F.lit(True)), "product_id", "left")
    return gone.withColumn("is_stale", F.col("is_stale") | (complete & F.col("was_seen").isNull() & F.col("canonical_source_url").isNull())).drop("was_seen")


def failure_streaks(outcomes: DataFrame, limit: int = FATAL_STREAK) -> DataFrame:
    """WIN-7, AGG-19: chunks with the length of the run of failures that ends there; ``stopped`` from the one that reaches the limit on."""
    order = Window.partitionBy("ingest_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    island = outcomes.withColumn("island", F.sum(F.when(F.col("status") == "ok", 1).otherwise(0)).over(order))
    inside = Window.partitionBy("ingest_id", "island").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    streak = island.withColumn("streak", F.sum(F.when(F.col("status") == "ok", 0).otherwise(1)).over(inside))
    return streak.withColumn("stopped", F.max(F.col("streak") >= limit).over(order)).drop("island")


def attribute_usage(products: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """AGG-8: products with each key of a class, and its first distinct values by product."""
    each = products.select("class_id", "product_id", F.explode("attributes").alias("key", "value")).where("value is not null")
    values = each.groupBy("class_id", "key", "value").agg(F.count("*").alias("n"), F.min("product_id").alias("first"))
    place = F.row_number().over(Window.partitionBy("class_id", "key").orderBy("first", "value"))
    return values.withColumn("place", place).groupBy("class_id", "key").agg(F.sum("n").alias("used_by"), F.array_sort(F.collect_list(F.when(F.col("place") <= samples, F.struct("place", "value")))).alias("v")).select(
        "class_id", "key", "used_by", F.transform("v", lambda x: x["value"]).alias("values")
    )


def value_usage(products: DataFrame, most: int = MOST_SPELLINGS) -> DataFrame:
    """AGG-9: frequencies of the values of each key that has between two and ``most`` distinct ones."""
    counts = products.select("class_id", F.explode("attributes").alias("key", "value")).where("value is not null").groupBy("class_id", "key", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("distinct_values", F.count("*").over(Window.partitionBy("class_id", "key"))).where(F.col("distinct_values").between(2, most))


def missing_specs(products: DataFrame, definitions: DataFrame, share: float = LEAST_SHARE) -> DataFrame:
    """AGG-10, DML-8: keys on at least a share of a class's products (one at least) that have no definition and are no identifiers."""
    size = products.groupBy("class_id").agg(F.count("*").alias("n_products"))
    used = products.select("class_id", F.explode("attributes").alias("key", "value")).where("value is not null").groupBy("class_id", "key").agg(F.count("*").alias("n"))
    wide = used.join(size, "class_id").where(F.col("n") >= F.greatest(F.lit(1), F.ceil(F.col("n_products") * share))).where(~is_identifier(F.col("key")))
    return wide.join(definitions.select("class_id", F.col("name").alias("key")), ["class_id", "key"], "left_anti")


def inferred_types(products: DataFrame, definitions: DataFrame) -> DataFrame:
    """AGG-11, SCA-16: datatype, unit and comparison of each key of a class as its data say. Counts are partial sums, so that no values are gathered."""
    each = products.select("class_id", F.explode("attributes").alias("key", "value")).where("value is not null")
    seen = each.groupBy("class_id", "key").agg(F.count("*").alias("n"), F.count_if(F.lower("value").isin("true", "false")).alias("n_bool"), F.count_if(spec_number(F.col("value")).isNotNull()).alias("n_number"))
    seen = seen.join(definitions.select("class_id", F.col("name").alias("key"), F.col("datatype").alias("current"), F.col("match_op").alias("current_op")), ["class_id", "key"], "left")
    kind = F.when(F.col("n_bool") == F.col("n"), "bool").when(F.col("n_number") >= F.col("n") * 0.9, "numeric").when(F.col("current") == "enum", "enum").otherwise("text")
    return seen.withColumn("datatype", kind).select("class_id", "key", "datatype", F.when(F.col("datatype") == "numeric", unit_of_key(F.col("key"))).alias("unit"), match_op(F.col("datatype"), F.coalesce("current_op", F.lit("eq")), F.col("key")).alias("match_op"))


def _value_maps(groups: DataFrame) -> DataFrame:
    """Groups with ``value_map``: trimmed lower-case value to canonical value, of the pairs that may merge; empty where there is none."""
    if "value_map" not in groups.columns:
        return groups.withColumn("value_map", F.create_map().cast("map<string,string>"))
    entries = F.map_entries(F.map_filter("value_map", lambda k, v: may_merge(k, v)))
    # of values that differ only in case or space the last one counts
    m = from_ranked(F.transform(entries, lambda e, i: F.struct(F.lower(strip(e["key"])).alias("key"), e["value"].alias("value"), (-i).alias("how"))))
    return groups.withColumn("value_map", F.coalesce(m, F.create_map().cast("map<string,string>")))


def _translated(value: Column, value_map: Column) -> Column:
    return F.coalesce(F.element_at(value_map, F.lower(strip(value))), value)


def merge_conflicts(products: DataFrame, groups: DataFrame) -> DataFrame:
    """AGG-12: (class_id, canonical, alias, conflict): whether any product has both keys with other values, by the value map of the group."""
    pairs = _value_maps(groups).select("class_id", "canonical", "value_map", F.explode("aliases").alias("alias"))
    both = products.select("class_id", "attributes").join(pairs, "class_id")
    a, b = F.element_at("attributes", F.col("canonical")), F.element_at("attributes", F.col("alias"))
    differ = a.isNotNull() & b.isNotNull() & ~same_value(_translated(a, F.col("value_map")), _translated(b, F.col("value_map")))
    return both.groupBy("class_id", "canonical", "alias").agg(F.coalesce(F.bool_or(differ), F.lit(False)).alias("conflict"))


def _rounds(groups: DataFrame) -> DataFrame:
    """Groups with ``round``: groups of a class that share a key go one after another, all others at once."""
    each = groups.withColumn("n", F.row_number().over(Window.partitionBy("class_id").orderBy("canonical", F.array_join("aliases", "\u0001"), F.to_json("value_map"))))
    keys = each.select("class_id", "n", F.explode(F.array_distinct(F.concat(F.array("canonical"), "aliases"))).alias("key"))
    clash = keys.withColumn("uses", F.count("*").over(Window.partitionBy("class_id", "key"))).where("uses > 1").select("class_id", "n").distinct()
    turn = clash.withColumn("round", F.row_number().over(Window.partitionBy("class_id").orderBy("n")))
    return each.join(turn, ["class_id", "n"], "left").withColumn("round", F.coalesce("round", F.lit(1))).drop("n")


def _known_as(groups: DataFrame, aliases: DataFrame) -> DataFrame:
    """Groups without aliases that are merged already, and with the canonical key that their own has become; groups without an alias left go."""
    names = aliases.groupBy("class_id").agg(F.map_from_entries(F.collect_list(F.struct("alias", "canonical"))).alias("names"))
    out = groups.join(names, "class_id", "left").withColumn("names", F.coalesce("names", F.create_map().cast("map<string,string>")))
    out = out.withColumn("canonical", F.coalesce(F.element_at("names", F.col("canonical")), "canonical"))
    return out.withColumn("aliases", F.filter("aliases", lambda x: (x != F.col("canonical")) & ~F.map_contains_key("names", x))).where(F.size("aliases") > 0).drop("names")


def _merge_round(products: DataFrame, definitions: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merges groups that share no key."""
    checked = merge_conflicts(products, groups.select("class_id", "canonical", "aliases", "value_map"))
    good = groups.join(checked.where("conflict").select("class_id", "canonical").distinct(), ["class_id", "canonical"], "left_anti")
    # no more than the model has answered; as rows, so that the plan of a round does not hold those before it several times
    good = good.sparkSession.createDataFrame(good.collect(), good.schema)
    alias = good.select("class_id", "canonical", F.posexplode(F.array_distinct("aliases")).alias("place", "alias"))
    to = F.struct("canonical", (F.col("place") + 1).alias("how"))
    moves = alias.groupBy("class_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("alias"), to.alias("to")))).alias("moves"))
    moves = moves.join(good.groupBy("class_id").agg(F.map_from_entries(F.collect_list(F.struct("canonical", "value_map"))).alias("translations")), "class_id")

    def entry(e: Column) -> Column:
        to = F.element_at("moves", e["key"])
        # an own value wins, then that of the first alias; no value gives way to any
        return F.struct(F.coalesce(to["canonical"], e["key"]).alias("key"), e["value"].alias("value"), F.when(e["value"].isNull(), 1 << 30).otherwise(F.coalesce(to["how"], F.lit(0))).alias("how"))

    bag = F.transform_values(from_ranked(F.transform(F.map_entries("attributes"), entry)), lambda k, v: _translated(v, F.element_at("translations", k)))
    moved = products.join(moves, "class_id", "left").withColumn("attributes", F.when(F.col("moves").isNotNull(), bag).otherwise(F.col("attributes"))).drop("moves", "translations")
    left = definitions.join(alias.select("class_id", F.col("alias").alias("name")), ["class_id", "name"], "left_anti")
    said = good.where(F.size("value_map") > 0).select("class_id", F.col("canonical").alias("name"), F.col("value_map").alias("_said"))
    left = left.join(said, ["class_id", "name"], "left")
    known = F.coalesce("value_aliases", F.create_map().cast("map<string,string>"))
    left = left.withColumn("value_aliases", F.when(F.col("_said").isNull(), F.col("value_aliases")).otherwise(map_union(known, F.col("_said")))).drop("_said")
    return moved, left, alias.select("class_id", "canonical", "alias")


def merge_duplicates(products: DataFrame, definitions: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """DML-9, one pass: products with alias keys moved to the canonical one and its values translated by the value map of the group,
    definitions without those of aliases and with the translations in ``value_aliases``, and the aliases.
    A group of which any alias conflicts is left alone. A value map counts as far as its values may merge (QK-18)."""
    if "value_aliases" not in definitions.columns:
        definitions = definitions.withColumn("value_aliases", F.lit(None).cast("map<string,string>"))
    ready = _rounds(_value_maps(groups.withColumn("aliases", F.array_remove("aliases", F.col("canonical")))).where(F.size("aliases") > 0))
    last = ready.agg(F.max("round")).first()[0] or 0
    aliases = None
    for n in range(1, last + 1):
        now = ready.where(F.col("round") == n).drop("round")
        products, definitions, alias = _merge_round(products, definitions, now if aliases is None else _known_as(now, aliases))
        # keys that became an alias only now lead their own aliases on
        aliases = alias if aliases is None else _followed(aliases, alias)
    if aliases is None:
        aliases = groups.select("class_id", "canonical", F.explode("aliases").alias("alias")).limit(0)
    return products, definitions, aliases


def _followed(before: DataFrame, new: DataFrame) -> DataFrame:
    """All aliases, the older ones by the canonical key that theirs has become."""
    step = new.select("class_id", F.col("alias").alias("canonical"), F.col("canonical").alias("further"))
    return before.join(step, ["class_id", "canonical"], "left").select("class_id", F.coalesce("further", "canonical").alias("canonical"), "alias").unionByName(new)


def merge_until_stable(products: DataFrame, definitions: DataFrame, groups: DataFrame | Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """DML-9: passes of ``merge_duplicates`` until one merges nothing, at most ``MOST_PASSES``.

    ``groups`` are proposals, or a function that makes them anew from the products and definitions of each pass.
    """
    aliases = None
    for _ in range(MOST_PASSES):
        proposed = groups(products, definitions) if callable(groups) else groups
        if aliases is not None:
            proposed = _known_as(proposed, aliases)
        products, definitions, new = merge_duplicates(products, definitions, proposed)
        merged = not new.isEmpty()
        aliases = new if aliases is None else _followed(aliases, new) if merged else aliases
        if not merged:
            break
    return products, definitions, aliases


def allowed_spellings(proposed: DataFrame) -> DataFrame:
    """SCA-12, SCA-13: proposed (variant, canonical) pairs that may merge, chains followed to their end; chains that do not end are dropped.

    The pairs of a key are one map of a model's answer (MOST_SPELLINGS values at most go into its question), in which chains of any length are followed.
    """
    ok = proposed.where(may_merge(F.col("variant"), F.col("canonical")) & (F.lower("variant") != F.lower("canonical"))).groupBy("class_id", "spec", "variant").agg(F.min("canonical").alias("canonical"))
    chains = ok.groupBy("class_id", "spec").agg(F.map_from_entries(F.collect_list(F.struct("variant", "canonical"))).alias("next"))
    follow = F.aggregate(F.sequence(F.lit(1), F.size("next")), F.col("variant"), lambda at, _: F.coalesce(F.element_at("next", at), at))
    ends = chains.select("class_id", "spec", "next", F.explode(F.map_keys("next")).alias("variant")).withColumn("canonical", follow)
    return ends.where(~F.map_contains_key("next", F.col("canonical")) & may_merge(F.col("variant"), F.col("canonical"))).select("class_id", "spec", "variant", "canonical")


def repaired_definitions(definitions: DataFrame, inferred: DataFrame) -> DataFrame:
    """DML-8: definitions without identifiers, with datatype, unit and comparison as inferred."""
    seen = inferred.select("class_id", F.col("key").alias("name"), F.col("datatype").alias("new_type"), F.col("unit").alias("new_unit"))
    kept = definitions.where(~is_identifier(F.col("name"))).join(seen, ["class_id", "name"], "left")
    kind = F.coalesce("new_type", "datatype")
    return kept.select("class_id", "name", kind.alias("datatype"), F.when(kind == "numeric", F.coalesce("new_unit", "canonical_unit")).alias("canonical_unit"), match_op(kind, F.col("match_op"), F.col("name")).alias("match_op"), is_ordered(F.col("name")).alias("ordered"), *(c for c in ("value_aliases",) if c in definitions.columns))


