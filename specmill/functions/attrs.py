"""Attribute bags: maps of text to text, with the rules that make their keys and values canonical."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import spec_number, strip, to_unit

# Keys that identify a product and never state a requirement.
IDENTIFIER_KEYS = ["item_no", "mpn", "manualLink", "description", "sku"]
# Words of accessory columns.
INCLUDED, NOT_INCLUDED = ["included"], ["not included"]
REQUIRED, NOT_REQUIRED = ["yes", "true", "required"], ["no", "false", "none", "not required", "n/a"]
REQUIRED_KEY = r"^(?:requires_([a-z0-9_]+)|([a-z0-9_]+?)_(?:req|required|selection))$"
COMPATIBLE_KEY = r"^compatible_([a-z0-9_]+)_item_no$"
ITEM_NUMBER = r"^(?=.*[A-Za-z])(?=.*\d)[A-Za-z0-9-]{4,15}$"
NUMBER_UNIT = r"^\d+(?:\.\d+)?\s*[A-Za-z%°/]+$"
#: How an entry came about; where entries meet in one key, the least wins.
EXISTING, RENAMED, DERIVED = 0, 1, 2


def is_identifier(key: Column) -> Column:
    """FLT-11."""
    return key.isin(*IDENTIFIER_KEYS) | key.endswith("_item_no") | key.endswith("_mpn")


def is_item_number(v: Column) -> Column:
    """SCA-11: 4 to 15 letters, digits and hyphens, with a letter and a digit, neither a number with a unit nor a number."""
    return v.rlike(ITEM_NUMBER) & ~v.rlike(NUMBER_UNIT) & spec_number(v).isNull()


def humanize(key: Column) -> Column:
    """SCA-15: parts of a key with first letters raised; the rest stays as it is."""
    return F.array_join(F.transform(F.split(key, "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))), " ")


def non_empty(bag: Column) -> Column:
    """FLT-15."""
    return F.map_filter(bag, lambda _, v: v.isNotNull() & (v != ""))


def map_union(left: Column, right: Column) -> Column:
    """SET-6: the right side wins."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def _entries(key: Column, value: Column) -> Column:
    """The entries that one entry becomes: array of (key, value, how)."""
    entry = lambda k, v, how: F.struct(k.alias("key"), v.alias("value"), F.lit(how).alias("how"))
    accessory = F.coalesce(F.nullif(F.regexp_extract(key, REQUIRED_KEY, 1), F.lit("")), F.regexp_extract(key, REQUIRED_KEY, 2))
    text = strip(value)
    lower, prefix = F.lower(text), F.replace(accessory, F.lit("_"), F.lit(" "))
    word = strip(F.when(F.startswith(lower, prefix), F.substr(lower, F.length(prefix) + 1)).otherwise(lower))
    said = lambda suffix, v: F.array(entry(F.concat(accessory, F.lit(suffix)), F.lit(v), RENAMED))
    number = is_item_number(text) | F.exists(F.split(text, "[,;]"), lambda p: F.exists(F.split(strip(p), " "), is_item_number))
    bought = F.array(entry(F.concat(accessory, F.lit("_item_no")), text, RENAMED), entry(F.concat(accessory, F.lit("_included")), F.lit("false"), DERIVED))
    split = (
        F.when(word.isin(*INCLUDED), said("_included", "true"))
        .when(word.isin(*NOT_INCLUDED), said("_included", "false"))
        .when(word.isin(*REQUIRED), said("_required", "true"))
        .when(word.isin(*NOT_REQUIRED), said("_required", "false"))
        .when(number, bought)
        .otherwise(F.array(entry(key, value, EXISTING)))
    )
    return (
        F.when(key.rlike(COMPATIBLE_KEY), F.array(entry(F.concat(F.regexp_extract(key, COMPATIBLE_KEY, 1), F.lit("_item_no")), value, RENAMED)))
        .when(key.rlike(REQUIRED_KEY) & value.isNotNull(), split)
        .otherwise(F.array(entry(key, value, EXISTING)))
    )


def from_ranked(entries: Column) -> Column:
    """A map of (key, value, how) entries: of entries with one key that of least ``how`` stays, then the first by position."""
    numbered = F.transform(entries, lambda e, i: F.struct(e["how"].alias("how"), i.alias("at"), e["key"].alias("key"), e["value"].alias("value")))
    ordered = F.array_sort(numbered)
    first = F.filter(ordered, lambda e, i: ~F.exists(F.slice(ordered, 1, i), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(F.transform(first, lambda e: F.struct(e["key"], e["value"])))


def split_accessories(bag: Column) -> Column:
    """SCA-10: columns on accessories as ``x_included``, ``x_required`` and ``x_item_no``. Existing keys win; doing it twice changes nothing."""
    return from_ranked(F.flatten(F.transform(F.map_entries(bag), lambda e: _entries(e["key"], e["value"]))))


def canonicalize(bag: Column, key_alias: Column, value_alias: Column) -> Column:
    """SCA-9: accessories split, alias keys made canonical (an entry that has the canonical name wins), values replaced.

    ``key_alias`` maps alias to canonical key; ``value_alias`` maps key to a map of trimmed lower-case value to canonical value.
    """

    def one(e: Column) -> Column:
        name = F.coalesce(F.element_at(key_alias, e["key"]), e["key"])
        return F.struct(name.alias("key"), e["value"].alias("value"), F.when(name == e["key"], EXISTING).otherwise(RENAMED).alias("how"))

    named = from_ranked(F.transform(F.map_entries(split_accessories(bag)), one))
    return F.transform_values(named, lambda k, v: F.coalesce(F.element_at(F.element_at(value_alias, k), F.lower(strip(v))), v))


def letters_digits(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]", "")


def may_merge(variant: Column, canonical: Column) -> Column:
    """SCA-12: whether two values may count as one thing written in two ways. Containment means that one says more."""
    a, b = strip(variant), strip(canonical)
    na, nb = letters_digits(a), letters_digits(b)
    pattern = r"^(\d+(?:\.\d+)?)\s*[\p{L}%°/ ]*$"
    xa, xb = (F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1).try_cast("double")) for c in (a, b))
    numbers = xa.isNotNull() & xb.isNotNull()
    ok = F.when((na == "") | (nb == ""), False).when(na == nb, True).when(numbers, F.abs(xa - xb) < 1e-9).otherwise(~na.contains(nb) & ~nb.contains(na))
    return F.coalesce(ok, F.lit(False))


def inferred_datatype(values: Column, current: Column) -> Column:
    """AGG-11 over an array: bool if all are, numeric if nine tenths parse, enum if it was, else text."""
    n = F.size(values)
    booleans = F.forall(values, lambda v: F.lower(v).isin("true", "false"))
    numbers = F.size(F.filter(values, lambda v: spec_number(v).isNotNull()))
    return F.when(booleans, "bool").when(numbers >= n * 0.9, "numeric").when(current == "enum", "enum").otherwise("text")


def normalize_units(bag: Column, units: Column) -> Column:
    """SCA-6: numbers of keys that ``units`` knows in its unit. The unit they are in is the value of ``<key>_unit``, or the same;
    that companion goes when the value was read, and both stay as they are when it was not."""

    def number(key: Column) -> Column:
        return spec_number(F.element_at(bag, key))

    known = F.map_keys(F.map_filter(bag, lambda k, _: F.map_contains_key(units, k) & number(k).isNotNull()))
    kept = F.map_filter(bag, lambda k, _: ~F.array_contains(F.transform(known, lambda x: F.concat(x, F.lit("_unit"))), k))

    def one(key: Column, value: Column) -> Column:
        target = F.element_at(units, key)
        source = F.coalesce(F.element_at(bag, F.concat(key, F.lit("_unit"))), target)
        return F.when(F.array_contains(known, key), to_unit(spec_number(value), source, target).cast("string")).otherwise(value)

    return F.transform_values(kept, one)


def replace_values(bag: Column, spellings: Column) -> Column:
    """DML-10: values by a map from key to a map from variant to canonical spelling."""
    return F.transform_values(bag, lambda k, v: F.coalesce(F.element_at(F.element_at(spellings, k), v), v))
