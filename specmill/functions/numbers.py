"""Numbers in specification values, ordered code scales, units and the comparison of required with offered values."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank of each code on its scale.
SCALES: dict[str, dict[str, float]] = {
    "insulation_class": {"a": 105.0, "b": 130.0, "f": 155.0, "h": 180.0, "n": 200.0},
    "motor_efficiency_group": {"ie1": 1.0, "ie2": 2.0, "ie3": 3.0, "ie4": 4.0, "ie5": 5.0},
    "efficiency_group": {"ie1": 1.0, "ie2": 2.0, "ie3": 3.0, "ie4": 4.0, "ie5": 5.0},
}
# Dimension, from, to, factor, addend.
UNIT_CONVERSIONS: list[tuple[str, str, str, float, float]] = [
    ("voltage", "kV", "V", 1000.0, 0.0),
    ("voltage", "mV", "V", 0.001, 0.0),
    ("current", "mA", "A", 0.001, 0.0),
    ("current", "kA", "A", 1000.0, 0.0),
    ("power", "kW", "W", 1000.0, 0.0),
    ("power", "MW", "W", 1000000.0, 0.0),
    ("length", "mm", "m", 0.001, 0.0),
    ("length", "cm", "m", 0.01, 0.0),
    ("length", "km", "m", 1000.0, 0.0),
    ("frequency", "kHz", "Hz", 1000.0, 0.0),
    ("frequency", "MHz", "Hz", 1000000.0, 0.0),
    ("temperature", "°F", "°C", 0.5556, -17.778),
    ("resistance", "kΩ", "Ω", 1000.0, 0.0),
    ("resistance", "MΩ", "Ω", 1000000.0, 0.0),
]
# The last part of a key, and its unit.
UNIT_SUFFIXES: dict[str, str] = {
    "pct": "%", "rpm": "rpm", "hp": "hp", "kw": "kW", "w": "W", "kv": "kV", "v": "V", "ma": "mA", "a": "A", "khz": "kHz", "hz": "Hz", "c": "°C", "f": "°F", "mm": "mm",
    "cm": "cm", "m": "m", "in": "in", "ft": "ft", "kg": "kg", "lb": "lb", "oz": "oz", "mfd": "µF", "uf": "µF", "psi": "psi", "db": "dB", "cfm": "cfm", "gpm": "gpm",
}
TOLERANCE = 1e-9
COMPLIANT, DEVIATION, UNVERIFIABLE = "COMPLIANT", "DEVIATION", "UNVERIFIABLE"


def literal_map(values: dict) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(values.items())))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends; ``trim`` knows the space alone."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def plain_number(s: Column) -> Column:
    """A decimal number with optional exponent and Java float suffix, else null; no infinity, no NaN."""
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[fFdD]?$"), s.try_cast("double"))


def spec_number(c: Column) -> Column:
    """SCA-1: number of a specification value: plain, a proper fraction n/d with d from 1 to 64, or a whole and a fraction."""
    s = F.regexp_replace(strip(c.cast("string")), "⁄", "/")
    mixed = r"^(?:(\d+)(?:\s+|\s*-\s*))?(\d+)\s*/\s*(\d+)$"
    part = lambda k: F.regexp_extract(s, mixed, k).try_cast("double")
    n, d = part(2), part(3)
    fraction = F.when((d >= 1) & (d <= 64) & (n < d), F.coalesce(part(1), F.lit(0.0)) + n / d)
    return F.coalesce(plain_number(s), F.when(s.rlike(mixed), fraction))


def is_ordered(spec: Column) -> Column:
    return F.lower(spec).isin(*SCALES)


def scale_rank(spec: Column, value: Column) -> Column:
    """SCA-2: rank of a value on the spec's scale, by code ("Class F") or by the rank itself ("155 °C")."""
    name = F.lower(spec)
    cleaned = strip(F.regexp_replace(F.lower(strip(value.cast("string"))), "^class", ""))
    number = F.regexp_extract(cleaned, r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
    out = F.lit(None).cast("double")
    for scale, ranks in SCALES.items():
        own = F.array(*(F.lit(r) for r in sorted(set(ranks.values()))))
        found = F.coalesce(F.element_at(literal_map(ranks), cleaned), F.when(F.exists(own, lambda r: F.abs(r - number) < TOLERANCE), number))
        out = F.when(name == scale, found).otherwise(out)
    return out


def verdict(name: Column, datatype: Column, op: Column, required: Column, offered: Column) -> Column:
    """SCA-3: COMPLIANT, DEVIATION or UNVERIFIABLE. A missing definition, requirement or offer cannot be verified.

    ``eq`` on numbers has a tolerance; on booleans the texts are compared without regard to case, untrimmed; on other text
    trimmed. ``gte`` and ``lte`` take numbers or ranks of an ordered scale, and are inclusive. ``range_contains`` asks that the offered
    interval holds the required number, ``superset`` that the offered list (by commas) holds every required member.
    """
    from .values import POINT, interval, let  # which builds on this module

    r, o = spec_number(required), spec_number(offered)
    rank_r, rank_o = F.coalesce(r, scale_rank(name, required)), F.coalesce(o, scale_rank(name, offered))
    text = lambda c: F.lower(c.cast("string"))
    judged = lambda ok: F.when(ok, COMPLIANT).otherwise(DEVIATION)
    equal = (
        F.when(datatype == "numeric", F.when(r.isNull() | o.isNull(), UNVERIFIABLE).otherwise(judged(F.abs(r - o) < TOLERANCE)))
        .when(datatype == "bool", judged(text(required) == text(offered)))
        .otherwise(judged(strip(text(required)) == strip(text(offered))))
    )
    unknown = rank_r.isNull() | rank_o.isNull()
    within = let(interval(offered, F.lit(POINT)), lambda i: F.when(r.isNull() | i.isNull(), UNVERIFIABLE).otherwise(judged((F.coalesce(i["lo"], r) <= r) & (r <= F.coalesce(i["hi"], r)))))
    members = lambda c: F.filter(F.split(text(c), r"\s*,\s*"), lambda m: m != "")
    return (
        F.when(op.isNull() | required.isNull() | offered.isNull(), UNVERIFIABLE)
        .when(op == "eq", equal)
        .when(op == "gte", F.when(unknown, UNVERIFIABLE).otherwise(judged(rank_o >= rank_r)))
        .when(op == "lte", F.when(unknown, UNVERIFIABLE).otherwise(judged(rank_o <= rank_r)))
        .when(op == "range_contains", within)
        .when(op == "superset", judged(F.size(F.array_except(members(strip(required)), members(strip(offered)))) == 0))
        .otherwise(UNVERIFIABLE)
    )


def simple_compliance(datatype: Column, op: Column, required: Column, offered: Column) -> Column:
    """SCA-4: the simpler judgement of overrides and line search: plain numbers only, no ranks, text trimmed, missing is false."""
    r, o = plain_number(strip(required)), plain_number(strip(offered))
    same_text = strip(F.lower(required)) == strip(F.lower(offered))
    ok = F.when(op == "eq", F.when(datatype == "numeric", F.abs(r - o) < TOLERANCE).otherwise(same_text)).when(op == "gte", o >= r).when(op == "lte", o <= r)
    return F.coalesce(ok, F.lit(False))


def same_value(a: Column, b: Column) -> Column:
    """SCA-14: null-safe; numbers with tolerance, else trimmed text without regard to case."""
    x, y = spec_number(a), spec_number(b)
    both = F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) < TOLERANCE).otherwise(F.lower(strip(a)) == F.lower(strip(b)))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(both)


def to_unit(value: Column, source: Column, target: Column) -> Column:
    """SCA-5: value in the target unit; unchanged if the units are equal or no conversion is known."""
    key = F.concat_ws("\u0001", source, target)
    factor = F.element_at(literal_map({f"{a}\u0001{b}": f for _, a, b, f, _ in UNIT_CONVERSIONS}), key)
    addend = F.element_at(literal_map({f"{a}\u0001{b}": d for _, a, b, _, d in UNIT_CONVERSIONS}), key)
    return F.when(source == target, value).otherwise(F.coalesce(value * factor + addend, value))


def unit_of_key(key: Column) -> Column:
    """SCA-7: the unit that the last part of a key names; the key must have a part before it."""
    return F.when(key.contains("_"), F.element_at(literal_map(UNIT_SUFFIXES), F.substring_index(key, "_", -1)))


def match_op(datatype: Column, requested: Column, name: Column) -> Column:
    """SCA-8: ordered scales compare upwards unless lte is asked for; numbers as asked; everything else by equality."""
    return F.when(is_ordered(name), F.when(requested == "lte", "lte").otherwise("gte")).when((datatype == "numeric") & requested.isin("eq", "gte", "lte"), requested).otherwise("eq")


def match_status(score: Column) -> Column:
    """SCA-47."""
    return F.when(score == 100, "matched").when(score >= 40, "partial").otherwise("not_found")


def score_band(score: Column) -> Column:
    """SCA-48."""
    return F.when(score >= 80, "high").when(score >= 40, "medium").otherwise("low")
