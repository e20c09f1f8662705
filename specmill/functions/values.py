"""Values of specifications as intervals: digits of several scripts, decimal conventions by vote, ranges and bounds, and an algebra of units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import literal_map, strip

# Arabic-Indic and extended Arabic-Indic digits, each in its order from 0 to 9
_OTHER_DIGITS = "".join(chr(0x0660 + i) for i in range(10)) + "".join(chr(0x06F0 + i) for i in range(10))
#: Decimal and thousands separators of Arabic, which no convention changes.
DECIMAL, THOUSANDS = "٫", "٬"
NUMBER = rf"[0-9]+(?:[.,{DECIMAL}{THOUSANDS}][0-9]+)*"
POINT, COMMA = "point", "comma"

_PREFIXES = {"": 1.0, "n": 1e-9, "µ": 1e-6, "μ": 1e-6, "u": 1e-6, "m": 1e-3, "c": 1e-2, "k": 1e3, "M": 1e6, "G": 1e9}
_SCALED = ("V", "A", "W", "m", "g", "s", "Hz", "Ω", "F", "Pa", "J", "N", "VA", "lm")
_OTHERS = {"h": (3600.0, "s"), "min": (60.0, "s"), "bar": (1e5, "Pa"), "in": (0.0254, "m"), "ft": (0.3048, "m"), "lb": (453.59237, "g"), "hp": (745.69987, "W"), "rpm": (1.0, "rpm"), "%": (1.0, "%"), "°C": (1.0, "°C"), "K": (1.0, "K")}
#: Symbol to (scale, base): every prefix with every base that takes one, and the others.
SYMBOLS = {p + b: (x, b) for b in _SCALED for p, x in _PREFIXES.items()} | _OTHERS
#: Symbols with a zero of their own: scale, addend, base.
SHIFTED = {"°F": (5 / 9, -160 / 9, "°C")}
UNIT = r"[\p{L}°%µΩ][\p{L}°%µΩ0-9^/·*-]*"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def latin_digits(text: Column) -> Column:
    return F.translate(text, _OTHER_DIGITS, "01234567890123456789")


def number_tokens(text: Column) -> Column:
    """Numbers in a text, with their separators."""
    return F.regexp_extract_all(latin_digits(F.coalesce(text, F.lit(""))), F.lit(NUMBER), F.lit(0))


def _count(token: Column, mark: str) -> Column:
    return F.length(token) - F.length(F.replace(token, F.lit(mark), F.lit("")))


def vote(token: Column) -> Column:
    """1 if a number shows that the decimal sign is a comma, -1 if a point, 0 if it may be either."""
    points, commas = _count(token, "."), _count(token, ",")
    after = F.length(F.regexp_extract(token, r"[.,]([0-9]*)$", 1))
    one = F.when((after != 3) | token.rlike(r"^0[.,]"), 1).otherwise(0)
    return (
        F.when((points > 0) & (commas > 0), F.when(token.rlike(r",[0-9]+$") & (commas == 1), 1).when(token.rlike(r"\.[0-9]+$") & (points == 1), -1).otherwise(0))
        .when(points > 1, 1)
        .when(commas > 1, -1)
        .when(commas == 1, one)
        .when(points == 1, -one)
        .otherwise(0)
    )


def conventions(rows: DataFrame) -> DataFrame:
    """(doc_id, votes, convention) over rows (doc_id, text): the sum of the votes of all numbers of a document; without a majority the point is the decimal sign."""
    votes = F.aggregate(number_tokens(F.col("text")), F.lit(0).cast("long"), lambda s, t: s + vote(t))
    summed = rows.select("doc_id", votes.alias("v")).groupBy("doc_id").agg(F.sum("v").alias("votes"))
    return summed.withColumn("convention", F.when(F.col("votes") > 0, COMMA).otherwise(POINT))


def number_value(token: Column, convention: Column) -> Column:
    """The number that a token (of Latin digits) stands for under a convention. A decimal sign that stands more than once, or before a thousands sign, groups thousands."""
    return let(token, lambda t: _number_value(t, convention))


def _number_value(token: Column, convention: Column) -> Column:

    def read(decimal: str, group: str) -> Column:
        plain = (_count(token, decimal) == 1) & ~token.rlike(rf"[{decimal}].*[{group}]")
        kept = F.replace(token, F.lit(group), F.lit(""))
        alone = F.replace(F.replace(token, F.lit(decimal), F.lit("")), F.lit(group), F.lit("."))
        swapped = token.rlike(rf"[{decimal}].*[{group}]") & (_count(token, group) == 1)
        return F.when(plain, F.replace(kept, F.lit(decimal), F.lit("."))).when(swapped, alone).otherwise(F.replace(kept, F.lit(decimal), F.lit("")))

    text = F.when(convention == COMMA, read(",", ".")).otherwise(read(".", ","))
    return F.replace(F.replace(text, F.lit(THOUSANDS), F.lit("")), F.lit(DECIMAL), F.lit(".")).try_cast("double")


def unit(text: Column) -> Column:
    """struct(scale, addend, dims) of a unit expression such as ``kV``, ``W/m2`` or ``kg·m/s^2``; null if a symbol is unknown.

    dims lists the bases in order with their exponents ("g1·m1·s-2"); exponents of one base add up, and one of 0 is left out.
    """
    return let(F.replace(strip(text), F.lit("*"), F.lit("·")), _unit)


def _unit(cleaned: Column) -> Column:
    factors = F.regexp_extract_all(cleaned, F.lit(r"[/·]?[^/·]+"), F.lit(0))
    scales, bases = literal_map({s: x for s, (x, _) in SYMBOLS.items()}), literal_map({s: b for s, (_, b) in SYMBOLS.items()})

    def factor(f: Column) -> Column:
        symbol = F.regexp_extract(f, r"^[/·]?([^0-9^-]+)", 1)
        power = F.coalesce(F.regexp_extract(f, r"\^?(-?[0-9]+)$", 1).try_cast("int"), F.lit(1)) * F.when(F.startswith(f, F.lit("/")), -1).otherwise(1)
        return F.struct(F.element_at(scales, symbol).alias("scale"), F.element_at(bases, symbol).alias("base"), power.alias("power"))

    shifted = F.lit(None).cast("struct<scale:double,addend:double,dims:string>")
    for symbol, (x, a, b) in SHIFTED.items():
        shifted = F.when(cleaned == symbol, F.struct(F.lit(x).alias("scale"), F.lit(a).alias("addend"), F.lit(f"{b}1").alias("dims"))).otherwise(shifted)
    return F.coalesce(shifted, let(F.transform(factors, factor), _product))


def _product(parts: Column) -> Column:
    scale = F.aggregate(parts, F.lit(1.0), lambda s, p: s * F.pow(p["scale"], p["power"]))
    names = F.array_sort(F.array_distinct(F.transform(parts, lambda p: p["base"])))
    power_of = lambda b: F.aggregate(F.filter(parts, lambda p: p["base"] == b), F.lit(0), lambda s, p: s + p["power"])
    dims = F.array_join(F.transform(F.filter(names, lambda b: power_of(b) != 0), lambda b: F.concat(b, power_of(b).cast("string"))), "·")
    known = (F.size(parts) > 0) & F.forall(parts, lambda p: p["base"].isNotNull())
    return F.when(known, F.struct(scale.alias("scale"), F.lit(0.0).alias("addend"), dims.alias("dims")))


_N, _U = rf"([+-]?{NUMBER})", rf"({UNIT})?"
_RANGE = rf"^{_N}\s*{_U}\s*(?:–|—|-|…|\.\.\.?|~|to\b|bis\b)\s*{_N}\s*{_U}(.*)$"
_SPREAD = rf"^{_N}\s*{_U}\s*(?:±|\+/-)\s*{_N}\s*{_U}(.*)$"
_LEAST = rf"^(?:≥|>=|>|min\.?|from|at least)\s*{_N}\s*{_U}(.*)$"
_MOST = rf"^(?:≤|<=|<|max\.?|up to|at most)\s*{_N}\s*{_U}(.*)$"
_PLAIN = rf"^{_N}\s*{_U}(.*)$"


def interval(text: Column, convention: Column) -> Column:
    """struct(lo, hi, unit, adjustable) of a value: "63–100 A adjustable", "≥ 20 kV", "max. 5 mm", "230 V ± 10 %", "16 A". An open end is null; null if nothing fits.

    Of a range without a unit at its first number the second's holds for both; a range whose ends are turned around is turned back.
    """
    return let(strip(latin_digits(text)), lambda s: _interval(s, convention))


def _interval(s: Column, convention: Column) -> Column:
    get = lambda pattern, k: F.regexp_extract(s, pattern, k)
    named = lambda pattern, k: F.nullif(get(pattern, k), F.lit(""))

    def number(pattern: str, k: int) -> Column:
        raw = get(pattern, k)
        return number_value(F.regexp_replace(raw, r"^[+-]", ""), convention) * F.when(F.startswith(raw, F.lit("-")), -1.0).otherwise(1.0)

    def made(lo: Column, hi: Column, name: Column, tail: Column) -> Column:
        return F.struct(lo.alias("lo"), hi.alias("hi"), name.alias("unit"), F.lower(tail).contains("adjustable").alias("adjustable"))

    open_end = F.lit(None).cast("double")
    a, b = number(_RANGE, 1), number(_RANGE, 3)
    middle, width = number(_SPREAD, 1), number(_SPREAD, 3)
    width = F.when(get(_SPREAD, 4) == "%", F.abs(middle) * width / 100).otherwise(width)
    return (
        F.when(s.rlike(_RANGE), made(F.least(a, b), F.greatest(a, b), F.coalesce(named(_RANGE, 4), named(_RANGE, 2)), get(_RANGE, 5)))
        .when(s.rlike(_SPREAD), made(middle - width, middle + width, named(_SPREAD, 2), get(_SPREAD, 5)))
        .when(s.rlike(_LEAST), made(number(_LEAST, 1), open_end, named(_LEAST, 2), get(_LEAST, 3)))
        .when(s.rlike(_MOST), made(open_end, number(_MOST, 1), named(_MOST, 2), get(_MOST, 3)))
        .when(s.rlike(_PLAIN), made(number(_PLAIN, 1), number(_PLAIN, 1), named(_PLAIN, 2), get(_PLAIN, 3)))
    )


def canonical_interval(value: Column) -> Column:
    """struct(lo, hi, dims, adjustable) of an ``interval`` in base units; a value without a unit has dims ''; null if its unit is unknown."""
    return let(value, lambda v: let(unit(v["unit"]), lambda u: _in_base(v, u)))


def _in_base(value: Column, u: Column) -> Column:
    put = lambda x: x * u["scale"] + u["addend"]
    bare = F.struct(value["lo"].alias("lo"), value["hi"].alias("hi"), F.lit("").alias("dims"), value["adjustable"].alias("adjustable"))
    known = F.struct(put(value["lo"]).alias("lo"), put(value["hi"]).alias("hi"), u["dims"].alias("dims"), value["adjustable"].alias("adjustable"))
    return F.when(value.isNotNull() & value["unit"].isNull(), bare).when(u.isNotNull(), known)
