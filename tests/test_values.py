"""Values as intervals, decimal conventions and units."""

import pytest
from pyspark.sql import functions as F

from specmill.functions import values as V


def all_of(spark, expression, rows):
    names = "abc"[: len(rows[0])]
    done = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names)).select("i", expression(*(F.col(n) for n in names)).alias("x"))
    return [r.x for r in sorted(done.collect())]


INTERVALS = [
        ("63–100 A adjustable", "point", 63, 100, "A", True),
        ("63 A to 100 A", "point", 63, 100, "A", False),
        ("100-63 mA", "point", 63, 100, "mA", False),
        ("٦٣–١٠٠ A Adjustable", "point", 63, 100, "A", True),
        ("۱۲٫۵ kV", "comma", 12.5, 12.5, "kV", False),
        ("١٬٢٣٤٫٥ V", "comma", 1234.5, 1234.5, "V", False),
        ("1.234,5 V", "comma", 1234.5, 1234.5, "V", False),
        ("1,234.5 V", "point", 1234.5, 1234.5, "V", False),
        ("1.234 V", "comma", 1234, 1234, "V", False),
        ("1.234 V", "point", 1.234, 1.234, "V", False),
        ("1.234.567", "point", 1234567, 1234567, None, False),
        ("≥ 20 kV", "point", 20, None, "kV", False),
        ("max. 5 mm", "point", None, 5, "mm", False),
        ("230 V ± 10 %", "point", 207, 253, "V", False),
        ("-5...+40 °C", "point", -5, 40, "°C", False),
        ("16", "point", 16, 16, None, False),
]


def test_intervals(spark):
    for got, (text, _, lo, hi, unit, adjustable) in zip(all_of(spark, V.interval, [r[:2] for r in INTERVALS]), INTERVALS, strict=True):
        assert (got.unit, got.adjustable) == (unit, adjustable), text
        assert got.lo == (lo if lo is None else pytest.approx(lo)) and got.hi == (hi if hi is None else pytest.approx(hi)), text


def test_what_is_no_interval(spark):
    assert all_of(spark, V.interval, [(t, "point") for t in ("", None, "many", "approx 5", "V 230")]) == [None] * 5


def test_units(spark):
    cases = [("kV", 1e3, 0, "V1"), ("mm", 1e-3, 0, "m1"), ("min", 60, 0, "s1"), ("W/m2", 1, 0, "W1·m-2"), ("kg·m/s^2", 1e3, 0, "g1·m1·s-2"), ("kW*h", 3.6e6, 0, "W1·s1"), ("m/m", 1, 0, ""), ("m·m", 1, 0, "m2"), ("mm2", 1e-6, 0, "m2"), ("°F", 5 / 9, -160 / 9, "°C1"), ("MΩ", 1e6, 0, "Ω1")]
    for got, (text, scale, addend, dims) in zip(all_of(spark, V.unit, [r[:1] for r in cases]), cases, strict=True):
        assert (got.scale, got.addend, got.dims) == (pytest.approx(scale), pytest.approx(addend), dims), text
    assert all_of(spark, V.unit, [("furlong",), ("V/furlong",), (None,), ("",)]) == [None] * 4


def test_canonical_intervals(spark):
    made = lambda t, c: V.canonical_interval(V.interval(t, c))
    shifted, scaled, bare, unknown = all_of(spark, made, [("-40…212 °F", "point"), ("0,5–1,2 kW", "comma"), ("7", "point"), ("5 furlong", "point")])
    assert (shifted.lo, shifted.hi, shifted.dims) == (pytest.approx(-40), pytest.approx(100), "°C1")
    assert (scaled.lo, scaled.hi, scaled.dims) == (500.0, 1200.0, "W1")
    assert bare.dims == "" and unknown is None


def test_votes(spark):
    cases = [("1.234,5", 1), ("1,234.5", -1), ("1.234", 0), ("1,234", 0), ("0.123", -1), ("0,123", 1), ("1.5", -1), ("1,25", 1), ("1.234.567", 1), ("1,234,567", -1), ("12", 0), ("1.2,3.4", 0)]
    assert all_of(spark, V.vote, [c[:1] for c in cases]) == [c[1] for c in cases]


def test_a_document_votes_as_a_whole(spark):
    rows = [("a", "1.234 pieces at 5,50"), ("a", "and 7,25"), ("b", "1.234 at 5.50"), ("c", "1,234 only"), ("d", None), ("e", "1,5 and 2.5")]
    got = {r.doc_id: (r.votes, r.convention) for r in V.conventions(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": (2, "comma"), "b": (-1, "point"), "c": (0, "point"), "d": (0, "point"), "e": (0, "point")}
