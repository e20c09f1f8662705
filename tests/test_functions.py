import ipaddress

import pytest
from pyspark.sql import functions as F

from specmill.functions import attrs, identity, numbers, text, url


@pytest.fixture(scope="module")
def value(spark):
    return lambda c: spark.range(1).select(c).first()[0]


def s(v):
    return F.lit(v).cast("string")


@pytest.mark.parametrize(
    ("given", "expected"),
    [("1.15", 1.15), (" 40 ", 40.0), ("13 3/8", 13.375), ("12 3⁄8", 12.375), ("5/8", 0.625), ("1-7/8", 1.875), ("115/230", None), ("56H", None), ("56D", 56.0), ("14.0/6.9-7.0", None), ("1/0", None), ("", None), (None, None), ("true", None), ("inf", None), ("NaN", None)],
)
def test_spec_number(value, given, expected):
    assert value(numbers.spec_number(s(given))) == expected


@pytest.mark.parametrize(
    ("spec", "given", "expected"), [("insulation_class", "F", 155.0), ("insulation_class", "Class H", 180.0), ("Insulation_Class", "155 °C", 155.0), ("insulation_class", "150", None), ("efficiency_group", "ie3", 3.0), ("brand", "F", None), ("insulation_class", None, None)]
)
def test_scale_rank(value, spec, given, expected):
    assert value(numbers.scale_rank(s(spec), s(given))) == expected


@pytest.mark.parametrize(
    ("name", "kind", "op", "required", "offered", "expected"),
    [
        ("v", "numeric", "gte", "1000", "600", "DEVIATION"),
        ("v", "numeric", "eq", "220", "220.0", "COMPLIANT"),
        ("v", "numeric", "lte", "14", "13 3/8", "COMPLIANT"),
        ("insulation_class", "text", "gte", "F", "Class H", "COMPLIANT"),
        ("insulation_class", "text", "gte", "F", "B", "DEVIATION"),
        ("t", "bool", "eq", "true", "TRUE", "COMPLIANT"),
        ("t", "bool", "eq", "true", " true", "DEVIATION"),
        ("t", "text", "eq", " Red", "red ", "COMPLIANT"),
        ("t", "numeric", "gte", "x", "5", "UNVERIFIABLE"),
        ("t", "numeric", "between", "5", "5", "UNVERIFIABLE"),
        ("t", "numeric", None, "5", "5", "UNVERIFIABLE"),
        ("t", "text", "eq", None, "5", "UNVERIFIABLE"),
    ],
)
def test_verdict(value, name, kind, op, required, offered, expected):
    assert value(numbers.verdict(s(name), s(kind), s(op), s(required), s(offered))) == expected


@pytest.mark.parametrize(
    ("a", "b", "expected"), [("CW", "CW/CCW", False), ("Ball", "Ball, permanently lubricated", False), ("Cast-iron", "Cast Iron", True), ("PSC", "Permanent Split Capacitor", True), ("90V", "90", True), ("230", "115", False), ("Baldor Electric", "Baldor", False), ("-", "Ball", False), (None, "x", False)]
)
def test_value_merge_veto(value, a, b, expected):
    assert value(attrs.may_merge(s(a), s(b))) is expected


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ({"capacitor_req": "Capacitor Included"}, {"capacitor_included": "true"}),
        ({"capacitor_required": "2MDV6"}, {"capacitor_item_no": "2MDV6", "capacitor_included": "false"}),
        ({"capacitor_req": "No"}, {"capacitor_required": "false"}),
        ({"voltage_selection": "115V"}, {"voltage_selection": "115V"}),
        ({"capacitor_included": "true", "requires_capacitor": "2MDV6"}, {"capacitor_included": "true", "capacitor_item_no": "2MDV6"}),
        ({"compatible_fan_item_no": "AB12"}, {"fan_item_no": "AB12"}),
    ],
)
def test_accessories(value, given, expected):
    once = attrs.split_accessories(numbers.literal_map(given))
    assert value(once) == expected
    assert value(attrs.split_accessories(once)) == expected


def test_identity(value):
    keys = {value(identity.crawl_identity(s("n"), s(m), s(None), s("u"))) for m in ("DMM-1000", "dmm-1000", "DMM 1000", "DMM.1000")}
    assert keys == {"mpn:DMM1000"}
    by_name = [value(identity.crawl_identity(s(n), s(m), s(None), s(u))) for n, m, u in ((" Meter", "", "u"), ("meter", None, "u"), ("meter", None, "v"))]
    assert by_name[0] == by_name[1] != by_name[2] and by_name[0].startswith("fallback:")


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("HTTP://Ex.com:80/a?utm_x=1&b=2&GCLID=3#f", "http://ex.com/a?b=2"), ("https://u@ex.com/", None), ("ftp://a.b/", None), ("http://a.b:70000/", None), ("", None), (None, None), ("https://EX.com.:8443/x", "https://ex.com:8443/x"),
    ],
)
def test_url(value, given, expected):
    assert value(url.canonical_absolute(s(given))) == expected


def test_url_of_reference():
    assert url.resolve_one("https://ex.com/a/b/c", "../d/./e?utm_source=1&q=2#x") == "https://ex.com/a/d/e?q=2"
    assert url.resolve_one("https://ex.com/a", "#x") is None
    assert url.resolve_one("https://ex.com/a", "mailto:x@y") is None
    assert url.resolve_one("https://[2001:db8:0::1]/", "x") == "https://[2001:db8::1]/x"


def test_public_addresses(spark):
    refused = [ipaddress.ip_network(n) for n in url.NOT_PUBLIC]
    edges = [str(a) for n in refused for a in (n[0], n[-1])] + [str(a) for n in refused for a in (n[0] - 1 if int(n[0]) else n[0], n[-1] + 1 if n[-1] != n[-1].__class__(2**n.max_prefixlen - 1) else n[-1])]
    given = edges + ["8.8.8.8", "[2606:4700::1111]", "2606:4700:0:0:0:0:0:1111", "::", "::1", "fe80::1", "2606:4700::5efe:1.2.3.4", "2606:4700::200:5efe:102:304", "64:ff9b::1", "::ffff:8.8.8.8", "::ffff:10.0.0.1"]
    wrong = ["", None, "a.example.com", "1.2.3", "1.2.3.256", "1.2.3.4.5", "1:2", "1::2::3", ":::", "12345::", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8", "g::1"]

    def public(a):
        try:
            ip = ipaddress.ip_address(a.strip("[]"))
        except (ValueError, AttributeError):
            return False
        ip = getattr(ip, "ipv4_mapped", None) or ip
        if any(ip.version == n.version and ip in n for n in refused):
            return False
        return ip.version == 4 or (ip.packed[0] >> 5 == 1 and ip.packed[8:12] not in (b"\0\0\x5e\xfe", b"\2\0\x5e\xfe"))

    got = spark.createDataFrame([(a,) for a in given + wrong], "a string").select("a", url.public_address(F.col("a")).alias("p")).collect()
    # version 6 that ends in version 4 notation is not read, and what a group of 8 leaves out must be something
    assert [(r.a, r.p) for r in got] == [(a, public(a) and a not in ("2606:4700::5efe:1.2.3.4", "1:2:3:4:5:6:7::8")) for a in given + wrong]
    assert spark.createDataFrame([], "a string").where(url.public_address(F.col("a"))).count() == 0


def test_registrable_domain(value):
    assert value(url.registrable_domain(s("a.b.example.com"))) == "example.com"
    assert value(url.registrable_domain(s("a.example.co.uk"))) == "example.co.uk"
    for host in ("co.uk", "localhost", "10.0.0.1", "[2001:db8::1]", None):
        assert value(url.registrable_domain(s(host))) is None


def test_chunks(value):
    pages = "\f".join("x" * 40 for _ in range(4))
    assert [len(c) for c in value(text.chunks(s(pages), 100))] == [81, 81]
    assert [len(c) for c in value(text.chunks(s("y" * 250), 100))] == [100, 100, 50]
    assert value(text.chunks(s(" \n\f "), 100)) == []
    assert value(text.candidate_groups(s("a b\n\nc\nProduct d"), 100)) == ["a b", "c", "Product d"]
    assert value(text.halves(s("aaa bbb ccc"))) == ["aaa bbb", "ccc"]


def test_text(value):
    assert value(text.strip_html(s("<p>a&nbsp;<b>b</b><script>x<y</script>"))) == "a b"
    assert value(text.error_text(s('{"error": {"message": "bad"}}'))) == "bad"
    assert value(text.json_array(s("nonsense"), "array<int>")) == []
    assert value(text.json_array(s("[1, 2]"), "array<int>")) == [1, 2]
    assert value(text.accepted_type(s("application/ld+json; charset=x"))) is True
    assert value(text.retry_after(s("120"), F.to_timestamp(F.lit("2024-01-01 00:00:00")))) == 120
    assert value(text.retry_after(s("Mon, 01 Jan 2024 00:01:00 GMT"), F.to_timestamp(F.lit("2024-01-01 00:00:00")))) == 60


def test_units(value):
    assert value(numbers.to_unit(F.lit(1.5), s("kV"), s("V"))) == 1500.0
    assert value(numbers.to_unit(F.lit(1.5), s("V"), s("V"))) == 1.5
    assert value(numbers.unit_of_key(s("max_pressure_psi"))) == "psi"
    assert value(numbers.unit_of_key(s("psi"))) is None
    assert value(numbers.match_op(s("text"), s("gte"), s("insulation_class"))) == "gte"
    assert value(numbers.match_op(s("text"), s("gte"), s("brand"))) == "eq"
    assert value(attrs.map_union(numbers.literal_map({"a": "1", "b": "2"}), numbers.literal_map({"b": "3"}))) == {"a": "1", "b": "3"}
