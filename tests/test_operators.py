import io
import json
import time
import zipfile
import zlib

from pyspark.sql import functions as F

from specmill.operators import flows, ingest, matching, proposals
from specmill.sources import documents, models, pages, reports, sitemaps
from specmill.streaming import misses

RULES = [("c", "max_voltage", "numeric", "gte"), ("c", "has_trms", "bool", "eq"), ("c", "width", "numeric", "lte"), ("c", "insulation_class", "text", "gte")]


def _match(spark, lines, products):
    lines = spark.createDataFrame(lines, "line_id long, tender_id long, description string, class_id string, attributes map<string,string>")
    products = spark.createDataFrame(products, "product_id long, supplier_id long, class_id string, name string, mpn string, is_stale boolean, attributes map<string,string>")
    scope = spark.createDataFrame([(1, 1)], "tender_id long, supplier_id long")
    rules = spark.createDataFrame(RULES, "class_id string, name string, datatype string, match_op string")
    return {r.line_id: r for r in matching.match_lines(lines, scope, products, rules).collect()}


def test_matching(spark):
    product = lambda i, bag, name="p", mpn=None, supplier=1, stale=False: (i, supplier, "c", name, mpn, stale, bag)
    got = _match(
        spark,
        [
            (1, 1, "Fluke 179", "c", {"max_voltage": "1"}), (2, 1, "fl179", "c", {}), (3, 1, "x", None, {"a": "1"}), (4, 1, "x", "c", {"max_voltage": "1000", "has_trms": "true"}),
            (5, 1, "x", "c", {"width": "14"}), (6, 1, "x", "c", {"insulation_class": "F"}), (7, 1, "x", "c", {}), (8, 1, "x", "c", {"max_voltage": "9999", "has_trms": "true", "width": "1"}), (9, 1, "x", "c", {"max_voltage": None}),
        ],
        [product(1, {}, "FLUKE 179"), product(2, {}, "q", "FL179"), product(3, {"max_voltage": "600", "has_trms": "true"}), product(4, {"width": "13 3/8"}), product(5, {"insulation_class": "Class H"}), product(6, {"max_voltage": "9999"}, supplier=2), product(7, {"max_voltage": "9999"}, stale=True)],
    )
    assert (got[1].product_id, got[1].match_type, got[1].score, got[1].status) == (1, "exact", 100, "matched")
    assert got[2].product_id == 2
    assert (got[3].product_id, got[3].match_type, got[3].score, got[3].status) == (None, None, 0, "not_found")
    assert (got[4].product_id, got[4].score, got[4].status) == (3, 50, "partial")
    assert {v.attr: v.verdict for v in got[4].verdicts} == {"max_voltage": "DEVIATION", "has_trms": "COMPLIANT"}
    assert (got[5].product_id, got[5].status) == (4, "matched")
    assert (got[6].product_id, got[6].status) == (5, "matched")
    assert (got[7].product_id, got[7].match_type, got[7].score) == (None, "spec", 0)
    assert (got[8].product_id, got[8].score, got[8].status) == (3, 33, "not_found")  # a low score keeps its product
    assert got[9].score == 0 and len(got) == 9


def test_alternatives_are_five_at_most_and_ordered(spark):
    got = _match(spark, [(1, 1, "x", "c", {"max_voltage": "5"})], [(i, 1, "c", "p", None, False, {"max_voltage": "5"}) for i in range(9, 0, -1)])[1]
    assert got.product_id == 1 and [a.product_id for a in got.alternatives] == [2, 3, 4, 5, 6]


def test_proposals(spark):
    matches = spark.createDataFrame(
        [(1, 1, 5, 100, [(6, 80), (7, 60)]), (1, 2, None, 0, []), (1, 3, 8, 50, [])],
        "tender_id long, line_id long, product_id long, score int, alternatives array<struct<product_id:long,score:int>>",
    )
    prices = spark.createDataFrame([(5, 500.0), (6, 99.5)], "product_id long, price double")
    told = spark.createDataFrame([(1, 5, 10, "a"), (1, 6, 10, "b"), (1, 7, 90, "c"), (3, 8, 0, "d")], "line_id long, product_id long, probability int, reasoning string")
    lines = proposals.generate(matches, prices, told).cache()
    got = {(r.line_id, r.variant): (r.product_id, r.score, r.probability) for r in lines.collect()}
    assert got[1, "PERFECT"] == (5, 100, 10) and got[1, "BEST_ACCEPTANCE"] == (7, 60, 90) and got[1, "CHEAPEST"] == (6, 80, 10)
    assert got[2, "PERFECT"] == (None, 0, None) and got[2, "CHEAPEST"] == (None, None, None) and got[3, "CHEAPEST"] == (8, 50, 0)
    top = {r.variant: r for r in proposals.rollup(lines).collect()}
    assert top["PERFECT"].acceptance_rate == 5.0 and top["PERFECT"].match_score == 50.0 and not top["PERFECT"].is_complete and top["PERFECT"].gaps == 1


def test_half_up(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, None)], "g int, x int")
    assert {r.g: r.m for r in rows.groupBy("g").agg(proposals.half_up_mean("x").alias("m")).collect()} == {1: 1.67, 2: None}


def test_ingest_identity(spark):
    stored = spark.createDataFrame([(1, 1, "Motor", "M1", {"item_no": "1K079"}), (2, 1, "Motor", "M2", {}), (3, 1, "Fan", None, {})], "product_id long, supplier_id long, name string, mpn string, attributes map<string,string>")
    new = [("1k079", "ZZ", "New name"), ("44D126", "M1", "x"), ("44D127", "M2", "x"), (None, "M9", "Fan"), (None, None, "fan"), (None, "m2", "x"), ("9Z9", None, "Fan")]
    rows = spark.createDataFrame([(1, i, a, b, n) for i, (a, b, n) in enumerate(new)], "supplier_id long, pos int, item_no string, mpn string, name string").withColumn("item_no", F.upper("item_no"))
    got = {r.pos: r.product_id for r in ingest.resolve_identity(rows, stored).collect()}
    assert got == {0: 1, 1: None, 2: 2, 3: None, 4: 3, 5: 2, 6: None}


def test_spelling_chains(spark):
    rows = [("c", "enclosure", "Tot. Encl. Fan Cooled", "TEFC"), ("c", "enclosure", "TEFC", "Totally Enclosed Fan-Cooled"), ("c", "v", "115", "230"), ("c", "r", "CW", "CW/CCW"), ("c", "x", "aa", "bb"), ("c", "x", "bb", "aa")]
    got = {(r.spec, r.variant): r.canonical for r in ingest.allowed_spellings(spark.createDataFrame(rows, "class_id string, spec string, variant string, canonical string")).collect()}
    assert got == {("enclosure", "Tot. Encl. Fan Cooled"): "Totally Enclosed Fan-Cooled", ("enclosure", "TEFC"): "Totally Enclosed Fan-Cooled"}


def test_merge_translates_values(spark):
    bags = [(1, "c", {"phase": "1", "phases": "Single "}), (2, "c", {"phases": "three"}), (3, "c", {"phase": None, "ph": "3", "phases": "single"}), (4, "c", {"phase": "single"}), (5, "d", {"phase": "1", "phases": "three"})]
    products = spark.createDataFrame(bags, "product_id long, class_id string, attributes map<string,string>")
    names = spark.createDataFrame([(c, n, {"one": "1"} if n == "phase" else None) for c in "cd" for n in ("phase", "phases", "ph")], "class_id string, name string, value_aliases map<string,string>")
    said = {"Single": "1", "three": "3", "1": "1/3"}  # the last says more and may not merge
    groups = spark.createDataFrame([(c, "phase", ["phases", "ph"], said) for c in "cd"], "class_id string, canonical string, aliases array<string>, value_map map<string,string>")
    assert {(r.class_id, r.alias) for r in ingest.merge_conflicts(products, groups).where("conflict").collect()} == {("d", "phases")}
    moved, left, aliases = ingest.merge_duplicates(products, names, groups)
    assert {r.product_id: r.attributes for r in moved.collect()} == {1: {"phase": "1"}, 2: {"phase": "3"}, 3: {"phase": "1"}, 4: {"phase": "1"}, 5: {"phase": "1", "phases": "three"}}
    assert {(r.class_id, r.name): r.value_aliases for r in left.collect()} == {("c", "phase"): {"one": "1", "single": "1", "three": "3"}, ("d", "phase"): {"one": "1"}, ("d", "phases"): None, ("d", "ph"): None}
    assert {(r.class_id, r.canonical, r.alias) for r in aliases.collect()} == {("c", "phase", "phases"), ("c", "phase", "ph")}


def test_merge_in_passes_and_rounds(spark):
    bags = [(1, "c", {"a": "1", "b": "1"}), (2, "c", {"c": "2"}), (3, "c", {"d": "3"}), (4, "c", {"b": "4", "e": "4"})]
    products = spark.createDataFrame(bags, "product_id long, class_id string, attributes map<string,string>")
    names = spark.createDataFrame([("c", n, "text", "eq", None) for n in "abcde"], "class_id string, name string, datatype string, match_op string, canonical_unit string")
    schema = "class_id string, canonical string, aliases array<string>"
    chain = spark.createDataFrame([("c", "c", ["d"]), ("c", "a", ["b", "e"]), ("c", "b", ["c"])], schema)
    moved, left, aliases = ingest.merge_duplicates(products, names, chain)
    assert {r.product_id: r.attributes for r in moved.collect()} == {1: {"a": "1"}, 2: {"a": "2"}, 3: {"a": "3"}, 4: {"a": "4"}}
    assert [r.name for r in left.collect()] == ["a"] and {(r.canonical, r.alias) for r in aliases.collect()} == {("a", x) for x in "bcde"}
    asked = []

    def ask(products, definitions):
        """Sees one group a pass, and never stops to propose."""
        asked.append(1)
        return spark.createDataFrame([("c", "a", ["bcde"[len(asked) - 1]])], schema)

    none = spark.createDataFrame([], "class_id string, spec string, variant string, canonical string")
    moved, left, aliases = flows.sync_classes(products, names, ask, none)
    assert len(asked) == 3 and {(r.canonical, r.alias) for r in aliases.collect()} == {("a", "b"), ("a", "c"), ("a", "d")}
    assert {r.product_id: r.attributes for r in moved.collect()} == {1: {"a": "1"}, 2: {"a": "2"}, 3: {"a": "3"}, 4: {"a": "4", "e": "4"}}
    assert {r.name for r in left.collect()} == {"a", "e"}


PAGE = """<html><head><title> Meter 1 </title><link rel="canonical" href="/p/1?utm_source=x"><script type="application/ld+json">
{"@graph": [{"@type": ["Product"], "name": "Meter", "mpn": "DMM-1000", "offers": {"@id": "#o"}}, {"@id": "#o", "@type": "Offer", "priceSpecification": [{"price": 5, "priceCurrency": "USD"}, {"price": 6, "priceCurrency": "EUR"}]}]}
</script><script type="application/json">{"a": {"name": "n", "sku": "s"}}</script><script type="application/json">{bad</script></head>
<body><nav class="pagination"><a href="?page=2">2</a></nav><div data-product-id="DMM-1000"><a href="/m.pdf" type="application/pdf">Manual</a></div><a href="/x#y">X</a><a href="/x">X again</a><a href="mailto:a@b">m</a><p>مرحبا</p></body></html>"""


def test_pages(spark):
    p = pages.parse_pages(spark.createDataFrame([(1, "https://ex.com/q/", PAGE), (2, None, None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    one = p[0]
    assert one.title == "Meter 1" and one.canonical_url == "https://ex.com/p/1" and one.has_arabic and one.skipped_json == 1
    assert one.products[0].mpn == "DMM-1000" and [(o.price, o.currency) for o in one.products[0].offers] == [("5", "USD"), ("6", "EUR")]
    assert [(x.uri, x.label) for x in one.links] == [("https://ex.com/x", "X")] and one.pagination[0].uri == "https://ex.com/q/?page=2"
    assert one.documents[0].linked_identity == "DMM-1000" and len(one.embedded_json) == 1
    assert pages.product_like(json.loads(one.embedded_json[0]))[0]["sku"] == "s"
    assert p[1].visible_text == "" and not p[1].has_arabic


def _zip(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


def test_documents(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = _zip(word__document_xml=f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    x = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    xlsx = _zip(xl__workbook_xml=f'<workbook {x}><sheets><sheet name="S1"/></sheets></workbook>', xl__sharedStrings_xml=f"<sst {x}><si><t>hello</t></si></sst>", xl__worksheets__sheet1_xml=f'<worksheet {x}><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c/></row></sheetData></worksheet>')
    pdf = b"%PDF-1.7\n<</Length 1 /Filter /FlateDecode>>\nstream\n" + zlib.compress(b"BT (Hello \\(x\\)) Tj ET") + b"\nendstream"
    files = [("a.docx", None, docx), ("b.xlsx", None, xlsx), ("c.pdf", None, pdf), ("d.txt", None, "one\ftwo".encode()), ("e.html", None, b"<h1>H</h1><p>t</p><script>x</script>"), ("f.pdf", None, docx), ("g.txt", None, b"\x01"), ("h.rtf", None, b"{\\rtf1 A\\par B}")]
    got = documents.fragments(spark.createDataFrame(files, "path string, media_type string, content binary")).collect()
    by = lambda p: [(r.page, r.sheet, r.section, r.text) for r in got if r.path == p and r.error is None]
    assert by("a.docx") == [(None, None, "Title", "Body\na\tb")]
    assert by("b.xlsx") == [(None, "S1", None, "hello\t5")]
    assert by("c.pdf") == [(1, None, None, "Hello (x)")]
    assert by("d.txt") == [(1, None, None, "one"), (2, None, None, "two")]
    assert by("e.html") == [(None, None, "H", "t")]
    assert by("h.rtf") == [(None, None, None, "A\nB")]
    assert {r.path for r in got if r.error} == {"f.pdf", "g.txt"}


def test_sitemaps_and_robots(spark):
    xml = [(1, '<?xml version="1.0"?><x:urlset xmlns:x="u"><x:url><x:loc> https://ex.com/a?b=1&amp;c=2 </x:loc><x:priority>0.5</x:priority></x:url></x:urlset>'), (2, "<sitemapindex><sitemap><loc>https://ex.com/s.xml</loc></sitemap></sitemapindex>"), (3, "<!DOCTYPE x><urlset><url><loc>https://e.com</loc></url></urlset>"), (4, "<urlset><url><loc>https://e.com</loc></url><url><loc>bad</loc></url></urlset>")]
    got = {(r.file_id, r.kind, r.loc, r.priority) for r in sitemaps.sitemap_entries(spark.createDataFrame(xml, "file_id int, xml string")).collect()}
    assert got == {(1, "url", "https://ex.com/a?b=1&c=2", 0.5), (2, "index", "https://ex.com/s.xml", None)}
    rules = sitemaps.robots_rules(spark.createDataFrame([("h", "User-agent: *\nDisallow: /p\nAllow: /p/ok # yes\n\nUser-agent: bot\nUser-agent: other\nDisallow: /")], "host string, body string"))
    urls = spark.createDataFrame([("h", "/p/x"), ("h", "/p/ok/1"), ("h", "/z"), ("g", "/")], "host string, path string")
    assert {(r.host, r.path): r.allowed for r in sitemaps.may_fetch(urls, rules, "mine").collect()} == {("h", "/p/x"): False, ("h", "/p/ok/1"): True, ("h", "/z"): True, ("g", "/"): True}
    assert not any(r.allowed for r in sitemaps.may_fetch(urls.where("host = 'h'"), rules, "Bot").collect())


def test_models(spark):
    assert models.salvage('```json\n{"products": [{"name": "a"}, {"name": "b}"}, {"na') == [{"name": "a"}, {"name": "b}"}]
    asked = spark.createDataFrame([("t", "k1", "p"), ("t", "k1", "p"), ("t", "k2", "boom")], "task string, prompt_key string, prompt string")

    def client(task, prompt):
        if prompt == "boom":
            raise ValueError("no")
        return json.dumps({"products": [{"name": "a", "price": "1,200.5", "attributes": {"x": "1"}}, {"name": " "}]}), False

    answers = models.ask(asked, client).cache()
    assert {r.prompt_key: r.error for r in answers.collect()} == {"k1": None, "k2": "ValueError: no"}
    got = models.parsed_products(answers).collect()
    assert [(r.name, float(r.price), r.currency) for r in got] == [("a", 1200.5, "JOD")]

    def endless(task, prompt):
        n = prompt.count(",") + (1 if "given" in prompt else 0)
        return json.dumps({"products": [{"name": f"n{min(n, 2)}"}]}), True

    done = models.ask_until_done(asked.where("prompt = 'p'"), endless).first()
    assert [p["name"] for p in json.loads(done.response)["products"]] == ["n0", "n1", "n2"] and done.truncated


def test_miss_stream(spark, tmp_path):
    rows = [(1, "a", r, s) for r, s in ((1, True), (2, False), (3, False), (4, True))]
    frame = spark.createDataFrame(rows, "supplier_id long, identity_key string, run long, seen boolean")
    frame.write.parquet(str(tmp_path / "in"))
    stream = misses.miss_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("misses").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [(r.run, r.misses, r.stale) for r in spark.table("misses").orderBy("run").collect()] == [(1, 0, False), (2, 1, False), (3, 2, True), (4, 0, False)]


def test_matching_with_many_attributes_gives_the_same(spark, monkeypatch):
    lines = [(i, 1, "x", "c", {"max_voltage": str(i * 100), "has_trms": "true", "insulation_class": "F"}) for i in range(1, 6)]
    products = [(i, 1, "c", "p", None, False, {"max_voltage": str(i * 90), "has_trms": "true" if i % 2 else "false", "insulation_class": "abfhn"[i % 5]}) for i in range(1, 12)]
    told = lambda: {k: (r.product_id, r.score, [tuple(v) for v in r.verdicts], [(a.product_id, a.score) for a in r.alternatives]) for k, r in _match(spark, lines, products).items()}
    compiled = told()
    monkeypatch.setattr(matching, "attribute_names", lambda definitions: None)
    assert told() == compiled


def _report(spark, n, **more):
    row = {"tender_id": 1, "line_no": "1", "description": "a <b> & \x01(c)\\", "qty": 2.5, "product": "", "mpn": "m", "match_type": "", "score": 0, "status": "not_found", "currency": "JOD"} | more
    return spark.createDataFrame([{**row, "line_id": k} for k in range(n)])


def test_report_workbooks(spark):
    files = reports.xlsx_files(_report(spark, 5), most=2).orderBy("part").collect()
    assert [f.part for f in files] == [0, 1, 2]
    sheets = [documents.read_xlsx(bytes(f.content))[0] for f in files]
    assert {s[1] for s in sheets} == {"Report"} and [s[3].count("\n") for s in sheets] == [2, 2, 1]
    assert sheets[0][3].split("\n")[1] == "1\ta <b> & (c)\\\t2.5\t\tm\t\t0\tnot_found\t\tJOD"
    assert reports.xlsx_files(_report(spark, 1).limit(0)).count() == 0


def test_report_pdfs(spark):
    lines = proposals.text_report(_report(spark, 90))
    file = reports.pdf_files(lines).collect()[0]
    pages_of = documents.read_pdf(bytes(file.content))
    assert [len(p[3].split("\n")) for p in pages_of] == [38, 39, 14]
    assert pages_of[0][3].startswith("Matching report #1\na <b> &  (c)\\")
    assert "NOT FOUND" in pages_of[2][3]


def test_cells_that_a_workbook_leaves_out():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{reports._MAIN}" xmlns:r="{reports._OFFICE}"><sheets><sheet name="S" r:id="x"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{reports._PACKAGE}/relationships"><Relationship Id="x" Target="worksheets/other.xml"/></Relationships>')
        z.writestr("xl/worksheets/other.xml", f'<worksheet xmlns="{reports._MAIN}"><sheetData><row><c r="B1"><v>1</v></c><c r="AB1"><v>2</v></c></row></sheetData></worksheet>')
    assert documents.read_xlsx(out.getvalue()) == [(None, "S", None, "\t1" + "\t" * 26 + "2")]


def test_chosen_products_of_a_proposal(spark):
    lines = spark.createDataFrame([(1, 1, None, None, "raw", None), (2, 1, "7", "d", "raw", 3.0)], "line_id long, tender_id long, line_no string, description string, raw_text string, qty double")
    matches = spark.createDataFrame([(1, 5, "exact", 100, "matched"), (2, 5, "spec", 50, "partial")], "line_id long, product_id long, match_type string, score int, status string")
    products = spark.createDataFrame([(5, "five", "M5"), (6, "six", None)], "product_id long, name string, mpn string")
    chosen = spark.createDataFrame([(1, 6), (2, None)], "line_id long, product_id long")
    got = proposals.export_rows(lines, matches, products, chosen).orderBy("line_id").collect()
    assert [(r.line_no, r.description, r.qty, r["product"], r.mpn, r.score) for r in got] == [("1", "raw", 0.0, "six", "", 100), ("7", "d", 3.0, "", "", 50)]
    assert [r["product"] for r in proposals.export_rows(lines, matches, products).collect()] == ["five", "five"]


def test_uploads_stop_by_document(spark):
    chunks = spark.createDataFrame([(1, 0, "bad"), (1, 1, "bad"), (1, 2, "ok"), (1, 3, "bad"), (1, 4, "bad"), (1, 5, "bad"), (1, 6, "ok"), (2, 0, "ok")], "doc_id long, chunk_no int, chunk string")

    def client(task, chunk):
        if chunk == "bad":
            raise RuntimeError("no answer")
        return "{}", False

    for parallelism in (1, 3, 8):
        got = flows.ask_in_waves(chunks, client, parallelism).orderBy("doc_id", "chunk_no").collect()
        assert [r.status for r in got] == ["failed", "failed", "ok", "failed", "failed", "failed", "stopped", "ok"]
        assert got[6].error is None and got[6].response is None


def test_hits_have_a_flag_for_each_name_however_many_names_there_are(spark):
    many = [f"a{i:02}" for i in range(matching.MOST_COMPILED + 3)]
    lines = spark.createDataFrame([(1, 1, "x", "c", {"a00": "5", "a01": "red", "a33": "9"})], "line_id long, tender_id long, description string, class_id string, attributes map<string,string>")
    products = spark.createDataFrame([(7, 1, "c", "p", None, False, {"a00": "6", "a01": "blue", "a33": "9"})], "product_id long, supplier_id long, class_id string, name string, mpn string, is_stale boolean, attributes map<string,string>")
    scope = spark.createDataFrame([(1, 1)], "tender_id long, supplier_id long")
    for names in (many, ["a00", "a01", "a33"]):
        rules = spark.createDataFrame([("c", n, "text" if n == "a01" else "numeric", "gte" if n == "a00" else "eq") for n in names], "class_id string, name string, datatype string, match_op string")
        got = matching.candidate_pairs(lines, scope, products, rules, names=["a33", "a01", "a00"]).first()
        assert got.hits == [True, False, True] and got.score == 66


def test_walks_through_json_take_linear_time_and_keep_the_order():
    wide = [{"@type": "Product", "@id": f"#{i}", "name": f"n{i}", "sku": str(i), "inner": [{"name": "x", "model": f"m{i}"}]} for i in range(100_000)]
    began = time.time()
    found, named = pages.product_nodes([{"@graph": wide}])
    assert [n["@id"] for n in found] == [f"#{i}" for i in range(100_000)] and len(named) == 100_000
    assert [n.get("sku") or n["model"] for n in pages.product_like(wide)][:4] == ["0", "m0", "1", "m1"]
    assert time.time() - began < 20


def test_an_upload_tells_whether_it_was_cut(spark):
    docs = spark.createDataFrame([(1, "short text"), (2, "a line of words\n" * 200_000)], "doc_id long, text string")
    chunks = ingest.chunk_documents(docs).withColumn("prompt_key", F.sha2("chunk", 256))
    answers = chunks.where("chunk_no = 0").select("prompt_key", F.lit('{"products": [{"name": "Meter", "class_name": "c"}]}').alias("response"), F.lit(False).alias("truncated"), F.lit(None).cast("string").alias("error"))
    classes = spark.createDataFrame([("c", "c")], "class_id string, name string")
    maps = flows.class_maps(spark.createDataFrame([("c", "volts", None)], "class_id string, name string, canonical_unit string"))
    got = {r.capped for r in flows.upload(docs, answers.dropDuplicates(["prompt_key"]), classes, maps, 5).collect()}
    assert got == {True, False}


def test_documents_of_one_task_are_asked_apart(spark):
    """Waves and failures in a row are a document's own, also where many documents follow each other in one task."""
    chunks = spark.range(500).select("id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("n")).select(F.col("id").alias("doc_id"), F.col("n").cast("int").alias("chunk_no"), F.when((F.col("id") % 2 == 0) & (F.col("n") < 3), "bad").otherwise("ok").alias("chunk"))

    def client(task, chunk):
        if chunk == "bad":
            raise RuntimeError("no answer")
        return "{}", False

    plan = flows.ask_in_waves(chunks.coalesce(1), client, 2)
    assert "FlatMapGroupsIn" not in plan._jdf.queryExecution().optimizedPlan().toString()
    got = plan.groupBy(F.col("doc_id") % 2, "status").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, "failed", 750), (0, "stopped", 500), (1, "ok", 1250 + 0)]


def test_files_of_reports_stay_in_many_tasks(spark):
    """Files cost time rather than bytes: small ones are not put together in one task, and their kind is told once a file."""
    files = reports.pdf_files(spark.range(40).select("id", F.col("id").alias("tender_id"), F.col("id").alias("line_id"), F.lit("a").alias("value")))
    assert files.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = documents.fragments(files.select(F.concat("tender_id", F.lit(".pdf")).alias("path"), F.lit(None).cast("string").alias("media_type"), "content"))
    assert kinds._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 2
    assert {(r.kind, r.error) for r in kinds.collect()} == {("PDF", None)}
