"""Queries on answers of models, tenders, and rows of the administration; the answers are JSON made from whole tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attrs, identity, numbers, text, url
from ..operators import flows, matching, proposals, tenders
from ..sources import models
from . import adapter as A
from .matching import matched
from .registry import register


def _pick(key: str, *values: str | None) -> Column:
    """One of the values by key."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.col(key) % len(values) + 1).cast("int"))


def _answers(spark: SparkSession, sf_dir: str, *responses: str) -> DataFrame:
    """An answer for each part, of the responses by key; ``#`` in them is the key."""
    said = F.replace(_pick("p_partkey", *responses), F.lit("#"), F.col("p_partkey").cast("string"))
    part = A.table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").cast("string").alias("prompt_key"), "p_partkey", said.alias("response"), F.lit(False).alias("truncated"), F.when(F.col("p_partkey") % 11 == 0, "timeout").alias("error"), F.lit("c").alias("class_id"))


@register(
    "verdict_texts",
    f"""{A.ALL}
    select m.line_id, case when t.line_id is null then '' else 'size: ' || case when t.ok_size = 1 then 'COMPLIANT' else 'DEVIATION' end || ', brand: ' || case when t.ok_brand = 1 then 'COMPLIANT' else 'DEVIATION' end
      || ', insulation_class: ' || case when t.ok_class = 1 then 'COMPLIANT' else 'DEVIATION' end end as verdicts
    from match_v m left join top_v t on t.line_id = m.line_id and t.place = 1 and m.match_type = 'spec'""",
)
def verdict_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-6, JN-6: the verdicts of every line's best product as a text."""
    return matched(spark, sf_dir, spelled=True).select("line_id", proposals.verdict_text(F.col("verdicts")).alias("verdicts"))


@register(
    "verdict_rules",
    """select p_partkey, case p_partkey % 3 when 0 then 'COMPLIANT' when 1 then 'DEVIATION' else 'UNVERIFIABLE' end as at_most, case p_partkey % 4 when 0 then 'COMPLIANT' when 1 then 'COMPLIANT' when 2 then 'DEVIATION' else 'UNVERIFIABLE' end as equal_number,
      case when p_partkey % 5 = 1 then 'DEVIATION' when p_partkey % 5 = 4 then 'UNVERIFIABLE' else 'COMPLIANT' end as equal_bool, 'UNVERIFIABLE' as no_rule, case p_partkey % 2 when 0 then 'COMPLIANT' else 'DEVIATION' end as equal_text,
      case p_partkey % 3 when 0 then 'COMPLIANT' when 1 then 'DEVIATION' else 'UNVERIFIABLE' end as ordered from part""",
)
def verdict_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA-3: every kind of comparison, values that cannot be read, and a missing rule or offer."""
    rule = lambda t, o: F.struct(F.lit(t).alias("datatype"), F.lit(o).alias("match_op"))
    rules = F.create_map(F.lit("price"), rule("numeric", "lte"), F.lit("rpm"), rule("numeric", "eq"), F.lit("ip"), rule("bool", "eq"), F.lit("colour"), rule("text", "eq"), F.lit("insulation_class"), rule("text", "gte"))
    bag = lambda **v: F.create_map(*(x for k, c in v.items() for x in (F.lit(k), c)))
    need = bag(price=F.lit("100"), rpm=F.lit("1500"), ip=F.lit("TRUE"), weight=F.lit("3"), colour=F.lit(" Red"), insulation_class=F.lit("F"))
    have = bag(
        price=_pick("p_partkey", "99.5", "101", "on request"), rpm=_pick("p_partkey", "1500.0", "1500", "1501", "fast"), ip=_pick("p_partkey", "true", "false", "True", "TRUE", None), weight=F.lit("3"),
        colour=_pick("p_partkey", "red ", "blue"), insulation_class=_pick("p_partkey", "Class H", "B", "unknown"),
    )
    offered = F.coalesce(matching.typed_offers(F.col("have"), rules), F.create_map().cast("map<string,struct<num:double,txt:string>>"))
    # values are read once a row: what is a column of its own is not put into each of its places again
    read = A.table(spark, sf_dir, "part").select("p_partkey", have.alias("have")).withColumns({"offered": offered, "required": matching.typed_requirements(need, rules)})
    found = read.select("p_partkey", matching.verdicts(F.col("required"), F.col("offered"), need, F.col("have")).alias("v"))
    named = {"price": "at_most", "rpm": "equal_number", "ip": "equal_bool", "weight": "no_rule", "colour": "equal_text", "insulation_class": "ordered"}
    of = lambda n: F.get(F.filter("v", lambda x: x["attr"] == n), F.lit(0))["verdict"]
    return found.select("p_partkey", *(of(n).alias(c) for n, c in named.items()))


@register(
    "crawl_filters",
    """select event_id, event_id % 4 = 0 as host, event_id % 5 in (0, 1) as link, event_id % 3 <> 2 as api, event_id % 6 in (0, 1, 4) as resource, event_id % 7 in (0, 1, 2, 3) as content from events""",
)
def crawl_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10, FLT-12, FLT-13, FLT-17, FLT-18."""
    p = lambda *v: _pick("event_id", *v)
    page = p("https://shop.example.com/api/items", "https://shop.example.com/p", "https://shop.example.com/p")
    inside = F.when(F.col("event_id") % 3 == 1, F.array(F.lit("https://shop.example.com/graphql/"))).otherwise(F.array().cast("array<string>"))
    kind, media = p("document", "script", "stylesheet", "image", "xhr", "fetch"), p("text/html; charset=utf-8", "application/javascript", "text/plain", "image/png", "application/ld+json", "image/png")
    content = p("text/html", "Application/JSON; q=1", "image/svg+xml", "application/xhtml+xml", "image/png", "application/pdf", "video/mp4")
    return A.table(spark, sf_dir, "events").select(
        "event_id", url.valid_crawl_host(p("shop.example.com", "https://shop.example.com", "10.0.0.1", "shop.example.com:8080")).alias("host"),
        url.safe_link(p("https://a.example.com/x", "HTTP://a.example.com", "javascript:alert(1)", "ftp://a.example.com", "https:///x")).alias("link"),
        url.api_evidence(page, inside).alias("api"), url.resource_accepted(kind, media).alias("resource"), text.accepted_type(content).alias("content"),
    )


@register(
    "answer_scalars",
    """select p_partkey, case p_partkey % 3 when 0 then 'slow down' when 1 then 'plain' else repeat('x', 300) end as error, case p_partkey % 3 when 2 then 0 else 2 end::int as n_items, case when p_size >= 40 then 'medium' else 'low' end as band,
      case p_partkey % 4 when 0 then 1234.5 when 1 then 7 when 3 then -2 end::double as price, case p_partkey % 3 when 0 then 'M1' when 1 then 'S1' else 'N1' end as hint,
      case when p_partkey % 2 = 0 then 'Motor' end as guessed, case p_partkey % 3 when 0 then 90 when 1 then 60 else 0 end::bigint as wait, case p_partkey % 3 when 0 then 'I1' when 1 then 'M1' else 'N1' end as upload_identity from part""",
)
def answer_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA-18, SCA-20, SCA-24, SCA-25, SCA-44, SCA-48, SCA-50, SCA-51."""
    p = lambda *v: _pick("p_partkey", *v)
    now = F.lit("2024-05-01 10:00:00").cast("timestamp")
    items = text.json_array(p('["a","b"]', '"[\\"a\\",\\"b\\"]"', "nothing"), "array<string>")
    return A.table(spark, sf_dir, "part").select(
        "p_partkey", text.error_text(p('{"error":{"message":"slow down"}}', "plain", "x" * 400)).alias("error"), F.size(items).alias("n_items"), numbers.score_band(F.col("p_size")).alias("band"),
        identity.upload_price(p(" 1,234.50", "7", "seven", "-2")).cast("double").alias("price"), identity.identity_hint(p(" M1", " ", None), p("x", "S1", ""), F.lit("N1")).alias("hint"),
        identity.guessed_class(p("AC motor 5 kW", "pump"), F.array(F.lit("Gear"), F.lit("Motor"))).alias("guessed"), text.retry_after(p("90", "Wed, 01 May 2024 10:01:00 GMT", "Wed, 01 May 2024 09:00:00 GMT"), now).alias("wait"),
        F.coalesce(identity.blank_to_null(p("I1", "", None)), identity.blank_to_null(p(None, "M1", " ")), F.lit("N1")).alias("upload_identity"),
    )


@register("bag_display", "select p_partkey, (case when p_partkey % 2 = 0 then 3 else 2 end)::bigint as n, 'new' as shared, case when p_partkey % 2 = 0 then p_brand end as brand from part")
def bag_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-15, SET-6."""
    left = F.create_map(F.lit("shared"), F.lit("old"), F.lit("brand"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(""), F.lit("none"), F.lit(None).cast("string"))
    bag = attrs.non_empty(attrs.map_union(left, F.create_map(F.lit("shared"), F.lit("new"), F.lit("size"), F.col("p_size").cast("string"))))
    return A.table(spark, sf_dir, "part").select("p_partkey", bag.alias("b")).select("p_partkey", F.size("b").cast("long").alias("n"), F.element_at("b", "shared").alias("shared"), F.element_at("b", "brand").alias("brand"))


@register(
    "candidate_halves",
    """select doc_id, ([length(x) for x in list_filter(string_split(t, '~'), lambda x: x <> '')])[1]::int as first, 3::int as n_groups, (case when doc_id % 2 = 0 then 2 else 1 end)::int as n_halves
    from (select doc_id, 'Product one' || doc_id || '~Model two~three' as t from documents)""",
)
def candidate_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA-39, SCA-40."""
    candidate = F.concat(F.lit("Product one"), F.col("doc_id").cast("string"), F.lit("\nModel two\n  \n three\n\n"))
    groups = text.candidate_groups(candidate, 1000)
    halves = text.halves(F.when(F.col("doc_id") % 2 == 0, F.lit("one two three")).otherwise(F.lit("onetwothree")))
    return A.table(spark, sf_dir, "documents").select("doc_id", F.length(F.get(groups, F.lit(0))).alias("first"), F.size(groups).alias("n_groups"), F.size(halves).alias("n_halves"))


@register(
    "answers_products",
    """select p_partkey::varchar as prompt_key, v.pos::int as pos, v.name || case when v.pos = 0 then p_partkey::varchar else '' end as name, v.price::double as price, v.currency, v.class_id from part,
      (values (0, 'Motor', 1200.5, 'EUR', 'c1'), (1, 'Pump', null, 'JOD', null)) v(pos, name, price, currency, class_id)
    where p_partkey % 11 <> 0 and p_partkey % 3 <> 2 and (p_partkey % 3 = 0 or v.pos = 0)""",
)
def answers_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-1, SCA-41, JN-15: whole JSON, broken JSON of which one product is whole, and none."""
    one, two = '{"class_name":"MOTORS","name":"Motor#","price":"1,200.50","currency":"EUR","attributes":{"a":"1"}}', '{"name":"Pump","class_name":"other"}'
    got = models.parsed_products(_answers(spark, sf_dir, f'{{"products":[{one},{two},{{"name":" "}}]}}', f'```json\n{{"products":[{one},{{"name":"Pu', "I found nothing"))
    classes = spark.createDataFrame([("c1", "Motors"), ("c2", "Pumps")], "class_id string, name string")
    return models.classified_lines(got, classes).select("prompt_key", "pos", "name", F.col("price").cast("double").alias("price"), "currency", "class_id")


@register(
    "answers_lines",
    """select p_partkey::varchar as prompt_key, v.line_no, v.description || p_partkey as description, v.qty::double as qty, v.class_id, v.kv from part, (values ('1', 'motor ', 2, 'c1', '1000.0'), ('2', 'gear ', null, null, null)) v(line_no, description, qty, class_id, kv)
    where p_partkey % 11 <> 0 and p_partkey % 2 = 0""",
)
def answers_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-11, DML-22, JN-13, JN-14: lines with class and canonical bag; a key known by another name, in another unit."""
    said = json.dumps({"lines": [{"class_name": "motors", "description": "motor #", "qty": 2, "attributes": {"volts": "1", "voltage_unit": "kV"}}, {"class_name": "gears", "description": "gear #"}]})
    classes = spark.createDataFrame([("c1", "Motors")], "class_id string, name string")
    definitions = spark.createDataFrame([("c1", "voltage", "V", None), ("c1", "voltage", "V", None)], "class_id string, name string, canonical_unit string, value_aliases map<string,string>")
    aliases = spark.createDataFrame([("c1", "volts", "voltage"), ("c1", "volts", "voltage")], "class_id string, alias string, canonical_name string")
    lines = flows.tender_lines(_answers(spark, sf_dir, said, "no lines"), classes, flows.class_maps(definitions, aliases))
    return lines.select("prompt_key", "line_no", "description", "qty", "class_id", F.element_at("attributes", "voltage").alias("kv"))


@register(
    "answers_schemas",
    """select p_partkey::varchar as prompt_key, v.* from part, (values ('definition', 'power', 'gte'), ('definition', 'colour', 'eq'), ('label', 'power', 'Power'), ('page', 'LISTING', '/a'), ('group', 'phase', 'phases'), ('synonym', 'one', '1'), ('url', 'https://x.example.com/1', '0')) v(kind, name, value)
    where p_partkey % 11 <> 0 or v.kind in ('page', 'url')""",
)
def answers_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-6 to FN-10 and FN-13: one answer that holds all kinds, of which only the good parts come out."""
    said = json.dumps(
        {
            "class_name": "Motors", "attributes": [{"name": "power", "label": "Power", "datatype": "numeric", "match_op": "gte"}, {"name": "colour", "datatype": "text", "match_op": "near"}, {"name": "mpn", "datatype": "text"}, {"name": "odd", "datatype": "list"}],
            "page_type": "LISTING", "priority": 50, "follow": True, "partition": "/a", "confidence": 90,
            "groups": [{"canonical": "phase", "aliases": ["phases", "unknown", "phase"]}, {"canonical": "unknown", "aliases": ["phase"]}, {"canonical": "power", "aliases": []}],
            "synonyms": [{"spec": "phase", "variant": "one", "canonical": "1"}, {"spec": "phase", "variant": "1", "canonical": "1"}, {"spec": "phase", "variant": "two", "canonical": "1"}],
            "urls": ["https://x.example.com/1", "javascript:x"],
        }
    )
    a = _answers(spark, sf_dir, said)
    keyed = a.withColumn("class_id", F.col("prompt_key"))
    keys = a.select(F.col("prompt_key").alias("class_id"), F.explode(F.array(*map(F.lit, ("phase", "phases", "power")))).alias("name"))
    values = a.select(F.col("prompt_key").alias("class_id"), F.lit("phase").alias("key"), F.explode(F.array(F.lit("one"), F.lit("1"))).alias("value"))
    row = lambda df, kind, key, name, value: df.select(F.col(key).alias("prompt_key"), F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(value).cast("string").alias("value"))
    out = row(models.class_definitions(a), "definition", "prompt_key", "name", "match_op")
    out = out.unionByName(row(models.attribute_labels(keyed, keys.where("name = 'power'")), "label", "class_id", "name", "label"))
    out = out.unionByName(row(models.page_types(a), "page", "prompt_key", "page_type", "partition"))
    out = out.unionByName(row(models.duplicate_groups(keyed, keys).withColumn("alias", F.array_join("aliases", ",")), "group", "class_id", "canonical", "alias"))
    out = out.unionByName(row(models.value_synonyms(keyed, values), "synonym", "class_id", "variant", "canonical"))
    return out.unionByName(row(models.product_urls(a), "url", "prompt_key", "url", "pos"))


@register("answers_acceptance", "select p_partkey as line_id, (case p_partkey % 2 when 0 then 70 else 0 end)::int as probability, case p_partkey % 2 when 0 then 'fits' else '' end as reasoning from part where p_partkey % 11 <> 0")
def answers_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-12."""
    a = _answers(spark, sf_dir, '{"probability":70,"reasoning":"fits"}', "no").withColumn("line_id", F.col("p_partkey")).withColumn("product_id", F.col("p_partkey"))
    return models.acceptance(a).drop("product_id")


@register(
    "answers_crawl",
    """select p_partkey::varchar as prompt_key, case when p_partkey % 4 in (0, 3) then 0 end::int as pos, case p_partkey % 4 when 0 then 'Motor' || p_partkey when 3 then 'Pump' end as name, case p_partkey % 4 when 0 then '9.5' when 3 then '7' end as price, case when p_partkey % 4 = 0 then 90 end::int as confidence,
      case p_partkey % 4 when 1 then 'unknown version' when 2 then 'no valid product' end as error from part""",
)
def answers_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-3: good answers, another version, no valid product, and one that is invalid beside a valid one."""
    good = '{"schemaVersion":"1.0","products":[{"name":"Motor#","attributes":{"a":1},"price":9.5,"confidence":90}]}'
    mixed = '{"schemaVersion":"1.0","products":[{"name":"Pump","attributes":{},"price":"7"},{"name":5,"attributes":{}},{"name":"x"}]}'
    a = _answers(spark, sf_dir, good, good.replace("1.0", "2.0"), '{"schemaVersion":"1.0","products":[{"name":"x"}]}', mixed)
    return models.crawl_products(a).select("prompt_key", "pos", "name", "price", "confidence", "error")


def _halving_client(task: str, prompt: str) -> tuple[str, bool]:
    """Reads candidates of one word only."""
    words = prompt.split()
    said = {"schemaVersion": "1.0", "products": [{"name": words[0], "attributes": {}}]} if len(words) == 1 else {}
    return json.dumps(said), False


@register(
    "crawl_halving",
    """select p_partkey::varchar as prompt_key, v.pos::int as pos, v.name || p_partkey as name, null::varchar as error from part, (values (0, 'a'), (1, 'b')) v(pos, name) where p_partkey % 3 = 0 or (p_partkey % 3 = 1 and v.pos = 0)
    union all select p_partkey::varchar, null, null, 'no call left' from part where p_partkey % 3 = 2""",
)
def crawl_halving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-5: a candidate that its halves settle, one that needs no halving, and one for which the calls do not suffice."""
    k = F.col("p_partkey").cast("string")
    prompt = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("a"), k, F.lit(" b"), k)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("a"), k)).otherwise(F.concat(F.lit("a b c d e"), k))
    asked = A.table(spark, sf_dir, "part").select(k.alias("prompt_key"), prompt.alias("prompt"))
    return models.extract_by_halves(asked, _halving_client, most=3).select("prompt_key", "pos", "name", "error")


@register("user_guard", "select c_custkey as user_id, false as owns from customer c where not exists (select 1 from orders where o_custkey = c_custkey) union all select o_custkey, true from orders where o_custkey % 7 = 3 group by o_custkey")
def user_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-22, FLT-16."""
    users = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    owned = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"))
    mine = flows.owned(owned.withColumn("asks", F.col("user_id")).where("asks % 7 = 3"), F.col("asks")).select("user_id").distinct()
    return flows.removable_users(users, owned).select("user_id", F.lit(False).alias("owns")).unionByName(mine.select("user_id", F.lit(True).alias("owns")))


@register("chunk_log", "select doc_id, 0 as chunk_no, case doc_id % 4 when 0 then 'ok' when 1 then 'incomplete' when 2 then 'failed' else 'missing' end as status, case when doc_id % 4 = 2 then 'timeout' end as error from documents")
def chunk_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-6, AGG-19."""
    docs = A.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("text "), F.col("doc_id").cast("string")).alias("text"))
    k = F.col("doc_id") % 4
    answers = docs.where(k != 3).select(F.sha2("text", 256).alias("prompt_key"), F.when(k == 2, None).otherwise(k == 1).alias("truncated"), F.when(k == 2, "timeout").alias("error"))
    return flows.run_log(docs, answers)


@register(
    "tender_states",
    """select o_orderkey as tender_id, case o_orderkey % 5 when 0 then 'done' when 1 then 'failed' when 2 then 'matching' when 3 then 'uploading' else 'done' end as status from orders""",
)
def tender_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-2: a whole run, a failure, one that is matching, one without events, and one that is asked to match again."""
    orders = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tender_id"))
    flow = F.element_at(F.array(*(F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in (["extract", "match", "matched"], ["extract", "error", "matched"], ["match", "match"], [], ["extract", "match", "matched", "match", "error"]))), (F.col("tender_id") % 5 + 1).cast("int"))
    events = orders.select("tender_id", F.posexplode(flow).alias("n", "event")).select("tender_id", "event", F.timestamp_seconds(F.col("n")).alias("at"))
    return tenders.with_states(orders, events)


@register(
    "new_classes",
    """select distinct p_type as name, false as auto_created, 0::bigint as n_rules from part where p_type not like 'S%' union all select distinct p_type, true, 2 from part where p_type like 'S%'""",
)
def new_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-7: classes that start with S are unknown; every name is asked for, in another spelling."""
    names = A.table(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct()
    said = F.concat(F.lit('{"class_name":'), F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2), F.lit(',"attributes":[{"name":"a","datatype":"text","match_op":"eq"},{"name":"b","datatype":"numeric","match_op":"gte"}]}'))
    answers = names.select(F.col("name").alias("prompt_key"), said.alias("response"), F.lit(None).cast("string").alias("error"))
    none = spark.createDataFrame([], "class_id string, name string, datatype string, match_op string, canonical_unit string")
    classes, rules = tenders.new_classes(names.select(F.lower("name").alias("class_name")), names.where("name not like 'S%'").select(F.col("name").alias("class_id"), "name"), none, answers)
    counted = rules.groupBy("class_id").agg(F.count("*").alias("n_rules"))
    return classes.join(counted, "class_id", "left").select("name", "auto_created", F.coalesce("n_rules", F.lit(0).cast("long")).alias("n_rules"))


@register(
    "admin_products",
    f"""with {A.PRODUCTS}, {A.SUPPLIERS} select product_id, p.name, mpn, supplier_id, s.name as supplier_name, class_id as product_class, is_stale, case when product_id % 2 = 0 then '{{"brand":"' || p_brand || '"}}' end as attributes, '2024-01-02T03:04:05Z' as last_observed_at
    from products_v p join suppliers_v s using (supplier_id)""",
)
def admin_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-4."""
    rows = A.products(spark, sf_dir)
    bag = F.when(F.col("product_id") % 2 == 0, F.create_map(F.lit("brand"), F.element_at("attributes", "brand"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = rows.withColumn("attributes", bag).withColumn("last_observed_at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    classes = rows.select("class_id", F.col("class_id").alias("name")).distinct()
    return tenders.admin_rows(rows, A.suppliers(spark, sf_dir).select("supplier_id", "name"), classes)


@register("run_details", "select o_orderkey as run_id, o_custkey as supplier_id, o_orderstatus = 'F' as can_reconcile, (o_orderkey % 5)::bigint as fetched, 0::bigint as failed from orders")
def run_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-5."""
    nothing = {c: F.lit(None).cast("long") for c in ("discovered", "failed", "rejected", "retried", "pending")}
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETE").otherwise("RUNNING")
    runs = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("supplier_id"), status.alias("status"), (F.col("o_orderkey") % 5).alias("fetched"), F.lit(1.0).alias("completeness_score"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at")).withColumns(nothing)
    return tenders.run_rows(runs).select("run_id", "supplier_id", F.col("completeness.can_reconcile").alias("can_reconcile"), F.col("counts.fetched").alias("fetched"), F.col("counts.failed").alias("failed"))


@register("tenders_newest", "select o_orderkey as tender_id, o_custkey as user_id from orders where o_custkey = (select min(o_custkey) from orders)")
def tenders_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-6: the tenders of the first user, newest first; tests look at the order."""
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tender_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"))
    first = rows.agg(F.min("user_id").alias("first"))
    return tenders.newest(rows.join(F.broadcast(first), rows.user_id == first["first"], "left_semi")).select("tender_id", "user_id")


@register("sync_totals", "select count(*)::bigint as added, sum(p_size)::bigint as fixed, 0::bigint as removed, count(*) filter (p_partkey % 2 = 0)::bigint as merged, sum(p_partkey % 3)::bigint as \"values\" from part")
def sync_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21."""
    k = F.col("p_partkey")
    rows = A.table(spark, sf_dir, "part").select(F.lit(1).cast("long").alias("added"), F.col("p_size").cast("long").alias("fixed"), F.lit(0).cast("long").alias("removed"), (k % 2 == 0).cast("long").alias("merged"), (k % 3).cast("long").alias("values"))
    return tenders.sync_total(rows)


@register("unit_table", "select p_partkey, case p_partkey % 4 when 0 then p_retailprice * 1000.0 + 0.0 when 1 then p_retailprice * 0.5556 + -17.778 else p_retailprice end as value from part")
def unit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-8: conversions from a table, in which one stands twice."""
    units = spark.createDataFrame([("kV", "V", 1000.0, 0.0), ("kV", "V", 1000.0, 0.0), ("°F", "°C", 0.5556, -17.778), ("V", "V", 5.0, 5.0)], "from_unit string, to_unit string, factor double, addend double")
    rows = A.table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("value"), _pick("p_partkey", "kV", "°F", "V", "parsec").alias("from_unit"), _pick("p_partkey", "V", "°C", "V", "m").alias("to_unit"))
    return tenders.converted(rows, units).select("p_partkey", "value")


@register("page_manuals", "select 'p' || p_size as page_url, p_partkey as pos, 'DMM-' || p_partkey as identity, 'https://m.example.com/' || p_partkey || '.pdf' as manual from part where p_partkey % 2 = 0")
def page_manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-19: manuals linked under other spellings, twice, and tokens that are too short."""
    part = A.table(spark, sf_dir, "part")
    k, page = F.col("p_partkey").cast("string"), F.concat(F.lit("p"), F.col("p_size").cast("string"))
    products = part.select(page.alias("page_url"), F.col("p_partkey").alias("pos"), F.concat(F.lit("DMM-"), k).alias("identity")).unionByName(part.select(page.alias("page_url"), F.lit(-1).cast("long").alias("pos"), F.lit("x-").alias("identity")))
    link = lambda pos, tail: part.where("p_partkey % 2 = 0").select(page.alias("page_url"), F.lit(pos).alias("doc_pos"), F.concat(F.lit("https://m.example.com/"), k, F.lit(tail)).alias("url"), F.concat(F.lit("dmm "), k).alias("linked_identity"))
    short = part.select(page.alias("page_url"), F.lit(0).alias("doc_pos"), F.lit("https://m.example.com/x.pdf").alias("url"), F.lit("X").alias("linked_identity"))
    return tenders.manuals_of(products, link(1, ".pdf").unionByName(link(2, "-b.pdf")).unionByName(short))
