"""Answers of language models as table functions: asked once a distinct prompt, read from a table or a client, checked before use."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.attrs import is_identifier
from ..functions.identity import DEFAULT_CURRENCY, blank_to_null, upload_price

ANSWER = "task string, prompt_key string, response string, truncated boolean, error string"
MOST_CALLS = 8
MATCH_OPS = ["eq", "gte", "lte"]
PAGE_TYPES = ["PRODUCT", "LISTING", "CATEGORY", "API", "OTHER", "UNKNOWN"]
PRODUCTS = "array<struct<class_name:string,name:string,mpn:string,price:string,currency:string,description:string,attributes:map<string,string>>>"
#: task, prompt -> response, truncated
Client = Callable[[str, str], tuple[str, bool]]


def prompt_key(system: str, user: str):
    """SRC-17."""
    return F.sha2(F.concat_ws("|", F.col(system), F.col(user)), 256)


def ask(requests: DataFrame, client: Client) -> DataFrame:
    """SRC-15: (task, prompt_key, prompt) as answers; equal prompts are asked once. An exception is an ``error``, not the end of the job."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for task, key, prompt in zip(frame["task"], frame["prompt_key"], frame["prompt"], strict=True):
                try:
                    response, truncated = client(task, prompt)
                    rows.append((task, key, response, truncated, None))
                except Exception as e:
                    rows.append((task, key, None, False, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["task", "prompt_key", "response", "truncated", "error"])

    return requests.select("task", "prompt_key", "prompt").dropDuplicates(["task", "prompt_key"]).mapInPandas(batches, ANSWER)


def from_table(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """The same from a table of known answers; a prompt without one gets an ``error``."""
    asked = requests.select("task", "prompt_key").distinct()
    known = answers.select("task", "prompt_key", "response", "truncated", "error")
    return asked.join(known, ["task", "prompt_key"], "left").withColumn("error", F.when(F.col("response").isNull() & F.col("error").isNull(), "no answer").otherwise(F.col("error")))


def ask_until_done(requests: DataFrame, client: Client, most: int = MOST_CALLS) -> DataFrame:
    """FN-2: asks again, with the names already given, while the answer is cut off and brings something new; a failed further call keeps what there is."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for task, key, prompt in zip(frame["task"], frame["prompt_key"], frame["prompt"], strict=True):
                found: dict[str, dict] = {}
                truncated, error = False, None
                for call in range(most):
                    try:
                        response, truncated = client(task, prompt if not found else f"{prompt}\nAlready given: {', '.join(found)}")
                    except Exception as e:
                        error = None if call else f"{type(e).__name__}: {e}"[:300]
                        truncated = True
                        break
                    new = {n: p for p in salvage(response) if (n := identity_of(p)) and n not in found}
                    found |= new
                    if not truncated or not new:
                        break
                rows.append((task, key, json.dumps({"products": list(found.values())}), truncated, error))
            yield pd.DataFrame(rows, columns=["task", "prompt_key", "response", "truncated", "error"])

    return requests.select("task", "prompt_key", "prompt").dropDuplicates(["task", "prompt_key"]).mapInPandas(batches, ANSWER)


def identity_of(product: dict) -> str:
    """SCA-18 on one object."""
    bag = product.get("attributes") or {}
    for value in (bag.get("item_no"), product.get("mpn"), product.get("name")):
        if value is not None and str(value).strip():
            return str(value).strip()
    return ""


def salvage(text: str | None) -> list[dict]:
    """SCA-41: products of an answer: whole JSON, without fences or talk before it; of broken JSON the complete objects of the array."""
    text = (text or "").replace("```json", "").replace("```", "")
    at = text.find('{"products"')
    at = text.find("{") if at < 0 else at
    if at < 0:
        return []
    text = text[at:]
    decoder = json.JSONDecoder()
    try:
        value, _ = decoder.raw_decode(text)
        return [p for p in value.get("products") or [] if isinstance(p, dict)] if isinstance(value, dict) else []
    except ValueError:
        pass
    at, out = text.find("["), []
    while 0 <= at < len(text):
        at = text.find("{", at)
        if at < 0:
            break
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            break
        if isinstance(value, dict):
            out.append(value)
        at = end
    return out


def salvaged_json(column: str):
    """SCA-41 as a column of JSON text; only answers that Spark cannot read go through Python."""
    fixed = F.pandas_udf(lambda s: s.map(lambda x: json.dumps({"products": salvage(x)})), "string")
    whole = F.try_parse_json(F.col(column)).isNotNull() & F.get_json_object(column, "$.products").isNotNull()
    return F.when(whole, F.col(column)).otherwise(fixed(F.col(column)))


def parsed_products(answers: DataFrame) -> DataFrame:
    """FN-1: products of answers, one a row, with position; answers without a list of products are left to ``failed``."""
    rows = answers.where("error is null").withColumn("p", F.from_json(salvaged_json("response"), f"products {PRODUCTS}")["products"])
    each = rows.select("prompt_key", F.posexplode("p").alias("pos", "p")).select("prompt_key", "pos", "p.*")
    return each.where(blank_to_null(F.col("name")).isNotNull()).withColumn("price", upload_price(F.col("price"))).withColumn("currency", F.coalesce(blank_to_null(F.col("currency")), F.lit(DEFAULT_CURRENCY)))


def parsed_lines(answers: DataFrame) -> DataFrame:
    """FN-11, DML-22: requirement lines, numbered from 1."""
    schema = "lines array<struct<class_name:string,raw_text:string,description:string,qty:double,qty_unit:string,attributes:map<string,string>>>"
    each = answers.where("error is null").select("prompt_key", F.posexplode(F.from_json("response", schema)["lines"]).alias("pos", "l"))
    return each.select("prompt_key", (F.col("pos") + 1).cast("string").alias("line_no"), "l.*")


def classified_lines(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """JN-15: lines with the class of their name, without regard to case; others are unclassified."""
    known = classes.groupBy(F.upper("name").alias("k")).agg(F.min("class_id").alias("class_id"))
    return lines.withColumn("k", F.upper("class_name")).join(known, "k", "left").drop("k").withColumn("status", F.when(F.col("class_id").isNull(), "unclassified").otherwise("classified"))


def page_types(answers: DataFrame) -> DataFrame:
    """FN-6: page types of answers that are well formed: a known type, numbers of 0 to 100, a path from the root."""
    a = answers.select("prompt_key", F.from_json("response", "page_type string, priority int, follow boolean, partition string, confidence int").alias("a")).select("prompt_key", "a.*")
    return a.where(F.col("page_type").isin(*PAGE_TYPES) & F.col("priority").between(0, 100) & F.col("confidence").between(0, 100) & F.col("partition").startswith("/"))


def class_definitions(answers: DataFrame) -> DataFrame:
    """FN-7: definitions of a class, one a row; comparisons that are none become eq."""
    schema = "class_name string, attributes array<struct<name:string,label:string,datatype:string,match_op:string,canonical_unit:string>>"
    each = answers.where("error is null").select("prompt_key", F.from_json("response", schema).alias("a")).select("prompt_key", "a.class_name", F.explode("a.attributes").alias("d")).select("prompt_key", "class_name", "d.*")
    good = each.where("class_name is not null and name is not null and datatype in ('numeric', 'text', 'bool', 'enum')").where(~is_identifier(F.col("name")))
    return good.withColumn("match_op", F.when(F.col("match_op").isin(*MATCH_OPS), F.col("match_op")).otherwise("eq"))


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` in as many tasks as the session names. Names repeat and compress to little, so that a shuffle of them looks small and would be put into few tasks, which hold them unpacked.

    For the same reason what is known of all classes is not broadcast: its file says little of its size.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def attribute_labels(answers: DataFrame, requested: DataFrame) -> DataFrame:
    """FN-8: labels and comparisons of requested names only."""
    schema = "attributes array<struct<name:string,label:string,match_op:string>>"
    each = answers.where("error is null").select("class_id", F.explode(F.from_json("response", schema)["attributes"]).alias("d")).select("class_id", "d.*")
    known = _spread(requested.select("class_id", "name"), "class_id", "name").hint("merge")
    return _spread(each, "class_id", "name").join(known, ["class_id", "name"], "left_semi").withColumn("match_op", F.when(F.col("match_op").isin(*MATCH_OPS), F.col("match_op")).otherwise("eq"))


def duplicate_groups(answers: DataFrame, known: DataFrame) -> DataFrame:
    """FN-9: groups of known keys: a known canonical one and at least one known alias."""
    schema = "groups array<struct<canonical:string,aliases:array<string>,value_map:map<string,string>>>"
    each = answers.where("error is null").select("class_id", F.explode(F.from_json("response", schema)["groups"]).alias("g")).select("class_id", "g.*")
    names = _spread(known.select("class_id", "name"), "class_id").groupBy("class_id").agg(F.collect_set("name").alias("names"))
    kept = _spread(each.where("canonical is not null and size(aliases) > 0"), "class_id").join(names.hint("merge"), "class_id").where(F.array_contains("names", F.col("canonical")))
    return kept.withColumn("aliases", F.array_remove(F.array_intersect("aliases", "names"), F.col("canonical"))).where(F.size("aliases") > 0).drop("names")


def value_synonyms(answers: DataFrame, values: DataFrame) -> DataFrame:
    """FN-10: pairs of which both ends are values of the key."""
    schema = "synonyms array<struct<spec:string,variant:string,canonical:string>>"
    each = answers.where("error is null").select("class_id", F.explode(F.from_json("response", schema)["synonyms"]).alias("s")).select("class_id", "s.*")
    seen = values.select("class_id", F.col("key").alias("spec"), "value").distinct()
    each = each.where("variant <> canonical")
    for end in ("variant", "canonical"):
        keys = ["class_id", "spec", end]
        each = _spread(each, *keys).join(_spread(seen.withColumnRenamed("value", end), *keys).hint("merge"), keys, "left_semi")
    return each.select("class_id", "spec", "canonical", "variant")


def acceptance(answers: DataFrame) -> DataFrame:
    """FN-12: probability and reason; what is missing is 0 and empty, and nothing is clamped."""
    a = F.from_json("response", "probability int, reasoning string")
    return answers.where("error is null").select("line_id", "product_id", F.coalesce(a["probability"], F.lit(0)).alias("probability"), F.coalesce(a["reasoning"], F.lit("")).alias("reasoning"))


def product_urls(answers: DataFrame, most: int = 30) -> DataFrame:
    """FN-13: addresses of an answer, none for a bad one."""
    urls = F.coalesce(F.from_json("response", "urls array<string>")["urls"], F.array().cast("array<string>"))
    return answers.select("prompt_key", F.posexplode(F.slice(F.filter(urls, lambda u: u.rlike("^https?://")), 1, most)).alias("pos", "url"))


# Bounds of an answer to a crawled page, and its version.
CRAWL_VERSION, MOST_CRAWL_PRODUCTS, MOST_CRAWL_ATTRIBUTES, MOST_CRAWL_DEPTH, MOST_CRAWL_TEXT, MOST_CANDIDATE = "1.0", 100, 64, 6, 4096, 12_000
CRAWL_TEXTS = ["identityHint", "name", "mpn", "className", "currency", "priceSourceUrl", "sourceUrl"]
CRAWL_PRODUCT = "pos int, identity_hint string, name string, mpn string, class_name string, attributes string, price string, currency string, price_source_url string, source_url string, confidence int"


class BadAnswer(ValueError):
    """An answer that cannot be used as a whole."""


def _bounded(value: object) -> int:
    """Number of the attributes in a value; raises where a bound is passed."""
    todo, number = [(value, 0)], 0
    while todo:
        node, depth = todo.pop()
        if depth > MOST_CRAWL_DEPTH or isinstance(node, str) and len(node) > MOST_CRAWL_TEXT:
            raise BadAnswer("attributes are too deep or too long")
        if isinstance(node, dict):
            number += len(node)
            if number > MOST_CRAWL_ATTRIBUTES or any(len(k) > MOST_CRAWL_TEXT for k in node):
                raise BadAnswer("too many attributes")
            todo += [(v, depth + 1) for v in node.values()]
        elif isinstance(node, list):
            todo += [(v, depth + 1) for v in node]
    return number


def _crawl_product(pos: int, p: object) -> tuple:
    if not isinstance(p, dict) or not isinstance(p.get("attributes"), dict):
        raise BadAnswer("a product needs attributes")
    _bounded(p["attributes"])
    texts = [p.get(f) for f in CRAWL_TEXTS]
    if any(t is not None and (not isinstance(t, str) or len(t) > MOST_CRAWL_TEXT) for t in texts):
        raise BadAnswer("a text is none or too long")
    price = p.get("price")
    if isinstance(price, bool) or price is not None and not isinstance(price, int | float | str):
        raise BadAnswer("a price is none")
    if price is not None and not Decimal(str(price)).is_finite():
        raise BadAnswer("a price is none")
    confidence = p.get("confidence")
    confidence = confidence if isinstance(confidence, int) and not isinstance(confidence, bool) and abs(confidence) < 1 << 31 else None
    hint, name, mpn, class_name, currency, price_source, source = texts
    return pos, hint, name, mpn, class_name, json.dumps(p["attributes"], sort_keys=True, ensure_ascii=False), None if price is None else str(price), currency, price_source, source, confidence


def crawl_products_of(response: str | None) -> list[tuple]:
    """FN-3 on one answer: strict JSON of the known version with a bounded list; products that are invalid are dropped, an answer of only such is bad."""
    try:
        value = json.loads(response or "")
    except ValueError as e:
        raise BadAnswer("no JSON") from e
    if not isinstance(value, dict) or value.get("schemaVersion") != CRAWL_VERSION:
        raise BadAnswer("unknown version")
    products = value.get("products")
    if not isinstance(products, list) or len(products) > MOST_CRAWL_PRODUCTS:
        raise BadAnswer("no list of products, or too many")
    out = []
    for pos, p in enumerate(products):
        try:
            out.append(_crawl_product(pos, p))
        except (BadAnswer, ArithmeticError):
            continue
    if products and not out:
        raise BadAnswer("no valid product")
    return out


def _crawl_frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in CRAWL_PRODUCT.split(", ")]
    frame = pd.DataFrame(rows, columns=["prompt_key", *names, "error"], dtype=object)
    return frame


def crawl_products(answers: DataFrame) -> DataFrame:
    """FN-3: products of answers to crawled candidates, one a row; a bad answer is one row with its ``error`` and nothing else."""
    nothing = (None,) * len(CRAWL_PRODUCT.split(", "))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, response in zip(frame["prompt_key"], frame["response"], strict=True):
                try:
                    rows += [(key, *p, None) for p in crawl_products_of(response)]
                except BadAnswer as e:
                    rows.append((key, *nothing, str(e)))
            yield _crawl_frame(rows)

    return answers.select("prompt_key", "response").mapInPandas(batches, f"prompt_key string, {CRAWL_PRODUCT}, error string")


def halved(text: str) -> list[str]:
    """SCA-40 on one text: cut at the first white space from its middle on, or in the middle if there is none; a text of one character stays whole."""
    middle = len(text) // 2
    at = next((i for i in range(middle, len(text)) if text[i].isspace()), middle)
    return [p for p in (text[:at].strip(), text[at:].strip()) if p] or [text]


def extract_by_halves(requests: DataFrame, client: Client, most: int = 2) -> DataFrame:
    """FN-5: (prompt_key, prompt) as products like ``crawl_products``; where an answer is bad its candidate is halved and asked again, ``most`` calls a candidate in all.

    A candidate that cannot be halved any further, or runs out of calls, is one row with its ``error``: nothing that other halves gave is kept.
    """
    nothing = (None,) * len(CRAWL_PRODUCT.split(", "))

    def products(candidate: str, left: list[int]) -> list[tuple]:
        if not left[0]:
            raise BadAnswer("no call left")
        left[0] -= 1
        try:
            if len(candidate) > MOST_CANDIDATE:
                raise BadAnswer("the candidate is too long")
            return crawl_products_of(client("crawl", candidate)[0])
        except BadAnswer as e:
            parts = halved(candidate)
            if not left[0] or parts == [candidate]:
                raise BadAnswer("no call left" if not left[0] else str(e)) from e
            return [p for part in parts for p in products(part, left)]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, prompt in zip(frame["prompt_key"], frame["prompt"], strict=True):
                try:
                    rows += [(key, pos, *p[1:], None) for pos, p in enumerate(products(prompt or "", [most]))]
                except Exception as e:  # noqa: BLE001 - a client's failure is the error of its candidate
                    rows.append((key, *nothing, f"{e}"[:300]))
            yield _crawl_frame(rows)

    return requests.select("prompt_key", "prompt").dropDuplicates(["prompt_key"]).mapInPandas(batches, f"prompt_key string, {CRAWL_PRODUCT}, error string")
