"""Text and markup by expressions: stripping, links, chunks, waiting times and statuses of the crawl."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import strip

ARABIC = r"[؀-ۿ]"
MAX_CHUNK = 12_000
# What product numbers and paths of pages look like to the crawl.
PRODUCT_ID = r"(?i)\b(?:mpn|sku|model|product)[:#\s-]*[a-z0-9][a-z0-9._/-]*|\b[a-z]{2,}[.-]?\d{2,}[a-z0-9.-]*\b"
NON_CATALOG, API = r"/(account|login|signin|register|cart|checkout)(/|$)", r"/(api|graphql)(/|$)"
CATALOG, PRODUCT = r"/(catalog|products?|categories?|shop)(/|$)", r"/(products?|items?|models?)/"


def squeeze(c: Column) -> Column:
    """SCA-34: runs of white space as one space."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def has_arabic(c: Column) -> Column:
    return c.rlike(ARABIC)


def strip_html(c: Column) -> Column:
    """SCA-31: text of markup: scripts and styles, tags and named entities become blanks."""
    for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<[^>]+>", r"&[a-zA-Z]+;"):
        c = F.regexp_replace(c, pattern, " ")
    return squeeze(c)


def absolute_href(origin: Column, href: Column) -> Column:
    """SCA-33: an address on the origin, or the reference if it is absolute already."""
    host = F.regexp_extract(origin, r"^(https?://[^/?#]+)", 1)
    return F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(host, href)).otherwise(F.concat(host, F.lit("/"), href))


def navigation(html: Column, origin: Column, most: int = 300) -> Column:
    """SCA-32: ``label -> href`` of the first links of a page."""
    pattern = r"(?is)<a\b[^>]*?href=[\"']([^\"'#]+)[\"'][^>]*>(.*?)</a>"
    links = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), 1).alias("href"), F.regexp_extract_all(html, F.lit(pattern), 2).alias("label"))
    return F.slice(F.transform(links, lambda x: F.concat(strip_html(x["label"]), F.lit(" -> "), absolute_href(origin, x["href"]))), 1, most)


def pieces_of(c: Column, most: int) -> Column:
    """A text cut hard into pieces of ``most`` characters."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(c) - 1) / most).cast("int"))), lambda i: F.substring(c, i * most + 1, F.lit(most)))


def chunks(text: Column, most: int = MAX_CHUNK) -> Column:
    """SCA-38: pages are parted by form feeds; pages too long fall into lines, lines too long are cut; then pieces are
    packed in order, joined by line breaks, as long as they fit."""
    pages = F.filter(F.transform(F.split(text, "\f"), strip), lambda p: p != "")
    lines = lambda p: F.filter(F.split(p, "\n"), lambda x: strip(x) != "")
    units = F.flatten(F.transform(pages, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(F.flatten(F.transform(lines(p), lambda x: pieces_of(x, most))))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def put(state: Column, unit: Column) -> Column:
        joined = F.when(state["open"] == "", unit).otherwise(F.concat(state["open"], F.lit("\n"), unit))
        fits = F.length(joined) <= most
        return F.struct(F.when(fits, state["done"]).otherwise(F.array_append(state["done"], state["open"])).alias("done"), F.when(fits, joined).otherwise(unit).alias("open"))

    return F.aggregate(units, start, put, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def candidate_groups(text: Column, most: int) -> Column:
    """SCA-39: parts begin after blank lines and at lines that start with Product or Model; long parts are cut."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n|\n(?=(?:Product|Model)\b)"), strip), lambda p: p != "")
    return F.flatten(F.transform(parts, lambda p: pieces_of(p, most)))


def halves(text: Column) -> Column:
    """SCA-40: a text in two at the first white space from its middle on; whole if there is none."""
    middle = F.floor(F.length(text) / 2).cast("int")
    space = F.regexp_instr(F.substr(text, middle + 1), F.lit(r"\s"))
    at = middle + space
    return F.when(space == 0, F.array(text)).otherwise(F.array(strip(F.substr(text, F.lit(1), at)), strip(F.substr(text, at + 1))))


def retry_after(header: Column, now: Column) -> Column:
    """SCA-44: seconds to wait, from a number or a date; not negative."""
    date = F.try_to_timestamp(F.regexp_replace(header, r"^\s*[A-Za-z]{3},\s*", ""), F.lit("dd MMM yyyy HH:mm:ss zzz"))
    return F.greatest(F.lit(0).cast("long"), F.coalesce(strip(header).try_cast("long"), F.unix_timestamp(date) - F.unix_timestamp(now)))


def backoff_seconds(attempt: Column, share: Column | None = None) -> Column:
    """SCA-45: 30 s doubled for each attempt up to ten times, spread by a quarter with ``share`` in -1..1, never below 30 s."""
    base = 30 * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(10)))
    return F.greatest(F.lit(30.0), base if share is None else base * (1 + 0.25 * share))


def robots_backoff_ms(attempt: Column, header_seconds: Column, cap: int = 2_000) -> Column:
    """SCA-49: what the server asks for, else 100 ms doubled for each attempt; both capped. Without jitter."""
    return F.least(F.lit(cap).cast("double"), F.coalesce(header_seconds * 1000.0, 100.0 * F.pow(F.lit(2.0), F.least(attempt, F.lit(20)))))


def ceiling(default: Column, supplier: Column, override: Column) -> Column:
    """SCA-46: the least of the limits that are set."""
    return F.least(default, supplier, override)


def throttle(default: Column, supplier: Column, override: Column) -> Column:
    """SCA-46: of waiting times the greatest."""
    return F.greatest(default, supplier, override)


def error_text(body: Column) -> Column:
    """SCA-50: the message in a JSON error body, else the body; 300 characters at most."""
    return F.left(F.coalesce(F.get_json_object(body, "$.error.message"), body), F.lit(300))


def json_array(c: Column, schema: str) -> Column:
    """SCA-51: an array, from JSON or from a JSON string that holds JSON; empty if it is neither."""
    inner = F.from_json(F.concat(F.lit('{"x":'), c, F.lit("}")), "x string")["x"]
    return F.coalesce(F.from_json(c, schema), F.from_json(inner, schema), F.from_json(F.lit("[]"), schema))


def accepted_type(c: Column) -> Column:
    """FLT-10: content types that a crawl reads."""
    kind = F.lower(strip(F.substring_index(c, ";", 1)))
    return kind.startswith("text/") | kind.endswith("+json") | kind.endswith("+xml") | kind.isin("application/json", "application/xml", "application/xhtml+xml", "application/ld+json")


def claimable(status: Column, next_at: Column, now: Column) -> Column:
    """FLT-6."""
    return (status == "PENDING") | ((status == "RETRY") & (next_at.isNull() | (next_at <= now)))


def classify_page(path: Column, structured: Column, embedded: Column, pagination: Column, product_links: Column, identifiers: Column, fallback: bool = False) -> Column:
    """SCA-30: (page_type, priority, follow, confidence); the first rule that holds decides."""
    p = F.lower(path)
    kind = lambda name, priority, follow, confidence: F.struct(F.lit(name).alias("page_type"), F.lit(priority).alias("priority"), F.lit(follow).alias("follow"), F.lit(confidence).alias("confidence"))
    return (
        F.when(p.rlike(NON_CATALOG) & (structured == 0), kind("OTHER", 0, False, 98))
        .when(structured == 1, kind("PRODUCT", 100, True, 100))
        .when(structured > 1, kind("LISTING", 95, True, 100))
        .when(p.rlike(API) & (embedded > 0), kind("API", 96, True, 95))
        .when((pagination > 0) | (product_links >= 4) | (identifiers >= 4), kind("LISTING", 85, True, 90))
        .when(p.rlike(PRODUCT) & (identifiers > 0), kind("PRODUCT", 80, True, 80))
        .when(p.rlike(CATALOG) | (product_links > 0), kind("CATEGORY", 65, True, 80))
        .otherwise(kind("UNKNOWN", 25, True, 0) if fallback else kind("OTHER", 10, False, 75))
    )


def identifier_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(PRODUCT_ID), 0))


def document_kind(media_type: Column, url: Column) -> Column:
    """SRC-4: format of a document by declared type, else by the ending of its address."""
    kind = F.lower(strip(F.substring_index(media_type, ";", 1)))
    known = {
        "application/pdf": "PDF", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "DOCX", "application/msword": "DOC", "application/rtf": "RTF", "text/rtf": "RTF",
        "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "XLSX", "application/vnd.ms-excel": "XLS", "text/plain": "TXT", "text/html": "HTML", "application/xhtml+xml": "HTML",
    }
    by_type = F.try_element_at(F.create_map(*(F.lit(v) for pair in known.items() for v in pair)), kind)
    return F.coalesce(by_type, kind_by_ending(url))


def kind_by_ending(url: Column) -> Column:
    """SRC-4: format of a document by the ending of its address."""
    known = {k: "HTML" if k == "htm" else k.upper() for k in ("pdf", "docx", "doc", "rtf", "xlsx", "xls", "txt", "html", "htm")}
    ending = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return F.try_element_at(F.create_map(*(F.lit(v) for pair in known.items() for v in pair)), ending)


def magic_kind(content: Column) -> Column:
    """SRC-3: family of a document by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "PDF").when(head.startswith("504B0304"), "ZIP").when(head.startswith("D0CF11E0A1B11AE1"), "OLE").when(head.startswith("7B5C727466"), "RTF").otherwise("TEXT")


def agreed_kind(media_type: Column, url: Column, content: Column) -> Column:
    """SRC-3: the format on which declared type, address and first bytes agree, else TYPE_MISMATCH."""
    told = F.struct(document_kind(media_type, url).alias("kind"), kind_by_ending(url).alias("other"), magic_kind(content).alias("magic"))

    def agreed(t: Column) -> Column:
        kind, other = t["kind"], t["other"]
        family = F.when(kind.isin("DOCX", "XLSX"), "ZIP").when(kind.isin("DOC", "XLS"), "OLE").when(kind.isin("TXT", "HTML"), "TEXT").otherwise(kind)
        return F.when(kind.isNull(), "UNKNOWN").when((other.isNotNull() & (other != kind)) | (family != t["magic"]), "TYPE_MISMATCH").otherwise(kind)

    # the variable of a lambda is computed once; a column would be written out at each of its mentions
    return F.get(F.transform(F.array(told), agreed), F.lit(0))
