"""Fill-in-the-middle: texts cut into prefix, middle and suffix at word ends, for all rows of an Arrow batch together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernel import pieces, raw

SEED, RATE, SPM = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of rows that are cut together, and of a part of a longer row.
PIECE = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def unit_ends(data: np.ndarray, after: int | None = None) -> np.ndarray:
    """Whether a unit ends with each byte: a character that is no white space before one that is. ``after`` is the byte behind the last one."""
    space = _SPACE[data]
    out = np.zeros(len(data), bool)
    out[:-1] = ~space[:-1] & space[1:]
    if len(data):
        out[-1] = after is None or (not space[-1] and _SPACE[after])
    return out


def _chosen(n: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = h1 % (n + 1), h2 % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


def cut_rows(data: np.ndarray, offs: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, code points of the prefix, code points of the middle) of each row of a buffer."""
    first, last = offs[:-1], offs[1:]
    ends = unit_ends(data)
    ends[last[last > first] - 1] = True  # a text's last byte ends a unit, whatever follows in the buffer
    running = np.concatenate([[0], np.cumsum(ends)])
    base = running[first]  # what a document starts from
    n = running[last] - base
    points = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
    k1, k2 = _chosen(n, h1, h2)
    at = [np.where(k > 0, np.searchsorted(running[1:], base + k) + 1, first) for k in (k1, k2)]
    return n, points[at[0]] - points[first], points[at[1]] - points[at[0]]


def cut_long(data: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``cut_rows`` for one long row: counts of its parts first, then only the parts that are cut are summed byte by byte."""
    bounds = [*range(0, len(data), PIECE), len(data)]
    parts = list(zip(bounds[:-1], bounds[1:], strict=True))
    mask = lambda a, b: unit_ends(data[a:b], int(data[b]) if b < len(data) else None)
    units = np.concatenate([[0], np.cumsum([np.count_nonzero(mask(a, b)) for a, b in parts])])
    points = np.concatenate([[0], np.cumsum([np.count_nonzero(data[a:b] & 0xC0 != 0x80) for a, b in parts])])
    n = units[-1:]
    chars = []
    for k in _chosen(n, h1, h2):
        if not k[0]:
            chars.append(0)
            continue
        p = int(np.searchsorted(units, k[0])) - 1
        a, b = parts[p]
        at = a + int(np.searchsorted(np.cumsum(mask(a, b)), k[0] - units[p])) + 1
        chars.append(int(points[p]) + int(np.count_nonzero(data[a:at] & 0xC0 != 0x80)))
    return n, np.array(chars[:1]), np.array([chars[1] - chars[0]])


def cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """struct(n, prefix_chars, middle_chars) of each text of a batch, in pieces of bounded bytes."""
    one, two = (h.to_numpy(zero_copy_only=False).astype(np.int64) for h in (h1, h2))
    out = np.zeros((3, len(text)), np.int64)
    for a, b in pieces(text, PIECE):
        data, offs = raw(text.slice(a, b - a), lower=False, stop=None)
        long = b - a == 1 and len(data) > PIECE
        out[:, a:b] = cut_long(data, one[a:b], two[a:b]) if long else cut_rows(data, offs, one[a:b], two[a:b])
    return pa.StructArray.from_arrays([pa.array(x) for x in out], ["n", "prefix_chars", "middle_chars"])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text with a sentinel in it is never cut, so each sentinel stands once."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    head, tail = F.substring_index(body, SUFFIX, 1), F.substring_index(body, SUFFIX, -1)
    psm = F.concat(head, F.substring_index(tail, MIDDLE, -1), F.substring_index(tail, MIDDLE, 1))
    head, tail = F.substring_index(body, PREFIX, 1), F.substring_index(body, PREFIX, -1)
    spm = F.concat(F.substring_index(tail, MIDDLE, 1), F.substring_index(tail, MIDDLE, -1), head)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row of ``docs`` (doc_id, text).

    A unit is a word with the white space before it, or the white space at the end; n is their number. Of a hundred texts ``rate`` are
    cut after two numbers of units that a hash of seed and doc_id gives, and of these ``spm`` have the suffix first (form spm), the others
    the prefix (psm). Empty texts and texts that hold a sentinel stay plain: null prefix_chars and middle_chars, the text as output.

    Null is read as the empty text, a null doc_id as no digits. Repeated rows give equal rows, and so do reruns. Other columns are ignored.
    The kernel returns numbers only; texts of any length pass through it in parts, and outputs are put together by Spark.
    """
    kernel = F.arrow_udf(cuts, "n long, prefix_chars long, middle_chars long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("decimal(38,0)").cast("string"), F.lit(""))), 256)
    number = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    rows = docs.select(F.col("doc_id"), text.alias("text"), digest.alias("digest")).select("doc_id", "text", *(x.alias(f"h{i + 1}") for i, x in enumerate(number)))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")).withColumn("cut", kernel("text", "h1", "h2"))
    a, b = F.col("cut.prefix_chars"), F.col("cut.middle_chars")
    prefix, middle, suffix = F.substr("text", F.lit(1), a), F.substr("text", a + 1, b), F.substr("text", a + b + 1)
    output = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    output = output.when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.col("text"))
    shown = [F.when(F.col("form") != "plain", F.col(f"cut.{c}")).alias(c) for c in ("prefix_chars", "middle_chars")]
    return rows.select("doc_id", F.col("cut.n").alias("n"), "form", *shown, output.alias("output"))


ORACLE = r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u
  from documents),
k as (
  select *, len(u) as n, ('0x' || h[1:8])::bigint % (len(u) + 1) as a, ('0x' || h[9:16])::bigint % (len(u) + 1) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || h[17:24])::bigint % 100 >= 50 then 'plain'
      when ('0x' || h[25:32])::bigint % 100 < 80 then 'spm' else 'psm' end as form
  from d),
c as (
  select doc_id, text, n, form, array_to_string(u[1:least(a, b)], '') as pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') as mid, array_to_string(u[greatest(a, b) + 1:], '') as suf
  from k)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(pre)::bigint end as prefix_chars, case when form <> 'plain' then length(mid)::bigint end as middle_chars,
  sha256(case form when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid when 'spm' then '<S>' || suf || '<P>' || pre || '<M>' || mid else text end) as output_sha256,
  sha256(text) as restored_sha256
from c
"""
