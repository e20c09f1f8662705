"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A window that is similar enough to an item shares most of the item's shingles with it, and at least one of its rarest few. Those
few are what a text is first looked up by; windows that hold enough shingles of an item are fingerprinted. Fingerprints within the
radius of an item's have at least one block of bits within the radius divided by the number of blocks: the blocks find all of
them, and few others. What is found is verified on its whole multiset of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import U, Hashes, _C, mix, pieces

N_WORDS, THRESHOLD = 5, 0.8
#: 64-bit words of a fingerprint, its blocks, and the bits of 256 in which a similar window may differ from its item. At similarity
#: 0.8 the mean is 38, the deviation 5.7 and the most of 24,000 pairs 60.
PRINT_WORDS, BLOCKS, RADIUS = 4, 8, 63
#: Items of one pass over the documents; their words are what is broadcast. More items take more passes.
PASS_ITEMS, PASS_BYTES = 20_000, 8 << 20
#: Pairs of fingerprints that are compared at once.
TILE = 1 << 20


@dataclass
class Group:
    """The items of one length in words. ``shingles``: a row of keys of ``distinct`` each."""

    length: int
    items: list[int]
    shingles: np.ndarray
    keys: np.ndarray
    prints: np.ndarray


@dataclass
class Index:
    ids: list[int]
    groups: list[Group]
    #: the rarest shingles of items of at least N_WORDS words, sorted, and for each the items, as (group, number in it)
    known: np.ndarray
    first: np.ndarray
    group_of: np.ndarray
    item_of: np.ndarray
    filter: np.ndarray


def distinct(shingles: np.ndarray) -> np.ndarray:
    """Rows of shingles as rows of keys, all different within a row: the second one of equal shingles has another key, and so on."""
    s = np.sort(shingles, axis=1)
    place = np.broadcast_to(np.arange(s.shape[1]), s.shape)
    head = np.where(np.concatenate([np.ones((len(s), 1), bool), s[:, 1:] != s[:, :-1]], axis=1), place, 0)
    return mix(s + (place - np.maximum.accumulate(head, axis=1)).astype(np.uint64) * _C[9])


def simhash(keys: np.ndarray) -> np.ndarray:
    """Fingerprints of PRINT_WORDS words of the rows of a matrix of keys: each shingle weighs as often as it stands there, each time with bits of its own, so that the radius holds whatever repeats."""
    out = np.empty((len(keys), PRINT_WORDS), np.uint64)
    step = max(1, (1 << 22) // max(1, keys.shape[1] * 64))
    for a in range(0, len(keys), step):
        for k in range(PRINT_WORDS):
            part = mix(keys[a : a + step] + _C[10 + k])
            bits = np.unpackbits(part.view(np.uint8).reshape(*part.shape, 8), axis=2)
            ones = bits.sum(axis=1, dtype=np.int32)
            out[a : a + step, k] = np.packbits(ones * 2 > part.shape[1], axis=1).view(np.uint64).ravel()
    return out


def near(prints: np.ndarray, others: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (row of ``prints``, row of ``others``) within the radius, in tiles of bounded size.

    Of BLOCKS blocks one at least differs in radius / BLOCKS bits or fewer; of random pairs 0.9 % have such a block.
    """
    mine, theirs = prints.view(np.uint32), others.view(np.uint32)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(1, TILE // max(1, len(others)))
    for a in range(0, len(prints), step):
        met = np.zeros((len(prints[a : a + step]), len(others)), bool)
        for k in range(BLOCKS):
            met |= np.bitwise_count(mine[a : a + step, k, None] ^ theirs[:, k]) <= radius // BLOCKS
        i, j = np.nonzero(met)
        ok = np.bitwise_count(prints[a + i] ^ others[j]).sum(1, dtype=np.int64) <= radius
        out.append((a + i[ok], j[ok]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the rows of two matrices of keys."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    same = (both[:, 1:] == both[:, :-1]).sum(1)
    return same / (a.shape[1] + b.shape[1] - same)


def build(rows: list[tuple[int, str]], n: int = N_WORDS, threshold: float = THRESHOLD) -> Index:
    words = Hashes(pa.array([t for _, t in rows], pa.string()))
    sh, first = words.shingles(n)
    count = words.counts()
    each, seen = np.unique(sh, return_counts=True)
    groups, place = [], []
    for length in np.unique(count[count > 0]).tolist():
        items = np.flatnonzero(count == length).tolist()
        shingles = np.stack([sh[first[i] : first[i + 1]] for i in items])
        if length >= n:
            # a similar text lacks at most m - threshold * m of the item's shingles: it has one of any so many and one more
            m = shingles.shape[1]
            rare = np.argsort(seen[np.searchsorted(each, shingles)], axis=1, kind="stable")[:, : m - math.ceil(threshold * m - 1e-9) + 1]
            for k, row in enumerate(np.take_along_axis(shingles, rare, 1).tolist()):
                place += [(s, len(groups), k) for s in set(row)]
        keys = distinct(shingles)
        groups.append(Group(length, items, shingles, keys, simhash(keys)))
    place.sort()
    known = np.array([p[0] for p in place], np.uint64)
    each, start = np.unique(known, return_index=True)
    bits = np.zeros(1 << 20, bool)
    bits[(each >> U(44)).astype(np.int64)] = True
    return Index([i for i, _ in rows], groups, each, np.append(start, len(known)), np.array([p[1] for p in place], np.int64), np.array([p[2] for p in place], np.int64), bits)


def candidates(sh: np.ndarray, first: np.ndarray, index: Index) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(group, row, items, places): by group and row, where one of the rarest shingles of an item stands."""
    at = np.flatnonzero(index.filter[(sh >> U(44)).astype(np.int64)])
    if not len(at) or not len(index.known):
        return
    place = np.searchsorted(index.known, sh[at])
    place[place == len(index.known)] = 0
    hit = index.known[place] == sh[at]
    at, place = at[hit], place[hit]
    if not len(at):
        return
    size = index.first[place + 1] - index.first[place]
    post = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(index.first[place], size)
    at = np.repeat(at, size)
    group, item, row = index.group_of[post], index.item_of[post], np.searchsorted(first, at, side="right") - 1
    order = np.lexsort((at, item, row, group))
    group, item, row, at = group[order], item[order], row[order], at[order]
    cut = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (row[1:] != row[:-1])]))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(at)], strict=True):
        yield int(group[a]), int(row[a]), item[a:b], at[a:b]


def windows_of(sh: np.ndarray, low: int, high: int, item: np.ndarray, places: np.ndarray, many: int, least: int) -> np.ndarray:
    """Starts of the windows of ``many`` shingles in [low, high) that hold a place and at least ``least`` shingles of the item."""
    starts = []
    edge = np.flatnonzero(np.diff(places) > many)
    for a, b in zip([places[0], *places[edge + 1]], [*places[edge], places[-1]], strict=True):
        lo, hi = max(low, a - many + 1), min(high, b + many)
        held = np.concatenate([[0], np.cumsum(np.isin(sh[lo:hi], item))])
        if len(held) > many:
            starts.append(lo + np.flatnonzero(held[many:] - held[:-many] >= least))
    return np.concatenate(starts) if starts else np.zeros(0, np.int64)


def matches(words: Hashes, index: Index, threshold: float, radius: int, n: int = N_WORDS) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, similarity, first word, words) of the best window of each row and item."""
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    sh, first = words.shingles(n)
    count = words.counts()

    def put(row: int, item: int, value: float, start: int, length: int) -> None:
        if (row, item) not in best or (-value, start) < (-best[row, item][0], best[row, item][1]):
            best[row, item] = (value, start, length)

    for g, row, items, places in candidates(sh, first, index):
        group = index.groups[g]
        many = group.length - n + 1
        low, high = int(first[row]), int(first[row + 1])
        if count[row] < group.length:  # a text shorter than the item is one window
            window = distinct(sh[None, low:high])
            for item in np.unique(items).tolist():
                value = float(similarity(window, group.keys[item : item + 1])[0])
                if value >= threshold:
                    put(row, group.items[item], value, 0, int(count[row]))
            continue
        least = math.ceil(2 * many * threshold / (1 + threshold) - 1e-9)
        cut = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]])).tolist()
        found = [windows_of(sh, low, high, group.shingles[items[a]], places[a:b], many, least) for a, b in zip(cut, [*cut[1:], len(items)], strict=True)]
        starts = np.unique(np.concatenate(found))
        for a in range(0, len(starts), 4096):
            keys = distinct(sh[starts[a : a + 4096, None] + np.arange(many)])
            w, item = near(simhash(keys), group.prints, radius)
            value = similarity(keys[w], group.keys[item])
            for k in np.flatnonzero(value >= threshold).tolist():
                put(row, group.items[int(item[k])], float(value[k]), int(starts[a + w[k]] - low), group.length)
    for group in index.groups:  # items too short for a shingle are found as they stand
        if group.length >= n:
            continue
        padded = np.concatenate([words.hash, np.zeros(n, np.uint64)])
        run = padded[: len(words.hash)] * _C[0]
        for j in range(1, group.length):
            run += padded[j : j + len(words.hash)] * _C[j]
        run = mix(run)
        order = np.argsort(group.shingles[:, 0])
        sorted_items = group.shingles[order, 0]
        left, right = (np.searchsorted(sorted_items, run, side=s) for s in ("left", "right"))
        for p in np.flatnonzero(right > left).tolist():
            r = int(np.searchsorted(words.first, p, side="right")) - 1
            if p + group.length <= words.first[r + 1]:
                for k in order[left[p] : right[p]].tolist():
                    put(r, group.items[k], 1.0, int(p - words.first[r]), group.length)
    for (r, item), (value, start, length) in sorted(best.items()):
        yield r, item, value, start, length


def match_batches(batches: Iterator[pa.RecordBatch], index: Index, threshold: float, radius: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, item_id, similarity, first_word, n_words)"""
    for batch in batches:
        for a, b in pieces(batch.column(1)):
            part = batch.slice(a, b - a)
            found = list(matches(Hashes(part.column(1)), index, threshold, radius))
            if found:
                row, item, value, start, length = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array([index.ids[i] for i in item], pa.int64()), pa.array(value), pa.array(start, pa.int64()), pa.array(length, pa.int64())], ["doc_id", "item_id", "similarity", "first_word", "n_words"])


def clean_batches(batches: Iterator[pa.RecordBatch], indexes: list[Index], text: int, threshold: float, radius: int) -> Iterator[pa.RecordBatch]:
    """The rows in which no item is found, as they are."""
    for batch in batches:
        for a, b in pieces(batch.column(text)):
            part = batch.slice(a, b - a)
            keep = np.ones(b - a, bool)
            words = Hashes(part.column(text))
            for index in indexes:
                keep[[r for r, *_ in matches(words, index, threshold, radius)]] = False
            yield part.filter(pa.array(keep))


def passes(items: DataFrame, threshold: float = THRESHOLD) -> Iterator[Index]:
    """Indexes over parts of the items, each of at most PASS_ITEMS items and about PASS_BYTES bytes of text."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null")
    number, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-number // PASS_ITEMS), -(-size // PASS_BYTES))
    for p in range(parts):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).distinct().collect()
        if got:
            yield build([(r.item_id, r.text) for r in sorted(got)], threshold=threshold)


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: benchmark items found in documents, with their best window.

    A window has as many words as the item, or all words of a shorter text. It matches where the weighted Jaccard similarity of
    the multisets of 5-word shingles is ``threshold`` or more; of equally good windows the first counts. An item of fewer
    than five words matches where its words stand in a row. Null, empty and wordless texts and items match nothing; null
    item ids are left out; each row of a repeated doc_id is searched and reported on its own; a null doc_id stays null.
    The result has rows for contaminated documents only.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    out = spark.createDataFrame([], schema)
    for k, index in enumerate(passes(items, threshold)):
        found = rows.mapInArrow(lambda it, index=index: match_batches(it, index, threshold, radius), schema)
        out = found if k == 0 else out.unionByName(found)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all their columns as they are, in which ``decontaminate`` finds no item."""
    text = docs.columns.index("text")
    for index in passes(items, threshold):
        docs = docs.mapInArrow(lambda it, index=index: clean_batches(it, [index], text, threshold, radius), docs.schema)
    return docs
