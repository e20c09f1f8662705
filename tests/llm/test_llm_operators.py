"""Every operator against brute force on small tables that hold nulls, empty texts, repeated rows and ties."""

import hashlib
import itertools
import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from specmill.llm import blocks, decontaminate, html_text, lm_score, mixing, neighbours, ngram_join, quality, shared, suffix_dedup, textkernel, token_counts, toxicity
from specmill.llm.queries import oracle_sql, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"\w+", (t or "").lower())


def made(seed=1, n=60):
    """Documents with copies, near copies, shared passages and odd rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = text(60)
    rows = []
    for i in range(n):
        t = text(rng.randint(1, 120))
        if i % 7 == 3:
            t = rows[rng.randrange(len(rows))][1] or t
        elif i % 7 == 4:
            w = (rows[rng.randrange(len(rows))][1] or t).split()
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif i % 7 == 5:
            t = f"{text(10)} {passage} {text(5)}"
        rows.append((i, t, "en", f"s{i % 3}" if i % 3 else "s0", len(t)))
    odd = [(None, None), (900, ""), (901, None), (902, "  \n"), (903, "one two"), (904, "one two"), (904, "one two"), (905, "ab" * 200), (906, "éß" * 90), (None, rows[0][1]), (907, "!!! ???"), (908, "x" * 99), (909, "x" * 101), (910, passage)]
    return rows + [(i, t, None, None, None) for i, t in odd]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), DOCS).repartition(3).withColumn("node", F.lit("clash")).withColumn("th", F.lit(1)).withColumn("score", F.lit(2)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_nothing_in_nothing_out(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert ngram_join.ngram_join(spark, empty).count() == 0
    assert suffix_dedup.suffix_dedup(spark, empty).count() == 0
    assert mixing.mix_sources(spark, empty).count() == 0
    assert lm_score.lm_scores(spark, empty).count() == 0
    assert toxicity.toxicity(spark, empty, labels).count() == 0
    assert quality.quality(spark, empty, labels).count() == 0
    assert decontaminate.decontaminate(spark, empty, items).count() == 0
    assert neighbours.nearest(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert html_text.html_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pack():
    x, y = np.array([5, 1, 2**63], np.uint64), np.array([], np.int32)
    a, b = blocks.unpack(blocks.pack(x, y))
    assert (a == x).all() and a.dtype == x.dtype and len(b) == 0
    s = np.sort(x)
    assert (blocks.undeltas(blocks.deltas(s)) == s).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    up = {v: v for e in edges for v in e}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in shared.connected_components(shared.Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: find(v) for v in linked}


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_ngram_join(spark, docs):
    rows = [(i, t) for i, t, *_ in made()]
    sets = [shingles(t) for _, t in rows]
    up, links = list(range(len(rows))), Counter()

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-12:
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), 10**9))
    want = Counter((i, least.get(find(k)) if sets[k] else i, links[k]) for k, (i, _) in enumerate(rows))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(spark, docs).collect()) == want
    kept = Counter((r.doc_id, r.text) for r in ngram_join.one_of_each(spark, docs).collect())
    assert len(list(kept.elements())) == len({find(k) for k in range(len(rows)) if sets[k]}) + sum(not x for x in sets)
    assert ngram_join.one_of_each(spark, docs).columns == docs.columns


def test_ngram_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 7)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base[: 70 + i % 9], f"own{i}"])) for i in range(60)]
    got = ngram_join.ngram_join(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [shingles(t) for _, t in rows]
    assert {r.doc_id: r.n_links for r in got} == {a: sum(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-12 for b in range(60) if b != a) for a in range(60)}
    assert {r.class_id for r in got} == {0}


def test_bands_reach_their_recall():
    for t in (0.5, 0.8, 0.9):
        b = ngram_join.bands_for(t)
        assert 1 - (1 - t**4) ** b >= 0.9995 > 1 - (1 - t**4) ** (b - 1)


def removed(rows):
    """By definition: every byte of a 100-byte string that also starts earlier."""
    order = sorted({(i is None, i or 0, t or "") for i, t in rows})
    seen, out = set(), {}
    for null, i, t in order:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        out[None if null else i, t] = gone
    return out


def test_suffix_dedup(spark, docs):
    rows = [(i, t) for i, t, *_ in made()]
    want = removed(rows)
    got = suffix_dedup.suffix_dedup(spark, docs).collect()
    assert len(got) == len(rows)
    by_id = {(i, b): g for (i, t), g in want.items() for b in [t.encode()]}
    texts = {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in want}
    for r in got:
        gone = [g for (i, b), g in by_id.items() if i == r.doc_id and bytes(c for c, x in zip(b, g, strict=True) if not x) == bytes(r.kept) and len(b) == r.n_bytes]
        assert gone, r.doc_id
        g = gone[0]
        assert r.n_removed == sum(g) and r.kept_sha256 == hashlib.sha256(bytes(r.kept)).hexdigest()
        assert len(r.spans) == sum(x and not y for x, y in zip(g, [0, *g][: len(g)], strict=True))
    assert texts
    same = suffix_dedup.suffix_dedup_rows(spark, docs)
    assert same.columns == docs.columns and {r.node for r in same.collect()} == {"clash"}


def test_suffix_dedup_tells_contexts_apart(spark):
    """Two texts around one string of 50 bytes, and no 100 bytes in common, whose contexts share the 40 bits of hash once compared."""
    hot = "lmfsmfntjzenpeyiuoeoebqqpvwhxzcbsjydycerxtgtiiujuv"
    a = f"axzhnthdxhlxzmfxjisrdompifinwtykxfkqcmdtvqcfhfyage{hot}rcipdyyaoadpgkyywjufyktwumpynulnguvdbijxwlqglifmpk"
    b = f"zpzeafwxguyynaunjwajlwjhbfdaawixkfksjthofnwszlxtyb{hot}pbbbqhvwaqcghcfgeedqdjejwztnoekwisnxzbmxbunuhtdutn"
    docs = spark.createDataFrame([(1, a), (2, b), (3, b)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.suffix_dedup(spark, docs).collect()} == {1: 0, 2: 0, 3: 150}


def entries(texts, d):
    """An entry for each string of 100 bytes or more around an anchor in its middle."""
    key = np.zeros((len(texts), suffix_dedup.KEY), np.uint8)
    for k, (before, after) in enumerate(texts):
        key[k, : len(after)] = list(after)
        key[k, suffix_dedup.WINDOW : suffix_dedup.WINDOW + len(before)] = list(before[::-1])
        key[k, -2:] = len(after) + 1, len(before) + 1
    return suffix_dedup.Entries(key, np.array(d, np.int64), np.zeros(len(d), np.int64), np.zeros(len(d), np.uint32))


def test_scan_compares_lengths():
    kept, again = suffix_dedup.scan(entries([(b"a" * 20, b"b" * 80), (b"a" * 20, b"b" * 80 + b"\0"), (b"a" * 20, b"b" * 80), (b"\0" + b"a" * 20, b"b" * 80)], [3, 2, 1, 0]))
    assert sorted(kept.c[1].tolist()) == [0, 1, 2] and again.c[1].tolist() == [3]
    assert kept.windows().tolist() == [1, 2, 2] or sorted(kept.windows().tolist()) == [1, 2, 2]


def test_arrays_are_in_the_order_of_bytes():
    rng = random.Random(3)
    texts = [(bytes(rng.choices(b"ab", k=50)), bytes(rng.choices(b"ab\0", k=100))) for _ in range(200)]
    family = suffix_dedup.Family()
    for a in range(0, 200, 20):
        family.add(entries(texts[a : a + 20], range(a, a + 20)))
    left, _ = family.close()
    assert [bytes(k[:100]) for k in left.c[0]] == sorted(t for _, t in texts)


def test_index_family_keeps_the_earliest():
    rng = random.Random(2)
    family, out, everything = suffix_dedup.Family(), [], []
    for k in range(9):
        texts = [(bytes(50 - rng.randrange(3)), bytes(rng.choices(b"ab", k=3)) + bytes(97)) for _ in range(50)]
        ids = [i * 10 + k for i in rng.sample(range(1000), 50)]
        everything += list(zip(texts, ids, strict=True))
        out += family.add(entries(texts, ids)).c[1].tolist()
        sizes = [len(x) for x in family.levels]
        assert sizes == sorted(sizes, reverse=True)
    left, more = family.close()
    first = {}
    for t, d in everything:
        first[t] = min(d, first.get(t, d))
    assert sorted(left.c[1].tolist()) == sorted(first.values())
    assert sorted(out + more.c[1].tolist()) == sorted(d for t, d in everything if d != first[t])


def test_suffix_dedup_of_repetitive_texts(spark, monkeypatch):
    """Few letters, zero bytes, overlapping repeats, and long texts in parts."""
    monkeypatch.setattr(suffix_dedup, "PART", 400)
    rng = random.Random(6)
    texts = ["".join(rng.choices(["a", "b\0", "éa" * 30, "xyz" * 40], k=rng.randint(1, 20))) for _ in range(25)]
    texts += [texts[3][:150] + "Q" + texts[3][150:], "".join(rng.choices("ab", k=900)), "\0" * 450, "ab" * 300]
    rows = list(enumerate(texts))
    want = {i: sum(g) for (i, _), g in removed(rows).items()}
    monkeypatch.setattr(suffix_dedup, "pieces", lambda column, most=1: ((k, k + 1) for k in range(len(column))))
    got = [r for batch in _family_result(rows) for r in batch]
    assert dict(got) == want
    assert {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def _family_result(rows):
    """The whole way without Spark, in one range and many batches."""
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([i]), pa.array([t])], ["doc_id", "th", "text"]) for i, t in rows]
    blocks = [b for x in batches for b in suffix_dedup.anchor_batches(iter([x]), 1)]
    found = suffix_dedup.Found()
    for batch in suffix_dedup.family_batches(iter(blocks), 1):
        for b in batch.column("block"):
            found.add(b.as_py())
    for i, t in rows:
        spans = found.of(i, i)
        start, end = suffix_dedup.removed(spans) if spans is not None else (np.zeros(0), np.zeros(0))
        yield [(i, int((end - start).sum()))]


def test_decontaminate(spark):
    rng = random.Random(5)
    rows = made(5, 40)
    items = [(k, " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa la mu".split()) + str(rng.randrange(40)) for _ in range(rng.randint(5, 40)))) for k in range(12)] + [(90, "only three words"), (91, None), (92, "")]
    docs = [(i, t) for i, t, *_ in rows if i is not None][:20] + [(2000, None), (2001, ""), (2002, "here are only three words ok")]
    for k in range(60):
        w = rng.choice(items[:12])[1].split()
        for _ in range(rng.randint(0, 2)):
            q = rng.randrange(len(w))
            w[q : q + rng.randint(0, 1)] = ["zz"] * rng.randint(0, 1)
        if k % 9 == 0:
            w = w[len(w) // 2 :] + w[: len(w) // 2]
        docs.append((3000 + k, " ".join(rows[k % 20][1].split()[: rng.choice([0, 9])] + w)))
    want = {}
    for i, t in docs:
        w = words(t)
        for j, u in items:
            v = words(u)
            if not v or not w:
                continue
            target = Counter(shingle_list(v))
            for p in range(max(1, len(w) - len(v) + 1)):
                x = w[p : p + len(v)]
                if len(v) < 5 and x != v:
                    continue
                c = Counter(shingle_list(x))
                s = sum((c & target).values()) / sum((c | target).values())
                if s >= 0.8 and s > want.get((i, j), (0, 0))[0]:
                    want[i, j] = (s, p)
    found = decontaminate.decontaminate(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in found}
    assert set(got) == set(want) and len(want) > 20
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
    clean = decontaminate.without_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def shingle_list(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (60, 4), dtype=np.uint64)
    probes = np.repeat(base, 3, axis=0)
    for k in range(len(probes)):
        for b in rng.choice(256, rng.integers(0, 90), replace=False):
            probes[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    got = set(zip(*(x.tolist() for x in decontaminate.near(probes, base)), strict=True))
    far = np.bitwise_count(probes[:, None] ^ base).sum(2)
    assert got == set(zip(*(x.tolist() for x in np.nonzero(far <= decontaminate.RADIUS)), strict=True)) and 60 < len(got) < 180
    a, b = (rng.integers(0, 2**63, (3000, 4), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (3000, 4), dtype=np.uint64) for _ in range(2))
    blocks = np.bitwise_count(a.view(np.uint32) ^ b.view(np.uint32)) <= decontaminate.RADIUS // decontaminate.BLOCKS
    assert blocks.any(1).mean() < 0.02  # random pairs that the blocks let through


@pytest.mark.parametrize("m", [9, 36, 120])
def test_radius_holds_similarity(m):
    rng = np.random.default_rng(m)
    a = rng.integers(0, 2**63, (2000, m), dtype=np.uint64)
    b = a.copy()
    b[:, math.ceil(2 * m * 0.8 / 1.8) :] = 7  # the rest is one shingle, repeated
    assert (np.bitwise_count(decontaminate.simhash(decontaminate.distinct(a)) ^ decontaminate.simhash(decontaminate.distinct(b))).sum(1) <= decontaminate.RADIUS).mean() >= 0.999


def test_lm_scores(spark, docs):
    rows = [(i, words(t)) for i, t, *_ in made()]
    grams = lambda w, m: Counter(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    total = {m: Counter() for m in (1, 2, 3)}
    for _, w in rows:
        for m in total:
            total[m].update(grams(w, m))
    size = sum(total[1].values())

    def score(w):
        own = {m: grams(w, m) for m in total}
        count = lambda *g: total[len(g)][g] - own[len(g)][g]
        out = 0.0
        for i, c in enumerate(w):
            if i > 1 and count(*w[i - 2 : i + 1]) > 0:
                out += math.log(count(*w[i - 2 : i + 1]) / count(*w[i - 2 : i]))
            elif i and count(w[i - 1], c) > 0:
                out += math.log(count(w[i - 1], c) / count(w[i - 1])) + (math.log(0.4) if i > 1 else 0)
            else:
                out += math.log(max(count(c), 0.5)) - math.log(max(1, size - len(w))) + math.log(0.4) * min(i, 2)
        return out

    def corpus_score(w):
        out = 0.0
        for i, c in enumerate(w):
            over = size if i == 0 else total[min(i, 2)][tuple(w[max(0, i - 2) : i])]
            out += math.log(total[min(i, 2) + 1][tuple(w[max(0, i - 2) : i + 1])] / over)
        return out

    want = sorted((i is None, i or 0, len(w), score(w), score(w) / max(1, len(w)), corpus_score(w) / max(1, len(w))) for i, w in rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.total_log_score, r.log_score, r.corpus_log_score) for r in lm_score.lm_scores(spark, docs).collect())
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3:] for x in got], [x[3:] for x in want], atol=1e-4)


def test_lm_scores_of_equal_chunks(spark):
    one = spark.createDataFrame([(1, "a b c"), (2, "a b d")], "doc_id long, text string").coalesce(1)
    got = lm_score.lm_scores(spark, one.union(one)).collect()
    assert len(got) == 4 and len({round(r.log_score, 9) for r in got if r.doc_id == 1}) == 1


def test_lm_scores_tell_doubles_apart(spark):
    """What occurs twice in the corpus scores higher than what occurs once."""
    rng = random.Random(8)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 200))) for _ in range(300)]
    rows = list(enumerate(texts + texts[:40]))
    got = {r.doc_id: r.log_score for r in lm_score.lm_scores(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    once = sorted(got[i] for i in range(40, 300))
    assert sum(got[i] > once[247] for i in range(40)) >= 36  # nine of ten above 95 % of the others


def test_mixing(spark, docs):
    rows = mixing.mix_sources(spark, docs).collect()
    again = mixing.mix_sources(spark, docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.taken) for r in rows) == Counter((r.doc_id, r.taken) for r in again)
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in rows)
    assert abs(sum(x[0].target for x in by.values()) - 1.5 * total) < 1e-6
    for x in by.values():
        assert x[0].source_size == sum(r.size for r in x) and x[0].target <= 2 * x[0].source_size + 1e-9
        assert abs(sum(r.taken for r in x) - x[0].target) <= max(r.size for r in x) / 2 + 1e-9
    for r in rows:  # whole epochs before a part
        if r.source_size:
            assert r.copies in (math.floor(r.target / r.source_size), math.floor(r.target / r.source_size) + 1)
    mixed = mixing.mixed_rows(spark, docs)
    assert mixed.count() == sum(r.copies for r in rows)


@pytest.mark.parametrize("quality", [0.003, 1.0, 400.0])
def test_ranges_of_the_mix_stay_small(spark, quality):
    number = F.floor(F.log(-F.log(mixing.uniform(F.col("id"))) / quality) * (mixing.RANGES / mixing.RANGE_WIDTH))
    sizes = sorted(r["count"] for r in spark.range(200_000).groupBy(number.alias("range")).count().collect())
    assert sizes[-1] <= 10 * sizes[len(sizes) // 2]
    assert sizes[-1] <= 2 * 200_000 * mixing.RANGE_WIDTH / math.e / mixing.RANGES


def test_mixing_by_odd_qualities(spark):
    given = [None, 0.0, -1.0, float("nan"), float("inf"), 1e-320, 1e300, 0.5]
    docs = spark.createDataFrame([(i, "a b c", "s", given[i % 8]) for i in range(80)], "doc_id long, text string, source string, q double")
    rows = mixing.mix_sources(spark, docs, F.col("q")).collect()
    assert len(rows) == 80 and abs(sum(r.taken for r in rows) - 1.5 * 240) <= 1.5
    assert all(r.copies == 2 for r in rows if r.doc_id % 8 == 6) and all(r.copies == 1 for r in rows if r.doc_id % 8 == 5)


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16)).astype(np.float32)
    base[50] = base[49]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (None, [1.0] * 16), (20, [float(x) for x in base[20]]), (1020, [1.0, 2.0]), (1040, [3.0, 4.0]), (1060, [])]
    got = neighbours.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    x = base.astype(np.float64)
    for q in range(0, 300, 20):
        s = neighbours.exact(np.repeat(x[q : q + 1], 300, 0), x)
        want = sorted(((-s[c], c) for c in range(300) if c != q))[:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in mine] == [c for _, c in want] and [r.score for r in mine] == [-v for v, _ in want]
    assert {(r.query_id, r.vec_id) for r in got if r.query_id >= 1000} == {(1020, 1040), (1040, 1020)}


def test_neighbours_under_repeated_ids(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.0]), (3, [0.9, 0.0]), (3, [0.9, 0.0]), (4, [0.7, 0.0])]
    got = neighbours.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(20, 1, 3, 0.9), (20, 2, 4, 0.7), (20, 3, 3, 0.5)]


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_neighbours_leave_out_the_row_of_the_query_only(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rows = [(20, [1.0, 0.0]), (20, [10.4, 0.0]), (20, [1.0, 5.0]), (3, [0.5, 0.0]), (20, [1.0, 0.0]), (40, [2.0])]
    got = neighbours.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(20, 1, 20, 10.4), (20, 2, 20, 1.0), (20, 3, 3, 0.5)]


def test_neighbours_by_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, neighbours.nearest(spark, frame).collect()))
    for name, size in (("QUERY_TILE", 6), ("BLOCK", 16), ("UNIT", 64), ("STRIP", 2)):
        monkeypatch.setattr(neighbours, name, size)
    assert sorted(map(tuple, neighbours.nearest(spark, frame).collect())) == whole


@pytest.fixture(scope="module")
def vocabulary():
    sys.path.insert(0, "/opt/tokenizers/..")
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_counts(spark, docs, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    rng = random.Random(3)
    pool = "aabcdest re've'll'm'd'  \n\t\r 0129é漢ß  \x85\x1c​!?.,;-_=''\"<|endoftext|>LVERS\U0001f600٣²ª"
    texts = [None, "", " ", "\n", "<|endoftext|>", "a<|endoftext|>b  <|endoftext|> ", "it's it'S 'start ''s y'll've", "a" * 2000, " " * 999 + "x", "!" * 500 + "'s"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [t for _, t, *_ in made()]
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    counter = token_counts.Counter(vocabulary)
    size, tokens = counter.texts(pa.array(texts))
    assert tokens.tolist() == [count(t) for t in texts] and size.tolist() == [len((t or "").encode()) for t in texts]
    assert [counter.long(t, 5) for t in texts[6:300]] == [count(t) for t in texts[6:300]] or any("<|endoftext|>" in t for t in texts[6:300])
    got = token_counts.token_counts(docs, vocabulary, limit=50).collect()
    assert Counter((r.doc_id, r.n_tokens, r.over_limit) for r in got) == Counter((i, count(t), count(t) > 50) for i, t, *_ in made())


def test_token_counts_by_chunks(vocabulary):
    counter = token_counts.Counter(vocabulary)
    rng = random.Random(8)
    for _ in range(40):
        t = "".join(rng.choice("ab 's\n.1") for _ in range(rng.randint(0, 300)))
        assert {counter.long(t, k) for k in (1, 3, 50, 1000)} == {counter.plain(t) if t else 0}


def labelled(n=1200, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{k}x" for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        toxic, bad = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["idiotisch", "dummkopf", "idiotin"])
        t = " ".join(w)
        t = t.upper() + "!!!" if bad else t
        rows.append((i, t))
        labels.append((i, int(not bad), int(toxic)))
    return rows + [(None, "w1x"), (5000, None), (5001, "")], labels + [(None, 1, 1), (3, None, None)]


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_classifiers(spark, name):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    call, modulus, held = (toxicity.toxicity, 3, 1) if name == "toxic" else (quality.quality, 5, 0)
    got = call(spark, docs, marks).collect()
    truth = {i: (t if name == "toxic" else q) for i, q, t in labels if q is not None}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    tests = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % modulus == held for r in tests) and len(tests) > 150
    assert sum(r.predicted == truth[r.doc_id] for r in tests) / len(tests) > 0.97
    assert not next(r for r in got if r.doc_id is None).held_out


@pytest.mark.parametrize("label", [lambda a, b: a != b, lambda a, b: a and b, lambda a, b: a == b])
def test_factorization_learns_pairs(label):
    """Also of terms that tell nothing alone."""
    rng = random.Random(2)

    def rows(n):
        for _ in range(n):
            a, b = rng.random() < 0.5, rng.random() < 0.5
            yield int(label(a, b)), np.unique([t for t, has in ((7, a), (8, b)) if has] + [rng.randrange(200, 900) for _ in range(20)])

    model = toxicity.fit(list(rows(3000)))
    got = [(y, model.score(1, np.zeros(len(t), int), t)[0]) for y, t in rows(500)]
    assert sum((s >= 0.5) == y for y, s in got) >= 490


def test_rules_as_columns_score_as_rules(spark):
    rng = np.random.default_rng(1)
    x = rng.random((800, len(quality.STATS)))
    y = ((x[:, 3] > 0.5) & (x[:, 5] <= 0.4)).astype(float)
    bias, rules = quality.fit(x, y)
    assert 0 < len(rules) < 200
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], quality.STATS)
    got = np.array([r[0] for r in frame.select(quality.compile_rules(bias, rules)).collect()])
    want = 1 / (1 + np.exp(-(bias + sum(w * quality.holds(r, x) for r, w in rules))))
    assert np.allclose(got, want) and ((got > 0.5) == y).mean() > 0.97


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class=site-header><h1>My Site</h1></header><nav><ul><li>home</ul></nav>
<div id=cookie-banner><p>We use cookies to improve your experience on this site, please accept them all.</p></div>
<div class="X"><div class="Y"><h1>Real title</h1><p>First long <b>paragraph</b> of the real&nbsp;article, with many words &amp; a full stop.<br>
<p>Short.<div class="ad-slot">Buy now! The best shoes in the world are here for you today.</div><p>Second paragraph of the article goes here, with <a href=x>a link</a> inside &lt;it&gt;.</p>
<form><p>Enter your email to subscribe to our newsletter today please.</p></form></div><aside class=sidebar><p>Sidebar words that are long enough to look like a real paragraph of text, are they not?</p></aside></div>
<section id="comments"><p>I totally agree with this article, it is really the best one that I have read today.</p></section><script>var a = "</p>";</script><footer>(c) 2020"""
TEXT = "Real title\n\nFirst long paragraph of the real article, with many words & a full stop.\n\nShort.\n\nSecond paragraph of the article goes here, with a link inside <it>."


@pytest.mark.parametrize("kind", [("X", "Y"), ("layout", "content"), ("wrap", "post-body")])
def test_html_text(kind):
    assert html_text.main_text(PAGE.replace('"X"', f'"{kind[0]}"').replace('"Y"', f'"{kind[1]}"')) == TEXT


@pytest.mark.parametrize("wrapper", ["layout has-sidebar", "with-comments", "entry category-popular", "story share-enabled"])
@pytest.mark.parametrize("inner", ["<article>", "<main>", "<div class=content>"])
def test_html_text_in_wrappers(wrapper, inner):
    text = "First long paragraph of the real article, with many words and a full stop."
    remark = "I totally agree with this article, it is really the best one that I have read today."
    body = f"<div class='{wrapper}'>{inner}<p>{text}</p></{inner[1:].split()[0].rstrip('>')}><section id=comments><article><p>{remark}</p></article></section></div>"
    assert html_text.main_text(f"<body>{body}<div class=related><article><p>{remark[:40]}</p></article></div></body>") == text
    plain = body.replace("<section id=comments><article>", "<section id=comments>").replace("</article></section>", "</section>")
    assert html_text.main_text(f"<body>{plain}</body>") == text
    assert html_text.main_text(f"<body><p>{text} {text}</p><section id=comments><article><p>{remark}</p></article></section></body>") == f"{text} {text}"


def test_minimum_cut():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 7)
        s, t = [rng.randint(0, 6) for _ in range(n)], [rng.randint(0, 6) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 5)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.6]
        cost = lambda x: sum(t[i] if x[i] else s[i] for i in range(n)) + sum(c for a, b, c in edges if x[a] != x[b])  # noqa: B023, E731
        assert cost(html_text.minimum_cut(s, t, edges)) == min(cost(x) for x in itertools.product([False, True], repeat=n))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, sf, name):
    from compare import connection, same

    same(queries()[name](spark, sf).toPandas(), connection(sf).sql(oracle_sql()[name]).df())


@pytest.mark.parametrize("seed", range(6))
def test_quality_statistics_by_parts_equal_those_of_the_whole(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    bits = ["a line that comes again and again.\n", "\n", "Wort ", "\u0130STANBUL \u023a ", "x" * 40 + "!\n", "end. ", "\u4e2d\u6587\u3002", "one | two, 3\r\n", "no stop\n", "q" * 300 + " "]
    text = "".join(bits[i] for i in rng.integers(0, len(bits), 600))
    column = pa.array([text, text + "tail without a line feed", text + "\n", "short"])
    whole = [x for part in column for _, _, x in quality.statistics(pa.array([part.as_py()]))]
    for size in (700, 1500, 4000):
        monkeypatch.setattr(textkernel, "PART", size)
        monkeypatch.setattr(textkernel, "LONGEST", 400)
        cut = [x for part in column for _, _, x in quality.statistics(pa.array([part.as_py()]))]
        assert np.allclose(np.concatenate(cut), np.concatenate(whole), rtol=0, atol=1e-12)
