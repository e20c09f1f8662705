"""Divergence audit, fill-in-middle and MinHash near-dedup against brute force, with odd rows, long texts and hot groups."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from specmill.llm import divergence, fill_middle, minhash_dedup
from specmill.llm.queries import oracle_sql, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("node", "th", "h1", "cut", "form", "pieces", "term", "count", "value", "rank", "label")


def frame(spark, rows):
    out = spark.createDataFrame(rows, DOCS).repartition(3)
    for c in CLASHES:
        out = out.withColumn(c, F.lit("clash"))
    return out


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# divergence


def audit(rows):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, held, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        found = term.findall((text or "").translate(low))
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        groups[lang, source].update(found)
        held[lang].update(set(found))
    out = set()
    for lang, sources in langs.items():
        kept = {t for t, n in held[lang].items() if n >= 10}
        share = lambda count, total: 1 + 1_000_000_000 * (count + 2) // (total + 2 * len(kept))  # noqa: B023, E731
        p = {}
        for s in sources:
            total = sum(groups[lang, s][t] for t in kept)
            p[s] = {t: share(groups[lang, s][t], total) for t in kept}
        everything = Counter({t: sum(groups[lang, s][t] for s in sources) for t in kept})
        q = {t: share(everything[t], sum(everything.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)}
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(terms[:10])}
    return out


def spoken(seed=3, n=150):
    rng = random.Random(seed)
    vocabulary = [w for w in ("".join(rng.choice("abcéßXYZ") for _ in range(rng.randint(1, 4))) for _ in range(40))]
    rows = [(i, " ".join(rng.choice(vocabulary[(i % 3) * 5 :]) for _ in range(rng.randint(0, 30))) + "-1_2" + rng.choice(vocabulary), rng.choice(["en", "de"]), f"s{i % 4}", 0) for i in range(n)]
    rows += [(None, None, None, None, None), (1, "", "en", "without", 0), (2, "alone here", "xx", "one", 0), (3, "alone here", "xx", "ünder", 0), (3, "alone here", "xx", "zwei", 0), (4, "a b" * 50, "", "", 0)]
    return rows + [rows[5]] * 12


def test_divergence_is_that_of_plain_counting(spark, monkeypatch):
    rows = spoken()
    got = [tuple(r) for r in divergence.source_divergence(spark, frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == audit(rows)


def test_divergence_of_a_hot_group_and_long_texts(spark):
    long = "é" * 1_200_000 + " word " + "ab " * 400_000
    rows = spoken(5) + [(i, "common words of one source " * 3, "en", "hot", 0) for i in range(400)] + [(9000 + i, long, "en", "long", 0) for i in range(10)]
    assert {tuple(r) for r in divergence.source_divergence(spark, frame(spark, rows)).collect()} == audit(rows)


def test_pieces_of_a_text_cut_no_term(spark):
    text = ("x" * 100 + "1 ") * 30_000 + "y" * 600_000 + " z"
    row = spark.createDataFrame([(text,)], "text string").select(divergence.text_pieces(F.col("text")).alias("p")).first()
    assert "".join(row.p) == text and len(row.p) > 2
    found = re.compile(divergence.TERM).findall
    assert [t for p in row.p for t in found(p)] == found(text)


def test_divergence_of_nothing(spark, empty):
    assert divergence.source_divergence(spark, empty).count() == 0


# fill in the middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def cut(doc_id, text, rate=50):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return len(units), form, len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"


def torn(seed=4, n=300):
    rng = random.Random(seed)
    made = lambda: "".join(rng.choice(["a", "é", "漢", "😀", " ", "  ", "\n", "\t", "\x0b", " ", "<", "S>", "<P", ">"]) for _ in range(rng.randint(0, 40)))
    rows = [(i, made(), "en", "s", 0) for i in range(n)]
    rows += [(None, "no id here", None, None, None), (None, None, None, None, None), (7000, "", "", "", 0), (7001, " \n ", "", "", 0), (7002, "holds <S> here", "", "", 0), (-5, "a negative id of a text", "", "", 0), (7003, "one", "", "", 0)]
    return rows + rows[:20]


@pytest.mark.parametrize("rate", [50, 100])
def test_fill_middle_is_that_of_plain_cutting(spark, rate):
    rows = torn()
    done = fill_middle.fill_middle(frame(spark, rows), rate=rate)
    got = Counter(tuple(r) for r in done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect())
    assert got == Counter((r[0], *cut(r[0], r[1], rate)) for r in rows)
    back = done.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert Counter((r.doc_id, r.t) for r in back) == Counter((r[0], r[1] or "") for r in rows)


def test_fill_middle_of_a_long_text(spark):
    long = "Ünit und 漢字 " * 900_000  # three parts and more
    rows = [(i, long[i:], "en", "s", 0) for i in range(3)]
    got = {r.doc_id: tuple(r)[1:] for r in fill_middle.fill_middle(frame(spark, rows), rate=100).collect()}
    assert got == {r[0]: cut(r[0], r[1], 100) for r in rows}


def test_parts_are_cut_like_whole_rows(monkeypatch):
    monkeypatch.setattr(fill_middle, "PIECE", 7)
    rng = np.random.default_rng(1)
    for r in torn(9, 200):
        data = np.frombuffer((r[1] or "").encode(), np.uint8)
        h = [rng.integers(0, 2**32, 1) for _ in range(2)]
        if len(data):
            whole = fill_middle.cut_rows(data, np.array([0, len(data)]), *h)
            assert [int(x[0]) for x in whole] == [int(x[0]) for x in fill_middle.cut_long(data, *h)]


def test_fill_middle_of_nothing(empty):
    assert fill_middle.fill_middle(empty).count() == 0


# MinHash near-dedup


def sets_of(text, n=4):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(rows):
    sets = [frozenset(sets_of(r[1])) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), c := least.get(find(i)), r[0] == c) for i, r in enumerate(rows))


def copies(seed=6, n=260):
    """Exact and near copies, chains of drifting texts, and pairs on both sides of the threshold."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(500)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    rows, chain = [], text(150).split()
    for i in range(n):
        t = text(rng.randint(1, 160))
        if i % 5 == 1:
            t = rng.choice(rows)[1]
        elif i % 5 == 2:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = "changed"
            t = "\t ".join(w).replace("a", "A")
        elif i % 5 == 3:
            chain[rng.randrange(len(chain))] = f"drift{i}"
            t = " ".join(chain)
        rows.append((i, t, "en", "s", 0))
    rng.shuffle(rows)
    odd = [None, "", " \n", "one two", "one two", "ONE  two", "a b c d", "a b c", "É b c d e", "é b c d e", " ", "x" * 70_000, "x" * 70_000 + "y", "漢字 " * 50]
    return rows + [(8000 + i, t, None, None, None) for i, t in enumerate(odd)] + [(None, "only without id", None, None, None), (None, rows[0][1], None, None, None), rows[1], rows[1], rows[2]]


def found(spark, rows):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.minhash_dedup(spark, frame(spark, rows)).collect())


def plain(rows):
    out = Counter()
    for (i, n, c, k), m in components(rows).items():
        out[i, n, c, k or (i is None and c is None)] += m
    return out


def test_minhash_components_are_those_of_all_pairs(spark):
    rows = copies()
    assert found(spark, rows) == plain(rows)


def test_minhash_in_small_units_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "UNIT_DOCS", 4)
    monkeypatch.setattr(minhash_dedup, "UNIT_SHINGLES", 900)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = copies(11, 120)
    for i in range(90):  # one large group about the threshold, whose members are linked to some others only
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((20_000 + i, " ".join(w), "en", "hot", 0))
    assert found(spark, rows) == plain(rows)


def test_minhash_of_nothing(spark, empty):
    assert minhash_dedup.minhash_dedup(spark, empty).count() == 0


def test_every_coordinate_of_a_sketch_fills_and_tells_the_similarity():
    rng = np.random.default_rng(5)
    t = 72
    sizes = [0, 1, 2, 5, 60, 400, 5000]
    sets = [np.unique(rng.integers(1, 2**63, n).astype(np.uint64)) for n in sizes]
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sketch = minhash_dedup.fast_sketch(np.concatenate(sets), first, t)
    assert (sketch[0] == np.uint64(2**64 - 1)).all() and (sketch[1:] != np.uint64(2**64 - 1)).all()
    for k, s in enumerate(sets):  # alone as in a batch, in any order
        assert (minhash_dedup.fast_sketch(rng.permutation(s), np.array([0, len(s)]), t)[0] == sketch[k]).all()
    agree = []
    for _ in range(150):  # similarity 0.8: 80 of 100 in common
        x = np.unique(rng.integers(1, 2**63, 100).astype(np.uint64))
        a, b = x[:90], np.concatenate([x[:80], x[90:]])
        s = minhash_dedup.fast_sketch(np.concatenate([a, b]), np.array([0, 90, 180]), t)
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - 0.8) < 0.015
    assert np.std(agree) < 1.05 * (0.8 * 0.2 / t) ** 0.5  # no wider than independent draws


@pytest.mark.parametrize("part", [1, 3, 16, 1000])
def test_words_over_the_cut_of_a_part(monkeypatch, part):
    texts = ["", " ", "a", "one twO  three\nfour", "x" * 50 + " y", "é漢 😀" * 9, "  lead and trail  "]
    whole = [minhash_dedup.BlankWords(pa.array([t])) for t in texts]
    monkeypatch.setattr(minhash_dedup, "PART", part)
    for t, w in zip(texts, whole, strict=True):
        got = minhash_dedup.BlankWords(pa.array([t]))
        assert (got.hash == w.hash).all() and (got.first == w.first).all()


@pytest.mark.parametrize("name", ["op11_divergence", "op12_fill_middle", "op13_minhash_dedup"])
def test_queries_give_what_their_sql_gives(spark, sf, name):
    from compare import connection, same

    same(queries()[name](spark, sf).toPandas(), connection(sf).sql(oracle_sql()[name]).df())
