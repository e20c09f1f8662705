"""Publishing against a replay of every run; class scoping against plain arithmetic."""

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from specmill.operators import publish as P
from specmill.operators import scoping as S

OBS = "product_id long, field string, value string, provenance string, run int"


def rank(s):
    return P.PRECEDENCE.index(s) + 1 if s in P.PRECEDENCE else 7


def best(rows):
    out = {}
    for p, f, v, s in rows:
        if v is not None:
            out[p, f] = min(out.get((p, f), (9, "", "")), (rank(s), v, s), key=lambda x: (x[0], x[1], x[2] or ""))
    return {k: (v, s) for k, (_, v, s) in out.items()}


def replay(live, staged):
    out = dict(live)
    for k, (v, s) in best(staged).items():
        if k not in out or rank(s) <= rank(out[k][1]):
            out[k] = v, s
    return out


def observed(seed=1, n=900):
    rng = random.Random(seed)
    rows = [(rng.randrange(12), rng.choice("abc"), rng.choice(["1", "2", "3", None]), rng.choices([*P.PRECEDENCE, "rumour", None], [1, 3, 3, 3, 4, 6, 1, 1])[0], rng.randrange(15)) for _ in range(n)]
    return rows + rows[:40] + [(99, "a", None, "human", 3)]


def test_history_is_a_replay_of_the_runs(spark):
    rows = observed()
    cells = P.history(spark.createDataFrame(rows, OBS)).cache()
    live = {}
    for run in range(-1, 16):
        live = replay(live, [r[:4] for r in rows if r[4] == run])
        got = P.state_at(cells, F.lit(run)).collect()
        assert {(r.product_id, r.field): (r.value, r.provenance) for r in got} == live and len(got) == len(live)
    # intervals of a cell touch, and each changes something
    by_cell = defaultdict(list)
    for r in sorted(cells.collect(), key=lambda r: r.valid_from):
        by_cell[r.product_id, r.field].append(r)
    for each in by_cell.values():
        assert each[-1].valid_to is None
        assert all(a.valid_to == b.valid_from and (a.value, a.provenance) != (b.value, b.provenance) for a, b in zip(each, each[1:], strict=False))


def test_diff_and_publish_are_those_of_one_run(spark):
    rows = observed(2)
    old, new = [r[:4] for r in rows if r[4] < 7], [r[:4] for r in rows if r[4] >= 7 and r[0] % 5] + [(50, "a", "9", "feed"), (50, "b", "8", None)]
    frame = lambda x: spark.createDataFrame(x, OBS.rsplit(",", 1)[0])
    live = best(old)
    after = {(r.product_id, r.field): (r.value, r.provenance) for r in P.publish(frame(old), frame(new)).collect()}
    assert after == replay(live, new)
    known, seen, wanted = {p for p, _ in live}, {p for p, _ in best(new)}, Counter()
    for (p, f), (v, s) in best(new).items():
        ov, os = live.get((p, f), (None, None))
        if v != ov:
            weaker = os is not None and rank(s) > rank(os)
            change = "new" if p not in known else "conflict_with_verified" if weaker and os == "human" else "field_changed"
            wanted[p, change, f, ov, v, not weaker] += 1
    wanted.update((p, "disappeared", None, None, None, False) for p in known - seen)
    assert Counter(tuple(r) for r in P.field_diff(frame(old), frame(new)).collect()) == wanted
    assert {r[1] for r in wanted} == {"new", "field_changed", "conflict_with_verified", "disappeared"}


def test_as_of_takes_the_last_change(spark):
    rows = observed(3)
    cells = P.history(spark.createDataFrame(rows, OBS))
    asked = [(p, t, f"{p}/{t}") for p in (*range(12), 77) for t in (-1, 0, 4, 4, 9, 20)]
    got = P.as_of(spark.createDataFrame(asked, "product_id long, at int, note string"), cells, "a").collect()
    live, at = {}, {}
    for run in range(-1, 21):
        live = replay(live, [r[:4] for r in rows if r[4] == run])
        at[run] = dict(live)
    assert Counter(tuple(r) for r in got) == Counter((p, t, n, *at[t].get((p, "a"), (None, None))) for p, t, n in asked)


def test_nothing_to_publish(spark):
    none = spark.createDataFrame([], OBS)
    assert P.history(none).count() == P.field_diff(none, none).count() == P.publish(none, none).count() == 0


def test_nearest_classes(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.choice(["x", "y", "z", None]), [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [(100, "x", None), (101, "y", [1.0, 2.0]), (102, "z", [float("nan")] * 5), (103, None, [0.0] * 5), (104, "w", [1.0, 0.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "id long, class_id string, v array<double>")
    means = S.centroids(frame, 5)
    good = {i: (c, [round(x * S.GRID) for x in v]) for i, c, v in rows if v and len(v) == 5 and all(map(math.isfinite, v))}
    mean = {}
    for c in "wxyz":
        own = [g for k, g in good.values() if k == c]
        mean[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    assert {r.class_id: r.centroid for r in means.collect()} == mean
    size = lambda a: math.sqrt(sum(x * x for x in a))
    for most in (S.MOST_NUMBERS, 10):  # one part, and two classes a part
        monkeypatch.setattr(S, "MOST_NUMBERS", most)
        got = defaultdict(list)
        for r in sorted(S.nearest_classes(frame.select("id", "v"), means, 5).collect(), key=lambda r: r["rank"]):
            got[r.id].append((r.class_id, r.score, r.margin))
        for i, (_, g) in good.items():
            scores = sorted(((-(sum(map(lambda a, b: a * b, g, m)) / (size(g) * size(m)) if size(g) else 0.0), c) for c, m in mean.items()))
            assert [c for c, _, _ in got[i]] == [c for _, c in scores[:3]]
            assert all(abs(s + w) < 1e-12 for (_, s, _), (w, _) in zip(got[i], scores, strict=False))
            assert all(abs(m - (b[0] - a[0])) < 1e-12 for (_, _, m), a, b in zip(got[i], scores, scores[1:], strict=False))
        assert set(got) == set(good)


def test_the_longest_alias_wins(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = ["red", "reds", "circuit", "breaker", "the", "Ü1", "漢字"]
    aliases = [(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 3))), rng.choice("AB")) for _ in range(25)] + [("", "A"), (None, "A"), ("--", "B")]
    texts = [(i, rng.choice([" ", "-", ", "]).join(rng.choice(vocabulary).upper() if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randint(0, 9)))) for i in range(80)] + [(200, None), (201, "")]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))) + " "
    targets = defaultdict(set)
    for a, t in aliases:
        if len(plain(a)) > 2:
            targets[plain(a)].add(t)
    wanted = set()
    for i, t in texts:
        hits = [(-len(a), plain(t).index(a), a) for a in targets if a in plain(t)]
        if hits:
            _, start, a = min(hits)
            wanted.add((i, a.strip(), start, min(targets[a]), len(targets[a])))
    for most in (100_000, 6):
        monkeypatch.setattr(S, "MOST_ALIASES", most)
        got = S.alias_lookup(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(aliases, "alias string, target string"))
        assert {tuple(r) for r in got.collect()} == wanted
    assert S.alias_lookup(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([], "alias string, target string")).count() == 0


def test_scoping_goes_by_alias_then_by_margin(spark):
    named = spark.createDataFrame([(1, "A"), (2, "B")], "id long, target string")
    ranked = spark.createDataFrame([(2, 1, "C", 0.9, 0.5), (3, 1, "C", 0.9, 0.2), (3, 2, "D", 0.7, 0.1), (4, 1, "D", 0.5, 0.01), (5, 1, "D", 0.5, None)], "id long, rank int, class_id string, score double, margin double")
    got = {r.id: (r.class_id, r.how) for r in S.scoped(named, ranked, 0.1).collect()}
    assert got == {1: ("A", "alias"), 2: ("B", "alias"), 3: ("C", "centroid"), 4: (None, "class_uncertain"), 5: ("D", "centroid")}
