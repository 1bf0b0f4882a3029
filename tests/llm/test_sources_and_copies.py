"""Divergence, MinHash near-duplicates and centroid clustering against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from headway.llm import set_links
from headway.llm.centroids import full_scan, moved, op13_centroids
from headway.llm.divergence import divergences, op11_divergence, opponents
from headway.llm.minhash_dedup import op12_minhash_dedup
from headway.llm.set_links import THREE_WORDS_85, sketches

DOCS = "doc_id long, text string, lang string, source string, row string, node long, key long"


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def plain_divergence(docs, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= least)
        count = defaultdict(Counter)
        for _, source, terms in own:
            for where in ((source,), None):
                count[where].update(t for t in terms if t in set(kept))
            count[source,] += Counter()
        groups = sorted({(d[1],) for d in own})
        share = {g: {t: 1 + 10**9 * (count[g][t] + 2) // (sum(count[g].values()) + 2 * len(kept)) for t in kept} for g in [*groups, None]}
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        for g in groups:
            pairs = [(h[0], sum(gap(share[g][t], share[h][t]) for t in kept)) for h in groups if h != g]
            terms = [(t, gap(share[g][t], share[None][t])) for t in kept if count[g][t] and share[g][t] > share[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, g[0], part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("slice_terms, block_groups", [(32_768, 16), (5, 2), (3, 1)])
def test_divergence(spark, slice_terms, block_groups):
    rng, words = random.Random(3), ["Tee", "tee", "été", "Ünal", "x", "ß", "ÄÖ", "zug7zug", "a_b", "日本", "rot", "blau", "GRÜN", "o'er"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "ß", "s10", None]), " ".join(rng.choices(words[rng.randrange(9) :], k=rng.randrange(12)))) for _ in range(150)]
    rows += [("fr", "alone", "un deux"), ("fr", "other", None), ("it", "one", "tee"), *rows[:5]]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n long, term string")
    got = sorted(map(tuple, divergences(docs, 10, 3, slice_terms, block_groups).collect()))
    assert got == plain_divergence(rows, 10, 3)


def test_divergence_of_nothing(spark, tmp_path):
    assert op11_divergence(spark, put(spark, tmp_path, "documents", [], DOCS)).count() == 0


@pytest.mark.parametrize("blocks", [1, 2, 3, 8, 13])
def test_tournament(blocks):
    rounds = opponents(blocks)
    assert sorted(m for r in rounds for m in r) == [(i, j) for i in range(blocks) for j in range(i + 1, blocks)]
    assert all(len({b for m in r for b in m}) == 2 * len(r) for r in rounds)


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_set(text, words=3):
    w = plain_words(text)
    return {tuple(w)} if 0 < len(w) < words else {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}


def plain_groups(rows, words=3, percent=85):
    """Component number of each row; rows without words are alone."""
    sets = [plain_set(t, words) for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    return [root(k) for k in range(len(rows))], sets


def copies(rng, texts, most):
    """Near copies: words exchanged, cut and added, around the threshold."""
    out = []
    for t in texts:
        for _ in range(rng.randrange(1, most)):
            w = t.split(" ")
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"n{rng.random()}"
            if rng.random() < 0.5:
                w += [f"more{k}" for k in range(rng.randrange(len(w) // 6 + 1))]
            out.append(" ".join(w).replace("w", rng.choice("wW")))
    return out


@pytest.mark.parametrize("block, few, early, long", [(500, 16, 2, 2000), (3, 1, 0, 20), (4, 3, 1, 50)])
def test_minhash(spark, tmp_path, monkeypatch, block, few, early, long):
    """With the settings as they are, and with small ones, so that all ways are gone."""
    for name, value in (("BLOCK", block), ("FEW", few), ("EARLY_ROUNDS", early), ("LONG", long)):
        monkeypatch.setattr(set_links, name, value)
    rng = random.Random(7)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 4, 9, 30, 60, 120]))) for _ in range(25)]
    texts = [*base, *copies(rng, base, 5), *copies(rng, base[:1] * 3 + base[-3:], 15), "a b", "A  B", "a", "", " \n", None, "", "w1 " * 3000, "w1 " * 3000]
    rng.shuffle(texts)
    rows = [(None if k % 23 == 5 else k // 2 if k % 17 == 3 else k, t) for k, t in enumerate(texts)]
    rows += rows[:3] + [(rows[0][0], rows[1][1]), (None, rows[9][1])]
    path = put(spark, tmp_path, "documents", [(*r, "en", "s", "x", 1, 2) for r in rows], DOCS)
    groups, sets = plain_groups(rows)
    least = {}
    for (doc_id, _), g in zip(rows, groups, strict=True):
        least[g] = min((x for x in (least.get(g), doc_id) if x is not None), default=None)
    want = sorted(((d, len(s), least[g], d == least[g]) for (d, _), g, s in zip(rows, groups, sets, strict=True)), key=str)
    assert sorted(map(tuple, op12_minhash_dedup(spark, path).collect()), key=str) == want


def test_minhash_of_nothing(spark, tmp_path):
    assert op12_minhash_dedup(spark, put(spark, tmp_path, "documents", [], DOCS)).count() == 0
    path = put(spark, tmp_path, "documents", [(1, None, None, None, None, 1, 1), (2, "", None, None, None, 1, 1)], DOCS)
    assert sorted(map(tuple, op12_minhash_dedup(spark, path).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_sketches():
    """Every bin fills, whatever the size; bins agree as often as sets are similar, within a narrow band."""
    rng = np.random.default_rng(5)
    for size in (1, 2, 7, 50, 3000):
        pool = rng.integers(0, 1 << 63, size=size + size // 4 + 1).astype(np.uint64)
        a, b = pool[:size], pool[size // 10 :]
        s = sketches([a, b, a], 200)
        assert (s != np.iinfo(np.uint64).max).all() and (s[0] == s[2]).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 5 * math.sqrt(true * (1 - true) / 200 + 1e-9) + 1e-6


def plain_clusters(rows, clusters=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in first[:clusters]]
    square = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y, strict=True))
    for k in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda c: (square(v, centroids[c]), c)) for _, v in kept]
        for c in range(len(centroids)) if k < rounds else ():
            if mine := [v for (_, v), o in zip(kept, own, strict=True) if o == c]:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    gaps = [square(v, centroids[o]) for (_, v), o in zip(kept, own, strict=True)]
    sums = Counter()
    for o, g in zip(own, gaps, strict=True):
        sums[o] += g
    return [(i, o, g, sums[o], sum(gaps), hashlib.sha256(",".join(map(str, centroids[o])).encode()).hexdigest()) for (i, _), o, g in zip(kept, own, gaps, strict=True)]


@pytest.mark.parametrize("n, spread", [(0, 1.0), (3, 1.0), (16, 1.0), (300, 1.0), (200, 0.03), (120, 1e5)])
def test_centroids(spark, tmp_path, n, spread):
    rng = random.Random(n)
    rows = [(k, [rng.gauss(rng.choice([-1, 0, 1]) if j < 3 else 0, 1) * spread for j in range(64)]) for k in range(n)]
    rows += [(n, None), (n + 1, [1.0] * 63), (n + 2, [None] + [0.5] * 63), (n + 3, [float("nan")] + [0.5] * 63), (n + 4, [float("-inf")] + [0.5] * 63), (n + 5, [])]
    if n > 20:
        rows += rows[:4] + [(None, rows[5][1]), (rows[7][0], rows[8][1]), (2**60 + 1, rows[9][1])]
    path = put(spark, tmp_path, "embeddings", [(i, v, 1, 2, 3.0) for i, v in rows], "vec_id long, embedding array<double>, cluster long, vec int, upper double")
    assert sorted(map(tuple, op13_centroids(spark, path).collect()), key=str) == sorted(plain_clusters(rows), key=str)


def test_bounds_hold_and_spare_scans():
    """Bounded assignments equal full scans while centroids drift; once they settle, nearly no vector is scanned."""
    rng = np.random.default_rng(1)
    rows = rng.integers(-20, 20, size=(2000, 64)) + rng.integers(-300, 300, size=(12, 64))[rng.integers(0, 12, size=2000)]
    centroids = rows[:16].copy()
    own, upper, lower = full_scan(rows, centroids)
    for k in range(6):
        before, centroids = centroids, np.array([rows[own == c].sum(0) // max(1, (own == c).sum()) if (own == c).any() else centroids[c] for c in range(16)])
        own, upper, lower, scanned = moved(rows, own, upper, lower, before, centroids)
        assert (own == full_scan(rows, centroids)[0]).all()
    assert scanned < len(rows) / 2


def plans_of(monkeypatch, module) -> list[str]:
    """The plans of the tables that ``module`` writes from now on."""
    plans, write = [], module.written

    def noted(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        return write(df, *args, **kwargs)

    monkeypatch.setattr(module, "written", noted)
    return plans


def test_copies_meet_without_a_row_for_each_band_and_join(spark, tmp_path, monkeypatch):
    """A large group of near copies: rows of bands aren't sorted out by hot keys, and most keys are settled before all are looked at."""
    rng, plans, seen = random.Random(9), plans_of(monkeypatch, set_links), []
    last = set_links.across
    monkeypatch.setattr(set_links, "across", lambda *args: seen.append(last(*args)) or seen[-1])
    group = [" ".join(f"w{k}" if k != j else f"other{j}" for k in range(90)) for j in range(60)]
    rows = [(k, t, "en", "s", "x", 1, 2) for k, t in enumerate([*group, *(" ".join(f"u{rng.random()}" for _ in range(20)) for _ in range(30))])]
    found = {r.doc_id: r.component_id for r in op12_minhash_dedup(spark, put(spark, tmp_path, "documents", rows, DOCS)).collect()}
    assert found == {k: 0 if k < 60 else k for k in range(90)}
    assert plans and not any("LeftAnti" in p for p in plans)
    assert len(seen) == 1
