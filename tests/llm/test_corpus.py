"""Corpus operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, no rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from headway.llm import hamming_links, language_id, packing, piece_codec, quality_classifier, quality_rules, quote_threads, secret_scan, shared, simhash_dedup, suffix_dedup, topk_search
from headway.llm.queries import QUERIES
from headway.llm.shared import connected_components

TABLES = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "embeddings": "vec_id long, embedding array<float>, label int", "labels": "doc_id long, quality int, toxic int", "conversations": "conv_id long, turn long, role string, text string"}


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abdeilmnorstuéß") for _ in range(r.randint(2, 8))) for _ in range(n))


TEXTS = {
    1: prose(1, 120), 2: prose(1, 120), 3: prose(1, 60) + " " + prose(2, 60), 4: None, 5: "", 6: " \n\t", 7: prose(3, 120) + "\n" + "password = 'abcdef12' AKIA" + "Q" * 16 + " " + "a" * 25,
    8: "x" * 5000, 9: prose(4, 3), 10: prose(1, 118) + " other end", 11: prose(5, 5000),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(d, t, "xx" if d % 2 else "yy", "s", len(t or "")) for d, t in TEXTS.items()]
    spark.createDataFrame(rows, TABLES["documents"]).write.parquet(f"{at}/documents.parquet")
    vectors = [(i, [float(((i * 7 + k * 3) % 11) - 5) / 8 for k in range(4)], 0) for i in range(0, 230)] + [(500, None, 0), (600, [1.0, float("nan"), 0.0, 0.0], 0), (None, [1.0] * 4, 0), (700, [0.0] * 4, 0)]
    spark.createDataFrame(vectors, TABLES["embeddings"]).write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(d, d % 2, 0) for d in TEXTS] + [(None, 1, 0), (3, None, 0)], TABLES["labels"]).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", "Hello there"), (1, 1, "assistant", "> Hello  there\nHi"), (None, None, None, None), (1, 1, "assistant", "> Hello  there\nHi")], TABLES["conversations"]).write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_pipeline_on_empty_and_small_tables(spark, empty, folder):
    assert corpus_pipeline.run(spark, empty).count() == 0
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert set(out["doc_id"]) == {1, 3, 7, 11}  # 2 and 10 are copies of 1; the others have too few words


def test_packing(spark, folder):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    out = QUERIES["op6_packing"](spark, folder).toPandas()
    assert out["sequence_id"].is_unique and (out["offset"] == 0).all()
    for d, pieces in out.groupby("doc_id"):
        ids, at = np.array([*tokenizer.encode(TEXTS[d] or "", add_special_tokens=False).ids, 2], dtype="<u4"), 0
        for p in pieces.sort_values("start").itertuples():
            assert (p.start, p.ids_crc32, p.doc_tokens) == (at, zlib.crc32(ids[at : at + p.length].tobytes()), len(ids)) and p.length & (p.length - 1) == 0 and p.length <= 4096
            at += p.length
        assert at == len(ids)


def test_secrets(spark, folder):
    out = {r.doc_id: r for r in QUERIES["op5_secret_scan"](spark, folder).collect()}
    kinds = {"assign": re.compile(secret_scan.ASSIGN), "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    for d, t in TEXTS.items():
        found = []
        for k, (kind, p) in enumerate(kinds.items()):
            found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in p.finditer(t or "") if len(m[2] if k == 0 else m[0]) >= (6, 20, 24)[k]]
        base = ",".join(x[2] for x in sorted(found))
        assert out[d].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and out[d].n_assign == base.count("assign")
    near = "key ASIA" + "B" * 12 + " and aB3" + "xY7/" * 10 + " at https://api.example.com/v1"
    far = "aB3" + "xY7/" * 10 + " alone"
    docs = spark.createDataFrame([(1, near), (2, far), (3, None)], "doc_id long, text string")
    spans = {r.doc_id: r.s for r in secret_scan.scanned(docs).select("doc_id", secret_scan.listed("spans").alias("s")).collect()}
    assert [x.split(":")[0] for x in spans[1].split(",")] == ["weak_access", "weak_secret", "endpoint"] and spans[2] == spans[3] == ""
    assert secret_scan.redact(docs).orderBy("doc_id").collect()[0].text == "key [secret] and [secret] at https://api.example.com/v1"


def test_quality_rules(spark, folder):
    for r in QUERIES["op8_quality_rules"](spark, folder).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", TEXTS[r.doc_id] or "")
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        again = {i + k for i, x in enumerate(windows) if collections.Counter(windows)[x] > 1 for k in range(3)} if len(w) < 1000 else set()
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(again)) and r.kept == (r.doc_id in (1, 2, 3, 7, 10, 11))


def test_suffix_dedup(spark, folder):
    seen, want = set(), {}
    for d in sorted(TEXTS):
        b = (TEXTS[d] or "").encode()
        gone = np.zeros(len(b) + 1, dtype=int)
        for s in range(len(b) - 99):
            x = b[s : s + 100]
            if x in seen:
                gone[s] += 1
                gone[s + 100] -= 1
            seen.add(x)
        cover = np.cumsum(gone)[: len(b)] > 0
        want[d] = (len(b), int(cover.sum()), hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~cover].tobytes()).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in QUERIES["op10_suffix_dedup"](spark, folder).collect()} == want


def test_suffix_sort():
    rows = np.random.default_rng(0).integers(0, 2, (300, 20), dtype=np.uint8)
    size = np.random.default_rng(1).integers(0, 21, 300)
    order, shared = suffix_dedup.suffix_sort(rows, size)
    texts = [rows[k, : size[k]].tobytes() for k in order]
    assert texts == sorted(texts)
    assert all(shared[k] == next((i for i, (x, y) in enumerate(zip(texts[k - 1], texts[k], strict=False)) if x != y), min(len(texts[k - 1]), len(texts[k]))) for k in range(1, 300))


def test_simhash(spark, folder):
    out = {r.doc_id: r for r in QUERIES["op9_simhash_dedup"](spark, folder).collect()}
    assert out[4].fingerprint == out[5].fingerprint == out[6].fingerprint == "0" * 16 and out[6].component_id == 4
    assert out[1].fingerprint == out[2].fingerprint and out[2].component_id == 1


def test_links_are_exact(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(15)})
    rows = [(k, f - (1 << 64) if f >= 1 << 63 else f) for k, f in enumerate(fps)]
    for tau, parts in ((4, 4), (8, 5)):
        found = connected_components(hamming_links.links(spark.createDataFrame(rows, "node long, fp long"), tau, parts))
        root = list(range(len(fps)))
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= tau and root[i] != root[j]:
                    a, b = sorted((root[i], root[j]))
                    root = [a if x == b else x for x in root]
        assert {x.node: x.component for x in found.collect()} == {k: c for k, c in enumerate(root) if root.count(c) > 1}


def test_near_duplicates_are_exact(spark):
    """Every pair of 0.8 or more, whatever the edit; among them are pairs beyond the bits of the word fingerprints."""
    r, rows = random.Random(11), []
    common = [f"c{k}" for k in range(40)]

    def fresh(n):
        return [f"w{r.getrandbits(40):x}" for _ in range(n)]

    for n in (30, 60, 100, 184, 500):
        for share in (0.04, 0.1, 0.15, 0.2, 0.25):
            for _ in range(4):
                words, k = fresh(n), max(1, int(n * share))
                at = r.randrange(n)
                spot = r.randrange(n - 4)
                for copy in (words, words + fresh(k), words[:at] + fresh(k) + words[at:], words[k:], words[:spot] + fresh(1) + words[spot + 1 :], words + common):
                    rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, "  ", "a b", "A  b", "a b c", " ".join(common), " ".join(common[:37])])]
    sets = [set(simhash_dedup.shingle_hashes(t, 5).tolist()) for _, t in rows]
    holders, links, beyond = collections.defaultdict(list), [], 0
    for d, s in enumerate(sets):
        for h in s:
            holders[h].append(d)
    fps = [simhash_dedup.majority(np.array([simhash_dedup.xxhash.xxh64_intdigest(w, 42) for w in set(simhash_dedup.normal_words(t))], dtype=np.uint64)) for _, t in rows]
    for i, s in enumerate(sets):
        for j in sorted({j for h in s for j in holders[h] if j > i}):
            common_n = len(s & sets[j])
            if common_n >= 0.8 * (len(s) + len(sets[j]) - common_n):
                links.append((i, j))
                beyond += ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() > simhash_dedup.WORD_TAU
    empty = [d for d, t in rows if not t]
    links += [(empty[0], d) for d in empty[1:]]
    want = list(range(len(rows)))
    for i, j in links:
        a, b = sorted((want[i], want[j]))
        want = [a if x == b else x for x in want]
    assert beyond > 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.id: x for x in simhash_dedup.near_duplicates(docs).collect()}
    first = {}
    for d in range(len(rows)):
        first.setdefault(found[d].component, d)
    assert {d: first[x.component] for d, x in found.items()} == dict(enumerate(want))
    assert {d for d, x in found.items() if x.stays} == set(want)


def test_each_text_of_an_id_is_judged(spark):
    """Null and repeated ids, repeated rows, two texts under one id: of each group of texts one row stays, clean ones do."""
    near = prose(1, 80).rsplit(" ", 1)[0] + " end"
    rows = [(1, prose(1, 80)), (1, prose(1, 80)), (None, prose(1, 80)), (None, prose(1, 80)), (2, near), (3, near), (1, prose(2, 80)), (7, prose(3, 80)), (7, near), (7, prose(3, 80))]
    rows += [(None, prose(4, 80)), (None, prose(4, 80)), (9, ""), (8, None), (None, ""), (4, prose(5, 80)), (4, prose(6, 80))]
    docs = spark.createDataFrame([(i, t, "en", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, digest int")
    got = sorted(((r.doc_id, r.text) for r in simhash_dedup.keep_one_of_each_group(docs).collect()), key=str)
    want = [(1, prose(1, 80)), (1, prose(2, 80)), (7, prose(3, 80)), (None, prose(4, 80)), (8, None), (4, prose(5, 80)), (4, prose(6, 80))]
    assert got == sorted(want, key=str)


def test_top_k(spark, folder):
    rows = {i: np.floor(1024 * np.array([float(((i * 7 + k * 3) % 11) - 5) / 8 for k in range(4)])).astype(int) for i in range(230)} | {700: np.zeros(4, dtype=int)}
    out = QUERIES["op2_topk_search"](spark, folder).toPandas()
    assert set(out["query_id"]) == {0, 100, 200, 700}
    for q, got in out.groupby("query_id"):
        want = sorted(((-int(rows[q] @ v), i) for i, v in rows.items() if i != q))[:10]
        assert [(-r.score, r.vec_id) for r in got.sort_values("rank").itertuples()] == want


def test_piece_codec():
    c = piece_codec.codec(piece_codec.model_path())
    for t in ["", " ", "a▁b", "Hello  world\n", "x\0y", "日本😀", "ab" * 400, "é" * 90, "\x01" * 70 + "the", prose(9, 50)]:
        ids = np.frombuffer(c.encode(t), dtype="<u4").tolist()
        assert c.decode(ids) == t
    long = "interna" * 60  # far longer than the window
    best = [(0.0, [])] + [None] * len(long)
    for e in range(1, len(long) + 1):
        for s in range(max(0, e - c.longest), e):
            if best[s] and long[s:e] in c.scores and (best[e] is None or best[s][0] + c.scores[long[s:e]][1] > best[e][0]):
                best[e] = (best[s][0] + c.scores[long[s:e]][1], [*best[s][1], c.scores[long[s:e]][0]])
    assert c.segment(long).tolist() == best[-1][1]


def test_classifiers(spark, folder):
    for name, column in (("op1_language_id", "lang_pred"), ("op7_quality_classifier", "predicted")):
        out = QUERIES[name](spark, folder).toPandas()
        assert len(out) == len(TEXTS) and out["score"].between(0, 1).all() and out[column].notna().all()
    filters = language_id.LanguageFilters.of(["a", "b"], [language_id.grams(language_id.folded(" the the ")), language_id.grams(language_id.folded(" und und "))])
    assert [x[0] for x in filters.predict(["the the", "und!", None, "12 3", ""])] == ["a", "b", "und", "und", "und"]
    x = np.random.default_rng(0).normal(size=(500, 3))
    forest = quality_classifier.fit_forest(x, (x[:, 1] > 0.3).astype(float))
    assert ((forest.scores(x) > 0.5) == (x[:, 1] > 0.3)).mean() > 0.98


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op1_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.97
    out = QUERIES["op7_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (out["quality"] == out["predicted"]).mean() > 0.95


def test_threads(spark, folder):
    out = QUERIES["op4_quote_threads"](spark, folder).collect()
    assert len(out) == 4
    assert {(r.turn, r.body, r.reply_turn, r.depth) for r in out if r.conv_id} == {(0, "Hello there", None, 0), (1, "Hi", 0, 1)}


def test_clashing_columns(spark):
    rows = [(1, prose(1, 80), "a", 1, 2, 3), (2, prose(1, 80), "b", 1, 2, 3), (3, None, "c", 1, 2, 3), (None, prose(2, 80), "d", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rules string, id long, spans long, row long")
    for step, n in ((quality_rules.keep_good, 3), (simhash_dedup.keep_one_of_each_group, 3), (suffix_dedup.remove_repeats, 4), (secret_scan.redact, 4)):
        out = step(docs)
        assert out.columns == docs.columns
        got = out.collect()
        assert len(got) == n and {(r.rules, r.id, r.spans, r.row) for r in got} <= {(x, 1, 2, 3) for x in "abcd"}


def test_texts_are_shuffled_once_where_no_row_repeats(spark):
    """What goes is left out in one join; the second one, for repeated rows, is made only if there are any."""
    near = prose(1, 80).rsplit(" ", 1)[0] + " end"
    rows = [(1, prose(1, 80)), (2, near), (3, prose(2, 80)), (4, prose(2, 80)), (5, None)]
    joins = lambda df: df._jdf.queryExecution().analyzed().toString().count("Join Left")
    once = simhash_dedup.keep_one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"))
    again = simhash_dedup.keep_one_of_each_group(spark.createDataFrame([*rows, rows[2]], "doc_id long, text string"))
    assert sorted(r.doc_id for r in once.collect()) == sorted(r.doc_id for r in again.collect()) == [1, 3, 5]
    assert (joins(once), joins(again)) == (1, 2)


def test_pieces_are_made_over_arrow(spark):
    """Pieces and ids of many lengths, against plain cuts; no Python row for each piece."""
    from headway.llm import packing

    rows = [(None if k == 7 else k, None if k == 5 else "word " * (k * 37 % 190)) for k in range(90)] + [(3, "word")]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), sequence=64)
    assert "InArrow" in found._jdf.queryExecution().analyzed().toString()
    pieces = found.collect()
    want, at, filled = [], 0, collections.Counter()
    for doc_id, text in rows:
        total, start = len((text or "").split()) + 1, 0
        while start < total:
            n = min(64, 1 << (total - start).bit_length() - 1)
            p = pieces[at]
            want.append((doc_id, start, n, zlib.crc32(np.array(p.ids, dtype="<u4").tobytes()), total, n.bit_length() - 1 << 58 | filled[n], 0, n.bit_length() - 1, filled[n]))
            assert len(p.ids) == n and (p.ids[-1] == packing.END_ID) == (start + n == total)
            at, start, filled[n] = at + 1, start + n, filled[n] + 1
    assert [tuple(p)[:9] for p in pieces] == want


def shuffled(spark, run) -> tuple[list, int]:
    """The rows of ``run()``, and the bytes that it shuffles without broadcast joins, as on large tables."""
    written = lambda: sum(x.totalShuffleWrite() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    joined, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return sorted(tuple(r) for r in run().collect()), written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joined)


def random_words(rng, n):
    return " ".join(f"{rng.getrandbits(64):x}" for _ in range(n))


def test_near_dedup_shuffles_few_texts(spark):
    """Only texts that have candidates, or may go, are shuffled."""
    rng = random.Random(3)
    texts = [random_words(rng, 3000) for _ in range(100)]
    rows = [(k, t) for k, t in enumerate([*texts, f"{texts[0]} more", texts[1]])]
    docs = spark.createDataFrame([*rows, rows[50]], "doc_id long, text string")
    got, moved = shuffled(spark, lambda: simhash_dedup.keep_one_of_each_group(docs))
    assert got == rows[:100]
    assert 0 < moved < sum(len(t) for _, t in rows)


def test_suffix_dedup_shuffles_rows_with_spans_alone(spark):
    """The other columns of a row show it: those of rows without spans stay where they are."""
    rng = random.Random(4)
    rows = [(k, random_words(rng, 40), random_words(rng, 3000)) for k in range(100)]
    rows += [(100, f"{rows[0][1]} end", rows[0][2]), (None, None, rows[1][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other string")
    got, moved = shuffled(spark, lambda: suffix_dedup.remove_repeats(docs).selectExpr("coalesce(doc_id, -1)", "text", "other"))
    assert got == [(-1, None, rows[1][2]), *rows[:100], (100, " end", rows[0][2])]
    assert 0 < moved < sum(len(x) for _, _, x in rows) / 2


def test_flagged_rows_are_all_that_meet(spark):
    rows, keys = spark.range(20_000).selectExpr("id key", "id % 7 other"), spark.range(0, 20_000, 10).selectExpr("id key")
    found = shared.flagged(rows, keys, "key").where("maybe").select("key")
    assert keys.exceptAll(found).isEmpty()
    assert 2_000 <= found.count() < 2_900
    assert shared.flagged(rows, keys.limit(0), "key").where("maybe").isEmpty()
