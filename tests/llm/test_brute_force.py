"""Corpus operators against brute force: random inputs, every kind of link and span, very long lines and texts."""

import collections
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from headway.llm import hamming_links, language_id, packing, quality_classifier, quality_rules, quote_threads, secret_scan, simhash_dedup, topk_search


def test_packing_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    tokenizer, mine = Tokenizer.from_file(packing.tokenizer_path()), packing.ChunkEncoder(packing.tokenizer_path())
    r = random.Random(6)
    pools = [[chr(c) for c in range(256)], list("abcZ09 '’\n\t-.,;!«»°éüß£§½²\x85\xa0\xad\x1c\x00"), list("ab'’“”€é\u0308 .\n\u200b İıſΣσς日本٣"), [*"a's'll'd're ve!?'", "'s", "'t"], [*"<|startoftext|> ab'", "<|endoftext|>"]]
    texts = ["".join(r.choice(p) for _ in range(r.randint(0, 25))) for p in (r.choice(pools) for _ in range(8000))]
    texts += ["«Bonjour.»", "«été»", "20-°C", "a.·b", "(£5)", "¿?", "!¡hola", "§1-§2"]
    for low in range(0, len(texts), 500):
        some = texts[low : low + 500]
        for text, got, want in zip(some, mine.encode(some), tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
            assert np.frombuffer(got, dtype="<u4").tolist() == want.ids, repr(text)


def test_packing_buckets(spark, tmp_path):
    pieces = packing.pack(spark.createDataFrame([(k, "word " * (k * 7 % 50)) for k in range(60)] + [(3, "word")], "doc_id long, text string")).cache()
    packing.write_buckets(pieces, f"{tmp_path}/buckets", 3)
    rows = pieces.collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.length == 1 << r.bucket and len(r.ids) == r.length for r in rows)
    assert [r.bucket for r in sorted(rows, key=lambda r: r.sequence_id)] == sorted(r.bucket for r in rows)
    back = spark.read.parquet(f"{tmp_path}/buckets").collect()
    assert sorted((r.sequence_id, r.bucket) for r in back) == sorted((r.sequence_id, r.bucket) for r in rows)


def test_navigation_lines(spark):
    whole = re.compile(r"^\s*[^|»›•>]{1,40}(?:\s[|»›•>]\s[^|»›•>]{1,40}){2,}\s*[|»›•>]?\s*$", re.A)
    r = random.Random(1)
    lines = ["".join(r.choice([" ", "a", "|", " | ", " > ", "home", "x" * 39, "\t"]) for _ in range(r.randint(0, 12))) for _ in range(3000)] + ["a | b | c |", " | ".join(["z" * 40] * 5), ""]
    rows = spark.createDataFrame(list(enumerate([*lines, "home page | " * 100_000])), "k long, line string")
    got = {x.k: x.f for x in rows.select("k", quality_rules.navigates(F.col("line")).alias("f")).collect()}
    assert [got[k] for k in range(len(lines))] == [bool(whole.match(x)) for x in lines] and got[len(lines)]


def test_rules_on_long_texts(spark):
    rows = [(1, "a b c\n\n\na b c\n =x\n=x\n\n"), (2, "home page | " * 100_000 + "\n" + "q w e r " * 5), (3, "x y\n" * 100_000)]
    out = {x.doc_id: x.rules for x in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1].n_dup_lines, out[1].n_repeat_words, out[1].cleaned) == (1, 6, "a b c\n\n\n =x\n=x\n\n")
    assert out[2].cleaned == "q w e r " * 5 and (out[3].n_dup_lines, out[3].n_repeat_words, out[3].cleaned) == (99_999, 200_000, "x y\n")


def secrets_of(text):
    """(start, kind, end) and the redacted text, by comparing all pairs of spans."""
    patterns = [(secret_scan.ASSIGN, 6), (secret_scan.ACCESS, 0), (secret_scan.HEX, 0), (secret_scan.WEAK_ACCESS, 0), (secret_scan.WEAK_SECRET, 0), (secret_scan.ENDPOINT, 0)]
    found = [[(m.start(), k, m.end()) for m in re.finditer(p, text) if not least or len(m[2]) >= least] for k, (p, least) in enumerate(patterns)]
    base = found[0] + found[1] + found[2]
    meets = lambda x, ys: any(x[0] < y[2] and y[0] < x[2] for y in ys)
    near = lambda x, ys: any(0 <= max(y[0] - x[2], x[0] - y[2]) <= 300 for y in ys)
    ids, weak = ([x for x in found[k] if not meets(x, base)] for k in (3, 4))
    ends = found[5] if base or found[3] or found[4] else []
    access, firm = found[1] + ids, found[0] + found[2]
    spans = base + [x for x in ids if near(x, firm + weak)] + [x for x in weak if near(x, access) or near(x, firm) and near(x, ends)]
    spans = sorted(spans + [x for x in ends if not meets(x, base) and near(x, access) and near(x, firm + weak)])
    at, out = 0, ""
    for start, kind, end in spans:
        if kind < 5:
            out += text[at:start] + "[secret]" if start >= at else ""
            at = max(at, end)
    return spans, out + text[at:]


def test_secrets_and_redaction(spark):
    r = random.Random(2)
    parts = ["password = hunter22", "AKIA" + "Q" * 16, "ASIA" + "B" * 12, "a1b2" * 7, "aB3" + "xY7/" * 10, "aB3" + "xY7/" * 40 + "==", "https://api.example.com/v1", "é日 ", "lorem ipsum " * 8, "\n", "token: AKIA" + "Z" * 18, " ", "x", "https://u.com/" + "ab12" * 9, "secret='" + "0f" * 14]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(0, 14))) if k % 2 else "".join(r.choice(parts) for _ in range(r.randint(0, 900 if k % 50 == 0 else 12))) for k in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {x.doc_id: [tuple(s) for s in x.spans] for x in secret_scan.scanned(docs).select("doc_id", "spans").collect()}
    cleared = {x.doc_id: x.text for x in secret_scan.redact(docs).collect()}
    assert {k for _, kinds in spans.items() for _, k, _ in kinds} == set(range(6))
    for k, text in enumerate(texts):
        assert (spans[k], cleared[k]) == secrets_of(text)


def test_many_secrets_in_a_text(spark):
    docs = spark.createDataFrame([(1, "password = hunter00001 ASIABBBBBBBBBBBB https://a.b/c \n" * 20_000)], "doc_id long, text string")
    assert secret_scan.scanned(docs).select(F.size("spans")).first()[0] == 60_000


def parsed_plainly(text):
    lines = text.split("\n")
    marks = [re.match(r"^[ \t>]*>", x) for x in lines]
    levels, bare = [m[0].count(">") if m else 0 for m in marks], [x[len(m[0]) :] if m else x for x, m in zip(lines, marks, strict=True)]
    introduces = re.compile(r"(?i)^\s*(?:on\b.{0,200}\bwrote|.{1,80}\bwrote)\s*:\s*$")
    own = "\n".join(x for i, x in enumerate(lines) if levels[i] == 0 and not (levels[i + 1 : i + 2] > [0] and introduces.match(x))).strip(" ") if any(levels) else text
    quotes, i = [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and levels[j] == levels[i]:
            j += 1
        if levels[i]:
            quotes.append((levels[i], "\n".join(bare[i:j])))
        i = j
    return own, quotes + [(1, x) for x in re.findall(quote_threads.INLINE, own)]


def test_quotes_meet_their_messages(spark):
    """Nested levels, quotes of lines, sentences and whole messages, from this and other conversations, ties, inline quotes."""
    r = random.Random(3)
    normal = lambda x: re.sub(r"[^\w]+|_", " ", x.lower()).strip()
    sentences = [f"Word{a} says number {b} of the day." for a in range(6) for b in range(5)]
    messages, of_conv, every = [], collections.defaultdict(list), []
    for c in range(25):
        for t in range(r.randint(1, 9)):
            body = "\n\n".join("\n".join(" ".join(r.choice(sentences) for _ in range(r.randint(1, 2))) for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 3)))
            text, pool = body, of_conv[c] if of_conv[c] and r.random() < 0.7 else every
            if pool and r.random() < 0.8:
                lines = r.choice(pool).split("\n")
                i, marks = r.randrange(len(lines)), r.choice([[1], [2], [1, 1, 2]])
                text = ("On Monday X wrote:\n" if r.random() < 0.5 else "") + "\n".join("> " * r.choice(marks) + x for x in lines[i : i + r.choice([1, 2, 3, 6, 8, 11])]) + "\n" + body
                text += "\nYou said “" + r.choice(sentences) + "” yes" if r.random() < 0.3 else ""
            messages.append((c, t, "user", text))
            of_conv[c].append(body)
            every.append(body)
    plain = [(c, t, *parsed_plainly(x)) for c, t, _, x in messages]
    units = {}
    for c, t, own, _ in plain:
        lines = own.split("\n")
        some = [own, *re.split(r"\n\s*\n", own), *re.split(quote_threads.SENTENCE, own), *("\n".join(lines[i : i + n]) for n in range(1, 5) for i in range(len(lines)))]
        full = [normal(x) for x in lines if normal(x)]
        units[c, t] = ({normal(x) for x in some} | {"\n".join(full[i:j]) for j in range(len(full) + 1) for i in range(j)}) - {""}
    want, linked = {}, 0
    for c, t, own, quotes in plain:
        links = []
        for k, (level, passage) in enumerate(quotes):
            forms = {normal(passage), "\n".join(normal(x) for x in passage.split("\n") if normal(x))} - {""}
            holders = [at for at in units if forms & units[at]]
            inside, high = min((x for x in holders if x[0] == c), default=None), max((x[0] for x in holders), default=None)
            if inside and inside[1] < t:
                links.append((level, k, *inside))
            elif holders:
                pick = min(holders) if min(holders)[0] != c else min(x for x in holders if x[0] == high)
                links += [(level, k, *pick)] if pick[0] != c else []
        want[c, t] = (own, len(quotes), len(links), *(min(links)[2:] if links else (None, None)))
        linked += len(links)
    assert linked > 50 and sum(p.count("\n") > 6 for _, _, _, quotes in plain for _, p in quotes) > 10
    docs = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    out = quote_threads.threads(docs).collect()
    assert {(x.conv_id, x.turn): (x.body, x.n_quotes, x.n_linked, x.reply_conv, x.reply_turn) for x in out} == want
    up = {(c, t): (w[4] if w[3] == c else None) for (c, t), w in want.items()}
    for x in out:
        depth, at = 0, x.turn
        while up[x.conv_id, at] is not None:
            depth, at = depth + 1, up[x.conv_id, at]
        assert (x.depth, x.thread_turn) == (depth, at)


def test_long_quotes(spark):
    rows = [(1, 0, "u", ">" * 20_000 + " x\ny"), (1, 1, "u", "> a line here\nb\n" * 50_000), (1, 2, "u", None)]
    out = {x.turn: x for x in quote_threads.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [out[k].n_quotes for k in range(3)] == [1, 50_000, 0] and out[0].body == "y"
    plain = [(1, 0, "u", "same words\n" * 20_000), (1, 1, "u", "> same words\n" * 9_000), (1, 2, "u", "> same words\n" * 20_001), (2, 0, "u", "a b\nc\n\nd e\nf\ng\nh i\nj\nk")]
    plain += [(2, 1, "u", "> c\n> d e\n> f\n>\n> g\n> h i"), (2, 2, "u", "> c\n> d e\n> f\n> g\n> h j"), (2, 3, "u", "I like “h i” most"), (2, 4, "u", "> c\n> d e f\n> g\n> h i\n> j")]
    out = {(x.conv_id, x.turn): x.reply_turn for x in quote_threads.threads(spark.createDataFrame(plain, "conv_id long, turn long, role string, text string")).collect()}
    assert out == {(1, 0): None, (1, 1): 0, (1, 2): None, (2, 0): None, (2, 1): 0, (2, 2): None, (2, 3): 0, (2, 4): None}


def test_fingerprints_and_components(spark, tmp_path):
    r = random.Random(9)
    texts = [" ".join(r.choice(["Alpha", "beta", "É", "gamma", "x1"]) for _ in range(r.randint(0, 9))) for _ in range(300)] + [None, "", " \t\n", "ÀB c\x0bd\x1ce f g"]
    texts += [" ".join(f"w{r.random()}" for _ in range(400)) for _ in range(3)]
    texts += [t.rsplit(" ", 1)[0] + " end" for t in texts[-3:]] * 2
    fps = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0)
    root = list(range(len(texts)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    spark.createDataFrame([*enumerate(texts), (5, texts[5])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = simhash_dedup.op9_simhash_dedup(spark, str(tmp_path)).collect()
    assert len(out) == len(texts) + 1 and {x.doc_id: (x.fingerprint, x.component_id) for x in out} == {k: (f"{fps[k]:016x}", root[k]) for k in range(len(texts))}


def test_fewer_groups_for_many_fingerprints(spark, monkeypatch):
    r = random.Random(5)
    base = [r.getrandbits(63) for _ in range(30)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(63), r.randint(0, 4))) for b in base for _ in range(8)})
    rows = spark.createDataFrame(list(enumerate(fps)), "node long, fp long")
    want = {x.node: x.component for x in simhash_dedup.connected_components(hamming_links.links(rows, 4, 4)).collect()}
    monkeypatch.setattr(hamming_links, "MANY", 10)
    assert {x.node: x.component for x in simhash_dedup.connected_components(hamming_links.links(rows, 4, 4)).collect()} == want and want


def test_languages_by_plain_counts():
    """Predictions against a loop over n-grams; 70 languages, so that slots have two words; texts without letters."""
    r = random.Random(4)
    owned = [np.unique(np.array([r.getrandbits(32) for _ in range(50)], dtype=np.uint64)) for _ in range(69)] + [np.unique(language_id.grams(language_id.folded(" the quick brown fox ")))]
    names = [f"l{k:02d}" for k in range(70)]
    filters = language_id.LanguageFilters.of(names, owned)
    texts = ["the quick fox", "brown", "the", "½ ² Ⅷ 12", "", None, "日本", "fox " * 5000]
    bits = [{s for o in own.tolist() for s in zip(range(2), (int(x[0]) for x in language_id.slots(np.array([o], dtype=np.uint64))), strict=True)} for own in owned]
    either = [{s for _, s in b} for b in bits]
    for text, (lang, score) in zip(texts, filters.predict(texts), strict=True):
        if not text or not any(map(str.isalpha, text)):
            assert (lang, score) == ("und", 0.0)
            continue
        data = bytes(language_id.folded(" " + text + " "))
        hits = [0] * 70
        windows = [data[i : i + 4] for i in range(len(data) - 3)]
        for w, times in collections.Counter(windows).items():
            at = [int(x[0]) for x in language_id.slots(np.array([int.from_bytes(w, "little")], dtype=np.uint64))]
            for k in range(70):
                hits[k] += times * all(s in either[k] for s in at)
        scores = [max(0.0, h - len(windows) * f) / (1 - f) for h, f in zip(hits, filters.false_rate, strict=True)]
        assert lang == names[int(np.argmax(scores))]


def test_trees_by_plain_walk():
    x = np.random.default_rng(0).normal(size=(400, 4))
    x[:50] = x[0]  # ties
    forest = quality_classifier.fit_forest(x, (x[:, 1] * x[:, 2] > 0.1).astype(float))
    for row, score in zip(x, forest.scores(x), strict=True):
        raw = forest.base
        for root in forest.roots.tolist():
            at = root
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.cut[at] else forest.right[at]
            raw += forest.value[at]
        assert abs(score - 1 / (1 + np.exp(-raw))) < 1e-12


def test_top_k_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CANDIDATES", 300)
    rows = np.random.default_rng(2).integers(-9, 9, (1500, 6))
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)] + [(9000, [1, 2]), (9001, [3, 4])], "id long, vec array<long>")
    out = topk_search.top_k(vectors, vectors.where("id % 100 = 0")).toPandas()
    for q, got in out.groupby("query_id"):
        want = sorted((-int(rows[q] @ v), k) for k, v in enumerate(rows) if k != q)[:10] if q < 9000 else [(-11, 9001)]
        assert [(-x.score, x.vec_id) for x in got.sort_values("rank").itertuples()] == want
    assert out["query_id"].nunique() == 16


def test_language_filters_against_plain_counts(spark):
    """The bits of the filters from plain counts of all n-grams; a language of one short text is learned too."""
    from collections import Counter

    r = random.Random(12)
    words = {"en": ["the", "of", "and", "house", "river"], "tr": ["ve", "bir", "için", "ağaç", "river"], "zolkur": ["qozz"]}
    rows = [(k, " ".join(r.choice(words[lang]) for _ in range(r.randint(0, 12))), lang) for k, lang in enumerate(r.choice(["en", "tr"]) for _ in range(60))]
    rows += [(100, "Qozz!", "zolkur"), (101, "nobody's", None), (102, None, "nought"), (103, "", "en"), (3, "the the", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    got = language_id.fit(docs)
    counts = {}
    for lang in words:
        data = b"    " + b"    ".join(bytes(language_id.folded(t)) for _, t, of in rows if of == lang and t is not None) + b"    "
        counts[lang] = Counter(data[k : k + 4] for k in range(len(data) - 3))
    rates = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    assert got.languages == sorted(words)
    want = np.zeros_like(got.slots)
    for number, lang in enumerate(got.languages):
        for g, rate in rates[lang].items():
            if rate >= language_id.LEAST_RATE and rate >= language_id.LEAST_SHARE * max(x.get(g, 0) for x in rates.values()):
                for s in language_id.slots(np.array([int.from_bytes(g, "little")], dtype=np.uint64)):
                    want[0, int(s[0])] |= np.uint64(1 << number)
    assert (got.slots == want).all()
    assert got.predict(["a qozz here", "the house", "için ağaç", "12"])[0][0] == "zolkur"
