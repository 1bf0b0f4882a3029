"""Links between documents whose sets of word shingles are similar: fast similarity sketches, bands, exact verification.

A sketch has ``coordinates`` bins. In each round every shingle is placed in one hashed bin with a hashed value; values of later
rounds are larger, and a bin keeps its least one. After as many rounds as bins, round j places all shingles in bin j. So
every bin fills, two sets agree in a bin with a probability that is their similarity, and, as a round places without
replacement, the share of bins that agree is concentrated at least as well as for independent hashes. Rounds stop when
all bins of a document are full.

Sets that share a band of ``rows`` bins are candidates. With similarity s a pair shares none of the b bands with the
probability (1 - s^rows)^b; the two settings below keep that under 1e-10 at their least similarity. Candidates are
verified on the full sets of shingles, byte by byte.

A band that many documents share isn't expanded into its pairs. In each of a few rounds, every document that shares a band
with another component than its own meets one partner: an end of the band in a hashed order, that of most of its bands.
Links found join components, so a group of copies costs about one comparison a document. Then all pairs that still share a
band across components are compared: of bands with few documents as pairs, of others within cells of two blocks of
documents, which only links leave."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.shared import connected_components, partitions, written

SEED = 42
#: Documents of a band, or partners of a document, that meet in one task.
BLOCK = 500
#: Rounds with one partner a document, before all pairs.
EARLY_ROUNDS = 2
#: A round with one partner looks at one in so many of the keys.
SHARE = 4
#: Keys of so many rows give their pairs; the rows of larger ones meet in cells. Sets of more shingles than LONG are held as arrays.
FEW, LONG = 16, 2000
#: Shingles placed at once.
PLACED = 1_000_000


class Rule(NamedTuple):
    """Link if 100 * intersection >= percent * union of the sets of ``words``-word shingles; bands of the sketch."""

    words: int
    percent: int
    rows: int
    bands: int


#: 0.85: (1 - 0.85^5)^40 = 7e-11; 0.8: (1 - 0.8^5)^60 = 5e-11.
THREE_WORDS_85, FIVE_WORDS_80 = Rule(3, 85, 5, 40), Rule(5, 80, 5, 60)


def normal_words(text: str | None) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` as UTF-8, A-Z lower-cased; bytes.lower and bytes.split know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None, words: int) -> list[bytes]:
    """All shingles, repeats included; a shorter text is one shingle, one without words none."""
    w = normal_words(text)
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    joined, ends = b" ".join(w), np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return [joined[s:e] for s, e in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def distinct_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each distinct shingle."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(x, SEED) for x in shingles(text, words)], dtype=np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketches(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """[set, bin]: the sketches of non-empty sets of hashes, all filled in the same rounds. A value is round, then 32 hashed bits."""
    low = np.uint64(0xFFFFFFFF)
    out = np.full((len(sets), coordinates), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat, values = out.ravel(), np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for turn in range(2 * coordinates):
        if not len(values):
            break
        h = mixed(values + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        place = ((h >> np.uint64(32)) * np.uint64(coordinates) >> np.uint64(32)).astype(np.int64) if turn < coordinates else np.int64(turn - coordinates)
        np.minimum.at(flat, of * coordinates + place, np.uint64(turn << 32) | (h & low))
        there = np.unique(of)
        full = np.zeros(len(sets), dtype=bool)
        full[there] = out[there].max(1) != np.iinfo(np.uint64).max
        if full.any():
            values, of = values[~full[of]], of[~full[of]]
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """[set, band]: a key of each band's values and its number."""
    bands = sketch.shape[1] // rows
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sketch), bands))
    for k in range(rows):
        key = mixed(key ^ sketch[:, k::rows])
    return key.view(np.int64)


def sketch_of(rule: Rule):
    """UDF of a text: number of its distinct shingles and the keys of its bands (none without words)."""

    @F.pandas_udf("size long, bands array<long>")
    def of(text: pd.Series) -> pd.DataFrame:
        sizes, keys, at = np.zeros(len(text), dtype=np.int64), [np.zeros(0, dtype=np.int64)] * len(text), []
        held = []

        def fill():
            for k, row in zip(at, band_keys(sketches(held, rule.rows * rule.bands), rule.rows), strict=True):
                keys[k] = row
            at.clear()
            held.clear()

        total = 0
        for k, t in enumerate(text):
            h = distinct_hashes(t, rule.words)
            sizes[k] = len(h)
            if len(h):
                at.append(k)
                held.append(h)
                total += len(h)
            if total > PLACED:
                fill()
                total = 0
        if held:
            fill()
        return pd.DataFrame({"size": sizes, "bands": keys})

    return of


def verified(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Those of the ``pairs`` (a, b) that link by the full sets of their ``texts`` (node, text). The pairs of one a are dealt
    into parts."""

    @F.pandas_udf("boolean")
    def linked(one: pd.Series, other: pd.Series) -> pd.Series:
        out, last, a = [], None, set()
        for s, t in zip(one, other, strict=True):
            if s != last:
                last, a = s, set(shingles(s, rule.words))
            b = set(shingles(t, rule.words))
            common = len(a & b)
            out.append(common > 0 and 100 * common >= rule.percent * (len(a) + len(b) - common))
        return pd.Series(out, dtype=bool)

    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    parts = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part")
    ones = counts.join(texts.select(F.col("node").alias("a"), F.col("text").alias("one")), "a").select("a", "one", parts)
    dealt = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("n")).alias("part"))
    others = dealt.join(texts.select(F.col("node").alias("b"), F.col("text").alias("other")), "b")
    return others.join(ones, ["a", "part"]).where(linked("one", "other")).select("a", "b")


def sizes_fit(x: Column, y: Column, rule: Rule) -> Column:
    return 100 * F.least(x, y) >= rule.percent * F.greatest(x, y)


def labelled(nodes: DataFrame, links: DataFrame | None) -> DataFrame:
    """``nodes`` (node, ...) with the component of ``links``; a node without links is its own."""
    if links is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))


def meeting(spots: DataFrame, keys: DataFrame) -> DataFrame:
    """``spots`` (node, keys, ...) exploded to the rows of ``keys`` (unique by key). A key of many rows makes a skewed partition, which Spark
    splits (adaptive execution); each row is made once."""
    return spots.withColumn("key", F.explode("keys")).drop("keys").join(keys, "key")


def across(spots: DataFrame) -> DataFrame:
    """(key, node, size, component) of ``spots`` (node, size, keys, component), of keys in several components; n: rows
    of the key, main: its most frequent component, n_main: rows of that."""
    held = spots.select("component", F.explode("keys").alias("key")).groupBy("key", "component").agg(F.count("*").alias("n"))
    keys = held.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("components")).where("components > 1")
    keys = written(keys.select("key", "n", F.col("main.component").alias("main"), F.col("main.n").alias("n_main")), "keys")
    return written(meeting(spots, keys), "across")


def one_partner(spots: DataFrame, turn: int, rule: Rule) -> DataFrame:
    """(a, b) for every node of ``spots`` (node, size, keys, component): b with the end of a key, in another component, that most of its
    keys share. Only the keys of a SHARE count, another one each turn: copies share most of their keys."""
    some = spots.withColumn("keys", F.filter("keys", lambda k: F.pmod(k, F.lit(SHARE)) == turn % SHARE))
    end = F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "size", "component")
    ends = some.withColumn("key", F.explode("keys")).groupBy("key").agg(F.min(end).alias("low"), F.max(end).alias("high"), F.min("component").alias("first"), F.max("component").alias("last"))
    met = meeting(some, written(ends.where("first < last").select("key", "low", "high"), "ends"))
    fits = lambda e: (F.col(f"{e}.component") != F.col("component")) & sizes_fit(F.col("size"), F.col(f"{e}.size"), rule)
    met = met.select(F.col("node").alias("b"), F.when(fits("low"), F.col("low.node")).when(fits("high"), F.col("high.node")).alias("a")).where("a is not null")
    votes = met.groupBy("b", "a").agg(F.count("*").alias("n"))
    return votes.groupBy("b").agg(F.max_by("a", F.struct("n", F.xxhash64("a"))).alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def few_pairs(rows: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): all pairs of ``rows`` (see ``across``) of a key in different components, each at the first band that they share. For keys
    of at most FEW rows."""
    held = rows.select("key", "node", "size", "component").join(nodes.select("node", "bands"), "node")
    x, y = held.alias("x"), held.alias("y")
    fits = (F.col("x.component") != F.col("y.component")) & sizes_fit(F.col("x.size"), F.col("y.size"), rule)
    same = F.array_position(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), True)
    first = F.get(F.col("x.bands"), (same - 1).cast("int")) == F.col("x.key")
    return x.join(y, [F.col("x.key") == F.col("y.key"), F.col("x.node") < F.col("y.node"), fits & first]).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def cell_links(cell: pd.DataFrame, rule: Rule) -> list[tuple[int, int]]:
    """Links that join the components of a cell's rows (key, side, node, component, size, bands, text) which are linked: of side 0 and 1
    with each other, or of side 2 among themselves. A row is compared with others until it is joined to their component, so only rows
    that aren't similar meet all; pairs that share an earlier band meet there."""
    node, size, side, text = cell["node"].tolist(), cell["size"].to_numpy(np.int64), cell["side"].to_numpy(), cell["text"].tolist()
    _, component = np.unique(cell["component"].to_numpy(np.int64), return_inverse=True)
    bands = np.stack(cell["bands"].tolist())
    at, held, out = int(np.argmax(bands[0] == cell["key"].iloc[0])), {}, []

    def hashes(k: int):
        if k not in held:
            h = distinct_hashes(text[k], rule.words)
            held[k] = h if len(h) > LONG else set(h.tolist())
        return held[k]

    def linked(x: int, y: int) -> bool:
        p, q = hashes(x), hashes(y)
        if isinstance(p, set) and isinstance(q, set):
            common = len(p & q)
        else:
            common = len(np.intersect1d(*(np.fromiter(h, dtype=np.uint64, count=len(h)) if isinstance(h, set) else h for h in (p, q))))
        if 100 * common < rule.percent * (int(size[x]) + int(size[y]) - common):
            return False
        p, q = set(shingles(text[x], rule.words)), set(shingles(text[y], rule.words))  # the bytes, should hashes have collided
        return 100 * len(p & q) >= rule.percent * len(p | q)

    for x in np.flatnonzero(side > 0):
        other = (component != component[x]) & (100 * np.minimum(size, size[x]) >= rule.percent * np.maximum(size, size[x]))
        other &= side == 0 if side[x] == 1 else np.arange(len(side)) > x
        other[other] = ~(bands[other, :at] == bands[x, :at]).any(1)
        for y in np.flatnonzero(other):
            if component[y] != component[x] and linked(x, y):
                out.append((node[x], node[y]))
                component[component == component[y]] = component[x]
    return out


def many_links(rows: DataFrame, nodes: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) that join what the pairs of ``rows`` (see ``across``) of a key in different components join.

    The rows of a key's main component are dealt into blocks, so are its others; blocks of others meet each other and the main
    ones, a cell at a time, so a key's main rows aren't copied for each other but once for BLOCK others. No pairs leave a task, links alone do."""
    spot = F.xxhash64("node")
    dealt = rows.withColumn("mains", F.ceil(F.col("n_main") / BLOCK).cast("int")).withColumn("others", F.ceil((F.col("n") - F.col("n_main")) / BLOCK).cast("int"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda i, j, side: F.struct(F.lit(i).cast("int").alias("i") if isinstance(i, int) else i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    main_block, own = F.pmod(spot, F.col("mains")), F.pmod(spot, F.col("others"))
    as_main = F.transform(every(F.col("others")), lambda j: cell(main_block, j, F.lit(0)))
    to_mains = F.transform(every(F.col("mains")), lambda i: cell(i, own, F.lit(1)))
    to_others = F.transform(every(F.col("others")), lambda j: cell(-1 - F.least(j, own), F.greatest(j, own), F.when(j == own, 2).otherwise(F.when(own < j, 0).otherwise(1))))
    cells = dealt.withColumn("cell", F.explode(F.when(F.col("component") == F.col("main"), as_main).otherwise(F.concat(to_mains, to_others))))
    cells = cells.select("key", "cell.*", "node", "component").join(nodes.select("node", "size", "bands"), "node").join(texts, "node")

    def meet(batches):
        open_rows = None
        for pdf in batches:
            for _, part in pdf.groupby(["key", "i", "j"], sort=False):
                if open_rows is not None and (open_rows[0][["key", "i", "j"]].iloc[0] == part[["key", "i", "j"]].iloc[0]).all():
                    open_rows.append(part)
                    continue
                if open_rows is not None:
                    yield pd.DataFrame(cell_links(pd.concat(open_rows), rule), columns=["a", "b"])
                open_rows = [part]
        if open_rows is not None:
            yield pd.DataFrame(cell_links(pd.concat(open_rows), rule), columns=["a", "b"])

    n = partitions(rows.sparkSession)
    return cells.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(meet, "a long, b long")


def similar_links(nodes: DataFrame, texts, rule: Rule, first: DataFrame | None = None) -> DataFrame | None:
    """Links (a, b) that connect the same nodes as all links by ``rule`` do, but for pairs that share no band. ``nodes``: node
    (long, unique), size, bands; ``texts``: function of a table (node) that gives (node, text) of these; ``first``: pairs (a, b), about as
    many as nodes, that are compared before all others. An empty set links to nothing. Within ``scratch``, intermediate
    tables are deleted."""
    shared = nodes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    keys = written(shared.where("n > 1").select("key"), "shared-keys")
    spots = meeting(nodes.select("node", "size", F.col("bands").alias("keys")), keys)
    spots = written(spots.groupBy("node", "size").agg(F.collect_list("key").alias("keys")), "spots")
    near = written(nodes.select("node", "size", "bands").join(spots.select("node"), "node", "left_semi"), "near")
    own, links = written(texts(near.select("node")), "texts"), None
    if first is not None:
        for end in ("a", "b"):
            first = first.join(near.select(F.col("node").alias(end), F.col("size").alias(f"{end}_size")), end)
        first = first.where((F.col("a") != F.col("b")) & sizes_fit(F.col("a_size"), F.col("b_size"), rule)).select("a", "b").distinct()
        links = written(verified(written(first, "first"), own, rule), "links")
    for turn in range(EARLY_ROUNDS + 1):
        placed = written(spots.join(labelled(near.select("node"), links), "node"), "placed")
        if turn < EARLY_ROUNDS:
            found = verified(written(one_partner(placed, turn, rule), "pairs"), own, rule)
        else:
            shared = across(placed)
            found = verified(written(few_pairs(shared.where(F.col("n") <= FEW), near, rule), "pairs"), own, rule)
            found = found.union(many_links(shared.where(F.col("n") > FEW), near, own, rule))
        links = written(found if links is None else links.union(found), "links")
    return links
