"""Chat formatting by quotation linking: quotes are parsed, linked to the messages they quote, and left out.
Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.native import let
from headway.llm.shared import hot_keys, spread_join, table, written

#: Quote marks at the start of a line; a level for each. One class of characters: no line is too long for it.
MARKS = r"^[ \t>]*>"
#: A passage between quotation marks.
INLINE = r"[“„«\"]([^“”„«»\"\n]+)[”“»\"]"
#: A quote of up to so many lines is sought by its whole text, a longer one by its first RUN lines and then by all of them.
RUN = 4
#: Where a sentence ends.
SENTENCE = r"(?<=[.!?])\s+"
#: A line that introduces a quote.
INTRODUCES = r"(?i)^\s*(?:on\b.{0,200}\bwrote|.{1,80}\bwrote|am\b.{0,200}\bschrieb.{0,80}|le\b.{0,200}\ba écrit|el\b.{0,200}\bescribió.{0,80})\s*:\s*$"


def normal(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parsed(text: Column) -> Column:
    """(own, quotes) of a text that is not null: own, the unquoted lines without those that introduce a quote; quotes,
    (level, passage): runs of lines of one level, in order, then the passages between quotation marks in the own lines, which
    stay there (level 1)."""
    lines = F.split(text, "\n", -1)
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", ""))
    each = F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("line"), x.alias("raw")))
    kept = lambda r: F.filter(r, lambda x, i: (x.level == 0) & ~(x.raw.rlike(INTRODUCES) & (F.coalesce(F.get(r, i + 1).level, F.lit(0)) > 0)))

    def runs(r: Column) -> Column:
        edges = F.filter(F.transform(r, lambda x, i: F.when((i == 0) | (F.get(r, i - 1).level != x.level), i)), lambda i: i.isNotNull())

        def between(at: Column) -> Column:
            to = lambda k: F.coalesce(F.get(at, k + 1), F.size(r))
            passage = lambda i, k: F.array_join(F.transform(F.slice(r, i + 1, to(k) - i), lambda x: x.line), "\n")
            some = F.transform(at, lambda i, k: F.when(F.get(r, i).level > 0, F.struct(F.get(r, i).level.alias("level"), passage(i, k).alias("passage"))))
            return F.filter(some, lambda x: x.isNotNull())

        return let(edges, between)

    def both(r: Column) -> Column:
        some = F.exists(r, lambda x: x.level > 0)
        none = F.expr("cast(array() as array<struct<level: int, passage: string>>)")
        own = F.when(some, F.trim(F.array_join(F.transform(kept(r), lambda x: x.raw), "\n"))).otherwise(text)
        inline = lambda o: F.transform(F.regexp_extract_all(o, F.lit(INLINE), F.lit(1)), lambda x: F.struct(F.lit(1).alias("level"), x.alias("passage")))
        return let(own, lambda o: F.struct(o.alias("own"), F.concat(F.when(some, runs(r)).otherwise(none), inline(o)).alias("quotes")))

    return let(each, both)


def lines_of(text: Column) -> Column:
    """The lines of a text, normalised, without those that have neither letter nor digit."""
    return F.filter(F.transform(F.split(text, "\n"), normal), lambda x: x != "")


def stretches(lines: Column, n: int) -> Column:
    """The ``n`` lines from each line on, where there are so many."""
    starts = lambda x: F.when(F.size(x) >= n, F.sequence(F.lit(1), F.size(x) - n + 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return let(lines, lambda x: F.transform(starts(x), lambda i: F.array_join(F.slice(x, i, n), "\n")))


def two_to(k: Column) -> Column:
    return F.get(F.array(*(F.lit(1 << b) for b in range(31))), k)


def below_log2(n: Column) -> Column:
    """The largest k with 2^k <= n, for n > 0."""
    return F.length(F.bin(n)) - 1


def doublings(lines: Column) -> Column:
    """For each k the hashes of the 2^k lines from each line on, each made of two hashes of half the length. Not for no lines."""

    def longer(out: Column, k: Column) -> Column:
        twice = lambda last: F.transform(F.slice(last, 1, F.size(last) - two_to(k)), lambda x, i: F.xxhash64(x, F.get(last, i + two_to(k))))
        return F.array_append(out, let(F.element_at(out, -1), twice))

    levels = F.filter(F.sequence(F.lit(-1), below_log2(F.size(lines)) - 1), lambda k: k >= 0)
    return F.aggregate(levels, F.array(F.transform(lines, lambda x: F.xxhash64(x))), longer)


def run_hash(levels: Column, at: Column, n: Column) -> Column:
    """Of the ``n`` lines from ``at`` (from 0) on, by the two runs of 2^k lines that cover them."""
    k = below_log2(n)
    return F.xxhash64(F.get(F.get(levels, k), at), F.get(F.get(levels, k), at + n - two_to(k)), n)


def units(own: Column) -> Column:
    """What of a message a quote may be, normalised: the whole, its paragraphs, sentences, and up to RUN lines in a row,
    however these are broken in the quote; and, broken as they are, up to RUN lines that aren't blank. Longer runs: see ``runs``."""
    lines = lambda x: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(RUN)), lambda n: F.transform(x, lambda _, i: F.array_join(F.slice(x, i + 1, n), "\n"))))
    some = F.concat(F.array(own), F.split(own, r"\n\s*\n"), F.split(own, SENTENCE), let(F.split(own, "\n"), lines))
    broken = let(lines_of(own), lambda x: F.concat(*(stretches(x, n) for n in range(2, RUN + 1))))
    return F.array_distinct(F.concat(F.transform(some, normal), broken))


def runs(messages: DataFrame, quotes: DataFrame) -> DataFrame:
    """(conv_id, turn, norm): the runs of more than RUN lines of ``messages`` (conv_id, turn, own, key; all but own say which) that
    are among ``quotes`` (head, n, run: hash of the first RUN lines, number and hash of all), broken as they are there.

    Lines meet the heads without their texts; where a head is found, the hash of as many lines as its quotes have is compared,
    and only runs of equal hashes get their text. A run is found once a message, however often it is there."""
    which = ["conv_id", "turn", "key"]
    wanted = quotes.where(F.col("head").isNotNull()).select("head", "n", "run")
    anchors = written(wanted.groupBy("head").agg(F.collect_set("n").alias("lengths")), "anchors")  # lengths that differ
    starts = F.posexplode(F.transform(stretches(lines_of(F.col("own")), RUN), lambda x: F.xxhash64(x))).alias("at", "head")
    heads = written(messages.select(*which, starts).join(anchors.select("head"), "head", "left_semi"), "heads")
    hot = written(hot_keys(heads.groupBy("head").agg(F.count("*").alias("n")), "head", heads.count()), "hot")
    spots = spread_join(heads, anchors, "head", hot).select(*which, "at", F.explode("lengths").alias("n")).distinct()
    gathered = lambda rows, *columns: messages.dropDuplicates(which).join(rows.groupBy(*which).agg(F.collect_list(F.struct(*columns)).alias("spots")), which)
    lines = lines_of(F.col("own"))
    hashed = let(doublings(lines), lambda levels: F.transform("spots", lambda s: F.struct(s.at.alias("at"), s.n.alias("n"), F.when(s.at + s.n <= F.size(F.get(levels, F.lit(0))), run_hash(levels, s.at, s.n)).alias("run"))))
    found = gathered(spots, "at", "n").select(*which, F.explode(hashed).alias("s")).select(*which, "s.*").where("run is not null")
    found = found.groupBy(*which, "run", "n").agg(F.min("at").alias("at")).join(wanted.select("run", "n").distinct(), ["run", "n"], "left_semi")
    texts = let(lines, lambda x: F.transform("spots", lambda s: F.array_join(F.slice(x, s.at + 1, s.n), "\n")))
    return gathered(found, "at", "n").select("conv_id", "turn", F.explode(texts).alias("norm"))


def threads(messages: DataFrame) -> DataFrame:
    """One row for each row of ``messages`` (conv_id, turn, role, text): the message without its quotes, what it answers
    and where it stands.

    body: the own text; n_quotes, n_linked; reply_conv, reply_turn: the message that its first linked quote of the lowest
    level is a unit or a run of lines of (see ``units``, ``runs``): the first in its own conversation, if that is earlier; or else the first (by turn) in
    the conversation with the smallest conv_id that has it, or, where that is its own, with the largest, if that is another;
    null if there is none. thread_turn: the turn at the start of its chain of replies inside the conversation; depth: its
    length. Ordered by conv_id, thread_turn, depth, turn every reply follows what it answers. formatted: the body under its
    role.

    Passages are joined by their hash, and equal hashes are verified on the text. Null texts are empty. Rows with a null
    conv_id or turn have neither replies nor thread. Rows that share conv_id and turn are linked
    alike; null turns of a quote are left out. Quotes without a
    letter or digit link to nothing."""
    base = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("p", parsed(F.col("text")))
    base = base.select("conv_id", "turn", "role", "p.own", "p.quotes")
    quotes = base.where(F.size("quotes") > 0).select("conv_id", "turn", F.posexplode("quotes").alias("at", "q"))
    quotes = quotes.select("conv_id", "turn", "at", "q.level", lines_of(F.col("q.passage")).alias("lines")).where(F.size("lines") > 0)
    forms, long = F.array_distinct(F.array(F.array_join("lines", " "), F.array_join("lines", "\n"))), F.size("lines") > RUN
    head, run = F.xxhash64(F.array_join(F.slice("lines", 1, RUN), "\n")), let(doublings(F.col("lines")), lambda x: run_hash(x, F.lit(0), F.size("lines")))
    quotes = quotes.select("conv_id", "turn", "at", "level", F.explode(forms).alias("norm"), F.size("lines").alias("n"), F.when(long, head).alias("head"), F.when(long, run).alias("run"))
    quotes = written(quotes.withColumn("hash", F.xxhash64("norm")), "quotes")
    counts = quotes.groupBy("hash").agg(F.count("*").alias("n"))
    hot = written(hot_keys(counts, "hash", quotes.count()), "hot")
    known = base.where("conv_id is not null and turn is not null").select("conv_id", "turn", "own", F.xxhash64("own").alias("key"))
    wanted = counts.select("hash").union(quotes.where("head is not null").select("head")).distinct()
    hits = known.select("conv_id", "turn", "key", F.explode(F.array_distinct(F.transform(units(F.col("own")), lambda x: F.xxhash64(x)))).alias("hash"))
    quoted = written(known.join(hits.join(wanted, "hash", "left_semi").select("conv_id", "turn", "key").distinct(), ["conv_id", "turn", "key"], "left_semi"), "quoted")
    originals = quoted.select("conv_id", "turn", F.explode(units(F.col("own"))).alias("norm")).union(runs(quoted, quotes))
    originals = originals.where("norm <> ''").withColumn("hash", F.xxhash64("norm")).join(counts.select("hash"), "hash", "left_semi")
    originals = written(originals.groupBy("conv_id", "hash", "norm").agg(F.min("turn").alias("turn")), "originals")
    within = originals.select("conv_id", "hash", F.col("norm").alias("found"), F.col("turn").alias("in_turn"))
    inside = quotes.join(within, ["conv_id", "hash"]).where("norm = found and in_turn < turn").groupBy("conv_id", "turn", "at").agg(F.min("in_turn").alias("in_turn"))
    ends = originals.groupBy("hash", "norm").agg(F.min(F.struct("conv_id", "turn")).alias("low"), F.max(F.struct("conv_id", (-F.col("turn")).alias("back"))).alias("high"))
    ends = ends.select("hash", F.struct("norm", "low.conv_id", "low.turn").alias("low"), F.struct("high.conv_id", (-F.col("high.back")).alias("turn")).alias("high"))
    owners = written(ends.groupBy("hash").agg(F.collect_list(F.struct("low", "high")).alias("owners")), "owners")  # one, but for collisions
    spread = spread_join(quotes, owners, "hash", hot)
    one = F.get(F.filter("owners", lambda o: o.low.norm == F.col("norm")), F.lit(0))
    outside = spread.withColumn("o", one).where("o is not null").groupBy("conv_id", "turn", "at").agg(
        F.min(F.struct("o.low.conv_id", "o.low.turn")).alias("low"), F.max(F.struct("o.high.conv_id", (-F.col("o.high.turn")).alias("back"))).alias("high")
    )
    outside = outside.withColumn("o", F.when(F.col("low.conv_id") != F.col("conv_id"), F.col("low")).otherwise(F.struct("high.conv_id", (-F.col("high.back")).alias("turn"))))
    outside = outside.where("o.conv_id <> conv_id").select("conv_id", "turn", "at", F.col("o.conv_id").alias("out_conv"), F.col("o.turn").alias("out_turn"))
    linked = quotes.select("conv_id", "turn", "at", "level").distinct().join(inside, ["conv_id", "turn", "at"], "left").join(outside, ["conv_id", "turn", "at"], "left")
    linked = linked.withColumn("to_turn", F.coalesce("in_turn", "out_turn")).withColumn("to_conv", F.when(F.col("in_turn").isNotNull(), F.col("conv_id")).otherwise(F.col("out_conv")))
    pick = F.min(F.when(F.col("to_turn").isNotNull(), F.struct("level", "at", F.col("to_conv").alias("conv"), F.col("to_turn").alias("turn")))).alias("to")
    replies = linked.groupBy("conv_id", "turn").agg(F.count("to_turn").alias("n_linked"), pick)
    replies = written(replies.select("conv_id", "turn", "n_linked", F.col("to.conv").alias("reply_conv"), F.col("to.turn").alias("reply_turn")), "replies")
    chains = chained(replies.where("reply_conv = conv_id").select("conv_id", "turn", F.col("reply_turn").alias("up")))
    out = base.join(replies, ["conv_id", "turn"], "left").join(chains, ["conv_id", "turn"], "left")
    known = F.col("conv_id").isNotNull()
    return out.select(
        "conv_id", "turn", "role", F.col("own").alias("body"), F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_conv", "reply_turn",
        F.when(known, F.coalesce("root", "turn")).alias("thread_turn"), F.when(known & F.col("turn").isNotNull(), F.coalesce("depth", F.lit(0)).cast("long")).alias("depth"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("own"), F.lit("\n")).alias("formatted"),
    )


def chained(up: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) for the links ``up`` (conv_id, turn, up < turn): pointers jump twice as far each
    round, so a chain of d replies takes about log2(d) rounds."""
    at = written(up.select("conv_id", "turn", F.col("up").alias("root"), F.lit(1).cast("long").alias("depth")), "chains")
    while True:
        over = at.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        joined = at.join(over, ["conv_id", "root"], "left")
        moved = written(joined.select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "chains")
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return at


def op4_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of ``conversations`` without quotes, linked and ordered; see ``threads``."""
    return threads(table(spark, sf_dir, "conversations"))
