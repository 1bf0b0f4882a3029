"""Secrets with positions, and multipart credentials linked within scopes. Built-in functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.native import count_below, let, pieces, running
from headway.llm.shared import boxed, table, unboxed

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts, reported only beside a complementary one.
WEAK_ACCESS = r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{8,}(?![A-Za-z0-9])"
WEAK_SECRET = r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*+[0-9])(?=[A-Z0-9+/]*+[a-z])(?=[a-z0-9+/]*+[A-Z])[A-Za-z0-9+/]{32,}+={0,2}+(?![A-Za-z0-9+/=])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/%-]*)?"
#: Parts belong together within so many code points.
SCOPE = 300
#: Order of the kinds that start at one place.
KINDS = ["assign", "access", "hex", "weak_access", "weak_secret", "endpoint"]

SPANS = "array<struct<start: bigint, kind: int, end: bigint>>"


def spans(text: Column, pattern: str, kind: str, least: int = 0) -> Column:
    """(start, kind, end) of the matches of ``pattern``, leftmost and non-overlapping, in code points: what stands between
    the matches and the matches themselves add up. least: of group 2's length; other matches are dropped."""
    empty = F.expr(f"cast(array() as {SPANS})")

    size = lambda s: F.length(s).cast("long")

    def walk(found: Column, between: Column, values: Column) -> Column:
        reach = running(F.transform(found, lambda m, i: size(F.get(between, i)) + size(m)), lambda a, b: a + b)
        span = lambda e, i: F.struct((e - size(F.get(found, i))).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), e.alias("end"))
        each = F.transform(reach, lambda e, i: F.when(F.length(F.get(values, i)) >= least, span(e, i)))
        return F.filter(each, lambda x: x.isNotNull())

    matches = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    some = lambda found: let(F.split(text, pattern, -1), lambda gaps: let(matches(2), lambda v: walk(found, gaps, v)) if least else walk(found, gaps, found))
    return let(matches(0), lambda found: F.when(F.size(found) == 0, empty).otherwise(some(found)))


def near(x: Column, *kinds: Column) -> Column:
    """Whether a span of one of ``kinds`` (sorted, without overlaps) lies within SCOPE of span x, but doesn't overlap it: the
    last ones that start before x, or the first behind it."""

    def beside(spots: Column) -> Column:
        at = count_below(spots, x.start, lambda y: y.start)
        back = lambda k: F.coalesce((F.get(spots, k).end <= x.start) & (x.start - F.get(spots, k).end <= SCOPE), F.lit(False))
        ahead = F.get(spots, count_below(spots, x.end, lambda y: y.start)).start
        return let(at, lambda k: back(k - 1) | back(k - 2)) | F.coalesce(ahead - x.end <= SCOPE, F.lit(False))

    return reduce(or_, map(beside, kinds))


def overlaps(x: Column, *kinds: Column) -> Column:
    """Whether span x overlaps a span of one of ``kinds`` (sorted, without overlaps): the last that starts before x ends."""
    last = lambda spots: F.get(spots, count_below(spots, x.end, lambda y: y.start) - 1).end
    return reduce(or_, (F.coalesce(last(k) > x.start, F.lit(False)) for k in kinds))


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with arrays ``base`` and ``spans`` of (start, kind, end), in order. A null text is empty.

    The scope of a part is its document within SCOPE code points, so the interval join of access identifiers, secrets and
    endpoints stays in the row, as binary searches in the sorted spans of each kind. Weak identifiers count beside a secret;
    weak secrets beside an identifier, or beside a base secret with an endpoint; endpoints beside both an identifier and a
    secret. Weak parts that overlap a base span are part of it and not reported."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.withColumns({"_assign": spans(text, ASSIGN, "assign", 6), "_access": spans(text, ACCESS, "access"), "_hex": spans(text, HEX, "hex")})
    base = base.withColumns({"_wa": spans(text, WEAK_ACCESS, "weak_access"), "_ws": spans(text, WEAK_SECRET, "weak_secret"), "base": F.array_sort(F.concat("_assign", "_access", "_hex"))})
    firm = [F.col(k) for k in ("_assign", "_access", "_hex")]
    alone = lambda weak: F.filter(weak, lambda x: ~overlaps(x, *firm))
    some = F.size("base") + F.size("_wa") + F.size("_ws") > 0
    points = F.when(some, spans(text, ENDPOINT, "endpoint")).otherwise(F.expr(f"cast(array() as {SPANS})"))
    base = base.withColumns({"_wa": alone(F.col("_wa")), "_ws": alone(F.col("_ws")), "_ep": points})
    access, assign, hexes, wa, ws, ends = (F.col(c) for c in ("_access", "_assign", "_hex", "_wa", "_ws", "_ep"))
    more = F.concat(
        F.filter("_wa", lambda x: near(x, assign, hexes, ws)),
        F.filter("_ws", lambda x: near(x, access, wa) | (near(x, assign, hexes) & near(x, ends))),
        F.filter(ends, lambda x: near(x, access, wa) & near(x, assign, hexes, ws) & ~overlaps(x, *firm)),
    )
    return base.withColumn("spans", F.array_sort(F.concat("base", more)))


def listed(found: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x.kind), x.start, x.end)), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row of ``documents``; see ``scanned``."""
    found = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def marked(text: Column, cut: Column, mark: str) -> Column:
    """``text`` with ``mark`` in place of each span of ``cut`` (sorted; a span that starts inside an earlier one joins it).
    The text is cut into stretches of a block of spans first, as finding a place in a text means to walk there."""
    heads = lambda reach: F.filter(F.transform(cut, lambda x, i: F.when((i == 0) | (x.start >= F.get(reach, i - 1)), F.struct(x.start.alias("start"), i.alias("i")))), lambda x: x.isNotNull())
    joined = lambda reach: let(heads(reach), lambda h: F.transform(h, lambda x, k: F.struct(x.start.alias("start"), F.get(reach, F.coalesce(F.get(h, k + 1).i, F.size(reach)) - 1).alias("end"))))
    part = lambda s, low, size: F.substring(s, (low + 1).cast("int"), size.cast("int"))

    def stretch(block: Column, low: Column) -> Column:
        own = part(text, low, F.element_at(block, -1).end - low)
        back = lambda k: F.coalesce(F.get(block, k - 1).end, low)
        return let(own, lambda s: F.array_join(F.transform(block, lambda x, k: F.concat(part(s, back(k) - low, x.start - back(k)), F.lit(mark))), ""))

    def whole(blocks: Column) -> Column:
        low = lambda k: F.coalesce(F.element_at(F.get(blocks, k - 1), -1).end, F.lit(0).cast("long"))
        rest = F.substring(text, (low(F.size(blocks)) + 1).cast("int"), F.lit(2**31 - 1))
        return F.concat(F.array_join(F.transform(blocks, lambda b, k: let(low(k), lambda at: stretch(b, at))), ""), rest)

    reach = running(F.transform(cut, lambda x: x.end), F.greatest)
    return let(let(reach, lambda r: pieces(joined(r))), whole)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each secret span of the text (not endpoints; overlapping spans as one) replaced by ``mark``, and
    n_chars with it. Every row stays; null texts stay null."""
    found = scanned(boxed(docs)).withColumn("_cut", F.filter("spans", lambda x: x.kind != KINDS.index("endpoint")))
    text = F.when(F.size("_cut") == 0, F.col("text")).otherwise(marked(F.col("text"), F.col("_cut"), mark))
    return unboxed(found, docs.columns, text)
