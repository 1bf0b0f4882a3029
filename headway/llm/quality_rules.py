"""Line-first quality rules: lines are judged first, documents by what is left of them. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.native import WORD, let, total, words
from headway.llm.shared import boxed, table, unboxed

SYMBOL = r"[#*$%&|<>]"
#: A line with one of these, in either case, is boilerplate (English, German, French, Spanish).
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "accept all cookies", "enable javascript",
    "subscribe to our", "sign up for our newsletter", "click here", "share this", "skip to content", "skip to main content",
    "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "datenschutzerklärung", "cookies akzeptieren", "hier klicken", "zum inhalt springen",
    "tous droits réservés", "conditions d'utilisation", "conditions d’utilisation", "politique de confidentialité", "accepter les cookies", "cliquez ici", "aller au contenu",
    "todos los derechos reservados", "términos y condiciones", "política de privacidad", "aceptar las cookies", "haga clic aquí", "saltar al contenido",
)
#: What stands between the links of a navigation line, and the most characters of a link.
MARK, LINK = "[|»›•>]", 40
#: Exclamation and question marks in runs, at word after word.
SHOUTING = r"[!?]{2,}"


@dataclass(frozen=True)
class LineRules:
    #: symbols a word; runs of ! and ? a word; ratio of letters in upper case (from so many words on)
    symbols_a_word: float = 0.5
    shouts_a_word: float = 0.25
    upper_share: float = 0.7
    upper_words: int = 4
    #: a document stays if at least this share of its word characters does
    least_kept: float = 0.7
    least_words: int = 50


def navigates(line: Column) -> Column:
    """Whether a line is three or more short links, with blanks and a bar, bullet or arrow between them, and perhaps a mark at
    the end. The line is cut at the marks and each part judged by itself: a pattern for the whole line would recurse once a
    link, and a line of thousands of links would overflow the stack."""

    def judge(parts: Column) -> Column:
        first, inner, last = (rf"^{head}[\s\S]{{1,{LINK}}}{tail}\z" for head, tail in ((r"\s*", r"\s"), (r"\s", r"\s"), (r"\s", r"\s*")))
        fit = lambda x, k, n: F.when(k == 0, x.rlike(first)).when(k == n - 1, x.rlike(last)).otherwise(x.rlike(inner))
        every = lambda some: (F.size(some) >= 3) & F.forall(F.transform(some, lambda x, k: fit(x, k, F.size(some))), lambda good: good)
        ended = F.element_at(parts, -1).rlike(r"^\s*\z")
        return every(parts) | (ended & let(F.slice(parts, 1, F.size(parts) - 1), every))

    return (F.regexp_count(line, F.lit(MARK)) >= 2) & let(F.split(line, MARK, -1), judge)


def boilerplate(text: Column) -> Column:
    """Whether a phrase of BOILERPLATE is there."""
    return let(F.lower(text), lambda low: reduce(or_, (low.contains(x) for x in BOILERPLATE)))


def line_fails(line: Column, rules: LineRules, suspect: Column) -> Column:
    """Whether a line with a word breaks a rule of punctuation, navigation or boilerplate. suspect: whether its text may have
    boilerplate."""
    n = F.regexp_count(line, F.lit(WORD))
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
    return (
        (F.regexp_count(line, F.lit(SYMBOL)) > n * rules.symbols_a_word)
        | (F.regexp_count(line, F.lit(SHOUTING)) > n * rules.shouts_a_word)
        | ((n >= rules.upper_words) & (capitals > letters * rules.upper_share))
        | navigates(line)
        | (suspect & boilerplate(line))
    )


def repeated_words(w: Column) -> Column:
    """Words in three-word windows that occur twice or more. Windows meet by a 64-bit hash; where a hash occurs twice, the
    words themselves are compared too."""
    n = F.size(w)
    none = F.lit(0).cast("long")
    word = lambda i, k: F.element_at(w, i + k)

    def covered(keys: Column) -> Column:
        full = F.transform(keys, lambda k, i: F.struct(k.alias("k"), word(i, 1).alias("x"), word(i, 2).alias("y"), word(i, 3).alias("z"), i.alias("i")))
        same = lambda e, o: (o.k == e.k) & (o.x == e.x) & (o.y == e.y) & (o.z == e.z)
        again = lambda p: F.filter(p, lambda e, j: same(e, F.get(p, j - 1)) | same(e, F.get(p, j + 1)))
        at = let(F.sort_array(full), lambda p: F.sort_array(F.transform(again(p), lambda e: e.i)))
        steps = lambda a: total(F.transform(a, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(a, j + 1), x + 3) - x)))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), none).otherwise(let(at, steps))

    some = let(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(word(i, 0), word(i, 1), word(i, 2))), covered)
    return F.when(n >= 3, some).otherwise(none)


def once(lines: Column) -> Column:
    """``lines`` without those with a word that equal an earlier one; blank lines all stay. The marks in front keep blank
    lines apart, so that one hash set does for all."""
    marked = F.transform(lines, lambda x, i: F.when(x.rlike(WORD), F.concat(F.lit("="), x)).otherwise(F.concat(i.cast("string"), F.lit("="), x)))
    return F.transform(F.array_distinct(marked), lambda x: F.substring(x, F.locate("=", x) + 1, F.length(x)))


def judged(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` with a column ``rules``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed,
    kept, and ``cleaned``, the lines that pass.

    A null text has no words and fails. Lines without a word are neither judged nor counted, and stay in ``cleaned``.
    A line equal to an earlier one of its document fails too: it counts as lost, and is not in ``cleaned``."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_lines(lines: Column, suspect: Column) -> Column:
        worded = F.filter(lines, lambda x: x.rlike(WORD))
        passed = F.filter(lines, lambda x: ~(x.rlike(WORD) & line_fails(x, rules, suspect)))
        return F.struct((F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"), passed.alias("passed"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))

    marks = docs.withColumn("_w", let(words(text), of_words)).withColumn("_l", let(boilerplate(text), lambda b: let(F.split(text, "\n", -1), lambda x: of_lines(x, b))))
    left = total(F.transform(F.array_distinct("_l.passed"), lambda x: F.length(F.regexp_replace(x, r"[\x20\x09-\x0D]+", ""))))
    failed = (F.col("_w.n_words") < rules.least_words) | (100 * F.col("_w.n_repeat_words") > 50 * F.col("_w.n_words"))
    found = F.struct(
        "_w.n_words", "_w.word_chars", F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"), "_l.n_dup_lines", "_w.n_repeat_words",
        failed.alias("base_failed"), (~failed & (left >= F.col("_w.word_chars") * rules.least_kept)).alias("kept"), F.array_join(once(F.col("_l.passed")), "\n").alias("cleaned"),
    )
    return marks.withColumn("rules", found).drop("_w", "_l")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counters, base_failed and kept for every row of ``documents``; see ``judged``."""
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "rules.*").drop("cleaned")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with the lines that pass as text, and n_chars with it."""
    return unboxed(judged(boxed(docs)).where("rules.kept"), docs.columns, F.col("rules.cleaned"))
