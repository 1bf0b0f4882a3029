"""Language identification by n-gram filters whose slots hold a bit for each language."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from headway.llm.shared import table, written

#: Bytes of an n-gram of lower-cased UTF-8, runs of anything but letters as blanks.
GRAM = 4
#: Slots of the filter, and slots of an n-gram.
SLOTS, HASHES = 1 << 20, 2
#: Bound of the fit: rows learned from for each language, about, chosen by a hash of doc_id.
FIT_ROWS = 10_000
#: Languages whose bits share a 64-bit word of a slot, and slots that one row brings to the driver.
WORD, RANGE = 63, 1 << 14
#: An n-gram is a language's if it makes up at least this part of the language's n-grams (so all count where there are fewer than a
#: million), and is at least so frequent as a share of where it is most so.
LEAST_RATE, LEAST_SHARE = 1e-6, 0.25
#: Bytes looked up at once.
BUFFER = 1 << 20

FOLD = np.full(256, 32, dtype=np.uint8)
FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[128:] = np.arange(128, 256)
COMMON_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]")
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def has_letter(text: str) -> bool:
    """Whether a character is a letter: of category L, so no number such as ½ or Ⅷ."""
    return bool(COMMON_LETTER.search(text)) or any(map(str.isalpha, text))


def folded(text: str) -> np.ndarray:
    return FOLD[np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)]


def grams(data: np.ndarray) -> np.ndarray:
    """The n-gram that starts at each byte but the last GRAM - 1."""
    n = len(data) - GRAM + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(GRAM if n > 0 else 0):
        out |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return out


def slots(gram: np.ndarray) -> list[np.ndarray]:
    shift = np.uint64(64 - SLOTS.bit_length() + 1)
    return [((gram + np.uint64(1)) * m >> shift).astype(np.int64) for m in MULTIPLIERS[:HASHES]]


@dataclass
class LanguageFilters:
    """slots[w, s] has bit l of word w if an n-gram of language w * WORD + l falls there; false_rate[l]: how often a foreign
    n-gram meets language l."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def of(cls, languages: list[str], owned: list[np.ndarray]) -> LanguageFilters:
        table = np.zeros((max(1, -(-len(languages) // WORD)), SLOTS), dtype=np.uint64)
        for number, own in enumerate(owned):
            for s in slots(own.astype(np.uint64)):
                table[number // WORD, s] |= np.uint64(1 << number % WORD)
        return cls.filled(languages, table)

    @classmethod
    def filled(cls, languages: list[str], table: np.ndarray) -> LanguageFilters:
        fill = np.array([((table[k // WORD] >> np.uint64(k % WORD)) & np.uint64(1)).mean() for k in range(len(languages))])
        return cls(languages, table, fill**HASHES)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score): the share of the language's popcount, corrected for false positives, in that of all."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.languages:
            return out
        at = [k for k, t in enumerate(texts) if t and has_letter(t)]
        while at:
            blocks, size = [], 0
            while at and (not blocks or size < BUFFER):
                data = folded(texts[at[0]])
                blocks.append((at.pop(0), data))
                size += len(data) + GRAM
            self._count(blocks, out)
        return out

    def _count(self, blocks, out) -> None:
        blank = np.full(1, 32, dtype=np.uint8)
        after = np.full(GRAM, 32, dtype=np.uint8)
        data = np.concatenate([x for _, d in blocks for x in (blank, d, after)])
        where = slots(grams(data))
        found = self.slots[:, where[0]]
        for s in where[1:]:
            found &= self.slots[:, s]
        ends = np.cumsum([len(d) + 1 + GRAM for _, d in blocks])
        starts = np.r_[0, ends[:-1]]
        inside = np.stack([starts, np.minimum(ends - GRAM + 1, found.shape[1])], 1)  # n-grams that reach no other text
        edges = inside.ravel()
        n = (inside[:, 1] - inside[:, 0]).astype(float)
        scores = np.zeros((len(self.languages), len(blocks)))
        for bit in range(len(self.languages)):
            hits = np.r_[0, np.cumsum((found[bit // WORD] >> np.uint64(bit % WORD)) & np.uint64(1), dtype=np.int64)]
            counted = (hits[edges[1::2]] - hits[edges[::2]]).astype(float)
            scores[bit] = np.maximum(0, counted - n * self.false_rate[bit]) / (1 - self.false_rate[bit])
        best, sums = scores.argmax(0), scores.sum(0)
        for k, (at, _) in enumerate(blocks):
            share = scores[best[k], k] / sums[k] if sums[k] else 1 / len(self.languages)
            out[at] = (self.languages[best[k]], float(min(1.0, share)))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; rows without an id are held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> LanguageFilters:
    """Filters learned from ``docs`` (doc_id, text, lang), of which about ``rows`` rows of each language are read. Counts and
    bits are put together on the executors; the driver gets the languages and SLOTS words for each WORD of them."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return LanguageFilters.of([], [])
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, int(min(1.0, rows / sizes[k]) * (1 << 30)))))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")])

    def count(batches):
        for pdf in batches:
            for low in range(0, len(pdf), 500):
                for lang, texts in pdf.iloc[low : low + 500].groupby("lang")["text"]:
                    blank = np.full(GRAM, 32, dtype=np.uint8)
                    data = np.concatenate([x for t in texts for x in (blank, folded(t))] + [blank])
                    gram, n = np.unique(grams(data), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": gram.astype(np.int64), "n": n})

    counted = some.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = written(counted, "grams")
    totals = {r.lang: r.all for r in counted.groupBy("lang").agg(F.sum("n").alias("all")).collect()}
    languages = sorted(totals)
    if not languages:
        return LanguageFilters.of([], [])
    look = lambda of: F.create_map(*(F.lit(x) for k in languages for x in (k, of(k))))[F.col("lang")]
    rated = counted.select("gram", look(languages.index).alias("number"), (F.col("n") / look(lambda k: float(totals[k]))).alias("rate")).where(F.col("rate") >= LEAST_RATE)
    best = rated.groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("number", "rate")).alias("all"))
    own = best.select("gram", F.transform(F.filter("all", lambda x: x.rate >= LEAST_SHARE * F.col("most")), lambda x: x.number).alias("numbers"))

    def place(batches):
        for pdf in batches:
            lists = [np.asarray(x, dtype=np.int64) for x in pdf["numbers"]]
            if not lists:
                continue
            number, of = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            for at in slots(pdf["gram"].to_numpy(np.int64).astype(np.uint64)):
                yield pd.DataFrame({"word": number // WORD, "slot": at[of], "bits": np.int64(1) << (number % WORD)})

    bits = own.mapInPandas(place, "word int, slot long, bits long").groupBy("word", "slot").agg(F.bit_or("bits").alias("bits"))

    def dense(key, pdf):
        part = np.zeros(RANGE, dtype=np.int64)
        part[pdf["slot"].to_numpy(np.int64) % RANGE] = pdf["bits"].to_numpy(np.int64)
        return pd.DataFrame({"word": [key[0]], "at": [key[1]], "part": [part.tobytes()]})

    parts = bits.groupBy("word", F.floor(F.col("slot") / RANGE).alias("at")).applyInPandas(dense, "word int, at long, part binary").collect()
    table = np.zeros((-(-len(languages) // WORD), SLOTS), dtype=np.uint64)
    for r in parts:
        table[r.word, r.at * RANGE : (r.at + 1) * RANGE] = np.frombuffer(r.part, dtype=np.uint64)
    return LanguageFilters.filled(languages, table)


def predicted(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """``docs`` with lang_pred and score, from the text alone. A null text, or one without a letter, is ``und`` with
    score 0; of equal languages the alphabetically first counts; if nothing was learned, all texts are ``und``."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS words for each WORD languages, whatever the input

    @F.pandas_udf(StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.predict(text.tolist()), columns=["lang_pred", "score"])

    return docs.withColumn("_p", predict("text")).select("*", "_p.lang_pred", "_p.score").drop("_p")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``documents``; learned from rows not held out."""
    docs = table(spark, sf_dir, "documents")
    filters = fit(docs.where(~held_out(F.col("doc_id"))))
    found = predicted(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), filters)
    return found.select("doc_id", "held_out", "lang_pred", "score")
