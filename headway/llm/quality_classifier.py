"""Quality scores by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from headway.llm.language_id import held_out
from headway.llm.shared import table, written

#: Bound of the fit: labelled rows learned from (about, chosen by a hash of doc_id).
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_HESSIAN, RIDGE = 60, 4, 64, 0.2, 1.0, 1.0
#: A text counts as good from this score on.
GOOD = 0.3

SYMBOLS = "#*$%&|<>"
CAPITAL = re.compile(r"[^\W\d_a-zß-öø-ÿ]")
FEATURES = [
    "log_words", "word_length", "symbols_a_word", "bars_a_word", "shouts_a_word", "capitals", "digits_a_word", "stops_a_word", "commas_a_word", "distinct_words",
    "distinct_windows", "commonest_word", "lines", "distinct_lines", "words_a_line", "ended_lines", "short_lines", "links_a_word", "longest_word", "letters",
]


def statistics(text: str | None) -> list[float]:
    """FEATURES of a whole text; of a null or empty one, zeros."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    letters = sum(map(len, words))
    counted: dict[str, int] = {}
    for w in words:
        counted[w] = counted.get(w, 0) + 1
    windows = len(set(zip(words, words[1:], words[2:], strict=False))) / max(n - 2, 1) if n > 2 else 1.0
    count = text.count
    return [
        np.log1p(n), letters / n, sum(map(count, SYMBOLS)) / n, count("|") / n, (count("!") + count("?")) / n, len(CAPITAL.findall(text)) / letters,
        sum(map(count, "0123456789")) / n, count(".") / n, count(",") / n, len(counted) / n, windows, max(counted.values()) / n, np.log1p(len(lines)),
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(x.rstrip()[-1:] in ".!?:" for x in lines) / len(lines), sum(len(x) < 30 for x in lines) / len(lines),
        count("http") / n, np.log1p(max(map(len, counted))), letters / len(text),
    ]


@dataclass
class Forest:
    """Trees flattened into arrays: node k tests feature[k] <= cut[k] and goes to left[k] or left[k] + 1; a leaf leads to
    itself. roots: the first node of each tree."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row, all rows stepping through a tree at once."""
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            raw += self.value[at]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for the logistic loss. Splits are searched in histograms of gradients and hessians over BINS
    quantile bins of each feature, all nodes of a level at once."""
    nodes: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "value")}
    roots: list[int] = []

    def node(value: float) -> int:
        at = len(nodes["value"])
        for k, v in (("feature", 0), ("cut", np.inf), ("left", at), ("right", at), ("value", value)):
            nodes[k].append(v)
        return at

    mean = float(y.mean()) if len(y) else 0.5
    base = float(np.log(max(mean, 1e-3) / max(1 - mean, 1e-3)))
    if len(y) and 0 < mean < 1:
        cuts = [np.unique(np.quantile(f, np.linspace(0, 1, BINS + 1)[1:-1])) for f in x.T]
        binned = np.stack([np.searchsorted(c, f, side="left") for c, f in zip(cuts, x.T, strict=True)], 1)
        n_features, raw = x.shape[1], np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            root = node(0.0)
            roots.append(root)
            leaf, level = np.full(len(y), root), [root]
            for _ in range(DEPTH):
                slot = np.full(len(nodes["value"]), -1)
                slot[level] = np.arange(len(level))
                on = np.flatnonzero(slot[leaf] >= 0)
                key = (slot[leaf[on]][:, None] * n_features + np.arange(n_features)) * BINS + binned[on]
                shape = (len(level), n_features, BINS)
                hist = [np.bincount(key.ravel(), np.repeat(v[on], n_features), minlength=np.prod(shape)).reshape(shape) for v in (g, h)]
                (gl, hl), (gt, ht) = [v.cumsum(2) for v in hist], [v.sum(2, keepdims=True) for v in hist]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hl < LEAST_HESSIAN) | (ht - hl < LEAST_HESSIAN)] = 0
                for f, c in enumerate(cuts):
                    gain[:, f, len(c) :] = 0
                below: list[int] = []
                best = gain.reshape(len(level), -1).argmax(1)
                for k, at in enumerate(level):
                    f, b = divmod(int(best[k]), BINS)
                    if gain[k, f, b] <= 1e-9:
                        continue
                    nodes["feature"][at], nodes["cut"][at] = f, float(cuts[f][b])
                    nodes["left"][at], nodes["right"][at] = node(0.0), node(0.0)
                    mine = np.flatnonzero(leaf == at)
                    leaf[mine] = np.where(binned[mine, f] <= b, nodes["left"][at], nodes["right"][at])
                    below += [nodes["left"][at], nodes["right"][at]]
                level = below
                if not level:
                    break
            n = len(nodes["value"])
            step = -RATE * np.bincount(leaf, g, minlength=n) / (np.bincount(leaf, h, minlength=n) + RIDGE)
            for at in np.unique(leaf).tolist():
                nodes["value"][at] = float(step[at])
            raw += step[leaf]
    return Forest(base, *(np.array(nodes[k]) for k in nodes), np.array(roots, dtype=np.int64), DEPTH)


@F.pandas_udf(ArrayType(FloatType()))
def features(text: pd.Series) -> pd.Series:
    return pd.Series([np.array(statistics(t), dtype=np.float32) for t in text], dtype=object)


def fit(described: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Forest:
    """A forest learned from at most about ``rows`` labelled rows that are not held out. ``described``: doc_id, features;
    ``labels``: doc_id, quality. Labels other than 0 and 1 are ignored; a document with several counts once for each."""
    known = labels.where("quality in (0, 1)").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    n = known.count()
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, rows / max(n, 1)) * (1 << 30)))
    pdf = described.select("doc_id", "features").join(some, "doc_id").toPandas().sort_values("doc_id")
    x = np.stack(pdf["features"].tolist()).astype(np.float64) if len(pdf) else np.zeros((0, len(FEATURES)))
    return fit_forest(x, pdf["quality"].to_numpy(np.float64))


def scored(described: DataFrame, forest: Forest) -> DataFrame:
    """``described`` with score and predicted."""
    shared = described.sparkSession.sparkContext.broadcast(forest)  # at most TREES * 2^(DEPTH + 1) nodes

    @F.pandas_udf(DoubleType())
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(np.stack(x.tolist()).astype(np.float64)) if len(x) else [], dtype="float64")

    return described.withColumn("score", score("features")).withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``documents``. Null and empty texts have the features of a
    text without words. Without labels of both kinds, every score is their share (0.5 without any)."""
    docs = table(spark, sf_dir, "documents")
    described = written(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), features("text").alias("features")), "statistics")
    forest = fit(described, table(spark, sf_dir, "labels"))
    return scored(described, forest).select("doc_id", "held_out", "score", "predicted")
