"""SentencePiece encoding and decoding by a streaming Viterbi search over the vocabulary's pieces."""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from headway.llm.shared import table

SPACE = "▁"
#: Chunks whose ids a Python worker remembers; only speed depends on it.
REMEMBERED = 1_000_000
LONGEST_KEY = 40


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCodec:
    """Pieces and byte fallback of a SentencePiece model.

    A unigram model's scores are log-probabilities and are used as they are. A BPE model's scores only rank its pieces;
    there the log-probability of rank r is taken as -log(r + 1) but for a constant (Zipf's law). A character that no piece
    covers becomes its UTF-8 bytes, at a cost above that of any piece."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_ids, scores = {}, {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                scores[piece] = (i, model.get_score(i))
        ranked = all(s == int(s) for _, s in scores.values())
        self.scores = {p: (i, -float(np.log(1 + max(1.0, -s))) if ranked else s) for p, (i, s) in scores.items()}
        self.fallback = min(s for _, s in self.scores.values()) - 10
        self.longest = max(map(len, self.scores))
        #: every beginning of a piece: (id, score), id -1 where it is no piece itself
        self.steps: dict[str, tuple[int, float]] = {p[:k]: (-1, 0.0) for p in self.scores for k in range(1, len(p))}
        self.steps.update(self.scores)
        self.known: dict[str, bytes] = {}
        self.chunk = self.chunk_pattern()
        #: text of each id that has one by itself; bytes of longer characters have none
        byte_of = {i: b for b, i in self.byte_ids.items()}
        self.texts = [chr(byte_of[i]) if byte_of.get(i, 128) < 128 else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.high = np.zeros(len(self.pieces), dtype=bool)
        self.high[[i for b, i in self.byte_ids.items() if b >= 128]] = True

    def segment(self, chunk: str) -> array:
        """Ids of the best segmentation of ``chunk`` (blanks as SPACE), of equally good ones that with the longest last
        pieces. Streaming: only the last ``longest`` positions are live; ids are committed, and positions behind them
        forgotten, as soon as the paths from all live positions meet in one boundary."""
        out, n, longest, steps, fallback = array("I"), len(chunk), self.longest, self.steps, self.fallback
        best: dict[int, tuple[float, int, int]] = {0: (0.0, -1, -1)}  # position: score, the one before, id (-1: bytes)
        done, look = 0, 2 * longest
        for start in range(n):
            if start >= look:  # all pieces that begin before ``start`` are in: positions up to it are final
                done = self.commit(chunk, best, done, start, out)
                look = start + longest
            here = best.get(start)
            if here is None:
                continue
            base = here[0]
            for end in range(start + 1, min(n, start + longest) + 1):
                hit = steps.get(chunk[start:end])
                if hit is None:
                    if end == start + 1 and (end not in best or base + fallback > best[end][0]):
                        best[end] = (base + fallback, start, -1)
                    break
                if hit[0] >= 0:
                    score = base + hit[1]
                    if end not in best or score > best[end][0]:
                        best[end] = (score, start, hit[0])
                elif end == start + 1 and (end not in best or base + fallback > best[end][0]):
                    best[end] = (base + fallback, start, -1)
        self.commit(chunk, best, done, n, out, last=True)
        return out

    def commit(self, chunk: str, best: dict, done: int, end: int, out: array, last: bool = False) -> int:
        """Appends the ids up to the boundary in which the paths from all live positions meet; returns that boundary.
        Live are the positions from which a piece can still begin or reach beyond ``end``: ``end`` and what lies behind it."""
        live = {end} if last else {p for p in best if p >= end}
        at = set(live)
        while len(at) > 1:  # step back from the furthest until one boundary is left
            far = max(at)
            at.remove(far)
            at.add(best[far][1])
        boundary = at.pop()
        path, p = [], boundary
        while p > done:
            path.append((best[p][1], p, best[p][2]))
            p = best[p][1]
        for start, stop, piece in reversed(path):
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.byte_ids[b] for b in chunk[start:stop].encode("utf-8", "surrogatepass"))
        for p in [p for p in best if p < boundary]:
            del best[p]
        return boundary

    def chunk_pattern(self) -> re.Pattern:
        """Chunks between boundaries that are sure: before a blank that follows another character, around a line break,
        and before a sign that follows another character, for those signs that no piece joins to what is before."""
        signs = set(string.punctuation)
        while bad := {y for p in self.scores for x, y in zip(p, p[1:], strict=False) if y in signs and x not in signs and x != SPACE}:
            signs -= bad
        assert not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.scores)
        own = re.escape("".join(sorted(signs)))
        if not own:
            return re.compile(rf"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")
        return re.compile(rf"{SPACE}*[^{SPACE}\n{own}]+|{SPACE}*[{own}]+[^{SPACE}\n{own}]*|\n|{SPACE}+")

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit bytes. A blank is put in front; blanks become SPACE. A text's own U+2581
        goes through bytes, so that decoding restores it. Chunks between sure boundaries are segmented, and
        remembered, on their own."""
        if not text:
            return b""
        if SPACE not in text:
            return self.encode_plain(SPACE + text.replace(" ", SPACE))
        parts, raw = text.split(SPACE), np.array([self.byte_ids[b] for b in SPACE.encode()], dtype="<u4").tobytes()
        return raw.join([self.encode_plain((SPACE if not k else "") + part.replace(" ", SPACE)) for k, part in enumerate(parts)])

    def encode_plain(self, text: str) -> bytes:
        chunks = self.chunk.findall(text)
        ids = list(map(self.known.get, chunks))
        if None in ids:
            for k in [k for k, i in enumerate(ids) if i is None]:
                ids[k] = self.segment(chunks[k]).tobytes()
                if len(chunks[k]) <= LONGEST_KEY:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[chunks[k]] = ids[k]
        return b"".join(ids)

    def decode(self, ids) -> str:
        """The text of some ids: the inverse of ``encode``."""
        at = np.asarray(ids, dtype=np.int64)
        if not self.high[at].any():
            return "".join(map(self.texts.__getitem__, at.tolist()))[1:]
        byte_of = {i: b for b, i in self.byte_ids.items()}
        whole = b"".join(bytes([byte_of[i]]) if i in byte_of else self.texts[i].encode("utf-8", "surrogatepass") for i in at.tolist())
        return whole.decode("utf-8", "surrogatepass")[1:]


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ids (array of int) of its text; a null or empty text has none."""
    path = path or model_path()

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(text: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([np.frombuffer(c.encode(t or ""), dtype="<i4") for t in text], dtype=object)

    return docs.withColumn("ids", encode("text"))


def decoded(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``coded`` with the text of its ids."""
    path = path or model_path()

    @F.pandas_udf(StringType())
    def decode(ids: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([c.decode(x.tolist()) if x is not None else "" for x in ids], dtype=object)

    return coded.withColumn("text", decode("ids"))


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids as little-endian 32-bit integers), decoded_sha256 and restored (whether
    decoding gives the text again) for every row of ``documents``; a null text counts as empty."""
    path = model_path()
    kind = StructType([StructField("n_ids", LongType()), StructField("ids_crc32", LongType()), StructField("decoded_sha256", StringType()), StructField("restored", BooleanType())])

    @F.pandas_udf(kind)
    def both_ways(text: pd.Series) -> pd.DataFrame:
        c, out = codec(path), []
        for t in text:
            ids = c.encode(t or "")
            back = c.decode(np.frombuffer(ids, dtype="<u4").tolist())
            out.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == (t or "")))
        return pd.DataFrame(out, columns=kind.names)

    return table(spark, sf_dir, "documents").select("doc_id", both_ways("text").alias("r")).select("doc_id", "r.*")
