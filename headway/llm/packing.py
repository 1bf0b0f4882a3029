"""Packing by power-of-two decomposition: no sequence crosses documents, none needs padding."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.shared import table

SEQUENCE = 4096
END_ID = 2
#: Chunks without white space whose ids a Python worker remembers; only speed depends on it.
REMEMBERED = 1_000_000
#: Longer chunks are not remembered.
LONGEST_KEY = 40
#: Texts tokenized together.
TOGETHER = 500

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int, place long, ids array<int>"
#: sequence_id: the bucket from this bit on, the task from the other, the place in the task's share of the bucket below.
BUCKET_BIT, TASK_BIT = 58, 32


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Latin-1 but for letters, numbers, white space and the apostrophe: the tokenizer makes one word of a run of these, and
#: cuts it from a letter or number on either side. White space here is what the tokenizer drops.
SIGN = r"""\x00-\x08\x0e-\x1f!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~\x7f-\x84\x86-\x9f¡-©«-±´¶-¸»¿×÷"""
#: Words (with the apostrophes that belong to them), and runs of signs (with theirs).
PIECE = re.compile(rf"[^{SIGN}' \n]+(?:'(?!'*[{SIGN}])[^{SIGN}' \n]*)*|'*[{SIGN}][{SIGN}']*|(?:'(?!'*[{SIGN}])[^{SIGN}' \n]*)+")
PLAIN_PIECE = re.compile(rf"[^{SIGN} \n]+|[{SIGN}]+")


class ChunkEncoder:
    """Ids of texts as little-endian 32-bit bytes, the same as the tokenizer gives for the whole text.

    The tokenizer drops white space before its merges, and neither its normaliser, its added tokens nor its words reach
    across a blank or a line break; so the ids of a text are those of its chunks, and chunks are remembered. A text of
    Latin-1 without the start of an added token is lower-cased first (as the tokenizer would; NFC leaves it as it is) and
    also cut between words and runs of signs, where the tokenizer's words always end; so fewer chunks are new."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}

    @staticmethod
    def chunks(text: str) -> list[str]:
        if "<|" not in text:
            try:
                text.encode("latin-1")
                return (PIECE if "'" in text else PLAIN_PIECE).findall(text.lower())
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        out = {}
        for low in range(0, len(chunks), 1000):
            some = chunks[low : low + 1000]
            coded = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(coded.ids, dtype="<u4").tobytes()
            of = np.array(coded.word_ids, dtype=np.int64)
            ends = (4 * np.searchsorted(of, np.arange(len(some)), side="right")).tolist()
            out.update((c, ids[s:e]) for c, s, e in zip(some, [0, *ends], ends, strict=False))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        split = [self.chunks(t) for t in texts]
        found = [list(map(known.get, chunks)) for chunks in split]
        new = {c for chunks, ids in zip(split, found, strict=True) if None in ids for c, i in zip(chunks, ids, strict=True) if i is None}
        learned = self.learn(list(new))
        known.update((c, i) for c, i in learned.items() if len(c) <= LONGEST_KEY)
        return [b"".join(ids if None not in ids else [learned[c] if i is None else i for c, i in zip(chunks, ids, strict=True)]) for chunks, ids in zip(split, found, strict=True)]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def binary_pieces(tokens: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Document and length of each piece of documents of so many ``tokens``: whole sequences first, then the powers of two of the rest,
    longest first."""
    lengths = 1 << np.arange(sequence.bit_length())[::-1]
    times = tokens[:, None] // lengths
    times[:, 1:] &= 1
    return np.repeat(np.arange(len(tokens)), times.sum(1)), np.repeat(np.tile(lengths, len(tokens)), times.ravel())


def numbered(groups: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each element's place among those before it in its group, and the sizes of groups 0 .. n-1."""
    sizes = np.bincount(groups, minlength=n)
    out = np.empty(len(groups), dtype=np.int64)
    out[np.argsort(groups, kind="stable")] = np.arange(len(groups)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return out, sizes


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text), in the columns of PIECES.

    A document is its token ids and END_ID; it is cut into pieces whose lengths are powers of two, at most ``sequence``
    (itself a power of two). Each piece is a sequence of its own and goes to the bucket of its length (bucket: the length's
    logarithm), at a place in its task's share of that bucket; sequence_id puts bucket, task and place together, so that
    its order is bucket by bucket, and depends on the input's partitions only, not on retries. Batches of a bucket have no
    padding; see ``write_buckets``. A null or empty text is the piece of END_ID alone; a null doc_id stays null; repeated
    rows are packed each."""
    path = path or tokenizer_path()

    def cut(batches):
        encode, task, buckets = encoder(path).encode, TaskContext.get().partitionId(), sequence.bit_length()
        filled, end = np.zeros(buckets, dtype=np.int64), END_ID.to_bytes(4, "little")
        for whole in batches:
            for low in range(0, whole.num_rows, TOGETHER):
                doc_id, text = whole.slice(low, TOGETHER).columns
                bodies = encode([t or "" for t in text.to_pylist()])
                flat = end.join([*bodies, b""])
                tokens = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies)) // 4 + 1
                of, length = binary_pieces(tokens, sequence)
                ends = np.cumsum(length)
                start = ends - length - (np.cumsum(tokens) - tokens)[of]
                view, crc = memoryview(flat), zlib.crc32
                crcs = [crc(view[s:e]) for s, e in zip([0, *(4 * ends[:-1]).tolist()], (4 * ends).tolist(), strict=True)]
                bucket = np.frexp(length)[1].astype(np.int64) - 1
                place, sizes = numbered(bucket, buckets)
                place += filled[bucket]
                filled += sizes
                ids = pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), pa.array(np.frombuffer(flat, dtype="<i4")))
                out = [doc_id.take(pa.array(of)), start, length, crcs, tokens[of], bucket << BUCKET_BIT | task << TASK_BIT | place, np.zeros(len(of), dtype=np.int64), bucket.astype(np.int32), place, ids]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names=COLUMNS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


COLUMNS = [c.split()[0] for c in PIECES.split(", ")]


def write_buckets(pieces: DataFrame, path: str, files: int) -> None:
    """The sequences of ``pack`` as Parquet in one folder for each bucket, dealt over at most ``files`` files each by a hash
    of the sequence, so that a long bucket isn't the work of one task. A reader of one folder gets equal lengths only."""
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("sequence_id"), F.lit(files)))
    dealt.repartition(files, "bucket", "part").drop("part").write.partitionBy("bucket").parquet(path)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of every document of ``documents``; see ``pack``."""
    return pack(table(spark, sf_dir, "documents")).drop("ids")
