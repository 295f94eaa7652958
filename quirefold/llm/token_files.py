"""Token ids as binary segments with Elias-Fano document boundaries.

The file format: a folder of Parquet files, written by Spark's own writer so that any store
Spark reaches will do.  File by file and row by row, segments follow in ascending document
order (null ids first, equal ids by the hash of their text).  A row is a segment:

* ``part``, ``seg``: its place; ``n_ids``: ids in it,
* ``doc_ids``: ids of its documents in order,
* ``ids``: the token ids of those documents, end id included, as little-endian unsigned
  integers of ``width`` bytes (2 if the vocabulary allows, else 4),
* ``ends``: Elias-Fano code of the documents' end offsets in ``ids``: per document about
  ``2 + log2(n_ids / documents)`` bits, with the place of every 256th one-bit for ``select``.

Offsets in the whole collection are those in a segment plus the ids of all segments before.

Defined results: a null or empty text is the end id alone; a document may be longer than a
segment (it then is one of its own); an empty table gives a table without segments.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import give_back, slices, worker_cache

#: Ids in a segment; words up to this length are remembered from their second time on, this many at most by each of a worker's two memos (some 240 bytes each), and marks of words that came once.
SEGMENT_IDS, MEMO_LENGTH, MEMO_SIZE, MARKS = 1 << 18, 48, 1 << 19, 1 << 21
SELECT_EVERY = 256
SCHEMA = "part int, seg int, n_ids long, width int, doc_ids array<long>, ends binary, ids binary"


class EliasFano:
    """A non-decreasing sequence below ``universe`` in near-minimal space, with random access."""

    def __init__(self, data: bytes) -> None:
        self.n, self.low_bits, universe, n_high, n_select = struct.unpack_from("<QIQQQ", data)
        at = struct.calcsize("<QIQQQ")
        low = -(-self.n * self.low_bits // 8)
        self.low = np.unpackbits(np.frombuffer(data, np.uint8, low, at), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        self.high = np.frombuffer(data, np.uint8, n_high, at + low)
        self.sample = np.frombuffer(data, np.uint32, n_select, at + low + n_high)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n, universe = len(values), int(values[-1]) + 1 if len(values) else 0
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        packed, high, sample = np.packbits(low.reshape(-1), bitorder="little"), np.packbits(bits, bitorder="little"), ones[::SELECT_EVERY].astype(np.uint32)
        return struct.pack("<QIQQQ", n, low_bits, universe, len(high), len(sample)) + packed.tobytes() + high.tobytes() + sample.tobytes()

    def select(self, i: int) -> int:
        """The i-th value: the one-bit is found from the sampled one before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.sample[i // SELECT_EVERY])
        left, byte = i % SELECT_EVERY, at // 8
        bits = np.unpackbits(self.high[byte : byte + (SELECT_EVERY * 4) // 8 + 8], bitorder="little")[at % 8 :]
        span = 1
        while (found := np.flatnonzero(bits)).size <= left:
            span *= 2
            bits = np.unpackbits(self.high[byte : byte + span * SELECT_EVERY], bitorder="little")[at % 8 :]
        high = at + int(found[left]) - i
        return (high << self.low_bits) | int((self.low[i].astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum())

    def values(self) -> np.ndarray:
        """All values at once."""
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        low = (self.low.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1) if self.low_bits else 0
        return (high.astype(np.int64) << self.low_bits) + low


#: Where byte-level BPE always cuts: before a space between two characters that are no white space.
_BEFORE_WORD = re.compile(r"(?<=\S)(?= \S)")
_LETTERS = re.compile(r"[^\W\d_]+")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE: itself if printable Latin-1, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class Encoder:
    """Token ids, as bytes, from the tokenizers library, remembered by word.

    Byte-level BPE cuts texts into letters, digits, signs and spaces first and merges only
    inside such a piece.  So a word of letters alone, with the space before it, goes straight to
    the library's model, and texts are put together from lines and words: between words there
    is always a cut, and a line end between two others is a piece of its own.  Texts with
    white space of another kind (two spaces, blank lines) are cut where that is safe.
    """

    def __init__(self, path: str, memo: int = MEMO_SIZE) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        spec = json.loads(self.tokenizer.to_str())
        first = spec.get("pre_tokenizer") or {}
        self.cuts = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and not spec.get("normalizer") and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.line_end = self.plain("\n")
        self.spaced, self.bare = _Words(self, " ", memo), _Words(self, "", memo)

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def plain(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def merge(self, letters: str) -> bytes:
        """Ids of one pre-token."""
        return self.pack([t.id for t in self.model.tokenize(letters.encode().decode("latin-1").translate(self.letters))])

    def encode(self, text: str) -> bytes:
        if not text or not self.cuts:
            return self.plain(text)
        try:
            lines = []
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                lines.append(self.bare[first] + b"".join(map(self.spaced.__getitem__, rest)))
            return self.line_end.join(lines)
        except LookupError:
            return b"".join(map(self.plain, _BEFORE_WORD.split(text)))


class _Words(dict):
    def __init__(self, encoder: Encoder, before: str, most: int) -> None:
        self.encoder, self.before, self.most, self.once = encoder, before, most, bytearray(MARKS)

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise LookupError
        head = _LETTERS.match(word)
        if not head or not head[0].isalpha():
            ids = self.encoder.plain(self.before + word)
        elif len(head[0]) == len(word):
            ids = self.encoder.merge(self.before + word)
        else:
            ids = self[head[0]] + self.encoder.bare[word[head.end() :]]
        if len(word) <= MEMO_LENGTH:
            mark = hash(word) & (MARKS - 1)
            if not self.once[mark]:
                self.once[mark] = 1
                return ids
            if len(self) >= self.most:
                self.clear()
                self.once = bytearray(MARKS)
            self[word] = ids
        return ids


def _segments(tokenizer: str, end_id: int, segment_ids: int, memo: int):
    def run(batches):
        encoder = worker_cache(("ids", tokenizer, memo), lambda: Encoder(tokenizer, memo))
        end = np.array([end_id], f"<u{encoder.width}").tobytes()
        part, seg, doc_ids, ends, ids, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([held], pa.int64()), pa.array([encoder.width], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([EliasFano.encode(np.array(ends, np.uint64))], pa.binary()), pa.array([b"".join(ids)], pa.binary())],
                ["part", "seg", "n_ids", "width", "doc_ids", "ends", "ids"],
            )

        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = encoder.encode(text) + end
                if held and held + len(own) // encoder.width > segment_ids:
                    yield flush()
                    seg, doc_ids, ends, ids, held = seg + 1, [], [], [], 0
                held += len(own) // encoder.width
                doc_ids.append(doc_id)
                ends.append(held)
                ids.append(own)
        if held:
            yield flush()
        give_back()

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS, memo: int = MEMO_SIZE) -> None:
    """Encode all texts and write them to ``folder`` in ascending id order.  Workers keep memos of ``memo`` words over their tasks: fewer, where other operators follow in them."""
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    # Batches of a slice each while this is written: neither side holds more texts than it works on.
    conf, rows = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(rows)
    conf.set(rows, "1024")
    try:
        ordered.mapInArrow(_segments(tokenizer, end_id, segment_ids, memo), SCHEMA).write.parquet(folder)
    finally:
        conf.set(rows, before)


def _documents(batches):
    for batch in slices(batches, 16):
        for row in batch.to_pylist():
            coded = EliasFano(row["ends"])
            ends = np.array([coded.select(k) for k in range(coded.n)], np.int64)
            ids = np.frombuffer(row["ids"], f"<u{row['width']}")
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            wide = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["base"]), pa.array(ends - starts), pa.array([zlib.crc32(wide[a:z].tobytes()) for a, z in zip(starts, ends, strict=True)], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def segment_bases(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of ``folder`` with ``base``, the ids of all segments before: part sums on the driver (one number a part), the rest by window."""
    table = spark.read.schema(SCHEMA).parquet(folder)
    sums = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, at = [], 0
    for part, n in sums:
        before.append((part, at))
        at += n
    bases = spark.createDataFrame(before, "part int, part_base long")
    places = table.select("part", "seg", "n_ids").join(bases, "part").select("part", "seg", (F.col("part_base") + F.sum("n_ids").over(W.partitionBy("part").orderBy("seg")) - F.col("n_ids")).alias("base"))
    return table.join(places, ["part", "seg"])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32``."""
    return segment_bases(spark, folder).select("base", "width", "doc_ids", "ends", "ids").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
