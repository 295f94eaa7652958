"""Exact SentencePiece token counts, with huge documents encoded in overlapping chunks.

A place in a text is a *proven* boundary if a space follows a character that is no space
and no piece of the vocabulary holds a space mark after another character: no merge can
then reach across, so what stands before and after is encoded alike alone and together.
``stable`` proves this for a model; for a model where it fails, documents are encoded whole.

Ordinary documents are cut at their proven boundaries, and a word that comes again is
looked up.  Documents longer than ``chunk`` characters go out as overlapping chunks to any
task; each chunk returns the offsets of its tokens, and neighbours are spliced at the
last proven boundary inside their overlap at which both have a token begin.  Where there is
none (a huge unbroken string), the overlap of that document doubles and it is encoded again,
in the end as one piece.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows are counted one by one,
so repeated rows and repeated or null ids do no harm.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, slices, worker_cache

#: Characters in a chunk, and of overlap at first; words up to this length are remembered, this many at most in a task.
CHUNK, OVERLAP, MEMO_LENGTH, MEMO_SIZE = 1 << 16, 1 << 9, 48, 1 << 20
_MARK = "▁"
_SEGMENT = re.compile(f"{_MARK}*[^{_MARK}]+|{_MARK}+")
_BOUNDARY = re.compile(f"(?<=[^ {_MARK}])(?= )")


def load(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def stable(encoder) -> bool:
    """Whether texts get a space mark in front, and no piece holds one after another character."""
    if not encoder.encode("a", out_type=str)[0].startswith(_MARK):
        return False
    return not any(re.search(f"[^{_MARK}]{_MARK}", encoder.id_to_piece(i)) for i in range(encoder.get_piece_size()))


class Counter(dict):
    """Token counts of words that follow a single space or begin a text; other texts are counted by segments."""

    def __init__(self, encoder) -> None:
        self.encoder, self.proven, self.segments = encoder, stable(encoder), {}

    def __missing__(self, word: str) -> int:
        if not word or _MARK in word:
            raise LookupError  # two spaces in a row, or a mark that is text: no boundary here
        n = len(self.encoder.encode(word))
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_SIZE:
                self.clear()
            self[word] = n
        return n

    def segment(self, segment: str) -> int:
        # The encoder puts one mark before what it gets; a lone mark is what is left of a final space.
        return len(self.encoder.encode(segment[1:].replace(_MARK, " "))) if len(segment) > 1 else 1

    def count(self, text: str) -> int:
        if not text or not self.proven:
            return len(self.encoder.encode(text))
        try:
            return sum(map(self.__getitem__, text.split(" ")))
        except LookupError:
            return sum(map(self.segment, _SEGMENT.findall(_MARK + text.replace(" ", _MARK))))


def _count_or_chunk(model: str, chunk: int):
    """Counts of ordinary documents; of longer ones the text itself, to be chunked."""

    def run(batches):
        counter = worker_cache(("counter", model), lambda: Counter(load(model)))
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            huge = [counter.proven and len(t) > chunk for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([None if h else counter.count(t) for t, h in zip(texts, huge, strict=True)], pa.int64()), pa.array([t if h else None for t, h in zip(texts, huge, strict=True)], pa.string())],
                ["doc_id", "n_bytes", "n_tokens", "huge_text"],
            )

    return run


def chunks_of(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of chunks that overlap by ``overlap``; one chunk if the overlap has grown past the chunk."""
    if overlap * 2 > chunk:
        chunk = overlap * 2
    if chunk >= length:
        return [(0, length)]
    starts = range(0, max(1, length - overlap), chunk - overlap)
    return [(s, min(length, s + chunk)) for s in starts]


def _cut_chunks(chunk: int):
    def run(batches):
        for batch in batches:
            for key, overlap, text in zip(*(batch.column(c).to_pylist() for c in ("key", "overlap", "huge_text")), strict=True):
                parts, before, start = chunks_of(len(text), chunk, overlap), 0, 0
                for k, (a, z) in enumerate(parts):
                    before, start = a, start + len(text[before:a].encode())
                    yield pa.RecordBatch.from_pylist([{"key": key, "k": k, "of": len(parts), "start": start, "piece": text[a:z]}], schema=pa.schema([("key", pa.int64()), ("k", pa.int32()), ("of", pa.int32()), ("start", pa.int64()), ("piece", pa.string())]))

    return run


def token_begins(encoder, text: str) -> np.ndarray:
    """Offset, in UTF-8 bytes, at which each token begins."""
    found = encoder.encode(text, return_type="proto")
    return np.array([p.begin for p in found.pieces], np.int64)


def boundaries(text: str) -> np.ndarray:
    """Offsets, in UTF-8 bytes, of the proven boundaries."""
    at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]) if not text.isascii() else np.arange(len(text) + 1)
    return at[[m.start() for m in _BOUNDARY.finditer(text)]].astype(np.int64)


def _encode_chunks(model: str):
    def run(batches):
        encoder = worker_cache(("encoder", model), lambda: load(model))
        for batch in batches:
            begins, marks = [], []
            for start, piece in zip(batch.column("start").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                begins.append((token_begins(encoder, piece) + start).tobytes())
                marks.append((boundaries(piece) + start).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), batch.column("start"), pa.array(begins, pa.binary()), pa.array(marks, pa.binary())], ["key", "k", "start", "begins", "marks"])

    return run


def splice(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> int | None:
    """Tokens of a document from its chunks (start, token offsets, proven boundaries); None if two neighbours share no boundary."""
    total, left = 0, 0
    for (_, begins, marks), (start, next_begins, next_marks) in zip(parts, parts[1:], strict=False):
        common = np.intersect1d(np.intersect1d(marks[marks > max(start, left)], next_marks), np.intersect1d(begins, next_begins))
        if not len(common):
            return None
        total += int(((begins >= left) & (begins < common[-1])).sum())
        left = int(common[-1])
    return total + int((parts[-1][1] >= left).sum())


def _splice_table(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["k"])
    n = splice([(r["start"], np.frombuffer(r["begins"], np.int64), np.frombuffer(r["marks"], np.int64)) for r in rows])
    return pa.table({"key": pa.array([rows[0]["key"]], pa.int64()), "spliced": pa.array([n], pa.int64())})


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = 4096) -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_count_or_chunk(model, chunk), "doc_id long, n_bytes long, n_tokens long, huge_text string")
    first = cut(counted.withColumn("key", F.when(F.col("huge_text").isNotNull(), F.monotonically_increasing_id())), "counts")
    waiting, done = first.where("huge_text is not null").select("key", "huge_text"), None
    while not waiting.isEmpty():
        pieces = waiting.select("key", F.lit(overlap).cast("long").alias("overlap"), "huge_text").mapInArrow(_cut_chunks(chunk), "key long, k int, of int, start long, piece string")
        encoded = pieces.repartition("key", "k").mapInArrow(_encode_chunks(model), "key long, k int, start long, begins binary, marks binary")
        tried = cut(encoded.groupBy("key").applyInArrow(_splice_table, "key long, spliced long"), "spliced")
        good = tried.where("spliced is not null")
        done = good if done is None else done.unionByName(good)
        waiting, overlap = waiting.join(tried.where("spliced is null"), "key", "left_semi"), overlap * 2
    plain = first.drop("huge_text")
    if done is not None:
        plain = plain.join(done, "key", "left").withColumn("n_tokens", F.coalesce("n_tokens", "spliced"))
    return plain.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
