"""Removal of token passages that occur more than once in a corpus (Rabin-Karp windows).

Every window of ``width`` successive words gets a rolling hash, and Spark counts the hashes
of the whole corpus.  Two things keep the shuffle small.  Windows go to buckets by the least
5-word hash inside them, so that neighbouring windows mostly share a bucket and travel as
runs with one position for the run instead of one for each window.  And each task combines
before it sends: a window goes out once for half a million windows or so, however often it occurs
there, so a passage found in a third of all documents floods no bucket.  A bucket holds about
``BUCKET_WINDOWS`` windows whatever the corpus size; the number of buckets grows with it, and
so do the hash bits: 56 bits inside a bucket that is itself chosen by hash.  Buckets are counted first: one that a frequent
phrase makes several times as large is split by the windows' own hashes, which brings equal windows together as well.

Defined results: a null or blank text has no words and keeps nothing; a row is known by its id
and its text, so repeated rows remove each other's windows, and rows that share an id but
not a text (or have none) are told apart; texts of any length are read whole, very long ones in sections; an empty table gives
no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import io
import re
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .shared import WORD, buckets_for, give_back, slices, text_bytes_total

#: Windows combined before they are sent, windows in a bucket, buckets at least, and the words whose least hash picks the bucket.
COMBINE_WINDOWS, BUCKET_WINDOWS, LEAST_BUCKETS, ANCHOR = 1 << 19, 1 << 21, 1024, 5
#: Times the usual size from which a bucket is split.
SPLIT_FROM = 2
_BLOCK = "bucket int, payload binary"
_SPAN = "row_id long, row_hash long, first int, last int"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed byte string; the last is stored as it is (hashes do not compress)."""
    *small, big = [np.ascontiguousarray(a) for a in arrays]
    head = zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in small))
    return struct.pack(f"<{len(arrays) + 1}I", *(a.nbytes for a in small), big.nbytes, len(head)) + head + big.tobytes()


def _unpack(payload: bytes, *kinds: type) -> list[np.ndarray]:
    *sizes, head = struct.unpack_from(f"<{len(kinds) + 1}I", payload)
    at = 4 * (len(kinds) + 1)
    small = zstandard.ZstdDecompressor().decompress(payload[at : at + head], max_output_size=sum(sizes[:-1]) or 1) if sum(sizes[:-1]) else b""
    out, pos = [], 0
    for size, kind in zip(sizes[:-1], kinds[:-1], strict=True):
        out.append(np.frombuffer(small, kind, size // np.dtype(kind).itemsize, pos))
        pos += size
    return [*out, np.frombuffer(payload, kinds[-1], sizes[-1] // np.dtype(kinds[-1]).itemsize, at + head)]


def _spans(doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of successive windows: (document, first window, last window)."""
    if not len(doc):
        return doc, first, first
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + 1)
    at = np.flatnonzero(new)
    return doc[at], first[at], first[np.append(at[1:], len(doc)) - 1]


def _seven(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :7]


def _eight(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = raw.reshape(-1, 7)
    return out.reshape(-1).view(np.uint64)


def _bucket_of(key: np.ndarray, anchor: np.ndarray, buckets: int, split: dict[int, tuple[int, int]]) -> np.ndarray:
    """Bucket by anchor; of split buckets, one of ``parts`` that begin at ``first``, by the window's hash."""
    bucket = (wh.mix(anchor) % np.uint64(buckets)).astype(np.int64)
    if split:
        for b in np.intersect1d(bucket, np.fromiter(split, np.int64)):
            first, parts = split[int(b)]
            own = np.flatnonzero(bucket == b)
            bucket[own] = first + (wh.mix(key[own] ^ np.uint64(wh.SECOND_BASE)) % np.uint64(parts)).astype(np.int64)
    return bucket


def _blocks(parts: list[tuple], ids: np.ndarray, hashes: np.ndarray, buckets: int, split: dict[int, tuple[int, int]]):
    """One block for each bucket: the windows that the combined pieces hold, each once, and the spans they repeat themselves."""
    key, anchor, doc, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)  # equal to another window here
    later = np.zeros(len(key), bool)  # not the first of its kind here
    again[order[1:]] |= same
    again[order[:-1]] |= same
    later[order[1:]] = same
    bucket = _bucket_of(key, anchor, buckets, split)
    known_doc, known_first, known_last = _spans(doc[again], pos[again])
    known_bucket = (wh.mix(ids[known_doc].view(np.uint64) ^ hashes[known_doc].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    send = np.flatnonzero(~later)
    send = send[np.argsort(bucket[send], kind="stable")]
    new = np.ones(len(send), bool)
    new[1:] = (np.diff(bucket[send]) != 0) | (np.diff(doc[send]) != 0) | (np.diff(pos[send]) != 1)
    runs = np.flatnonzero(new)
    lengths = np.diff(np.append(runs, len(send)))
    run_bucket, by_known = bucket[send[runs]], np.argsort(known_bucket, kind="stable")
    raw = _seven(key[send])
    for b in np.union1d(run_bucket, known_bucket):
        lo, hi = np.searchsorted(run_bucket, [b, b + 1])
        klo, khi = np.searchsorted(known_bucket[by_known], [b, b + 1])
        own, known = runs[lo:hi], by_known[klo:khi]
        docs, local = np.unique(np.concatenate([doc[send[own]], known_doc[known]]), return_inverse=True)
        a, z = (runs[lo], runs[lo] + lengths[lo:hi].sum()) if hi > lo else (0, 0)
        yield int(b), _pack(
            ids[docs], hashes[docs], local[: hi - lo].astype(np.uint32), pos[send[own]].astype(np.uint32), lengths[lo:hi].astype(np.uint32),
            local[hi - lo :].astype(np.uint32), known_first[known].astype(np.uint32), known_last[known].astype(np.uint32),
            np.packbits(again[send[a:z]]), raw[a:z].reshape(-1),
        )


_KINDS = (np.int64, np.int64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32, np.uint8, np.uint8)


def _count_buckets(width: int, buckets: int):
    """Windows by bucket, of each task's texts."""
    anchor_width = min(ANCHOR, width)

    def run(batches):
        byte_powers, window_powers, total = wh.Powers(wh.BYTE_BASE), wh.Powers(wh.WINDOW_BASE), np.zeros(buckets, np.int64)
        for batch in slices(batches):
            data, at = wh.text_bytes(batch.column("text"))
            for *_, offsets, hashed, _, _ in wh.hashed_pieces(data, at, width, byte_powers):
                starts, _ = wh.window_starts(offsets, width)
                if len(starts):
                    least = wh.sliding_min(wh.window_hashes(hashed, anchor_width, window_powers), width - anchor_width + 1)[starts]
                    total += np.bincount((wh.mix(least) % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])
        give_back()

    return run


def _hash_windows(width: int, buckets: int, split: dict[int, tuple[int, int]]):
    anchor_width = min(ANCHOR, width)

    def run(batches):
        byte_powers, window_powers = wh.Powers(wh.BYTE_BASE), wh.Powers(wh.WINDOW_BASE)
        parts, ids, hashes, docs, held = [], [], [], 0, 0

        def flush():
            found = list(_blocks(parts, np.concatenate(ids), np.concatenate(hashes), buckets, split)) if held else []
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([p for _, p in found], pa.binary())], ["bucket", "payload"])

        for batch in slices(batches):
            data, at = wh.text_bytes(batch.column("text"))
            own_ids, own_hashes = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("row_id", "row_hash"))
            for first, last, offsets, hashed, before, _ in wh.hashed_pieces(data, at, width, byte_powers):
                starts, doc = wh.window_starts(offsets, width)
                if len(starts):
                    key = wh.window_hashes(hashed, width, window_powers)[starts]
                    least = wh.sliding_min(wh.window_hashes(hashed, anchor_width, window_powers), width - anchor_width + 1)[starts]
                    parts.append((key, least, doc + docs, starts - offsets[doc] + before))
                    ids.append(own_ids[first:last])
                    hashes.append(own_hashes[first:last])
                    docs += last - first
                    held += len(starts)
                if held >= COMBINE_WINDOWS:
                    yield flush()
                    parts, ids, hashes, docs, held = [], [], [], 0, 0
        yield flush()
        give_back()

    return run


def _count_windows(table: pa.Table) -> pa.Table:
    """Spans of windows in this bucket that occur more than once in the corpus."""
    blocks = [_unpack(p, *_KINDS) for p in table.column("payload").to_pylist()]
    raw = np.concatenate([b[9] for b in blocks])
    key = _eight(raw)
    twice = np.concatenate([np.unpackbits(b[8], count=len(b[9]) // 7).astype(bool) for b in blocks])
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    repeated = twice.copy()
    repeated[order[1:]] |= same
    repeated[order[:-1]] |= same
    out: list[list[np.ndarray]] = [[], [], [], []]
    at = 0
    for ids, hashes, doc, pos, lengths, known_doc, known_first, known_last, _, own in blocks:
        n = len(own) // 7
        each = np.repeat(doc, lengths).astype(np.int64)
        place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(pos, lengths)
        hit = repeated[at : at + n]
        d, f, t = _spans(each[hit], place[hit])
        for got, more in zip(out, (ids[np.append(d, known_doc).astype(np.int64)], hashes[np.append(d, known_doc).astype(np.int64)], np.append(f, known_first), np.append(t, known_last)), strict=True):
            got.append(more)
        at += n
    return pa.table({"row_id": pa.array(np.concatenate(out[0]), pa.int64()), "row_hash": pa.array(np.concatenate(out[1]), pa.int64()), "first": pa.array(np.concatenate(out[2]).astype(np.int32)), "last": pa.array(np.concatenate(out[3]).astype(np.int32))})


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("row_id"), F.xxhash64(text_col).alias("row_hash"), F.col(text_col).alias("text"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35) -> DataFrame:
    """Spans ``(row_id, row_hash, first, last)`` of windows, by first word, that also start anywhere else in the corpus."""
    buckets = buckets_for(text_bytes_total(docs, text_col) // 6, BUCKET_WINDOWS, LEAST_BUCKETS)
    # Only buckets beyond SPLIT_FROM times the usual size come to the driver: at most one in so many.
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_count_buckets(width, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    split, first = {}, buckets
    for row in counted.where(F.col("n") > SPLIT_FROM * BUCKET_WINDOWS).orderBy("bucket").collect():
        parts = -(-row["n"] // BUCKET_WINDOWS)
        split[row["bucket"]] = (first, parts)
        first += parts
    blocks = _keyed(docs, id_col, text_col).mapInArrow(_hash_windows(width, buckets, split), _BLOCK)
    return blocks.groupBy("bucket").applyInArrow(_count_windows, _SPAN)


_FOUND = re.compile(WORD)
#: Characters from which a text's words are not listed at once.
LONG_TEXT = 1 << 20


def _merge(spans: list[dict], width: int) -> list[list[int]]:
    """Maximal removal intervals of words."""
    merged: list[list[int]] = []
    for first, last in sorted((s["first"], s["last"] + width) for s in spans):
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    return merged


def _walk(text: str, merged: list[list[int]]) -> tuple[int, str]:
    """Number of words, and the kept ones with a space between, word by word."""
    out, n, at = io.StringIO(), 0, 0
    for n, m in enumerate(_FOUND.finditer(text), 1):
        while at < len(merged) and merged[at][1] < n:
            at += 1
        if at == len(merged) or n - 1 < merged[at][0]:
            if out.tell():
                out.write(" ")
            out.write(m[0])
    return n, out.getvalue()


def _strip(width: int):
    def run(batches):
        for batch in slices(batches):
            n_words, n_removed, kept, removed = [], [], [], []
            for text, packed in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if text and len(text) > LONG_TEXT:
                    merged = _merge(packed or [], width)
                    n, left = _walk(text, merged)
                    n_words.append(n)
                    n_removed.append(sum(b - a for a, b in merged))
                    kept.append(left)
                    removed.append([{"start": a, "end": b} for a, b in merged])
                    continue
                found = _FOUND.findall(text or "")
                if packed:
                    merged = _merge(packed, width)
                    left, at = [], 0
                    for first, last in merged:
                        left += found[at:first]
                        at = last
                    left += found[at:]
                else:
                    merged, left = [], found
                n_words.append(len(found))
                n_removed.append(len(found) - len(left))
                kept.append(" ".join(left))
                removed.append([{"start": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c not in ("text", "spans")), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                [*(c for c in batch.schema.names if c not in ("text", "spans")), "n_words", "n_removed", "kept_text", "removed"],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35) -> DataFrame:
    """Per document: its id as ``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` (kept words, one space between) and the ``removed`` word spans."""
    spans = repeated_windows(docs, id_col, text_col, width).groupBy("row_id", "row_hash").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    keyed = _keyed(docs, id_col, text_col).withColumn("doc_id", F.when(F.col("row_id") != -(1 << 63), F.col("row_id")))
    joined = keyed.join(spans, ["row_id", "row_hash"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_strip(width), "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>")
