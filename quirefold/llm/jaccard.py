"""N-gram Jaccard join: documents whose word-shingle sets have a similarity of 3/4 or more.

1. Equal sets form a class at once; from here on one document stands for its class.
2. Every shingle hash of every class is counted across the corpus, in hash buckets to which tasks
   send compact blocks.  A class can have a partner only if 3/4 of its shingles occur in another
   class, so only such classes go on.
3. Their shingles are counted again among themselves and ordered rare first.  Two sets can reach the
   similarity only if they share a shingle within the first ``n - ceil(0.75 n) + 1``: the prefix.
4. Classes are dealt to tiles of about ``TILE`` by the least class they meet over prefix
   shingles; tiles are joined on prefix shingles, so near copies mostly sit in one tile, and a large
   group costs a few tile pairs where it would cost millions of document pairs.
5. In a pair of tiles, the prefix, length, positional and suffix filters leave candidates, and each is
   verified on its whole sets, once.  Links are counted there, and those already implied by others are not sent.
6. Links become components; members get the component of their class.

A class is known by half of its set's digest (64 bits) in steps 3 to 6, so rows that share an id but not a text are told apart.

Defined results: a null or blank text has an empty set and links with nothing; a document of fewer
words than a shingle is one shingle of its whole sequence; rows without an id take part in no
link and have no component; equal rows have equal results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .components import components
from .shared import buckets_for, cut, likely, slices, text_bytes_total
from .substring import _pack, _unpack

#: Words in a shingle; similarity in hundredths; shingles sent at once and in a bucket; classes and shingles in a tile, about; bins of the suffix filter.
WIDTH, PERCENT, SEND, BUCKET, LEAST_BUCKETS, TILE, TILE_SHINGLES, BINS = 5, 75, 1 << 20, 1 << 21, 64, 384, 1 << 20, 64


def _ceil(percent: int, n: np.ndarray | int) -> np.ndarray | int:
    return -(-percent * n // 100)


class Shingler:
    def __init__(self, width: int) -> None:
        self.width, self.byte_powers, self.window_powers = width, wh.Powers(wh.BYTE_BASE), wh.Powers(wh.WINDOW_BASE)

    def sets(self, column: pa.Array):
        """(first row, set offsets, shingle hashes sorted by row and value) for piece after piece of a column of texts."""
        data, at = wh.text_bytes(column)
        sections: list[np.ndarray] = []  # of a long document
        for first, last, offsets, hashed, before, ends in wh.hashed_pieces(data, at, self.width, self.byte_powers, lower=True):
            starts, doc = wh.window_starts(offsets, self.width)
            keys = wh.window_hashes(hashed, self.width, self.window_powers)[starts]
            if before or sections or not ends:
                sections.append(np.unique(keys))
                if not ends:
                    continue
                keys = np.unique(np.concatenate(sections))
                doc, sections = np.zeros(len(keys), np.int64), []
                offsets = np.array([0, before + len(hashed)])
            counts = np.diff(offsets)
            few = np.flatnonzero((counts > 0) & (counts < self.width))
            if len(few):
                short = [wh.window_hashes(hashed[offsets[d] : offsets[d + 1]], int(counts[d]), self.window_powers)[0] ^ np.uint64(counts[d]) for d in few]
                keys, doc = np.concatenate([keys, np.array(short, np.uint64)]), np.concatenate([doc, few])
            order = np.lexsort((keys, doc))
            keys, doc = keys[order], doc[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
            keys, doc = keys[new], doc[new]
            yield first, np.searchsorted(doc, np.arange(last - first + 1)), keys


def _digest(values: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _describe(width: int):
    """Size and digest of each document's set."""

    def run(batches):
        shingler = Shingler(width)
        for batch in slices(batches):
            rows = []
            for _, at, keys in shingler.sets(batch.column("text")):
                rows += [(b - a, *(_digest(keys[a:b]) if b > a else (None, None))) for a, b in zip(at[:-1], at[1:], strict=True)]
            n, d1, d2 = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array([int(x) for x in n], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64())], ["doc_id", "text_hash", "n_shingles", "d1", "d2"])

    return run


def _blocks_of(refs: np.ndarray, at: np.ndarray, keys: np.ndarray, buckets: int, whole: bool):
    """Blocks by bucket: the sets' references, their counts in the bucket, the hashes (32 bits, or 64 if ``whole``)."""
    owner = np.repeat(np.arange(len(refs)), np.diff(at))
    bucket = ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, owner, keys = bucket[order], owner[order], keys[order]
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        own = owner[edges[b] : edges[b + 1]]
        new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        part = keys[edges[b] : edges[b + 1]]
        yield int(b), _pack(np.diff(np.append(new, len(own))).astype(np.uint32), refs[own[new]], part if whole else part.astype(np.uint32))


def _send_sets(width: int, buckets: int):
    """Blocks of all documents' shingles; equal sets go out once for a batch of blocks."""

    def run(batches):
        shingler = Shingler(width)
        refs, sizes, held, count, seen = [], [], [], 0, set()

        def flush():
            found = list(_blocks_of(np.array(refs, np.int64).reshape(-1, 2), np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(held), buckets, False)) if held else []
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([p for _, p in found], pa.binary())], ["bucket", "payload"])

        for batch in slices(batches):
            for _, at, keys in shingler.sets(batch.column("text")):
                for a, b in zip(at[:-1], at[1:], strict=True):
                    if b > a and (digest := _digest(keys[a:b])) not in seen:
                        seen.add(digest)
                        refs.append(digest)
                        sizes.append(b - a)
                        held.append(keys[a:b])
                        count += b - a
                if count >= SEND:
                    yield flush()
                    refs, sizes, held, count, seen = [], [], [], 0, set()
        yield flush()

    return run


def _shared_counts(table: pa.Table) -> pa.Table:
    """In one bucket: for each class, how many of its shingles another class has too."""
    blocks = [_unpack(p, np.uint32, np.int64, np.uint32) for p in table.column("payload").to_pylist()]
    counts = np.concatenate([b[0] for b in blocks]).astype(np.int64)
    refs = np.concatenate([b[1] for b in blocks]).reshape(-1, 2)
    keys = np.concatenate([b[2] for b in blocks])
    order = np.lexsort((refs[:, 1], refs[:, 0]))
    same = np.zeros(len(refs), bool)  # a class that other blocks hold as well
    same[order[1:]] = (refs[order[1:]] == refs[order[:-1]]).all(axis=1)
    owner = np.repeat(np.arange(len(refs)), counts)
    kept = ~same[owner]
    keys, owner = keys[kept], owner[kept]
    by_key = np.argsort(keys, kind="stable")
    equal = keys[by_key][1:] == keys[by_key][:-1]
    shared = np.zeros(len(keys), bool)
    shared[by_key[1:]] |= equal
    shared[by_key[:-1]] |= equal
    n = np.bincount(owner[shared], minlength=len(refs))
    has = np.flatnonzero(n)
    return pa.table({"d1": pa.array(refs[has, 0]), "d2": pa.array(refs[has, 1]), "shared": pa.array(n[has].astype(np.int64))})


def _send_survivors(width: int, buckets: int):
    """Blocks of survivors' shingles, 64 bits each, with the class as reference."""

    def run(batches):
        shingler = Shingler(width)
        for batch in slices(batches):
            d1, d2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d1", "d2"))
            for first, at, keys in shingler.sets(batch.column("text")):
                # Rows that share an id but not the text of their class's first document drop out here.
                right = [a < b and _digest(keys[a:b]) == (d1[first + i], d2[first + i]) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
                sizes = np.diff(at) * right
                found = list(_blocks_of(d1[first : first + len(right)].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]), keys[np.repeat(right, np.diff(at))], buckets, True))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([p for _, p in found], pa.binary())], ["bucket", "payload"])

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """In one bucket: each survivor's shingles with the number of survivors that have them."""
    blocks = [_unpack(p, np.uint32, np.int64, np.uint64) for p in table.column("payload").to_pylist()]
    counts, refs, keys = np.concatenate([b[0] for b in blocks]).astype(np.int64), np.concatenate([b[1] for b in blocks]), np.concatenate([b[2] for b in blocks])
    order = np.argsort(refs, kind="stable")
    owner = np.repeat(np.arange(len(refs)), counts)
    twice = np.zeros(len(refs), bool)  # equal rows send equal blocks
    twice[order[1:]] = refs[order[1:]] == refs[order[:-1]]
    keys = keys[~twice[owner]]
    refs, counts = refs[~twice], counts[~twice]
    _, inverse, df = np.unique(keys, return_inverse=True, return_counts=True)
    edges = np.concatenate([[0], np.cumsum(counts)])
    df = df[inverse].astype(np.uint32)
    return pa.table({"class": pa.array(refs), "keys": pa.array([keys[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()), "df": pa.array([df[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())})


def _rank(batches):
    """Shingles rare first (ties by hash), and the prefix's shared ones."""
    for batch in slices(batches):
        ranked, prefix, sizes = [], [], []
        for parts in batch.column("parts").to_pylist():
            keys = np.concatenate([np.frombuffer(p["keys"], np.uint64) for p in parts])
            df = np.concatenate([np.frombuffer(p["df"], np.uint32) for p in parts])
            order = np.lexsort((keys, df))
            n = len(keys)
            head = order[: n - _ceil(PERCENT, n) + 1]
            ranked.append(keys[order].tobytes())
            prefix.append(keys[head[df[head] > 1]].view(np.int64))
            sizes.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(sizes, pa.int64()), pa.array(ranked, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], ["class", "n", "ranked", "prefix"])


def _dense(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """Which of the columns (sorted hashes) each set has, as a matrix of 0 and 1."""
    out = np.zeros((len(sets), len(columns)), np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(columns, s)
        at[at == len(columns)] = 0
        out[i, at[columns[at] == s]] = 1
    return out


def _shared_columns(a: list[np.ndarray], b: list[np.ndarray], within: bool) -> np.ndarray:
    """Hashes that two sets can share."""
    if within:
        values, n = np.unique(np.concatenate(a), return_counts=True)
        return values[n > 1]
    return np.intersect1d(np.concatenate(a), np.concatenate(b))


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], within: bool, step: int = 4096) -> np.ndarray:
    columns = _shared_columns(a, b, within)
    out = np.zeros((len(a), len(b)), np.float32)
    for k in range(0, len(columns), step):
        left = _dense(a, columns[k : k + step])
        out += left @ (left if within else _dense(b, columns[k : k + step])).T
    return out


def _candidates(a: list[np.ndarray], b: list[np.ndarray], within: bool) -> np.ndarray:
    """Pairs that pass the prefix, length, positional and suffix filters, as a matrix of booleans.  Sets are ordered rare first."""
    m, n = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    need = np.ceil(PERCENT * (m[:, None] + n[None, :]) / (100 + PERCENT) - 1e-9)
    length = 100 * np.minimum(m[:, None], n[None, :]) >= PERCENT * np.maximum(m[:, None], n[None, :])
    heads = lambda sets: [s[: len(s) - _ceil(PERCENT, len(s)) + 1] for s in sets]
    head_a, head_b = heads(a), heads(b)
    in_heads = _overlaps([np.sort(h) for h in head_a], [np.sort(h) for h in head_b], within)
    # Positional: what both prefixes share, and at most the shorter rest; a shingle of one prefix may lie in the other's rest.
    rest = np.minimum(m - [len(h) for h in head_a], 1 << 30)[:, None], (n - [len(h) for h in head_b])[None, :]
    bound = in_heads + np.maximum(np.minimum(rest[0], n[None, :] - in_heads), np.minimum(rest[1], m[:, None] - in_heads))
    passed = (in_heads > 0) & length & (bound >= need)
    # Suffix: the rest of both sets falls into bins by hash; sets share at most the lesser count of each bin.
    bins = lambda sets: np.array([np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=BINS) for s in sets], np.float32).reshape(len(sets), BINS)
    bins_a, bins_b = bins(a), bins(b)
    for i in np.flatnonzero(passed.any(axis=1)):
        j = np.flatnonzero(passed[i])
        passed[i, j] = np.minimum(bins_a[i], bins_b[j]).sum(axis=1) >= need[i, j]
    return passed


def _links(ids_a: np.ndarray, a: list[np.ndarray], members_a: np.ndarray, ids_b: np.ndarray, b: list[np.ndarray], members_b: np.ndarray, within: bool) -> list[tuple[int, int | None, int]]:
    """A spanning forest of the verified links between two tiles, or within one, as (u, v, 0); and per class, the members of the classes it links with here, as (u, None, members)."""
    passed = _candidates(a, b, within)
    if within:
        passed &= np.triu(np.ones_like(passed), 1)
    left, right = np.flatnonzero(passed.any(axis=1)), np.flatnonzero(passed.any(axis=0))
    if not len(left):
        return []
    both = _overlaps([np.sort(a[i]) for i in left], [np.sort(b[j]) for j in right], False)
    m, n = np.array([len(a[i]) for i in left]), np.array([len(b[j]) for j in right])
    linked = passed[np.ix_(left, right)] & (100 * both >= PERCENT * (m[:, None] + n[None, :] - both))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        u, v = int(ids_a[left[i]]), int(ids_b[right[j]])
        if root(u) != root(v):
            parent[root(u)] = root(v)
            out.append((u, v, 0))
    for ids, n in ((ids_a[left], linked @ members_b[right]), (ids_b[right], members_a[left] @ linked)):
        out += [(int(u), None, int(k)) for u, k in zip(ids, n, strict=True) if k]
    return out


def _verify_tiles(table: pa.Table) -> pa.Table:
    """One pair of tiles: rows of side 0, and of side 1 unless a tile meets itself."""
    sides = np.array(table.column("side").to_pylist())
    ids, members = table.column("class").to_numpy(), table.column("members").to_numpy()
    sets = [np.frombuffer(r, np.uint64) for r in table.column("ranked").to_pylist()]
    a, b = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    within = not len(b)
    b = a if within else b
    found = _links(ids[a], [sets[i] for i in a], members[a], ids[b], [sets[i] for i in b], members[b], within)
    return pa.table({name: pa.array([x[k] for x in found], pa.int64()) for k, name in enumerate(("u", "v", "members"))})


def describe_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: ``doc_id``, ``text_hash``, ``n_shingles`` and the set's digest (``d1``, ``d2``; null if empty)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(_describe(width), "doc_id long, text_hash long, n_shingles long, d1 long, d2 long")


def class_links(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Links ``(u, v, 0)`` between classes ``(d1, d2, first, n_shingles, members)``, by ``d1``, that span the components of all links, and rows ``(u, null, members)`` whose sum by ``u`` is the number of documents in linked classes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = buckets_for(text_bytes_total(rows, "text") // 6, BUCKET, LEAST_BUCKETS)
    shared = rows.select("text").mapInArrow(_send_sets(width, buckets), "bucket int, payload binary").groupBy("bucket").applyInArrow(_shared_counts, "d1 long, d2 long, shared long")
    shared = shared.groupBy("d1", "d2").agg(F.sum("shared").alias("shared"))
    survivors = cut(classes.join(shared, ["d1", "d2"]).where(100 * F.col("shared") >= PERCENT * F.col("n_shingles")).select(F.col("first").alias("doc_id"), "d1", "d2", "n_shingles", "members"), "survivors")
    few = buckets_for(survivors.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0, BUCKET // 4, LEAST_BUCKETS)
    texts = likely(rows, survivors, ["doc_id"]).join(survivors, "doc_id")
    parts = texts.select("doc_id", "d1", "d2", "text").mapInArrow(_send_survivors(width, few), "bucket int, payload binary").groupBy("bucket").applyInArrow(_frequencies, "class long, keys binary, df binary")
    ranked = cut(parts.groupBy("class").agg(F.collect_list(F.struct("keys", "df")).alias("parts")).mapInArrow(_rank, "class long, n long, ranked binary, prefix array<long>"), "ranked")
    heads = ranked.select("class", F.explode("prefix").alias("key"))
    # Tiles: each class takes the least class it meets over prefix shingles, twice, and shares that one's tiles.
    label = lambda known: known.groupBy("key").agg(F.min("label").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    once = heads.join(label(heads.withColumn("label", F.col("class"))), "key").groupBy("class").agg(F.min("least").alias("label"))
    twice = heads.join(once, "class")
    labels = cut(twice.join(label(twice), "key").groupBy("class").agg(F.min("least").alias("label")).join(survivors.select(F.col("d1").alias("class"), "n_shingles", "members"), "class"), "labels")
    sizes = cut(labels.groupBy("label").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n_shingles") / TILE_SHINGLES)).alias("parts")), "label-parts")
    tiles = cut(labels.join(sizes, "label").select("class", "members", F.xxhash64("label", F.pmod(F.xxhash64("class"), "parts").cast("int")).alias("tile")), "tiles")
    by_key = heads.join(tiles.select("class", "tile"), "class").select("key", "tile").distinct()
    x, y = by_key.alias("x"), by_key.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.tile") < F.col("y.tile"))).select(F.col("x.tile").alias("a"), F.col("y.tile").alias("b")).distinct()
    pairs = cut(pairs.unionByName(tiles.select(F.col("tile").alias("a"), F.col("tile").alias("b")).distinct()), "tile-pairs")
    sets = ranked.select("class", "ranked").join(tiles, "class")
    side = lambda k, own, which: which.join(sets.withColumnRenamed("tile", own), own).select("a", "b", F.lit(k).alias("side"), "class", "members", "ranked")
    met = side(0, "a", pairs).unionByName(side(1, "b", pairs.where("a <> b")))
    return met.groupBy("a", "b").applyInArrow(_verify_tiles, "u long, v long, members long")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: ``doc_id``, ``text_hash`` (with the id, it names the row), ``n_shingles``, ``class_id`` (first document with the same set), ``component_id`` (least document that links reach) and ``n_links``, the documents it links with."""
    info = cut(describe_sets(docs, id_col, text_col, width), "sets")
    classes = cut(info.where("d1 is not null and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("members")), "classes")
    links = cut(class_links(docs, classes, id_col, text_col, width), "class-links")
    linked = cut(components(links.where("v is not null").select("u", "v")).withColumnRenamed("node", "d1").join(classes.select("d1", "first"), "d1"), "linked")
    least = cut(linked.groupBy("component").agg(F.min("first").alias("least")), "least")
    others = links.where("v is null").groupBy(F.col("u").alias("d1")).agg(F.sum("members").alias("others"))
    known = cut(linked.join(least, "component").select("d1", "least").join(others, "d1", "left"), "known")
    named = classes.join(known, "d1", "left").select("d1", "d2", "first", F.coalesce("least", "first").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    of = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id"))
    return info.join(named, ["d1", "d2"], "left").select("doc_id", "text_hash", "n_shingles", of("first").alias("class_id"), of("component").alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0).cast("long"))).alias("n_links"))
