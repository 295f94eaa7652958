"""Benchmark decontamination by spaced seeds, in built-in functions only.

Texts are read as lower-case runs of letters and digits; in scripts without blanks each character is a
word.  A seed is a fixed mask over ``SPAN``
successive words: it hashes the words at its marked places and ignores the others, so a passage
with substituted words still meets the benchmark wherever one placement misses the
substitutions.  Hashes of benchmark items and of documents are joined; a hit fixes the
alignment of document and item, and around each hit the words are compared place by place.
A leak is a hit around which at least ``SIMILAR`` of the compared words are equal, of those inside both texts, or
else of the ``SPAN`` words of the hit itself: a quote of part of an item counts as well.

The benchmark is the small side: its hashes are broadcast in blocks of at most ``BLOCK_HASHES``
(some tens of MB each); a larger benchmark takes more blocks, each a pass over the documents.

An item of fewer than ``SPAN`` words has seeds of its length alone, which are tried only if the benchmark has such items:
its places are dealt to three groups, or to four from 8 words on, and each seed leaves out one, or two, of them, so some seed
misses all the substitutions that ``SIMILAR`` allows.  An item of fewer than ``LEAST_WORDS`` words, which any text may hold by
chance, leaks into documents that hold nothing else.

Defined results: null and blank texts have no words and leak nothing; equal items are reported each; rows that share an id are
told apart by their text, and equal rows are reported each; columns other than ids and texts are not read; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let
from .shared import cut, likely

#: Marked places of each seed: weight 7 of 11.
SEEDS = ((0, 1, 2, 4, 7, 8, 10), (0, 2, 3, 6, 8, 9, 10))
SPAN = 11
LEAST_WORDS, AROUND, SIMILAR, BLOCK_HASHES = 5, 8, 0.75, 1 << 20


#: Characters of scripts that set no blanks between words: Thai to Myanmar, Khmer, kana, Han.
UNSPACED = r"([\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{323AF}])"


def _with_words(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``_words``: strings between blanks and signs, blank ones among them.  Plain columns step by step, which generated code computes once each."""
    low = df.withColumn("_low", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    spaced = low.withColumn("_spaced", F.when(F.length("_low") == F.octet_length("_low"), F.col("_low")).otherwise(F.regexp_replace("_low", UNSPACED, " $1 ")))
    return spaced.withColumn("_words", F.split("_spaced", r"[^\p{L}\p{N}]+")).drop("_low", "_spaced")


def _hashed(words: Column) -> Column:
    """A hash for each word, from place 0."""
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _masks(n: int) -> list[tuple[int, ...]]:
    """Seeds for an item of n words, fewer than ``SPAN``."""
    if n < LEAST_WORDS:
        return [tuple(range(n))]
    groups, left_out = (3, 1) if int((1 - SIMILAR) * n) < 2 else (4, 2)
    return [tuple(i for i in range(n) if i % groups not in gone) for gone in combinations(range(groups), left_out)]


def _keys(h: Column, seeds: list[tuple[int, tuple[int, ...]]]) -> Column:
    """(key, place) of every placement of every seed; the place of its first word, from 0."""
    return F.concat(*(_placements(h, k, n, seed) for k, (n, seed) in enumerate(seeds)))


def _placements(h: Column, k: int, n: int, seed: tuple[int, ...]) -> Column:
    """Of seed k over n words; seeds of very short items lie on texts of just their length."""
    last = F.size(h) - n + 1
    fits = last >= 1 if n >= LEAST_WORDS else last == 1
    places = F.when(fits, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(F.xxhash64(F.lit(k), *(h[i + o] for o in seed)).alias("key"), i.alias("place")))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each leak: ``doc_id``, ``item_id``, ``text_hash`` (with the id, it names the row), ``n_equal`` of ``n_compared`` words around the best hit, and ``first_word`` of the item in the document."""
    texts = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    items = cut(_with_words(texts, "text").select("item_id", _hashed(F.col("_words")).alias("item")).where(F.size("item") > 0), "items")
    lengths = sorted(r["n"] for r in items.select(F.least(F.size("item"), F.lit(SPAN)).alias("n")).distinct().collect())  # SPAN values at most
    seeds = [(n, seed) for n in lengths for seed in (SEEDS if n == SPAN else _masks(n))]
    # Items of SPAN words and more take the spaced seeds; the others serve only items of just their length.
    def seeded_items(k: int, n: int, seed: tuple[int, ...]) -> DataFrame:
        own = items.where(F.size("item") >= SPAN if n == SPAN else F.size("item") == n)
        return own.select("item_id", F.explode(_placements(F.col("item"), k, n, seed)).alias("x")).select("item_id", "x.key", F.col("x.place").alias("item_place"))

    none = items.limit(0).select("item_id", F.lit(0).cast("long").alias("key"), F.lit(0).alias("item_place"))
    seeded = cut(reduce(DataFrame.unionByName, (seeded_items(k, n, seed) for k, (n, seed) in enumerate(seeds)), none), "seeds")
    blocks = max(1, -(-seeded.count() // BLOCK_HASHES))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    placed = _with_words(keyed, "text").select("doc_id", "text_hash", F.explode(let(_hashed(F.col("_words")), lambda h: _keys(h, seeds or [(SPAN, SEEDS[0])]))).alias("x")).select("doc_id", "text_hash", "x.key", "x.place")
    hits = None
    for b in range(blocks):
        part = seeded.where(F.pmod("key", F.lit(blocks)) == b)
        found = placed.join(F.broadcast(part), "key").groupBy("doc_id", "text_hash", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).agg(F.collect_set("item_place").alias("places"))
        hits = found if hits is None else hits.unionByName(found)
    hits = cut(hits.groupBy("doc_id", "text_hash", "item_id", "shift").agg(F.flatten(F.collect_list("places")).alias("places")), "hits")
    texts = likely(keyed, hits, ["text_hash"])
    checked = hits.join(items, "item_id").join(texts, (texts["doc_id"].eqNullSafe(hits["doc_id"])) & (texts["text_hash"] == hits["text_hash"])).select(hits["doc_id"], hits["text_hash"], "item_id", "shift", "places", "item", "text")
    return _verified(_with_words(checked, "text"))


def _verified(candidates: DataFrame) -> DataFrame:
    def compare(h: Column) -> Column:
        equal = F.transform(F.col("item"), lambda x, i: F.when((i + F.col("shift") >= 0) & (i + F.col("shift") < F.size(h)), F.when(h[F.greatest(F.least(i + F.col("shift"), F.size(h) - 1), F.lit(0))] == x, 1).otherwise(0)).otherwise(0))

        def around(e: Column) -> Column:
            def one(q: Column) -> Column:
                def share(first: Column, last: Column) -> Column:
                    return let(F.aggregate(F.slice(e, first + 1, last - first), F.lit(0), lambda s, x: s + x), lambda n: F.struct((n / (last - first)).alias("share"), n.alias("n_equal"), (last - first).alias("n_compared")))

                wide = share(F.greatest(q - AROUND, F.lit(0), -F.col("shift")), F.least(q + SPAN + AROUND, F.size(e), F.size(h) - F.col("shift")))
                return let(wide, lambda w: F.when(w["share"] >= SIMILAR, w).otherwise(share(q, F.least(q + SPAN, F.size(e)))))

            return F.array_max(F.transform("places", one))

        return let(equal, around)

    best = let(_hashed(F.col("_words")), compare)
    scored = candidates.select("doc_id", "text_hash", "item_id", F.col("shift").alias("first_word"), best.alias("best")).where(F.col("best.share") >= SIMILAR)
    top = scored.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("best.share", "best.n_equal", "best.n_compared", (-F.col("first_word")).alias("before"))).alias("top"))
    return top.select("doc_id", "item_id", "text_hash", F.col("top.n_equal").cast("long").alias("n_equal"), F.col("top.n_compared").cast("long").alias("n_compared"), (-F.col("top.before")).cast("long").alias("first_word"))
