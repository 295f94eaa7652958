"""Order-sensitive operators: islands, spans, forward fill, greedy packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], at: str, block: int = 1 << 16) -> DataFrame:
    """Runs of consecutive integers per key: ``(keys, first, last, n)``.

    Runs are found inside blocks of ``at`` first, each block a window partition of its own, and only the
    runs (as few as the data allows) are merged across block edges, so one key may hold most rows.
    """
    cut = df.select(*keys, F.col(at).alias("at")).distinct().withColumn("block", F.floor(F.col("at") / block))
    inner = W.partitionBy(*keys, "block").orderBy("at")
    runs = cut.withColumn("run", F.col("at") - F.row_number().over(inner)).groupBy(*keys, "block", "run").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    # Only runs that touch a block edge can go on elsewhere.
    edge = (F.col("first") % block == 0) | (F.col("last") % block == block - 1)
    whole, open_ = runs.where(~edge).select(*keys, "first", "last"), runs.where(edge)
    outer = W.partitionBy(*keys).orderBy("first")
    starts = open_.withColumn("new", F.coalesce((F.col("first") != F.lag("last").over(outer) + 1).cast("int"), F.lit(1)))
    merged = starts.withColumn("chain", F.sum("new").over(outer)).groupBy(*keys, "chain").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("chain")
    return whole.unionByName(merged).withColumn("n", F.col("last") - F.col("first") + 1)


def lead_spans(df: DataFrame, key: str, order: list[str], start: str, default: Column, block: Column | None = None) -> DataFrame:
    """Adds ``span_end``: the next row's start within the key, or ``default`` for the last.

    With a ``block`` that never falls along the order (the day of a time), a key that holds most rows is read block by block, and only the
    blocks' first starts meet.
    """
    if block is None:
        return df.withColumn("span_end", F.coalesce(F.lead(start).over(W.partitionBy(key).orderBy(*order)), default))
    cut = df.withColumn("_block", block)
    firsts = cut.groupBy(key, "_block").agg(F.min_by(start, F.struct(*order)).alias("_first"))
    after = firsts.select(key, "_block", F.lead("_first").over(W.partitionBy(key).orderBy("_block")).alias("_next"))
    inside = cut.withColumn("_lead", F.lead(start).over(W.partitionBy(key, "_block").orderBy(*order)))
    return inside.join(after, [key, "_block"]).withColumn("span_end", F.coalesce("_lead", "_next", default)).select(*df.columns, "span_end")


def forward_fill(df: DataFrame, key: str, order: list[str], value: str, into: str, block: Column | None = None) -> DataFrame:
    """The last value that is not null, up to and including the row; ``block`` as for ``lead_spans``."""
    filled = lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    if block is None:
        return df.withColumn(into, filled(value, W.partitionBy(key).orderBy(*order)))
    cut = df.withColumn("_block", block)
    lasts = cut.groupBy(key, "_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    carried = lasts.select(key, "_block", before.alias("_before"))
    inside = cut.withColumn("_own", filled(value, W.partitionBy(key, "_block").orderBy(*order)))
    return inside.join(carried, [key, "_block"]).withColumn(into, F.coalesce("_own", "_before")).select(*df.columns, into)


def pack_numbers(sizes: Column, max_items: int, max_size: int) -> Column:
    """Batch number (from 1) of each item, packed greedily in order; an item over the limit stands alone."""
    start = F.struct(F.lit(1).alias("batch"), F.lit(0).alias("items"), F.lit(0).cast("long").alias("size"), F.array().cast("array<int>").alias("out"))

    def add(s: Column, size: Column) -> Column:
        flush = (s["items"] > 0) & ((s["items"] >= max_items) | (s["size"] + size > max_size))
        batch = s["batch"] + flush.cast("int")
        return F.struct(batch.alias("batch"), (F.when(flush, 0).otherwise(s["items"]) + 1).alias("items"), (F.when(flush, F.lit(0).cast("long")).otherwise(s["size"]) + size).alias("size"), F.array_append(s["out"], batch).alias("out"))

    return F.aggregate(sizes, start, add, lambda s: s["out"])


def pack_records(df: DataFrame, document: str, order: str, size: str, max_items: int = 3, max_size: int = 18_000) -> DataFrame:
    """``(document, order, size, batch)``: the records of each document packed in order."""
    listed = df.groupBy(document).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(size).cast("long").alias("size")))).alias("items"))
    packed = listed.withColumn("batches", pack_numbers(F.transform("items", lambda i: i["size"]), max_items, max_size))
    each = packed.select(document, F.explode(F.arrays_zip("items", "batches")).alias("x"))
    return each.select(document, F.col("x.items.at").alias(order), F.col("x.items.size").alias(size), F.col("x.batches").cast("long").alias("batch"))


def fixed_chunks(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Chunk number (from 0) of n rows each, in order."""
    return df.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy(key).orderBy(order)) - 1) / n))
