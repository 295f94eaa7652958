"""Mixing sources to target weights by capped water-filling.

Sources share the total by weight; a source whose share exceeds ``max_epochs`` times its
size is clamped there, and the excess goes to the others by weight until no share is
above its cap.  With sources ordered by cap over weight, the clamped ones are a prefix, so
one ordered pass finds the level; it runs over one row for each source.

A source with target r times its size takes every document floor(r) times and a seeded
sample once more.  The sample fills what is left by classes of document size, largest first: within
a class, documents follow in the order of a seeded hash, dealt to bins; the cut is the bin edge
nearest to the class's part plus what larger classes left open, so the error shrinks to
about a small document.  Bins are summed in Spark before one source's classes (at most
64 x ``BINS`` rows) meet.

Defined results: a null or blank text has size 0 and takes nothing; a null source is a source
of its own, after all others; equal rows are taken alike; no rows give no rows; other columns pass through, but those whose
names begin with ``mix_`` or ``_mix_`` are replaced.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, words

#: Bins of the seeded hash within a size class.
BINS = 1 << 10


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """Sources in code-point order, null last, with ``weights`` in turn."""
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (order % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, total: Column, max_epochs: float = 3.0) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): one row a source, so a single ordered pass is bounded."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    up = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(W.unboundedPreceding, -1)
    from_here = up.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here)
    first_open = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(W.partitionBy())
    filled = sources.withColumn("cap", cap).withColumn("total", total).withColumn("level", level).withColumn("place", F.row_number().over(up)).withColumn("open", first_open)
    target = F.when(F.col("open").isNull() | (F.col("place") < F.col("open.place")), F.col("cap")).otherwise(F.col("open.level") * F.col("weight"))
    return filled.withColumn("target", target).select(*sources.columns, "target")


def _cuts(bins: pd.DataFrame) -> pd.DataFrame:
    """For one source: the bin from which a class's documents are not sampled."""
    left = float(bins["target"].iloc[0]) - int(bins["whole"].iloc[0]) * float(bins["source_size"].iloc[0])
    share = left / max(float(bins["source_size"].iloc[0]), 1.0)
    out, carry = [], 0.0
    for size_class, own in sorted(bins.groupby("size_class"), key=lambda x: -x[0]):
        own = own.sort_values("bin")
        sums = [0, *own["size"].cumsum()]
        edges = [0, *(own["bin"] + 1)]
        want = share * sums[-1] + carry
        k = min(range(len(sums)), key=lambda i: abs(sums[i] - want))
        carry = want - sums[k]
        out.append((bins["source"].iloc[0], size_class, edges[k]))
    return pd.DataFrame(out, columns=["source", "size_class", "cut"])


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` (of its source) and ``mix_times`` (whole repetitions, the sampled one included)."""
    size = F.size(words(F.col(text_col))).cast("long")
    sized = (
        docs.drop(*(c for c in docs.columns if c.lower().startswith(("mix_", "_mix_")) and c not in (id_col, text_col, source_col)))
        .withColumn("mix_size", size)
        .withColumn("mix_class", F.floor(F.log2(F.col("mix_size") + 1)).cast("int"))
        .withColumn("mix_bin", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(BINS)).cast("int"))
    )
    bins = sized.groupBy(F.col(source_col).alias("source"), F.col("mix_class").alias("size_class"), F.col("mix_bin").alias("bin")).agg(F.sum("mix_size").alias("size"))
    sizes = bins.groupBy("source").agg(F.sum("size").alias("source_size"))
    total = F.sum("source_size").over(W.partitionBy()).cast("double")
    targets = water_fill(cyclic_weights(sizes, weights), total, max_epochs).withColumn("whole", F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)))
    named = targets.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    cuts = (
        bins.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
        .drop("source")
        .join(named, "key")
        .groupBy("key")
        .applyInPandas(_cuts, "source string, size_class int, cut int")
        .withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
        .groupBy("key")
        .agg(F.map_from_entries(F.collect_list(F.struct("size_class", "cut"))).alias("cuts"))
    )
    # One row a source; written, its size is known, and Spark broadcasts it or not by that.
    plan = cut(named.join(cuts, "key").select(F.col("key").alias("_mix_key"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("whole").alias("_mix_whole"), F.col("cuts").alias("_mix_cuts")), "mix-plan")
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit(""))
    taken = F.col("_mix_whole") + F.when(F.col("mix_bin") < F.try_element_at(F.col("_mix_cuts"), F.col("mix_class")), 1).otherwise(0)
    return sized.withColumn("_mix_key", key).join(plan, "_mix_key").withColumn("mix_times", F.least(taken, F.lit(int(max_epochs))).cast("long")).drop("_mix_key", "mix_class", "mix_bin", "_mix_whole", "_mix_cuts")


def repeat_documents(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed.where("mix_times > 0").select(*(F.col(f"`{c}`") for c in columns), F.explode(F.sequence(F.lit(1), F.col("mix_times").cast("int"))).alias("_mix_copy")).drop("_mix_copy")
