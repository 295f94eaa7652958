"""Relational operators over a registry of records and long-format facts.

All take and return DataFrames; ties are always broken by named columns.  Ranking filters are written as
``row_number() <= k``, which Spark cuts to k rows a group before the shuffle, and global ones as
``orderBy().limit()``, which it plans without a full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COMPARATORS = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


def compare(value: Column, comparator: str, threshold: float) -> Column:
    """One of gt, gte, lt, lte; an unknown comparator is an error rather than a guess."""
    return COMPARATORS[comparator](value, F.lit(threshold))


def extremum(df: DataFrame, value: str, tie: str, k: int = 3, largest: bool = True) -> DataFrame:
    """The extreme row and its k - 1 runners-up, ranked from 1; nulls never win."""
    order = [F.col(value).desc() if largest else F.col(value).asc(), F.col(tie).asc()]
    top = df.where(F.col(value).isNotNull()).orderBy(*order).limit(k)
    return top.withColumn("rk", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))


def extremum_by_group(df: DataFrame, group: str, value: str, tie: str, k: int = 3, largest: bool = True) -> DataFrame:
    order = [F.col(value).desc() if largest else F.col(value).asc(), F.col(tie).asc()]
    ranked = df.where(F.col(value).isNotNull()).withColumn("rk", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("rk") <= k).withColumn("rk", F.col("rk").cast("long"))


def group_counts_with_total(df: DataFrame, group: str) -> DataFrame:
    """Rows of each group, and of all under a null group: one pass by grouping sets."""
    return df.rollup(group).agg(F.count("*").alias("n"), F.grouping(group).cast("long").alias("is_total"))


def missing_keys(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Expected keys without an actual row; an operator that needs full coverage declines unless this is empty."""
    return expected.join(actual.select(key), key, "left_anti")


def complete(expected: DataFrame, actual: DataFrame, key: str) -> bool:
    return missing_keys(expected, actual, key).isEmpty()


def without_totals(df: DataFrame, table: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Drop rows that state the total of the others in their table (three rows at least)."""
    sums = df.groupBy(*table).agg(F.sum(value).alias("_all"), F.count(value).alias("_n"))
    is_total = (F.col("_n") >= 3) & (F.abs(2 * F.col(value) - F.col("_all")) <= F.greatest(F.lit(1e-9), F.abs(F.col(value)) * tolerance))
    return df.join(sums, table).where(~F.coalesce(is_total, F.lit(False))).drop("_all", "_n")


def field_coverage(facts: DataFrame, record: str = "record_id", field: str = "field") -> DataFrame:
    return facts.groupBy(field).agg(F.countDistinct(record).alias("n_records"), F.count("*").alias("n_facts"))


def field_catalog(facts: DataFrame, n_records: Column, share: float = 0.3, least: int = 2, record: str = "record_id", field: str = "field") -> DataFrame:
    """Fields that at least max(least, round(share x records)) records hold (half to even)."""
    floor = F.greatest(F.lit(least).cast("double"), F.bround(n_records * F.lit(share), 0))
    return field_coverage(facts, record, field).where(F.col("n_records") >= floor)


def modal_value(df: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group, the least of equals."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.max("n").alias("n")).join(counts, [group, "n"]).groupBy(group, "n").agg(F.min(value).alias(value))


def unit_outliers(facts: DataFrame, record: str = "record_id", field: str = "field", unit: str = "unit") -> DataFrame:
    """Per field with more than one unit and no record holding two: the record whose unit nobody shares, if it is the only one."""
    per_record = facts.groupBy(field, record).agg(F.countDistinct(unit).alias("n_units"), F.min(unit).alias(unit))
    by_unit = per_record.groupBy(field, unit).agg(F.count("*").alias("n"), F.min(record).alias(record), F.max("n_units").alias("most"))
    per_field = by_unit.groupBy(field).agg(F.count("*").alias("units"), F.max("most").alias("most"), F.count_if(F.col("n") == 1).alias("odd"), F.min_by(F.struct(record, unit), "n").alias("who"), F.max("n").alias("usual"))
    hit = (F.col("units") > 1) & (F.col("most") == 1) & (F.col("odd") == 1) & (F.col("usual") > 1)
    return per_field.where(hit).select(field, F.col(f"who.{record}").alias(record), F.col(f"who.{unit}").alias(unit))


def claim_conflicts_in_group(claims: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """Claims of being largest in a group that another member of it exceeds, with the largest such peer.

    The largest peer of every claim is the group's extremum, so an aggregate replaces the self join: rows
    stay as many as claims, however large a group is.
    """
    best = claims.groupBy(group).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(key)).alias("k"))).alias("best"))
    return claims.join(best, group).where(F.col("best.v") > F.col(value)).select(*claims.columns, (-F.col("best.k")).alias("peer"), F.col("best.v").alias("peer_value"))


def claim_conflicts_universal(claims: DataFrame, value: str, key: str) -> DataFrame:
    """The same over the whole registry: one row of extremum meets every claim."""
    best = claims.agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(key)).alias("k"))).alias("best"))
    return claims.join(F.broadcast(best)).where(F.col("best.v") > F.col(value)).select(*claims.columns, (-F.col("best.k")).alias("peer"), F.col("best.v").alias("peer_value"))


def closest_dates(events: DataFrame, years: DataFrame, key: str) -> DataFrame:
    """Per key, the years between an event and a founding year; the closest first, with the margin to the next."""
    diff = events.join(years, key).withColumn("diff", F.abs(F.col("event_year") - F.col("base_year")))
    top = diff.orderBy("diff", key).limit(2)
    order = W.partitionBy(F.lit(0)).orderBy("diff", key)
    return top.withColumn("rk", F.row_number().over(order).cast("long")).withColumn("margin", F.lead("diff").over(order) - F.col("diff"))


def range_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points joined to the ranges that hold them: an equi-join on bins of ``width``, checked exactly.

    A range is repeated for each bin it touches, so a width near the usual range keeps both sides small.
    """
    binned = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return points.withColumn("_bin", F.floor(F.col(at) / width)).join(binned, "_bin").where(F.col(at).between(F.col(start), F.col(end))).drop("_bin")


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def preferred_fill(preferred: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Preferred rows, and fallback rows only for keys that have none."""
    return preferred.unionByName(fallback.join(preferred.select(key).distinct(), key, "left_anti"))


def merge_by_priority(left: DataFrame, right: DataFrame, key: str, status: str, rank: dict[str, int]) -> DataFrame:
    """Full merge of two status tables: the status of higher rank wins, the left one among equals."""
    order = F.create_map(*(F.lit(x) for pair in rank.items() for x in pair))
    a, b = left.select(key, F.col(status).alias("_a")), right.select(key, F.col(status).alias("_b"))
    both = a.join(b, key, "full_outer")
    better = F.coalesce(order[F.col("_b")], F.lit(-1)) > F.coalesce(order[F.col("_a")], F.lit(-1))
    return both.select(key, F.when(better, F.col("_b")).otherwise(F.col("_a")).alias(status))


def first_of_each(df: DataFrame, conditions: dict[str, Column], order: list[str], keep: str) -> DataFrame:
    """One row with the first match of each condition; no row unless all are met (a relation needs every part)."""
    firsts = df.agg(*(F.min(F.when(c, F.struct(*order, F.col(keep).alias("_keep")))).alias(n) for n, c in conditions.items()))
    return firsts.select(*(F.col(f"{n}._keep").alias(n) for n in conditions)).where(" AND ".join(f"{n} IS NOT NULL" for n in conditions))
