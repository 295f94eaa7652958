"""Where documents, runs and answers are kept: Parquet tables partitioned by document or run, and a submission file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class RunStore:
    """Tables below one root in any store that Spark reaches; Spark's commit protocol makes each write all or nothing."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, df: DataFrame, table: str, by: str = "document_id") -> None:
        """Replace the partitions that ``df`` holds, and no others."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.root}/{table}")

    def load(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}")

    def load_of(self, table: str, ids: list[str], by: str = "document_id") -> DataFrame:
        """Rows of some documents or runs: their partitions alone are read."""
        return self.load(table).where(F.col(by).isin(ids))

    def stale(self, compiled: str, version: str) -> DataFrame:
        """Documents compiled by another version, to be compiled anew."""
        return self.load(compiled).where(F.col("compiler_version") != version).select("document_id")

    def misses(self, wanted: DataFrame, table: str, key: str = "cache_key") -> DataFrame:
        """Wanted rows whose result is not kept yet."""
        return wanted.join(self.load(table).select(key).distinct(), key, "left_anti")


def cache_key(*parts: Column) -> Column:
    """Content key of a result: the hash of everything it depends on."""
    return F.substring(F.sha2(F.to_json(F.struct(*(p.alias(f"p{k}") for k, p in enumerate(parts)))), 256), 1, 28)


def upserted(submission: DataFrame, answers: DataFrame) -> DataFrame:
    """A submission ``(ordinal, id, answer, error, evidence)`` with new answers ``(question_id, answer, result_value, pages, note)`` in place; other rows, and their order, stay."""
    asked = submission.select(F.col("id").alias("question_id"), "ordinal").join(answers.select("question_id").distinct(), "question_id", "left_semi")
    fresh = submission_rows(asked, answers)
    return submission.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


def evaluation_sink(metrics: DataFrame, folder: str) -> None:
    """Evaluation rows as CSV with a header, and as JSON lines."""
    metrics.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    metrics.write.mode("overwrite").json(f"{folder}/json")


def submission_rows(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """``(question_id, ordinal)`` with ``(question_id, answer, result_value, pages, note)`` as rows in question order: id, answer, error, evidence.

    An answer that begins with ``Error:`` gives way to the computed value; a question without an answer is pending.
    """
    joined = questions.join(answers, "question_id", "left")
    failed = F.coalesce(F.col("answer").startswith("Error:"), F.lit(False))
    text = F.when(failed & F.col("result_value").isNotNull(), F.col("result_value")).otherwise(F.col("answer"))
    error = F.when(F.col("answer").isNull(), "Pending").when(failed & F.col("result_value").isNull(), F.col("answer")).when(F.trim(text) == "", "Empty answer")
    pages = F.when(F.size(F.coalesce("pages", F.array().cast("array<int>"))) > 0, F.concat(F.lit("Source pages/segments: "), F.array_join("pages", ", ")))
    return joined.select("ordinal", F.col("question_id").alias("id"), F.when(error.isNull(), text).otherwise("").alias("answer"), error.alias("error"), F.concat_ws(" ", "note", pages).alias("evidence"))


def submission_json(rows: DataFrame, team: str | None = None, notes: str | None = None) -> DataFrame:
    """The whole submission as one JSON text; a submission is as long as its list of questions."""
    item = F.struct("id", "answer", "error")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", item.alias("item")))), lambda x: x["item"])
    return rows.agg(ordered.alias("answers")).select(F.to_json(F.struct(F.col("answers"), F.lit(team).alias("team"), F.lit(notes).alias("notes"))).alias("json"))
