"""Filling holes of a registry from a reader's proposals, each proved against the source text first."""

from __future__ import annotations

import re
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import document as doc
from . import relational as rel

PROPOSAL = "document_id string, record_id string, ordinal int, name string, grp string, field string, label string, value double, unit string, page int, quote string"


class RecordProfiler(Protocol):
    """Proposes a name, a group and facts (metric, value, unit, quote) of one record."""

    def profile(self, record: dict, vocabulary: list[str]) -> dict: ...


def names_the_record(text: str, name: str) -> bool:
    """A name is a record's own if each of its words comes back in the text."""
    words, key = doc.source_key(name).split(), doc.source_key(text)
    return bool(words) and doc.source_key(name) in key and all(len(re.findall(rf"\b{re.escape(w)}\b", key)) >= 2 for w in words)


def needs_profiling(records: DataFrame, facts: DataFrame) -> bool:
    """Whether any record lacks a fact or a title."""
    keys = ["document_id", "record_id"]
    return not records.join(facts.select(*keys).distinct(), keys, "left_anti").isEmpty() or not records.where(F.col("title").rlike(r"^Record \d+$")).isEmpty()


def profile_records(records: DataFrame, profiler, vocabulary: list[str] | None = None) -> DataFrame:
    """Proved proposals, one row a fact (or one without a fact): quotes must stand in the record and state the value, names must recur."""

    def scan(batches):
        reader = profiler()
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                text, found = r["text"] or "", reader.profile(r, vocabulary or [])
                name = found.get("name") or ""
                name = name if names_the_record(text, name) else ""
                group = found.get("category") or ""
                group = group if group and doc.source_key(group) in doc.source_key(text) else ""
                head = (r["document_id"], r["record_id"], r["ordinal"], name[:120], group[:80])
                rows.append((*head, None, None, None, None, None, None))
                for f in found.get("facts", []):
                    metric, value = (f.get("metric") or "").strip(), doc.number(str(f.get("value", "")))
                    place = doc.literal_quote(text, f.get("quote") or "")
                    if metric and value is not None and place and doc.value_supported(value, doc.field_of(metric), f["quote"]):
                        rows.append((*head, doc.field_of(metric), metric, value, f.get("unit") or doc.unit_in(metric), place[1], place[0]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PROPOSAL.split(", ")])

    return records.select("document_id", "record_id", "ordinal", "title", "text").mapInPandas(scan, PROPOSAL)


def spread_sample(records: DataFrame, size: int = 6) -> DataFrame:
    """Records at equal steps through each document: what vocabulary induction reads first."""
    n = records.groupBy("document_id").agg(F.count("*").alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / size))
    return records.join(n, "document_id").where(((F.col("ordinal") - 1) % step == 0) & ((F.col("ordinal") - 1) / step < size)).drop("n")


def induced_vocabulary(proposals: DataFrame, least: int = 2) -> DataFrame:
    """Fields that at least two sampled records state, most frequent first, each in its least spelling."""
    return proposals.where("field IS NOT NULL").groupBy("document_id", "field").agg(F.countDistinct("record_id").alias("n"), F.min("label").alias("label")).where(F.col("n") >= least).orderBy(F.col("n").desc(), "field")


def merged_facts(facts: DataFrame, proposals: DataFrame) -> DataFrame:
    """A profiled record's proved facts, and of its compiled ones those whose field it did not state; other records keep theirs."""
    columns = ["document_id", "record_id", "field", "label", "value", "unit", "page", "quote"]
    proved = rel.first_rows(proposals.where("field IS NOT NULL"), ["document_id", "record_id", "field"], [F.col("page"), F.col("quote")]).select(*columns)
    return proved.unionByName(facts.select(*columns).join(proved.select("document_id", "record_id", "field"), ["document_id", "record_id", "field"], "left_anti"))


def renamed_records(records: DataFrame, proposals: DataFrame) -> DataFrame:
    """Placeholder titles and empty groups take the proved name and group."""
    named = proposals.groupBy("document_id", "record_id").agg(F.max("name").alias("new_name"), F.max("grp").alias("new_grp"))
    joined = records.join(named, ["document_id", "record_id"], "left")
    title = F.when(F.col("title").rlike(r"^Record \d+$") & (F.coalesce("new_name", F.lit("")) != ""), F.col("new_name")).otherwise(F.col("title"))
    return joined.withColumn("title", title).withColumn("grp", F.when((F.col("grp") == "") & (F.coalesce("new_grp", F.lit("")) != ""), F.col("new_grp")).otherwise(F.col("grp"))).drop("new_name", "new_grp")


def proved_contents(proposed: DataFrame, source: DataFrame, baseline: DataFrame) -> DataFrame:
    """Proposed contents entries whose identifier stands in the contents text, with ``trusted``: no category fell below min(its baseline, 4)."""
    kept = proposed.join(source, "document_id").where(F.expr("regexp_like(contents_text, concat('(?i)(?<![A-Za-z0-9])', regexp_replace(identifier, '[.]', '[.]'), '(?![A-Za-z0-9])'))")).drop("contents_text").dropDuplicates(["document_id", "category", "identifier"])
    counts = kept.groupBy("document_id", "category").agg(F.count("*").alias("n"))
    short = baseline.join(counts, ["document_id", "category"], "left").where(F.coalesce("n", F.lit(0)) < F.least(F.col("n_listed"), F.lit(4))).select("document_id").distinct().withColumn("short", F.lit(True))
    return kept.join(short, "document_id", "left").withColumn("trusted", F.col("short").isNull()).drop("short")
