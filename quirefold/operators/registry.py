"""Documents to a registry: records, facts, tables, contents, one grouped map a document.

Everything is keyed by ``document_id``, so many documents compile in one job; a document is the unit that must fit into
a task.  The compiled form is one nested row a document, from which the flat tables are plain projections.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import document as doc
from ..functions import scalars as sc

COMPILER_VERSION = "1"
_FACT = "struct<field:string,label:string,value:double,raw_value:string,unit:string,subject:string,page:int,quote:string>"
_RECORD = f"struct<record_id:string,ordinal:int,title:string,grp:string,page_start:int,page_end:int,anchor_page:int,text:string,facts:array<{_FACT}>>"
_ROW = "struct<label:string,page:int,rank:int,grp:string,values:map<string,double>,quote:string>"
_TABLE = f"struct<table_id:string,number:int,title:string,page_start:int,page_end:int,columns:array<string>,rows:array<{_ROW}>,trusted:boolean>"
SCHEMA = (
    f"document_id string, compiler_version string, record_kind string, entity_label string, registry_trusted boolean, page_count int, signals map<string,string>, warnings array<string>, "
    f"records array<{_RECORD}>, supplements array<{_RECORD}>, tables array<{_TABLE}>, contents array<struct<category:string,identifier:string,title:string,page:int>>, contents_trusted boolean"
)


def compile_documents(pages: DataFrame, vocabulary: doc.Vocabulary | None = None, fold: bool = True) -> DataFrame:
    """``pages (document_id, page_number, text)`` as one compiled row a document; null texts count as empty pages."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        own = {int(n): t or "" for n, t in zip(pdf["page_number"][::-1], pdf["text"][::-1], strict=True)}
        read = doc.Document(sorted(own.items()), vocabulary)
        found = doc.compile_records(read)
        records = doc.named_records(found.records)
        if fold:
            records, _ = doc.fold_synonyms(records, vocabulary)
        entries, trusted = doc.compile_contents(read.pages)
        nested = lambda rs: [{**asdict(r), "facts": [asdict(f) for f in r.facts]} for r in rs]
        row = [pdf["document_id"].iloc[0], COMPILER_VERSION, found.kind, found.entity, found.trusted, len(read.pages), found.signals, found.warnings, nested(records), nested(found.supplements), doc.compile_tables(read.pages), entries, trusted]
        return pd.DataFrame([row], columns=[c.split()[0] for c in ("document_id", "compiler_version", "record_kind", "entity_label", "registry_trusted", "page_count", "signals", "warnings", "records", "supplements", "tables", "contents", "contents_trusted")])

    ordered = pages.select("document_id", "page_number", "text")
    return ordered.groupBy("document_id").applyInPandas(one, SCHEMA)


@dataclass(frozen=True)
class Registry:
    """The flat tables of compiled documents."""

    compiled: DataFrame

    @property
    def records(self) -> DataFrame:
        return self.compiled.select("document_id", F.explode("records").alias("r")).select("document_id", "r.*").drop("facts")

    @property
    def mapping_records(self) -> DataFrame:
        """Records and supplements: every unit of text."""
        rows = self.compiled.select("document_id", F.explode(F.concat("records", "supplements")).alias("r"))
        return rows.select("document_id", "r.*").drop("facts")

    @property
    def facts(self) -> DataFrame:
        rows = self.compiled.select("document_id", F.explode("records").alias("r")).select("document_id", "r.record_id", "r.ordinal", "r.title", "r.grp", F.explode("r.facts").alias("f"))
        return rows.select("document_id", "record_id", "ordinal", "title", "grp", "f.*")

    @property
    def tables(self) -> DataFrame:
        return self.compiled.select("document_id", F.explode("tables").alias("t")).select("document_id", "t.*").drop("rows")

    @property
    def table_rows(self) -> DataFrame:
        rows = self.compiled.select("document_id", F.explode("tables").alias("t")).select("document_id", "t.table_id", "t.trusted", F.posexplode("t.rows").alias("at", "r"))
        return rows.select("document_id", "table_id", "trusted", F.format_string("%s-row-%03d", "table_id", F.col("at") + 1).alias("row_id"), "r.*")

    @property
    def contents(self) -> DataFrame:
        return self.compiled.select("document_id", "contents_trusted", F.explode("contents").alias("c")).select("document_id", "contents_trusted", "c.*")

    @property
    def field_catalog(self) -> DataFrame:
        """Fields of facts, columns of tables and keys of their rows, once each."""
        columns = self.tables.select("document_id", F.explode("columns").alias("field"))
        keys = self.table_rows.select("document_id", F.explode(F.map_keys("values")).alias("field"))
        return self.facts.select("document_id", "field").unionByName(columns).unionByName(keys).distinct()

    @property
    def chunks(self) -> DataFrame:
        """Units of text with a content hash."""
        return self.mapping_records.withColumn("chunk_index", F.row_number().over(W.partitionBy("document_id").orderBy("page_start", "record_id")) - 1).withColumn("content_hash", sc.content_hash(F.col("text")))

    @property
    def manifest(self) -> DataFrame:
        size = lambda c: F.size(c).alias(f"n_{c}")
        return self.compiled.select("document_id", "compiler_version", "record_kind", "registry_trusted", "page_count", *(size(c) for c in ("records", "supplements", "tables", "contents", "warnings")))


def quality_report(pages: DataFrame) -> DataFrame:
    """Per page: characters left after trimming, and no_text, low_text (under 50) or ok."""
    n = F.length(F.trim(F.coalesce("text", F.lit(""))))
    return pages.select("document_id", "page_number", n.alias("character_count"), F.when(n == 0, "no_text").when(n < 50, "low_text").otherwise("ok").alias("status"), (n < 50).alias("low_text_warning"))


def contents_counts(contents: DataFrame) -> DataFrame:
    """Entries by category, for documents whose contents are trusted."""
    return contents.where("contents_trusted").groupBy("document_id", "category").agg(F.count("*").alias("n"))


def figures_by_chapter(contents: DataFrame, category: str = "figures") -> DataFrame:
    """Entries by chapter: the part before the first point, without a leading S; O is the overview, which comes first."""
    chapter = F.regexp_replace(F.substring_index("identifier", ".", 1), "^[sS]", "")
    named = F.when(F.upper(chapter) == "O", "Overview").otherwise(chapter)
    counts = contents.where(F.col("category") == category).groupBy("document_id", named.alias("chapter")).agg(F.count("*").alias("n"))
    place = F.struct((F.col("chapter") != "Overview").alias("later"), F.coalesce(F.col("chapter").try_cast("int"), F.lit(1 << 30)).alias("number"), "chapter")
    return counts.withColumn("place", F.row_number().over(W.partitionBy("document_id").orderBy(place)).cast("long"))
