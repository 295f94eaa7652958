"""Queries that render the driver's tables as documents, compile them, and ask the registry; their DuckDB equivalents ask the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import mapper
from ..operators import registry as reg
from . import executor
from .catalog import query
from .questions import Plan

#: Documents that suppliers are dealt to, and parts in a table's document.
DEALT, PARTS = 3, 100

#: Suppliers as records of three documents: place in the document, group, figures, and what their text says.
_SUPPLIERS = f"""(SELECT 'd' || (s_suppkey % {DEALT}) AS document_id, row_number() OVER (PARTITION BY s_suppkey % {DEALT} ORDER BY s_suppkey) AS ordinal, s_suppkey AS k, s_name AS title, 'Land ' || chr(65 + n_nationkey) AS grp, s_acctbal AS balance,
    (1950 + s_suppkey * 7 % 40)::DOUBLE AS founded, 1990 + s_suppkey * 11 % 30 AS audit FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def supplier_pages(t) -> DataFrame:
    """Two pages a supplier: a title page with prose, and a card of figures."""
    place = F.row_number().over(W.partitionBy("document_id").orderBy("s_suppkey"))
    k = F.col("s_suppkey")
    own = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("document_id", F.concat(F.lit("d"), (k % DEALT).cast("string"))).withColumn("ordinal", place)
    said = lambda every, text: F.when(k % every == 0, text).otherwise("")
    prose = F.concat(
        F.lit("# "), "s_name", F.lit("\nCountry: Land "), F.char(65 + F.col("n_nationkey")), F.lit("\n"), "s_name", F.lit(" has the largest account balance of its country. Its first audit was in "), (1990 + k * 11 % 30).cast("string"), F.lit(". Northgate opened as a depot in "), (1900 + k % 90).cast("string"), F.lit("."),
        said(4, " It straddles the border."), said(5, " It is shared by two nations."), said(3, " It is twinned with others."), F.when(k % 2 == 0, " It is inscribed on the list.").otherwise(" It is nominated for the list."),
    )
    card = F.concat(F.lit("## Supplier in numbers\nAccount balance: "), F.col("s_acctbal").cast("string"), F.lit(" dollars\n"), (1950 + k * 7 % 40).cast("string"), F.lit(" Year founded"))
    both = F.array(F.struct((2 * F.col("ordinal") - 1).alias("page_number"), prose.alias("text")), F.struct((2 * F.col("ordinal")).alias("page_number"), card.alias("text")))
    return own.select("document_id", F.explode(both).alias("p")).select("document_id", "p.*")


def suppliers(t) -> reg.Registry:
    return reg.Registry(reg.compile_documents(supplier_pages(t)))


def _answers(plan: Plan, registry: reg.Registry, run) -> DataFrame:
    return run(plan, registry).select("rk", "title", "grp", "value", "page")


@query(f"SELECT document_id, ordinal::BIGINT AS ordinal, title, grp, 'account_balance' AS field, balance AS value, 'dollars' AS unit, 2 * ordinal AS page FROM {_SUPPLIERS} UNION ALL SELECT document_id, ordinal, title, grp, 'year_founded', founded, '', 2 * ordinal FROM {_SUPPLIERS}")
def compiled_facts(t):
    return suppliers(t).facts.select("document_id", F.col("ordinal").cast("long").alias("ordinal"), "title", "grp", "field", "value", "unit", F.col("page").cast("long").alias("page"))


@query(f"SELECT document_id, title, 2 * ordinal - 1 AS page_start, 2 * ordinal AS page_end, 2 * ordinal AS anchor_page FROM {_SUPPLIERS}")
def compiled_records(t):
    return suppliers(t).records.select("document_id", "title", *(F.col(c).cast("long").alias(c) for c in ("page_start", "page_end", "anchor_page")))


@query(f"SELECT document_id, true AS trusted, 'supplier' AS entity, 2 * count(*) AS pages, count(*) AS n_records FROM {_SUPPLIERS} GROUP BY 1")
def compiled_manifest(t):
    return suppliers(t).compiled.select("document_id", F.col("registry_trusted").alias("trusted"), F.col("entity_label").alias("entity"), F.col("page_count").cast("long").alias("pages"), F.size("records").cast("long").alias("n_records"))


@query(f"SELECT rk, title, grp, balance AS value, 2 * ordinal AS page FROM (SELECT *, row_number() OVER (ORDER BY balance DESC, ordinal) AS rk FROM {_SUPPLIERS}) WHERE rk <= 3")
def executed_extremum(t):
    return _answers(Plan("q", "", "extremum", "account_balance", direction="max"), suppliers(t), executor.extremum)


@query(f"SELECT 0 AS rk, NULL AS title, NULL AS grp, count(*)::DOUBLE AS value, NULL::BIGINT AS page FROM {_SUPPLIERS} WHERE balance > 5000 UNION ALL SELECT 1, title, grp, balance, 2 * ordinal FROM {_SUPPLIERS} WHERE balance > 5000")
def executed_threshold(t):
    return _answers(Plan("q", "", "count_by_threshold", "account_balance", comparator="gt", threshold=5000.0), suppliers(t), executor.count_by_threshold)


@query(f"WITH s AS {_SUPPLIERS} SELECT 1 AS rk, title, grp, balance AS value, 2 * ordinal - 1 AS page FROM s WHERE balance < (SELECT max(balance) FROM s p WHERE p.document_id = s.document_id AND p.grp = s.grp)")
def executed_claim_conflict(t):
    return _answers(Plan("q", "", "claim_conflict", "account_balance", direction="max"), suppliers(t), executor.claim_conflict)


@query(f"SELECT rk, title, NULL AS grp, d::DOUBLE AS value, 2 * ordinal - 1 AS page FROM (SELECT *, abs(audit - founded) AS d, row_number() OVER (ORDER BY abs(audit - founded), ordinal, document_id) AS rk FROM {_SUPPLIERS}) WHERE rk <= 2")
def executed_dated_event(t):
    return _answers(Plan("q", "", "dated_event", "year_founded", phrase="first audit"), suppliers(t), executor.dated_comparison)


@query(f"WITH s AS {_SUPPLIERS}, r AS (SELECT *, 1 AS rk FROM s WHERE k % 4 = 0 UNION ALL SELECT *, 2 FROM s WHERE k % 5 = 0 UNION ALL SELECT *, 3 FROM s WHERE k % 3 = 0) SELECT rk, title, grp, NULL::DOUBLE AS value, 2 * ordinal - 1 AS page FROM (SELECT *, row_number() OVER (PARTITION BY rk ORDER BY document_id, ordinal) AS n FROM r) WHERE n = 1")
def executed_relation(t):
    return _answers(Plan("q", "", "relation"), suppliers(t), executor.cross_border)


@query(f"SELECT 1 AS rk, title, grp, (1900 + k % 90)::DOUBLE AS value, 2 * ordinal - 1 AS page FROM {_SUPPLIERS} WHERE k = 7")
def executed_needle(t):
    return _answers(Plan("q", "", "needle", kind="origin", phrase="Supplier#000000007"), suppliers(t), executor.needle)


@query(f"SELECT rk, title, grp, balance AS value, 2 * ordinal AS page FROM (SELECT *, row_number() OVER (ORDER BY balance DESC, ordinal) AS rk FROM {_SUPPLIERS} WHERE k % 2 = 0) WHERE rk <= 3")
def executed_status_extremum(t):
    return _answers(Plan("q", "", "extremum", "account_balance", direction="max", statuses=("inscribed",)), suppliers(t), executor.status_extremum)


@query(f"SELECT 1 AS rk, NULL AS title, grp, count(*)::DOUBLE AS value, NULL::BIGINT AS page FROM {_SUPPLIERS} WHERE grp IN (SELECT min(grp) FROM {_SUPPLIERS}) GROUP BY grp")
def executed_group_count(t):
    registry = suppliers(t)
    first = registry.records.agg(F.min("grp").alias("g")).first()["g"]
    return _answers(Plan("q", "", "count_entities", groups=(first,)), registry, executor.count_entities)


def part_pages(t) -> DataFrame:
    """Parts as pipe tables of up to ``PARTS`` rows, a document each."""
    row = F.concat(F.lit("| part "), F.col("p_partkey").cast("string"), F.lit(" | "), F.col("p_size").cast("string"), F.lit(" | "), F.col("p_retailprice").cast("string"), F.lit(" |"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("row")))), lambda x: x["row"]), "\n")
    head = "TABLE 4 Parts\n| Part | Size | Retail price |\n|---|:--|--:|\n"
    return t("part").groupBy(F.concat(F.lit("p"), F.floor(F.col("p_partkey") / PARTS).cast("string")).alias("document_id")).agg(F.concat(F.lit(head), lines).alias("text")).select("document_id", F.lit(1).alias("page_number"), "text")


@query(f"WITH p AS (SELECT 'p' || (p_partkey // {PARTS}) AS document_id, 'part ' || p_partkey AS label, p_size::DOUBLE AS size, p_retailprice AS price FROM part) SELECT document_id, label, 'size' AS field, size AS value, true AS trusted FROM p UNION ALL SELECT document_id, label, 'retail_price', price, true FROM p")
def compiled_table_rows(t):
    rows = reg.Registry(reg.compile_documents(part_pages(t))).table_rows
    return rows.select("document_id", "label", F.explode("values").alias("field", "value"), "trusted")


@query("WITH n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) SELECT 'boxes' AS category, '1.' || i AS identifier, 2 AS page FROM n UNION ALL SELECT 'figures', '2.' || i, 3 FROM n WHERE n_regionkey % 2 = 0")
def compiled_contents(t):
    """A contents list of nations, and body pages that hold their captions."""
    numbered = t("nation").withColumn("i", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("n_nationkey")))
    listed = lambda kind, cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("i", F.initcap("n_name").alias("name"))))), lambda x: F.concat(F.lit(f"{kind}."), x["i"].cast("string"), F.lit(" Map of "), x["name"], F.lit(" 12"))), " ")
    captions = lambda word, kind, cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.col("i")))), lambda i: F.concat(F.lit(f"{word} {kind}."), i.cast("string"))), " and ")
    even = F.col("n_regionkey") % 2 == 0
    pages = numbered.agg(F.concat(F.lit("Contents B O X E S "), listed(1, F.lit(True)), F.lit(" FIGURES "), listed(2, even)).alias("one"), F.concat(F.lit("Overview. "), captions("Box", 1, F.lit(True))).alias("two"), F.concat(F.lit("More: "), captions("Figure", 2, even)).alias("three"))
    each = pages.select(F.lit("c").alias("document_id"), F.posexplode(F.array("one", "two", "three")).alias("at", "text")).select("document_id", (F.col("at") + 1).alias("page_number"), "text")
    return reg.Registry(reg.compile_documents(each)).contents.where("contents_trusted").select("category", "identifier", "page")


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS whole, rtrim(rtrim(printf('%.2f', p_retailprice), '0'), '.') AS part, CAST((p_size::BIGINT * 1234567) AS VARCHAR) AS large FROM part")
def written_numbers(t):
    return t("part").select("p_partkey", sc.written_number(F.col("p_size").cast("double")).alias("whole"), sc.written_number(F.col("p_retailprice")).alias("part"), sc.written_number(F.col("p_size") * 1234567.0).alias("large"))


@query("SELECT source AS question_id, count(*) AS n_read, count(*) FILTER (label = 1) AS n_found, 0::BIGINT AS n_uncertain, count(*) FILTER (label IS NULL) AS n_missing, count(*) FILTER (label = 1) = 0 OR count(*) FILTER (label IS NULL) > 0 AS needs_repair FROM (SELECT source, quality AS label FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1")
def evidence_packet(t):
    status = F.when(F.col("quality") == 1, "evidence_found").when(F.col("quality") == 0, "no_evidence").otherwise("parse_failed")
    return mapper.evidence_packet(t("documents").join(t("labels"), "doc_id", "left").select(F.col("source").alias("question_id"), status.alias("status")))
