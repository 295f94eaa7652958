"""The named queries over the driver's tables, each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import evidence as ev
from ..operators import relational as rel
from ..operators import sequences as seq

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Topics of the exhaustive map; the last is in no document.
TOPICS = ["the", "password", "loser", "zebra crossing"]


def query(sql: str):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def long(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def supplier_facts(t) -> DataFrame:
    """Suppliers as records: title, group (nation), value (balance)."""
    return t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("record_id"), F.col("s_name").alias("title"), F.col("n_name").alias("grp"), F.col("s_acctbal").alias("value"))


_SUPPLIERS = "(SELECT s_suppkey AS record_id, s_name AS title, n_name AS grp, s_acctbal AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query(f"SELECT rk, title, grp, value FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY value DESC, record_id) AS rk FROM {_SUPPLIERS}) WHERE rk <= 3")
def extremum_top3_by_group(t):
    return rel.extremum_by_group(supplier_facts(t), "grp", "value", "record_id").select("rk", "title", "grp", "value")


@query(f"SELECT rk, title, grp, value FROM (SELECT *, row_number() OVER (ORDER BY value DESC, record_id) AS rk FROM {_SUPPLIERS}) WHERE rk <= 3")
def extremum_global(t):
    return rel.extremum(supplier_facts(t), "value", "record_id").select("rk", "title", "grp", "value")


@query(f"SELECT rk, title, grp, value FROM (SELECT *, row_number() OVER (ORDER BY value, record_id) AS rk FROM {_SUPPLIERS}) WHERE rk <= 3")
def argmin_global(t):
    return rel.extremum(supplier_facts(t), "value", "record_id", largest=False).select("rk", "title", "grp", "value")


@query("SELECT p_brand AS brand, count(*) FILTER (p_size > 40) AS n_gt, count(*) FILTER (p_size >= 40) AS n_gte, count(*) FILTER (p_size < 10) AS n_lt, count(*) FILTER (p_size <= 10) AS n_lte FROM part GROUP BY 1")
def count_by_threshold(t):
    size = F.col("p_size")
    return t("part").groupBy(F.col("p_brand").alias("brand")).agg(*(F.count_if(rel.compare(size, c, x)).alias(f"n_{c}") for c, x in (("gt", 40), ("gte", 40), ("lt", 10), ("lte", 10))))


@query("SELECT p_partkey AS record_id, p_name AS title, p_size::BIGINT AS value FROM part WHERE p_size >= 40")
def list_by_threshold(t):
    return t("part").where(rel.compare(F.col("p_size"), "gte", 40)).select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("title"), F.col("p_size").cast("long").alias("value"))


@query("SELECT n_name AS grp, count(*) AS n, grouping(n_name)::BIGINT AS is_total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_name), ())")
def group_count_with_total(t):
    return rel.group_counts_with_total(t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_name", "grp"), "grp")


_TOTALS = "(SELECT o_orderpriority AS label, o_orderkey AS record_id, o_totalprice AS value FROM orders UNION ALL SELECT o_orderpriority, 0, sum(o_totalprice) FROM orders GROUP BY 1)"


@query(f"WITH r AS (SELECT *, sum(value) OVER (PARTITION BY label) AS s FROM {_TOTALS}), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY value DESC, record_id) AS rk FROM r WHERE abs(2 * value - s) > greatest(1e-9, abs(value) * 1e-6)) SELECT label, record_id, round(value, 2) AS value, rk FROM k WHERE rk <= 3")
def table_argmax_excluding_total(t):
    rows = t("orders").select(F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("record_id"), F.col("o_totalprice").alias("value"))
    totals = rows.groupBy("label").agg(F.lit(0).cast("long").alias("record_id"), F.sum("value").alias("value"))
    kept = rel.without_totals(rows.unionByName(totals), ["label"], "value")
    return rel.extremum_by_group(kept, "label", "value", "record_id").select("label", "record_id", F.round("value", 2).alias("value"), "rk")


def long_facts(t) -> DataFrame:
    part = t("part").select(F.concat(F.lit("p"), "p_partkey").alias("record_id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    supplier = t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("record_id"), F.col("s_acctbal").alias("balance"))
    return part.unpivot("record_id", ["size", "price"], "field", "value").unionByName(supplier.unpivot("record_id", ["balance"], "field", "value"))


_FACTS = "(SELECT 'p' || p_partkey AS record_id, 'size' AS field, p_size::DOUBLE AS value FROM part UNION ALL SELECT 'p' || p_partkey, 'price', p_retailprice FROM part UNION ALL SELECT 's' || s_suppkey, 'balance', s_acctbal FROM supplier)"


@query(f"SELECT field, count(DISTINCT record_id) AS n_records, count(*) AS n_facts FROM {_FACTS} GROUP BY 1")
def field_coverage(t):
    return rel.field_coverage(long_facts(t))


@query(f"WITH f AS {_FACTS}, n AS (SELECT count(DISTINCT record_id) AS n FROM f) SELECT field, count(DISTINCT record_id) AS n_records, count(*) AS n_facts FROM f GROUP BY 1 HAVING count(DISTINCT record_id) >= (SELECT greatest(2, round_even(n * 0.3, 0)) FROM n)")
def field_catalog(t):
    facts = long_facts(t)
    n = facts.agg(F.countDistinct("record_id").alias("n")).first()["n"]
    return rel.field_catalog(facts, F.lit(n))


@query("SELECT c_custkey AS record_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1995)")
def complete_field_gate(t):
    held = t("orders").where(F.year("o_orderdate") == 1995).select(F.col("o_custkey").alias("record_id"))
    return rel.missing_keys(t("customer").select(F.col("c_custkey").alias("record_id")), held, "record_id")


@query("WITH f AS (SELECT p_brand AS field, p_partkey AS record_id, CASE WHEN p_size = 50 AND p_partkey = (SELECT min(q.p_partkey) FROM part q WHERE q.p_brand = part.p_brand AND q.p_size = 50) THEN 'sq miles' ELSE 'sq km' END AS unit FROM part), c AS (SELECT field, unit, count(*) AS n, min(record_id) AS record_id FROM f GROUP BY 1, 2), p AS (SELECT field, count(*) AS units, max(n) AS usual, count(*) FILTER (n = 1) AS odd FROM c GROUP BY 1) SELECT c.field, c.record_id, c.unit FROM c JOIN p ON c.field = p.field WHERE units > 1 AND odd = 1 AND usual > 1 AND n = 1")
def unit_outlier(t):
    part = t("part").select(F.col("p_brand").alias("field"), F.col("p_partkey").alias("record_id"), "p_size")
    odd = part.where("p_size = 50").groupBy("field").agg(F.min("record_id").alias("odd"))
    facts = part.join(odd, "field", "left").select("field", "record_id", F.when(F.col("record_id") == F.col("odd"), "sq miles").otherwise("sq km").alias("unit"))
    return rel.unit_outliers(facts)


@query("WITH v AS (SELECT p_partkey AS record_id, round(p_retailprice * CASE WHEN p_size > 25 THEN 2.58999 ELSE 1 END, 4) AS km2 FROM part) SELECT record_id, km2, rk FROM (SELECT *, row_number() OVER (ORDER BY km2 DESC, record_id) AS rk FROM v) WHERE rk <= 3")
def unit_normalized_argmax(t):
    unit = F.when(F.col("p_size") > 25, "sq miles").otherwise("sq km")
    areas = t("part").select(F.col("p_partkey").alias("record_id"), F.round(sc.area_km2(F.col("p_retailprice"), unit), 4).alias("km2"))
    return rel.extremum(areas, "km2", "record_id")


@query(f"WITH s AS {_SUPPLIERS}, b AS (SELECT grp, max(value) AS v FROM s GROUP BY 1), p AS (SELECT s.grp, min(record_id) AS peer, v FROM s JOIN b ON s.grp = b.grp AND s.value = b.v GROUP BY 1, 3) SELECT s.record_id, s.grp, s.value, p.peer, p.v AS peer_value FROM s JOIN p ON s.grp = p.grp WHERE p.v > s.value")
def claim_conflict_in_group(t):
    return rel.claim_conflicts_in_group(supplier_facts(t).select("record_id", "grp", "value"), "grp", "value", "record_id")


@query("WITH b AS (SELECT max(p_retailprice) AS v FROM part), p AS (SELECT min(p_partkey) AS peer FROM part, b WHERE p_retailprice = v) SELECT p_partkey AS record_id, p_retailprice AS value, peer, v AS peer_value FROM part, b, p WHERE p_retailprice < v")
def claim_conflict_universal(t):
    return rel.claim_conflicts_universal(t("part").select(F.col("p_partkey").alias("record_id"), F.col("p_retailprice").alias("value")), "value", "record_id")


@query("WITH d AS (SELECT o_custkey AS record_id, max(year(o_orderdate)) AS event_year, min(year(o_orderdate)) AS base_year, abs(max(year(o_orderdate)) - min(year(o_orderdate))) AS diff FROM orders GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY diff, record_id) AS rk, lead(diff) OVER (ORDER BY diff, record_id) - diff AS m FROM d) SELECT record_id, diff::BIGINT AS diff, rk, CASE WHEN rk = 1 THEN m::BIGINT END AS margin FROM k WHERE rk <= 2")
def date_difference_closest(t):
    events = t("orders").groupBy(F.col("o_custkey").alias("record_id")).agg(F.max(F.year("o_orderdate")).alias("event_year"))
    years = t("orders").groupBy(F.col("o_custkey").alias("record_id")).agg(F.min(F.year("o_orderdate")).alias("base_year"))
    return rel.closest_dates(events, years, "record_id").select("record_id", long("diff"), "rk", long("margin"))


@query("SELECT (SELECT min(doc_id) FROM documents WHERE contains(text, ' le ')) AS first_french, (SELECT min(doc_id) FROM documents WHERE contains(lower(text), ' das ')) AS first_article, (SELECT min(doc_id) FROM documents WHERE lang = 'de' AND contains(text, 'ß')) AS first_sharp WHERE first_french IS NOT NULL AND first_article IS NOT NULL AND first_sharp IS NOT NULL")
def first_match_relations(t):
    low = F.lower("text")
    parts = {"first_french": F.col("text").contains(" le "), "first_article": low.contains(" das "), "first_sharp": (F.col("lang") == "de") & F.col("text").contains("ß")}
    return rel.first_of_each(t("documents"), parts, ["doc_id"], "doc_id")


@query("WITH d AS (SELECT doc_id, source, n_chars FROM documents), r AS (SELECT source AS segment, min(doc_id) AS first, min(doc_id) + 40 AS last FROM documents GROUP BY 1) SELECT segment, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM d JOIN r ON doc_id BETWEEN first AND last GROUP BY 1")
def range_join_segments(t):
    docs = t("documents")
    ranges = docs.groupBy(F.col("source").alias("segment")).agg(F.min("doc_id").alias("first"), (F.min("doc_id") + 40).alias("last"))
    return rel.range_join(docs.select("doc_id", "n_chars"), ranges, "doc_id", "first", "last", 64).groupBy("segment").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@query("WITH g AS (SELECT lang, doc_id, doc_id - row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS run FROM documents) SELECT lang, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n FROM g GROUP BY lang, run")
def virtual_islands(t):
    return seq.islands(t("documents"), ["lang"], "doc_id", block=256)


@query("SELECT event_id, user_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS span_end FROM events")
def lead_spans(t):
    return seq.lead_spans(t("events").select("event_id", "user_id"), "user_id", ["event_id"], "event_id", F.lit(-1).cast("long"))


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events")
def forward_fill_group(t):
    marked = t("events").withColumn("own", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return seq.forward_fill(marked, "user_id", ["ts", "event_id"], "own", "last_purchase").select("event_id", "user_id", "last_purchase")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedupe_first(t):
    hashed = t("documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    return rel.first_rows(hashed, ["hash"], [F.col("doc_id")]).select("doc_id", "source")


@query("SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n\\s*\\n', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> ''))::BIGINT AS n_sentences FROM documents")
def sentence_split_counts(t):
    return t("documents").select("doc_id", F.size(sc.sentences("text")).cast("long").alias("n_sentences"))


@query("SELECT doc_id, len(regexp_extract_all(text, '([0-9][0-9.,]*)'))::BIGINT AS n_numbers FROM documents")
def number_extraction(t):
    return t("documents").select("doc_id", F.regexp_count("text", F.lit("[0-9][0-9.,]*")).cast("long").alias("n_numbers"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS plain, round(-round(o_totalprice, 2), 2) AS negative, round(round(o_totalprice, 2) * 1e6, 0) AS millions FROM orders")
def parse_number_roundtrip(t):
    shown = F.format_number("o_totalprice", 2)
    return t("orders").select("o_orderkey", F.round(sc.parse_number(F.concat(F.lit("$"), shown)), 2).alias("plain"), F.round(sc.parse_number(F.concat(F.lit("("), shown, F.lit(")"))), 2).alias("negative"), F.round(sc.parse_number(F.concat(shown, F.lit(" million"))), 0).alias("millions"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS slashed, strftime(o_orderdate, '%Y-%m-%d') AS worded, strftime(o_orderdate, '%Y') || '-01-01' AS year_only FROM orders")
def normalize_date_text(t):
    shown = lambda form: sc.normalize_date(F.date_format("o_orderdate", form))
    return t("orders").select("o_orderkey", shown("yyyy-MM-dd").alias("iso"), shown("yyyy/M/d").alias("slashed"), shown("d MMMM yyyy").alias("worded"), shown("yyyy").alias("year_only"))


@query("SELECT p_partkey, coalesce(nullif(left(trim(regexp_replace(regexp_replace(split_part(lower(p_type || ' ' || p_brand || ' (mm): ' || p_name), ':', 1), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', '_', 'g'), '_'), 80), ''), 'number') AS field FROM part")
def field_id(t):
    return t("part").select("p_partkey", sc.field_id(F.concat("p_type", F.lit(" "), "p_brand", F.lit(" (mm): "), "p_name")).alias("field"))


@query("WITH RECURSIVE s AS (SELECT conv_id, turn, length(coalesce(text, ''))::BIGINT AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations), p AS (SELECT conv_id, turn, size, rn, 1::BIGINT AS batch, 1 AS items, size AS held FROM s WHERE rn = 1 UNION ALL SELECT s.conv_id, s.turn, s.size, s.rn, CASE WHEN p.items >= 3 OR p.held + s.size > 1500 THEN p.batch + 1 ELSE p.batch END, CASE WHEN p.items >= 3 OR p.held + s.size > 1500 THEN 1 ELSE p.items + 1 END, CASE WHEN p.items >= 3 OR p.held + s.size > 1500 THEN s.size ELSE p.held + s.size END FROM p JOIN s ON s.conv_id = p.conv_id AND s.rn = p.rn + 1) SELECT conv_id, turn, size, batch FROM p")
def record_packing(t):
    sized = t("conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return seq.pack_records(sized, "conv_id", "turn", "size", 3, 1500)


_PHRASE = {x: r"(?:^|[^\p{L}\p{N}_])" + x.replace(" ", r"[\s\-–—]+") + r"(?:$|[^\p{L}\p{N}_])" for x in TOPICS}


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{x}' AS topic, count(*) FILTER (regexp_matches(lower(text), '{p}')) AS n_records, count(*) AS n_all FROM documents" for x, p in _PHRASE.items()) + ") SELECT topic, n_records, n_all, n_records = 0 AND (SELECT count(*) FROM c WHERE n_records = 0) = 1 AS is_answer FROM c")
def absence_matrix(t):
    return ev.absence_matrix(t("documents"), "text", TOPICS, ev.has_phrase)


_STATUS = "(" + " UNION ALL ".join(f"SELECT doc_id, '{x}' AS topic, CASE WHEN text IS NULL THEN 'parse_failed' WHEN regexp_matches(lower(text), '{p}') THEN 'evidence_found' ELSE 'no_evidence' END AS status FROM documents" for x, p in _PHRASE.items()) + ")"


@query(f"SELECT doc_id, topic, status FROM {_STATUS}")
def exhaustive_map_status(t):
    return ev.map_statuses(t("documents"), "doc_id", "text", TOPICS, ev.has_phrase)


@query(f"SELECT topic, count(*) AS n_records, count(*) FILTER (status = 'evidence_found') AS n_found, count(*) FILTER (status = 'no_evidence') AS n_none, round(100.0 * count(*) FILTER (status IN ('evidence_found', 'no_evidence')) / count(*), 2)::DOUBLE AS coverage FROM {_STATUS} GROUP BY 1")
def coverage_report(t):
    return ev.coverage_report(ev.map_statuses(t("documents"), "doc_id", "text", TOPICS, ev.has_phrase)).withColumn("coverage", F.col("coverage").cast("double"))


@query("WITH s AS (SELECT source, trim(unnest(string_split(text, chr(10)))) AS claim FROM documents) SELECT source, count(*) AS n_lines, count(DISTINCT trim(regexp_replace(lower(claim), '\\s+', ' ', 'g'))) AS n_claims FROM s WHERE claim <> '' GROUP BY 1")
def evidence_dedupe(t):
    claims = t("documents").select("source", F.explode(F.split("text", "\n")).alias("claim")).withColumn("claim", F.trim("claim")).where("claim <> ''")
    # Hashes, not lines, go through the shuffle.
    key = F.trim(F.regexp_replace(F.lower("claim"), r"\s+", " "))
    per_claim = claims.groupBy("source", F.sha2(key, 256).alias("key")).agg(F.count("*").alias("n"))
    return per_claim.groupBy("source").agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_claims"))


def _terms(df: DataFrame, key: str) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 4))
    return df.select(key, F.explode(words).alias("term"))


_TERMS = "(SELECT DISTINCT {key}, unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) >= 4)) AS term FROM {table})"
_DOC_TERMS, _ITEM_TERMS = _TERMS.format(key="doc_id", table="documents"), _TERMS.format(key="item_id", table="benchmark")


@query(f"SELECT term, count(*) AS df FROM {_DOC_TERMS} GROUP BY 1 HAVING count(*) <= (SELECT count(*) FROM documents) * 0.25")
def rare_terms(t):
    return ev.rare_terms(_terms(t("documents"), "doc_id"), F.lit(t("documents").count()))


@query(f"WITH d AS {_DOC_TERMS}, i AS {_ITEM_TERMS}, r AS (SELECT term FROM d GROUP BY 1 HAVING count(*) <= (SELECT count(*) FROM documents) * 0.25), s AS (SELECT item_id, doc_id, count(*) AS score FROM i JOIN r USING (term) JOIN d USING (term) GROUP BY 1, 2 HAVING count(*) >= 2) SELECT item_id, doc_id, score, rk FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rk FROM s) WHERE rk <= 4")
def dismissed_matches(t):
    return ev.dismissed_matches(_terms(t("benchmark"), "item_id"), _terms(t("documents"), "doc_id"), F.lit(t("documents").count()), "item_id", "doc_id")


@query("WITH n AS (SELECT max(doc_id) + 1 AS n FROM documents), s AS (SELECT doc_id, least(2, floor(3 * greatest(doc_id, 0) / n))::BIGINT AS tercile, (length(text) - length(replace(text, ' the ', '')))::BIGINT // 5 AS score FROM documents, n), k AS (SELECT *, row_number() OVER (PARTITION BY tercile ORDER BY score DESC, doc_id) AS rk FROM s) SELECT doc_id, tercile, score, rk FROM k WHERE rk <= CASE tercile WHEN 2 THEN 2 ELSE 3 END")
def lexical_repair_terciles(t):
    docs = t("documents")
    n = docs.agg((F.max("doc_id") + 1).alias("n")).first()["n"] or 1
    score = F.floor((F.length("text") - F.length(F.replace(F.col("text"), F.lit(" the "), F.lit("")))) / 5)
    scored = docs.select("doc_id", sc.tercile(F.col("doc_id") + 1, F.lit(n)).alias("tercile"), score.alias("score"))
    return ev.tercile_selection(scored, "tercile", "score", "doc_id").select("doc_id", long("tercile"), "score", "rk")


@query("SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL AND l.quality = 1 THEN 'evidence_found' WHEN contains(text, 'the') THEN 'no_evidence' WHEN l.doc_id IS NOT NULL AND l.quality = 0 THEN 'uncertain' ELSE 'parse_failed' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def map_merge_priority(t):
    first = t("labels").select("doc_id", F.when(F.col("quality") == 1, "evidence_found").otherwise("uncertain").alias("status"))
    again = t("documents").select("doc_id", F.when(F.col("text").contains("the"), "no_evidence").otherwise("parse_failed").alias("status"))
    return rel.merge_by_priority(first, again, "doc_id", "status", ev.STATUSES)


@query("SELECT doc_id, quality::DOUBLE AS value, 'fact' AS origin FROM labels UNION ALL SELECT doc_id, n_chars::DOUBLE, 'mapped' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def facts_preferred_fill(t):
    facts = t("labels").select("doc_id", F.col("quality").cast("double").alias("value"), F.lit("fact").alias("origin"))
    mapped = t("documents").select("doc_id", F.col("n_chars").cast("double").alias("value"), F.lit("mapped").alias("origin"))
    return rel.preferred_fill(facts, mapped, "doc_id")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_payload_extract(t):
    return t("events").select("event_id", F.get_json_object(sc.json_span(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))), "$.k").alias("k"))


@query("SELECT event_type AS stage, 'm' || (user_id % 3) AS model, count(*) AS n_calls, round(sum(value), 4) AS total FROM events GROUP BY GROUPING SETS ((event_type), ('m' || (user_id % 3)), ())")
def usage_by_stage_model(t):
    usage = t("events").select(F.col("event_type").alias("stage"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), "value")
    return ev.usage_totals(usage, "stage", "model", {"n_calls": F.count("*"), "total": F.round(F.sum("value"), 4)})


@query("WITH q AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, coalesce(answer, '') AS answer, CASE WHEN answer IS NULL THEN 'Pending' END AS error FROM q LEFT JOIN a USING (conv_id, turn)")
def submission_upsert(t):
    rows = t("conversations")
    asked = rows.where("role = 'user'").select("conv_id", "turn")
    said = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return ev.submission(asked, said, ["conv_id", "turn"])


@query("WITH n AS (SELECT item_id, trim(regexp_replace(regexp_replace(lower(b.text), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS reference, trim(regexp_replace(regexp_replace(lower(d.text), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS answer FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id) SELECT item_id, coalesce(reference = answer, false) AS exact, coalesce(contains(answer, reference), false) AS contained, round(coalesce(len(list_intersect(list_distinct(string_split(reference, ' ')), list_distinct(string_split(answer, ' '))))::DOUBLE / len(list_distinct(string_split(reference, ' '))), 0), 6) AS key_points FROM n")
def evaluation_metrics(t):
    items = t("benchmark").select("item_id", sc.comparable("text").alias("reference"))
    answers = t("documents").select(F.col("doc_id").alias("item_id"), sc.comparable("text").alias("answer"))
    wanted, given = F.array_distinct(F.split("reference", " ")), F.split("answer", " ")
    share = F.size(F.array_intersect(wanted, given)) / F.size(wanted)
    joined = items.join(answers, "item_id", "left")
    return joined.select("item_id", F.coalesce(F.col("reference") == F.col("answer"), F.lit(False)).alias("exact"), F.coalesce(F.contains("answer", "reference"), F.lit(False)).alias("contained"), F.round(F.coalesce(F.when(F.col("answer").isNotNull(), share), F.lit(0.0)), 6).alias("key_points"))
