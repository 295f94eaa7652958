"""Run a plan over a registry: the first executor that can answer completely does, and what none can answer is declined."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import registry as reg
from ..operators import relational as rel
from ..operators import statements as st
from .questions import Catalog, Plan

ANSWER = "question_id string, shape string, rk long, title string, grp string, value double, page long, quote string"


#: Names of fields and of groups that planning takes to the driver; of more, those that most records hold.
MOST_NAMES = 20_000


def catalog_of(registry: reg.Registry, statuses: tuple[str, ...] = ()) -> Catalog:
    """Fields and groups of a registry for the driver that plans."""
    most = lambda df, name: sorted(r[name] for r in df.groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(MOST_NAMES).collect())
    entity = registry.compiled.select("entity_label").first()
    return Catalog(tuple(most(registry.facts, "field")), tuple(most(registry.records.where("grp <> ''"), "grp")), entity[0] if entity else "entity", statuses)


def _answer(df: DataFrame, plan: Plan, **columns) -> DataFrame:
    wanted = {"rk": "long", "title": "string", "grp": "string", "value": "double", "page": "long", "quote": "string"}
    given = {c: columns.get(c, F.col(c) if c in df.columns else F.lit(None)) for c in wanted}
    return df.select(F.lit(plan.question_id).alias("question_id"), F.lit(plan.shape).alias("shape"), *(given[c].cast(k).alias(c) for c, k in wanted.items()))


def _field_facts(plan: Plan, registry: reg.Registry) -> DataFrame | None:
    """The field's facts, one a record; None unless every record (of the groups asked for) holds it."""
    records, facts = registry.records, registry.facts.where(F.col("field") == plan.field)
    if plan.groups:
        inside = F.lower("grp").isin([g.lower() for g in plan.groups])
        records, facts = records.where(inside), facts.where(inside)
    facts = rel.first_rows(facts, ["document_id", "record_id"], [F.col("page"), F.col("label")])
    key = F.concat_ws("/", "document_id", "record_id").alias("key")
    return facts if rel.complete(records.select(key), facts.select(key), "key") else None


def count_entities(plan: Plan, registry: reg.Registry) -> DataFrame | None:
    if plan.shape != "count_entities" or registry.compiled.where("NOT registry_trusted").limit(1).count():
        return None
    if not plan.groups:
        return _answer(registry.records.agg(F.count("*").alias("value")), plan, rk=F.lit(1))
    named = F.lower("grp").isin([g.lower() for g in plan.groups])
    counts = registry.records.where(named).groupBy("grp").agg(F.count("*").alias("value"), F.array_join(F.array_sort(F.collect_list("title")), "; ").alias("quote"))
    return _answer(counts, plan, rk=F.lit(1)) if counts.count() == len(plan.groups) else None


def count_by_threshold(plan: Plan, registry: reg.Registry) -> DataFrame | None:
    if plan.shape != "count_by_threshold" or plan.field is None or plan.threshold is None or (facts := _field_facts(plan, registry)) is None:
        return None
    hits = facts.where(rel.compare(F.col("value"), plan.comparator, plan.threshold))
    total = hits.agg(F.count("*").alias("value"))
    return _answer(total, plan, rk=F.lit(0)).unionByName(_answer(hits, plan, rk=F.lit(1)))


def extremum(plan: Plan, registry: reg.Registry) -> DataFrame | None:
    if plan.shape != "extremum" or plan.statuses or plan.field is None or (facts := _field_facts(plan, registry)) is None:
        return None
    level = facts.withColumn("value", sc.area_km2(F.col("value"), F.col("unit")))
    return _answer(rel.extremum(level, "value", "ordinal", 3, plan.direction == "max"), plan)


def unit_outlier(plan: Plan, registry: reg.Registry) -> DataFrame | None:
    if plan.shape != "unit_outlier":
        return None
    facts = registry.facts.where(F.col("field") == plan.field) if plan.field else registry.facts
    found = rel.unit_outliers(facts.where("unit <> ''").withColumn("key", F.struct("ordinal", "record_id", "title")), "key")
    return _answer(found.orderBy("field").limit(1), plan, rk=F.lit(1), title=F.col("key.title"), quote=F.concat_ws(": ", "field", "unit"))


def claim_conflict(plan: Plan, registry: reg.Registry) -> DataFrame | None:
    """Records whose claim to be the largest, in their group or anywhere, another record's figure refutes; then those whom another record names as beaten.

    A claim is about the field asked for, else about the field of the record that its sentence names.
    """
    if plan.shape != "claim_conflict" or (plan.field is not None and _field_facts(replace(plan, groups=()), registry) is None):
        return None
    sentences = st.record_sentences(registry.records)
    claimed = st.claims(sentences, st.Superlatives().of(plan.direction)).select(*st.NAMES, "page", "sentence", "scope")
    bound = st.bound_claims(claimed, registry.facts, plan.field)
    refuted = st.refuted_claims(bound, registry.facts, plan.direction != "min")
    by_figure = _answer(refuted, plan, rk=F.lit(1), quote=F.concat(F.col("sentence"), F.lit(" — "), F.col("peer.title"), F.lit(": "), F.col("peer.value").cast("string")))
    said = st.explicit_comparisons(sentences, claimed.where("scope <> 'unknown'"))
    by_word = _answer(said, plan, rk=F.lit(2), title=F.col("name"), quote=F.concat(F.col("peer_title"), F.lit(": "), F.col("sentence")))
    return by_figure.unionByName(by_word)


def dated_comparison(plan: Plan, registry: reg.Registry) -> DataFrame | None:
    """The two records whose event lies closest to their founding year.  The founding year is the field asked for if it holds years, else the one such field that most records hold."""
    if plan.shape != "dated_event" or not plan.phrase:
        return None
    years = st.year_fields(registry.facts)
    asked = years.where(F.col("field") == plan.field) if plan.field else years
    founding = asked.head() or years.orderBy(F.desc("n"), "field").head()
    if founding is None:
        return None
    closest = st.event_distances(st.record_sentences(registry.records), registry.facts, plan.phrase, founding["field"])
    return _answer(closest, plan, value=F.col("diff"), quote=F.col("sentence"))


#: Relations that a cross-border answer needs all of, and what denies one.
RELATIONS = {"straddling": r"(?i)\b(?:straddl\w+|lies? across)\b", "shared": r"(?i)\b(?:transboundary|shared (?:by|between|with)|cross-border)\b", "paired": r"(?i)\b(?:twinned|paired|formally linked)\b"}
DENIED = {name: r"(?i)\b(?:not|never|no longer|non)\b" for name in RELATIONS}


def cross_border(plan: Plan, registry: reg.Registry) -> DataFrame | None:
    """The first record of each relation, if there is one for all."""
    if plan.shape != "relation":
        return None
    found = st.relations(st.record_sentences(registry.records), RELATIONS, DENIED)
    rows = found.select(F.posexplode(F.array(*(F.col(n) for n in RELATIONS))).alias("at", "x")).select((F.col("at") + 1).alias("rk"), "x.*")
    return _answer(rows, plan, quote=F.col("sentence"))


def needle(plan: Plan, registry: reg.Registry) -> DataFrame | None:
    """A narrow fact about a subject, from the first sentence that states it; its number is the value."""
    if plan.shape != "needle" or plan.kind not in st.NEEDLES:
        return None
    found = st.needle(st.record_sentences(registry.records), plan.kind, plan.phrase)
    stated = [c for c in ("year", "age") if c in found.columns]
    value = F.regexp_replace(F.col(stated[0]), r"[^\d]", "").try_cast("double") * F.when(F.col(stated[0]).rlike("BCE?"), -1).otherwise(1)
    return _answer(found, plan, rk=F.lit(1), value=value, quote=F.col("sentence"))


def status_extremum(plan: Plan, registry: reg.Registry) -> DataFrame | None:
    """Extremum over the records that state one of the statuses asked for."""
    if plan.shape != "extremum" or not plan.statuses or plan.field is None:
        return None
    stated = st.with_status(st.record_sentences(registry.records), list(plan.statuses), list(plan.statuses))
    facts = rel.first_rows(registry.facts.where(F.col("field") == plan.field), ["document_id", "record_id"], [F.col("page"), F.col("label")])
    held = stated.select("document_id", "record_id").join(facts.select("document_id", "record_id"), ["document_id", "record_id"], "left_anti")
    if not held.isEmpty():
        return None
    return _answer(st.extremum_with_status(facts, stated, largest=plan.direction != "min"), plan, quote=F.col("sentence"))


def contents_index(plan: Plan, registry: reg.Registry) -> DataFrame | None:
    if plan.shape != "contents_index":
        return None
    counts = reg.contents_counts(registry.contents).where(F.col("category").isin(list(plan.categories)))
    return _answer(counts, plan, rk=F.lit(1), title=F.col("category"), value=F.col("n")) if counts.count() >= len(plan.categories) else None


def table_extremum(plan: Plan, registry: reg.Registry) -> DataFrame | None:
    """Extremum over a column of the one trusted table that has it; rows that state a total do not count."""
    if plan.shape != "extremum" or plan.statuses or plan.field is None:
        return None
    cells = registry.table_rows.where("trusted").select("document_id", "table_id", "label", "grp", "page", "rank", "row_id", "quote", F.col("values")[plan.field].alias("value")).where("value IS NOT NULL")
    if cells.select("document_id", "table_id").distinct().count() != 1:
        return None
    ranked = cells.where("rank IS NOT NULL")
    rows = rel.without_totals(ranked if not ranked.isEmpty() else cells, ["document_id", "table_id"], "value")
    return _answer(rel.extremum(rows, "value", "row_id", 3, plan.direction == "max"), plan, title=F.col("label"))


#: In order of cost; the first complete answer counts.
CHAIN = (table_extremum, contents_index, count_entities, unit_outlier, claim_conflict, dated_comparison, cross_border, needle, count_by_threshold, status_extremum, extremum)


def execute(plan: Plan, registry: reg.Registry) -> DataFrame | None:
    """Answer rows of a plan, or None where every executor declines and the exhaustive map must read the records."""
    for run in CHAIN:
        if (found := run(plan, registry)) is not None and not found.isEmpty():
            return found
    return None
