"""Answer a list of questions over paged documents: plan, execute, map what is left, reduce, submit.

``python -m quirefold.plans.run DOCUMENTS QUESTIONS OUT`` reads text files and a question file, and writes a submission.
"""

from __future__ import annotations

import json
import re
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import written
from ..operators import mapper, registry
from ..sources import store, text
from . import executor, questions

_EMPTY = "question_id string, answer string, result_value string, pages array<int>, note string"


def flat_answer(value) -> str:
    """An answer of any JSON form as text: envelopes opened, objects as "key: value.", lists joined by semicolons."""
    if isinstance(value, dict):
        for key in ("final_answer", "answer"):
            if key in value:
                return flat_answer(value[key])
        return " ".join(f"{k}: {flat_answer(v)}." for k, v in value.items() if flat_answer(v))
    if isinstance(value, list):
        return "; ".join(x for x in map(flat_answer, value) if x)
    return "" if value is None or isinstance(value, bool) else str(value).strip()


def parse_answer(reply: str) -> str:
    found = mapper.reply_json(reply)
    return flat_answer(found) if found else reply.strip()


def missing_slots(answer: str, slots: tuple[str, ...]) -> list[str]:
    """Slots that an answer leaves open: a date, a thesis of 35 words, entities of 5."""
    n = len(answer.split())
    open_ = {"date": not re.search(r"\b\d{3,4}\b|\bBCE?\b", answer), "thesis": n < 35, "entities": n < 5}
    return [s for s in slots if open_.get(s, False)]


def sentence_of(rows: list, plan: questions.Plan) -> tuple[str, str, list[int]]:
    """(answer, value, pages) of executed rows; runners-up follow the first, named after the direction asked for."""
    rows = sorted(rows, key=lambda r: (r["rk"] or 0, r["title"] or "", r["grp"] or ""))
    shown = lambda r: f"{r['title'] or r['grp'] or 'total'}" + (f" ({written(r['value'])})" if r["value"] is not None else "")
    pages = sorted({r["page"] for r in rows if r["page"] is not None})
    if plan.shape == "extremum":
        rest = f" The next {'highest' if plan.direction == 'max' else 'lowest'}: {', '.join(shown(r) for r in rows[1:])}." if rows[1:] else ""
        return f"{shown(rows[0])}.{rest}", written(rows[0]["value"]), pages
    value = rows[0]["value"]
    return "; ".join(shown(r) for r in rows) + ".", "" if value is None else written(value), pages


#: Rows of an answer that are named in it; the rest is counted.
MOST_SHOWN = 200


def read_records(own: registry.Registry, plans: list[questions.Plan], provider, kept: store.RunStore | None = None) -> DataFrame:
    """The exhaustive map with its repairs: failed pairs once more, then records that were dismissed though they hold a question's rare words.

    Each step is written to ``kept`` (or persisted, where there is none) before the next one reads it, so a provider is never asked twice for one pair.
    """
    records = own.mapping_records

    def settled(df: DataFrame, name: str) -> DataFrame:
        if kept is None:
            return df.persist()
        kept.save(df, name, "question_id")
        return kept.load(name)

    results = settled(mapper.map_records(records, plans, provider), "map_results")
    if not results.where(F.col("status").isin("llm_failed", "parse_failed")).isEmpty():
        results = settled(mapper.repaired(records, results, plans, provider), "map_repaired")
    looked_up = [p for p in plans if p.shape != "absence"]
    empty = [r["question_id"] for r in mapper.evidence_packet(results).where("needs_repair").select("question_id").collect()]  # questions of the caller's list
    again = [p for p in looked_up if p.question_id in empty]
    if again:
        pairs = mapper.overlooked(records, results, again).unionByName(mapper.lexical_selection(records, again).select("question_id", "document_id", "record_id")).distinct()
        results = settled(mapper.reread(records, results, pairs, again, provider), "map_reread")
    return results


def answer_questions(compiled: DataFrame, asked: list[tuple[str, str]], provider=mapper.LexicalProvider, router: questions.Router | None = None, kept: store.RunStore | None = None) -> DataFrame:
    """``(question_id, answer, result_value, pages, note)``: one row for each question that has an answer."""
    spark, own = compiled.sparkSession, registry.Registry(compiled.persist())
    catalog = executor.catalog_of(own)
    plans = [questions.compile_question(i, q, catalog) for i, q in asked]
    if router is not None:
        plans = [questions.routed(p, router.route(p.question, catalog), catalog) for p in plans]
    done, left = [], []
    for plan in plans:
        found = executor.execute(plan, own)
        rows = found.orderBy("rk", "title", "grp").limit(MOST_SHOWN + 1).collect() if found is not None else []
        if rows:
            answer, value, pages = sentence_of(rows[:MOST_SHOWN], plan)
            answer += f" And {found.count() - MOST_SHOWN} more." if len(rows) > MOST_SHOWN else ""
            done.append((plan.question_id, answer, value or None, pages, "computed from the registry"))
        else:
            left.append(plan)
    parts = [spark.createDataFrame(done, _EMPTY)]
    if left:
        results = read_records(own, left, provider, kept)
        absent = [p.question_id for p in left if p.shape == "absence"]
        evidence = mapper.evidence_rows(results.where(~F.col("question_id").isin(absent)))
        pages = evidence.groupBy("question_id").agg(F.array_sort(F.collect_set("page")).alias("pages"))
        n = own.mapping_records.count()
        said = mapper.absence_answer(results.where(F.col("question_id").isin(absent)), n).select("question_id", F.col("topic").alias("answer"), F.col("topic").alias("result_value"), F.array().cast("array<int>").alias("pages"), F.lit("in no record").alias("note"))
        read = mapper.fallback_answers(evidence).join(pages, "question_id").select("question_id", "answer", F.lit(None).cast("string").alias("result_value"), "pages", F.lit("from evidence").alias("note"))
        parts += [said, read]
    return reduce(DataFrame.unionByName, parts)


def main(documents: str, asked: str, out: str) -> None:
    spark = SparkSession.builder.appName("quirefold").getOrCreate()
    lines = [r["value"] for r in spark.read.text(asked).collect()]
    listed = questions_of(lines)
    pages = text.split_pages(text.read_text_documents(spark, documents).select("document_id", "text"))
    compiled = registry.compile_documents(pages).persist()
    asked_df = spark.createDataFrame([(i, k) for k, (i, _) in enumerate(listed)], "question_id string, ordinal int")
    rows = store.submission_rows(asked_df, answer_questions(compiled, listed))
    store.submission_json(rows).write.mode("overwrite").text(out)


def questions_of(lines: list[str]) -> list[tuple[str, str]]:
    joined = "\n".join(lines)
    try:
        return text.questions_from_json(json.loads(joined))
    except ValueError:
        return text.questions_from_text(lines)


if __name__ == "__main__":
    main(*sys.argv[1:4])
