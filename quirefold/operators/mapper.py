"""The exhaustive question x record scan: packing, a provider per partition, validation, repair, reduction."""

from __future__ import annotations

import json
import re
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import document as doc
from ..functions import scalars as sc
from ..plans.questions import Plan
from . import evidence as ev
from . import relational as rel
from . import sequences as seq

EVIDENCE = "array<struct<claim:string,exact_quote:string,page:int,role:string,entity:string,field:string,value:string,unit:string,confidence:double>>"
TOPICS = "array<struct<topic:string,level:string,exact_quote:string,page:int>>"
RESULT = f"question_id string, document_id string, record_id string, ordinal int, status string, evidence {EVIDENCE}, topics {TOPICS}, error string"


def _treats(text: str, phrase: str) -> bool:
    """``evidence.treats_phrase`` in plain Python."""
    said = re.compile(r"(?<!\w)" + r"[\s\-–—]+".join(map(re.escape, phrase.lower().split())) + r"(?!\w)")
    return any(said.search(s) and not re.search(ev.DECLARES_ABSENCE, s) for s in re.split(r"(?<=[.!?])\s+|\n\s*\n", text.lower()))


class EvidenceProvider(Protocol):
    """Reads one record for one question; a model-backed one is made anew in each partition."""

    def read(self, question: dict, record: dict) -> dict: ...


class LexicalProvider:
    """Deterministic reader: sentences that share the question's content words, and literal presence of its topics."""

    def read(self, question: dict, record: dict) -> dict:
        asked = set(re.findall(r"[a-z]{4,}", question["question"].lower()))
        found = []
        for sentence in re.split(r"(?<=[.!?])\s+|\n\s*\n", doc._PAGE.sub(" ", record["text"])):
            shared = asked & set(re.findall(r"[a-z]{4,}", sentence.lower()))
            if len(shared) >= 2 and len(sentence.strip()) >= 8:
                found.append({"claim": " ".join(sentence.split()), "exact_quote": sentence.strip(), "confidence": min(1.0, len(shared) / max(len(asked), 1)), "entity": record["title"], "role": "support"})
        topics = [{"topic": t, "level": "mention_only" if _treats(record["text"], t) else "none"} for t in question["topics"]]
        return {"status": "evidence_found" if found else "no_evidence", "evidence": found, "topics": topics}


def reply_json(reply: str) -> dict:
    """The object of a model's reply: fences stripped, else the outermost braces; empty if none parses."""
    bare = re.sub(r"^\s*```(?:json)?|```\s*$", "", reply).strip()
    for text in (bare, (re.search(r"\{.*\}", bare, re.S) or [""])[0]):
        try:
            if isinstance(found := json.loads(text), dict):
                return found
        except ValueError:
            continue
    return {}


def validated(answer: dict, question: dict, record: dict) -> tuple[str, list[dict], list[dict]]:
    """Status, evidence and topics that survive: quotes must stand in the record; found without a quote is uncertain."""
    kept = []
    for e in answer.get("evidence", [])[: min(8, max(2, question["slots"] + 1))]:
        if place := doc.literal_quote(record["text"], e.get("exact_quote") or ""):
            confidence = e.get("confidence")
            blank = {k: e.get(k) or "" for k in ("claim", "role", "entity", "field", "unit")}
            kept.append({**blank, "value": None if e.get("value") is None else str(e["value"]), "exact_quote": place[0], "page": place[1], "confidence": max(0.0, min(1.0, float(confidence))) if isinstance(confidence, (int, float)) else 0.5})
    said = {" ".join(t.get("topic", "").lower().split()): t for t in answer.get("topics", [])}
    topics = []
    for t in question["topics"]:
        got = said.get(" ".join(t.lower().split()))
        level = got["level"] if got and got.get("level") in ev.LEVELS else "uncertain"
        topics.append({"topic": t, "level": level, "exact_quote": (got or {}).get("exact_quote") or "", "page": (got or {}).get("page")})
    claimed = answer.get("status")
    if question["topics"]:
        status = "uncertain" if any(t["level"] == "uncertain" for t in topics) else "evidence_found" if any(t["level"] != "none" for t in topics) else "no_evidence"
    elif kept:
        status = "evidence_found"
    else:
        status = {"no_evidence": "no_evidence", "evidence_found": "uncertain", "uncertain": "uncertain"}.get(claimed, "parse_failed")
    return status, kept, topics


def _read(reader, question: dict, batch: list[dict], attempts: int) -> list[tuple]:
    """(status, evidence, topics, error) of each record for one question: one call for the batch if the reader takes batches, what does not come back complete is asked again."""
    if len(batch) > 1 and not hasattr(reader, "read_many"):
        return [found for r in batch for found in _read(reader, question, [r], attempts)]
    done: dict[str, tuple] = {}
    left = batch
    for _ in range(attempts):
        if not left:
            break
        try:
            if len(left) > 1:
                answers = reader.read_many(question, left)
                answers = reply_json(answers) if isinstance(answers, str) else answers
            else:
                answers = {left[0]["record_id"]: reader.read(question, left[0])}
            errors = dict.fromkeys((r["record_id"] for r in left), "no answer for this record")
        except Exception as e:  # a provider may fail in any way: the pairs are kept with its error and repaired later
            answers, errors = {}, dict.fromkeys((r["record_id"] for r in left), f"{type(e).__name__}: {e}")
            failed = "llm_failed"
        else:
            failed = "parse_failed"
        for r in left:
            answer = answers.get(r["record_id"])
            if answer is None:
                done[r["record_id"]] = (failed, [], [], errors[r["record_id"]])
                continue
            try:
                status, evidence, topics = validated(reply_json(answer) if isinstance(answer, str) else answer, question, r)
                done[r["record_id"]] = (status, evidence, topics, "")
            except Exception as e:  # an answer of another form than asked for
                done[r["record_id"]] = ("parse_failed", [], [], f"{type(e).__name__}: {e}")
        left = [r for r in left if done[r["record_id"]][0] in ("llm_failed", "parse_failed")]
    return [done[r["record_id"]] for r in batch]


def _packed(records: list[dict], max_items: int, max_chars: int) -> list[list[dict]]:
    """Records in order, dealt to calls of bounded size; a longer record goes alone."""
    out: list[list[dict]] = []
    held = 0
    for r in records:
        if not out or len(out[-1]) >= max_items or held + len(r["text"]) > max_chars:
            out.append([])
            held = 0
        out[-1].append(r)
        held += len(r["text"])
    return out


def map_records(records: DataFrame, plans: list[Plan], provider=LexicalProvider, attempts: int = 2, max_items: int = 3, max_chars: int = 18_000) -> DataFrame:
    """Every record read for every question: questions ride with the function, so records are neither copied nor joined.

    A column ``asked`` (an array of question ids) restricts a record to those questions.  Providers with ``read_many(question, records)``,
    which returns answers by record id, get up to ``max_items`` records and ``max_chars`` characters a call.
    """
    questions = [{"question_id": p.question_id, "question": p.question, "topics": list(p.topics), "slots": len(p.operations) + 1} for p in plans]
    some = "asked" in records.columns

    def scan(batches):
        reader = provider()
        for pdf in batches:
            every = [{**r, "text": r["text"] or ""} for r in pdf.to_dict("records")]
            rows = []
            for q in questions:
                for call in _packed([r for r in every if not some or q["question_id"] in r["asked"]], max_items, max_chars):
                    rows += [(q["question_id"], r["document_id"], r["record_id"], r["ordinal"], *found) for r, found in zip(call, _read(reader, q, call, attempts), strict=True)]
            yield pd.DataFrame(rows, columns=["question_id", "document_id", "record_id", "ordinal", "status", "evidence", "topics", "error"])

    return records.select("document_id", "record_id", "ordinal", "title", "text", *(["asked"] if some else [])).mapInPandas(scan, RESULT)


def reread(records: DataFrame, results: DataFrame, pairs: DataFrame, plans: list[Plan], provider) -> DataFrame:
    """Results after ``pairs (question_id, document_id, record_id)`` are read again; of two results the better status stays."""
    asked = pairs.groupBy("document_id", "record_id").agg(F.collect_set("question_id").alias("asked"))
    again = map_records(records.join(asked, ["document_id", "record_id"]), plans, provider)
    keys = ["question_id", "document_id", "record_id"]
    rank = F.create_map(*(F.lit(x) for pair in ev.STATUSES.items() for x in pair))[F.col("status")]
    both = results.withColumn("later", F.lit(0)).unionByName(again.withColumn("later", F.lit(1)))
    return rel.first_rows(both, keys, [rank.desc(), F.col("later").desc()]).drop("later")


def repaired(records: DataFrame, results: DataFrame, plans: list[Plan], provider) -> DataFrame:
    """Only failed pairs are read again, each for its own question."""
    failed = results.where(F.col("status").isin("llm_failed", "parse_failed")).select("question_id", "document_id", "record_id")
    return reread(records, results, failed, plans, provider)


def overlooked(records: DataFrame, results: DataFrame, plans: list[Plan], share: float = 0.25, least: int = 2, k: int = 4) -> DataFrame:
    """Pairs that were read without evidence though the record holds rare words of the question: ``least`` or more, the ``k`` best records a question."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 4))
    spark = records.sparkSession
    asked = spark.createDataFrame([(p.question_id, p.question) for p in plans], "question_id string, question string").select("question_id", F.explode(words(F.col("question"))).alias("term"))
    key = F.struct("ordinal", "document_id", "record_id").alias("record")
    terms = records.select(key, F.explode(words(F.col("text"))).alias("term"))
    found = ev.dismissed_matches(asked, terms, F.lit(records.count()), "question_id", "record", share, least, k)
    dismissed = results.where("status = 'no_evidence'").select("question_id", "document_id", "record_id")
    return found.select("question_id", "record.document_id", "record.record_id").join(dismissed, ["question_id", "document_id", "record_id"])


def lexical_selection(records: DataFrame, plans: list[Plan], total: int = 8, quotas: tuple[int, int, int] = (3, 3, 2)) -> DataFrame:
    """Per question, the records whose words match it best, from each third of the document by quota and then the next best up to ``total``."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 4))
    asked = F.array(*(F.struct(F.lit(p.question_id).alias("question_id"), words(F.lit(p.question)).alias("words")) for p in plans))
    expected = records.groupBy("document_id").agg(F.max("ordinal").alias("expected"))
    scored = records.join(expected, "document_id").withColumn("tercile", sc.tercile(F.col("ordinal"), F.col("expected"))).select("document_id", "record_id", "ordinal", "tercile", words(F.col("text")).alias("own"), F.explode(asked).alias("q")).select("q.question_id", "document_id", "record_id", "ordinal", "tercile", F.size(F.array_intersect("own", F.col("q.words"))).alias("score")).where("score > 0")
    best = [F.col("score").desc(), F.col("ordinal"), F.col("record_id")]
    # The constant bound lets Spark cut each third before the shuffle; the quota decides after it, and the rest fills up.
    ranked = scored.withColumn("rk", F.row_number().over(W.partitionBy("question_id", "document_id", "tercile").orderBy(*best))).where(F.col("rk") <= total)
    first = F.col("rk") <= F.element_at(F.array(*map(F.lit, quotas)), F.col("tercile") + 1)
    placed = ranked.withColumn("place", F.row_number().over(W.partitionBy("question_id", "document_id").orderBy(first.desc(), *best)))
    return placed.where(F.col("place") <= total).select("question_id", "document_id", "record_id", "ordinal", "score", "place")


def evidence_packet(results: DataFrame) -> DataFrame:
    """Per question: pairs read, with evidence, uncertain and failed, and whether its evidence needs repair: none found, or a failed pair."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    counts = results.groupBy("question_id").agg(F.count("*").alias("n_read"), count("evidence_found").alias("n_found"), count("uncertain").alias("n_uncertain"), count("llm_failed", "parse_failed").alias("n_missing"))
    return counts.withColumn("needs_repair", (F.col("n_found") == 0) | (F.col("n_missing") > 0))


def evidence_rows(results: DataFrame) -> DataFrame:
    """Flat evidence, one row for each (record, quote, claim) after levelling, in order of page, record and claim."""
    flat = results.select("question_id", "document_id", "record_id", "ordinal", F.explode("evidence").alias("e")).select("question_id", "document_id", "record_id", "ordinal", "e.*")
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return rel.first_rows(flat.withColumn("k1", key(F.col("exact_quote"))).withColumn("k2", key(F.col("claim"))), ["question_id", "document_id", "record_id", "k1", "k2"], [F.col("page"), F.col("confidence").desc(), F.col("role")]).drop("k1", "k2")


def relevant(evidence: DataFrame, terms: list[str]) -> DataFrame:
    """Evidence in which any concept term occurs."""
    hay = F.lower(F.concat_ws(" ", "claim", "exact_quote", "field", "role"))
    return evidence.where(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(hay, t))) if terms else evidence


def topic_levels(results: DataFrame) -> DataFrame:
    """Records by topic and level, per question."""
    return results.select("question_id", F.explode("topics").alias("t")).groupBy("question_id", F.col("t.topic").alias("topic"), F.col("t.level").alias("level")).agg(F.count("*").alias("n"))


def absence_answer(results: DataFrame, expected: int, allow_partial: bool = False) -> DataFrame:
    """The one topic that no record supports; none unless every record was read for it (or partial coverage is allowed)."""
    rows = results.select("question_id", "status", F.explode("topics").alias("t"))
    per = rows.groupBy("question_id", F.col("t.topic").alias("topic")).agg(F.count_if(F.col("t.level").isin("mention_only", "substantive")).alias("n_support"), F.count_if(F.col("t.level") != "uncertain").alias("n_read"))
    free = F.count_if(F.col("n_support") == 0).over(W.partitionBy("question_id"))
    covered = F.min(F.col("n_read") >= expected).over(W.partitionBy("question_id"))
    picked = per.withColumn("complete", covered).withColumn("free", free).where((F.col("n_support") == 0) & (F.col("free") == 1))
    return (picked if allow_partial else picked.where("complete")).select("question_id", "topic", "complete")


def dominant_unit(values: DataFrame, least: int = 2, share: float = 0.6) -> DataFrame:
    """Per question, the unit of at least max(least, share) of its rows, if there is one."""
    units = values.where("unit <> ''").groupBy("question_id", "unit").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("question_id"))
    return units.withColumn("total", total).where(F.col("n") >= F.greatest(F.lit(least).cast("double"), F.col("total") * share)).select("question_id", F.col("unit").alias("usual"))


def mapped_extremum(facts: DataFrame, evidence: DataFrame, largest: bool = True, k: int = 3) -> DataFrame:
    """Extremum over compiled facts, and mapped numbers only for records without one; numbers of another unit than the usual do not count."""
    columns = ["question_id", "document_id", "record_id", "ordinal", "value", "unit"]
    mapped = evidence.withColumn("value", sc.parse_number("value")).where("value IS NOT NULL").select(*columns)
    keys = ["question_id", "document_id", "record_id"]
    filled = facts.select(*columns).unionByName(mapped.join(facts.select(*keys).distinct(), keys, "left_anti"))
    level = filled.join(dominant_unit(filled), "question_id", "left").where("usual IS NULL OR unit = '' OR unit = usual")
    order = [F.col("value").desc() if largest else F.col("value").asc(), F.col("ordinal")]
    return level.withColumn("rk", F.row_number().over(W.partitionBy("question_id").orderBy(*order))).where(F.col("rk") <= k)


def bounded_evidence(evidence: DataFrame, expected: Column, per_third: int = 12) -> DataFrame:
    """The best evidence of each third of the document, by confidence."""
    third = evidence.withColumn("tercile", sc.tercile(F.col("ordinal"), expected))
    order = W.partitionBy("question_id", "tercile").orderBy(F.col("confidence").desc(), "page", "record_id", "claim")
    return third.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_third).drop("k")


def evidence_payload(evidence: DataFrame) -> DataFrame:
    """Numbered, bounded evidence as it goes to an answer: claim of 600, quote of 900 characters, and where it stands."""
    order = W.partitionBy("question_id").orderBy("page", "record_id", "claim")
    place = F.element_at(F.array(F.lit("early"), F.lit("middle"), F.lit("late")), F.col("tercile") + 1)
    return evidence.select("question_id", F.format_string("E%03d", F.row_number().over(order)).alias("evidence_id"), F.substring("claim", 1, 600).alias("claim"), F.substring("exact_quote", 1, 900).alias("quote"), "page", place.alias("position"))


def fallback_answers(evidence: DataFrame, lookup: bool = False, most: int = 10) -> DataFrame:
    """An answer from evidence alone: its first claim for a lookup, else its first distinct claims.  Claims are ranked and cut before any are gathered."""
    once = rel.first_rows(evidence.select("question_id", "page", "record_id", "claim"), ["question_id", "claim"], [F.col("page"), F.col("record_id")])
    place = F.row_number().over(W.partitionBy("question_id").orderBy("page", "record_id", "claim"))
    kept = once.withColumn("place", place).where(F.col("place") <= most)
    claims = F.transform(F.array_sort(F.collect_list(F.struct("place", "claim"))), lambda x: x["claim"])
    listed = kept.groupBy("question_id").agg(claims.alias("claims"))
    text = F.array_join(F.slice("claims", 1, 1 if lookup else most), " ")
    return listed.select("question_id", F.when(text.rlike(r"[.!?]$"), text).otherwise(F.concat(text, F.lit("."))).alias("answer"))


def record_batches(records: DataFrame, max_items: int = 3, max_chars: int = 18_000) -> DataFrame:
    """Records of each document packed in order into calls of bounded size."""
    return seq.pack_records(records.withColumn("size", F.length("text")), "document_id", "ordinal", "size", max_items, max_chars)
