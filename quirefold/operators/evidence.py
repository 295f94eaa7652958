"""Exhaustive question x record mapping and its reduction: statuses, coverage, absence, selection.

Topics and questions are plan-side values (a handful), so they become columns or a literal array that is
exploded beside each record: records are read once, and no join multiplies them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Map statuses and topic levels in ascending order.
STATUSES = {"llm_failed": 0, "parse_failed": 1, "uncertain": 2, "no_evidence": 3, "evidence_found": 4}
LEVELS = {"none": 0, "uncertain": 1, "mention_only": 2, "substantive": 3}


def phrase_pattern(phrase: str) -> str:
    """A topic phrase as whole words, joined by blanks or dashes, in lower case; for Java, RE2 and Python alike."""
    return r"(?:^|[^\p{L}\p{N}_])" + r"[\s\-–—]+".join(re.escape(w) for w in phrase.lower().split()) + r"(?:$|[^\p{L}\p{N}_])"


#: Sentences that declare a topic absent; what follows the cue is what they are silent about.
DECLARES_ABSENCE = r"\b(?:not (?:covered|discussed|mentioned|reported|included)|no (?:information|mention|data|record)|(?:does|do|did) not (?:cover|discuss|mention|report|include))\b"


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether a topic phrase stands in a text as whole words, case aside."""
    return F.lower(text).rlike(phrase_pattern(phrase))


def treats_phrase(text: Column, phrase: str) -> Column:
    """Whether a sentence of a text has a topic phrase and does not declare it absent."""
    low = F.lower(text)
    said = F.exists(F.split(low, r"(?<=[.!?])\s+|\n\s*\n"), lambda s: s.rlike(phrase_pattern(phrase)) & ~s.rlike(DECLARES_ABSENCE))
    return has_phrase(text, phrase) & said


def map_statuses(records: DataFrame, key: str, text: str, topics: list[str], test=treats_phrase) -> DataFrame:
    """One status for each record and topic: found, absent, or parse_failed where there is no text to read."""
    pairs = F.array(*(F.struct(F.lit(t).alias("topic"), F.when(F.col(text).isNull(), "parse_failed").when(test(F.col(text), t), "evidence_found").otherwise("no_evidence").alias("status")) for t in topics))
    return records.select(key, F.explode(pairs).alias("x")).select(key, "x.topic", "x.status")


def coverage_report(statuses: DataFrame, topic: str = "topic") -> DataFrame:
    """Per question: records by status, and the share that ended in found or none."""
    count = lambda s: F.count_if(F.col("status") == s)
    found, none = count("evidence_found"), count("no_evidence")
    return statuses.groupBy(topic).agg(F.count("*").alias("n_records"), found.alias("n_found"), none.alias("n_none"), F.round(100.0 * (found + none) / F.count("*"), 2).alias("coverage"))


def absence_matrix(records: DataFrame, text: str, topics: list[str], test=treats_phrase) -> DataFrame:
    """Per topic: records that state it, and whether it is the one topic that none states.  One pass, one row for each topic."""
    counts = records.agg(*(F.count_if(F.coalesce(test(F.col(text), t), F.lit(False))).alias(f"c{k}") for k, t in enumerate(topics)), F.count("*").alias("n"))
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(t).alias("topic"), F.col(f"c{k}").alias("n_records")) for k, t in enumerate(topics)))).alias("x"), "n").select("x.topic", "x.n_records", F.col("n").alias("n_all"))
    absent = F.sum((F.col("n_records") == 0).cast("int")).over(W.partitionBy(F.lit(0)))
    return rows.select("topic", "n_records", "n_all", ((F.col("n_records") == 0) & (absent == 1)).alias("is_answer"))


def missing_pairs(expected: DataFrame, returned: DataFrame, keys: list[str]) -> DataFrame:
    """Every expected pair with its status; pairs that did not come back count as parse_failed."""
    return expected.join(returned, keys, "left").withColumn("status", F.coalesce("status", F.lit("parse_failed")))


def document_frequency(terms: DataFrame, term: str = "term") -> DataFrame:
    """Documents that hold each term, from distinct (document, term) rows."""
    return terms.groupBy(term).agg(F.count("*").alias("df"))


def rare_terms(terms: DataFrame, n_documents: Column, share: float = 0.25, term: str = "term") -> DataFrame:
    """Terms that at most ``share`` of the documents hold."""
    return document_frequency(terms, term).where(F.col("df") <= n_documents * F.lit(share))


def dismissed_matches(questions: DataFrame, terms: DataFrame, n_documents: Column, question: str, document: str, share: float = 0.25, least: int = 2, k: int = 4) -> DataFrame:
    """Per question, the k documents that hold most of its rare terms (``least`` or more), lowest id first among equals.

    Both inputs are distinct (id, term) rows.  Only terms that a question asks for are counted and joined.
    """
    asked = terms.join(questions.select("term").distinct(), "term", "left_semi")
    rare = rare_terms(asked, n_documents, share)
    scores = questions.join(rare.select("term"), "term").join(asked, "term").groupBy(question, document).agg(F.count("*").alias("score")).where(F.col("score") >= least)
    ranked = scores.withColumn("rk", F.row_number().over(W.partitionBy(question).orderBy(F.col("score").desc(), F.col(document))))
    return ranked.where(F.col("rk") <= k).withColumn("rk", F.col("rk").cast("long"))


def tercile_selection(scored: DataFrame, tercile: str, score: str, ordinal: str, quotas: tuple[int, int, int] = (3, 3, 2)) -> DataFrame:
    """The best records of each third of the document, up to its quota; lowest ordinal first among equals."""
    quota = F.element_at(F.array(*map(F.lit, quotas)), F.col(tercile) + 1)
    ranked = scored.withColumn("rk", F.row_number().over(W.partitionBy(tercile).orderBy(F.col(score).desc(), F.col(ordinal))))
    # The constant bound lets Spark cut each group before the shuffle; the quota of the third decides after it.
    return ranked.where(F.col("rk") <= max(quotas)).where(F.col("rk") <= quota).withColumn("rk", F.col("rk").cast("long"))


def distinct_evidence(evidence: DataFrame, claim: str) -> DataFrame:
    """First of each normalised claim."""
    return evidence.withColumn("claim_key", F.trim(F.regexp_replace(F.lower(claim), r"\s+", " "))).dropDuplicates(["claim_key"])


def usage_totals(usage: DataFrame, stage: str, model: str, measures: dict[str, Column]) -> DataFrame:
    """Totals by stage, by model and over all in one pass."""
    return usage.groupingSets([[stage], [model], []], stage, model).agg(*(c.alias(n) for n, c in measures.items()))


def submission(questions: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Every question with its answer; a question without one is pending."""
    joined = questions.join(answers, key, "left")
    return joined.withColumn("error", F.when(F.col("answer").isNull(), "Pending")).withColumn("answer", F.coalesce("answer", F.lit("")))
