"""Questions to logical plans: small driver-side values, checked against what the registry holds."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import Protocol

SHAPES = ("count_entities", "count_by_threshold", "extremum", "unit_outlier", "claim_conflict", "relation", "dated_event", "needle", "absence", "contents_index", "synthesis")
STRATEGY = {"absence": "absence_matrix", "claim_conflict": "claim_compare", "synthesis": "hierarchical_synthesis", "relation": "exhaustive_lookup", "needle": "exhaustive_lookup"}
#: What a question says when it asks for a narrow fact.
NEEDLE_CUES = {"origin": r"\b(?:begin|began|start|started|opened?|founded) (?:out |life )?as\b", "age": r"\bhow old\b|\bestimated age\b", "first_record": r"\b(?:first|earliest)\b.*\brecord(?:ed|s)?\b"}
RELATION_CUES = r"\b(?:straddl\w+|transboundary|cross-border|twinned|across (?:a|the) border|shared (?:by|between|with))\b"
CONTENT_KINDS = {"box": "boxes", "spotlight": "spotlights", "figure": "figures", "table": "tables"}
#: Arguments without which a shape cannot run.
REQUIRED = {"count_by_threshold": ("field", "threshold"), "extremum": ("field", "direction"), "absence": ("topics",), "contents_index": ("categories",)}

_MAX = r"\b(?:largest|highest|biggest|most|greatest|longest|deepest|tallest|oldest|maximum)\b"
_MIN = r"\b(?:smallest|lowest|least|fewest|shortest|shallowest|youngest|minimum)\b"
_LIMIT = re.compile(r"(?P<word>more than|over|above|exceed\w*|at least|no less than|less than|under|below|fewer than|at most|no more than)\s+(?P<n>[\d.,]+(?:\s*(?:million|billion|thousand))?)", re.I)
_COMPARATOR = {"more than": "gt", "over": "gt", "above": "gt", "at least": "gte", "no less than": "gte", "less than": "lt", "under": "lt", "below": "lt", "fewer than": "lt", "at most": "lte", "no more than": "lte"}
_STOP = frozenset("the a an of in on for and or is are was were which what who how many much with by to from at that this has have had does do record report station each".split())


@dataclass(frozen=True)
class Catalog:
    """What a registry offers to plan against."""

    fields: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    entity: str = "entity"
    statuses: tuple[str, ...] = ()  # that records may state, known to the caller


@dataclass(frozen=True)
class Plan:
    question_id: str
    question: str
    shape: str = "synthesis"
    field: str | None = None
    groups: tuple[str, ...] = ()
    comparator: str = "gte"
    threshold: float | None = None
    direction: str | None = None
    topics: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    phrase: str = ""  # of an event, or the subject of a narrow fact
    kind: str = ""  # of a narrow fact
    statuses: tuple[str, ...] = ()
    confident: bool = False
    operations: tuple[str, ...] = ()

    @property
    def strategy(self) -> str:
        return STRATEGY.get(self.shape, "structured_reduce")


class Router(Protocol):
    """Anything that proposes a shape and its arguments for a question (a model, a rule set)."""

    def route(self, question: str, catalog: Catalog) -> dict: ...


def threshold_of(question: str) -> tuple[str, float] | None:
    from ..functions.document import number

    m = _LIMIT.search(question)
    if not m or (value := number(m["n"].strip(" .,"))) is None:
        return None
    word = m["word"].lower()
    return _COMPARATOR.get(word, "gt"), value


def topics_of(question: str) -> tuple[str, ...]:
    """The listed candidates: between dashes, or in "which of a, b and c"."""
    m = re.search(r"[—–]\s*(.+?)\s*[—–]", question) or re.search(r"\bof\s+(.+?,.+?)(?:,\s*which|\?|$)", question)
    parts = re.split(r",\s*(?:and|or)\s+|,\s*|\s+(?:and|or)\s+", m[1]) if m else []
    return tuple(p.strip(" .?") for p in parts if p.strip(" .?"))


def subject_of(question: str) -> str:
    """The name that a question is about: its longest run of capitalised words after the first word."""
    runs = re.findall(r"(?<=\s)[A-Z][\w'\-]*(?: [A-Z][\w'\-]*)*", question)
    return max(runs, key=len, default="")


def _words(text: str) -> set[str]:
    return {w.rstrip("s") for w in re.findall(r"[a-z]+", text.lower()) if w not in _STOP and len(w) > 2}


def bind_field(question: str, fields: tuple[str, ...]) -> str | None:
    """The field that shares most words with the question; of equals the longest name, then the first; none shares none."""
    asked = _words(question)
    scored = [(len(asked & _words(f.replace("_", " "))), len(f), f) for f in fields]
    best = max(scored, key=lambda s: (s[0], s[1]), default=(0, 0, ""))
    return best[2] if best[0] else None


def compile_question(question_id: str, question: str, catalog: Catalog) -> Plan:
    """The plan that a question's wording asks for."""
    low = question.lower()
    plan = Plan(question_id, question, groups=tuple(g for g in catalog.groups if re.search(rf"\b{re.escape(g.lower())}\b", low)))
    kinds = tuple(v for k, v in CONTENT_KINDS.items() if re.search(rf"\b{k}(?:e?s)?\b", low))
    topics, limit, bound = topics_of(question), threshold_of(question), bind_field(question, catalog.fields)
    if len(topics) > 1 and re.search(r"\b(?:not|never|no|absent|missing|without)\b", low):
        return replace(plan, shape="absence", topics=topics, confident=True, operations=("filter", "count"))
    if kinds and re.search(r"\bhow many\b|\bcontents\b|\blist", low):
        return replace(plan, shape="contents_index", categories=kinds, confident=True, operations=("group_by", "count"))
    if re.search(r"\bunits?\b", low) and re.search(r"\b(?:different|other|another|inconsistent|odd)\b", low):
        return replace(plan, shape="unit_outlier", field=bound, confident=True, operations=("group_by", "filter"))
    if re.search(r"\b(?:contradict\w*|conflict\w*|claims?)\b", low):
        return replace(plan, shape="claim_conflict", field=bound, direction="min" if re.search(_MIN, low) else "max", confident=True, operations=("join", "compare"))
    if re.search(RELATION_CUES, low):
        return replace(plan, shape="relation", confident=True, operations=("filter", "join"))
    for kind, cue in NEEDLE_CUES.items():
        if re.search(cue, low):
            return replace(plan, shape="needle", kind=kind, phrase=subject_of(question), confident=True, operations=("filter",))
    if re.search(r"\byears?\b|\bfounded\b|\bestablished\b", low) and re.search(r"\b(?:closest|nearest|apart|between|after|before)\b", low):
        event = re.search(r"[\"“']([^\"”']{3,60})[\"”']", question)
        return replace(plan, shape="dated_event", field=bound, phrase=event[1] if event else "", confident=event is not None, operations=("join", "date_difference"))
    if limit and re.search(r"\bhow many\b|\bwhich\b|\blist\b", low):
        return replace(plan, shape="count_by_threshold", field=bound, comparator=limit[0], threshold=limit[1], confident=bound is not None, operations=("filter", "count", "list"))
    if re.search(_MAX, low) or re.search(_MIN, low):
        stated = tuple(s for s in catalog.statuses if re.search(rf"\b{re.escape(s.lower())}\b", low))
        return replace(plan, shape="extremum", field=bound, statuses=stated, direction="max" if re.search(_MAX, low) else "min", confident=bound is not None, operations=("argmax" if re.search(_MAX, low) else "argmin",))
    if re.search(r"\bhow many\b", low):
        return replace(plan, shape="count_entities", confident=True, operations=("group_by", "count") if plan.groups else ("count",))
    return plan


def routed(plan: Plan, proposal: dict, catalog: Catalog) -> Plan:
    """A router's proposal, if every argument is in the catalog and none that the shape needs is missing; else the plan as it was.

    A threshold of 0 is an argument like any other.
    """
    shape = proposal.get("shape")
    if shape not in SHAPES or not proposal.get("confident"):
        return plan
    known = {k: v for k, v in proposal.items() if k in ("field", "comparator", "threshold", "direction", "topics", "categories", "groups")}
    if known.get("field") is not None and known["field"] not in catalog.fields:
        return plan
    if not set(known.get("groups", ())) <= set(catalog.groups) or known.get("comparator", "gte") not in ("gt", "gte", "lt", "lte") or known.get("direction", "max") not in ("max", "min", None):
        return plan
    if any(known.get(a) is None or known.get(a) == () for a in REQUIRED.get(shape, ())):
        return plan
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in known.items()}
    return replace(plan, shape=shape, confident=True, **known)
