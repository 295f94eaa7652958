"""Quality rules as a bitmask ledger, in built-in functions only.

``ledger`` evaluates every rule once and stores the measurements and one failure bit for
each rule.  A policy is a version and a mask: applying it, comparing versions and asking what a
rule alone rejects are then bitwise operations on the ledger, never another look at the texts.

Measurements: ``n_words``; ``word_chars``, code points in words; ``n_symbols``, characters of
``#*$%&|<>``; ``n_upper``, upper-case letters; ``n_lines``, lines with a word, and ``n_dup_lines``,
those equal to an earlier one; ``n_repeat_words``, words inside 8-word windows that occur twice or
more in the text, the first included.

Defined results: null, empty and blank texts measure 0 throughout and fail ``few_words``; rows
are judged one by one; extra columns pass through, and measurements take the place of columns of
the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import words

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once a row."""
    return F.transform(F.array(value), then)[0]


def _repeat_words(w: Column) -> Column:
    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    def covered(places: Column) -> Column:
        gaps = F.zip_with(F.slice(places, 2, F.size(places)), F.slice(places, 1, F.size(places) - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(WINDOW), lambda s, g: s + g)

    def repeated(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(r: Column) -> Column:
            equal = lambda x, k: (F.try_element_at(r, k + 2)["h"] == x["h"]) | ((k > 0) & (F.try_element_at(r, F.greatest(k, F.lit(1)))["h"] == x["h"]))
            return F.array_sort(F.transform(F.filter(r, lambda x, k: F.coalesce(equal(x, k), F.lit(False))), lambda x: x["i"]))

        return let(ranked, lambda r: let(places(r), covered))

    return F.when(F.size(w) < WINDOW + 1, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h))))


def _measures(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeat_words(w).alias("n_repeat_words"))
    of_lines = lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    return F.struct(let(words(text), of_words).alias("w"), let(lines, of_lines).alias("l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("n_symbols"), F.regexp_count(text, F.lit(r"\p{Lu}")).alias("n_upper"))


#: Rules by bit: name and failing condition over the measurements.  New rules take new bits; a bit never changes its meaning.
RULES = (
    ("few_words", lambda m: m["n_words"] < 20),
    ("repeated_words", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    ("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    ("duplicate_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    ("upper_case", lambda m: 2 * m["n_upper"] > m["word_chars"]),
    ("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 14 * m["n_words"])),
)
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_words"))
FULL = Policy("full-1", tuple(BITS))


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``measures`` of longs and ``fail_bits``, one bit for each failed rule."""
    raw = docs.withColumn("measures", _measures(F.coalesce(F.col(text_col), F.lit(""))))
    place = {"n_words": "w.n_words", "word_chars": "w.word_chars", "n_repeat_words": "w.n_repeat_words", "n_lines": "l.n_lines", "n_dup_lines": "l.n_dup_lines"}
    # The scores are needed by every rule: cast in a step of its own, so that they are computed once.
    flat = raw.withColumn("measures", let(F.col("measures"), lambda x: F.struct(*(_path(x, place.get(n, n)).cast("long").alias(n) for n in MEASURES))))
    return flat.withColumn("fail_bits", let(F.col("measures"), lambda x: _bits(x)))


def _path(x: Column, path: str) -> Column:
    for part in path.split("."):
        x = x[part]
    return x


def _bits(x: Column) -> Column:
    bits = F.lit(0).cast("long")
    n = {k: x[k] for k in MEASURES}
    for k, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(rule[1](n), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def apply_policy(entries: DataFrame, policy: Policy, into: str = "kept") -> DataFrame:
    """Adds the verdict of a policy: true where no rule of its mask failed."""
    return entries.withColumn(into, F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0)


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects.  One small aggregate by bitmask, whatever the corpus size."""
    mask = F.lit(policy.mask).cast("long")
    groups = entries.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in policy.rules))).alias("r")
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return groups.select("bits", "n", rules).groupBy(F.lit(policy.version).alias("version"), F.col("r.rule").alias("rule")).agg(F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"))
