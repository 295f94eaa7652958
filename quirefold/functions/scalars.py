"""Numbers, units, dates, names and sentences: built-in column expressions throughout.

Every function takes columns (or names) and returns a column; null in gives null out, and what cannot be
read gives null rather than an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import let, steps

# Scale words, unit factors and month names of the formats read here.
SCALES = {"million": 1e6, "mln": 1e6, "mil": 1e6, "billion": 1e9, "bln": 1e9, "bil": 1e9, "b": 1e9, "trillion": 1e12, "thousand": 1e3, "k": 1e3}
METRES = {"m": 1.0, "meter": 1.0, "meters": 1.0, "metre": 1.0, "metres": 1.0, "km": 1000.0, "kilometer": 1000.0, "kilometers": 1000.0, "kilometre": 1000.0, "kilometres": 1000.0, "mi": 1609.344, "mile": 1609.344, "miles": 1609.344, "ft": 0.3048, "foot": 0.3048, "feet": 0.3048}
SQUARE_KM = {
    "km2": 1.0, "km²": 1.0, "sq km": 1.0, "square kilometer": 1.0, "square kilometers": 1.0, "square kilometre": 1.0, "square kilometres": 1.0,
    "mi2": 2.58999, "sq mi": 2.58999, "sq mile": 2.58999, "sq miles": 2.58999, "square mile": 2.58999, "square miles": 2.58999, "ha": 0.01, "hectare": 0.01, "hectares": 0.01, "acre": 0.00404686, "acres": 0.00404686,
}
KILOGRAMS = {"kg": 1.0, "kilogram": 1.0, "kilograms": 1.0, "g": 0.001, "gram": 0.001, "grams": 0.001, "lb": 0.453592, "lbs": 0.453592, "pound": 0.453592, "pounds": 0.453592, "ton": 1000.0, "tons": 1000.0, "tonne": 1000.0, "tonnes": 1000.0}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

_USUAL = r"^(\d{1,3}(,\d{3})+|\d+)(\.\d+)?$"
_NUMBER = r"^\+?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"


_SCALE_WORD = rf"(?s)^(.*\S)\s*({'|'.join(sorted(SCALES, key=len, reverse=True))})$"


def _scaled(t: Column) -> Column:
    """(text without its scale word, factor)."""
    factor = F.create_map(*(F.lit(x) for pair in SCALES.items() for x in pair))
    return F.when(t.rlike(_SCALE_WORD), F.struct(F.regexp_extract(t, _SCALE_WORD, 1).alias("text"), factor[F.regexp_extract(t, _SCALE_WORD, 2)].alias("scale"))).otherwise(F.struct(t.alias("text"), F.lit(1.0).alias("scale")))


def _with_point(t: Column) -> Column:
    """Digits with a decimal point: of comma and point, the later is the decimal; a lone comma before one or two digits is one too."""
    last_comma, last_point = F.length(t) - F.locate(",", F.reverse(t)), F.length(t) - F.locate(".", F.reverse(t))
    comma, point = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
    plain = F.regexp_replace(t, ",", "")
    european = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    both = F.when(last_point > last_comma, plain).otherwise(european)
    return F.when(comma & point, both).when(comma & t.rlike(r"^[^,]*,\d{1,2}$"), F.replace(t, F.lit(","), F.lit("."))).otherwise(plain)


def parse_number(raw: Column | str) -> Column:
    """The number in a text: separators of either style, percent, currency, parentheses or minus for negatives, scale words; else null."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    cleaned = F.lower(F.trim(F.translate(raw, "\u00a0\u2009\t\n\r$€£¥₩%", "     ")))

    def unsigned(t: Column) -> Column:
        bracketed = t.rlike(r"^\(.*\)$")
        inner = F.when(bracketed, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
        return F.struct((bracketed | inner.startswith("-")).alias("minus"), F.trim(F.regexp_replace(inner, "^-", "")).alias("text"))

    def value(u: Column) -> Column:
        def of(s: Column) -> Column:
            t = s["text"]
            sign = s["scale"] * F.when(u["minus"], -1.0).otherwise(1.0)
            digits = F.replace(_with_point(t), F.lit(" "), F.lit(""))
            return F.when(t.rlike(_USUAL), F.replace(t, F.lit(","), F.lit("")).try_cast("double") * sign).otherwise(let(digits, lambda d: F.when(d.rlike(_NUMBER), d.try_cast("double") * sign)))

        return let(_scaled(u["text"]), of)

    # Numbers in the usual form need no reading, and stay inside generated code.
    usual = F.translate(raw, "$€£¥₩%,", "")
    return F.when(F.ltrim(raw).rlike(r"^[$€£¥₩]?(\d{1,3}(,\d{3})+(\.\d+)?|\d+(\.\d+)?)%?$"), usual.try_cast("double")).when(F.trim(raw) != "", steps(cleaned, unsigned, value))


def _factor(unit: Column, table: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[F.lower(F.trim(unit))]


def normalize_unit(value: Column, source: Column, target: Column) -> Column:
    """Convert between units of distance, area or mass; null across dimensions; any unit converts to itself."""
    same = F.lower(F.trim(source)) == F.lower(F.trim(target))
    return F.when(same, value).otherwise(F.coalesce(*(value * _factor(source, t) / _factor(target, t) for t in (METRES, SQUARE_KM, KILOGRAMS))))


def area_km2(value: Column, unit: Column) -> Column:
    """Square kilometres of a value whose unit is an area; other values as they are."""
    return value * F.coalesce(_factor(unit, SQUARE_KM), F.lit(1.0))


def _month(name: Column) -> Column:
    table = {m: k for k, m in enumerate(MONTHS, 1)} | {m[:3]: k for k, m in enumerate(MONTHS, 1)} | {"sept": 9}
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[F.lower(name)]


def normalize_date(raw: Column | str) -> Column:
    """ISO text of a date, or ``475 BC``; day before month where both could be; a year alone is its first day; no calendar check."""
    raw = F.col(raw) if isinstance(raw, str) else raw

    def read(t: Column) -> Column:
        part = lambda pattern, k: F.regexp_extract(t, pattern, k)
        two = lambda c: F.lpad(c, 2, "0")
        iso = lambda y, m, d: F.concat(y, F.lit("-"), two(m), F.lit("-"), two(d))
        month = lambda c: _month(c).cast("string")
        era, ymd, dmy = r"(?i)\b(\d{1,5})\s*(BCE|BC)\b", r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$"
        mdy, dmonth, year = r"^(\p{L}+)\.?\s+(\d{1,2}),?\s+(\d{4})$", r"^(\d{1,2})\s+(\p{L}+)\.?,?\s+(\d{4})$", r"^\d{4}$"
        # The usual forms first; none of the anchored ones can hold an era.
        return (
            F.when(t.rlike(ymd), iso(part(ymd, 1), part(ymd, 2), part(ymd, 3)))
            .when(t.rlike(year), F.concat(t, F.lit("-01-01")))
            .when(t.rlike(dmonth), iso(part(dmonth, 3), month(part(dmonth, 2)), part(dmonth, 1)))
            .when(t.rlike(mdy), iso(part(mdy, 3), month(part(mdy, 1)), part(mdy, 2)))
            .when(t.rlike(dmy) & (part(dmy, 2).try_cast("int") > 12), iso(part(dmy, 3), part(dmy, 1), part(dmy, 2)))
            .when(t.rlike(dmy), iso(part(dmy, 3), part(dmy, 2), part(dmy, 1)))
            .when(t.rlike(era), F.concat(part(era, 1), F.lit(" "), F.upper(part(era, 2))))
        )

    return let(F.trim(raw), read)


def field_id(label: Column | str) -> Column:
    """Identifier of what a label measures: before any colon, without parentheses, as a slug of at most 80 characters."""
    label = F.col(label) if isinstance(label, str) else label
    slug = F.trim(F.regexp_replace(F.regexp_replace(F.substring_index(F.lower(label), ":", 1), r"\([^)]*\)", " "), "[^a-z0-9]+", "_"), F.lit("_"))
    return let(F.substring(slug, 1, 80), lambda s: F.when(s == "", "number").otherwise(s))


def written_number(value: Column) -> Column:
    """A number as an answer states it: whole ones in full, others with two decimals at most."""
    whole = F.round(value, 0)
    return F.when(F.abs(value - whole) < 1e-9 * F.greatest(F.lit(1.0), F.abs(value)), whole.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), "0+$", ""), r"\.$", ""))


def extracted_value(raw: Column, kind: Column, provided: Column, unit: Column, target: Column) -> Column:
    """A value read from text as text: an era wins; dates and years become ISO; a number (the text's own, or the first in it, with its scale word) is converted to the target unit; else what was provided, else the text.

    What a model provides gives way to a number that the text scales ("15 million").
    """
    inside = F.regexp_extract(raw, r"(?i)([-(]?\d[\d.,]*\)?(?:\s*(?:million|billion|trillion|thousand))?)", 1)
    number = F.coalesce(parse_number(raw), parse_number(F.regexp_replace(inside, r"[.,]+$", "")))
    converted = F.coalesce(F.when((unit != "") & (target != ""), normalize_unit(number, unit, target)), number)
    shown = lambda v: F.when(v == F.floor(v), v.cast("decimal(38,0)").cast("string")).otherwise(v.cast("string"))
    date = normalize_date(raw)
    return (
        F.when(raw.rlike(r"(?i)\b\d{1,5}\s*BCE?\b"), date)
        .when(kind.isin("date", "year") & date.isNotNull(), date)
        .when((kind == "number") & converted.isNotNull(), shown(converted))
        .otherwise(F.coalesce(provided, raw))
    )


def canonical_field(name: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """One spelling of a field's name: lower case, ``&`` as "and", single underscores; then its alias.  Compatibility forms of letters must be levelled before (``document.source_key``)."""
    name = F.col(name) if isinstance(name, str) else name
    slug = F.trim(F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))
    if not aliases:
        return slug
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return let(slug, lambda s: F.coalesce(table[s], s))


def entity_name(name: Column | str) -> Column:
    """Trimmed, single spaces, no closing punctuation, case as it is."""
    name = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), r"[.,;:]+$", "")


def comparable(text: Column | str) -> Column:
    """Lower case, single spaces, no punctuation: for comparing answers."""
    text = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def sentences(text: Column | str) -> Column:
    """Sentences of a text: page marks removed, split after a full stop, exclamation or question mark, or at a blank line."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"\[Page \d+\]", " "), r"(?<=[.!?])\s+|\n\s*\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def bounded_confidence(value: Column) -> Column:
    return F.when(value.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value.cast("double"))))


def unit_of(label: Column) -> Column:
    """Unit named in a label: its parenthesis if that is a unit, else a unit word; '' if none."""
    folded = F.lower(label)
    inside = F.trim(F.regexp_extract(folded, r"\(([^)]+)\)", 1))
    return (
        F.when(inside.isin("m", "sq km", "sq miles", "years", "km/h"), inside)
        .when(inside == "sq mile", "sq miles")
        .when(folded.rlike(r"\bsq\s*km\b"), "sq km")
        .when(folded.rlike(r"\bsq\s*miles?\b"), "sq miles")
        .when(folded.rlike(r"\bmetres?\b|\bmeters?\b"), "m")
        .when(folded.rlike(r"\b(bc|bce)\b"), "year_bc")
        .when(folded.contains("gigawatt"), "GWh")
        .otherwise(inside)
    )


def subject_of(label: Column) -> Column:
    """What a label measures in particular: the text after its colon, unless that is a number."""
    after = F.trim(F.regexp_replace(F.when(F.contains(label, F.lit(":")), F.regexp_extract(label, r":(.*)$", 1)).otherwise(""), r"\([^)]*\)", ""))
    return F.when(after.rlike(r"^[\d,.]+(\s*\w+)?$"), "").otherwise(after)


def card_value(raw: Column, label: Column) -> Column:
    """Number of a fact card: bounds marks dropped, millions by label, BC years negative."""
    folded = F.lower(label)
    value = parse_number(F.regexp_replace(raw, "[<>]", "")) * F.when(F.contains(folded, F.lit("million")), 1e6).otherwise(1.0)
    return F.when(folded.rlike(r"\b(bc|bce)\b"), -F.abs(value)).otherwise(value)


def json_span(text: Column) -> Column:
    """The JSON of a reply: code fences stripped, else the outermost object or array; null if none parses."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)^\s*```(json)?|```\s*$", ""), r"^\s+|\s+$", "")
    span = F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(F.try_parse_json(bare).isNotNull(), bare).when((span != "") & F.try_parse_json(span).isNotNull(), span)


def page_at(text: Column, offset: Column) -> Column:
    """Number of the last page mark before an offset."""
    return F.try_element_at(F.regexp_extract_all(F.substring(text, F.lit(1), offset), F.lit(r"\[Page (\d+)\]"), 1), F.lit(-1)).try_cast("int")


def content_hash(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def tercile(ordinal: Column, expected: Column) -> Column:
    """Third of the document an ordinal lies in: 0, 1 or 2."""
    return F.least(F.lit(2), F.floor(3 * F.greatest(ordinal - 1, F.lit(0)) / expected)).cast("int")
