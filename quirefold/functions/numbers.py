"""Numbers in text, in plain Python; ``scalars.parse_number`` reads them alike as a column expression."""

from __future__ import annotations

import re

# Scale words, longest first among those that end alike.
SCALES = (("trillion", 1e12), ("thousand", 1e3), ("million", 1e6), ("billion", 1e9), ("mln", 1e6), ("mil", 1e6), ("bln", 1e9), ("bil", 1e9), ("b", 1e9), ("k", 1e3))


def number(raw: str) -> float | None:
    """The number in a text, or None."""
    t = re.sub("[$€£¥₩]", "", raw.strip().lower()).replace(" ", " ").replace(" ", " ")
    minus = bool(re.fullmatch(r"\(.*\)", t))
    t = t[1:-1] if minus else t
    if t.startswith("-"):
        minus, t = True, t[1:]
    t, scale = t.replace("%", "").strip(), 1.0
    for word, factor in SCALES:
        if t.endswith(word) and t[: -len(word)].strip():
            t, scale = t[: -len(word)].strip(), factor
            break
    point, comma = t.rfind("."), t.rfind(",")
    if point >= 0 and comma > point:
        t = t.replace(".", "").replace(",", ".")
    elif point < 0 and re.fullmatch(r"[^,]*,\d{1,2}", t):
        t = t.replace(",", ".")
    t = t.replace(",", "").replace(" ", "")
    if not re.fullmatch(r"\+?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?", t):
        return None
    return float(t) * scale * (-1 if minus else 1)


def split_leading(text: str) -> tuple[str, str] | None:
    """(number, rest) of a text that begins with a number; a sign, ``<`` or ``>`` belongs to it."""
    at = 0
    for allowed in ("<>", "-"):
        if text[at : at + 1] and text[at] in allowed:
            at += 1
        while text[at : at + 1].isspace():
            at += 1
    end = at
    while end < len(text) and (text[end].isdecimal() or (text[end] in ".," and end > at)):
        end += 1
    return (text[:end], text[end:].strip()) if end > at else None


def written(value: float) -> str:
    """A number as an answer states it: whole ones in full, others with two decimals at most."""
    whole = round(value)
    return str(whole) if abs(value - whole) < 1e-9 * max(1.0, abs(value)) else f"{value:.2f}".rstrip("0").rstrip(".")
