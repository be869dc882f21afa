"""Scalar expressions over text and numbers, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NEGATIONS = ("not ", "no ", "without ", "never ")


def entity_id(name: str | Column) -> Column:
    """Leading digits of the last path part, else that part without its suffix and with other characters than letters, digits, _ and - as _."""
    last = F.regexp_extract(name, r"([^/]*)/*$", 1)
    digits, stem = F.regexp_extract(last, r"^(\d+)", 1), F.regexp_replace(last, r"\.[^.]*$", "")
    return F.when(digits != "", digits).otherwise(F.regexp_replace(stem, r"[^A-Za-z0-9_-]+", "_"))


def first_decimal(text: str | Column) -> Column:
    """The first decimal number in a text; a comma is a point; null without one."""
    return F.regexp_extract(F.translate(text, ",", "."), r"([-+]?\d+(?:\.\d+)?)", 1).try_cast("double")


def mentions(text: str | Column, word: str, reach: int = 18) -> Column:
    """Whether `word` stands in the text without a negation in the `reach` characters before it."""
    low = F.lower(text)
    return F.exists(F.regexp_extract_all(low, F.lit(rf"(?s)(.{{0,{reach}}}){re.escape(word)}"), 1), lambda before: ~before.rlike("|".join(NEGATIONS)))


def supports(text: str | Column, words: list[str], excluded: list[str]) -> Column:
    low, any_of = F.lower(text), lambda xs: "|".join(map(re.escape, xs))
    return low.rlike(any_of(words)) & ~low.rlike(any_of(excluded))


def fenced_json(text: str | Column) -> Column:
    """The JSON object in a model's answer, fenced or bare, as VARIANT; null where there is none."""
    return F.try_parse_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1))


def slug(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s-]+", "_"), F.lit("_"))


def clock(seconds: str | Column) -> Column:
    """h:mm:ss of whole seconds."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def angle(x: Column, y: Column) -> Column:
    """Direction in degrees, 0..360."""
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def angular_distance(a: Column, b: Column) -> Column:
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360.0 - d)


def box_iou(a: str, b: str) -> Column:
    """Overlap over union of two structs x0, y0, x1, y1."""
    c = F.col
    w = F.greatest(F.lit(0.0), F.least(c(f"{a}.x1"), c(f"{b}.x1")) - F.greatest(c(f"{a}.x0"), c(f"{b}.x0")))
    h = F.greatest(F.lit(0.0), F.least(c(f"{a}.y1"), c(f"{b}.y1")) - F.greatest(c(f"{a}.y0"), c(f"{b}.y0")))
    area = lambda n: (c(f"{n}.x1") - c(f"{n}.x0")) * (c(f"{n}.y1") - c(f"{n}.y0"))
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def jaccard(a: str | Column, b: str | Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def redacted(text: str | Column) -> Column:
    """Key material and addresses in a text replaced by a mark."""
    out = F.regexp_replace(text, r"(?i)\b(token|secret|password|api[_-]?key)\b(\s*[=:]\s*)\"?[A-Za-z0-9_\-]{8,}\"?", "$1$2[redacted]")
    return F.regexp_replace(out, r"\b\d{1,3}(\.\d{1,3}){3}\b", "[address]")
