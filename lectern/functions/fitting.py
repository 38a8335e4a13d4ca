"""Text wrapped to a width and set in the largest size that fits a box. Glyph widths are a parameter."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

LEAST, LEAST_SHARE, LEADING, FIRST = 5.5, 0.55, 1.2, 1.15


def plain_width(text: str) -> float:
    """Width in ems when no font is known: wide signs 1, marks 0, the rest one half."""
    return sum(0.0 if unicodedata.combining(c) else 1.0 if unicodedata.east_asian_width(c) in "WF" else 0.5 for c in text)


def wrapped(text: str, size: float, width: float, ems: Callable[[str], float] = plain_width) -> list[str]:
    """Lines no wider than width, broken at blanks; a word wider than a line is broken between characters."""
    fits = lambda s: ems(s) * size <= width
    words, start = [], 0
    value = (text or "").strip()
    for i in range(1, len(value) + 1):
        if i == len(value) or value[i - 1].isspace() and not value[i].isspace():
            words.append(value[start:i])
            start = i
    lines, line = [], ""
    for word in words:
        if line and not fits(line + word):
            lines.append(line.rstrip())
            line = ""
        if fits(word):
            line += word
            continue
        for c in word:
            if line and not fits(line + c):
                lines.append(line.rstrip())
                line = c.lstrip()
            else:
                line += c
    return [*lines, line.rstrip()] if line or not lines else lines


def fitted(text: str, width: float, height: float, preferred: float, strict: bool = False, ems: Callable[[str], float] = plain_width) -> tuple[float, list[str]] | None:
    """(size, lines) of the largest size between the least and the preferred one that fits, or None."""
    high = max(1.0, preferred)
    low = 1.0 if strict else max(LEAST, high * LEAST_SHARE)

    def lines_at(size: float) -> list[str] | None:
        lines = wrapped(text, size, width, ems)
        return lines if size * FIRST + (len(lines) - 1) * size * LEADING <= height + 0.01 else None

    if lines := lines_at(high):
        return high, lines
    if not (lines := lines_at(low)):
        return None
    best = low, lines
    for _ in range(16):
        middle = (low + high) / 2
        if lines := lines_at(middle):
            best, low = (middle, lines), middle
        else:
            high = middle
    return best


@F.pandas_udf(StructType([StructField("size", DoubleType()), StructField("lines", ArrayType(StringType()))]))
def fit_box(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for text, width, height, preferred in batches:
        found = [fitted(t or "", w, h, p) or (None, None) for t, w, h, p in zip(text, width, height, preferred)]
        yield pd.DataFrame({"size": [x[0] for x in found], "lines": [x[1] for x in found]})


def _direction(text: str | None, target: str | None) -> str:
    for c in text or "":
        kind = unicodedata.bidirectional(c)
        if kind in ("L", "R", "AL"):
            return "LTR" if kind == "L" else "RTL"
    return "RTL" if target in ("乌尔都文", "阿拉伯文", "希伯来文", "波斯文", "维吾尔文") else "LTR"


@F.pandas_udf(StringType())
def line_direction(text: pd.Series, target: pd.Series) -> pd.Series:
    """LTR or RTL by the first strong character of a line; without one, by the target language."""
    return pd.Series([_direction(t, g) for t, g in zip(text, target)])


def background(pixels: Column) -> Column:
    """The median of edge pixels (0..255) as a share of white with five decimals; white where there are none."""
    s, n = F.sort_array(pixels), F.size(pixels)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, F.round((low + high) / 2 / 255.0, 5)).otherwise(1.0)
