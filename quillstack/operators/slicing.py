"""Slices of a text's lines as Column expressions: head, tail, both with a gap, and numbered lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import count_lines, end_newline


def head(text: Column, n: int) -> Column:
    """The first n lines, byte for byte."""
    if n <= 0:
        return F.lit("")
    cut = F.concat(F.substring_index(text, "\n", n), F.lit("\n"))
    return F.when(count_lines(text) <= n, text).otherwise(cut)


def tail(text: Column, n: int) -> Column:
    """The last n lines, byte for byte."""
    if n <= 0:
        return F.lit("")
    ended = F.endswith(text, F.lit("\n"))
    body = F.when(ended, F.left(text, F.length(text) - 1)).otherwise(text)
    cut = F.concat(F.substring_index(body, "\n", -n), F.when(ended, "\n").otherwise(""))
    return F.when(count_lines(text) <= n, text).otherwise(cut)


def excerpt(text: Column, first: int, last: int = 0, numbers: bool = False) -> Column:
    """Head and tail of a text with a gap marker between; a negative `first` or parts that meet give the whole text.

    With `numbers`, each line has its row number in front, padded to the width of the text's last row.
    """
    rows, last = count_lines(text), max(last, 0)
    whole = F.lit(True) if first < 0 else rows <= first + last
    if numbers:
        all_, top, bottom = _number(text, F.lit(1), rows), _number(head(text, first), F.lit(1), rows), _number(tail(text, last), rows - last + 1, rows)
        all_ = end_newline(all_)
    else:
        all_, top, bottom = end_newline(text), head(text, first), tail(text, last)
    parts = [top]
    if first > 0 and last > 0:
        parts.append(F.concat(F.lit("... ("), (rows - first - last).cast("string"), F.lit(" rows skipped)\n")))
    return F.when(whole, all_).otherwise(F.concat(*parts, bottom))


def lines_option(text: Column, n: int, numbers: bool = False) -> Column:
    """The -n option: n lines, the larger half of them from the start."""
    return excerpt(text, (n + 1) // 2, n // 2, numbers)


def _number(text: Column, start: Column, rows: Column) -> Column:
    ended = F.endswith(text, F.lit("\n"))
    body = F.when(ended, F.left(text, F.length(text) - 1)).otherwise(text)
    width = F.length(F.greatest(rows, F.lit(1)).cast("string"))

    def line(x: Column, i: Column) -> Column:
        number = (start + i).cast("string")
        return F.concat(F.repeat(F.lit(" "), width - F.length(number)), number, F.lit(": "), x)

    out = F.concat(F.array_join(F.transform(F.split(body, "\n", -1), line), "\n"), F.when(ended, "\n").otherwise(""))
    return F.when(text == "", "").otherwise(out)


def is_compact(text: Column, first: int, last: int) -> Column:
    """Whether only a header is shown: nothing is asked for or there is nothing."""
    return F.lit(first == 0 and last == 0) | (text == "")
