"""Cleaning expressions. All are plain Columns, so batch and streaming plans share them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The code points Python's str.split()/str.strip() treat as whitespace.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The same without line feed, for work inside one line.
WS_IN_LINE = r"\t\x0b-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _text(code: Column | str) -> Column:
    return F.coalesce(F.col(code) if isinstance(code, str) else code, F.lit(""))


def collapse_whitespace(code: Column | str) -> Column:
    """Every whitespace run becomes one space, ends stripped, null becomes the empty string."""
    return F.trim(F.regexp_replace(_text(code), f"[{WS}]+", " "))


def normalise_newlines(code: Column | str) -> Column:
    """CRLF and CR become LF, null becomes the empty string."""
    return F.regexp_replace(_text(code), r"\r\n?", "\n")


def rstrip_lines(code: Column | str) -> Column:
    """Newlines normalised, trailing whitespace of every line removed.

    The look-behind plus possessive run visits each whitespace run once, so one long run inside a
    line stays linear.
    """
    run = rf"(?<![{WS_IN_LINE}])[{WS_IN_LINE}]++(?=\n|\z)"
    return F.regexp_replace(normalise_newlines(code), run, "")


def split_lines(normalised: Column | str) -> Column:
    """Lines of newline-normalised text; empty tails are kept, so "" is one empty line."""
    return F.split(normalised, "\n", -1)


def is_blank(line: Column) -> Column:
    return line.rlike(rf"^[{WS}]*\z")
