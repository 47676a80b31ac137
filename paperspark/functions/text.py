"""Column functions over text: strip, newline folding, validity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import MAX_TEXT_CHARS


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Remove leading and trailing Unicode whitespace (like ``str.strip``).

    ``trim`` only removes spaces; this also removes newlines, tabs and other
    Unicode white space.
    """
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def newline_to_space(col) -> Column:
    return F.replace(_c(col), F.lit("\n"), F.lit(" "))


def first_token(col) -> Column:
    """First whitespace-separated token, NULL when there is none."""
    tok = F.split(strip_ws(col), r"(?U)\s+").getItem(0)
    return F.when(tok != "", tok)


def text_validity(col, max_chars: int = MAX_TEXT_CHARS) -> Column:
    """Struct ``(is_valid, reason)`` for a text handed to an embedder.

    Invalid: NULL, blank (only Unicode white space, including a no-break
    space), or longer than ``max_chars`` characters.
    """
    c = _c(col)
    reason = (
        F.when(c.isNull(), F.lit("text is NULL"))
        .when(~c.rlike(r"(?U)\S"), F.lit("text is empty or white space"))
        .when(F.length(c) > max_chars, F.lit(f"text exceeds {max_chars} characters"))
    )
    return F.struct(reason.isNull().alias("is_valid"), F.coalesce(reason, F.lit("valid")).alias("reason"))
