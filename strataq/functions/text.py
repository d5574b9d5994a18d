"""Text expressions: tokens of identifiers, lines, names of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric runs of more than one character, with camel case and underscores taken apart."""
    apart = F.lower(F.translate(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "_", " "))
    return F.filter(F.regexp_extract_all(apart, F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 1)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot; names that begin with their only dot have none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def cut(text: Column, n: int, marker: str) -> Column:
    """At most ``n`` characters, with a marker where more were there."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(marker))).otherwise(text)


def ladder(count: Column, bounds: list[int]) -> Column:
    """1, 2, ... by the first bound that the count is below; one more beyond all."""
    out = F.lit(float(len(bounds) + 1))
    for i, b in reversed(list(enumerate(bounds))):
        out = F.when(count < b, F.lit(i + 1.0)).otherwise(out)
    return out
