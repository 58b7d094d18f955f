"""Tokens of text and source code, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Which characters make a token, and where it changes into its parts. Fixed values.
TOKEN, PART = "[A-Za-z0-9_]+", "(?<=[a-z0-9])(?=[A-Z])"


def _parts(raw: Column) -> Column:
    marked = F.regexp_replace(raw, PART, "_")
    return F.filter(F.split(marked, "_"), lambda p: p != "")


def tokenize(text: Column) -> Column:
    """``array<string>``: runs of ASCII letters, digits and underscores in lower case, in order, with repeats.

    A run with an inner underscore or a change from small letter or digit to
    capital is followed by its parts. Null and blank texts give an empty array.
    """

    def expand(raw: Column) -> Column:
        parts = _parts(raw)
        lowered = F.transform(parts, lambda p: F.lower(p))
        none = F.array().cast("array<string>")
        return F.concat(F.array(F.lower(raw)), F.when(F.size(parts) > 1, lowered).otherwise(none))

    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.flatten(F.transform(runs, expand))


def has_text(text: Column) -> Column:
    """True if there is anything but white space (as Python's ``str.strip`` sees it); null is false."""
    return F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))
