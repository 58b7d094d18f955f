"""Half-open character spans of texts, as column expressions (folds over lines and paragraphs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import has_text

SPANS = "array<struct<s:int,e:int>>"


def check_size(size: int) -> int:
    if not isinstance(size, int) or size <= 0:
        raise ValueError("max_chunk_size must be a positive integer")
    return size


def _none() -> Column:
    return F.array().cast(SPANS)


def _span(s: Column, e: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))


def _split(start: Column, end: Column, size: int) -> Column:
    steps = F.when(end > start, F.sequence(start, end - 1, F.lit(size)))
    return F.coalesce(F.transform(steps, lambda k: _span(k, F.least(k + size, end))), _none())


def hard_split(text: Column, size: int) -> Column:
    """Spans of exactly ``size`` characters and a rest."""
    check_size(size)
    return _split(F.lit(0), F.length(F.coalesce(text, F.lit(""))), size)


def line_spans(text: Column, size: int, base: Column | None = None) -> Column:
    """Whole lines packed greedily into spans of at most ``size``; longer lines are split hard.

    All characters are covered. What a hard split leaves over is not joined
    with the next line. ``base`` is added to all offsets.
    """
    check_size(size)
    lines = F.transform(F.filter(F.split(text, r"(?<=\n)"), lambda x: x != ""), lambda x: F.length(x))
    zero = F.lit(0)
    start = F.struct(_none().alias("o"), zero.alias("cs"), zero.alias("ce"), zero.alias("p"))

    def step(a: Column, n: Column) -> Column:
        held = F.when(a["ce"] > a["cs"], F.array(_span(a["cs"], a["ce"]))).otherwise(_none())
        end = a["p"] + n
        return (
            F.when(n > size, F.struct(F.concat(a["o"], held, _split(a["p"], end, size)).alias("o"), end.alias("cs"), end.alias("ce"), end.alias("p")))
            .when(a["ce"] - a["cs"] + n > size, F.struct(F.concat(a["o"], held).alias("o"), a["p"].alias("cs"), end.alias("ce"), end.alias("p")))
            .otherwise(F.struct(a["o"].alias("o"), a["cs"].alias("cs"), end.alias("ce"), end.alias("p")))
        )

    def finish(a: Column) -> Column:
        return F.concat(a["o"], F.when(a["ce"] > a["cs"], F.array(_span(a["cs"], a["ce"]))).otherwise(_none()))

    spans = F.aggregate(lines, start, step, finish)
    return spans if base is None else F.transform(spans, lambda x: _span(x["s"] + base, x["e"] + base))


def paragraph_spans(text: Column) -> Column:
    """Spans of the stretches between runs of two or more line feeds, without blank ones."""
    pieces = F.split(F.coalesce(text, F.lit("")), r"(?<=\n\n)(?!\n)")
    start = F.struct(_none().alias("o"), F.lit(0).alias("p"))

    def step(a: Column, x: Column) -> Column:
        own = F.regexp_replace(x, r"\n{2,}\z", "")
        span = F.array(_span(a["p"], a["p"] + F.length(own)))
        return F.struct(
            F.when(has_text(own), F.concat(a["o"], span)).otherwise(a["o"]).alias("o"), (a["p"] + F.length(x)).alias("p")
        )

    return F.aggregate(pieces, start, step, lambda a: a["o"])


def pack_spans(spans: Column, size: int) -> Column:
    """Neighbouring spans joined while the whole, gaps included, is at most ``size``."""
    check_size(size)
    start = F.struct(_none().alias("o"), F.lit(-1).alias("gs"), F.lit(-1).alias("ge"))

    def step(a: Column, x: Column) -> Column:
        return (
            F.when(a["gs"] < 0, F.struct(a["o"].alias("o"), x["s"].alias("gs"), x["e"].alias("ge")))
            .when(x["e"] - a["gs"] <= size, F.struct(a["o"].alias("o"), a["gs"].alias("gs"), x["e"].alias("ge")))
            .otherwise(F.struct(F.concat(a["o"], F.array(_span(a["gs"], a["ge"]))).alias("o"), x["s"].alias("gs"), x["e"].alias("ge")))
        )

    def finish(a: Column) -> Column:
        return F.when(a["gs"] < 0, a["o"]).otherwise(F.concat(a["o"], F.array(_span(a["gs"], a["ge"]))))

    return F.aggregate(spans, start, step, finish)


def markdown_spans(text: Column, size: int = 2000) -> Column:
    """Paragraphs packed up to ``size``; a longer paragraph is cut at lines, a longer line hard. Blank texts give none."""
    groups = pack_spans(paragraph_spans(text), size)

    def fit(g: Column) -> Column:
        inside = F.substring(text, g["s"] + 1, g["e"] - g["s"])
        return F.when(g["e"] - g["s"] <= size, F.array(_span(g["s"], g["e"]))).otherwise(line_spans(inside, size, g["s"]))

    return F.when(has_text(text), F.flatten(F.transform(groups, fit))).otherwise(_none())


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two source structs; 0 for other files, touching or empty spans, or nulls."""
    s1, e1, s2, e2 = (x[k] for x in (a, b) for k in ("first_character_index", "last_character_index"))
    shared = F.least(e1, e2) - F.greatest(s1, s2)
    whole = F.greatest(e1, e2) - F.least(s1, s2)
    given = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()  # least and greatest pass over nulls
    return F.when((a["file_path"] == b["file_path"]) & given & (shared > 0), shared / whole).otherwise(F.lit(0.0))
