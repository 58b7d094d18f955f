"""Answers from prompts by a pluggable generator."""

from __future__ import annotations

import re
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prompts import prompts

# What is said without sources, and the greatest length of an answer. Fixed values.
NO_SOURCES = "No relevant sources found -- cannot answer."
MAX_NEW_TOKENS = 300
#: White space that is drawn together within an answer, and (with all of Unicode's space separators) taken off its ends.
BLANKS = "\t\n\f\r "
ENDS = BLANKS + "\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


class Generator(Protocol):
    """Maps a prompt to an answer; must be picklable. Loaded models belong into a module global of the worker."""

    def generate(self, prompt: str) -> str: ...


class ExtractiveGenerator:
    """Stand-in that needs no model: gives back the first lines of the first source of the prompt."""

    def __init__(self, max_chars: int = 300):
        self.max_chars = max_chars

    def generate(self, prompt: str) -> str:
        context = prompt.partition("\n\nContext:\n")[2].rpartition("\n\nQuestion: ")[0]
        body = context.partition("]\n")[2] if context.startswith("[Source: ") else context
        return re.sub(f"[{BLANKS}]+", " ", body).strip(ENDS)[: self.max_chars].strip(ENDS)


def generate(prompted: DataFrame, generator: Generator) -> DataFrame:
    """``(question_id, answer)``; a row whose generation fails says so, the others go on."""
    kind = dict(prompted.dtypes)["question_id"]

    def run(batches):
        for b in batches:
            answers = []
            for p in b.column(1).to_pylist():
                try:
                    answers.append(generator.generate(p).strip(ENDS))
                except Exception as e:  # one bad row must not end the batch
                    answers.append(f"Generation failed: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(answers, pa.string())], names=["question_id", "answer"])

    return prompted.select("question_id", "prompt").mapInArrow(run, f"question_id {kind}, answer string")


def answer_results(results: DataFrame, files: DataFrame, generator: Generator | None = None) -> DataFrame:
    """``(question_id, question, retrieved_sources, answer)`` for every row of ``results``.

    Rows without sources get ``NO_SOURCES`` and never reach the generator.
    ``question_id`` must be unique among the rows with sources.
    """
    results = results.select("question_id", "question", "retrieved_sources")
    empty = F.coalesce(F.size("retrieved_sources"), F.lit(0)) < 1
    canned = results.where(empty).withColumn("answer", F.lit(NO_SOURCES))
    asked = results.where(~empty)
    made = generate(prompts(asked, files), generator or ExtractiveGenerator())
    cols = ["question_id", "question", "retrieved_sources", "answer"]
    return canned.select(*cols).unionByName(asked.join(made, "question_id").select(*cols))
