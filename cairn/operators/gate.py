"""What a prompt is about and what it may be answered from."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import fixed_values as V


def trivial_reason(prompt: Column, names_something: Column) -> Column:
    """Why a prompt is trivial; null if it isn't."""
    x = F.lower(F.trim(prompt))
    words = F.regexp_count(x, F.lit(r"\S+"))
    any_of = lambda patterns: x.rlike("|".join(f"(?:{p})" for p in patterns))
    return (
        F.when(x == "", "empty prompt")
        .when(x.rlike(V.AUTOMATED), "an automated message, not a prompt")
        .when(any_of(V.MECHANICAL), "mechanical edit")
        .when(any_of(V.EXPLAINING) & (words <= V.TRIVIAL_WORDS), "asks about code already on screen")
        .when(any_of(V.WEAKLY_MECHANICAL) & (words <= V.TRIVIAL_WORDS) & ~names_something, "short local edit naming nothing memory holds")
    )


def _strength(patterns: list[re.Pattern], text: str) -> int:
    """In how many separate places of a text a task shows: overlapping matches count once."""
    spans = sorted(m.span() for p in patterns for m in p.finditer(text))
    n, end = 0, -1
    for a, b in spans:
        if a >= end:
            n, end = n + 1, b
        else:
            end = max(end, b)
    return n


@F.pandas_udf(T.StringType())
def task_type(prompts: pd.Series) -> pd.Series:
    """The task with the most signals; ties go to the one named first; none: implement. Match positions are needed, which SQL expressions don't give."""
    compiled = {task: [re.compile(p) for p in patterns] for task, patterns in V.TASK_SIGNALS.items()}

    def of(prompt: str | None) -> str | None:
        if prompt is None:
            return None
        text = prompt.strip().lower()
        found = {task: _strength(patterns, text) for task, patterns in compiled.items()}
        best = max(found, key=lambda t: (found[t], -list(found).index(t)))
        return best if found[best] else "implement"

    return prompts.map(of)


def decision(trivial: Column, task: Column, words: Column, named: Column) -> Column:
    """Struct: profile, history (booleans), record_types, reason. ``named``: array of known entities in the prompt."""
    types = F.create_map(*(x for t, r in V.RECORD_TYPES.items() for x in (F.lit(t), F.array(*(F.lit(y) for y in r)))))
    out = lambda profile, history, reason, kinds=None: F.struct(F.lit(profile).alias("profile"), F.lit(history).alias("history"), (kinds if kinds is not None else F.expr("cast(array() as array<string>)")).alias("record_types"), reason.alias("reason"))
    return (
        F.when(trivial.isNotNull(), out(False, False, F.concat(F.lit("trivial prompt ("), trivial, F.lit(")"))))
        .when(words > V.LONG_PROMPT_WORDS, out(True, False, F.concat(words.cast("string"), F.lit("-word prompt is a paste, not a question"))))
        .when(F.size(named) > 0, out(True, True, F.concat(F.lit("prompt names "), F.array_join(F.slice(named, 1, 4), ", ")), F.try_element_at(types, task)))
        .otherwise(out(True, False, F.concat(task, F.lit(" prompt names nothing the history gate knows"))))
    )
