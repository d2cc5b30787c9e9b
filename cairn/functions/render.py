"""Served statements, records and passages as the text that is handed out; redacted last, so nothing sensitive leaves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.redact import withheld


def citation(uri: Column, start: Column, end: Column, locator: Column) -> Column:
    """The exact place: ``path:10-17``, ``path:4``, ``book.ipynb (cell 7)``, or the address alone."""
    lined = F.coalesce(start, F.lit(0)) > 0
    span = F.concat(uri, F.lit(":"), start.cast("string"), F.when(end > start, F.concat(F.lit("-"), end.cast("string"))).otherwise(""))
    return F.when(lined, span).when(F.coalesce(locator, F.lit("")) != "", F.concat(uri, F.lit(" ("), locator, F.lit(")"))).otherwise(uri)


def statement(said: Column, scope: Column) -> Column:
    return withheld(F.concat(F.lit("- "), said, F.when(F.coalesce(scope, F.lit("")) != "", F.concat(F.lit(" _("), scope, F.lit(")_"))).otherwise("")))


def record(kind: Column, project: Column, at: Column, what: Column, why: Column, inferred: Column, outcome: Column, url: Column) -> Column:
    head = F.concat(F.lit("- **["), kind, F.lit("] "), project, F.lit("** ("), F.date_format(at, "yyyy-MM"), F.lit(") — "), what)
    filled = lambda c: F.nullif(c, F.lit(""))
    reason = F.concat(F.when(inferred, F.lit("  - inferred reason: ")).otherwise("  - reason: "), filled(why))
    return withheld(F.concat_ws("\n", head, reason, F.concat(F.lit("  - outcome: "), filled(outcome)), F.concat(F.lit("  - source: "), url)))


def evidence(kind: Column, project: Column, label: Column, place: Column, excerpt: Column) -> Column:
    lines = F.transform(F.split(excerpt, r"\r\n|[\n\r]"), lambda x: F.when(F.trim(x) != "", F.concat(F.lit("  > "), x)).otherwise("  >"))
    head = F.concat(F.lit("- **["), kind, F.lit("] "), project, F.lit("** — "), label)
    return withheld(F.concat(head, F.lit("\n  `"), place, F.lit("`\n"), F.array_join(lines, "\n")))
