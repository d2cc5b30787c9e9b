"""Documents cut into citable passages, with exact lines. One function per kind of document, applied to Arrow batches."""

from __future__ import annotations

import ast
import itertools
import json
import re
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import fixed_values as V
from cairn.functions import text as words
from cairn.session import ship

MOST_CHARS = 1800
LEAST_SECTION = 60
Passage = tuple[str, str, int, int, str]  # text, heading, first line, last line, locator
#: Marks of a heading and of a fence.
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_FENCE = re.compile(r"^\s*(?:```|~~~)")


def window(lines: list[str], first: int, heading: str = "", most: int = MOST_CHARS) -> list[Passage]:
    """Whole paragraphs packed up to a size, a line's end counting as a character. A larger paragraph stands alone, cut between lines; a larger line stays whole. ``first``: number of the first line."""
    upto = [0, *itertools.accumulate(len(x) + 1 for x in lines)]
    size = lambda a, b: upto[b] - upto[a]
    filled = [i for i, x in enumerate(lines) if x.strip()]
    # Paragraphs: runs of filled lines, as [first, last + 1).
    paragraphs = [(r[0][1], r[-1][1] + 1) for r in (list(g) for _, g in itertools.groupby(enumerate(filled), lambda p: p[1] - p[0]))]
    spans: list[tuple[int, int]] = []
    growing = False
    for a, b in paragraphs:
        if size(a, b) > most:
            cut = a
            for i in range(a + 1, b):
                if size(cut, i + 1) > most:
                    spans.append((cut, i))
                    cut = i
            spans.append((cut, b))
            growing = False
        elif growing and size(spans[-1][0], b) <= most:
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
            growing = True
    return [("\n".join(lines[a:b]).strip("\n"), heading, first + a, first + b - 1, "") for a, b in spans]


def plain(text: str) -> list[Passage]:
    return window(text.splitlines(), 1)


def markdown(text: str) -> list[Passage]:
    """By section, under the path of its headings; marks within fences are text; a section of fewer than sixty characters, line ends not counted, goes with the next and under its heading."""
    lines, path = text.splitlines(), []
    starts: list[tuple[int, str]] = [(0, "")]
    fenced = False
    for i, line in enumerate(lines):
        fenced ^= bool(_FENCE.match(line))
        found = None if fenced else _HEADING.match(line)
        if found:
            depth = len(found.group(1))
            path = [p for p in path if p[0] < depth] + [(depth, found.group(2).strip())]
            starts.append((i, " > ".join(t for _, t in path)))
    ends = [i for i, _ in starts[1:]] + [len(lines)]
    sections = [(a, b, name) for (a, name), b in zip(starts, ends) if any(x.strip() for x in lines[a:b])]
    out: list[Passage] = []
    begin = None
    for n, (a, b, name) in enumerate(sections):
        begin = a if begin is None else begin
        if sum(map(len, lines[begin:b])) < LEAST_SECTION and n + 1 < len(sections):
            continue
        out += window(lines[begin:b], begin + 1, name)
        begin = None
    return out


def python_source(text: str, most: int = 12) -> list[Passage]:
    """What the author says the code is for: the comments at its head with the module's docstring, and each top-level definition that has a docstring, to the docstring's end.
    What can't be parsed gives its first lines as plain text."""
    lines = text.splitlines()
    head = next((i for i, x in enumerate(lines) if x.strip() and not x.strip().startswith("#")), len(lines))
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return plain("\n".join(lines[: max(head, 40)]))[:most]
    out: list[Passage] = []
    said = ast.get_docstring(tree)
    if said or "".join(lines[:head]).strip():
        first = tree.body[0] if tree.body else None
        literal = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
        end = max(head, first.end_lineno if literal else 0)
        body = "\n".join(lines[:end]).strip()
        if body:
            out.append((body[: 2 * MOST_CHARS], "module", 1, end, ""))
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    for node in (n for n in tree.body if isinstance(n, kinds) and ast.get_docstring(n)):
        end = node.body[0].end_lineno
        out.append(("\n".join(lines[node.lineno - 1 : end])[: 2 * MOST_CHARS], node.name, node.lineno, end, ""))
    return out[:most]


def _joined(x: object) -> str:
    return "".join(map(str, x)) if isinstance(x, list) else "" if x is None else str(x)


def _shown(cell: dict) -> str:
    """What a cell printed or returned as text."""
    parts = []
    for o in cell.get("outputs") or []:
        kind = o.get("output_type")
        parts.append(_joined(o.get("text")) if kind == "stream" else _joined((o.get("data") or {}).get("text/plain")) if kind in ("execute_result", "display_data") else "")
    return "\n".join(p for p in parts if p).strip()


def notebook(text: str, most: int = 60) -> list[Passage]:
    """Cells under the last heading before them: prose of twenty characters, code by its first twelve lines with the beginning of its text output; the place is the cell's number."""
    try:
        cells = json.loads(text).get("cells", [])
    except (ValueError, AttributeError):
        return []
    out: list[Passage] = []
    heading = ""
    for n, cell in enumerate(cells, 1):
        source = _joined(cell.get("source", "")).strip()
        if cell.get("cell_type") == "markdown":
            named = next((m.group(2).strip() for m in map(_HEADING.match, source.splitlines()) if m), None)
            heading = heading if named is None else named
            if len(source) >= 20:
                out.append((source[: 2 * MOST_CHARS], heading, 0, 0, f"cell {n}"))
        elif cell.get("cell_type") == "code":
            code, shown = "\n".join(source.splitlines()[:12]), _shown(cell)[:600]
            if len(code) >= 20 or shown:
                out.append((f"```python\n{code}\n```" + (f"\n\nOutput:\n{shown}" if shown else ""), heading, 0, 0, f"cell {n}"))
    return out[:most]


_METRIC = re.compile(V.METRIC_LINE)


def run_log(text: str, gap: int = 3, most: int = 40) -> list[Passage]:
    """Runs of lines that report a measured result, at most ``gap`` lines apart, with a line of context that isn't blank."""
    lines = text.splitlines()
    hits = [i for i, x in enumerate(lines) if _METRIC.search(x)]
    opens = [n for n, i in enumerate(hits) if n == 0 or i - hits[n - 1] > gap]
    out: list[Passage] = []
    for a, b in zip(opens, [*opens[1:], len(hits)]):
        low, high = max(0, hits[a] - 1), min(len(lines) - 1, hits[b - 1] + 1)
        low += not lines[low].strip()
        high -= not lines[high].strip()
        out.append(("\n".join(lines[low : high + 1])[:MOST_CHARS], "measured results", low + 1, high + 1, ""))
    return out[:most]


def _leaves(value: object) -> Iterator[tuple[str, str]]:
    """(path, value as text) of a JSON value, in order, without recursion: of lists of numbers their first eight, of other lists their first five elements; nulls and long strings are left out."""
    waiting: list[tuple[str, object]] = [("", value)]
    while waiting:
        path, x = waiting.pop()
        if isinstance(x, dict):
            waiting += [(f"{path}.{k}" if path else str(k), y) for k, y in reversed(x.items())]
        elif isinstance(x, list) and x and all(isinstance(y, (int, float)) for y in x):
            yield path, f"[{', '.join(map(str, x[:8]))}{', ...' if len(x) > 8 else ''}]"
        elif isinstance(x, list):
            waiting += [(f"{path}[{i}]", x[i]) for i in reversed(range(min(5, len(x))))]
        elif x is not None and not (isinstance(x, str) and len(x) > 120):
            yield path, str(x)


def results_json(text: str, most_lines: int = 60) -> list[Passage]:
    """``path: value`` lines of a file of results; nothing where no value has a digit."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return []
    found = list(itertools.islice(_leaves(value), most_lines))
    if not any(re.search(r"\d", v) for _, v in found):
        return []
    return [("\n".join(f"{p}: {v}" for p, v in found)[:MOST_CHARS], "results", 0, 0, "json")]


KINDS: dict[str, Callable[[str], list[Passage]]] = {"note": markdown, "markdown": markdown, "web": markdown, "issue": markdown, "code": plain, "python": python_source, "notebook": notebook, "log": run_log, "results": results_json}


def passages(documents: DataFrame, id_col: str, text_col: str, kind_col: str) -> DataFrame:
    """(id, ordinal, text, heading, start_line, end_line, locator): every document cut by its kind; unknown kinds as plain text; null texts give nothing."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, text, kind in zip(batch.iloc[:, 0], batch.iloc[:, 1], batch.iloc[:, 2]):
                for n, p in enumerate(KINDS.get(kind, plain)(text)):
                    rows.append((name, n, *p))
            yield pd.DataFrame(rows, columns=["id", "ordinal", "text", "heading", "start_line", "end_line", "locator"])

    source = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), text_col, kind_col)
    return source.mapInPandas(run, f"id {dict(source.dtypes)['id']}, ordinal int, text string, heading string, start_line int, end_line int, locator string")


def metric_groups(documents: DataFrame, id_col: str, text_col: str, gap: int = 3, most: int = 40) -> DataFrame:
    """(id, group_no, start_line, end_line, n_metrics): runs of lines that report measured results, at most ``gap`` lines apart, the first ``most`` a document, a line of context around.

    Gaps and islands: the windows run over one document's metric lines."""
    lines = documents.select(F.col(id_col).alias("id"), F.size(F.split(text_col, "\n")).alias("n"), F.posexplode(F.split(text_col, "\n")).alias("at", "line")).where(F.col("line").rlike(V.METRIC_LINE))
    by = Window.partitionBy("id").orderBy("at")
    opened = lines.withColumn("opens", F.coalesce(F.col("at") - F.lag("at").over(by) > gap, F.lit(True)).cast("int"))
    grouped = opened.withColumn("group_no", F.sum("opens").over(by)).where(F.col("group_no") <= most).groupBy("id", "group_no", "n").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("n_metrics"))
    return grouped.select(F.col("id").alias(id_col), "group_no", F.greatest(F.lit(1), F.col("a")).cast("bigint").alias("start_line"), F.least(F.col("n"), F.col("b") + 2).cast("bigint").alias("end_line"), "n_metrics")


def excerpt(said: Column, first: Column, last: Column, terms: Column) -> Column:
    """(excerpt, start, end): a short passage whole, of a longer one the earliest window of lines with most of the terms, trimmed at its weaker end (its beginning on ties) until it fits.
    Where the passage has no place in lines, start and end are 0."""
    lines = F.split(said, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    hits = F.transform(lines, lambda x: F.size(F.array_intersect(words.vocabulary(x), terms)))
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(h) - V.EXCERPT_LINES)), lambda b: F.aggregate(F.slice(h, b + 1, F.lit(V.EXCERPT_LINES)), F.lit(0), lambda s, x: s + x))

    def cut(x: Column) -> Column:
        begin = F.array_position(windows(x["hits"]), F.array_max(windows(x["hits"]))).cast("int")
        whole = F.struct(begin.alias("a"), F.least(begin + V.EXCERPT_LINES - 1, F.size(x["lines"])).alias("b"))

        def trim(w: Column, _: Column) -> Column:
            long = (w["b"] > w["a"]) & (F.length(F.array_join(F.slice(x["lines"], w["a"], w["b"] - w["a"] + 1), "\n")) > V.EXCERPT_CHARS)
            weaker = F.get(x["hits"], w["a"] - 1) <= F.get(x["hits"], w["b"] - 1)
            return F.struct(F.when(long & weaker, w["a"] + 1).otherwise(w["a"]).alias("a"), F.when(long & ~weaker, w["b"] - 1).otherwise(w["b"]).alias("b"))

        w = F.aggregate(F.sequence(F.lit(1), F.lit(V.EXCERPT_LINES)), whole, trim)
        at = lambda n: F.when(F.coalesce(first, F.lit(0)) > 0, first + n - 1).otherwise(0)
        return F.transform(F.array(w), lambda w: F.struct(F.array_join(F.slice(x["lines"], w["a"], w["b"] - w["a"] + 1), "\n").alias("excerpt"), at(w["a"]).alias("start"), at(w["b"]).alias("end")))[0]

    fits = (F.size(lines) <= V.EXCERPT_LINES) & (F.length(said) <= V.EXCERPT_CHARS)
    placed = F.coalesce(first, F.lit(0)) > 0
    whole = F.struct(said.alias("excerpt"), F.when(placed, first).otherwise(0).alias("start"), F.when(placed, last).otherwise(0).alias("end"))
    return F.when(fits, whole).otherwise(F.transform(F.array(F.struct(lines.alias("lines"), hits.alias("hits"))), cut)[0])
