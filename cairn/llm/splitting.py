"""Oversized texts cut at natural boundaries, by packing their structure tree.

A text is parsed into a tree: sections under their headings, blocks (paragraphs, lists, fenced code, tables), list items and lines, sentences,
words, and characters where nothing else is left. Sibling subtrees are merged from the left while they fit; only a node that does not fit is
descended into. The leaves tile the text, so the pieces' cores, put together, are the text.

Each piece but the first begins with up to ``overlap`` characters of the piece before it, from a line's, sentence's or word's beginning where there is one.

Defined cases: rows of null id or text and texts within the limit give no pieces; a repeated id is cut once (its longest text, then the greatest); line numbers
that are null or 0 (no lines) are passed on as they are; CR LF pairs and combining characters are not parted; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import ship

_FENCE = re.compile(r"^[ \t]{0,3}(```|~~~)")
_HEADING = re.compile(r"^[ \t]{0,3}(#{1,6})[ \t]+\S")
_DEF = re.compile(r"^(?:async\s+def|def|class|function|export|func|fn|pub|impl|struct|interface|CREATE|\[[\w.\-\" ]+\]\s*$|In \[\d*\]:|(?:You|Reply):)", re.I)
_ITEM = re.compile(r"^[ \t]*(?:[-*+]|\d{1,3}[.)])[ \t]+\S")
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'»”’)\]]*[ \t\r\n]+")
_WORD = re.compile(r"\s+")
#: Levels of the tree below a section, from the widest boundary to the narrowest.
_LEVELS = ("block", "item", "line", "sentence", "word", "character")


def _lines(text: str, start: int, end: int) -> list[int]:
    """Starts of lines within a span."""
    out, at = [start], text.find("\n", start, end)
    while at >= 0 and at + 1 < end:
        out.append(at + 1)
        at = text.find("\n", at + 1, end)
    return out


def _sections(text: str, start: int, end: int, depth: int) -> list[tuple[int, int]]:
    """Cut at headings of this depth or above, outside fences; at depth 7 at the beginnings of definitions, cells and turns."""
    cuts, fenced = [start], False
    for at in _lines(text, start, end):
        stop = text.find("\n", at, end)
        line = text[at : stop if stop >= 0 else end]
        if _FENCE.match(line):
            fenced = not fenced
        elif not fenced and at > start:
            heading = _HEADING.match(line)
            if (heading and len(heading.group(1)) <= depth) if depth < 7 else _DEF.match(line):
                cuts.append(at)
    return list(zip(cuts, [*cuts[1:], end]))


def _parts(text: str, start: int, end: int, level: str, limit: int) -> list[tuple[int, int]]:
    cuts = [start]
    if level == "block":
        fenced, blank = False, False
        for at in _lines(text, start, end):
            stop = text.find("\n", at, end)
            line = text[at : stop if stop >= 0 else end]
            empty = not line.strip()
            if not empty and blank and not fenced and at > start:
                cuts.append(at)
            if _FENCE.match(line):
                fenced = not fenced
            blank = empty
    elif level == "item":
        for at in _lines(text, start, end)[1:]:
            stop = text.find("\n", at, end)
            if _ITEM.match(text[at : stop if stop >= 0 else end]):
                cuts.append(at)
    elif level == "line":
        cuts = _lines(text, start, end)
    elif level == "sentence":
        cuts += [m.end() for m in _SENTENCE.finditer(text, start, end) if m.end() < end]
    elif level == "word":
        cuts += [m.end() for m in _WORD.finditer(text, start, end) if start < m.end() < end]
    else:
        at = start + limit
        while at < end:
            cut = at
            while cut > at - 32 and cut > start + 1 and (unicodedata.combining(text[cut]) or text[cut] in "‍️" or text[cut - 1] == "‍" or text[cut - 1 : cut + 1] == "\r\n"):
                cut -= 1
            cuts.append(cut)
            at = cut + limit
    return list(zip(cuts, [*cuts[1:], end]))


def _pack(text: str, start: int, end: int, level: int, limit: int) -> list[tuple[int, int]]:
    """Spans that tile (start, end), none above the limit. Levels 1 to 7 cut into sections, later ones as in ``_LEVELS``."""
    if end - start <= limit:
        return [(start, end)]
    while True:
        parts = _sections(text, start, end, level) if level <= 7 else _parts(text, start, end, _LEVELS[level - 8], limit)
        level += 1
        if len(parts) > 1:
            break
    spans: list[tuple[int, int]] = []
    for a, b in parts:
        spans += _pack(text, a, b, level, limit) if b - a > limit else [(a, b)]
    merged = [spans[0]]
    for a, b in spans[1:]:
        if b - merged[-1][0] <= limit:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


def _overlap_start(text: str, low: int, cut: int) -> int:
    """Where in [low, cut] the repetition begins: after the first line end, else sentence end, else white space; else at ``low``."""
    if low == 0 or text[low - 1] == "\n":
        return low
    line = text.find("\n", low, cut)
    if 0 <= line < cut - 1:
        return line + 1
    for pattern in (_SENTENCE, _WORD):
        found = pattern.search(text, low, cut)
        if found and found.end() < cut:
            return found.end()
    while low < cut and (unicodedata.combining(text[low]) or text[low] == "‍"):
        low += 1
    return low


def pieces(text: str, limit: int = 1800, overlap: int = 200) -> list[tuple[int, int, int]]:
    """(start, core start, end) of each piece; a piece is ``text[start:end]``, and the cores tile the text."""
    if len(text) <= limit:
        return [(0, 0, len(text))]
    spans = _pack(text, 0, len(text), 1, limit - overlap)
    out = [(0, 0, spans[0][1])]
    for a, b in spans[1:]:
        low = max(a - overlap, out[-1][1], b - limit)
        out.append((_overlap_start(text, low, a), a, b))
    return out


def _udf(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("id", "piece_no", "text", "heading", "start_line", "end_line", "start_char", "core_char", "end_char")}
            for name, text, heading, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                lined = first is not None and first > 0
                for k, (start, core, end) in enumerate(pieces(text, limit, overlap)):
                    begin = first + text.count("\n", 0, start) if lined else first
                    values = (name, k, text[start:end], heading, begin, begin + text.count("\n", start, end - 1) if lined else last, start, core, end)
                    for column, value in zip(out.values(), values):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return run


def split(df: DataFrame, id_col: str = "chunk_id", *, text_col: str = "text", heading_col: str = "heading", start_line: str = "start_line", end_line: str = "end_line", limit: int = 1800, overlap: int = 200) -> DataFrame:
    """The pieces of all texts above ``limit`` code points: ``id``, ``piece_no`` (from 0), ``text``, ``heading``, ``start_line``, ``end_line``, and the piece's
    ``start_char``, ``core_char`` (where what is not repeated begins) and ``end_char`` within the text.

    Only oversized rows leave the scan; these are spread by id, which also brings repeated ones together.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be below limit")
    ship(df.sparkSession)
    row = F.struct(F.length("text").alias("n"), "text", "heading", "first", "last")
    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(heading_col).alias("heading"), F.col(start_line).cast("int").alias("first"), F.col(end_line).cast("int").alias("last"))
    large = source.where((F.length("text") > limit) & F.col("id").isNotNull()).groupBy("id").agg(F.max(row).alias("row")).select("id", "row.text", "row.heading", "row.first", "row.last")
    return large.mapInArrow(_udf(limit, overlap), "id bigint, piece_no int, text string, heading string, start_line int, end_line int, start_char int, core_char int, end_char int")
