"""Chunks of sources and texts along their structure, within a budget of tokens.

A file's units are its functions and classes, its sections and paragraphs, or
one window of lines. A unit that fits the budget is a chunk; a class that does
not fit becomes its header, its methods and what stands between them; anything
else too large is cut by lines, and a line too large by words. Each file is
parsed where it is read, in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.sources.tables import spread

CHUNKS = "artifact_id string, chunk_id string, chunk_index int, total_chunks int, start_line int, end_line int, content string, token_count int, part int, parts int, symbol_name string, section_title string, chunk_type string"

#: A stand-in for a model's tokens: words and single signs. No token reaches over white space, so lines add up.
TOKEN = r"\w+|[^\w\s]"
#: Tokens that a model adds to every input.
KEPT_BACK = 2
CODE = ("source_code", "test")
# What a title may be underlined with.
UNDERLINES = "=-~`#*^+\"':"

_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
_DEFINITION = (ast.FunctionDef, ast.AsyncFunctionDef)

Unit = tuple[int, int, str | None, str | None, str]  # first and last line, symbol, section, type
Piece = tuple[int, int, str]


class Text:
    """The lines of one file with the tokens of each and of all before it."""

    def __init__(self, content: str, budget: int, token: re.Pattern) -> None:
        self.lines, self.budget, self.token = content.splitlines(), budget, token
        self.counts = [len(token.findall(x)) for x in self.lines]
        self.upto = [0, *accumulate(self.counts)]

    def fits(self, first: int, last: int) -> bool:
        return self.upto[last] - self.upto[first - 1] <= self.budget

    def blank(self, n: int) -> bool:
        return not self.lines[n - 1].strip()

    def piece(self, first: int, last: int) -> Piece:
        """The lines without blank ones at either end."""
        while first < last and self.blank(first):
            first += 1
        while last > first and self.blank(last):
            last -= 1
        return first, last, "\n".join(self.lines[first - 1 : last]).strip()

    def pieces(self, first: int, last: int, overlap: int) -> Iterator[Piece]:
        """A unit whole if it fits, else as many lines at a time as fit, of which ``overlap`` are repeated."""
        if self.fits(first, last):
            yield self.piece(first, last)
            return
        at = first
        while at <= last:
            if self.blank(at):
                at += 1
            elif self.counts[at - 1] > self.budget:
                yield from ((at, at, x) for x in self.words(self.lines[at - 1]))
                at += 1
            else:
                end = at
                while end < last and self.counts[end] <= self.budget and self.fits(at, end + 1):
                    end += 1
                yield self.piece(at, end)
                if end == last:
                    return
                at = max(at + 1, end + 1 - overlap) if overlap and end + 1 - at > overlap else end + 1

    def words(self, line: str) -> Iterator[str]:
        """A line in parts of whole words, and a word that is too large in slices of whole tokens."""
        held, used = "", 0
        for word in re.findall(r"\s+|\S+", line):
            starts = [m.start() for m in self.token.finditer(word)]
            if used + len(starts) > self.budget and held.strip():
                yield held.strip()
                held, used = "", 0
            if len(starts) > self.budget:
                cuts = [*starts[:: self.budget][1:], len(word)]
                yield from (word[a:b] for a, b in zip([0, *cuts], cuts, strict=False))
                held, used = "", 0
                continue
            held, used = held + word, used + len(starts)
        if held.strip():
            yield held.strip()


def _span(node: ast.AST, lines: int) -> tuple[int, int]:
    return min([node.lineno, *(d.lineno for d in node.decorator_list)]), min(node.end_lineno or lines, lines)


def code_units(text: Text, tree: ast.Module) -> Iterator[Unit]:
    """Definitions at the top of a module and all that stands before, between and after them; nothing if it has none."""
    n = len(text.lines)
    nodes = sorted((x for x in tree.body if isinstance(x, (*_DEFINITION, ast.ClassDef))), key=lambda x: _span(x, n)[0])
    at = 1
    for k, node in enumerate(nodes):
        first, last = _span(node, n)
        if at < first:
            yield at, first - 1, "<module_code>" if k else "<module_preamble>", None, "module_code" if k else "module_header"
        inner = [m for m in node.body if isinstance(m, _DEFINITION)] if isinstance(node, ast.ClassDef) else []
        if inner and not text.fits(first, last):
            yield from class_units(node.name, inner, first, last, n)
        else:
            yield first, last, node.name, None, "class" if isinstance(node, ast.ClassDef) else "function"
        at = last + 1
    if nodes and at <= n:
        yield at, n, "<module_trailer>", None, "module_trailer"


def class_units(name: str, methods: list[ast.AST], first: int, last: int, n: int) -> Iterator[Unit]:
    """A class that is too large: its header, its methods, and its body between and after them."""
    at = _span(methods[0], n)[0]
    if first < at:
        yield first, at - 1, f"{name}.<header>", None, "class_header"
    for method in methods:
        begins, ends = _span(method, n)
        if at < begins:
            yield at, begins - 1, f"{name}.<body>", None, "class_body"
        yield begins, ends, f"{name}.{method.name}", None, "method"
        at = ends + 1
    if at <= last:
        yield at, last, f"{name}.<body>", None, "class_body"


def titled(lines: list[str]) -> Iterator[tuple[str, int, int]]:
    """(title, first, last) of each section: a Markdown heading or an underlined title up to the line before the next."""
    title, first = "Introduction", 1
    for n, line in enumerate(lines, 1):
        heading, under = _HEADING.match(line), lines[n] if n < len(lines) else ""
        underlined = line.strip() and len(under) >= 3 and under[0] in UNDERLINES and under == under[0] * len(under)
        if heading or underlined:
            if n > first:
                yield title, first, n - 1
            title, first = heading.group(2) if heading else line.strip(), n
    yield title, first, len(lines)


def paragraphs(text: Text, first: int, last: int) -> Iterator[tuple[int, int]]:
    begins = None
    for n in range(first, last + 2):
        if n > last or text.blank(n):
            if begins:
                yield begins, n - 1
            begins = None
        elif not begins:
            begins = n


def section_units(text: Text) -> Iterator[Unit]:
    """Sections, and of those too large as many paragraphs at a time as fit."""
    for title, first, last in titled(text.lines):
        if text.fits(first, last):
            yield first, last, None, title, "doc_section"
            continue
        block = None
        for begins, ends in paragraphs(text, first, last):
            if block and text.fits(block[0], ends):
                block = block[0], ends
                continue
            if block:
                yield *block, None, title, "doc_paragraph_block"
            block = begins, ends
        if block:
            yield *block, None, title, "doc_paragraph_block"


def file_chunks(content: str, kind: str, python: bool, most: int, overlap: int, token: re.Pattern) -> Iterator[tuple]:
    """(start_line, end_line, content, token_count, part, parts, symbol_name, section_title, chunk_type) of one file."""
    text = Text(content, max(1, most - KEPT_BACK), token)
    units, repeated = [], 0
    if kind not in CODE:
        units = list(section_units(text)) if text.lines else []
    else:
        if python:
            try:
                units = list(code_units(text, ast.parse(content)))
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                units = []
        if not units and text.lines:
            units, repeated = [(1, len(text.lines), None, None, "code_block")], overlap
    for first, last, symbol, section, unit in units:
        if all(text.blank(n) for n in range(first, last + 1)):
            continue
        pieces = [p for p in text.pieces(first, last, repeated) if p[2]]
        for part, (begins, ends, words) in enumerate(pieces, 1):
            of = (part, len(pieces)) if len(pieces) > 1 else (None, None)
            yield begins, ends, words, len(token.findall(words)) + KEPT_BACK, *of, symbol, section, unit


def chunks(artifacts: DataFrame, most_tokens: int = 512, overlap: int = 5, token: str = TOKEN) -> DataFrame:
    """The chunks of ``artifacts`` (artifact_id, artifact_type, path, language, content), in their order within each.

    Source code and tests are cut at definitions if they are Python that parses,
    else into windows of lines of which ``overlap`` are repeated; all else at
    headings and paragraphs. A chunk has at most ``most_tokens`` tokens, two of
    which are kept back for those that a model adds; its lines are exact, and
    every line that isn't blank lies in a chunk. ``part`` and ``parts`` are set
    where a unit was cut. Null and blank contents have no chunks. ``token`` is a
    pattern no match of which holds white space.
    """
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    schema = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in CHUNKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(token)
        for batch in batches:
            rows = []
            for key, kind, path, language, content in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                found = list(file_chunks(content or "", kind or "", language == "python" or (path or "").endswith(".py"), most_tokens, overlap, pattern))
                rows += [(key, f"{key}:chunk:{k}", k, len(found), *c) for k, c in enumerate(found)]
            yield pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], names=names)

    return spread(artifacts.select("artifact_id", "artifact_type", "path", "language", "content")).mapInArrow(run, CHUNKS)
