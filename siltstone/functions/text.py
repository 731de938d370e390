"""Text functions on columns: normalising, tokens, citations, paths."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "in", "on", "at", "to", "for", "of", "with", "is", "are", "was", "were", "be", "been", "by", "as", "this", "that", "it", "from", "which",
    "will", "can", "has", "have", "had", "not", "but", "also", "evidence", "supported", "insufficient", "file", "lines", "line", "chunk",
)
LOOSE_CITATION = r"\[?`?([a-zA-Z0-9_\-\.\/]+\.[a-zA-Z0-9]+)(?::(?:L)?(\d+)(?:-(?:L)?(\d+))?)?`?\]?"
LINE_CITATION = r"\[\s*`?([A-Za-z0-9_\-./]+\.[A-Za-z0-9]+):L?(\d+)(?:\s*-\s*L?(\d+))?`?\s*\]"
FILE_CITATION = r"\[\s*`?([A-Za-z0-9_\-./]+/[A-Za-z0-9_\-.]+\.[A-Za-z0-9]+)`?\s*\]"
FENCE = r"```[\s\S]*?```"
CAMEL = r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)"


def normalize_text(text: Column) -> Column:
    """Without a leading byte order mark and control characters; line ends as one newline."""
    text = F.regexp_replace(text, "^﻿", "")
    return F.regexp_replace(F.regexp_replace(text, "\r\n|\r", "\n"), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def content_hash(text: Column) -> Column:
    return F.sha2(normalize_text(text), 256)


def artifact_id(repository: Column, path: Column, text: Column) -> Column:
    return F.concat_ws(":", repository, path, F.substring(F.sha2(text, 256), 1, 16))


def words(text: Column) -> Column:
    """The pieces between white space, none empty."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def code_tokens(text: Column) -> Column:
    """Tokens of prose and code: each word, and its parts by underscore, case, dot and slash; repeats stay."""

    def parts(word: Column) -> Column:
        none = F.array().cast("array<string>")
        camel = F.regexp_extract_all(word, F.lit(CAMEL), F.lit(0))
        return F.concat(
            F.array(word),
            F.when(word.contains("_"), F.split(word, "_")).otherwise(none),
            F.when(F.size(camel) > 1, camel).otherwise(none),
            F.when(word.rlike(r"[/.]"), F.split(word, r"[/.]")).otherwise(none),
        )

    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\w\s./]", " ")
    return F.filter(F.transform(F.flatten(F.transform(words(spaced), parts)), lambda t: F.lower(t)), lambda t: F.length(t) > 1)


_WORD_TOKENS: dict[str, list[str]] = {}


def _word_tokens(word: str) -> list[str]:
    """``code_tokens`` of one word between white space, remembered."""
    found = _WORD_TOKENS.get(word)
    if found is None:
        if len(_WORD_TOKENS) > 300_000:
            _WORD_TOKENS.clear()
        camel = re.findall(CAMEL, word)
        parts = [word, *(word.split("_") if "_" in word else ()), *(camel if len(camel) > 1 else ()), *(re.split("[/.]", word) if "/" in word or "." in word else ())]
        found = _WORD_TOKENS[word] = [t.lower() for t in parts if len(t) > 1]
    return found


_SIGNS = re.compile(r"[^\w\s./]")


@F.pandas_udf(ArrayType(StringType()))
def code_tokens_in_batches(text: pd.Series) -> pd.Series:
    """The same as ``code_tokens``, by Arrow batches: what a word gives is found once per worker."""
    return text.map(code_tokens_of)


def code_tokens_of(text: str | None) -> list[str]:
    """``code_tokens`` of one text."""
    return [x for w in _SIGNS.sub(" ", text or "").split() for x in _word_tokens(w)]


def token_set(text: Column) -> Column:
    """Distinct lower-case words without punctuation."""
    return F.array_distinct(words(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " ")))


def gate_tokens(text: Column) -> Column:
    """Distinct lower-case words of more than two characters that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-zA-Z0-9_\-.]+"), F.lit(0))
    kept = F.filter(found, lambda w: F.length(w) > 2)
    return F.array_except(F.array_distinct(kept), F.array(*map(F.lit, STOP_WORDS)))


def normalize_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def line_citations(answer: Column) -> Column:
    """Bracketed citations with lines: path, start_line, end_line; swapped lines are put in order, numbers beyond any file leave no citation."""

    def span(c: Column) -> Column:
        first = c["1"].try_cast("long")
        last = F.coalesce(F.nullif(c["2"], F.lit("")).try_cast("long"), first)
        return F.struct(normalize_path(c["0"]).alias("path"), F.least(first, last).alias("start_line"), F.greatest(first, last).alias("end_line"))

    text = F.regexp_replace(F.coalesce(answer, F.lit("")), FENCE, "")
    groups = [F.regexp_extract_all(text, F.lit(LINE_CITATION), F.lit(g)) for g in (1, 2, 3)]
    return F.filter(F.transform(F.arrays_zip(*groups), span), lambda c: c["start_line"].isNotNull())


def file_citations(answer: Column) -> Column:
    text = F.regexp_replace(F.coalesce(answer, F.lit("")), FENCE, "")
    return F.transform(F.regexp_extract_all(text, F.lit(FILE_CITATION), F.lit(1)), normalize_path)


def loose_citations(answer: Column) -> Column:
    """What the gate takes for citations: anything like a path with an extension, with or without lines."""
    text = F.regexp_replace(F.coalesce(answer, F.lit("")), FENCE, "")
    groups = [F.regexp_extract_all(text, F.lit(LOOSE_CITATION), F.lit(g)) for g in (1, 2, 3)]

    def cited(c: Column) -> Column:
        first = F.nullif(c["1"], F.lit("")).try_cast("long")
        return F.struct(c["0"].alias("path"), first.alias("start_line"), F.coalesce(F.nullif(c["2"], F.lit("")).try_cast("long"), first).alias("end_line"))

    return F.filter(F.transform(F.arrays_zip(*groups), cited), lambda c: ~F.lower(c["path"]).rlike("^https?://"))


def is_test_file(path: Column) -> Column:
    """By any directory or by the name, whatever the case."""
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    inside = F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, ("tests", "test", "__tests__", "spec", "specs"))))
    return inside | name.rlike(r"^(test_|conftest)") | name.rlike(r"(_test|\.test|\.spec|_spec)\.[^.]+$")


def module_name(path: Column) -> Column:
    """The dotted name of a Python file: without src or lib, a package by its folder."""
    stem = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"^(src|lib)/", "")
    return F.replace(F.regexp_replace(stem, r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def any_word(text: Column, cues: tuple[str, ...]) -> Column:
    """Whether any cue stands between word borders."""
    return text.rlike(r"(?U)\b(" + "|".join(c.replace("-", "\\-") for c in cues) + r")\b")


def count_words(text: Column, cues: tuple[str, ...]) -> Column:
    """How many of the cues stand between word borders."""
    return sum((any_word(text, (c,)).cast("int") for c in cues), F.lit(0))
