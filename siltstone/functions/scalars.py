"""Small column functions: names, ids, masks, maps, prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reasons that a graphics processor gives for slowing down, by bit.
THROTTLE_REASONS = {1: "gpu_idle", 2: "applications_clocks_setting", 4: "sw_power_cap", 8: "hw_slowdown", 16: "sync_boost", 32: "sw_thermal_slowdown", 64: "hw_thermal_slowdown", 128: "hw_power_brake_slowdown"}


def chunk_id(artifact_id: Column, index: Column) -> Column:
    """A chunk's id: its artifact's, the word chunk, and its place from 0."""
    return F.concat_ws(":", artifact_id, F.lit("chunk"), index.cast("string"))


def short_node(node_id: Column) -> Column:
    """What follows the kind and the repository in a node's id."""
    parts = F.split(node_id, ":", 3)
    return F.when(F.size(parts) == 3, parts[2]).otherwise(F.element_at(parts, -1))


def name_key(name: Column) -> Column:
    """A person's name for comparison: lower case, white space as one space."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def same_person(one: Column, other: Column) -> Column:
    """Equal names, or one of them only the other's first name."""
    a, b = name_key(one), name_key(other)
    first = lambda c: F.split(c, " ")[0]
    return (a == b) | ((a == first(a)) & (a == first(b))) | ((b == first(b)) & (b == first(a)))


def is_author(reviewer: Column, *authors: Column) -> Column:
    """Whether the reviewer's first name is that of one of the authors; a null or blank name is nobody's."""
    first = lambda c: F.nullif(F.split(name_key(c), " ")[0], F.lit(""))
    return F.coalesce(reduce(lambda a, b: a | b, (F.coalesce(first(reviewer) == first(x), F.lit(False)) for x in authors)), F.lit(False))


def canonical_hash(**fields: Column) -> Column:
    """A stable digest of named values: the same whatever order they are given in."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def throttle_reasons(mask: Column) -> Column:
    """The names of the bits that are set, in their order."""
    return F.filter(F.array(*(F.when(mask.bitwiseAND(bit) != 0, F.lit(name)) for bit, name in THROTTLE_REASONS.items())), lambda x: x.isNotNull())


def rough_token_count(text: Column) -> Column:
    """A fourth of the characters, where no tokenizer's count is known."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)


def safe_label(label: Column, default: str = "Entity") -> Column:
    """A label of letters, digits and underscores, else the default."""
    return F.when(label.rlike(r"^[A-Za-z0-9_]+$"), label).otherwise(F.lit(default))


def merged_maps(*maps: Column) -> Column:
    """One map; of a key in several the last value counts."""
    without = lambda m, later: F.map_filter(m, lambda k, _: ~F.array_contains(F.map_keys(later), k))
    return reduce(lambda one, later: F.map_concat(without(one, later), later), maps)


def known_fields(fields: Column) -> Column:
    """A map without the keys whose value is null."""
    return F.map_filter(fields, lambda _, v: v.isNotNull())


def minutes_between(start: Column, end: Column, least: float = 0.1) -> Column:
    return F.greatest(F.lit(least), (F.unix_micros(end) - F.unix_micros(start)) / 6e7)


def evidence_block(rank: Column, path: Column, start: Column, end: Column, symbol: Column, content: Column) -> Column:
    """One numbered chunk of a prompt; lines and symbol only where they are known."""
    lines = F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit(" (Lines "), start, F.lit("-"), end, F.lit(")"))).otherwise("")
    named = F.when(symbol.isNotNull() & (symbol != ""), F.concat(F.lit(" ["), symbol, F.lit("]"))).otherwise("")
    return F.concat(F.lit("["), rank, F.lit("] "), path, lines, named, F.lit("\n"), content)
