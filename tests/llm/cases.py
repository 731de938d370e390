"""Small tables with everything that may go wrong."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    """Copies, near copies, shared passages, repeated rows, nulls in each column, blanks, one very long text."""
    rng = random.Random(seed)
    out = []
    base = [words(rng, rng.randint(1, 120)) for _ in range(40)]
    passage = words(rng, 90)
    for k, text in enumerate(base):
        out.append((k, text, "en", f"s{k % 4}", len(text)))
    for k in range(40, 60):
        parts = base[k % 12].split()
        parts[rng.randrange(len(parts))] = "changed"
        out.append((k, " ".join(parts), "en", "s0", None))
    for k in range(60, 70):
        out.append((k, base[3].replace(" ", "\n\t", 2), "en", "s1", 3))
    for k in range(70, 76):
        out.append((k, f"{words(rng, 20)} {passage} {words(rng, 20)}", None, None, 1))
    long = words(rng, 30_000)
    out += [(76, long, "en", "s2", len(long)), (77, "", "en", "s2", 0), (78, None, "en", "s2", None), (79, " \n ", "en", "s2", 3), (80, "A", "en", "s3", 1), (81, "a", "en", "s3", 1)]
    out += [(5, base[5], "en", "s1", len(base[5]))] * 2
    out += [(None, base[6], "en", "s2", 9), (None, None, None, None, None), (82, "Ümläut ßtraße 漢字 " + base[7], "de", "s1", 5)]
    return out


def table(spark, data: list[tuple] | None = None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


#: Names that the operators use within.
CLASHING = ("digest", "_digest", "size", "shard", "slot", "keep_id", "n", "a", "b", "node", "comp", "cluster", "block", "rank", "score", "source_size", "_doc", "_spans", "h", "content", "ids", "route", "toxic", "row_key", "number", "start", "bucket", "key", "v", "_key", "_stay", "_keep_id", "salt", "part", "counts")


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING))
