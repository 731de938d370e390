"""Outlines against a plain program over random files."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.operators import outline as O

SIGNS = "=-~^\"'`#*+"


def files(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "path string, content string")
    return O.text_lines(df, "path", F.col("path"), F.col("content"))


def brute_heads(path, lines):
    heads, fence, styles = [], False, []
    if path.endswith(".md"):
        for n, line in enumerate(lines, 1):
            if line.lstrip()[:3] in ("```", "~~~"):
                fence = not fence
            elif not fence and (m := re.match(O.MARKDOWN, line)):
                heads.append((len(m[1]), m[2].strip(), n))
        return heads
    adorned = lambda x: re.match(O.ADORNMENT, x) is not None
    for k in range(1, len(lines)):
        title, under = lines[k - 1], lines[k]
        if adorned(under) and title.strip() and not adorned(title) and len(under.rstrip()) >= len(title.rstrip()) and title[0] not in " \t" and title[:2] != "..":
            style = under[0], k > 1 and lines[k - 2].strip() == under.strip()
            styles += [style] if style not in styles else []
            heads.append((styles.index(style), title.strip(), k - 1 if style[1] else k))
    return heads


def brute_outline(path, text):
    lines = re.split("\r\n|\n|\r", text)
    heads, out = brute_heads(path, lines), []
    for rank, title, start in heads:
        end = min([n - 1 for r, _, n in heads if n > start and r <= rank], default=len(lines))
        while end > start and (not lines[end - 1].strip() or re.match(O.TARGET, lines[end - 1])):
            end -= 1
        out.append((path, rank, title, start, end))
    return out


def brute_data(path, text):
    lines = text.split("\n")
    out = []
    for n, line in enumerate(lines, 1):
        if m := re.match(r"^\.\. py:data:: (.+)$", line.strip()):
            end = len(lines)
            for k in range(n + 1, len(lines) + 1):
                if lines[k - 1].startswith(".. ") or (k < len(lines) and re.match(O.BLOCK_END, lines[k])):
                    end = k - 1
                    break
            while end > n and not lines[end - 1].strip():
                end -= 1
            out.append((path, m[1], n, end))
    return out


def made(seed):
    rng = random.Random(seed)
    out = {}
    for k in range(25):
        lines = []
        for _ in range(rng.randint(0, 14)):
            sign, title = rng.choice(SIGNS), rng.choice(["One", "Two words", "..dots", " indented", "===", "Ünder"])
            lines += rng.choice([
                [], [""], ["text"], ["```", "# not one", "```"], ["  ~~~"], ["#" * rng.randint(1, 7) + " " + title + rng.choice(["", " ##", "#"])], [title, sign * rng.randint(2, 12) + rng.choice(["", " "])], [sign * 9, title, sign * 9],
                [".. _target:", ""], [".. py:data:: a.b", "", "   Says.", ""], ["  .. py:data:: c "], ["---", "==="],
            ])
        out[f"f{k}." + rng.choice(["md", "rst"])] = "\n".join(lines)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    texts = made(seed)
    lines = files(spark, texts)
    assert sorted(map(tuple, O.outline(lines).collect())) == sorted(x for p, t in texts.items() for x in brute_outline(p, t))
    assert sorted(map(tuple, O.data_blocks(lines).collect())) == sorted(x for p, t in texts.items() for x in brute_data(p, t))


GUIDE = "Guide\n=====\n\nIntro.\n\nFirst\n-----\n\nText.\n\nInner\n~~~~~\n\nMore.\n\n.. _second:\n\nSecond\n------\n\nEnd.\n"


def test_sections_by_name(spark):
    lines = files(spark, {"g.rst": GUIDE, "g.md": "# A\n```\n# A\n```\n## B ##\nx\n\n# C\n"})
    asked = spark.createDataFrame([("g.rst", "First"), ("g.rst", "Inner"), ("g.rst", "Guide"), ("g.md", "A"), ("g.md", "B")], "key string, name string")
    got = {(r.key, r.name): (r.start_line, r.end_line) for r in O.sections_of(asked, lines).collect()}
    assert got == {("g.rst", "First"): (6, 14), ("g.rst", "Inner"): (11, 14), ("g.rst", "Guide"): (1, 21), ("g.md", "A"): (1, 6), ("g.md", "B"): (5, 6)}


@pytest.mark.parametrize(("text", "name", "times"), [("# A\n# A\n", "A", 2), ("# A\n", "B", 0)])
def test_a_heading_must_be_one(spark, text, name, times):
    asked = spark.createDataFrame([("x.md", name)], "key string, name string")
    with pytest.raises(Exception, match=f"x.md: heading {name} found {times} times"):
        O.sections_of(asked, files(spark, {"x.md": text})).collect()


def test_data_by_name(spark):
    lines = files(spark, {"x.rst": ".. py:data:: g\n\n   Text.\n\n\nTitle\n=====\n"})
    asked = spark.createDataFrame([("x.rst", "g")], "key string, name string")
    assert [tuple(r) for r in O.data_blocks_of(asked, lines).collect()] == [("x.rst", "g", 1, 3)]
    with pytest.raises(Exception, match="py:data h found 0 times"):
        O.data_blocks_of(asked.withColumn("name", F.lit("h")), lines).collect()
