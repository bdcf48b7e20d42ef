"""Small tables with awkward rows, and plain Python versions to compare with."""

from __future__ import annotations

import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Names that the operators use themselves.
CLASHING = "size long, shard int, h long, key string, a int, rep int, part int, node int, text_key int, id string, t int"


def vary(words: list[str], *changes: int) -> str:
    """The words with those at the given places replaced."""
    return " ".join(f"new{i}" if i in changes else w for i, w in enumerate(words))


def numbered(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(n)]


BASE, OTHER = numbered("w", 120), numbered("v", 90)
DOCS = [
    (7, " ".join(BASE)), (3, " ".join(BASE).upper()), (12, vary(BASE, 60)), (15, vary(BASE, 5, 60)), (18, vary(BASE, 5, 20, 60, 90)),
    (20, " ".join(OTHER)), (21, " ".join(OTHER) + " tail"), (22, "one two three"), (23, "one  two\tthree"), (24, "one two"),
    (30, None), (31, ""), (32, " \n\t "), (33, "é ß 中文 😀 x"), (None, " ".join(BASE)), (None, None), (40, "same row"), (40, "same row"),
    (50, " ".join(numbered("long", 30_000))), (51, "x" * 300_000), (60, "twice"), (60, "two texts of one id"),
]


def table(spark, rows, schema="doc_id long, text string", clashing=True):
    df = spark.createDataFrame(rows, schema)
    if clashing:
        from pyspark.sql import functions as F

        for field in CLASHING.split(", "):
            name, kind = field.split()
            if name not in df.columns:
                df = df.withColumn(name, F.lit("1").cast(kind))
    return df


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, width):
    w = words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def smallest(nodes, links):
    """Smallest node reachable from each."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        if n not in out:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = n
                    todo.extend(near[x])
    return out
