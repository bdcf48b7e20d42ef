"""Periodic runs of words, found by the branching tandem test on an enhanced suffix array; plain functions in numpy for use
inside tasks, and the operator over a table."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.llm import textkit
from scriptmill.llm.common import ready

# A run holds at least so many words and so many times its period.
LEAST_LENGTH, LEAST_TIMES = 6, 4
# Suffixes of smaller children that are tested at once.
SLICE = 1 << 20

RUNS = "array<struct<start:long,length:long,period:long>>"


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Words of all texts as numbers (equal in one text if the words are), the offsets of the texts, and the words. Bytes are
    split at the ASCII white space that ends a word here: space and \\t to \\r."""
    parts = [t.split() for t in texts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    ids = np.empty(offsets[-1], np.int64)
    for p, a, b in zip(parts, offsets[:-1].tolist(), offsets[1:].tolist()):
        number: dict[bytes, int] = defaultdict(count(a).__next__)  # texts share no number
        ids[a:b] = np.fromiter(map(number.__getitem__, p), np.int64, b - a)
    return ids, offsets, parts


def suffix_order(ids: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and for 1, 2, 4, ... words the ranks of the suffixes by that many; two suffixes have equal ranks
    if they agree so far. Ranks are doubled until no two are equal, each time only where some still are. Words with fewer
    than ``least`` places in their text are in no run, so each of their places gets a rank of its own."""
    n = len(ids)
    end = np.repeat(offsets[1:], np.diff(offsets))
    places = np.bincount(ids, minlength=n)
    order = np.argsort(ids * 2, kind="stable")
    word = ids[order]
    new = np.ones(n, bool)
    new[1:] = (word[1:] != word[:-1]) | (places[word[1:]] < least)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    suffixes, levels, width = order, [rank], 1
    while True:
        last = np.ones(n, bool)
        last[:-1] = group[1:] != group[:-1]
        tied = np.flatnonzero(~((group == np.arange(n)) & last))  # places in the order whose group has several suffixes
        if not len(tied):
            return suffixes, levels
        at = suffixes[tied]
        beyond = at + width
        follow = np.where(beyond < end[at], rank[np.minimum(beyond, n - 1)], -1)
        sort = np.lexsort((follow, group[tied]))
        at, follow, old = at[sort], follow[sort], group[tied]
        first = np.ones(len(at), bool)
        first[1:] = (old[1:] != old[:-1]) | (follow[1:] != follow[:-1])
        suffixes[tied] = at
        group = group.copy()
        group[tied] = tied[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        rank = rank.copy()
        rank[at] = group[tied]
        levels.append(rank)
        width *= 2


def common_lengths(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that the suffixes have in common, pair by pair, from the ranks of 2^k words, the longest first."""
    n, out = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + out, b + out
        inside = (i < n) & (j < n)
        same = inside & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        out += same.astype(np.int64) << k
    return out


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the place of the nearest smaller one before and behind (-1 and n where there is none), by descending
    through the minima of 2^k values."""
    n = len(values)
    tables = [values]
    while (1 << len(tables)) <= n:
        low, w = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.minimum(low[:-w], low[w:]))
    before, behind = np.arange(n), np.arange(n) + 1  # all of [before, k] and [k, behind) is not smaller
    for k in range(len(tables) - 1, -1, -1):
        w, low = 1 << k, tables[k]
        ok = before - w >= 0
        ok[ok] = low[(before - w)[ok]] >= values[ok]
        before -= ok * w
        ok = behind + w <= n
        ok[ok] = low[behind[ok]] >= values[ok]
        behind += ok * w
    return before - 1, behind


def branching_squares(ids: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of the squares that end a stretch of ``least`` periods or more and do not go on behind it.

    Intervals of the LCP table whose suffixes have d words in common are cut where neighbours have no more: these are
    their children. For every suffix i of all children but the largest, i + d and i - d are looked up in the interval by
    their rank; both of a square's halves cannot be in the largest child, since the words behind them differ. Intervals
    with fewer than ``least`` suffixes end no such stretch, and are left out."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(ids):
        return none
    order, levels = suffix_order(ids, offsets, least)
    grouped = levels[0][order]
    shared = np.zeros(len(order) + 1, bool)
    shared[1:-1] = grouped[1:] == grouped[:-1]
    order = order[shared[:-1] | shared[1:]]  # the others agree with no suffix
    m = len(order)
    if not m:
        return none
    lcp = np.zeros(m, np.int64)
    lcp[1:] = common_lengths(order[:-1], order[1:], levels)
    rank = np.full(len(ids), -1, np.int64)
    rank[order] = np.arange(m)
    cut = np.flatnonzero(lcp)
    before, behind = nearest_smaller(lcp)
    left, right, depth = before[cut], behind[cut], lcp[cut]  # the suffixes left, ..., right - 1
    wide = right - left >= least
    cut, left, right, depth = cut[wide], left[wide], right[wide], depth[wide]
    if not len(cut):
        return none
    # cuts of one interval side by side, each with the child on its left; behind the last one, the child on its right
    sort = np.lexsort((cut, right, left))
    cut, left, right, depth = cut[sort], left[sort], right[sort], depth[sort]
    first = np.ones(len(cut), bool)
    first[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    last = np.append(first[1:], True)
    begin = np.where(first, left, np.concatenate([[0], cut[:-1]]))
    number = np.cumsum(first) - 1
    lo, hi = np.concatenate([begin, cut[last]]), np.concatenate([cut, right[last]])
    owner = np.concatenate([number, number[last]])
    left, right, depth = left[first], right[first], depth[first]
    sort = np.lexsort((hi - lo, owner))  # the largest child of an interval comes last and is left out
    smaller = sort[:-1][owner[sort[1:]] == owner[sort[:-1]]]
    lo, hi, owner = lo[smaller], hi[smaller], owner[smaller]

    n = len(ids)
    end = np.repeat(offsets[1:], np.diff(offsets))
    total = np.cumsum(hi - lo)
    starts, periods = [], []
    at = 0
    while at < len(lo):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE, side="right")))
        size = hi[at:to] - lo[at:to]
        of = np.repeat(owner[at:to], size)
        slot = np.arange(size.sum()) + np.repeat(lo[at:to] - np.cumsum(size) + size, size)
        i, d = order[slot], depth[of]
        for s in (i, i - d):  # the square may begin at i or end with its second half there
            keep = s >= 0
            for k in (0, 1, -1, -2):  # the last ``least`` halves, of which the two of the square are the last
                p = s + k * d
                inside = (p >= 0) & (p < n)
                r = rank[np.minimum(np.maximum(p, 0), n - 1)]
                keep &= inside & (r >= left[of]) & (r < right[of]) if -k <= least - 2 else True
            s, q = s[keep], d[keep]
            stop = s + 2 * q
            goes_on = stop < end[s]
            goes_on[goes_on] = ids[stop[goes_on]] == ids[(stop - q)[goes_on]]
            starts.append(s[~goes_on])
            periods.append(q[~goes_on])
        at = to
    return np.concatenate(starts), np.concatenate(periods)


def first_of_run(ids: np.ndarray, start: int, period: int, low: int) -> int:
    """The square rotated to the left as long as it stays one: where its run begins, not before ``low``."""
    step = 16
    while start > low:
        a = max(low, start - step)
        differ = np.flatnonzero(ids[a:start] != ids[a + period : start + period])
        if len(differ):
            return a + int(differ[-1]) + 1
        start, step = a, step * 2
    return start


def runs_of(ids: np.ndarray, offsets: np.ndarray, length: int = LEAST_LENGTH, times: int = LEAST_TIMES) -> list[list[tuple[int, int, int]]]:
    """Per text its runs (start, length, period) by start and period: stretches of ``length`` words and ``times`` times
    their smallest period that no neighbouring word extends. The squares that end a run are found from the smallest period
    on; squares of its multiples belong to a run that is known already."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    start, period = branching_squares(ids, offsets, times)
    sort = np.lexsort((start, period))
    owner = np.searchsorted(offsets, start, side="right") - 1
    known: dict[int, list[tuple[int, int]]] = defaultdict(list)  # end -> first word and period of the runs that end there
    for s, q, text in zip(start[sort].tolist(), period[sort].tolist(), owner[sort].tolist()):
        end = s + 2 * q
        if any(q % p == 0 and first <= s for first, p in known[end]):
            continue
        first = first_of_run(ids, s, q, int(offsets[text]))
        known[end].append((first, q))
        if end - first >= max(length, times * q):
            out[text].append((first - int(offsets[text]), end - first, q))
    return [sorted(runs) for runs in out]


def collapsed_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds behind its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()]


def periodic_runs(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  length: int = LEAST_LENGTH, times: int = LEAST_TIMES) -> DataFrame:
    """One row per input row: doc_id, runs (start, length, period in words, by start and period) and collapsed, the words
    left when every run keeps its first period only, joined by one space.

    A run is a stretch of consecutive words with smallest period q, ``length`` words and ``times`` * q words long at least
    (``times`` at least 2), that no neighbouring word extends keeping q. Every row is worked on where it is read, some
    megabytes of text at a time; a text is never cut.

    Nulls: a null, empty or blank text has no runs and an empty collapsed text. Rows without an id keep their null; repeated
    rows each get their line. An empty table gives an empty result; other columns are ignored, whatever their names."""
    ready(spark)
    if times < 2:
        raise ValueError("a run holds its period twice at least")

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in textkit.batched(batches):
            ids, offsets, parts = word_ids([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
            found = runs_of(ids, offsets, length, times)
            at = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
            flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
            fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            collapsed = [b" ".join(collapsed_words(p, r)) for p, r in zip(parts, found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(at), fields), pa.array(collapsed, pa.binary()).cast(pa.string())],
                ["doc_id", "runs", "collapsed"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(find, f"doc_id long, runs {RUNS}, collapsed string")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text of all rows, where one in ten (by the CRC-32 of the id) has a tail that repeats one stretch of its
    words: from word a on, word i is the original word a + (i - a) % p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    some = (h % 10 == 0) & (F.size("w") > 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(some, g % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    rows = rows.withColumn("tail", F.slice("w", F.col("a") + 1, F.col("p")))
    rest = F.slice(F.flatten(F.array_repeat("tail", F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), F.col("n") - F.col("a"))
    changed = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), rest), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the greatest length / period (start, length, period, exponent_milli) and the SHA-256 of
    all runs and of the collapsed text."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.reduce("runs", none, lambda b, r: F.when(
        b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("best.length * 1000 div best.period")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")
