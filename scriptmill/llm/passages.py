"""Passages that repeat across documents: paragraphs by content, MinHash bands, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.llm import textkit
from scriptmill.llm.common import Stored, components, ready

# Words of a shingle and of a paragraph; every stretch of so many starts of paragraphs has one that is looked at; bands,
# beside the band of the whole paragraph, and coordinates of each; words of a passage that is reported.
SHINGLE, PARAGRAPH, STRETCH, BANDS, WIDTH, PASSAGE = 5, 24, 26, 4, 2, 50
SIMILAR = 0.8
# Words of a piece of a passage, which agree; chains of pieces up to which a loop is faster than arrays.
PIECE, FEW = 8, 48
BROADCAST_IDS = 1_000_000
# Members of a block of one bucket; words on each side of a paragraph that a passage around it may have, and places of
# shingles (the paragraph has 20) that two members need in common to be worth aligning.
BLOCK, SIDE, COMMON = 256, PASSAGE - 1, PARAGRAPH - SHINGLE + 5


def _least(value: np.ndarray, place: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
    """Place of the first smallest value in every window, whose width doubles, or grows by less, with each step."""
    for step in steps:
        right = value[step:] < value[:-step]
        place = np.where(right, place[step:], place[:-step])
        value = np.minimum(value[step:], value[:-step])
    return place


def units(word: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chosen paragraphs of texts that lie one after the other in ``word``: start, hash, band keys (a row per paragraph), and
    the offsets of the texts in them.

    A paragraph may start at any word. Of the starts in a stretch the one whose shingle has the smallest hash is chosen, so
    two texts with a common passage of PARAGRAPH + STRETCH - 1 words choose a common paragraph wherever it lies."""
    if len(word) < PARAGRAPH:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), np.zeros((0, BANDS + 1), np.uint64), np.zeros(len(rows), np.int64)
    shingle = textkit.runs(word, SHINGLE)
    size = np.diff(rows)
    behind = (np.repeat(rows[1:], size) - np.arange(len(word)))[: len(shingle)]  # words to the end of the text
    rank = textkit.mix64(shingle ^ np.uint64(0xA0761D6478BD642F))
    rank[behind < PARAGRAPH] = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = _least(rank, np.arange(len(rank)), (1, 2, 4, 8, STRETCH - 16))
    chosen = np.zeros(len(word), bool)
    chosen[least[behind[: len(least)] >= PARAGRAPH + STRETCH - 1]] = True
    n = size - PARAGRAPH + 1
    for i in np.flatnonzero((n > 0) & (n <= STRETCH)).tolist():
        chosen[rows[i] + rank[rows[i] : rows[i] + n[i]].argmin()] = True
    start = np.flatnonzero(chosen)
    whole = word[start]
    for k in range(1, PARAGRAPH):
        whole = whole * textkit._STEP + word[start + k]
    whole = textkit.mix64(whole)
    place = (textkit.mix64(shingle) >> np.uint64(32)).astype(np.uint32)
    at = np.arange(len(place), dtype=np.uint64)
    keys = np.empty((len(start), BANDS + 1), np.uint64)
    keys[:, 0] = whole
    for j in range(BANDS):  # circulant coordinates, each named by the shingle that has the smallest value
        key = np.full(len(start), j + 1, np.uint64)
        for k in range(j * WIDTH, (j + 1) * WIDTH):
            t = place - np.uint32(k)
            textkit._pi(t)
            low = (t.astype(np.uint64) << np.uint64(32)) | at
            for step in (1, 2, 4, 8, PARAGRAPH - SHINGLE + 1 - 16):
                low = np.minimum(low[step:], low[:-step])
            key = textkit.mix64(key + shingle[(low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)])
        keys[:, j + 1] = key
    return start, whole, keys, np.searchsorted(start, rows)


def paragraphs(word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each chosen paragraph of one text, its hash, and its band keys (``units``)."""
    return units(word, np.array([0, len(word)]))[:3]


def _each(word: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The words of every text and its ``paragraphs``, which are computed for all texts at once."""
    start, whole, keys, cut = units(word, rows)
    for a, b, u, v in zip(rows[:-1].tolist(), rows[1:].tolist(), cut[:-1].tolist(), cut[1:].tolist()):
        yield word[a:b], (start[u:v] - a, whole[u:v], keys[u:v])


def _distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in order; for short arrays faster than np.unique."""
    values = values.copy()
    if len(values) < 2:
        return values
    values.sort()
    keep = np.empty(len(values), bool)
    keep[0] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def band_rows(docs: DataFrame) -> DataFrame:
    """doc_id and the distinct band keys of its paragraphs."""

    def keys(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in textkit.batched(batches, 1 << 20):
            raw, offsets = textkit.buffers(batch.column(1))
            _, _, word, rows = textkit.words(raw, offsets)
            lists = [_distinct(found[2].ravel()).view(np.int64) for _, found in _each(word, rows)]
            cut = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cut), pa.array(flat))], ["doc_id", "keys"])

    return docs.mapInArrow(keys, "doc_id long, keys array<long>").select("doc_id", F.explode("keys").alias("key"))


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two stretches have equal shingles (given, at least one of each) to the share SIMILAR."""
    s, t = _distinct(x), _distinct(y)
    union = len(_distinct(np.concatenate([s, t])))
    return len(s) + len(t) - union >= SIMILAR * union


def by_key(units: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The band keys of all paragraphs of a text, sorted, and the paragraphs' starts in that order."""
    flat = units[2].ravel()
    order = np.argsort(flat, kind="stable")
    return flat[order], np.repeat(units[0], units[2].shape[1])[order]


def _pieces(x: np.ndarray, y: np.ndarray, units_x: tuple, index_y: tuple) -> list[tuple[int, int, int]]:
    """Runs of PIECE equal words or more (start in x, end in x, diagonal) on the diagonals of paragraphs with a common key.
    A paragraph of x in equal runs of PASSAGE words adds no diagonal; places of one in y come from their slices of the
    index, and no list of all pairs of places is made."""
    keys, starts = index_y
    lo = np.searchsorted(keys, units_x[2], side="left")
    hi = np.searchsorted(keys, units_x[2], side="right")
    n = (hi - lo).sum(axis=1)
    some = np.flatnonzero(n)
    pieces: list[tuple[int, int, int]] = []
    if not len(some):
        return pieces
    in_x, in_y = textkit.runs(x, PIECE), textkit.runs(y, PIECE)
    shift = len(y)
    seen = bytearray(len(x) + len(y) + 1)  # by diagonal + len(y)
    seen_too = np.frombuffer(seen, np.uint8)
    found, full = bytearray(len(x)), bytes([1]) * PARAGRAPH  # words in equal runs that are passages by themselves
    for a, places, low, high in zip(units_x[0][some].tolist(), n[some].tolist(), lo[some].tolist(), hi[some].tolist()):
        if found[a : a + PARAGRAPH] == full:
            continue
        if places <= 8:
            at = sorted({e for p, q in zip(low, high) if q > p for e in starts[p:q].tolist()})
        else:
            every = np.concatenate([starts[p:q] for p, q in zip(low, high) if q > p])
            at = _distinct(every[seen_too[a - every + shift] == 0]).tolist()
        for e in at:
            d = a - e
            if seen[d + shift]:
                continue
            if found[a : a + PARAGRAPH] == full:
                break
            seen[d + shift] = 1
            first, end = max(0, d), min(len(in_x), len(in_y) + d)
            if end <= first:
                continue
            equal = (in_x[first:end] == in_y[first - d : end - d]).nonzero()[0]
            m = len(equal)
            if not m:
                continue
            p, q = int(equal[0]) + first, int(equal[-1]) + first + PIECE
            if m == q - PIECE - p + 1:
                ends = [(p, q)]
            else:
                gap = (equal[1:] - equal[:-1] > 1).nonzero()[0]
                ends = list(zip([p, *(equal[gap + 1] + first).tolist()], [*(equal[gap] + (first + PIECE)).tolist(), q]))
            for p, q in ends:
                pieces.append((p, q, d))
                if q - p >= PASSAGE:
                    found[p:q] = b"\1" * (q - p)
    return pieces


def common_passages(x: np.ndarray, y: np.ndarray, units_x: tuple, index_y: tuple) -> list[tuple[int, int, int, int]]:
    """Passages (first and last word in x, first and last word in y, ends excluded) that two texts have in common. They
    begin at paragraphs with a common key (``by_key`` of y), at every place that y has for it, unless equal runs of PASSAGE words already
    hold the paragraph in x. Along the diagonal equal words form pieces. Pieces in the same order in both texts are joined
    over gaps of any length, and what is joined must have PASSAGE words and equal shingles to the share SIMILAR; if it does
    not, it is parted at its longest gap."""
    if len(x) == len(y) and np.array_equal(x, y):
        return [(0, len(x), 0, len(y))] if len(x) >= PASSAGE else []
    pieces = _pieces(x, y, units_x, index_y)
    if not pieces:
        return []
    chains: list[list[tuple[int, int, int]]] = []  # pieces (start in x, end in x, diagonal)
    most = min(len(x), len(y)) // 4 + PIECE  # a longer gap leaves no share of 0.8, whatever lies around it
    ends = np.zeros((2, len(pieces)), np.int64)
    last: list[tuple[int, int]] = []  # the same ends, for few chains
    for a, b, d in sorted(pieces):
        at, best = 0, most + 1
        if len(chains) <= FEW:
            for i, (u, v) in enumerate(last):
                g, h = a - u, a - d - v
                if g < best and h < best and g > -PIECE and h > -PIECE and u < b and v < b - d:
                    at, best = i, max(g, h)
        else:
            gap = np.array([[a], [a - d]]) - ends[:, : len(chains)]
            wide = gap.max(axis=0)
            behind = ends[:, : len(chains)] >= np.array([[b], [b - d]])
            wide[(gap.min(axis=0) <= -PIECE) | behind.any(axis=0)] = most + 1
            at = int(wide.argmin())
            best = wide[at]
        if best <= most:
            chains[at].append((a, b, d))
            last[at] = b, b - d
        else:
            at = len(chains)
            chains.append([(a, b, d)])
            last.append((b, b - d))
        ends[:, at] = b, b - d
    out: list[tuple[int, int, int, int]] = []
    chains.sort(key=lambda c: c[-1][1] - c[0][0])
    lost = bytearray(len(x))
    in_x, in_y = textkit.runs(x, SHINGLE), textkit.runs(y, SHINGLE)
    while chains:
        chain = chains.pop()
        (a, _, d), (_, b, e) = chain[0], chain[-1]
        p, q = a - d, b - e
        if min(b - a, q - p) < PASSAGE or lost.find(0, a, b) < 0:  # another place in y of words that x loses already
            continue
        if _similar(in_x[a : b - SHINGLE + 1], in_y[p : q - SHINGLE + 1]):
            out.append((a, b, p, q))
            lost[a:b] = b"\1" * (b - a)
        elif len(chain) > 1:
            gaps = [max(v[0] - u[1], v[0] - v[2] - u[1] + u[2]) for u, v in zip(chain, chain[1:])]
            at = gaps.index(max(gaps)) + 1
            chains += [chain[:at], chain[at:]]
    return out


def _chars(raw: np.ndarray, a: int, b: int) -> int:
    """Characters of a stretch of UTF-8."""
    return int(((raw[a:b] & 0xC0) != 0x80).sum())


FOUND = ("doc_id long, first_word long, end_word long, start long, length long, kept_in long, kept_first long, kept_end long, "
         "kept_start long, kept_length long, unit long, unit_first long, unit_last long")


def verified(pairs: DataFrame) -> DataFrame:
    """For pairs (a, b, text_a, text_b): the passages they share, with their place in a and in b (the one kept), and three
    of the paragraphs in it: the one with the smallest hash, the first and the last."""

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        import pyarrow.compute as pc

        for batch in textkit.batched(batches, 1 << 20):
            raw, offsets = textkit.buffers(batch.column(2))
            start, end, word, cut = textkit.words(raw, offsets)
            # Pairs come in the order of b, so each run of pairs with one text of b has it taken apart once.
            same = batch.column(3).fill_null("")
            new = np.ones(len(same), bool)
            new[1:] = np.asarray(pc.not_equal(same[1:], same[:-1]))
            data_b, at_b = textkit.buffers(same.filter(pa.array(new)))
            start_of, end_of, words_of, rows_of = textkit.words(data_b, at_b)
            right = [(w, u, by_key(u)) for w, u in _each(words_of, rows_of)]
            rows = []
            for i, (a, b, k, (mine, own)) in enumerate(
                    zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (np.cumsum(new) - 1).tolist(), _each(word, cut))):
                word_b, units_b, index_b = right[k]
                base, base_b, first_b = int(offsets[i]), int(at_b[k]), int(rows_of[k])
                for x0, x1, y0, y1 in common_passages(mine, word_b, own, index_b):
                    p, q = int(start[cut[i] + x0]), int(end[cut[i] + x1 - 1])
                    r, t = int(start_of[first_b + y0]), int(end_of[first_b + y1 - 1])
                    inside = units_b[1][(units_b[0] >= y0) & (units_b[0] + PARAGRAPH <= y1)].view(np.int64)
                    if not len(inside):
                        inside = textkit.runs(word_b[y0:y1], PARAGRAPH)[:1].view(np.int64)
                    rows.append((a, x0, x1, _chars(raw, base, p), _chars(raw, p, q), b, y0, y1, _chars(data_b, base_b, r), _chars(data_b, r, t),
                                 int(inside.min()), int(inside[0]), int(inside[-1])))
            if rows:
                names = [f.split()[0] for f in FOUND.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(verify, FOUND)


MEMBERS = "doc_id long, key long, places array<int>, least int, near array<long>"
# Places of shingles in the shortest passage, and in a paragraph.
SHORTEST, OWN = PASSAGE - SHINGLE + 1, PARAGRAPH - SHINGLE + 1


def _fewest(around: np.ndarray, at: int) -> int:
    """The least number of different shingles in a passage of the smallest length that holds the paragraph at that place;
    where hardly any shingle repeats, all of them."""
    if 10 * len(_distinct(around)) >= 9 * len(around):
        return SHORTEST
    view = np.lib.stride_tricks.sliding_window_view(around, min(SHORTEST, len(around)))
    view = np.sort(view[max(0, at + OWN - SHORTEST) : at + 1], axis=1)
    return int((view[:, 1:] != view[:, :-1]).sum(axis=1).min()) + 1


def _open(batches: Iterator) -> Iterator:
    """Of rows (doc_id, text, keys, spans): doc_id, the words, the starts and keys of the paragraphs outside the removed
    passages, and the wanted keys that one of these has; a list per batch."""
    for batch in textkit.batched(batches, 1 << 20):
        raw, offsets = textkit.buffers(batch.column(1))
        _, _, word, cut = textkit.words(raw, offsets)
        out = []
        for doc, wanted, spans, (mine, (start, _, keys)) in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), _each(word, cut)):
            left = np.ones(len(start), bool)
            for s in spans or []:
                left &= (start < s["first_word"]) | (start + PARAGRAPH > s["end_word"])
            flat = keys[left].view(np.int64)
            out.append((doc, mine, start[left], flat, np.intersect1d(flat, np.array(wanted, np.int64))))
        yield out


def open_keys(rows: DataFrame) -> DataFrame:
    """For rows (doc_id, text, keys, spans): doc_id and each key that has a paragraph outside the removed passages."""

    def keys(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rows in _open(batches):
            if rows:
                doc = np.repeat(np.array([r[0] for r in rows], np.int64), [len(r[4]) for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.concatenate([r[4] for r in rows]))], ["doc_id", "key"])

    return rows.select("doc_id", "text", "keys", "spans").mapInArrow(keys, "doc_id long, key long")


def open_members(rows: DataFrame) -> DataFrame:
    """For rows (doc_id, text, keys, spans): one row per key that has a paragraph outside the removed passages, with the
    places of these paragraphs, the different shingles of the words around all of them, and how many different ones the
    shortest passage around one of them has at least."""

    def members(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rows in _open(batches):
            out = []
            for doc, mine, places, flat, wanted in rows:
                shingle = textkit.runs(mine, SHINGLE)
                fewest: dict[int, int] = {}  # by place, which has several keys
                for key in wanted.tolist():
                    at = places[(flat == key).any(axis=1)]
                    around = np.zeros(len(shingle) + 1, np.int32)
                    np.add.at(around, np.maximum(0, at - SIDE), 1)
                    np.add.at(around, np.minimum(len(shingle), at + PARAGRAPH + SIDE - SHINGLE + 1), -1)
                    near = _distinct(shingle[np.cumsum(around)[:-1] > 0])
                    for p in at.tolist():
                        if p not in fewest:
                            fewest[p] = _fewest(shingle[max(0, p - SIDE) : p + PARAGRAPH + SIDE - SHINGLE + 1], min(p, SIDE))
                    out.append((doc, key, at.astype(np.int32), min(fewest[p] for p in at.tolist()), near.view(np.int64)))
            if out:
                doc, key, at, least, near = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(least, pa.int32()),
                     pa.array(near, pa.list_(pa.int64()))], ["doc_id", "key", "places", "least", "near"])

    return rows.select("doc_id", "text", "keys", "spans").mapInArrow(members, MEMBERS)


def _alike(near: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """Pairs of members that have COMMON shingles in common, and less where a passage around them may hold fewer."""
    owner = np.repeat(np.arange(len(near)), [len(e) for e in near])
    _, column = np.unique(np.concatenate(near), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both, width, at = np.zeros((len(near), len(near)), np.float32), 4096, 0
    while at < len(column):
        first = column[at]
        to = int(np.searchsorted(column, first + width))
        held = np.zeros((len(near), width), np.float32)
        held[owner[at:to], column[at:to] - first] = 1
        both += held @ held.T
        at = to
    return both * 2 * SHORTEST >= COMMON * (least[:, None] + least[None, :])


def next_pairs(members: DataFrame, tried: DataFrame, many: int) -> DataFrame:
    """Pairs to be compared next, a row per open member (doc_id, key, least, near) of a bucket that has some: key, a, b (the
    ``many`` smallest documents of the bucket before it that look alike and that it has not been compared with), more
    (whether there are others). A bucket is cut into blocks and every two blocks meet in one task; pairs exist only as cells
    of a matrix. Buckets of one block are dealt to lots, several of which a task takes one bucket at a time."""
    blocks = members.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(
        "k", F.ceil(F.col("m") / BLOCK).cast("int").alias("g"))
    known = tried.groupBy(F.col("a").alias("d")).agg(F.collect_set("b").alias("known"))
    dealt = members.join(blocks, F.col("key") == F.col("k")).join(known, F.col("doc_id") == F.col("d"), "left")
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64("doc_id"), F.col("g")).cast("int")).withColumn(
        "o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    lots = max(1, members.count() // BLOCK)
    lot = F.when(F.col("g") == 1, F.pmod(F.xxhash64("key"), F.lit(lots))).otherwise(F.col("key"))
    dealt = dealt.select(lot.alias("lot"), "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "doc_id", "least", "near", "known")

    def link(table):
        import pyarrow as pa

        table = table.combine_chunks().sort_by("key")
        key, docs, least = (np.asarray(table.column(c)) for c in ("key", "doc_id", "least"))
        near, known = (table.column(c).combine_chunks() for c in ("near", "known"))
        near = near.chunk(0) if isinstance(near, pa.ChunkedArray) else near
        values, cut = np.asarray(near.values), np.asarray(near.offsets)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
        out = []
        for p, q in zip(first, [*first[1:], len(key)]):
            mine = docs[p:q]
            alike = _alike([values[cut[m] : cut[m + 1]] for m in range(p, q)], least[p:q]) & (mine[None, :] < mine[:, None])
            for m in np.flatnonzero(alike.any(axis=1)).tolist():
                new = np.setdiff1d(mine[alike[m]], np.array(known[p + m].as_py() or [], np.int64))
                if len(new):
                    out.append((int(key[p]), int(mine[m]), new[:many], len(new) > many))
        key, a, b, more = zip(*out) if out else ((), (), (), ())
        return pa.table({"key": pa.array(key, pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.list_(pa.int64())),
                         "more": pa.array(more, pa.bool_())})

    found = dealt.groupBy("lot", "i", "j").applyInArrow(link, "key long, a long, b array<long>, more boolean")
    every = F.array_distinct(F.flatten(F.collect_list("b")))  # of as many as there are pairs of blocks
    found = found.groupBy("key", "a").agg(F.array_sort(every).alias("b"), F.max("more").alias("more"))
    return found.select("key", "a", F.slice("b", F.lit(1), F.lit(many)).alias("b"), (F.col("more") | (F.size("b") > many)).alias("more"))


def later_passages(store: Stored, texts: DataFrame, members: DataFrame, pairs: DataFrame, found: DataFrame, compared) -> DataFrame:
    """``found``, and what documents of one bucket (members: doc_id, key) have in common beyond the stars around its smallest
    one: in rounds, every document that keeps a paragraph of the bucket outside the passages it loses is compared with the
    smallest ones like it that are left, twice as many in each round, until nothing is left to compare. Each pair is compared
    once, whatever keys it shares."""
    def spans_of(found: DataFrame) -> DataFrame:
        return store.keep(found.groupBy(F.col("doc_id").alias("d")).agg(F.collect_set(F.struct("first_word", "end_word")).alias("spans")))

    spans = spans_of(found)

    def parsed(members: DataFrame, read) -> DataFrame:
        keys = members.groupBy(F.col("doc_id").alias("k")).agg(F.collect_set("key").alias("keys"))
        return read(texts.join(keys, F.col("doc_id") == F.col("k")).join(spans, F.col("doc_id") == F.col("d"), "left"))

    touched = members.join(spans.select("d"), F.col("doc_id") == F.col("d"), "left_semi")
    left = members.join(spans.select("d"), F.col("doc_id") == F.col("d"), "left_anti").unionByName(
        parsed(touched, open_keys))
    left = store.keep(left)
    shared = left.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key")
    left = store.keep(parsed(left.join(shared, "key", "left_semi"), open_members))
    covers = lambda p, s: (s["first_word"] <= p) & (p + PARAGRAPH <= s["end_word"])
    many = 1
    while True:
        chosen = store.keep(next_pairs(left, pairs, many))
        new = store.keep(chosen.select("a", F.explode("b").alias("b")).distinct())
        if not new.limit(1).count():
            return found
        many *= 2
        more = compared(new)
        pairs, found = pairs.unionByName(new), found.unionByName(more)
        gone = spans_of(more)  # of this round; what earlier ones have covered is no member any more
        rest = chosen.filter("more").select("key").distinct()  # in other buckets every pair that is alike has been compared
        now = left.join(rest, "key", "left_semi").join(gone, F.col("doc_id") == F.col("d"), "left")
        still = F.exists("places", lambda p: ~F.exists(F.coalesce("spans", F.array()), lambda s: covers(p, s)))
        left = store.keep(now.filter(F.col("spans").isNull() | still).select(*left.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per passage of 50 words or more that documents share: doc_id, first_word, end_word (excluded), start and
    length (characters), cluster, kept_in (the document with the smallest id that it was compared with), removed.

    Paragraphs of 24 words are chosen by content (``paragraphs``). A band key that several documents have is a bucket;
    each of its documents is compared with the one with the smallest id. Documents that keep the paragraph after that are
    compared with each other, in rounds: each with the smallest ones left whose words around the paragraph are alike, until
    nothing is left to compare. The bands are one of the whole paragraph, whose buckets hold equal paragraphs only, and four of two
    circulant MinHash coordinates, which bring together a pair of paragraphs of Jaccard similarity 0.8 with probability
    0.98, and a passage by any of its paragraphs. Comparison is on whole texts. Paragraphs of a verified passage are linked,
    and the components of the links are the clusters. In a document that is not the first of its pair the passage is to be
    removed; the lines of the first ones, one per cluster, span all that others have in common with them.

    Nulls: null, empty and shorter texts hold no passage. Rows without an id cannot be named and are left out; rows that
    share an id count as one document. Passages repeated only inside a document are not reported. An empty table gives an
    empty result; other columns are ignored."""
    ready(spark)
    store = Stored(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    keys = store.keep(band_rows(docs))
    buckets = store.keep(keys.groupBy("key").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("last")).filter(
        "b < last").select("key", "b"))
    members = store.keep(keys.join(buckets, "key").filter("doc_id <> b").distinct())
    store.drop(0, 1)  # keys and buckets, which nothing reads any more
    pairs = store.keep(members.select(F.col("doc_id").alias("a"), "b").distinct())
    ids = store.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = store.keep(docs.join(wanted, docs["doc_id"] == wanted["id"], "left_semi"))

    def compared(pairs: DataFrame) -> DataFrame:
        return store.keep(verified(pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")))

    found = later_passages(store, texts, members.select("doc_id", "key"), pairs, compared(pairs), compared)
    edges = found.select("unit", F.explode(F.array("unit_first", "unit_last")).alias("other"))
    roots = store.keep(components(spark, edges, "unit", "other"))
    named = found.join(roots, F.col("unit") == F.col("node"), "left").withColumn("cluster", F.coalesce("root", "unit"))
    late = named.groupBy("doc_id", "first_word", "end_word", "start", "length", "cluster").agg(
        F.min("kept_in").alias("kept_in"), F.lit(True).alias("removed"))
    reach = F.max(F.col("kept_start") + F.col("kept_length")) - F.min("kept_start")
    first = named.groupBy(F.col("kept_in").alias("doc_id"), "cluster").agg(
        F.min("kept_first").alias("first_word"), F.max("kept_end").alias("end_word"), F.min("kept_start").alias("start"),
        reach.alias("length"))
    first = first.withColumn("kept_in", F.col("doc_id")).withColumn("removed", F.lit(False))
    return late.unionByName(first)


def cleaned(spark: SparkSession, docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, without the passages marked as removed; ids must be unique."""
    ready(spark)
    spans = passages.filter("removed").groupBy(F.col("doc_id").alias("__d")).agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("__spans"))

    @F.arrow_udf("string")
    def cut(texts, spans):
        import pyarrow as pa

        out = []
        for t, ss in zip(texts.to_pylist(), spans.to_pylist()):
            at, parts = 0, []
            for s in ss or []:
                if s["start"] > at:
                    parts.append(t[at : s["start"]])
                at = max(at, s["start"] + s["length"])
            out.append(t if not ss else "".join(parts) + t[at:])
        return pa.array(out, pa.string())

    rows = docs.join(spans, docs[doc_id] == F.col("__d"), "left")
    return rows.withColumn(text, cut(text, F.col("__spans"))).select(*docs.columns)
