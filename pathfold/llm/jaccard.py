"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct 5-word shingles (64-bit hashes). Documents with equal
sets (equal size and 96 bits of sums) are one item. Shingles are ordered rarest first by the
number of items that have them; items whose shingles are shared too rarely to reach the
threshold drop out. Items with equal prefixes and size become one group, and groups that
share a prefix shingle are candidates unless their sizes, or the shingles that can still be
common behind those met in the prefixes, keep them below the threshold. Groups that pass are
expanded and their members verified.

Only components are asked for, so pairs that are already joined are left out: in two rounds
each group meets a few drawn groups of each of its shingles, which joins copies without
listing their pairs. The last step then decides every pair that is still apart. It deals in
lists: a group meets each of its shingles' groups as one row for each block of them, and the
members of candidates are compared block by block, of which only links come out.

No group of any key meets in one task unless its size is bounded: shingles that more than a
65,536th of all shingle places have skip the count and stand last in the order, copies within
a block of text are sent once, and lists of groups are cut into blocks.

Edge cases: null and empty texts, and texts without words, have no shingles and link with
nothing; fewer than five words make one shingle; texts of any length are read whole, in
pieces; rows that share an id are linked, as one document; a null id links with nothing and
has no component; an id may have any type that can be ordered; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfold.llm import wordhash
from pathfold.llm.columns import column, spare
from pathfold.llm.components import components
from pathfold.llm.memory import tidy, tidy_group
from pathfold.scratch import Scratch, free_shuffles

WORDS = 5
#: Similarity of at least NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 3, 4
#: Shingles that one task of the count holds, about: at least and, for large inputs, at most.
PER_TASK, MOST_PER_TASK = 2_000_000, 32_000_000
#: Bytes for each shingle of the table that one pass of the count may send, about: hash ranges
#: are counted in as many passes over the texts as that takes.
PER_SHINGLE = 8
#: Shingles with more than one in so many of all shingle places are not counted.
HOT = 1 << 16
#: A task reports such a shingle if it meets it so often.
SEEN = 16
#: Groups drawn of each shingle, round by round.
DRAWS = (4, 12)
#: Groups in a block of a shingle's list, and in a block of the last comparison.
LIST, BLOCK = 2048, 512
_SHARED = np.dtype([("h", "<u8"), ("f", "<u4")])
_KEY = np.dtype([("a", "<u8"), ("b", "<u4"), ("n", "<u4")])


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each row its sorted distinct shingle hashes."""
    h, begin = wordhash.words(raw, offsets)
    grams = {k: wordhash.ngrams(h, k) for k in range(1, WORDS + 1)}
    out = []
    for i in range(len(offsets) - 1):
        n = int(begin[i + 1] - begin[i])
        k = min(n, WORDS)
        out.append(np.unique(grams[k][begin[i] : begin[i + 1] - k + 1]) if n else np.zeros(0, np.uint64))
    return out


def keys_of(sets: list[np.ndarray]) -> np.ndarray:
    """Size, a 64-bit and a 32-bit sum of each set."""
    out = np.zeros(len(sets), _KEY)
    out["n"] = [len(s) for s in sets]
    out["a"] = [wordhash.mix(s ^ np.uint64(1)).sum(dtype=np.uint64) for s in sets]
    out["b"] = [wordhash.mix(s ^ np.uint64(2)).sum(dtype=np.uint64) >> np.uint64(32) for s in sets]
    return out


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key stands first, and for each key which of them it is."""
    order = np.lexsort((keys["n"], keys["b"], keys["a"]))
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    first = np.full(int(new.sum()), len(keys), np.int64)
    np.minimum.at(first, back, np.arange(len(keys)))
    return first, back


def binary(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Slices of an array's bytes as a binary column."""
    offsets = cuts * data.dtype.itemsize
    if len(offsets) and offsets[-1] >= 1 << 31:
        raise OverflowError("a block of over 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def planes(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Slices of an array as a binary column, in each all first bytes, then all second bytes
    and so on: bytes that are alike stand together, and the shuffle's compression takes them."""
    raw = np.ascontiguousarray(data).view(np.uint8).reshape(-1, data.dtype.itemsize)
    turned = [raw[a:b].T.ravel() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return binary(np.concatenate([np.zeros(0, np.uint8), *turned]), cuts * data.dtype.itemsize)


def from_planes(rows: list[bytes], kind) -> np.ndarray:
    """The arrays of such rows, joined."""
    kind = np.dtype(kind)
    out = np.empty((sum(map(len, rows)) // kind.itemsize, kind.itemsize), np.uint8)
    at = 0
    for row in rows:
        n = len(row) // kind.itemsize
        out[at : at + n] = np.frombuffer(row, np.uint8).reshape(kind.itemsize, n).T
        at += n
    return out.reshape(-1).view(kind)


def passes(total: int, texts: int, buckets: int) -> int:
    """In how many passes to count so many shingles of so many texts: each sends a text's key
    and count to every bucket that has a shingle of it, besides the hashes."""
    places = min(total, texts * buckets)
    sent = 8 * total + (_KEY.itemsize + 4) * places
    return max(1, min(buckets, -(-sent // (PER_SHINGLE * max(total, 1)))))


def share(x: np.ndarray, parts: int) -> np.ndarray:
    """Which of so many equal ranges of 64-bit numbers each is in."""
    return ((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


class Frequent:
    """Counts of the most frequent of many items (Misra and Gries), too low by 1 / HOT of
    all items at most."""

    def __init__(self, most: int = HOT):
        self.most, self.total = most, 0
        self.h, self.c = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, h: np.ndarray) -> None:
        self.total += len(h)
        every, back = np.unique(np.concatenate([self.h, h]), return_inverse=True)
        count = np.bincount(back, np.concatenate([self.c, np.ones(len(h), np.int64)]), len(every)).astype(np.int64)
        if len(every) > self.most:
            count -= np.partition(count, -self.most - 1)[-self.most - 1]
        self.h, self.c = every[count > 0], count[count > 0]

    def large(self) -> np.ndarray:
        return np.flatnonzero((self.c >= SEEN) & (self.c * self.most >= self.total))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and sums of every row's set, then (n = -1) the task's frequent shingles."""
    frequent, kind = Frequent(), pa.null()
    names = ["id", "n", "a", "b"]
    for batch in batches:
        kind = batch.column(0).type
        for at, to, raw, offsets in wordhash.blocks(batch.column(1)):
            sets = shingle_sets(raw, offsets)
            frequent.add(np.concatenate(sets))
            k = keys_of(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(k["n"].astype(np.int64)), pa.array(k["a"].view(np.int64)), pa.array(k["b"].astype(np.int64))], names=names)
    if len(at := frequent.large()):
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), kind), pa.array(np.full(len(at), -1)), pa.array(frequent.h[at].view(np.int64)), pa.array(frequent.c[at])], names=names)


def _deal(buckets: int, hot: np.ndarray, low: int, high: int):
    """Each block of rows sends each bucket of hashes from low to below high one row: keys of
    its sets, how many hashes of each, the hashes. Hot ones go to buckets of their own, spread
    by key, each in the pass of the bucket that it would follow in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offsets in wordhash.blocks(batch.column(0)):
                sets = shingle_sets(raw, offsets)
                keys = keys_of(sets)
                first = distinct_keys(keys)[0]
                keys, sets = keys[first], [sets[i] for i in first]
                h = np.concatenate(sets)
                if not len(h):
                    continue
                row = np.repeat(np.arange(len(sets)), keys["n"])
                bucket = share(h, buckets)
                if len(hot):
                    often = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                    bucket[often] = buckets + share(keys["a"][row[often]], buckets)
                if high - low < buckets:
                    mine = np.flatnonzero((bucket % buckets >= low) & (bucket % buckets < high))
                    h, row, bucket = h[mine], row[mine], bucket[mine]
                    if not len(h):
                        continue
                order = np.argsort(bucket, kind="stable")
                h, row, bucket = h[order], row[order], bucket[order]
                start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])])
                counts = np.diff(np.r_[start, len(h)]).astype(np.int32)
                used = np.unique(bucket)
                cut_h = np.r_[np.searchsorted(bucket, used), len(h)]
                cut_k = np.searchsorted(start, cut_h)
                yield pa.RecordBatch.from_arrays([pa.array(used), planes(keys[row[start]], cut_k), planes(counts, cut_k), planes(h, cut_h)], names=["bucket", "keys", "counts", "hashes"])

    return run


def _together(table: pa.Table, column: str, kind) -> np.ndarray:
    return from_planes(table[column].to_pylist(), kind)


def _count(buckets: int, ranges: int):
    """Of one bucket, for each range of keys the hashes that several sets have, with counts."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts, h = _together(table, "keys", _KEY), _together(table, "counts", "<i4"), _together(table, "hashes", "<u8")
        first, back = distinct_keys(keys)
        once = np.repeat(first[back] == np.arange(len(keys)), counts)  # a set may come from several blocks
        h, doc, keys = h[once], np.repeat(back.astype(np.int32), counts)[once], keys[first]
        del once
        if table["bucket"][0].as_py() >= buckets:
            df = np.full(len(h), 2**32 - 1, np.uint32)
        else:
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[start, len(h)])
            df = np.repeat(size.astype(np.uint32), size)
            several = df > 1
            h, doc, df = h[several], doc[several], df[several]
        order = np.argsort(doc, kind="stable")  # distinct keys are in order of a, so of their range
        h, doc, df = h[order], doc[order], df[order]
        found = np.empty(len(h), _SHARED)
        found["h"], found["f"] = h, np.minimum(df, 2**32 - 1)
        start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
        part = share(keys["a"][doc[start]], ranges)
        used = np.unique(part)
        cut_k = np.r_[np.searchsorted(part, used), len(start)]
        cut_h = np.r_[start, len(doc)][cut_k]
        sizes = np.diff(np.r_[start, len(doc)]).astype(np.int32)
        return pa.table({"part": pa.array(used, pa.int32()), "keys": planes(keys[doc[start]], cut_k), "counts": planes(sizes, cut_k), "shared": planes(found, cut_h)})

    return run


def _prepare(table: pa.Table) -> pa.Table:
    """Of one range of keys, rarest-first prefixes and sorted shared shingles of the sets
    that can link."""
    keys, counts, found = _together(table, "keys", _KEY), _together(table, "counts", "<i4"), _together(table, "shared", _SHARED)
    first, back = distinct_keys(keys)
    keys, doc = keys[first], np.repeat(back, counts)
    order = np.lexsort((found["h"], found["f"], doc))
    h, doc = found["h"][order], doc[order]
    cuts = np.searchsorted(doc, np.arange(len(keys) + 1))
    size = np.diff(cuts)
    rows: list[list] = [[] for _ in range(8)]
    for i in np.flatnonzero(size * DENOMINATOR >= keys["n"].astype(np.int64) * NUMERATOR):
        own, n = h[cuts[i] : cuts[i + 1]], int(keys["n"][i])
        need = -(-n * NUMERATOR // DENOMINATOR)
        spare = n - len(own)  # shingles of this set alone, rarest of all
        prefix = own[: max(0, n - need + 1 - spare)]
        placed = wordhash.mix(prefix + np.arange(len(prefix), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        marks = [int(wordhash.mix(placed ^ np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64)) for salt in (3, 4)]
        for column, value in zip(rows, (n, int(keys["a"][i].astype(np.int64)), int(keys["b"][i]), spare, *marks, prefix.view(np.int64), np.sort(own).view(np.int64)), strict=True):
            column.append(value)
    kinds = [pa.int64()] * 6 + [pa.list_(pa.int64())] * 2
    return pa.table({name: pa.array(v, t) for name, v, t in zip(("n", "a", "b", "spare", "p1", "p2", "prefix", "shared"), rows, kinds, strict=True)})


def near(n, i, m, j):
    """Whether sets of sizes n and m whose first common shingle has positions i and j can
    reach the threshold: by size, and by the shingles that are left from there."""
    n, i, m, j = map(F.col, (n, i, m, j))
    by_size = F.least(n, m) * DENOMINATOR >= F.greatest(n, m) * NUMERATOR
    return by_size & (F.least(n - i, m - j) * (NUMERATOR + DENOMINATOR) >= (n + m) * NUMERATOR)


def verify(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of pairs, with items a and b, whose sets reach the threshold."""
    left = items.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    right = items.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("o", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return both.filter(F.col("o") * DENOMINATOR >= (F.col("na") + F.col("nb") - F.col("o")) * NUMERATOR).select(*pairs.columns)


def several(index: DataFrame, placed: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows of the index, by component, of shingles that several components have. These
    shingles are a table first, so that the rows of a frequent one are dealt to many tasks."""
    cells = index.join(placed.select("g", "comp").distinct(), "g")
    mixed = cells.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("t")
    return scratch.write(cells.join(scratch.write(mixed, f"{name}-t"), "t").select("t", "g", "n", "i", "comp"), name)


def _candidates(table: pa.Table) -> pa.Table:
    """Of one group (and one block of each of its shingles' lists): the groups that may reach
    the threshold, one row for each block of the comparison.

    Common prefix shingles are counted, and behind the last of them no more than what is left
    can be common. Each pair is looked at once, from the smaller component.
    """
    g, comp, n, weight = (table[c][0].as_py() for c in ("g", "comp", "n", "weight"))
    lists = table["list"].combine_chunks()
    y = lists.flatten()
    i = np.repeat(table["i"].to_numpy(), lists.value_lengths().to_numpy())
    yg, yc, yn, yi, yw, yb = (y.field(c).to_numpy(zero_copy_only=False) for c in ("g", "comp", "n", "i", "weight", "yb"))
    fits = ((yw > weight) | (yw == weight) & (yc > comp)) & (np.minimum(yn, n) * DENOMINATOR >= np.maximum(yn, n) * NUMERATOR)
    order = np.flatnonzero(fits)[np.lexsort((yc[fits], yg[fits], yb[fits]))]
    yg, yc, yn, yi, yb, i = yg[order], yc[order], yn[order], yi[order], yb[order], i[order]
    start = np.flatnonzero(np.r_[True, (yg[1:] != yg[:-1]) | (yc[1:] != yc[:-1])]) if len(yg) else np.zeros(0, np.int64)
    if len(start):
        met = np.diff(np.r_[start, len(yg)])
        most = met + np.minimum(n - np.maximum.reduceat(i, start), yn[start] - np.maximum.reduceat(yi, start)) - 1
        start = start[most * (NUMERATOR + DENOMINATOR) >= (n + yn[start]) * NUMERATOR]
    used, cuts = np.unique(yb[start], return_index=True)
    cuts = pa.array(np.r_[cuts, len(start)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(cuts, pa.array(v[start])) for v in (yg, yc)]
    own = [pa.array(np.full(len(used), v)) for v in (g, comp)]
    return pa.table({"g": own[0], "comp": own[1], "yb": pa.array(used, pa.int32()), "yg": lists[0], "yc": lists[1]})


def _compare(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between components among the candidates of one block; links that follow from
    others of the block are left out."""
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            c = up
        return c

    sets = right["shared_y"].combine_chunks()
    cuts, values = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
    sizes = right["n_y"].to_numpy()
    rows: dict[tuple[int, int], list[int]] = {}
    for k, key in enumerate(zip(right["g_y"].to_pylist(), right["comp_y"].to_pylist(), strict=True)):
        rows.setdefault(key, []).append(k)
    links = []
    mine = left["shared"].combine_chunks()
    my_cuts, my_values = mine.offsets.to_numpy(), mine.values.to_numpy().view(np.uint64)
    for k, (n, comp, yg, yc) in enumerate(zip(left["n"].to_pylist(), left["comp"].to_pylist(), left["yg"].to_pylist(), left["yc"].to_pylist(), strict=True)):
        own = my_values[my_cuts[k] : my_cuts[k + 1]]
        at, comps = [], []
        for g, c in zip(yg, yc, strict=True):
            if find(c) != find(comp):
                at += rows.get((g, c), [])
                comps += [c] * (len(at) - len(comps))
        if not at:
            continue
        other = np.concatenate([values[cuts[r] : cuts[r + 1]] for r in at])
        hit = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
        both = np.add.reduceat(hit.astype(np.int64), np.r_[0, np.cumsum(cuts[1:][at] - cuts[:-1][at])[:-1]])
        for j in np.flatnonzero(both * DENOMINATOR >= (n + sizes[at] - both) * NUMERATOR):
            a, b = find(comp), find(comps[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((comp, comps[j]))
    return pa.table({"ca": pa.array([a for a, _ in links], pa.int64()), "cb": pa.array([b for _, b in links], pa.int64())})


def last_links(apart: DataFrame, placed: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """Links ca, cb between the components of apart: every pair of groups of different
    components that can reach the threshold is expanded and verified."""
    weights = placed.groupBy("comp").agg(F.count(F.lit(1)).alias("weight"))
    cells = scratch.write(apart.join(weights, "comp"), "cells")
    held = placed.join(cells.select("g", "comp").distinct(), ["g", "comp"], "left_semi")
    sets = scratch.write(held.select("id", "g", "comp").join(items.select("id", "n", "shared"), "id"), "sets")
    blocks = sets.count() // BLOCK + 1
    block = lambda parts: F.pmod(F.xxhash64("g"), F.lit(parts)).cast("int")
    counts = scratch.write(cells.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("weight", "comp")).alias("top")), "counts")
    longest = counts.agg(F.max("c")).first()[0] or 0
    lists = cells.withColumn("yb", block(blocks)).groupBy("t", block(longest // LIST + 1).alias("part"))
    lists = lists.agg(F.collect_list(F.struct("g", "comp", "n", "i", "weight", "yb")).alias("list"))
    mine = cells.join(counts.select("t", F.col("top.comp").alias("top")), "t").filter("comp <> top").drop("top")
    met = mine.join(lists, "t").groupBy("g", "comp", "part")
    found = scratch.write(met.applyInArrow(_candidates, "g long, comp long, yb int, yg array<long>, yc array<long>"), "candidates")
    mates = block(blocks // 8 + 1).alias("xb")
    left = found.join(sets, ["g", "comp"]).select("yb", mates, "n", "comp", "shared", "yg", "yc")
    wanted = found.select("yb", mates).distinct()
    right = sets.withColumn("yb", block(blocks)).join(wanted, "yb").select(*(F.col(c).alias(f"{c}_y") for c in ("yb", "xb", "g", "comp", "n", "shared")))
    return left.groupBy("yb", "xb").cogroup(right.groupBy("yb_y", "xb_y")).applyInArrow(_compare, "ca long, cb long")


def join_components(placed: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """placed with the components ca and cb of each link made one."""
    part = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch, f"{name}-cc")
    moved = placed.join(part.withColumnRenamed("v", "comp"), "comp", "left")
    return scratch.write(moved.select("id", "n", "g", F.coalesce("label", "comp").alias("comp")), name)


def drawn_pairs(apart: DataFrame, placed: DataFrame, seeds: range, scratch: Scratch, name: str) -> DataFrame:
    """Pairs a, b of members (of components ca, cb) of groups and a few drawn groups of each
    of their shingles."""
    draws = [F.min(F.struct(F.xxhash64("g", F.lit(seed)).alias("h"), "g", "n", "i", "comp")) for seed in seeds]
    picks = F.array_distinct(F.transform(F.array(*draws), lambda p: p.dropFields("h")))
    one = apart.groupBy("t").agg(picks.alias("p")).select("t", F.explode("p").alias("p"))
    one = one.select("t", F.col("p.g").alias("pg"), F.col("p.n").alias("pn"), F.col("p.i").alias("pi"), F.col("p.comp").alias("cb"))
    one = scratch.write(one, name)
    met = apart.join(one, "t").filter((F.col("comp") != F.col("cb")) & near("n", "i", "pn", "pi")).select("g", F.col("comp").alias("ca"), "pg", "cb").distinct()
    least = placed.groupBy("g", "comp").agg(F.min("id").alias("id"))
    a = least.select("g", F.col("comp").alias("ca"), F.col("id").alias("a"))
    b = least.select(F.col("g").alias("pg"), F.col("comp").alias("cb"), F.col("id").alias("b"))
    return met.join(a, ["g", "ca"]).join(b, ["pg", "cb"]).select("a", "ca", "b", "cb")


def items_of(texts: DataFrame, meta: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The items that can link: id, n, spare, p1, p2, prefix, shared."""
    rows, total = meta.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    per_task = min(max(int((64 * total) ** 0.5), PER_TASK), MOST_PER_TASK)
    parts = total // per_task + 1
    often = meta.filter("n < 0").groupBy("a").agg(F.sum("b").alias("c")).filter(F.col("c") >= total // HOT + 1).select("a")
    hot = np.sort(np.array([r["a"] for r in often.collect()], np.int64).view(np.uint64))  # HOT at most
    turns = passes(total, rows, parts)
    tables = []
    for k in range(turns):
        deal = _deal(parts, hot, k * parts // turns, (k + 1) * parts // turns)
        dealt = texts.filter("id IS NOT NULL").select("text").mapInArrow(tidy(deal), "bucket int, keys binary, counts binary, hashes binary")
        counted = dealt.groupBy("bucket").applyInArrow(tidy_group(_count(parts, parts)), "part int, keys binary, counts binary, shared binary")
        turn = F.expr(f"int(part * {turns}L div {parts})").alias("turn")
        tables.append(scratch.write(counted.select("part", "keys", "counts", "shared", turn), f"counted{k}", by="turn"))
        del dealt, counted
        free_shuffles(texts.sparkSession)  # all hashes; what several sets share is far less
    every, items = functools.reduce(DataFrame.unionAll, tables), []
    for k in range(turns):  # each moves its range of keys only, whose counts then go
        mine = every.filter(F.col("turn") == k).select("part", "keys", "counts", "shared")
        found = mine.groupBy("part").applyInArrow(tidy_group(_prepare), "n long, a long, b long, spare long, p1 long, p2 long, prefix array<long>, shared array<long>")
        items.append(scratch.write(found.join(sets.select("id", "n", "a", "b"), ["n", "a", "b"]).drop("a", "b"), f"items{k}"))
        scratch.drop(*(f"counted{j}/turn={k}" for j in range(turns)))
        del mine, found
        free_shuffles(texts.sparkSession)
    return functools.reduce(DataFrame.unionAll, items)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    meta = scratch.write(texts.mapInArrow(tidy(_describe), f"id {kind}, n long, a long, b long"), "meta")
    sets = meta.filter("id IS NOT NULL AND n > 0").groupBy("n", "a", "b").agg(F.min("id").alias("least"))
    sets = scratch.write(sets.withColumn("id", F.monotonically_increasing_id()), "sets-of-docs")
    items = items_of(texts, meta, sets, scratch)
    free_shuffles(spark)

    groups = items.groupBy("n", "p1", "p2").agg(F.min("id").alias("g"))
    placed = items.select("id", "n", "p1", "p2").join(groups, ["n", "p1", "p2"]).select("id", "n", "g", F.col("id").alias("comp"))
    placed = scratch.write(placed, "placed")
    heads = items.join(placed.filter("id = g").select("id"), "id", "left_semi")
    index = heads.select("spare", F.posexplode("prefix").alias("k", "t"), F.col("id").alias("g"), "n").select("t", "g", "n", (F.col("k") + F.col("spare")).alias("i"))
    members = placed.filter("id <> g").select(F.col("id").alias("a"), F.col("id").alias("ca"), F.col("g").alias("b"), F.col("g").alias("cb"))
    placed = join_components(placed, scratch.write(verify(members, items), "links"), scratch, "placed-m")
    apart = several(index, placed, scratch, "apart")
    seed = 0
    for k, draws in enumerate(DRAWS):
        pairs = drawn_pairs(apart, placed, range(seed, seed + draws), scratch, f"drawn{k}")
        placed = join_components(placed, scratch.write(verify(pairs, items), f"links{k}"), scratch, f"placed{k}")
        apart = several(apart.select("t", "g", "n", "i").distinct(), placed, scratch, f"apart{k}")
        seed += draws
        free_shuffles(spark)
    links = scratch.write(last_links(apart, placed, items, scratch), "links-last")

    linkable = meta.filter("id IS NOT NULL AND n > 0")
    named = sets.join(placed.select("id", "comp"), "id", "left").select("n", "a", "b", "least", F.coalesce("comp", "id").alias("comp"))
    again = linkable.groupBy("id").agg(F.min(F.struct("n", "a", "b")).alias("lo"), F.max(F.struct("n", "a", "b")).alias("hi")).filter("lo <> hi")
    again = linkable.join(again, "id").select("n", "a", "b", F.col("lo.n").alias("n2"), F.col("lo.a").alias("a2"), F.col("lo.b").alias("b2")).distinct()
    again = again.join(named.select("n", "a", "b", F.col("comp").alias("ca")), ["n", "a", "b"])
    again = again.join(named.select(F.col("n").alias("n2"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("comp").alias("cb")), ["n2", "a2", "b2"])
    part = components(links.unionAll(again.select("ca", "cb")).toDF("a", "b"), scratch, "cc-last")
    named = scratch.write(named.join(part.withColumnRenamed("v", "comp"), "comp", "left").select("n", "a", "b", "least", F.coalesce("label", "comp").alias("label")), "named")
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("c"))
    classes = named.join(smallest.filter("c > 1"), "label", "left").select("n", "a", "b", F.coalesce("component_id", "least").alias("component_id"))
    free_shuffles(spark)
    out = linkable.join(classes, ["n", "a", "b"]).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    rest = meta.filter("n = 0 OR n > 0 AND id IS NULL").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.unionAll(rest)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which one document of each component stays.

    Rows that share an id are one document and stay or go together; rows without an id link
    with nothing and all stay. Columns may have any names.
    """
    (key,) = spare(docs, "dropped_id")
    dropped = near_duplicates(docs, id_col, text_col).filter("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(dropped, column(id_col) == F.col(key), "left_anti").select(*map(column, docs.columns))


QUERY = "op9_jaccard_join"


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None
