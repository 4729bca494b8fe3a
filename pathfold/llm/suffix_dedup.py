"""Removal of long strings that stand elsewhere too, by merging positional BWTs of shards.

Every string of LENGTH bytes has one anchor: the leftmost of its least-hashed GRAM bytes, so
equal strings have it at the same place. The strings of one anchor fall into CLASSES by their
distance from it; those of a class begin at STEP successive bytes and have a core of
LENGTH - STEP + 1 bytes in common. A repeated string has a repeated core, so cores are counted
first, and rows of single cores drop out. What is left is a row of bytes: up to STEP - 1
before the core, the core as one symbol, up to STEP - 1 behind it.

Rows of equal cores meet. Each shard of them, of SHARD rows, has its positional
Burrows-Wheeler transform: column by column the symbols in the order of the reversed prefixes,
made by stable partitions. The shards are merged by their interleave alone: it starts as one
shard behind the other and is refined column by column, each entry taking the next symbol of
its shard's column; no rows are sorted again. The start of the common run with the entry above
follows from the runs of the column before, and a run of STEP columns is a repeated interval:
two rows that share such a string.

Cores of more than HOT rows would make large groups (a passage that very many documents have,
each in other surroundings); each of their strings is counted by itself instead, by 64-bit
hash, which needs no group.

Edge cases: null and empty texts and texts shorter than LENGTH keep all bytes; texts of any
length are read whole, in pieces; overlapping occurrences count; rows that repeat a text
repeat its strings, whatever their ids; ids may be null or of any type; an empty table gives
an empty result; other columns are ignored. Equal cores and rows are told by 64 bits of hash
each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfold.llm import wordhash
from pathfold.llm.columns import column
from pathfold.llm.jaccard import binary
from pathfold.llm.kneser_ney import MAPS, Store, _send, fetch, put, shard_of
from pathfold.scratch import Scratch, free_shuffles

LENGTH = 400
GRAM = 32
WINDOW = LENGTH - GRAM + 1
#: Strings of a class begin at so many successive bytes.
STEP = 93
CLASSES = -(-WINDOW // STEP)
SIDE = STEP - 1
CORE = LENGTH - SIDE
#: Bytes of text handled at once, bytes for each shard of counts, rows for each task of the merge.
PIECE, COUNT_BYTES, TASK_ROWS = 4 << 20, 16_000_000, 40_000
#: Rows of one shard that has a transform of its own; rows of one core that meet at most.
SHARD, HOT = 4096, 20_000
#: A byte that UTF-8 never has: nothing stands there.
ABSENT = 255
_ROW = np.dtype([("core", "<u8"), ("key", "<u8"), ("times", "<u4"), ("left", "u1", SIDE), ("right", "u1", SIDE)])
_CORE_SALT = np.uint64(0xD6E8FEB86659FD93)


class Sums:
    """Prefix sums of some bytes, which give the hash of any stretch."""

    def __init__(self, raw: np.ndarray):
        self.inverse = wordhash._powers(wordhash._INVERSE, len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * wordhash._powers(wordhash._BASE, len(raw) + 1)[: len(raw)], out=self.total[1:])

    def of(self, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        return wordhash.mix((self.total[to] - self.total[at]) * self.inverse[at])


class Block:
    """The strings of some texts by anchor and class.

    raw: the bytes; end: for each position where its text ends; n: how many positions strings
    begin at (the rest only belong to strings). For each class of each anchor: base, the
    position of the string that would begin first, and low and high, which of the STEP strings
    there are.
    """

    def __init__(self, raw: np.ndarray, end: np.ndarray, n: int):
        self.raw, self.sums = raw, Sums(raw)
        self.base = self.low = self.high = np.zeros(0, np.int64)
        self.core = np.zeros(0, np.uint64)
        n = min(n, len(raw) - LENGTH + 1)
        if n <= 0:
            return
        m = len(raw) - GRAM + 1
        gram = wordhash.mix((self.sums.total[GRAM:] - self.sums.total[:-GRAM]) * self.sums.inverse[:m])
        places = np.uint64((1 << 28) - 1)
        packed = gram & ~places | np.arange(m, dtype=np.uint64)
        rows = -(-m // WINDOW)
        padded = np.full(rows * WINDOW, ~np.uint64(0))
        padded[:m] = packed
        padded = padded.reshape(rows, WINDOW)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(back[:n], ahead[WINDOW - 1 : WINDOW - 1 + n]) & places).astype(np.int64)
        at = np.flatnonzero(np.arange(n) + LENGTH <= end[:n])
        if not len(at):
            return
        anchor = anchor[at]
        group = (at - anchor + WINDOW - 1) // STEP
        start = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (group[1:] != group[:-1])])
        size = np.diff(np.r_[start, len(at)])
        self.base = anchor[start] - (WINDOW - 1) + group[start] * STEP
        self.low = at[start] - self.base
        self.high = self.low + size - 1
        self.core = wordhash.mix(self.sums.of(self.base + SIDE, self.base + LENGTH) + group[start].astype(np.uint64) * _CORE_SALT)

    def keys(self, pick: np.ndarray) -> np.ndarray:
        """For some rows a hash of the core, the bytes around it and which strings there are."""
        base, low, high = self.base[pick], self.low[pick], self.high[pick]
        body = self.sums.of(base + low, base + high + LENGTH)
        return wordhash.mix(body + (low * STEP + high).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))

    def strings(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings of some rows begin, and their hashes."""
        size = self.high[pick] - self.low[pick] + 1
        at = np.repeat(self.base[pick] + self.low[pick], size) + wordhash.spans(size)
        return at, self.sums.of(at, at + LENGTH)


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[tuple[int, Block]]]]:
    """Runs of rows: from, to, bytes, offsets, and blocks with the position they begin at."""
    for at, to, raw, offsets in wordhash.blocks(column, PIECE):
        end = np.repeat(offsets[1:], np.diff(offsets))
        yield at, to, raw, offsets, ((i, Block(raw[i : i + PIECE + LENGTH - 1], end[i : i + PIECE + LENGTH - 1] - i, PIECE)) for i in range(0, len(raw), PIECE))


def _counted(h: np.ndarray, shards: int, first: int = 0) -> pa.RecordBatch:
    h, c = np.unique(h, return_counts=True)
    batch = _send(shards, h, c.astype("<u4"))
    return batch.set_column(0, "shard", pa.array(batch.column(0).to_numpy() + np.int32(first)))


def _cores(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, blocks in pieces(batch.column(0)):
                for _, b in blocks:
                    if len(b.core):
                        yield _counted(b.core, shards)

    return run


def _keep_repeated(folder: str, kind: str, first: int = 0, hot: int = HOT):
    """Writes which hashes of a shard stand twice or more, and how often."""

    def run(table: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(table["h"].to_pylist()), "<u8")
        c = np.frombuffer(b"".join(table["v"].to_pylist()), "<u4")
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        total = np.add.reduceat(c.astype(np.int64), start)
        h, total = h[start][total > 1], total[total > 1]
        shard = table["shard"][0].as_py()
        if len(h):
            put(folder, f"{kind}-{shard - first}.hash", h)
            put(folder, f"{kind}-{shard - first}.value", np.minimum(total, 2**32 - 1).astype("<u4"))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(h)], pa.int64()), "rows": pa.array([int(total[total <= hot].sum())], pa.int64())})

    return run


def _look_up(store: Store, h: np.ndarray) -> np.ndarray:
    every, back = np.unique(h, return_inverse=True)
    return store.find(every)[1][back] if len(h) else np.zeros(0, np.int64)


def _rows(cores: Store, tasks: int, shards: int, most: int):
    """Rows of repeated cores to the tasks of the merge, strings of hot ones to shards behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, blocks in pieces(batch.column(0)):
                for _, b in blocks:
                    times = _look_up(cores, b.core)
                    hot = np.flatnonzero(times > most)
                    if len(hot):
                        yield _counted(b.strings(hot)[1], shards, tasks)
                    pick = np.flatnonzero((times > 1) & (times <= most))
                    _, first, n = np.unique(b.keys(pick), return_index=True, return_counts=True)
                    pick = pick[first]
                    if not len(pick):
                        continue
                    rows = np.zeros(len(pick), _ROW)
                    rows["core"], rows["key"], rows["times"] = b.core[pick], b.keys(pick), n
                    side, end = np.arange(SIDE), len(b.raw) - 1
                    base, low, high = b.base[pick, None], b.low[pick, None], b.high[pick, None]
                    rows["left"] = np.where(side >= low, b.raw[np.clip(base + side, 0, end)], ABSENT)
                    rows["right"] = np.where(side < high, b.raw[np.clip(base + LENGTH + side, 0, end)], ABSENT)
                    order = np.argsort(rows["core"], kind="stable")
                    sent = _send(tasks, rows["core"][order], rows[order])
                    yield sent.set_column(1, "h", pa.nulls(sent.num_rows, pa.binary()))

    return run


class ShardTransform:
    """The positional Burrows-Wheeler transform of a shard of rows: the symbols of each
    column, and the rows that its entries are of, behind the columns where strings end."""

    def __init__(self, rows: np.ndarray, core: np.ndarray):
        order = np.arange(len(rows), dtype=np.int32)
        self.rows, self.columns, self.ends = len(rows), [], []
        for k in range(2 * SIDE + 1):
            symbol = rows["left"][order, k] if k < SIDE else core[order] if k == SIDE else rows["right"][order, k - STEP]
            self.columns.append(symbol)
            order = order[np.argsort(symbol, kind="stable")]
            if k >= SIDE:
                self.ends.append(order)


def _range_max(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """max(v[low .. high]) for many ranges with low <= high."""
    span = high - low + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(low), v.dtype)
    table = v
    for k in range(int(level.max()) + 1 if len(level) else 0):
        at = np.flatnonzero(level == k)
        out[at] = np.maximum(table[low[at]], table[high[at] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.maximum(table[: len(table) - (1 << k)], table[1 << k :])
    return out


def merge(shards: list[ShardTransform]) -> list[np.ndarray]:
    """For each row of each shard which of its STEP strings another row has too.

    Only the shards' columns are read: entry i of the interleave says which shard the i-th of
    all rows (by reversed prefix) is of, and stable partitions refine it.
    """
    size = [s.rows for s in shards]
    n, first = sum(size), np.cumsum([0, *size])
    of = np.repeat(np.arange(len(shards), dtype=np.uint16), size)
    since = np.zeros(n, np.int16)
    out = [np.zeros((m, STEP), bool) for m in size]
    symbol = np.empty(n, np.int32)
    for k in range(2 * SIDE + 1):
        at = np.argsort(of, kind="stable")
        symbol[at] = np.concatenate([s.columns[k] for s in shards])
        small = symbol if k == SIDE else symbol.astype(np.uint8)
        move = np.argsort(small, kind="stable")
        now = small[move]
        new = np.full(n, k + 1, np.int16)
        same = np.flatnonzero((now[1:] == now[:-1]) & ((now[1:] != ABSENT) | (k == SIDE))) + 1
        new[same] = _range_max(since, move[same - 1] + 1, move[same])
        of, since = of[move], new
        if k >= SIDE:
            long = since <= k - SIDE
            hit = long.copy()
            hit[:-1] |= long[1:]
            at = np.argsort(of, kind="stable")
            for j, s in enumerate(shards):
                out[j][s.ends[k - SIDE][hit[at[first[j] : first[j + 1]]]], k - SIDE] = True
    return out


def _merge(folder: str, tasks: int):
    """Of the rows of one task, flags of the repeated strings of every distinct row."""
    counts = _keep_repeated(folder, "string", tasks)

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        if shard >= tasks:
            return counts(table).select(["shard", "n"])
        rows = np.concatenate([np.frombuffer(v, _ROW) for v in table["v"].to_pylist()])
        order = np.lexsort((rows["key"], rows["core"]))
        new = np.ones(len(rows), bool)
        new[1:] = (rows["core"][order[1:]] != rows["core"][order[:-1]]) | (rows["key"][order[1:]] != rows["key"][order[:-1]])
        start = np.flatnonzero(new)
        times = np.add.reduceat(rows["times"][order].astype(np.int64), start)
        rows = rows[order[start]]
        _, core, among = np.unique(rows["core"], return_inverse=True, return_counts=True)
        flags = np.zeros((len(rows), STEP), bool)
        company = np.flatnonzero(among[core] > 1)
        if len(company):
            # dealt in turn, as they come from different texts
            cuts = [company[i :: -(-len(company) // SHARD)] for i in range(-(-len(company) // SHARD))]
            found = merge([ShardTransform(rows[c], core[c].astype(np.int32)) for c in cuts])
            for c, f in zip(cuts, found, strict=True):
                flags[c] = f
        flags[times > 1] = True
        order = np.lexsort((rows["core"], rows["key"]))
        put(folder, f"row-{shard}.hash", np.ascontiguousarray(rows["key"][order]))
        put(folder, f"row-{shard}.value", np.packbits(flags[order], axis=1))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(rows)], pa.int64())})

    return run


class Flags:
    """Flags of rows, looked up by the core's task and the row's key."""

    def __init__(self, folder: str, tasks: int, filled: frozenset):
        self.folder, self.tasks, self.filled, self.open = folder, tasks, filled, {}

    def find(self, core: np.ndarray, key: np.ndarray) -> np.ndarray:
        shard = shard_of(core, self.tasks)
        wide = -(-STEP // 8)
        out = np.zeros((len(key), wide), np.uint8)
        for s in np.unique(shard):
            if int(s) not in self.filled:
                continue
            if s not in self.open:
                if len(self.open) >= MAPS:
                    self.open.clear()
                self.open[s] = fetch(self.folder, f"row-{s}.hash", "<u8"), fetch(self.folder, f"row-{s}.value", np.uint8).reshape(-1, wide)
            keys, values = self.open[s]
            mine = np.flatnonzero(shard == s)
            at = np.minimum(np.searchsorted(keys, key[mine]), len(keys) - 1)
            hit = keys[at] == key[mine]
            out[mine[hit]] = values[at[hit]]
        return np.unpackbits(out, axis=1)[:, :STEP].astype(bool)


def repeated(b: Block, cores: Store, flags: Flags, strings: Store, most: int) -> np.ndarray:
    """Where the repeated strings of a block begin."""
    times = _look_up(cores, b.core)
    pick = np.flatnonzero((times > 1) & (times <= most))
    row, j = np.nonzero(flags.find(b.core[pick], b.keys(pick))) if len(pick) else (np.zeros(0, np.int64),) * 2
    real = (j >= b.low[pick[row]]) & (j <= b.high[pick[row]])
    found = [(b.base[pick[row]] + j)[real]]
    hot = np.flatnonzero(times > most)
    if len(hot):
        at, h = b.strings(hot)
        found.append(at[_look_up(strings, h) > 1])
    return np.concatenate(found)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes.

    hot: rows of one core that meet at most.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    folder = f"{scratch.path}/tables"
    texts = docs.select(column(text_col).cast("string").alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = size // COUNT_BYTES + 1
    sent = texts.mapInArrow(_cores(shards), "shard int, h binary, v binary")
    made = sent.groupBy("shard").applyInArrow(_keep_repeated(folder, "core", hot=hot), "shard int, n long, rows long").collect()
    cores = Store(folder, "core", shards, frozenset(r["shard"] for r in made if r["n"]), "<u4")
    tasks = sum(r["rows"] for r in made) // TASK_ROWS + 1
    del sent
    free_shuffles(spark)
    found = texts.mapInArrow(_rows(cores, tasks, shards, hot), "shard int, h binary, v binary")
    done = found.groupBy("shard").applyInArrow(_merge(folder, tasks), "shard int, n long").collect()
    flags = Flags(folder, tasks, frozenset(r["shard"] for r in done if r["n"] and r["shard"] < tasks))
    strings = Store(folder, "string", shards, frozenset(r["shard"] - tasks for r in done if r["n"] and r["shard"] >= tasks), "<u4")
    del found
    free_shuffles(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, raw, offsets, blocks in pieces(batch.column(1)):
                depth = np.zeros(len(raw) + 1, np.int32)
                for first, b in blocks:
                    start = repeated(b, cores, flags, strings, hot) + first
                    depth[start] += 1
                    depth[start + LENGTH] -= 1
                gone = np.cumsum(depth[:-1], dtype=np.int32) > 0
                rows = []
                for i in range(to - at):
                    part, cut = raw[offsets[i] : offsets[i + 1]], gone[offsets[i] : offsets[i + 1]]
                    kept = part[~cut].tobytes()
                    rows.append((len(part), int(cut.sum()), int((cut[1:] & ~cut[:-1]).sum() + (cut[0] if len(cut) else 0)), hashlib.sha256(kept).hexdigest(), kept))
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 5 if with_text else 4])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_text else 5])

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text")).mapInArrow(run, schema)


QUERY = "op6_suffix_dedup"


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None
