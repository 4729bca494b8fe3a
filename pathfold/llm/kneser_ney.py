"""Interpolated modified Kneser-Ney n-grams of words, counted in Spark.

Counts are kept as arrays sorted by 64-bit hash, cut into shards by hash range, as plain
files in the shared folder; workers map them into memory and look up whole blocks of texts
at once. A text stands behind order - 1 begin tokens. The first pass counts the longest
n-grams. Each further pass goes down by one word: from the counts of the n-grams above it
derives, occurrence by occurrence, how often each n-gram stands, how many different words
stand before it, and, as a context, how many follow it with count 1, 2 and more. The last
pass scores. Single words interpolate with the uniform 1 / (V + 1), so unknown words have mass.

Edge cases: null and empty texts are one end token; without training texts every token is
unknown and the model is uniform; a null id counts as training; repeated rows are scored
alike and each counts; texts of any length are read whole; ties do not arise; an empty table
gives an empty result; ids may have any type; other columns are ignored, whatever their names;
an order below 2 is refused.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfold.llm import wordhash
from pathfold.llm.columns import column
from pathfold.llm.jaccard import binary
from pathfold.scratch import Scratch, free_shuffles

END, BEGIN = np.uint64(0x51ED270B0A1F3C5D), np.uint64(0x2545F4914F6CDD1D)
#: Words in the longest n-gram.
ORDER = 3
#: Bytes of text for each shard of the longest n-grams, of those between, and of words.
TOP_BYTES, MIDDLE_BYTES, WORD_BYTES = 12_000_000, 4_000_000, 24_000_000
BLOCK = 8 << 20
#: N-grams whose statistics a task holds before it adds them up.
HELD = 2_000_000
#: Shards that a worker has mapped before it lets go of all of them.
MAPS = 8192
#: Of an n-gram: how often it stands and how many words stand before it; of what follows it:
#: the sum of the counts, and how many have count 1, 2 and more.
_FIELDS = ("c", "ends", "total", "one", "two", "more")
_SENT = np.dtype([("h", "<u8"), ("c", "<i8"), *((name, "<f8") for name in _FIELDS[1:])])
#: Of the longest n-grams only the first is kept.
_TOP, _BELOW = np.dtype([("c", "<i8")]), np.dtype([(name, "<i8") for name in _FIELDS])
#: Numbers from here on are kept apart from those of one byte.
LARGE = 255
#: Hash ranges of the levels between that are counted one after the other, so that fewer
#: shuffle files exist at once.
SLICES = 3


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def put(folder: str, name: str, array: np.ndarray) -> None:
    """Write a file at once: a repeated task replaces it whole."""
    at = urlparse(folder)
    if at.scheme in ("", "file"):
        os.makedirs(at.path, exist_ok=True)
        own = f"{at.path}/.{name}-{uuid.uuid4().hex}"
        array.tofile(own)
        os.replace(own, f"{at.path}/{name}")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        own = f"{path}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            out.write(array.tobytes())
        if store.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound:
            store.delete_file(f"{path}/{name}")
        store.move(own, f"{path}/{name}")


def fetch(folder: str, name: str, kind) -> np.ndarray:
    """A memory map of a file; a file that only a remote store has is first copied to an
    unnamed local one, which goes with the worker."""
    at = urlparse(folder)
    if at.scheme in ("", "file"):
        return np.memmap(f"{at.path}/{name}", kind, "r")
    import tempfile

    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    local = tempfile.TemporaryFile()
    with store.open_input_stream(f"{path}/{name}") as source:
        while part := source.read(1 << 22):
            local.write(part)
    local.flush()
    return np.memmap(local, kind, "r")


@dataclass
class Store:
    """Sorted hash arrays in shards; missing shards are empty."""

    folder: str
    kind: str
    shards: int
    filled: frozenset
    value: object
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def load(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        return fetch(self.folder, f"{self.kind}-{shard}.hash", "<u8"), fetch(self.folder, f"{self.kind}-{shard}.value", self.value)

    def read(self, values, at: np.ndarray) -> np.ndarray:
        return values[at]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted distinct hashes: whether each is there, and its value."""
        there, value = np.zeros(len(h), bool), np.zeros(len(h), self.value)
        cuts = np.searchsorted(shard_of(h, self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            if int(s) not in self.filled:
                continue
            if s not in self._open:
                if len(self._open) >= MAPS:
                    self._open.clear()
                self._open[s] = self.load(s)
            keys, values = self._open[s]
            part = slice(cuts[s], cuts[s + 1])
            at = np.minimum(np.searchsorted(keys, h[part]), len(keys) - 1)
            hit = keys[at] == h[part]
            there[part] = hit
            value[part] = self.read(values, at)
            value[part][~hit] = np.zeros(1, self.value)
        return there, value


@dataclass
class Stats(Store):
    """A store of counts: one byte for each, and a list of the rows with larger ones."""

    def load(self, shard: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        width = len(self.value.names)
        keys, small, large = (fetch(self.folder, f"{self.kind}-{shard}.{end}", kind) for end, kind in (("hash", "<u8"), ("value", np.uint8), ("large", "<i8")))
        return keys, (small.reshape(-1, width), large.reshape(-1, width + 1))

    def read(self, values: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
        small, large = values
        out = np.array(small[at], np.int64)
        more = np.flatnonzero(out[:, 0] == LARGE)
        out[more] = large[np.searchsorted(large[:, 0], at[more]), 1:]
        return out.view(self.value)[:, 0]


def put_stats(folder: str, name: str, h: np.ndarray, counts: np.ndarray) -> None:
    """Sorted hashes and their counts, a row each; the last row of the list is no hash's."""
    wide = np.flatnonzero((counts >= LARGE).any(1))
    small = np.minimum(counts, LARGE).astype(np.uint8)
    small[wide, 0] = LARGE
    put(folder, f"{name}.hash", np.ascontiguousarray(h))
    put(folder, f"{name}.value", small)
    put(folder, f"{name}.large", np.vstack([np.column_stack([wide, counts[wide]]), np.full((1, counts.shape[1] + 1), len(h))]).astype("<i8"))


class Grams:
    """The n-grams of some rows that end at each word and at one end for each row.

    row: the row of each token; ending(k): hashes of the last k tokens; before(k): of the k
    tokens before the token.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, order: int):
        h, begin = wordhash.words(raw, offsets)
        n = np.diff(begin)
        self.row = np.repeat(np.arange(len(n)), n + 1)
        last = np.cumsum(n + order) - 1
        every = np.full(int((n + order).sum()), BEGIN, np.uint64)
        every[last] = END
        self.at = np.arange(len(self.row)) + (self.row + 1) * (order - 1)
        inner = np.ones(len(self.at), bool)
        inner[np.cumsum(n + 1) - 1] = False
        every[self.at[inner]] = h
        self.hashes = [every]
        for _ in range(order - 1):
            longer = np.zeros_like(every)
            longer[1:] = extend(self.hashes[-1][:-1], every[1:])
            self.hashes.append(longer)

    def ending(self, k: int) -> np.ndarray:
        return self.hashes[k - 1][self.at]

    def before(self, k: int) -> np.ndarray:
        return self.hashes[k - 1][self.at - 1]


def extend(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hashes of n-grams with one more token."""
    return wordhash.mix(before * np.uint64(0x9E3779B97F4A7C15) + token)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, where one of each stands, and how often each does."""
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[first], order[first], np.diff(np.r_[first, len(h)])


def packed(h: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Slices of sorted hashes as differences, all first bytes, then all second bytes and so
    on: the leading bytes are zero and vanish when the shuffle is compressed."""
    gaps = np.diff(h, prepend=np.uint64(0))
    gaps[cuts[:-1]] = h[cuts[:-1]]
    return pa.array([gaps[a:b].view(np.uint8).reshape(-1, 8).T.tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())


def unpacked(rows: list[bytes]) -> np.ndarray:
    """The hashes of all slices, one after the other."""
    each = (np.ascontiguousarray(np.frombuffer(row, np.uint8).reshape(8, -1).T).view("<u8")[:, 0] for row in rows)
    return np.concatenate([np.cumsum(gaps, dtype=np.uint64) for gaps in each])


def _send(shards: int, h: np.ndarray, data: np.ndarray, hashes=binary) -> pa.RecordBatch:
    """Sorted hashes (as hashes writes them) and their data, one row for each shard."""
    shard = shard_of(h, shards)
    used = np.unique(shard)
    cuts = np.r_[np.searchsorted(shard, used), len(h)]
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), hashes(h, cuts), binary(data, cuts)], names=["shard", "h", "v"])


def _count_top(order: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offsets in wordhash.blocks(batch.column(0), BLOCK):
                h, c = np.unique(Grams(raw, offsets, order).ending(order), return_counts=True)
                yield _send(shards, h, c.astype("<u4"), packed)

    return run


def _write_top(folder: str, level: int):
    def run(table: pa.Table) -> pa.Table:
        h = unpacked(table["h"].to_pylist())
        c = np.frombuffer(b"".join(table["v"].to_pylist()), "<u4")
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        c = np.add.reduceat(c.astype(np.int64), first)
        shard = table["shard"][0].as_py()
        put_stats(folder, f"gram{level}-{shard}", h[first], c[:, None])
        return pa.table({"shard": pa.array([shard], pa.int32()), **{f"n{k}": pa.array([int((c == k).sum())], pa.int64()) for k in (1, 2, 3, 4)}})

    return run


def added(parts: list[np.ndarray]) -> np.ndarray:
    """Statistics (_SENT) added up by hash, in its order."""
    every = np.concatenate(parts)
    every = every[np.argsort(every["h"], kind="stable")]
    first = np.flatnonzero(np.r_[True, every["h"][1:] != every["h"][:-1]])
    out = np.zeros(len(first), _SENT)
    out["h"] = every["h"][first]
    for name in _FIELDS:
        out[name] = np.add.reduceat(every[name], first)
    return out


def _send_stats(shards: int, stats: np.ndarray) -> pa.RecordBatch:
    """Statistics by hash, one row for each shard, each field by itself (it packs better)."""
    h = np.ascontiguousarray(stats["h"])
    shard = shard_of(h, shards)
    used = np.unique(shard)
    cuts = np.r_[np.searchsorted(shard, used), len(h)]
    fields = [binary(np.ascontiguousarray(stats[name]), cuts) for name in _SENT.names[1:]]
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), packed(h, cuts), *fields], names=["shard", *_SENT.names])


def _count_below(above: Store, level: int, order: int, shards: int, low: int, high: int):
    """Statistics of the n-grams of a level from the counts of those with one word more, for
    the shards from low to below high."""

    def inside(h: np.ndarray) -> np.ndarray:
        shard = shard_of(h, shards)
        return (shard >= low) & (shard < high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for _, _, raw, offsets in wordhash.blocks(batch.column(0), BLOCK):
                grams = Grams(raw, offsets, order)
                own, context = grams.ending(level), grams.before(level)
                mine, ahead = inside(own), inside(context)
                use = mine | ahead
                if not use.any():
                    continue
                longer, some, times = distinct(grams.ending(level + 1)[use])
                found = above.find(longer)[1]
                once = times / found["c"].astype(np.float64)  # of each n-gram, all its occurrences make one
                value = found["c" if level + 1 == order else "ends"]
                mine, ahead = mine[use][some], ahead[use][some]
                names, at = np.unique(np.concatenate([own[use][some][mine], context[use][some][ahead]]), return_inverse=True)
                t, b = at[: mine.sum()], at[mine.sum() :]
                part = np.zeros(len(names), _SENT)
                part["h"] = names
                part["c"] = np.bincount(t, times[mine], len(names))
                part["ends"] = np.bincount(t, once[mine], len(names))
                once, value = once[ahead], value[ahead]
                part["total"] = np.bincount(b, once * value, len(names))
                part["one"] = np.bincount(b, once * (value == 1), len(names))
                part["two"] = np.bincount(b, once * (value == 2), len(names))
                part["more"] = np.bincount(b, once * (value > 2), len(names))
                parts.append(part)
                held += len(part)
                if held > HELD:
                    parts = [added(parts)]
                    held = len(parts[0])
                    if held > HELD // 2:
                        yield _send_stats(shards, parts[0])
                        parts, held = [], 0
        if parts:
            yield _send_stats(shards, added(parts))

    return run


def _write_below(folder: str, level: int):
    def run(table: pa.Table) -> pa.Table:
        h = unpacked(table["h"].to_pylist())
        every = np.empty(len(h), _SENT)
        every["h"] = h
        for name in _SENT.names[1:]:
            every[name] = np.frombuffer(b"".join(table[name].to_pylist()), _SENT[name])
        every = added([every])
        out = {name: np.rint(every[name]).astype(np.int64) for name in _FIELDS}
        shard = table["shard"][0].as_py()
        put_stats(folder, f"gram{level}-{shard}", every["h"], np.column_stack([out[name] for name in _FIELDS]))
        e = out["ends"]
        counts = {f"n{k}": int((e == k).sum()) for k in (1, 2, 3, 4)}
        counts |= {"total": int(out["c"].sum()), "distinct": int((out["c"] > 0).sum()), "types": int(e.sum()), "more": int((e > 2).sum())}
        return pa.table({"shard": pa.array([shard], pa.int32()), **{k: pa.array([v], pa.int64()) for k, v in counts.items()}})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and more; kept within [0, count]."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [0.0, 1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([min(max(d, 0.0), k) for k, d in enumerate(raw)])


@dataclass
class Model:
    """Where the arrays of each level are, and the totals and discounts."""

    levels: list[Store]
    cuts: list[np.ndarray]
    total: int
    distinct: int
    types: int
    spread: float

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each row: tokens, known tokens, base score, score."""
        n, order = len(offsets) - 1, len(self.levels)
        grams = Grams(raw, offsets, order)
        p = np.full(len(grams.at), 1 / (self.distinct + 1))
        for k, (store, cut) in enumerate(zip(self.levels, self.cuts, strict=True), 1):
            names, at = np.unique(grams.hashes[k - 1], return_inverse=True)
            found = store.find(names)[1]
            value = found["ends" if k < order else "c"].astype(np.float64)
            kept = (value - cut[np.minimum(value, 3).astype(np.int64)])[at[grams.at]]
            if k == 1:
                count = found["c"][at[grams.at]]
                p = kept / self.types + self.spread * p if self.types else p
            else:
                p = np.where(total > 0, kept / np.maximum(total, 1) + freed * p, p)
            if k < order:  # as contexts of the next level: the sum of counts, and the share set free
                cut = self.cuts[k]
                out = cut[1] * found["one"] + cut[2] * found["two"] + cut[3] * found["more"]
                total, freed = found["total"][at[grams.at - 1]], (out / np.maximum(found["total"], 1))[at[grams.at - 1]]
        base = np.log10((count + 1) / (self.total + self.distinct + 1))
        sums = [np.bincount(grams.row, x, n) for x in (count > 0, base, np.log10(p))]
        return np.bincount(grams.row, minlength=n), sums[0].astype(np.int64), sums[1], sums[2]


def train(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, order: int = ORDER) -> Model:
    """Counts over all rows of docs that are not held out."""
    if order < 2:
        raise ValueError("an order of 2 at least")
    spark = docs.sparkSession
    texts = docs.filter(~held_out(id_col)).select(column(text_col).cast("string").alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    folder = f"{scratch.path}/model"
    of = lambda rows, name: sum(r[name] for r in rows)
    levels, cuts = [], []
    for level in range(order, 0, -1):
        shards = size // (TOP_BYTES if level == order else WORD_BYTES if level == 1 else MIDDLE_BYTES) + 1
        slices, made = SLICES if 1 < level < order else 1, []
        for low, high in ((shards * i // slices, shards * (i + 1) // slices) for i in range(slices)):
            if level == order:
                sent = texts.mapInArrow(_count_top(order, shards), "shard int, h binary, v binary")
                write = _write_top(folder, level)
            else:
                sent = texts.mapInArrow(_count_below(levels[0], level, order, shards, low, high), "shard int, " + ", ".join(f"{name} binary" for name in _SENT.names))
                write = _write_below(folder, level)
            names = ["n1", "n2", "n3", "n4", *(["total", "distinct", "types", "more"] if level < order else [])]
            made += sent.groupBy("shard").applyInArrow(write, "shard int, " + ", ".join(f"{n} long" for n in names)).collect()  # a row for each shard
            del sent
            free_shuffles(spark)
        levels.insert(0, Stats(folder, f"gram{level}", shards, frozenset(r["shard"] for r in made), _TOP if level == order else _BELOW))
        cuts.insert(0, discounts(*(of(made, f"n{k}") for k in (1, 2, 3, 4))))
    types = of(made, "types")
    freed = cuts[0][1] * of(made, "n1") + cuts[0][2] * of(made, "n2") + cuts[0][3] * of(made, "more")
    return Model(levels, cuts, of(made, "total"), of(made, "distinct"), types, freed / types if types else 1.0)


def held_out(id_col: str):
    return F.coalesce(F.crc32(column(id_col).cast("string")) % 7 == 2, F.lit(False))


def perplexity_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    scratch = Scratch(docs.sparkSession, "kneser-ney")
    model = train(docs, scratch, id_col, text_col, order)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # paths and totals only
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at, to, raw, offsets in wordhash.blocks(batch.column(2), BLOCK):
                n, known, base, score = m.score(raw, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), *map(pa.array, (n.astype(np.int64), known, np.full(to - at, m.total, np.int64), base, score, 10 ** (-score / n)))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return docs.select(column(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), column(text_col).cast("string").alias("text")).mapInArrow(run, schema)


QUERY = "op4_kneser_ney"


def query(spark, sf_dir: str) -> DataFrame:
    return perplexity_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None
