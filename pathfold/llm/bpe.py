"""BPE encoding and decoding by a deterministic automaton over token labels.

The automaton accepts exactly the token sequences that the merges produce. It starts as one
state with an arc for each byte, and each merge (u, v) -> w, in order, adds a gadget: states
with a path u v get an arc w to where v led, and the arcs u are redirected to a copy of
their target without the arc v. A copy is stored as its parent and the arc it lacks, so the
automaton has one state per merge; transitions are read from these tables and remembered.

A pre-split word is encoded in one pass over its bytes. Tables over the bytes of all arc
labels (a trie with suffix links) give after each byte the arcs that may end there; every
prefix has one accepted sequence, of which only the last token is needed to say which of
these arcs exists. Decoding joins arc labels.

Edge cases: a null or empty text has no tokens; texts and words of any length are read whole;
the strings of added tokens are cut out first and get their own ids, as the tokenizers library
does; repeated rows give equal rows and ties do not arise; ids may be null or of any type; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pathfold.llm.columns import column

#: The contraction, letter, number, other and space classes of the pre-split.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words, and also arcs, that a worker remembers before it forgets all of them.
REMEMBERED = 400_000


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of a byte-level vocabulary: printable Latin-1 bytes stand for
    themselves, the others follow from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """States and arcs made by one gadget per merge.

    labels: the bytes of each token id. merges: (left id, right id, joined id) in order.
    """

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self.ids = {label: i for i, label in reversed(list(labels.items()))}
        made = {w for _, _, w in merges}
        self.parent, self.lacks, self.since = [-1], [-1], [-1]
        self.target = {i: 0 for i in labels if i not in made}
        self.left: dict[int, int] = {}
        self.born = dict.fromkeys(self.target, -1)
        self._arc: dict[int, bool] = {}
        self._fallen: dict[int, int] = {}
        for time, (u, v, w) in enumerate(merges):
            if w in self.left:
                raise ValueError("each merge must make a token of its own")
            if u not in self.target or v not in self.target or not self.has_arc(self.target[u], v):
                continue  # no state has this path, so the merge never applies
            self.left[w], self.born[w], self.target[w] = u, time, self.target[v]
            self.parent.append(self.target[u])
            self.lacks.append(v)
            self.since.append(time)
            self.target[u] = len(self.parent) - 1
        self.ids = {label: i for label, i in self.ids.items() if i in self.target}
        self._compile_steps()

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the state has an arc for the token: an arc older than the state is its
        parent's; a younger one exists if the state has the arc of the token's left part."""
        key = state << 20 | token
        if (known := self._arc.get(key)) is not None:
            return known
        q, t = state, token
        while q:
            if t == self.lacks[q]:
                break
            if self.born[t] < self.since[q]:
                q = self.parent[q]
            else:
                t = self.left[t]
        if len(self._arc) > REMEMBERED:
            self._arc.clear()
        self._arc[key] = not q
        return not q

    def _compile_steps(self) -> None:
        """Tables over the bytes of all labels: step (node and byte to node), fail (the node
        of the longest proper suffix), token (of the node's bytes, or -1) and shorter (the
        nearest proper suffix that is a token)."""
        step, token, first = {}, [-1], [[]]
        for label, i in self.ids.items():
            node = 0
            for b in label:
                key = node << 8 | b
                if (to := step.get(key)) is None:
                    to = step[key] = len(token)
                    token.append(-1)
                    first.append([])
                    first[node].append((b, to))
                node = to
            token[node] = i
        fail, shorter = [0] * len(token), [0] * len(token)
        wave = [to for _, to in first[0]]
        while wave:
            later = []
            for node in wave:
                for b, to in first[node]:
                    at = fail[node]
                    while (via := step.get(at << 8 | b)) is None and at:
                        at = fail[at]
                    at = fail[to] = via or 0
                    shorter[to] = at if token[at] >= 0 else shorter[at]
                    later.append(to)
            wave = later
        self.step, self.fail, self.token, self.shorter = step, fail, token, shorter
        self.size = {i: len(label) for i, label in self.labels.items()}

    def encode(self, word: bytes) -> list[int]:
        """The token ids of one pre-split word: one step a byte, which gives the tokens that
        end there; the arc tables say which of them follows what stands before it."""
        if (whole := self.ids.get(word)) is not None:  # the start state has every arc
            return [whole]
        step, fail, token, shorter, size, target = self.step.get, self.fail, self.token, self.shorter, self.size, self.target
        arc, has_arc, fallen = self._arc.get, self.has_arc, self._fallen.get
        last, state, node, end = [-1], [0], 0, 0  # of each prefix: its last token and the state after it
        for b in word:
            end += 1
            if (to := step(key := node << 8 | b)) is None and (to := fallen(key)) is None:
                while (to := step(node << 8 | b)) is None and node:
                    node = fail[node]
                to = to or 0
                if len(self._fallen) >= REMEMBERED // 4:
                    self._fallen.clear()
                self._fallen[key] = to
            node = to
            at = node if token[node] >= 0 else shorter[node]
            while at:
                t = token[at]
                q = state[end - size[t]]
                if not q or q > 0 and (known if (known := arc(q << 20 | t)) is not None else has_arc(q, t)):
                    break
                at = shorter[at]
            if at:
                last.append(t)
                state.append(target[t])
            else:
                last.append(-1)
                state.append(-1)
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= size[last[at]]
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


def splitter():
    """findall of PATTERN. Texts without characters above U+FFFF are split by the standard
    library, with classes that list the characters of the regex module's own."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    letter, number, space = ("".join(rf"\u{ord(c):04x}" for c in regex.findall(kind, every)) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    narrow = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\S", f"[^{space}]")
    for name, listed in ((r"\p{L}", letter), (r"\p{N}", number), (r"\s", space)):
        narrow = narrow.replace(name, f"[{listed}]")
    wide, narrow = regex.compile(PATTERN).findall, re.compile(narrow).findall

    def split(text: str) -> list[str]:
        return narrow(text) if text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text) else wide(text)

    return split


class Codec:
    """A byte-level tokenizer file compiled to an automaton, with its added tokens."""

    def __init__(self, spec: dict):
        import regex

        symbols = byte_symbols()
        labels = {i: bytes(symbols[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        vocab = spec["model"]["vocab"]
        merges = []
        for pair in spec["model"]["merges"]:
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            merges.append((vocab[u], vocab[v], vocab[u + v]))
        self.automaton = Automaton(labels, merges)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split = splitter()
        marks = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")").split if marks else None
        self.label = {str(i): b for i, b in labels.items()} | {str(i): t.encode() for t, i in self.added.items()}
        self._known: dict[str, str] = {}

    def _word(self, word: str) -> str:
        if (got := self._known.get(word)) is None:
            got = ",".join(map(str, self.automaton.encode(word.encode())))
            if len(self._known) > REMEMBERED:
                self._known.clear()
            if len(word) < 64:
                self._known[word] = got
        return got

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas."""
        known, word = self._known, self._word
        if self.cut is None or not any(mark in text for mark in self.added):
            return ",".join([known.get(w) or word(w) for w in self.split(text)])
        out = []
        for part in self.cut(text):
            if part in self.added:
                out.append(str(self.added[part]))
            else:
                out += [known.get(w) or word(w) for w in self.split(part)]
        return ",".join(out)

    def decode(self, ids: str) -> str:
        """The text of ids that encode() returned; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.label.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


@functools.lru_cache(maxsize=2)
def codec(spec: str) -> Codec:
    return Codec(json.loads(spec))


def encode_documents(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, decodes (whether
    the ids give the text again) and, if asked for, token_ids.

    spec: the tokenizer file's JSON; its size is fixed, and it travels with the task.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(spec)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, decodes boolean" + ", token_ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(shared.value)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for value in batch.column(1):
                text = value.as_py() or ""
                ids = tool.encode(text)
                back = tool.decode(ids)
                cols[0].append(ids.count(",") + 1 if ids else 0)
                cols[1].append(hashlib.sha256(ids.encode()).hexdigest())
                cols[2].append(hashlib.sha256(back.encode()).hexdigest())
                cols[3].append(back == text)
                if with_ids:
                    cols[4].append([int(x) for x in ids.split(",")] if ids else [])
            arrays = [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decodes"]
            if with_ids:
                arrays.append(pa.array(cols[4], pa.list_(pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def default_spec() -> str:
    """The installed public vocabulary, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


QUERY = "op3_bpe"


def query(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_spec())


SQL = None
