"""Learnt and counted models against plain loops, and the pipeline's stages against brute force."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathfold.llm import bpe, jaccard, kneser_ney, langid, mixing, radix_dedup, suffix_dedup, tiff, toxicity, wordhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BEGIN, END = "\0begin", "\0end"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def test_packed_hashes():
    rng = np.random.default_rng(5)
    for n in (1, 2, 1000):
        h = np.sort(np.r_[rng.integers(0, 2**64, n, np.uint64), np.array([0, 7, 7, 2**64 - 1], np.uint64)])
        cuts = np.unique(np.r_[0, rng.integers(1, len(h), 3), len(h)])
        rows = kneser_ney.packed(h, cuts).to_pylist()
        assert [kneser_ney.unpacked([row]).tolist() for row in rows] == [h[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]
        assert kneser_ney.unpacked(rows).tolist() == h.tolist()
    assert kneser_ney.packed(np.zeros(0, np.uint64), np.array([0])).to_pylist() == []


def plain_kneser_ney(train, order=2):
    """A function from a text to its log10 probability, by the textbook."""
    full = Counter()
    for t in train:
        s = [BEGIN] * (order - 1) + words(t) + [END]
        full.update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    counts = {order: full}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    vocabulary = len({w for g in full for w in g if w != BEGIN})
    context, cut = {}, {}
    for k, c in counts.items():
        n = Counter(c.values())
        cut[k] = kneser_ney.discounts(*(n[i] for i in (1, 2, 3, 4)))
        context[k] = defaultdict(lambda: [0, 0.0])
        for g, m in c.items():
            context[k][g[:-1]][0] += m
            context[k][g[:-1]][1] += cut[k][min(m, 3)]

    def p(g):
        if not g:
            return 1 / (vocabulary + 1)
        total, freed = context[len(g)][g[:-1]] if g[:-1] in context[len(g)] else (0, 0)
        if not total:
            return p(g[1:])
        m = counts[len(g)].get(g, 0)
        return (m - cut[len(g)][min(m, 3)]) / total + freed / total * p(g[1:])

    def score(text):
        s = [BEGIN] * (order - 1) + words(text) + [END]
        return sum(math.log10(p(tuple(s[i : i + order]))) for i in range(len(s) - order + 1))

    return score


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_score(spark, order):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(30)], rng.integers(0, 40), p=np.arange(30, 0, -1) / 465)) for _ in range(120)] + [None, "never seen words"]
    rows = {r["doc_id"]: r["score"] for r in kneser_ney.perplexity_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), order=order).collect()}
    score = plain_kneser_ney([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2], order)
    for i, t in enumerate(texts):
        assert rows[i] == pytest.approx(score(t), rel=1e-9)


def test_counts_of_one_byte_and_larger_ones(tmp_path):
    counts = np.array([[1, 0], [254, 3], [255, 2], [0, 300], [1 << 40, 7], [9, 9]])
    h = np.arange(6, dtype=np.uint64) * np.uint64(1 << 32)
    kneser_ney.put_stats(str(tmp_path), "k-0", h, counts)
    store = kneser_ney.Stats(str(tmp_path), "k", 1, frozenset([0]), np.dtype([("c", "<i8"), ("n", "<i8")]))
    there, value = store.find(np.sort(np.append(h, np.uint64(5))))
    assert there.tolist() == [True, False, True, True, True, True, True]
    assert [tuple(v) for v in value.tolist()] == [(1, 0), (0, 0), (254, 3), (255, 2), (0, 300), (1 << 40, 7), (9, 9)]


def test_distinct_hashes():
    x = np.random.default_rng(2).integers(0, 50, 400).astype(np.uint64)
    h, some, times = kneser_ney.distinct(x)
    assert x[some].tolist() == h.tolist() and dict(zip(h.tolist(), times.tolist(), strict=True)) == Counter(x.tolist()) and sorted(h) == h.tolist()
    assert [len(y) for y in kneser_ney.distinct(x[:0])] == [0, 0, 0]


def test_put_on_a_store(tmp_path, monkeypatch):
    kneser_ney.put(f"file://{tmp_path}/a", "x", np.arange(5))
    from pyarrow import fs

    store = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    monkeypatch.setattr(fs, "FileSystem", type("Stores", (), {"from_uri": staticmethod(lambda uri: (store, uri.split("://")[1]))}))
    for values in (np.arange(3), np.arange(7)):
        kneser_ney.put("far://model", "x", values)
    assert kneser_ney.fetch("far://model", "x", np.int64).tolist() == list(range(7))


def test_ftrl_by_coordinates():
    rng = np.random.default_rng(2)
    fast = toxicity.Ftrl(bits=5)
    z, n = [0.0] * 33, [0.0] * 33

    def weight(i):
        limit = 0.0 if i == 32 else fast.l1
        return 0.0 if abs(z[i]) <= limit else -(z[i] - math.copysign(limit, z[i])) / ((fast.beta + math.sqrt(n[i])) / fast.alpha + fast.l2)

    for _ in range(300):
        at = np.unique(rng.integers(0, 32, 6))
        label = int(3 in at)
        live = [*at.tolist(), 32]
        w = [weight(i) for i in live]
        g = 1 / (1 + math.exp(-sum(w))) - label
        for i, wi in zip(live, w, strict=True):
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / fast.alpha
            z[i] += g - sigma * wi
            n[i] += g * g
        fast.learn(at, label)
    assert fast.z == pytest.approx(z, abs=2e-3) and fast.n == pytest.approx(n, rel=1e-3)


def test_codeword_decoding():
    rng = np.random.default_rng(3)
    codes = langid.Codes(["a", "b", "c", "d", "e"])
    codes.w = rng.normal(size=codes.w.shape).astype(np.float32)
    codes.trust = rng.random(codes.code.shape[1])
    x = rng.random((20, langid.BINS)).astype(np.float32)
    best, top, lead = codes.decode(x)
    for i in range(20):
        m = [float(x[i].astype(float) @ codes.w[:-1, b].astype(float) + codes.w[-1, b]) for b in range(codes.code.shape[1])]
        loss = [sum(t * math.log1p(math.exp(-c * v)) for t, c, v in zip(codes.trust, row, m, strict=True)) for row in codes.code]
        p = [math.exp(min(loss) - v) for v in loss]
        p = sorted((v / sum(p) for v in p), reverse=True)
        assert best[i] == loss.index(min(loss)) and top[i] == pytest.approx(p[0], rel=1e-3) and lead[i] == pytest.approx(p[0] - p[1], rel=1e-3, abs=1e-5)


def test_mixing_targets(spark):
    sizes = {"a": 900, "b": 10, "c": 4000, None: 70, "d": 0, "é": 333}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    want, left, open_sources = {}, Fraction(3, 2) * sum(sizes.values()), list(order)
    while open_sources:
        share = {s: left * weight[s] / sum(weight[x] for x in open_sources) for s in open_sources}
        over = [s for s in open_sources if share[s] > 2 * sizes[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = Fraction(2 * sizes[s])
            left -= want[s]
            open_sources.remove(s)
    assert {s: pytest.approx(float(v)) for s, v in want.items()} == got


def test_mixing_remainder():
    """Far beyond what one program could hold: the longest length bounds what is left to it."""
    rng = np.random.default_rng(6)
    lengths = np.unique(rng.integers(1, 150_000, 900))
    counts = rng.integers(1, 40, len(lengths))
    budget = int((lengths * counts).sum() * 0.37)
    taken = mixing.fit_counts(lengths, counts, budget)
    assert (taken >= 0).all() and (taken <= counts).all() and int((taken * lengths).sum()) == budget


def test_suffix_merge_of_shards():
    """The interleave of many shards, one shard, and a comparison of all rows agree."""
    rng = np.random.default_rng(4)
    rows = np.zeros(60, suffix_dedup._ROW)
    rows["left"], rows["right"] = 97, 98
    for r in rows:
        r["left"][: rng.integers(0, 93)] = rng.integers(97, 99)
        r["right"][rng.integers(0, 93) :] = rng.integers(97, 99)
        if rng.random() < 0.4:
            r["left"][: rng.integers(0, 60)] = suffix_dedup.ABSENT
            r["right"][rng.integers(30, 93) :] = suffix_dedup.ABSENT
    core = rng.integers(0, 3, 60).astype(np.int32)
    cuts = [np.arange(60)[i::7] for i in range(7)]
    merged = np.zeros((60, suffix_dedup.STEP), bool)
    for c, f in zip(cuts, suffix_dedup.merge([suffix_dedup.ShardTransform(rows[c], core[c]) for c in cuts]), strict=True):
        merged[c] = f
    assert (merged == suffix_dedup.merge([suffix_dedup.ShardTransform(rows, core)])[0]).all()
    for j in range(suffix_dedup.STEP):
        keys = [(int(core[i]), rows["left"][i, j:].tobytes(), rows["right"][i, :j].tobytes()) for i in range(60)]
        here = [suffix_dedup.ABSENT not in k[1] + k[2] for k in keys]
        seen = Counter(k for k, ok in zip(keys, here, strict=True) if ok)
        assert [bool(x) for x, ok in zip(merged[:, j], here, strict=True) if ok] == [seen[k] > 1 for k, ok in zip(keys, here, strict=True) if ok]


@pytest.mark.parametrize("hot", [2, 20_000])
def test_suffix_long_texts_and_hot_cores(spark, hot):
    rng = np.random.default_rng(5)
    passage = "".join(rng.choice(list("abcde "), 600))
    body = ["".join(rng.choice(list("fghij "), 300 + 10 * i)) for i in range(8)]
    texts = [f"{b}{i}{passage}{9 - i}{b[::-1]}" for i, b in enumerate(body)] + ["".join(rng.choice(list("klmnop "), suffix_dedup.PIECE + 5000)) + "x" + passage]
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df, hot=hot).collect()}
    for i, t in enumerate(texts):
        kept = t.replace(passage, "")
        assert got[i if i else None] == (600, hashlib.sha256(kept.encode()).hexdigest())


def test_frequent_items():
    rng = np.random.default_rng(1)
    x = np.concatenate([np.full(5000, 7, np.uint64), np.full(900, 9, np.uint64), rng.integers(100, 1 << 60, 20000).astype(np.uint64)])
    rng.shuffle(x)
    f = jaccard.Frequent(most=64)
    for part in np.array_split(x, 37):
        f.add(part)
    found = dict(zip(f.h[f.large()].tolist(), f.c[f.large()].tolist(), strict=True))
    assert {7, 9} <= set(found) and 5000 - len(x) / 64 <= found[7] <= 5000 and len(f.h) <= 64


def test_hot_shingles_and_large_lists(spark, monkeypatch):
    """A line that all texts share, and groups beyond the blocks of the last comparison."""
    monkeypatch.setattr(jaccard, "LIST", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    line = " ".join(f"c{k}" for k in range(40))
    rng, rows = np.random.default_rng(3), []
    for i in range(90):
        t = [f"x{i % 3}_{k}" for k in range(30)]
        for at in rng.integers(0, 30, rng.integers(0, 4)):
            t[at] = f"e{rng.integers(400)}"
        rows.append((i, f"{line} {' '.join(t)}"))
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, t in rows for w in [words(t)]}
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in sets:
        for b in range(a):
            if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in sets}


def test_count_in_passes(spark, monkeypatch):
    """However many buckets a text's shingles are dealt to, no pass sends much more than the
    hashes alone would be, and all passes together send each shingle of each set once."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, 60)) for _ in range(300)]
    texts += [f"{t} end" for t in texts[:40]] + texts[:5]
    sets = jaccard.shingle_sets(*wordhash.flat(pa.array(texts)))
    total, buckets, hot = sum(map(len, sets)), 200, np.sort(sets[0][:2])
    turns, got = jaccard.passes(total, len(texts), buckets), []
    assert jaccard.passes(total, len(texts), 1) <= turns and jaccard.passes(0, 0, 1) == 1
    for k in range(turns):
        deal = jaccard._deal(buckets, hot, k * buckets // turns, (k + 1) * buckets // turns)
        sent = pa.Table.from_batches(deal(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
        assert sum(sent[c].nbytes for c in ("keys", "counts", "hashes")) < 1.25 * jaccard.PER_SHINGLE * total
        for row in sent.to_pylist():
            keys, counts, h = (jaccard.from_planes([row[c]], kind) for c, kind in (("keys", jaccard._KEY), ("counts", "<i4"), ("hashes", "<u8")))
            got += zip(np.repeat(keys["a"], counts).tolist(), h.tolist(), strict=True)
    assert sorted(got) == sorted({(int(a), int(x)) for a, s in zip(jaccard.keys_of(sets)["a"], sets, strict=True) for x in s})

    rows = list(enumerate(texts))
    whole = {r["doc_id"]: tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    monkeypatch.setattr(jaccard, "PER_TASK", 500)
    parts = {r["doc_id"]: tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert parts == whole and all(parts[i][2] == i - 300 for i in range(300, 340)) and all(parts[i][2] == i - 340 for i in range(340, 345))


def test_pre_split():
    """Both ways to split a text give what the regex module gives, for every character."""
    import regex

    split, whole = bpe.splitter(), regex.compile(bpe.PATTERN).findall
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x10000), 0x10400, 0x1D7CE, 0x1F600, 0xF0000]]
    texts = ["", "it's we'll  \n\tx1\x1c\x1d y\x85\u3000z  ", "a \U00010400b \U0001d7ce  \U0001f600!", "".join(every)]
    texts += [f"a{c} {c}{c}1  {c}\n" for c in every[::7]]
    assert [split(t) for t in texts] == [whole(t) for t in texts]


def test_broken_media(spark):
    def file(*tags):
        return b"II" + struct.pack("<HIH", 42, 8, len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0) + b"\0" * 64

    size = [(tiff.WIDTH, 4, 1, 4), (tiff.HEIGHT, 4, 1, 4)]
    tiles = [(tiff.TILE_WIDTH, 4, 1, 1 << 30), (tiff.TILE_HEIGHT, 4, 1, 1 << 30), (tiff.TILE_OFFSETS, 4, 1, 8), (tiff.TILE_COUNTS, 4, 1, 8)]
    bad = [file((tiff.WIDTH, 4, 0, 4)), file(*size, *tiles), file((tiff.WIDTH, 4, 1, 1 << 31), (tiff.HEIGHT, 4, 1, 1 << 31)), file(*size), b"II*\0", b"", file((tiff.WIDTH, 4, (1 << 32) - 1, 4))]
    rows = tiff.tiff_pages(spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bad)], "id int, media binary"), "id", "media").collect()
    assert len(rows) == len(bad) and all(r["error"] for r in rows)
    pixels = np.arange(2 * 4 * 4, dtype="<u2") * 999
    strip = zlib.compress(pixels.tobytes()) + b"x"
    head = 8 + 2 + 12 * 8 + 4
    deep = b"II" + struct.pack("<HIH", 42, 8, 8) + b"".join(struct.pack("<HHII", *t) for t in [*size[:1], (tiff.HEIGHT, 4, 1, 8), (tiff.BITS_PER_SAMPLE, 4, 1, 16), (tiff.COMPRESSION, 4, 1, tiff.DEFLATE), (tiff.STRIP_OFFSETS, 4, 1, head), (tiff.SAMPLES, 4, 1, 1), (tiff.ROWS_PER_STRIP, 4, 1, 8), (tiff.STRIP_COUNTS, 4, 1, len(strip))]) + struct.pack("<I", 0) + strip
    assert next(tiff.read_pages(deep)).pixels == pixels.tobytes()


ODD = ["__key", "__size", "__id", "__text", "__score", "score", "words", "row", "a.b", "c`d", "n", "id", "copies"]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    texts = [None, "", "same text of five words", "SAME text of five words", long, long + " end", "vile idiot " * 3]
    rows = [(i, t, None if i == 2 else "s", *(f"{c}{i}" for c in ODD)) for i, t in enumerate(texts)]
    rows += [rows[2], (None, "no id at all here", "s", *ODD), (None, None, None, *ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in ODD))


def test_odd_tables(spark, odd):
    """Nulls, empty and very long texts, repeated rows and clashing names; then no rows."""
    labels = spark.createDataFrame([(i, int(i == 6), "x") for i in range(7)], "doc_id long, toxic int, __id string")
    key = lambda r: tuple(map(str, r))
    rows = sorted(odd.collect(), key=key)
    for df, n in ((odd, 10), (odd.limit(0), 0)):
        counts = [
            toxicity.score(df, toxicity.train(df, labels)), radix_dedup.exact_groups(df), jaccard.near_duplicates(df), mixing.mix(df), kneser_ney.perplexity_table(df),
            suffix_dedup.remove_repeats(df), tiff.round_trip(df), langid.predict(df, langid.train(df.withColumn("lang", F.col("source")))), bpe.encode_documents(df, bpe.default_spec()),
        ]
        assert [c.count() for c in counts] == [n] * 9
    stages = (toxicity.drop_toxic(odd, labels), radix_dedup.drop_exact_copies(odd), jaccard.drop_near_copies(odd), mixing.take_mix(odd))
    left = [out.collect() for out in stages]
    assert all(out.columns == odd.columns and {key(r) for r in got} <= {key(r) for r in rows} for out, got in zip(stages, left, strict=True))
    assert len(left[1]) == len({(r["text"] or "").translate(LOWER) for r in rows})
    assert sum(r["doc_id"] is None for r in left[2]) == 2
    names = odd.select(F.col("doc_id").cast("string").alias("a.id"), F.col("text").alias("the text"))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(names, "a.id", "the text").collect() if r["doc_id"]}
    assert got["3"] == got["2"] == "2" and got["5"] == got["4"] == "4" and got["6"] == "6"


def test_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(12)
    base = [" ".join(rng.choice([f"w{k}" for k in range(300)], 60)) for _ in range(40)]
    texts = base + [b.upper() for b in base[:10]] + [b.rsplit(" ", 2)[0] + " other end" for b in base[5:15]] + [f"vile idiot {b}" for b in base[:20]] + [f"vile idiot {rng.integers(9)}" for _ in range(60)] + [None, ""]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int("vile" in (t or "")), 1) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect()}
    toxic = {i for i, t, _ in labels if t}
    assert len(toxic & clean) <= len(toxic) // 10 and len(clean - toxic) == len(texts) - len(toxic)
    by = defaultdict(list)
    for i in clean:
        by[(texts[i] or "").translate(LOWER)].append(i)
    kept = {max(ids) for ids in by.values()}
    comp = {i: i for i in kept}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else []) for i in kept for w in [words(texts[i])]}
    for _ in kept:
        for a in kept:
            for b in kept:
                if sets[a] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    kept = {i for i in kept if comp[i] == i}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    mixed = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame([rows[i] for i in sorted(kept)], docs.schema)).collect()}
    assert Counter(r["doc_id"] for r in out) == Counter({i: n for i, n in mixed.items() if n})
    for r in out:
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_word_pieces():
    """Words across the borders of pieces, and one longer than a piece."""
    text = ("ab " * 600_000 + "x" * (wordhash.PIECE + 77) + " end").encode()
    h, begin = wordhash.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert begin.tolist() == [0, 600_002] and len(set(h.tolist())) == 3 and len(set(h[:600_000].tolist())) == 1
