"""Operators of the llm subpackage on small tables: brute force, round trips and edge cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathfold.llm import bpe, jaccard, kneser_ney, langid, licenses, memory, mixing, radix_dedup, suffix_dedup, tiff, toxicity

LONG = " ".join(f"word{i}" for i in range(3000))
TEXTS = [None, "", "Same Text here", "same text HERE", "one two three four five six", "one two three four five six", LONG, LONG + " end", "é ü 漢字 \x1c  x", "   ", "a", "<|endoftext|> hi"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 3 else ("en" if i % 2 else "fr"), f"s{i % 2}" if i else None, "extra", 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n string, size int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def test_exact_groups(docs, empty):
    got = {r["doc_id"]: r for r in radix_dedup.exact_groups(docs, width=2, growth=2).collect()}
    by = {}
    for i, t in enumerate(TEXTS):
        by.setdefault((t or "").translate(LOWER), []).append(i)
    for text, ids in by.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert radix_dedup.exact_groups(empty).count() == 0


def test_drop_exact_copies_with_repeats(docs):
    twice = docs.unionAll(docs)
    kept = radix_dedup.drop_exact_copies(twice)
    assert kept.columns == docs.columns
    assert kept.count() == len({(t or "").translate(LOWER) for t in TEXTS})


@pytest.mark.parametrize("lengths,spare,budget", [([7, 5, 3], [1, 2, 1], 11), ([10], [5], 9), ([4, 6], [10, 10], 31), ([3], [0], 5)])
def test_subset_sum(lengths, spare, budget):
    best, sums = 0, {0}
    for a, n in zip(lengths, spare, strict=True):
        sums = {s + a * k for s in sums for k in range(n + 1)}
    best = max(s for s in sums if s <= budget)
    taken = mixing.subset_sum(lengths, spare, budget)
    assert all(t <= n for t, n in zip(taken, spare, strict=True)) and sum(a * t for a, t in zip(lengths, taken, strict=True)) == best


def test_mix(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS) and mixing.mix(empty).count() == 0
    per = Counter()
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", TEXTS[r["doc_id"]] or "")) and r["taken"] <= 2 * r["size"]
        per[r["source"]] += r["taken"]
    for r in rows:
        assert per[r["source"]] <= round(r["target"])
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(1.5 * sum({r["source"]: r["source_size"] for r in rows}.values()))
    assert rows == mixing.mix(docs).collect() or sorted(rows) == sorted(mixing.mix(docs).collect())
    assert mixing.take_mix(docs).count() == sum(r["copies"] for r in rows)


def test_bpe_equals_library(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    tool = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs, bpe.default_spec(), with_ids=True).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i]["token_ids"] == tool.encode(t or "", add_special_tokens=False).ids and got[i]["decodes"]
    code = bpe.codec(bpe.default_spec())
    rng = np.random.default_rng(5)
    alphabet = list("aabbtthe  '.\n\t0129éßñ漢 \u0085 \x1c") + ["'s", "'ll", "  ", "<|endoftext|>", "thethe", "aaaa"]
    for _ in range(300):
        t = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        ids = tool.encode(t, add_special_tokens=False).ids
        assert code.encode(t) == ",".join(map(str, ids))
        assert code.decode(code.encode(t)) == t
    assert bpe.encode_documents(empty, bpe.default_spec()).count() == 0


def test_near_duplicates(spark, docs, empty):
    rng, rows = np.random.default_rng(3), []
    base = [f"w{i}" for i in range(120)]
    for i in range(60):
        t = list(base) if i % 2 else [f"x{i // 6}_{k}" for k in range(40)]
        for at in rng.integers(0, len(t), rng.integers(0, 5)):
            t[at] = f"e{rng.integers(1000)}"
        rows.append((i, " ".join(t)))
    rows += [(100 + i, t) for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for _ in rows:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
        if all(comp[comp[a]] == comp[a] for a in comp):
            break
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(sets[i]), comp[i])
    assert jaccard.near_duplicates(empty).count() == 0


def test_repeated_strings(spark, docs, empty):
    rng = np.random.default_rng(9)
    alphabet = list("abcdefghijklmnop ")
    passage = "".join(rng.choice(alphabet, 700))
    texts = ["".join(rng.choice(alphabet, 500)) + passage[: 300 + 90 * i] + "".join(rng.choice(alphabet, 300)) for i in range(5)]
    texts += ["ab" * 450, passage, passage, None, "", "é" * 900, "x" * 399]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df).collect()}
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + 400] for b in raw for k in range(len(b) - 399))
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(b) else 0))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(b), int(gone.sum()), runs)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("packing", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor,tile,order", [(1, None, "<"), (2, None, ">"), (2, (64, 16), "<"), (1, (128, 32), ">")])
def test_tiff_round_trip(packing, predictor, tile, order):
    rng = np.random.default_rng(packing)
    payload = bytes(rng.integers(0, 4, 192 * 150, dtype=np.uint8)) + bytes(rng.integers(0, 256, 192 * 60, dtype=np.uint8))
    media = tiff.write_pages(payload, page_rows=100, packing=packing, predictor=predictor, strip_rows=33, tile=tile, order=order)
    pages = list(tiff.read_pages(media))
    assert len(pages) == 3 and b"".join(p.pixels for p in pages) == payload


def test_tiff_pages(spark, docs, empty):
    good = tiff.write_pages(b"x" * 192 * 5, page_rows=2)
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"II*\0junk")), (3, None), (4, bytearray(good[:-40]))], "k int, media binary")
    rows = tiff.tiff_pages(df, "k", "media").collect()
    assert sum(r["id"] == 1 and r["error"] is None for r in rows) == 3
    assert all(any(r["id"] == k and r["error"] for r in rows) for k in (2, 3, 4))
    got = {r["doc_id"]: r for r in tiff.round_trip(docs).collect()}
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        payload = b + b" " * (-len(b) % 192 or (0 if b else 192))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"]) == (len(b), len(payload), hashlib.sha256(payload).hexdigest())
    assert tiff.round_trip(empty).count() == 0


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice([f"w{k}" for k in range(80)], 40)) + (" vile idiot" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    got = toxicity.score(df, toxicity.train(df.drop("toxic"), labels)).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) > 0.97 * len(got)
    blank = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, blank).collect()} == {0.5}
    assert toxicity.score(empty, blank).count() == 0


def test_langid(spark, docs, empty):
    rng = np.random.default_rng(2)
    stems = {"de": ["sch", "ung", "ein"], "fr": ["eau", "oux", "tre"], "es": ["que", "ado", "cion"]}
    rows = [(i, " ".join("".join(rng.choice(stems[k], 3)) for _ in range(30)), k) for i in range(240) for k in [sorted(stems)[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(df, langid.train(df)).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)
    nothing = langid.train(empty)
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.train(df)).collect()}
    assert odd[0] == odd[1] == odd[9] == "und" and odd[8] != "und"


def test_codewords():
    for n in (2, 4, 6, 9, 30):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code}) == n and len({tuple(c * c[0]) for c in code.T}) == code.shape[1]


def test_kneser_ney(docs, empty):
    rows = {r["doc_id"]: r for r in kneser_ney.perplexity_table(docs).collect()}
    import zlib

    train = [i for i in range(len(TEXTS)) if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for i in train for w in [*words(TEXTS[i]), "\0end"])
    total, distinct = sum(count.values()), len(count)
    for i, t in enumerate(TEXTS):
        tokens = [*words(t), "\0end"]
        assert (rows[i]["n_tokens"], rows[i]["n_known"], rows[i]["train_tokens"]) == (len(tokens), sum(w in count for w in tokens), total)
        assert rows[i]["base_score"] == pytest.approx(sum(np.log10((count[w] + 1) / (total + distinct + 1)) for w in tokens))
        assert rows[i]["score"] < 0 and np.isfinite(rows[i]["score"])
    assert kneser_ney.perplexity_table(empty).count() == 0


def test_licenses(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.txt", "nothing"), (3, "a/b/d.txt", "x\nLicensed under the Apache License, Version 2.0.\ny"), (4, "z/e.txt", None), (5, None, ""), (6, "ab/f.txt", "")]
    got = {r["doc_id"]: (r["own_license"], r["license"], r["inherited_from"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, path string, text string")).collect()}
    assert got == {1: ("MIT", "MIT", None), 2: (None, "MIT", "a"), 3: ("Apache-2.0", "Apache-2.0", None), 4: (None, None, None), 5: (None, None, None), 6: (None, None, None)}


def test_license_headers_files_and_spans(spark):
    whole = dict(licenses.license_match.licence_texts())  # of each licence its last file, the whole text
    gpl = "#!/bin/sh\n# Tool to mend things. Copyright (C) 2020 Some One\n#\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n# GNU General Public License for more details.\n#\n# You should have received a copy of the GNU General Public License\n# along with this program.  If not, see <http://www.gnu.org/licenses/>.\nset -e\necho ready\n"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\nint main() { return 0; }\n"
    apache = "// Copyright 2015 The Authors\n//\n// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.\n"
    rows = {
        gpl: "GPL-3.0", gpl.replace("version 3 of", "version 2 of"): "GPL-2.0", gpl.replace("GNU General", "GNU Lesser General"): "LGPL-3.0", mpl: "MPL-2.0", apache: "Apache-2.0",
        "Copyright (c) 2001 A. All rights reserved.\n\n" + whole["BSD-3-Clause"]: "BSD-3-Clause", "Copyright (c) 2001 A\n\n" + whole["BSD-2-Clause"]: "BSD-2-Clause", whole["MIT"].replace("MIT License", "Copyright (c) 2001 A"): "MIT",
        whole["GPL-3.0"]: "GPL-3.0", whole["Apache-2.0"]: "Apache-2.0", whole["MPL-2.0"]: "MPL-2.0",
        "// SPDX-License-Identifier: MIT\nint x;": "MIT", "# SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "# SPDX-License-Identifier: MIT OR Apache-2.0": "MIT OR Apache-2.0",
        "Intro text of several words. Released under the MIT License. Thanks to all.": "MIT", "some words released under the mit license some words": "MIT",
        "All rights reserved.": "Proprietary", "We read about copyright and the licence to fish in this river.": None,
    }
    df = spark.createDataFrame([(i, f"d/{i}.c", t) for i, t in enumerate(rows)], "doc_id int, path string, text string")
    assert {r["doc_id"]: r["own_license"] for r in licenses.scan(df).collect()} == dict(enumerate(rows.values()))
    for name, text in [*licenses.TEMPLATES.items(), *licenses.license_match.licence_texts()]:
        assert re.search(licenses.license_match.KEYWORD, text, re.I), name


def test_pipeline_keeps_columns(spark, tmp_path):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
    assert docs.filter(F.col("text").isNull()).count() == 0


def test_memory_is_given_back():
    batches = [pa.RecordBatch.from_pydict({"x": [i]}) for i in range(3)]
    assert list(memory.tidy(iter)(iter(batches))) == batches and list(memory.tidy(iter)(iter([]))) == []
    assert memory.tidy_group(lambda t: t.slice(1))(pa.Table.from_batches(batches)).to_pydict() == {"x": [1, 2]}
