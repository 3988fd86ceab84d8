"""Each stage of the pipeline, and its run, against brute force on a small corpus."""

import random
import re
import struct

import xxhash

import corpus_pipeline
from proofmill.llm import compression, mixing

from .test_operators import brute_near, brute_sizes, brute_targets, sentence

GOOD, BAD = "garden calm old house stood by river quiet window letter winter morning".split(), "click buy now cheap win offer prize deal free bonus cash hurry".split()


def corpus(rng):
    """Good and bad texts, exact and near copies, shared passages, benchmark items, nulls, blanks and a long text."""
    prose = lambda n: " ".join(rng.choice(GOOD) + str(rng.randrange(400)) if rng.random() < 0.7 else rng.choice(GOOD) for _ in range(n))
    passage, item = prose(60), prose(30)
    texts = [prose(rng.randrange(40, 200)) for _ in range(40)] + [" ".join(rng.choice(BAD) for _ in range(80)) for _ in range(25)]
    for t in list(texts[:6]):
        near = t.split()
        near[len(near) // 2] = "changed"
        texts += [t, " ".join(near)]
    texts += [prose(50) + " " + passage + " " + prose(50) for _ in range(4)] + [prose(40) + " " + item + " " + prose(40)] + [passage, prose(9000), None, "", None]
    docs = [(k, t, "en", rng.choice(("a", "b", "c", None)), len(t or "")) for k, t in enumerate(texts)]
    labels = [(k, 1 if k < 40 else 0, 0) for k in range(65)]
    return docs, labels, [("i1", item), ("i2", sentence(rng, 20)), (None, None)]


def brute_cut(rows, window=20):
    first, out = {}, []
    for r in sorted(rows):
        w = (r[1] or "").split()
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (r[0], p))
    for r in rows:
        w = (r[1] or "").split()
        gone = {q for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < (r[0], p) for q in range(p, p + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        if not gone or kept:
            out.append((r[0], kept, *r[2:4], len(kept)) if gone else r)
    return out


def brute_blocks(rows, block=64):
    """Per source its blocks as texts and how many slots they fill."""
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    place = lambda r: (signed(xxhash.xxh64_intdigest(struct.pack("<q", r[0]), 42)), r[0])
    want, out = brute_targets(sizes), {}
    for s in (s for s in sizes if sizes[s]):
        words = [w for r in sorted((r for r in rows if r[3] == s), key=place) for w in (r[1] or "").split()]
        blocks = [" ".join(words[i : i + block]) for i in range(0, len(words), block)]
        out[s] = blocks, int(want[s] * len(blocks) / sizes[s] + 0.5)
    return out


def test_stages_and_run(spark, tmp_path):
    import numpy as np

    docs, labels, items = corpus(random.Random(71))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows, kind in (("documents", docs, schema), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id string, text string")):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizer, w = compression.learn_quality(table, spark.read.parquet(f"{tmp_path}/labels.parquet"), 3, 1, -1, compression.DICT_BYTES)

    def good(t):
        t = (t or "").encode()
        bad, fine = brute_sizes(sizer.contents, t, -1)
        left = min(min(bad, fine) / (len(t) + 20), 1.0)
        return float(np.dot([1, (bad - fine) / (bad + fine + 20), left, left**2, np.log1p(len(t)) / 10], w)) >= 0

    grams = lambda t: {tuple(x[i : i + 5]) for x in [re.findall(r"\w+", (t or "").lower())] for i in range(len(x) - 4)}
    clean = lambda t: not any(grams(i) and len(grams(i) & grams(t)) >= 0.8 * len(grams(i)) for _, i in items)
    want = [[r for r in docs if good(r[1])]]
    groups = brute_near([r[1] or "" for r in want[0]])
    want.append([r for k, r in enumerate(want[0]) if groups[k] == k])
    want.append(brute_cut(want[1]))
    want.append([r for r in want[2] if clean(r[1])])
    assert len(docs) > len(want[0]) > len(want[1]) > len(want[3]) > 30 and want[1] != want[2]
    at = table
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        at = stage(spark, at, str(tmp_path))
        assert at.columns == table.columns
        assert sorted(map(tuple, at.collect()), key=repr) == sorted(want[k], key=repr), k
        at = spark.createDataFrame(at.collect(), schema)
    blocks = brute_blocks(want[3])
    slots = sorted((repr(s), int(mixing.permuted(np.array([k % len(b)]), len(b), mixing._seed(2, s, k // len(b)))[0]), k // len(b)) for s, (b, quota) in blocks.items() for k in range(quota))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((repr(r["source"]), r["idx"], r["pass"]) for r in out) == slots
    assert all(r["words"] == blocks[r["source"]][0][r["idx"]] for r in out) and len({(r["shard"], r["slot"]) for r in out}) == len(out)


def test_stages_on_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, kind in (("documents", schema), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id string, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_clashing_columns(spark, tmp_path):
    docs, labels, items = corpus(random.Random(72))
    names = ("doc_id", "text", "lang", "source", "n_chars", "kept", "__sha", "__hash", "__id", "__bad", "score", "predicted", "held_out", "a.b", "row", "hash", "sha", "id", "n_removed", "text_hash", "key", "doc")
    kinds = ["long", "string", "string", "string", "long"] + ["string"] * (len(names) - 5)
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))
    rows = [(*r, *(f"{n} of {r[0]}" for n in names[5:])) for r in docs]
    rows += [(900, None, "en", "a", 0, *("x" for _ in names[5:])), (900, "", "en", "a", 0, *("x" for _ in names[5:]))]
    plain = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data, kind in (("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id string, text string")):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    wide, narrow = spark.createDataFrame(rows, schema), spark.createDataFrame([r[:5] for r in rows], plain)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out, want = stage(spark, wide, str(tmp_path)), stage(spark, narrow, str(tmp_path))
        assert out.columns == list(names)
        got = out.collect()
        assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(map(tuple, want.collect()), key=repr), name
        assert all(r[5:] == tuple("x" if r[0] == 900 else f"{n} of {r[0]}" for n in names[5:]) for r in got), name
        if name == "near_dedup":
            assert sum(not r[1] for r in got) == 1
    assert corpus_pipeline.mix_sources(spark, wide, str(tmp_path)).count() == corpus_pipeline.mix_sources(spark, narrow, str(tmp_path)).count() > 0
