"""Each operator against brute force on small fixtures with nulls, empty texts, ties, copies and clashing columns."""

import hashlib
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from proofmill.llm import compression, decontam, graph, licenses, mixing, simhash, substring, tokens, topk, urls
from proofmill.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, words int, kept string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    """Rows ``(doc_id, text[, source])`` with columns whose names clash with the operators' own."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "web", len(r[1] or ""), "x", 1, "y") for r in rows]
    return spark.createDataFrame(full, DOCS)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components_chain_and_empty(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "u long, v long")), "node", "root"))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_fingerprint(text):
    words = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op1_brute_force(spark):
    rng = random.Random(1)
    base = sentence(rng, 300).split()
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (5, "ONE two"), (6, "Ünï x y z q"), (None, "one two"), (7, "a b c d")]
    for i in range(40):
        near = list(base)
        for _ in range(i % 5):
            near[rng.randrange(300)] = "changed"
        rows.append((100 + i, " ".join(near)))
    rows += [(200 + i, sentence(rng, rng.randrange(1, 60))) for i in range(40)]
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(parent, i)] = find(parent, j)
    group = [find(parent, i) for i in range(len(rows))]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    want = sorted(((r[0], f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, group)), key=repr)
    assert rows_of(simhash.simhash_groups(docs_of(spark, rows)), "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("seed", [1, 2])
def test_op1_links_of_bit_flips(spark, seed):
    """Every link at 4 or fewer bits is found, whichever bits differ."""
    rng = random.Random(seed)
    values = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(4):
            y = x
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                y ^= 1 << b
            values.add(y)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    parent = {v: v for v in signed}
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4:
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    got = dict(rows_of(simhash.link_groups(spark.createDataFrame([(v,) for v in signed], "fp long"), 4), "fp", "root"))
    assert got == {v: find(parent, v) for v in signed}


def test_op1_broadcasts_nothing_that_grows(spark, monkeypatch):
    """No table of the links is held whole by the driver, however small its files are."""
    rng = random.Random(5)
    plans, write = [], simhash.materialise

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    for module in (simhash, graph):
        monkeypatch.setattr(module, "materialise", seen)
    rows = [(i, sentence(rng, 80) if i % 2 else "one text of which there are many copies") for i in range(40)]
    for of in (simhash.simhash_groups, simhash.dedup_near):
        plans.append(of(docs_of(spark, rows))._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans)


def test_near_duplicates_are_linked_by_simhash(spark, monkeypatch):
    """Fingerprints find near copies, the exact similarity verifies them, and only the rest is left to prefixes."""
    rng = random.Random(8)
    texts = []
    for _ in range(6):
        base = sentence(rng, 600, 5000).split()
        texts += [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (10, 300, 500)]
    short = sentence(rng, 40, 5000)
    texts += [short, short + " and four words more", "one", "two", "x y", "X y"]
    fps = [brute_fingerprint(t) for t in texts]
    near, near_root = brute_near(texts), {}
    found, linked = [], simhash.linked

    def seen(sets, copies, similarity, pairs):
        found.extend(map(tuple, pairs.collect()))
        return linked(sets, copies, similarity, pairs)

    monkeypatch.setattr(simhash, "linked", seen)
    groups = {r["text_hash"]: r["group_id"] for r in simhash.near_duplicates(docs_of(spark, list(enumerate(texts)))).collect()}
    key = [h - (1 << 64) if (h := xxhash.xxh64_intdigest(t, 42)) >> 63 else h for t in texts]
    for i, k in enumerate(key):
        near_root.setdefault(near[i], groups[k])
        assert groups[k] == near_root[near[i]]
    assert len(set(near_root.values())) == len(set(near))
    at = {k: i for i, k in enumerate(key)}
    assert found and all(near[at[u]] == near[at[v]] for u, v in found)
    close = {(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4 and near[i] == near[j]}
    parent = list(range(len(texts)))
    for u, v in found:
        parent[find(parent, at[u])] = find(parent, at[v])
    assert close and all(find(parent, i) == find(parent, j) for i, j in close)


def test_near_duplicates_keep_one_of_each_group(spark):
    rng = random.Random(3)
    shared = sentence(rng, 60)
    base = sentence(rng, 400).split()
    near = list(base)
    near[100], near[200] = "x", "y"
    rows = [(9, " ".join(base)), (4, " ".join(near)), (7, " ".join(base)), (1, None), (2, ""), (None, " ".join(base))]
    rows += [(20 + i, shared + " " + sentence(rng, 300)) for i in range(5)] + [(40 + i, sentence(rng, 100)) for i in range(5)]
    docs = docs_of(spark, rows)
    out = simhash.dedup_near(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 4, *range(20, 25), *range(40, 45)]


def test_near_duplicates_find_short_near_copies(spark):
    """Short texts with two changed words (similarity about 0.85) join their original; unrelated texts stay apart."""
    rng = random.Random(12)
    rows = []
    for k in range(40):
        base = sentence(rng, 130, 2000).split()
        near = list(base)
        near[rng.randrange(10, 60)], near[rng.randrange(70, 120)] = "changed", "words"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    assert sorted(r["doc_id"] for r in simhash.dedup_near(docs_of(spark, rows)).collect()) == list(range(0, 80, 2))


def brute_near(texts, shingle=5, similarity=0.8):
    """The least index of each text's component over all pairs of at least this Jaccard similarity."""
    words = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} for w in words]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n >= similarity * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    return [find(parent, i) for i in range(len(texts))]


def test_near_duplicates_join_groups_without_a_center(spark):
    """Variants of absent originals and chains of edits: exactly one of each brute-force component stays."""
    rng = random.Random(21)
    texts = []
    for size in (100, 100, 10, 10, 10, 10):
        base = sentence(rng, 300, 3000).split()
        for _ in range(size):
            near = list(base)
            for p in rng.sample(range(300), rng.choice((3, 4))):
                near[p] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(near))
    for _ in range(2):
        near = sentence(rng, 300, 3000).split()
        for _ in range(100):
            for p in rng.sample(range(300), 5):
                near[p] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(near))
    kept = sorted(r["doc_id"] for r in simhash.dedup_near(docs_of(spark, list(enumerate(texts)))).collect())
    assert kept == sorted(set(brute_near(texts)))


def test_near_duplicates_find_appended_and_cut_copies(spark):
    """Copies with a paragraph added at the end or cut from the start, as far as five-word sets still reach 0.8."""
    rng = random.Random(22)
    texts = []
    for k in range(120):
        words = sentence(rng, rng.randrange(40, 400), 5000).split()
        texts.append(" ".join(words))
        texts.append(" ".join(words[len(words) * 15 // 100 :] if k % 2 else words + sentence(rng, len(words) * 18 // 100, 5000).split()))
    want = brute_near(texts)
    kept = sorted(r["doc_id"] for r in simhash.dedup_near(docs_of(spark, list(enumerate(texts)))).collect())
    assert len(set(want)) <= 130 and kept == sorted(set(want))


def brute_substrings(rows, window=20):
    texts = [(i, t, (t or "").split()) for i, t in rows]
    first, out = {}, []
    for i, _, w in sorted(texts, key=lambda r: r[0]):
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (i, p))
    for i, _, w in texts:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (i, p):
                gone.update(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_op8_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    passage, line = sentence(rng, 50), "same words again and again " * 12
    rows = [(1, None), (2, ""), (3, passage), (4, sentence(rng, 30) + " " + passage + "\n" + sentence(rng, 30)), (5, line), (6, passage.upper())]
    rows += [(7, "a " * 100), (8, passage + " " + passage), (9, sentence(rng, 9000, 30)), (10, " ".join(passage.split()[:20])), (11, " ".join(passage.split()[:19]))]
    rows += [(20 + i, sentence(rng, 200, 3)) for i in range(10)] + [(40 + i, passage) for i in range(30)]
    got = substring.dedup_substrings(docs_of(spark, rows)).withColumn("kept_sha256", F.sha2("kept", 256))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows)


def test_op8_hash_collisions_are_found_and_undone(spark):
    """With hashes of 6 bits nearly all windows collide; the comparison of words at the source finds it, and other hashes follow."""
    rng = random.Random(41)
    passage = sentence(rng, 60)
    rows = [(i, sentence(rng, 60) + (" " + passage if i % 3 == 0 else "") + " " + sentence(rng, 30)) for i in range(30)]
    keyed = docs_of(spark, rows).selectExpr("doc_id AS doc", "0L AS mark", "cast(text AS binary) AS text")
    wrong = spark.createDataFrame([((3, 0, 60), 41, 9, 0, 60), ((3, 0, 60), 41, 6, 0, 59)], "src struct<doc:long,mark:long,pos:int>, n int, doc long, mark long, pos int").select("doc", "mark", "pos", "n", "src")
    assert substring._unlike(keyed, wrong.where("doc = 9"), 20).count() == 0 and substring._unlike(keyed, wrong, 20).count() == 1
    for bits in (6, 64):
        out = substring.dedup_substrings(docs_of(spark, rows), bits=bits).collect()
        got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in out), key=repr)
        assert got == brute_substrings(rows)


def test_op8_paths_are_long(spark):
    """Copies of a passage are one path each, whatever pieces it was cut into; its source is where it stands first."""
    rng = random.Random(42)
    passage = sentence(rng, 300, 5000)
    rows = [(i, sentence(rng, 50, 5000) + " " + passage + " " + sentence(rng, 50, 5000)) for i in range(8)]
    keyed = docs_of(spark, rows).selectExpr("doc_id AS doc", "0L AS mark", "cast(text AS binary) AS text")
    paths = sorted((r["doc"], r["pos"], r["n"], tuple(r["src"])) for r in substring.repeated_paths(keyed, 20, 8).collect())
    assert paths == [(i, 50, 281, (0, 0, 50)) for i in range(1, 8)]


def test_op8_circles_and_copies_are_few_paths(spark):
    """A text that goes round in circles is a path or two, not one for each round; a copy of a whole text is one path."""
    rng = random.Random(43)
    text = sentence(rng, 400, 5000)
    rows = [(1, "same " * 3000), (2, "to and fro " * 500), (3, text), (4, text), (5, text)]
    keyed = docs_of(spark, rows).selectExpr("doc_id AS doc", "0L AS mark", "cast(text AS binary) AS text")
    paths = sorted((r["doc"], r["pos"], r["n"], tuple(r["src"])) for r in substring.repeated_paths(keyed, 20, 8).collect())
    assert paths[-2:] == [(4, 0, 381, (3, 0, 0)), (5, 0, 381, (3, 0, 0))] and len(paths) <= 6
    assert sum(n for doc, _, n, _ in paths if doc == 1) == 2980 and sum(n for doc, _, n, _ in paths if doc == 2) == 1478


def test_op8_small_blocks_and_ids_far_apart(spark, monkeypatch):
    """Texts split over blocks, short copies between long ones, long words, all kinds of white space; ids of 32 bits and ids that need 64."""
    for name, bound in {"BLOCK": 7, "BUCKET": 3, "BUCKETS": 5, "TEXTS": 3000, "LONG": 16, "PIECE": 16}.items():
        monkeypatch.setattr(substring, name, bound)
    rng = random.Random(44)
    passage, long_words = sentence(rng, 90, 5000), " ".join(f"{'x' * (k % 40)}{k}" for k in range(60))
    texts = [passage, "few words", sentence(rng, 30, 5000), "few words", "few words", passage, "", None, passage + "\t\n" + passage, long_words, "\n" + long_words.replace(" ", "\v "), "x\0 y " * 30, "x y " * 30]
    texts += ["one two three " * 40, "one two three " * 40, "a" + "one two three " * 20, sentence(rng, 300, 2), passage[:300], passage.replace("1", "2", 1), passage + " end", passage + " end"]
    order = rng.sample(range(len(texts)), len(texts))
    for far in (1, 1 << 40):
        rows = [((i - 5) * far, t) for i, t in zip(order, texts)]
        got = substring.dedup_substrings(docs_of(spark, rows)).withColumn("kept_sha256", F.sha2("kept", 256))
        assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows)


def test_op8_repeated_ids(spark):
    rng = random.Random(5)
    a, b = sentence(rng, 40), sentence(rng, 40)
    got = substring.dedup_substrings(docs_of(spark, [(1, a), (1, a), (None, b), (2, b)]))
    assert rows_of(got, "doc_id", "n_removed") == [(1, 0), (1, 0), (2, 40), (None, 0)]
    # One id with two texts: two documents, one of which repeats the other's passage.
    got = substring.dedup_substrings(docs_of(spark, [(1, a + " x"), (1, "y " + a), (-(1 << 63), a), (None, "z " + a)]))
    assert rows_of(got, "doc_id", "n_removed") == [(-(1 << 63), 40), (1, 40), (1, 40), (None, 0)]


def test_op4_brute_force(spark):
    rng = random.Random(6)
    item = {k: sentence(rng, n).split() for k, n in (("a", 5), ("b", 12), ("c", 70), ("d", 4))}
    changed = list(item["c"])
    changed[0] = changed[1] = "q"  # 64 of 66 shingles stay
    broken = ["q" if k % 5 == 0 else w for k, w in enumerate(item["b"])]
    texts = [" ".join(item["a"]), "Intro, " + sentence(rng, 3000) + " " + "; ".join(item["b"]).upper() + ". " + sentence(rng, 2000), " ".join(changed)]
    texts += [" ".join(broken), " ".join(item["d"]), None, "", sentence(rng, 500), " ".join(item["a"]) + " " + " ".join(item["c"])]
    item[None] = sentence(rng, 30, 10**6).split()
    texts += [sentence(rng, 40) + " " + " ".join(item[None])]
    items = spark.createDataFrame([(k, " ".join(w), 1) for k, w in item.items()] + [("n", None, 1), (None, "", 1)], "item_id string, text string, n int")
    docs = docs_of(spark, list(enumerate(texts)) + [(0, texts[0])])
    grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"\w+", (t or "").lower())] for i in range(len(w) - 4)}
    want = []
    for i, t in enumerate(texts):
        for k, w in item.items():
            g = grams(" ".join(w))
            if g and len(g & grams(t)) >= 0.8 * len(g):
                want.append((i, k, len(g), len(g & grams(t))))
    assert {(0, "a"), (1, "b"), (2, "c"), (8, "a"), (8, "c"), (9, None)} == {x[:2] for x in want}
    assert rows_of(decontam.contaminated(docs, items), "doc_id", "item_id", "n_shingles", "n_shared") == sorted(want, key=repr)
    out = decontam.decontaminate(docs, items)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [3, 4, 5, 6, 7]


def test_op4_shared_shingles(spark):
    """Items and documents that share many shingles, null document ids, and a very long document."""
    rng = random.Random(61)
    common = sentence(rng, 20)
    items = [(k, sentence(rng, 20 + k, 300) + " " + common) for k in range(20)] + [(99, common)]
    docs = [(k, sentence(rng, 30) + " " + (t if k % 2 else common)) for k, t in items] + [(None, common), (200, " ".join([sentence(rng, 60_000), items[3][1], sentence(rng, 60_000)]))]
    grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"\w+", t.lower())] for i in range(len(w) - 4)}
    want = [(d, k, len(grams(i)), len(grams(i) & grams(t))) for d, t in docs for k, i in items if len(grams(i) & grams(t)) >= 0.8 * len(grams(i))]
    got = decontam.contaminated(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got, "doc_id", "item_id", "n_shingles", "n_shared") == sorted(want, key=repr)


def brute_targets(sizes, weights=(5, 2, 1), repeat=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest, live = total - sum(stopped.values()), [s for s in names if s not in stopped]
        over = [s for s in live if rest * w[s] / sum(w[x] for x in live) > repeat * sizes[s]]
        if not over:
            return stopped | {s: rest * w[s] / sum(w[x] for x in live) for s in live}
        stopped |= {s: repeat * sizes[s] for s in over}


def test_op2_targets_and_draw(spark):
    rng = random.Random(7)
    counts = {"a": 3, "b": 900, "c": 300, "d": 40, None: 30, "e": 0}
    rows, k = [(0, None, "e"), (-1, " ", "a"), (None, "x y z", "a")], 1
    for s, n in counts.items():
        for _ in range(n):
            rows.append((k, sentence(rng, rng.randrange(1, 80)), s))
            k += 1
    docs = docs_of(spark, rows)
    got, again = (mixing.mix(docs).collect() for _ in range(2))
    assert sorted(got, key=repr) == sorted(again, key=repr) and len(got) == len(rows)
    sizes = {s: 0 for s in counts}
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    want = brute_targets(sizes)
    for s in counts:
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], abs_tol=1e-6) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 3 * 64
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)


def test_op2_mixed_blocks_hold_the_words(spark):
    """Every slot holds its block's words, those of the documents in its parts, and mix counts just these."""
    rng = random.Random(8)
    rows = [(k, sentence(rng, rng.choice((1, 7, 64, 150, 700)), 10**6), rng.choice("aab")) for k in range(300)] + [(None, "x  y\tz", None), (5, "again", "a"), (6, None, "b")]
    docs = docs_of(spark, rows)
    blocks = mixing.mixed_blocks(docs, slots=100).collect()
    texts, taken, whole = {}, {}, {}
    for r in rows:
        texts.setdefault(r[0], []).append((r[1] or "").split())
    assert len({(r["shard"], r["slot"]) for r in blocks}) == len(blocks) and max(r["shard"] for r in blocks) > 3
    for r in blocks:
        words, at = r["words"].split(" "), 0
        assert whole.setdefault((r["source"], r["idx"]), r["words"]) == r["words"] and len(words) == sum(p["n"] for p in r["parts"]) <= 64
        for p in r["parts"]:
            off = max(0, r["idx"] * 64 - p["start"])
            assert words[at : at + p["n"]] in [t[off : off + p["n"]] for t in texts[p["doc_id"]]]
            at += p["n"]
            taken[p["doc_id"]] = taken.get(p["doc_id"], 0) + p["n"]
    counted = {}
    for r in mixing.mix(docs, slots=100).collect():
        counted[r["doc_id"]] = counted.get(r["doc_id"], 0) + r["taken"]
    assert {k: v for k, v in counted.items() if v} == taken


def test_op2_taken_against_a_brute_force_mix(spark):
    """Blocks laid out, slots drawn and words counted one by one, for few sources and for more than a task may hold."""
    import struct

    import numpy as np

    rng = random.Random(82)
    rows = [(k, sentence(rng, rng.choice((1, 5, 64, 90, 300))), rng.choice(("a", "b", "b", "c", None))) for k in range(250)] + [(7, "again and again", "a"), (9, None, "a"), (-4, "", "q")]
    docs = docs_of(spark, rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    names = [s for s in sorted(sizes, key=lambda s: (s is None, s or "")) if sizes[s]]
    hashed = lambda k: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(struct.pack("<q", k), 42))
    blocks, quota = {}, {}
    for s in names:
        laid = [k for k, n in sorted(((k, len(t.split())) for k, t, x in rows if x == s and t), key=lambda r: (hashed(r[0]), *r)) for _ in range(n)]
        blocks[s] = [laid[i : i + 64] for i in range(0, len(laid), 64)]
        quota[s] = int(want[s] * len(blocks[s]) / sizes[s] + 0.5)
    shards = -(-sum(quota.values()) // 50)
    slots, base = [], 0
    for s in names:
        n = len(blocks[s])
        for k in range(quota[s]):
            block = int(mixing.permuted(np.array([k % n]), n, mixing._seed(2, s, k // n))[0])
            slots.append((int(mixing.permuted(np.array([base + k]), shards * 50, mixing._seed(2, "slots"))[0]) // 50, s, block))
        base += quota[s]
    taken = {}
    for _, s, block in slots:
        for k in blocks[s][block]:
            taken[k] = taken.get(k, 0) + 1
    for limit in (100, 2):
        plan = mixing.targets(mixing.sized_documents(docs, "doc_id", "text", "source"))
        got = mixing.sample_slots(plan, 64, 50, 2, max_sources=limit).collect()
        assert sorted((repr(r["source"]), r["idx"]) for r in got) == sorted((repr(s), b) for _, s, b in slots)
        assert len({(r["shard"], r["slot"]) for r in got}) == len(got) and max(r["slot"] for r in got) < 50
        if limit == 2:
            assert sorted((r["shard"], repr(r["source"]), r["idx"]) for r in got) == sorted((x, repr(s), b) for x, s, b in slots)
    mine = {}
    for r in mixing.mix(docs, slots=50).collect():
        mine[r["doc_id"]] = mine.get(r["doc_id"], 0) + r["taken"]
    assert {k: v for k, v in mine.items() if v} == taken


def test_op2_never_holds_two_shuffles_of_all_texts(spark):
    """Disk: no action shuffles much more than the texts once, and of the blocks only those that fill a slot are shuffled."""
    rng = random.Random(83)
    rows = [(k, " ".join(f"{rng.getrandbits(64):016x}" for _ in range(300)), "aabbcccccc"[k % 10]) for k in range(1000)]
    docs = docs_of(spark, rows)
    runs = spark._jsparkSession.sharedState().statusStore()
    before, store = runs.executionsList().size(), spark.sparkContext._jsc.sc().statusStore()
    got = mixing.mix(docs, slots=100).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ids = [runs.executionsList().apply(i).stages().mkString(",").split(",") for i in range(before, runs.executionsList().size())]
    moved = sorted(sum(store.lastStageAttempt(int(k)).shuffleWriteBytes() for k in x if k) for x in ids)
    texts = sum(len(t) for _, t, _ in rows)
    # c is drawn to a quarter, so about half of all blocks fill slots.
    assert len(got) == len(rows) and moved[-1] < 1.2 * texts and moved[-2] < 0.7 * texts, moved


def test_op2_permutation_inverts_and_tells_the_drawn_blocks(spark):
    import numpy as np

    for n in (1, 2, 3, 100, 1000):
        for i in (np.arange(n), np.arange(n)[::-1]):
            assert (mixing.permuted(mixing.permuted(i, n, 5), n, 5, back=True) == i).all()
    plan = spark.createDataFrame([("a", 100 * 64, 30.4 * 64), ("b", 50 * 64 - 7, 149.0 * 64), (None, 77 * 64, 76.0 * 64), ("z", 9, 0.0)], "source string, source_size long, target double")
    every = mixing._quotas(plan, 64).withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    for limit in (100, 2):
        slots = mixing.sample_slots(plan, 64, 10, 2, max_sources=limit)
        assert rows_of(every.where(mixing._taken_by_slots(2)("source", "idx", "blocks", "quota")), "source", "idx") == rows_of(slots.select("source", "idx").distinct(), "source", "idx")


def test_op2_draws_stay_random_beyond_numpy():
    import numpy as np

    quota = np.array([4_000_000_000, 1_000_000_000, 0, 20])
    draws = np.array([mixing._draw(np.random.default_rng(i), quota, 1_000_000) for i in range(400)])
    assert (draws.sum(axis=1) == 1_000_000).all() and (draws[:, 2] == 0).all()
    assert abs(draws[:, 0].mean() - 800_000) < 100 and 340 < draws[:, 0].std() < 460


def test_op2_permutation_and_shards():
    import numpy as np

    for n in (1, 2, 3, 100, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5)) == list(range(n))
    quota = np.array([500, 30, 0, 70])
    parts = [mixing.shard_counts(quota, 6, 100, s, 3) for s in range(6)]
    assert (sum(p[0] for p in parts) == quota).all() and all(p[0].sum() == 100 for p in parts)
    assert all((parts[s][1] == sum(p[0] for p in parts[:s])).all() for s in range(1, 6))


def op3_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_op3_brute_force(spark):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    rng = random.Random(31)
    mit, long = licenses.TEMPLATES["mit"][0], licenses.TEMPLATES["zlib"][0]
    cut = op3_words(long)
    for p in rng.sample(range(len(cut)), 20):
        cut[p] = "changed"
    texts = [None, "", "Under the MIT License, under the mit-license! the mit license under the mit license", "CC BY-NC and Apache License, Version 2", "thunder the mit license", "the MIT License"]
    texts += ["word " * 100 + mit + " tail" * 50, "x " * 61 + mit, " ".join(mit.split()[:10]), "permission is granted", "y " * 777 + " ".join(cut), "z " * 5000 + long + " z" * 5000]
    texts += [sentence(rng, rng.randrange(700)) + " " + n + " " + sentence(rng, 99) for notices in licenses.TEMPLATES.values() for n in notices]
    got = licenses.scan_licenses(docs_of(spark, list(enumerate(texts)) + [(None, texts[2]), (2, texts[2])])).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        words = op3_words(texts[2 if r["doc_id"] is None else r["doc_id"]])
        at = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(words), len(at))
        assert (r["first_word"], r["last_word"]) == (min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        base = sorted({x for _, x in at})
        assert r["base_labels"] == ",".join(base) and set(base) <= set(filter(None, r["labels"].split(",")))
        # Exact containment over the same blocks, without any filter.
        shares = {}
        for label, notices in licenses.TEMPLATES.items():
            for n in map(op3_words, notices):
                half = next(1 << k for k in range(20) if 1 << k >= len(n))
                blocks = [set(words[s : s + 2 * half]) for s in range(0, max(1, len(words)), half)]
                shares[label] = max([shares.get(label, 0.0), *(len(set(n) & b) / len(set(n)) for b in blocks)])
        assert r["labels"] == ",".join(sorted({*base, *(k for k, s in shares.items() if s >= 0.8)}))
        assert math.isclose(r["score"], 1.0 if at else max((s for s in shares.values() if s >= 0.8), default=0.0))
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[5] == "" and labels[6] == labels[7] == "mit" and labels[10] == labels[11] == "zlib"
    many = [label for label, notices in licenses.TEMPLATES.items() for _ in notices]
    assert all(label in labels[12 + k].split(",") for k, label in enumerate(many))
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs_of(spark, []), templates={"x": ("a " * 2_000_001,)})


#: The columns that rest on the phrases alone, in SQL.
OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, i, CASE WHEN w[i : i + 3] = ['under', 'the', 'mit', 'license'] THEN 'mit' WHEN w[i : i + 3] = ['apache', 'license', 'version', '2'] THEN 'apache-2' WHEN w[i : i + 2] = ['cc', 'by', 'nc'] THEN 'cc-by-nc' END AS label
 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
s AS (SELECT doc_id, count(label) AS n_base, min(i - 1) FILTER (WHERE label IS NOT NULL) AS first_word, max(i - 1) FILTER (WHERE label IS NOT NULL) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM w LEFT JOIN s USING (doc_id)
"""


def test_op3_base_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    want = sorted(duckdb.sql(OP3_SQL.replace("FROM documents", f"FROM '{sf}/documents.parquet'")).fetchall())
    got = licenses.scan_licenses(spark.read.parquet(f"{sf}/documents.parquet"))
    assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr) and any(r[2] for r in want)


def test_op6_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(700)]
    rows += [(700, rows[0][1]), (701, rows[0][1]), (702, None), (703, [None] * 16), (704, [float("nan")] * 16), (705, [float("inf")] * 16), (None, rows[1][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, v int")
    sound = [(r["vec_id"], [math.floor(1024 * x) for x in r["embedding"]]) for r in df.collect() if r["vec_id"] is not None and r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    want = []
    for q, a in sound:
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in sound if c != q)[:10]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    for block in (100, 10_000):
        assert rows_of(topk.top_k(df, block=block), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_op6_ties_and_unequal_lengths(spark):
    rng = random.Random(81)
    rows = [(k, [float(rng.randrange(-2, 3)) for _ in range(rng.randrange(4))]) for k in range(400)] + [(9, [1.0, 2.0])] * 3
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "vec_id long, embedding array<double>, block int")
    want = []
    for q, a in {(r[0], tuple(r[1])) for r in rows if r[0] % 100 == 0}:
        scores = sorted((-sum(int(1024 * x) * int(1024 * y) for x, y in zip(a, b)), c) for c, b in rows if c != q)
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scores[:10])]
    assert rows_of(topk.top_k(df, block=50), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(0, [1e9])], "vec_id long, embedding array<double>"))


def test_op6_fewer_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (3, [2.0])], "vec_id long, embedding array<double>")
    assert rows_of(topk.top_k(df), "query_id", "rank", "vec_id", "score") == [(0, 1, 3, 1024 * 2048)]


def greedy(word, pieces, prefix=b""):
    at, n = 0, 0
    while at < len(word):
        lead = prefix if at else b""
        size = next((k for k in range(len(word) - at, 0, -1) if lead + word[at : at + k] in pieces), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


@pytest.mark.parametrize("prefix", [b"", b"##"])
def test_op7_greedy(spark, prefix):
    rng = random.Random(9)
    pieces = {prefix * (rng.random() < 0.5) + bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 5))) for _ in range(40)}
    auto = tokens.LongestMatch(sorted(pieces), prefix)
    for _ in range(3000):
        w = bytes(rng.choice(b"abcd" if rng.random() < 0.1 else b"abc") for _ in range(rng.randrange(1, 12)))
        assert auto.count(w) == greedy(w, pieces, prefix), w
    texts = [None, "", "abc  ab\tcab", "abcabcabcabc " * 500]
    got = tokens.count_tokens(docs_of(spark, list(enumerate(texts))), sorted(pieces), prefix, lead=b"")
    want = [(i, len((t or "").split()), sum(greedy(w.encode(), pieces, prefix) for w in (t or "").split())) for i, t in enumerate(texts)]
    assert rows_of(got, "doc_id", "n_words", "n_tokens") == want


def test_op9_brute_force(spark):
    links = [None, "", "no scheme", "http://Example.NET/en/x?q", "https://a.b.example.net/en", "http://net/", "http://x.net", "http://x.net/#a", "http://example.com/de/y", "http://sub.example.com/de/"]
    links += ["http://my-example.com/de/", "http://wiki.org/fr/a", "http://org/fr/", "http://orgy/fr/", "ftp://x.org?u=http://y.net/", "http://planet/", "http://x.net:80/", "://x.net/", "http://a.example.net/en/../de/"]
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(links)], "page_id long, url string, host string, path string")
    want = []
    for i, u in enumerate(links):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fit = [r for r in rules if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
        best = max(fit, key=len, default=None)
        want.append((i, host, path, best, rules.get(best, "allow")))
    assert rows_of(urls.filter_urls(df), "page_id", "host", "path", "rule", "verdict") == sorted(want, key=repr)
    assert rows_of(urls.filter_urls(df, max_rules=3), "page_id", "host", "path", "rule", "verdict") == sorted(want, key=repr)


def test_op9_many_entries_of_one_host():
    rng = random.Random(19)
    paths = lambda n: ["/" + "".join(rng.choice("abc/") for _ in range(rng.randrange(1, 9))) for _ in range(n)]
    rules = [urls.rule(rng.choice(("allow", "block")), "host.example" + p) for p in paths(300)]
    trie, asked = urls.build_trie(rules), paths(500)
    for path in asked:
        fits = [(len(r.path), r.verdict == "block", "host.example" + r.path, r.verdict) for r in rules if path.startswith(r.path)]
        assert urls.lookup(trie, "www.host.example", path) == (max(fits)[2:] if fits else None)
    # Entries that end in one segment are looked up, not gone through.
    most = lambda n: max(len(here[urls._END]) for here in [urls.build_trie([urls.rule("block", f"h/{i:06d}") for i in range(n)])["h"][urls._PATH][""]])
    assert most(2000) == 2000

    class Counted(dict):
        asked = 0

        def __contains__(self, key):
            Counted.asked += 1
            return dict.__contains__(self, key)

    trie = urls.build_trie([urls.rule("block", f"h/{i:06d}") for i in range(20_000)])
    node = trie["h"][urls._PATH][""]
    node[urls._END] = Counted(node[urls._END])
    assert urls.lookup(trie, "h", "/019999xyz") == ("h/019999", "block") and Counted.asked <= 7


def test_op5_bounds_its_labels(spark, monkeypatch):
    monkeypatch.setattr(compression, "LABELS", 2)
    rows = [(i, "some text here " * 5, ("en", "en", "en", "de", "de", f"x{i}")[i % 6], "web", 1, "x", 1, "y") for i in range(120)]
    assert compression.learn_languages(spark.createDataFrame(rows, DOCS))[0] == ["de", "en"]


def test_op9_trie_and_join_agree(spark):
    """Random entries and urls on both sides of the limit, against a scan of all entries."""
    rng = random.Random(10)
    hosts = ["a", "b.a", "c.b.a", "x.a", "net", "q.net", ""]
    paths = ["", "/", "/en", "/en/", "/en/a", "/en/abc/", "/e", "//", "/a/b/c/d"]
    entries = [urls.rule(rng.choice(("allow", "block")), rng.choice(hosts[:-1]) + rng.choice(paths)) for _ in range(40)]
    links = [(k, f"http://{rng.choice(('', 'w.', 'b.'))}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(('', 'x', '/y', '?q'))}") for k in range(300)]
    df = spark.createDataFrame(links, "page_id long, url string")
    table = spark.createDataFrame(entries, "verdict string, host string, path string")
    want = []
    for k, u in links:
        host, path = re.match(r"http://([^/?#]*)([^?#]*)", u).groups()
        fit = [(len(r.host + r.path), len(r.host), r.verdict == "block", r.host + r.path) for r in entries if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
        best = max(fit, default=None)
        want.append((k, best and best[3], "block" if best and best[2] else "allow"))
    for rules, limit in ((entries, 100), (entries, 10), (table, 100), (table, 10)):
        assert rows_of(urls.filter_urls(df, rules, max_rules=limit), "page_id", "rule", "verdict") == sorted(want, key=repr)
    assert urls.filter_urls(df.limit(0), table, max_rules=1).count() == 0


def test_op5_and_op10_learn(spark):
    good, bad = "the garden was calm and the old house stood by the river ", "click buy now cheap win $$$ offer offer prize "
    rows = [(i, (good if i % 2 else bad) * (2 + i % 3) + str(i)) for i in range(400)] + [(1000, None), (1001, ""), (1002, "12 34 !"), (None, good)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(None, 1, 0), (5, 1, 0), (399, None, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in compression.score_quality(docs, labels).collect()}
    assert all(out[i]["predicted"] == i % 2 for i in range(400)) and all(0 <= r["score"] <= 1 for r in out.values()) and len(out) == len(rows)
    assert compression.score_quality(docs, labels).columns == [*docs.columns, "held_out", "score", "predicted"]
    two = spark.createDataFrame([(i, "der garten war ruhig und schön " + str(i) if i % 2 else "the garden was quiet and fine " + str(i), "de" if i % 2 else "en") for i in range(200)] + [(900, None, "de"), (901, "12 !", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in compression.identify_languages(two).collect()}
    assert all(got[i]["lang_pred"] == ("de" if i % 2 else "en") for i in range(200))
    assert (got[900]["lang_pred"], got[901]["lang_pred"], got[900]["score"]) == ("und", "und", 0.0)


def brute_sizes(contents, text, level):
    import zstandard

    return [len(zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False).compress(text)) for c in contents]


def test_op5_brute_force(spark):
    """Whole texts under each language's dictionary, one at a time: the smallest wins; very long texts, ties, columns with clashing names."""
    rng = random.Random(51)
    words = {"de": "der die und garten haus fluss ruhig schön", "en": "the and garden house river calm of was", "fr": "le la et jardin maison rivière calme"}
    rows = [(k, " ".join(rng.choice(words[lang].split()) for _ in range(30)), lang, 0.5, "x") for k, lang in enumerate(rng.choice(list(words)) for _ in range(300))]
    rows += [(900, "½ ² ① 12", "de", 0.0, None), (901, "", None, 0.0, None), (902, None, "en", 0.0, None), (903, ("garden river " * 60_000), None, 0.0, None), (904, "日本", None, 0.0, None), (None, "haus und garten", "de", 0.0, None), (5, rows[5][1], rows[5][2], 0.0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    names, sizer = compression.learn_languages(docs)
    assert names == ["de", "en", "fr"]
    got = {r["doc_id"]: r for r in compression.identify_languages(docs).collect()}
    assert [got[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3 and got[904]["lang_pred"] in names and got[903]["lang_pred"] == "en"
    for k, t in [(r[0], r[1]) for r in rows if r[0] not in (900, 901, 902)]:
        found = brute_sizes(sizer.contents, compression.letters(t), -3)
        assert got[k]["lang_pred"] == names[found.index(min(found))]
        assert math.isclose(got[k]["score"], 1 / sum(math.exp(-(x - min(found)) / (2 + 0.01 * min(found))) for x in found))


def test_op10_brute_force(spark):
    """Scores from the sizes of whole texts; ids that repeat add no rows to the samples, columns may have the result's names."""
    rng = random.Random(52)
    good, bad = "the garden was calm and the old house stood by the river".split(), "click buy now cheap win offer prize deal free".split()
    text = lambda k: " ".join(rng.choice(good if k % 2 else bad) for _ in range(40))
    rows = [(k, text(k), 0.1, True, 7, "r") for k in range(200)] + [(2, text(2), 0.1, True, 7, "r")] * 3000 + [(3, text(3), 0.1, True, 7, "r")] * 3000
    rows += [(500, None, 0.1, True, 7, "r"), (501, "", 0.1, True, 7, "r"), (502, " ".join([text(1)] * 3000), 0.1, True, 7, "r"), (None, text(1), 0.1, True, 7, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, held_out boolean, predicted int, row string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    collected = []
    real = type(docs).collect
    type(docs).collect = lambda self: collected.append(real(self)) or collected[-1]
    try:
        sizer, w = compression.learn_quality(docs, labels, 3, 1, -1, compression.DICT_BYTES)
    finally:
        type(docs).collect = real
    assert max(map(len, collected)) <= 200
    out = compression.score_quality(docs, labels)
    assert out.columns == ["doc_id", "text", "row", "held_out", "score", "predicted"] and out.count() == len(rows)
    for r in out.where("doc_id >= 4 OR doc_id IS NULL").collect():
        t = (r["text"] or "").encode()
        lo, hi = brute_sizes(sizer.contents, t, -1)
        left = min(min(lo, hi) / (len(t) + 20), 1.0)
        x = [1, (lo - hi) / (lo + hi + 20), left, left * left, math.log1p(len(t)) / 10]
        assert math.isclose(r["score"], 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, w)))), rel_tol=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.5) and (r["doc_id"] is None or r["doc_id"] >= 500 or r["predicted"] == r["doc_id"] % 2)


def test_empty_tables(spark):
    none = docs_of(spark, [])
    labels, items = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id string, text string")
    some = docs_of(spark, [(1, "a b c"), (2, None)])
    vectors, pages = spark.createDataFrame([], "vec_id long, embedding array<float>"), spark.createDataFrame([], "page_id long, url string")
    found = [
        simhash.simhash_groups(none), simhash.dedup_near(none), mixing.mix(none), licenses.scan_licenses(none), decontam.contaminated(none, items), decontam.contaminated(some, items),
        compression.identify_languages(none), topk.top_k(vectors), tokens.count_tokens(none, [b"a"]), substring.dedup_substrings(none), urls.filter_urls(pages), compression.score_quality(none, labels),
    ]
    assert [df.count() for df in found] == [0] * len(found)
    assert decontam.decontaminate(some, items).count() == 2
    assert [r["predicted"] for r in compression.score_quality(some, labels).collect()] != []
