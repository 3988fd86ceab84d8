"""op11 to op13 against brute force on small fixtures with nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from proofmill.llm import divergence, resample, rules

DOCS = "doc_id long, text string, lang string, source string, n long, rank string, value int, kept string, score string, `a.b` int"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def table(spark, rows):
    """Rows ``(doc_id, text, lang, source)`` with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 1, "x", 2, "y", "z", 3) for r in rows], DOCS)


def lists(df):
    return sorted(map(tuple, df.collect()), key=repr)


# op11


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, marked = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            marked.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def brute_kind(c):
    import unicodedata

    if c in " \t\n\v\f\r":
        return None
    if c in "#*$%&|<>":
        return 5
    if c in ".,;:!?'\"()-":
        return 4
    name = unicodedata.category(c)
    return {"Ll": 0, "Lu": 1, "Lt": 1}.get(name, {"L": 2, "M": 2, "N": 3, "P": 6, "S": 6}.get(name[0], 7) if name != "Me" else 7)


def brute_histograms(text):
    kinds = Counter(k for c in text if (k := brute_kind(c)) is not None)
    return [kinds[i] for i in range(8)], Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER)))


def brute_js(p, q, n):
    a, b = sum(p) or 1, sum(q) or 1
    kl = lambda x, y: sum(u * math.log2(u / v) for u, v in zip(x, y) if u)
    p, q = [x / a for x in p], [x / b for x in q]
    m = [(x + y) / 2 for x, y in zip(p, q)]
    square = max(0.0, (kl(p, m) + kl(q, m)) / 2)
    return math.sqrt(max(0.0, square - 1.5 * len(p) / (8 * max(n, 1) * math.log(2))))


def rule_rows():
    rng = random.Random(11)
    rows = [(1, None, "xx", "s"), (2, "", "xx", "s"), (3, " \n\t", None, None), (None, "one two", "xx", None)]
    for i in range(90):
        lang = ("xx", "yy", None)[i % 3]
        common = {"xx": "the of and to in", "yy": "der die das und zu"}.get(lang, "de la el que y").split()
        words = [rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(5, 300))]
        kind = i % 10
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        elif kind == 1:
            words = [w + "$$$" for w in words]
        elif kind == 2:
            words = [w for w in words if w not in common]
        text = " ".join(w + ("\n" if rng.random() < 0.1 else "") for w in words)
        if kind == 3:
            text += "\nsame line here\nsame line here\n"
        if kind == 4:
            text = (" ".join(words[:9]) + " ") * 6 + text
        rows.append((i + 10, text, lang, "s"))
    rows += [rows[-1], (500, "word " * 200_000, "xx", "s"), (501, "x" * 300_000 + " " + " ".join(f"Ünï{i}" for i in range(60)), "yy", "s")]
    return rows


@pytest.mark.parametrize("counters", [rules.COUNTERS, 50])
def test_op11_brute_force(spark, counters):
    rows = rule_rows()
    got = lists(rules.check_quality(table(spark, rows), language_docs=8, counters=counters))
    seen = defaultdict(lambda: (np.zeros(8), Counter(), [0]))
    for _, text, lang, _ in rows:
        n, chars, symbols, dup, repeated = brute_base(text)
        if lang and not (n < 20 or 100 * repeated > 30 * n) and 100 * symbols <= chars and not dup:
            classes, words = brute_histograms(text)
            seen[lang][0].__iadd__(classes)
            seen[lang][1].update(words)
            seen[lang][2][0] += 1
    known = {k: v for k, v in seen.items() if v[2][0] >= 8}
    assert set(known) == {"xx", "yy"}
    want = []
    for doc_id, text, _, _ in rows:
        base = brute_base(text)
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        best = None
        if not failed and base[0] >= 50:
            classes, words = brute_histograms(text)
            for lang in sorted(known):
                ref, counts, _ = known[lang]
                common = sorted(counts, key=lambda w: (-counts[w], w.encode()))[:20]
                own, its = [words[w] for w in common], [counts[w] for w in common]
                own, its = own + [sum(words.values()) - sum(own)], its + [sum(counts.values()) - sum(its)]
                found = (lang, brute_js(classes, list(ref), sum(classes)), brute_js(own, its, sum(words.values())))
                if best is None or max(found[1:]) < max(best[1:]) - 1e-12:
                    best = found
        kept = not failed and (best is None or max(best[1:]) <= 0.25)
        want.append((doc_id, *base, failed, kept, *(best or (None, None, None))))
    key = lambda r: repr(r[:9])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:9] == w[:9] and g[9:] == pytest.approx(w[9:], abs=1e-9), (g, w)
    by_kept = Counter(g[7] for g in got)
    assert by_kept[True] > 20 and by_kept[False] > 20


def test_op11_without_references(spark):
    text = "plain words " * 3 + " ".join(f"w{i}" for i in range(60))
    got = lists(rules.check_quality(table(spark, [(1, text, None, None), (2, "few", "xx", None)])))
    assert [(r[0], r[6], r[7], r[8]) for r in got] == [(1, False, True, None), (2, True, False, None)]
    assert rules.check_quality(table(spark, [])).count() == 0


# op12


def audit_rows():
    rng = random.Random(12)
    rows = [(1, None, None, None), (2, "", "", ""), (3, "7 8 9", "zz", "only"), (4, "éa A b", "xx", None), (5, "one", "solo", "s0")]
    for i in range(200):
        lang = ("xx", "xx", "xx", "yy", None)[i % 5]
        source = ("hot", "hot", "ä", "b", None, "c")[i % 6]
        words = [f"{'Ab'[rng.randrange(2)]}{chr(97 + int(rng.expovariate(0.3)) % 26)}{'é' * rng.randrange(2)}" for _ in range(rng.randrange(0, 40))]
        rows.append((i, ",".join(words) if i % 2 else " 12 ".join(words), lang, source))
    rows += [rows[30]] * 12 + [(900, "rareword " * 500, "xx", "hot"), (901, "abcabcab" * 1000, "yy", "b")]
    return rows


def brute_audit(rows):
    groups, having, counts = set(), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups.add((lang, source))
        having[lang].update(set(words))
        counts[lang, source].update(words)
        counts[lang,].update(words)
    out = []
    for lang, source in groups:
        kept = [t for t, n in having[lang].items() if n >= 10]
        whole = lambda g: sum(counts[g][t] for t in kept) + 2 * len(kept)
        wholes = {g: whole(g) for g in [(lang,), *(x for x in groups if x[0] == lang)]}
        p = lambda g, t: 1 + 1_000_000_000 * (counts[g][t] + 2) // wholes[g]
        f = lambda x, y: (x - y) ** 2 // (x + y)
        own = (lang, source)
        pair = [(sum(f(p(own, t), p(g, t)) for t in kept), g[1]) for g in groups if g[0] == lang and g != own]
        term = [(f(p(own, t), p((lang,), t)), t) for t in kept if counts[own][t] and p(own, t) > p((lang,), t)]
        for part, found, most in (("pair", pair, None), ("term", term, 10)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bounds", [{}, {"counters": 30, "container": 50, "term_rows": 20, "pairs": 3}])
def test_op12_brute_force(spark, bounds):
    rows = audit_rows()
    want = brute_audit(rows)
    assert {r[2] for r in want} == {"pair", "term"} and len(want) > 60
    assert lists(divergence.audit_sources(table(spark, rows), **bounds)) == want


def test_op12_sql_says_the_same(tmp_path, spark):
    rows = audit_rows()
    table(spark, rows).select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/d")
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
        assert sorted(con.sql(divergence.ORACLE).fetchall(), key=repr) == brute_audit(rows)


def test_op12_empty(spark):
    assert divergence.audit_sources(table(spark, [])).count() == 0


def test_op12_shares_of_large_counts():
    count, whole = np.array([0, 5, 10**12, 9 * 10**14]), np.array([10**12, 7, 10**12 + 4, 9 * 10**14 + 2])
    assert divergence.share(count, whole).tolist() == [1 + 10**9 * (c + 2) // w for c, w in zip(count.tolist(), whole.tolist())]


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_op12_containers_hold_the_trie(depth):
    rng = random.Random(3)
    leaves = {"".join(rng.choice("abcé字") for _ in range(rng.randrange(1, 9))).encode(): [(f"s{i}", rng.randrange(1, 9)) for i in rng.sample(range(5), rng.randrange(1, 5))] for _ in range(900)}
    terms = sorted(leaves)
    source, n = (np.array(x) for x in zip(*((int(s[1:]), n) for t in terms for s, n in leaves[t])))
    batch = divergence.containers("xx", terms, np.arange(len(terms)), np.array([len(leaves[t]) for t in terms]), [f"s{i}" for i in range(5)], source, n, depth)
    got, docs = {}, []
    for _, prefix, rest, docs_of, sizes, names, at, count in divergence.opened(batch):
        docs += docs_of.tolist()
        counters = iter([(names[i], k) for i, k in zip(at, count)])
        got |= {prefix + t: [next(counters) for _ in range(size)] for t, size in zip(rest, sizes)}
    assert list(got.items()) == sorted(leaves.items()) and docs == list(range(len(terms)))
    assert batch.column("prefix").to_pylist() == sorted({t[:depth] for t in terms})


# op13


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(x.encode()) % 10000 for x in runs]


def brute_resample(rows, items, percent=25):
    docs = [(r[0], *brute_features(r[1])) for r in rows]
    s, t = Counter(b for d in docs for b in d[2]), Counter(b for x in items for b in brute_features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for doc_id, n, found in docs:
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def resample_rows():
    rng = random.Random(13)
    rows = [(1, None, None, None), (2, "", "", ""), (-5, "a b", "xx", None), (3, "~" * 50, "xx", None)]
    for i in range(150):
        rows.append(((i * 2654435761) % 2**62 * (-1) ** i, " ".join(f"W{rng.randrange(60)}é" for _ in range(rng.randrange(0, 80))), "xx", "s"))
    same = " ".join(f"w{i}" for i in range(30))
    return rows + [(77, same, "xx", "s")] * 40 + [(None, same, "xx", "s")] * 3 + [(78, f"long {same} " * 3000, "xx", "s")]


@pytest.mark.parametrize("percent", [0, 1, 10, 25, 60, 100])
def test_op13_brute_force(spark, percent):
    rows, items = resample_rows(), [None, "", "w1é w2é w3é", "w1é w2é", "W5é w6é w7é w8é"]
    target = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "item_id long, text string")
    assert lists(resample.resample(table(spark, rows), target, percent)) == brute_resample(rows, items, percent)


def test_op13_ties_are_drawn_one_by_one(spark):
    rows, items = resample_rows(), ["w1 w2"]
    target = spark.createDataFrame([(1, items[0])], "item_id long, text string")
    fit = [r for r in brute_resample(rows, items, 100) if r[4]]
    first = min(r[4] for r in fit if r[0] == 77)
    percent = next(p for p in range(1, 100) if first < p * len(fit) // 100 < first + 39)
    got = lists(resample.resample(table(spark, rows), target, percent))
    assert got == brute_resample(rows, items, percent) and 0 < sum(r[0] == 77 and r[4] is not None for r in got) < 40


def test_op13_kth_key(spark):
    rng = random.Random(4)
    rows = [(rng.choice((-(2**63), -1, 0, 1, 2**63 - 1, 70000)), rng.randrange(-3, 3)) for _ in range(300)]
    df, order = spark.createDataFrame(rows, "a long, b long"), sorted(rows)
    for k in (1, 2, 100, 150, 299, 300):
        key = order[k - 1]
        assert resample.kth(df, ["a", "b"], k) == (key, order.index(key), order.count(key))


def test_op13_slices_and_empty(spark, monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(500)).encode()
    whole = sorted(np.concatenate(list(resample.features(text))).tolist())
    slices = resample.text_slices
    monkeypatch.setattr(resample, "text_slices", lambda t: slices(t, 7))
    assert sorted(np.concatenate(list(resample.features(text))).tolist()) == whole == sorted(brute_features(text.decode())[1])
    empty = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(table(spark, []), empty).count() == 0
    assert lists(resample.resample(table(spark, resample_rows()), empty)) == brute_resample(resample_rows(), [])
