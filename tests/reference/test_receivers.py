"""The match of receivers by equality lookups against a plain comparison of every name with every payee."""

import random

import pytest
from pyspark.sql import functions as F

from proofmill.functions.names import GENERIC
from proofmill.operators import receivers


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(token, part):
    k = 2 if len(token) >= 8 else 1 if len(token) >= 4 else 0
    return abs(len(token) - len(part)) <= k and distance(token, part) <= k


def fits(norm, cand):
    tokens = [t for t in norm.split(" ") if len(t) >= 3 and t not in GENERIC]
    return cand in norm or norm in cand or any(near(t, c) for t in tokens for c in cand.split(" "))


def typo(rng, word):
    for _ in range(rng.randrange(3)):
        i, letter = rng.randrange(len(word) + 1), rng.choice("abcz")
        word = rng.choice((word[:i] + word[i + 1 :], word[:i] + letter + word[i:], word[:i] + letter + word[i + 1 :]))
    return word


def made(rng, n, lenders=("A", "B", "")):
    syllables = "ka ra mo ti sen lo vi dra pe nu".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    names = [" ".join([word() for _ in range(rng.randrange(1, 4))] + rng.choice(([], ["bank"], ["finance", "ltd"]))) for _ in range(n)]
    rows = [(lender, i, i < 2, f"{name}!", name) for lender in lenders for i, name in enumerate(rng.sample(names, n // 2))]
    payees = [(rng.choice(lenders), " ".join(typo(rng, w) for w in rng.choice(names).split()[: rng.randrange(1, 4)]).strip()) for _ in range(n)]
    return rows, payees + [("A", "a"), ("A", ""), ("B", "bank"), ("C", "karamo"), ("A", "x" * 300), ("A", "kara " * 40)]


SCHEMA = "lender string, rank int, own boolean, name string, norm string"


def plain(rows, payees):
    out = set()
    for lender, cand in set(payees):
        hit = [(r[2], r[3]) for r in sorted(rows) if r[0] == lender and cand and fits(r[4], cand)]
        if hit:
            out.add((lender, cand, *(next((n for o, n in hit if o == own), None) for own in (True, False))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_payees(spark, seed):
    rows, payees = made(random.Random(seed), 60)
    got = receivers.payee_hits(spark.createDataFrame(payees, "lender string, cand string"), spark.createDataFrame(rows, SCHEMA))
    assert set(map(tuple, got.collect())) == plain(rows, payees) and got.count() > 30


def test_payees_among_many_names(spark):
    """10,000 accepted names: the pairs that are compared in full stay few."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfghjklmnpqrstvw") + rng.choice("aeiou") for _ in range(rng.randrange(3, 6)))
    rows = [("A", i, False, f"n{i}", f"{word()} {word()} finance") for i in range(10_000)]
    payees = [("A", " ".join(typo(rng, w) for w in r[4].split()[:2])) for r in rng.sample(rows, 40)] + [("A", "zzzzzzzz qqqqqq")]
    got = set(map(tuple, receivers.payee_hits(spark.createDataFrame(payees, "lender string, cand string"), spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == plain(rows, payees) and len(got) >= 39


def test_written_names(spark):
    rows = [("A", 0, True, "Own", "own name"), ("A", 1, False, "Allowed", "allowed one"), ("A", 2, False, "Later", "name"), ("B", 0, False, "Single", "solo")]
    texts = [("A", "the own name stands"), ("A", "own names"), ("A", "an allowed one"), ("B", "solo"), ("B", "soloist own name"), ("A", ""), ("A", "own name and allowed one")]
    got = receivers.written_hits(spark.createDataFrame(texts, "lender string, body string"), spark.createDataFrame(rows, SCHEMA))
    assert set(map(tuple, got.collect())) == {("A", "the own name stands", "Later"), ("A", "an allowed one", "Allowed"), ("B", "solo", "Single"), ("A", "own name and allowed one", "Allowed")}


def test_handles_in_order(spark):
    rows = [("A", 0, True, "First", "zztest corp"), ("A", 1, False, "Second", "karamo finance")]
    found = [("A", ["karamo9@upi", "pay.zztestcorp@upi"]), ("A", ["karamofin@upi"]), ("A", ["nothing@upi"]), ("A", []), ("B", ["karamo@upi"]), ("A", ["kara@upi", "karamo@x", "karamo2@x"])]
    got = receivers.handle_hits(spark.createDataFrame(found, "lender string, handles array<string>"), spark.createDataFrame(rows, SCHEMA))
    assert sorted((*r["handles"], r["handle_name"], r["handle"]) for r in got.collect()) == [
        ("kara@upi", "karamo@x", "karamo2@x", "Second", "karamo@x"), ("karamo9@upi", "pay.zztestcorp@upi", "First", "pay.zztestcorp@upi"), ("karamofin@upi", "Second", "karamofin@upi"),
    ]


def test_deletions(spark):
    got = spark.range(1).select(receivers.deleted(F.lit("abcd"), 2).alias("d"), receivers.deleted(F.lit("a"), 2).alias("e")).first()
    assert set(got["d"]) == {"abcd", "bcd", "acd", "abd", "abc", "ab", "ac", "ad", "bc", "bd", "cd"} and set(got["e"]) == {"a", ""}


def test_questions_are_asked_once_and_leads_are_not_shuffled(spark, monkeypatch):
    """Leads are read twice, whatever is matched: once for the different questions, once with the answers."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    schema = "institute_name string, doc_receiver string, doc_text string"
    rows = [("SMFG_PL", ("SMFG", "", None, "Nobody")[i % 4], ("to smfg9@upi", "smfg pl stands here", "", None)[i // 4 % 4]) for i in range(160)] + [("B", "SMFG", "x")]
    leads = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    known = spark.createDataFrame([("SMFG_PL", ["SMFG India"])], "lender string, receivers array<string>")
    plans = []
    for limit in (receivers.ANSWERS, 0):
        monkeypatch.setattr(receivers, "ANSWERS", limit)
        before = read.value
        out = receivers.with_hits(leads, known, F.col("institute_name") == "SMFG_PL")
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        got = out.collect()
        assert read.value - before == 2 * len(rows) and len(got) == len(rows)
        hit = {(r["doc_receiver"], r["doc_text"]): (r["own_name"] or r["allowed_name"], r["handle"], r["written_name"]) for r in got if r["institute_name"] == "SMFG_PL"}
        assert all(hit["SMFG", t][0] and hit["Nobody", t][0] is None for t in ("to smfg9@upi", "", None))
        assert hit["Nobody", "to smfg9@upi"][1] == "smfg9@upi" and hit["", "smfg pl stands here"][2] and hit["Nobody", "smfg pl stands here"][2] is None
        assert [tuple(r)[3:] for r in got if r["institute_name"] == "B"] == [(None,) * 5]
    assert "SortMergeJoin" not in plans[0] and "SortMergeJoin" in plans[1]
