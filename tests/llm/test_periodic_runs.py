"""Periodic runs against a scan of every period, and the planted tails against plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from threatlens.llm import periodic_runs as PR
from threatlens.llm.queries import QUERIES

from .conftest import SF, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, min_length=12):
    """Every period, every maximal stretch in which words q apart agree."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def random_words(rng):
    kind = rng.random()
    if kind < 0.4:
        return [rng.randint(0, rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 120))]
    if kind < 0.8:
        out = []
        for _ in range(rng.randint(1, 6)):
            unit = [rng.randint(0, rng.choice([1, 2, 9])) for _ in range(rng.randint(1, 12))]
            out += (unit * rng.randint(1, 12))[:rng.randint(1, 80)]
        return out
    a, b = [0], [0, 1]
    while len(b) < rng.randint(5, 150):
        a, b = b, b + a
    return b + b[::-1] if rng.random() < 0.5 else b


@pytest.mark.parametrize("min_length", [2, 3, 5, 9, 12, 30])
def test_runs_equal_the_scan_of_every_period(min_length):
    rng = random.Random(min_length)
    for _ in range(60):
        docs = [random_words(rng) for _ in range(rng.randint(1, 5))]
        flat = [w for d in docs for w in d]
        if not flat:
            continue
        got = list(zip(*(x.tolist() for x in PR.find_runs(flat, [len(d) for d in docs], min_length))))
        assert got == [(i, *r) for i, d in enumerate(docs) for r in brute_runs(d, min_length)]


def test_two_halves_that_meet_in_many_squares():
    words = [0, 1] * 40 + [1, 0] * 40
    got = list(zip(*(x.tolist() for x in PR.find_runs(words, [len(words)], 12))))
    assert [r[1:] for r in got] == brute_runs(words)
    assert len(got) > 20


def test_operator_on_hazards(spark, hazards):
    rows = PR.periodic_runs(hazards, ["doc_id"]).collect()
    assert len(rows) == hazards.count()
    by = sorted(((r["doc_id"] or -1, r["text"]) for r in hazards.collect()), key=str)
    got = sorted(((r["doc_id"] or -1, [(x["start"], x["length"], x["period"]) for x in r["runs"]], r["collapsed"])
                  for r in rows), key=str)
    want = []
    for i, t in by:
        words = WORD.findall(t or "")
        runs = brute_runs(words) if len(words) < 3000 else None
        want.append((i, runs, words))
    assert sorted(str(i) for i, *_ in got) == sorted(str(i) for i, *_ in want)
    for i, runs, words in want:
        if runs is not None:
            assert any(g[0] == i and g[1] == runs and g[2] == collapse(words, runs) for g in got)


def test_very_long_texts_of_one_word_and_of_blanks(spark):
    rows = [(1, "a " * 500_000), (2, " " * 3_000_000), (3, "x" * 3_000_000), (4, "\n" * 100 + "ab cd " * 100_000)]
    got = {r["doc_id"]: r for r in PR.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 500_000, 1)] and got[1]["collapsed"] == "a"
    assert got[2]["n_words"] == 0 and got[2]["collapsed"] == ""
    assert got[3]["runs"] == [] and got[3]["collapsed"] == "x" * 3_000_000
    assert [tuple(x) for x in got[4]["runs"]] == [(0, 200_000, 2)] and got[4]["collapsed"] == "ab cd"


def test_empty_table(spark):
    assert PR.periodic_runs(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).collect() == []


def test_planted_tail(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(None, "a b"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = df.select("doc_id", "text", PR.with_planted_tail(F.col("text"), F.col("doc_id")).alias("t")).collect()
    for r in got:
        words = WORD.findall(r["text"] or "")
        assert WORD.findall(r["t"] or "") == (words if r["doc_id"] is None else planted(r["doc_id"], words))


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    got = QUERIES["op11_periodic_runs"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        words = planted(r["doc_id"], WORD.findall(docs[r["doc_id"]] or ""))
        runs = brute_runs(words)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (best[1] * 1000 // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    assert sum(r["n_runs"] > 0 for r in got) > 10
