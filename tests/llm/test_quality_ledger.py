import re
from collections import Counter

from threatlens.llm import quality_ledger as Q

from .conftest import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    windows = list(zip(w, w[1:], w[2:]))
    n = Counter(windows)
    covered = {p for i, x in enumerate(windows) if n[x] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def as_tuple(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)


def test_measurements_match_brute_force(spark):
    docs = documents(spark)
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    assert {r.doc_id: as_tuple(r) for r in Q.build_ledger(docs).collect()} == want


def test_hazards(hazards):
    want = Counter((r.doc_id, *brute(r.text)) for r in hazards.collect())
    got = Q.apply_policy(Q.build_ledger(hazards)).collect()
    assert Counter((r.doc_id, *as_tuple(r)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_empty_table(no_rows):
    assert Q.apply_policy(Q.build_ledger(no_rows)).collect() == []


def test_overlapping_and_split_windows(spark):
    cases = ["a b c a b c", "a a a a", "a a a", "a b c x a b c", "a b", "a b c d e a b c d e q", "x y z q x y z x y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in Q.build_ledger(df).collect()}
    assert got == {i: brute(t)[4] for i, t in enumerate(cases)}


def test_policies_and_ablations_use_stored_bits(spark):
    ledger = spark.createDataFrame([(1, 0), (2, 1), (3, 4), (4, 5), (5, 16)], "doc_id long, fail_bits long")
    kept = {p: {r.doc_id for r in Q.apply_policy(ledger, p).collect() if r.kept} for p in Q.POLICIES}
    assert kept == {"base": {1, 3, 5}, "v1": {1, 5}, "v2": {1}}
    got = {r.rule: (r.failing, r.failing_alone, r.kept, r.kept_without) for r in Q.ablations(ledger, "v1").collect()}
    assert got == {"too_few_words": (2, 1, 2, 3), "repeated_words": (0, 0, 2, 2), "symbols": (2, 1, 2, 3)}


def test_no_python_in_the_plan(spark):
    plan = Q.build_ledger(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clean_documents_stay(spark):
    docs, labels = documents(spark, sf="/root/testdata/sf0.01"), documents(spark, "labels", "/root/testdata/sf0.01")
    got = Q.apply_policy(Q.build_ledger(docs)).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((1, False), 0) == 0
    assert n.get((0, True), 0) <= 0.1 * sum(v for (q, _), v in n.items() if q == 0)
