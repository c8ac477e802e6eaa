"""Split, sampling, TF-IDF, metrics: checked against brute force on small data."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatlens.operators import evaluate as EV
from threatlens.operators import features as FE
from threatlens.operators import model as MD
from threatlens.operators import sampling as SP


def md5_key(k, seed=42):
    return hashlib.md5(f"{seed}|{k}".encode()).hexdigest()


def test_test_counts_largest_remainder():
    assert SP.test_counts([(0, 800), (1, 200)]) == {0: 160, 1: 40}
    c = SP.test_counts([(0, 7), (1, 3)])
    assert sum(c.values()) == math.ceil(0.2 * 10) and c == {0: 1, 1: 1}


@pytest.mark.parametrize("parts", [1, 7])
def test_stratified_split_exact_and_partition_independent(spark, parts):
    rows = [(f"id{i:04d}", int(i % 9 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id string, y int").repartition(parts)
    got = {r.id: r.fold for r in SP.stratified_split(df, "y", "id").collect()}
    k = SP.test_counts([(0, sum(1 for _, y in rows if y == 0)), (1, sum(1 for _, y in rows if y == 1))])
    for cls in (0, 1):
        ids = sorted((i for i, y in rows if y == cls), key=lambda i: (md5_key(i), i))
        assert {i for i in ids[:k[cls]]} == {i for i in ids if got[i] == "test"}


def test_sample_n_exact(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(300)], "k string").repartition(5)
    got = {r.k for r in SP.sample_n(df, 37, "k").collect()}
    want = set(sorted((f"k{i}" for i in range(300)), key=md5_key)[:37])
    assert got == want
    assert SP.sample_n(df, 1000, "k").count() == 300


def brute_auc(ys, ps):
    pos = [p for y, p in zip(ys, ps) if y == 1]
    neg = [p for y, p in zip(ys, ps) if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


@pytest.mark.parametrize("n,ranges", [(5, 1024), (400, 16), (400, 1)])
def test_roc_auc_matches_pairs(spark, n, ranges):
    rnd = random.Random(n)
    if n == 5:
        ys, ps = [1, 0, 1, 0, 1], [0.9, 0.9, 0.3, 0.2, 0.1]
    else:
        ys = [rnd.randint(0, 1) for _ in range(n)]
        ps = [round(rnd.random(), 2) for _ in range(n)]   # many ties
    df = spark.createDataFrame(list(zip(ys, ps)), "y int, prob double")
    got = EV.roc_auc(df, ranges=ranges).first().roc_auc
    assert got == pytest.approx(brute_auc(ys, ps), abs=1e-12)


def test_sweep_matches_101_passes(spark):
    rnd = random.Random(3)
    ps = [i * 0.01 for i in range(101)] + [np.nextafter(i * 0.01, 2) for i in range(101)] + \
         [np.nextafter(i * 0.01, -1) for i in range(1, 101)] + [rnd.random() for _ in range(300)]
    ys = [rnd.randint(0, 1) for _ in ps]
    df = spark.createDataFrame([(y, float(p)) for y, p in zip(ys, ps)], "y int, prob double")
    sw = {r.step: r for r in EV.threshold_sweep(df).collect()}
    for i in range(101):
        t = i * 0.01
        tp = sum(1 for y, p in zip(ys, ps) if p >= t and y == 1)
        fp = sum(1 for y, p in zip(ys, ps) if p >= t and y == 0)
        assert (sw[i].tp, sw[i].fp) == (tp, fp)
        assert sw[i].tp + sw[i].fp + sw[i].fn + sw[i].tn == len(ps)
    recalls = [sw[i].recall for i in range(101)]
    assert all(a >= b for a, b in zip(recalls, recalls[1:]))


def test_sweep_keeps_rows_without_a_score(spark):
    df = spark.createDataFrame([(1, 0.9), (0, None), (1, None), (0, float("nan")), (1, -0.5)], "y int, prob double")
    for r in EV.threshold_sweep(df).collect():
        assert (r.tp + r.fn, r.fp + r.tn) == (3, 2) and r.tp == (1 if r.step <= 90 else 0)


def test_a_vocabulary_may_keep_all_terms(spark):
    docs = spark.createDataFrame([("a", "x1 y1 z1"), ("b", "x1 y1")], "id string, t string")
    tf = FE.term_counts(docs, "id", "t").withColumn("y", F.lit(0))
    assert MD.fit_vocab(tf, 2, vocab_size=None, min_df=1, max_df=1.0).count() == 5


def test_best_thresholds_ties_lowest(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.8), (0, 0.2)], "y int, prob double")
    best = {r.criterion: r.step for r in EV.best_thresholds(EV.threshold_sweep(df)).collect()}
    assert best["min_false_negatives"] == 0 and best["max_f1"] == 21 and best["recall_at_least_99"] == 21
    assert best["default_050"] == 50


def test_confusion_and_report_zero_division(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "y int, pred int")
    m = EV.class_metrics(EV.confusion(df)).first()
    assert (m.tn, m.fp, m.fn, m.tp, m.precision, m.recall, m.f1) == (1, 0, 2, 0, 0.0, 0.0, 0.0)
    rep = {r.label: r for r in EV.classification_report(df).collect()}
    assert rep["accuracy"].f1 == pytest.approx(1 / 3) and rep["Benign"].support == 1


def test_tfidf_weights_are_unit_norm_and_sublinear(spark):
    docs = spark.createDataFrame([("a", "spam spam spam ham"), ("b", "ham eggs"), ("c", "spam eggs eggs")],
                                 "id string, t string")
    tf = FE.term_counts(docs, "id", "t", carry=())
    tf = tf.withColumn("y", F.lit(0))
    vocab = MD.fit_vocab(tf, 3, vocab_size=100, min_df=1, max_df=1.0)
    w = FE.tfidf(tf.drop("y"), vocab).groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n2")).collect()
    assert all(abs(r.n2 - 1) < 1e-12 for r in w)
    idf = {r.term: r.idf for r in vocab.collect()}
    assert idf["spam"] == pytest.approx(math.log(4 / 3) + 1)
    a = {r.term: r.weight for r in FE.tfidf(tf.drop("y"), vocab).where("id = 'a'").collect()}
    raw = {"spam": (1 + math.log(3)) * idf["spam"], "ham": idf["ham"], "spam spam": (1 + math.log(2)) * idf["spam spam"],
           "spam ham": idf["spam ham"]}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert a == pytest.approx({k: v / norm for k, v in raw.items()})


def test_top_by_count_order(spark):
    rows = [("b", 5), ("a", 5), ("c", 9), ("d", 1), ("e", 5)]
    df = spark.createDataFrame(rows, "term string, total_tf long")
    assert [r.term for r in MD.top_by_count(df, 3).collect()] == ["c", "a", "b"]


def test_logistic_fit_is_stationary(spark):
    """Gradient of the C=1, balanced, L2 objective vanishes at Spark's solution."""
    rnd = random.Random(1)
    words = ["win", "cash", "now", "meet", "lunch", "report", "prize", "team"]
    rows = []
    for i in range(120):
        y = int(i % 4 == 0)
        pool = words[:3] + ["prize"] if y else words[3:6] + ["team"]
        rows.append((f"d{i}", " ".join(rnd.choice(pool) for _ in range(6)) + " " + rnd.choice(words), y))
    docs = spark.createDataFrame(rows, "id string, text string, y int")
    tf = FE.term_counts(docs, "id", "text", carry=("y",))
    vocab = MD.fit_vocab(tf, len(rows), vocab_size=1000, min_df=1, max_df=1.0)
    m = MD.fit_logistic(docs, vocab, "text")
    coef = {r.term: r.coef for r in m.vocab.collect()}
    terms = sorted(coef)
    W = {(r.id, r.term): r.weight for r in FE.tfidf(tf.drop("y"), vocab).collect()}
    X = np.array([[W.get((d, t), 0.0) for t in terms] for d, _, _ in rows])
    y = np.array([r[2] for r in rows])
    n, n1 = len(y), y.sum()
    sw = np.where(y == 1, n / (2 * n1), n / (2 * (n - n1)))
    w = np.array([coef[t] for t in terms])
    p = 1 / (1 + np.exp(-(X @ w + m.intercept)))
    grad_w = w + X.T @ (sw * (p - y))
    grad_b = np.sum(sw * (p - y))
    assert np.max(np.abs(grad_w)) < 1e-4 and abs(grad_b) < 1e-4


def small_corpus(spark, n=160, seed=4):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        y = int(i % 3 == 0)
        rows.append((f"d{i}", " ".join(rnd.choice(words[:25] if y else words[10:]) for _ in range(rnd.randint(0, 12))), y))
    docs = spark.createDataFrame(rows, "id string, clean_text string, y int").repartition(5)
    tf = FE.term_counts(docs, "id", "clean_text", carry=("y",))
    return docs, MD.fit_vocab(tf, n, vocab_size=None, min_df=1, max_df=1.0)


def test_the_fit_with_tables_is_the_fit_with_a_dictionary(spark, monkeypatch):
    docs, vocab = small_corpus(spark, 90)
    held = MD.fit_logistic(docs, vocab, tol=1e-14)
    monkeypatch.setattr(MD, "MAX_DICTIONARY_BYTES", 10)
    monkeypatch.setattr(FE, "BROADCAST_VOCAB_BYTES", 10)
    monkeypatch.setattr(MD.LG, "HOT_PARTS", 30)
    tabled = MD.fit_logistic(docs, vocab, tol=1e-10)
    want, got = ({r.term: r.coef for r in m.vocab.collect()} for m in (held, tabled))
    assert set(want) == set(got) and max(abs(want[t] - got[t]) for t in want) < 1e-6
    assert abs(held.intercept - tabled.intercept) < 1e-6
    assert MD.largest_gradient(docs, tabled).first().gradient < 1e-9
    a, b = ({r.id: r.prob for r in MD.predict(docs, "clean_text", m).collect()} for m in (held, tabled))
    assert max(abs(a[i] - b[i]) for i in a) < 1e-6


def test_gradient_steps_against_numpy(spark):
    docs, vocab = small_corpus(spark, 60, 5)
    rows = sorted(docs.collect())
    terms = sorted((r.idx, r.term) for r in vocab.collect())
    tf = FE.term_counts(docs, "id", "clean_text")
    at = {(r.id, r.term): r.weight for r in FE.tfidf(tf, vocab).collect()}
    x = np.array([[at.get((r.id, t), 0.0) for _, t in terms] for r in rows])
    y = np.array([r.y for r in rows])
    n, n1 = len(y), y.sum()
    c, w, b = np.where(y == 1, n / (2 * n1), n / (2 * (n - n1))), np.zeros(len(terms)), 0.0
    for _ in range(3):
        r = c * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w, b = w - 2.0 * (x.T @ r + w) / n, b - 2.0 * r.sum() / n
    m = MD.fit_gradient_steps(docs, vocab, 3, 2.0)
    got = {r.idx: r.coef for r in m.vocab.collect()}
    assert np.allclose([got[i] for i, _ in terms], w, atol=1e-12) and m.intercept == pytest.approx(b, abs=1e-12)


def test_ordinals(spark):
    from threatlens.operators.ordinals import with_ordinals

    rnd = random.Random(2)
    values = [(f"t{rnd.randint(0, 10 ** 6)}", i) for i in range(3000)] + [(None, 1), ("", 2)]
    got = with_ordinals(spark.createDataFrame(values, "term string, _range int").repartition(7), [F.col("term"), F.col("_range")], "at").collect()
    assert [(r.term, r["_range"]) for r in sorted(got, key=lambda r: r["at"])] == sorted(values, key=lambda v: (v[0] is not None, v[0] or "", v[1]))
    assert sorted(r["at"] for r in got) == list(range(len(values)))
    assert with_ordinals(spark.createDataFrame([], "term string"), [F.col("term")], "at").collect() == []


def test_copies_of_the_cut_key_are_told_apart_exactly(spark):
    rows = [("hot", i % 3, "same") for i in range(900)] + [(f"k{i}", i % 3, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "key string, g int, v string").repartition(7)
    got = SP.smallest_by_hash(df, "key", {0: 250, 1: 1, 2: 400}, "g").where("selected").groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {0: 250, 1: 1, 2: 400}
    a, b = (sorted(map(tuple, SP.sample_n(d, 500, "key").collect())) for d in (df, df.repartition(3)))
    assert len(a) == 500 and a == b
    assert SP.sample_n(spark.createDataFrame([(None, 1)] * 50, "key string, v int"), 20, "key").count() == 20


def test_any_number_of_groups(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(f"id{i}", rnd.choice([None, *range(40)])) for i in range(1500)]
    df = spark.createDataFrame(rows, "id string, y int").repartition(4)
    want = {r.id: r.fold for r in SP.stratified_split(df.where("y is not null"), "y", "id").collect()}
    monkeypatch.setattr(SP, "LITERAL_GROUPS", 5)
    assert {r.id: r.fold for r in SP.stratified_split(df.where("y is not null"), "y", "id").collect()} == want
    monkeypatch.setattr(SP, "BROADCAST_BYTES", -1)
    picked = SP.smallest_by_hash(df, "id", 7, "y").where("selected").groupBy("y").count().collect()
    sizes = {y: sum(1 for _, z in rows if z == y) for y in {y for _, y in rows}}
    assert {r.y: r["count"] for r in picked} == {y: min(7, n) for y, n in sizes.items()}


def test_crosstab_of_many_labels_comes_in_long_form(spark, monkeypatch):
    from collections import Counter

    from threatlens.operators import quality as Q

    rnd = random.Random(7)
    rows = [(rnd.choice(["sms", "email", None]), rnd.choice([None, *[f"l{i}" for i in range(30)]])) for _ in range(400)]
    monkeypatch.setattr(Q, "MAX_CROSSTAB_COLUMNS", 20)
    got = {(r[0], r[1]): r[2] for r in Q.crosstab_margins(spark.createDataFrame(rows, "channel string, attack_label string")).collect()}
    pairs = [p for p in rows if None not in p]
    want = Counter(pairs) + Counter(("All", c) for _, c in pairs) + Counter((r, "All") for r, _ in pairs) + Counter({("All", "All"): len(pairs)})
    assert got == dict(want)
