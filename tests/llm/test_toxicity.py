import math
import random

import pytest
from pyspark.sql import functions as F

from threatlens.llm import toxicity as X
from threatlens.llm.queries import QUERIES

from .conftest import TEXTS, documents


def test_folding():
    assert X.fold("You are an 1D10T") == "you are an idiot"
    assert X.fold("іdіоt m0r0n") == "idiot moron"                  # Cyrillic look-alikes, zeros
    assert X.fold("ＳＴＵＰＩＤ st\u00adupid") == "stupid stupid"
    assert X.fold("in 2024 we paid 100 $") == "in 2024 we paid 100 $"
    assert X.fold("Réeux ÇA") == "réeux ça"


@pytest.fixture(scope="module")
def matcher():
    return X.Matcher(X.Lexicon({"idiot": 5.0, "trash": 4.0, "scum": 3.0}, frozenset({"scum"}), ("trash can",), (-3.0, 1.0, 1.0)))


def test_matches_at_word_starts_outside_exceptions(matcher):
    hits = lambda t: matcher.evidence(t)[2]
    assert hits("What idiots! Trash.") == ["idiot", "trash"]
    assert hits("nonidiot scums scum") == ["scum"]
    assert hits("the trash can, and trash") == ["trash"]
    assert hits("trash cannot") == ["trash"]
    assert hits("tr4sh 1d1ot") == ["trash", "idiot"]
    assert hits(None) == hits("") == hits(" \n") == []


def test_score_falls_with_length(matcher):
    score = lambda t: matcher.score(*matcher.evidence(t)[:2])
    assert score("you idiot") > score("you idiot " + "fine words " * 500) > score("fine words") == score(None) == score("")


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op9_toxicity"](spark, sf).join(documents(spark, "labels", sf), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_learning_ignores_held_out_labels(spark):
    docs, labels = documents(spark, sf="/root/testdata/sf0.01"), documents(spark, "labels", "/root/testdata/sf0.01")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    other = labels.withColumn("toxic", F.when(learn, F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert X.fit(docs, labels, learn) == X.fit(docs, other, learn)


def test_hazards_and_missing_labels(spark, hazards, no_rows):
    labels = documents(spark, "labels")
    empty = X.fit(hazards, labels.where("doc_id < 0"), F.lit(True))
    assert empty.stems == {}
    strange = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None), (6, 0), (8, 0)], "doc_id long, toxic int")
    lexicon = X.fit(hazards, strange, F.lit(True))
    got = X.score_toxicity(hazards, lexicon, ["doc_id"]).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert X.score_toxicity(no_rows, lexicon, ["doc_id"]).collect() == []
    assert X.fit(no_rows, labels, F.lit(True)).stems == {}


def test_stems_stand_for_longer_forms():
    rows = [("idio", 9, 4.0), ("idiot", 9, 4.1), ("idiot ", 7, 4.0), ("scum", 5, 3.0), ("scum ", 5, 3.0), ("réeux", 9, 3.0), ("réeuxa", 3, 3.5)]
    stems, whole = X.choose_stems(rows)
    assert stems == {"idiot": 4.1, "scum": 3.0, "réeux": 3.0} and whole == {"scum"}


def test_statistic(spark):
    def direct(t, c, n1, n0):
        if t * n0 <= c * n1:
            return 0.0
        n, cells = n1 + n0, ((t, t + c, n1), (c, t + c, n0), (n1 - t, n1 + n0 - t - c, n1), (n0 - c, n1 + n0 - t - c, n0))
        return 2 * sum(k * math.log(k * n / (row * col)) for k, row, col in cells if k)

    rows = [(t, c) for t in (0, 1, 5, 30, 60) for c in (0, 1, 7, 90)]
    got = spark.createDataFrame(rows, "t long, c long").select("t", "c", X.g2(F.col("t"), F.col("c"), 60, 90).alias("g")).collect()
    assert all(r.g == pytest.approx(direct(r.t, r.c, 60, 90), abs=1e-9) for r in got)


def test_many_different_toxic_words(spark):
    rnd = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    toxic = ["".join(rnd.choices(letters, k=10)) for _ in range(900)]
    clean = ["".join(rnd.choices(letters, k=10)) for _ in range(900)]
    docs = [[] for _ in range(400)]
    for words, first in ((toxic, 0), (clean, 200)):
        for w in words:
            for i in rnd.sample(range(first, first + 200), 20):
                docs[i].append(w)
    table = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(400)], "doc_id long, toxic int")
    stems = set(X.fit(table, labels, F.lit(True)).stems)
    known = lambda w: any(w[:k] in stems for k in range(1, len(w) + 1))
    assert sum(map(known, toxic)) >= 895 and sum(map(known, clean)) <= 5


def test_repeated_ids_keep_the_sample_bounded(spark):
    docs = spark.range(0, 2000, 1, 4).select("id", F.concat(F.lit("text "), F.col("id")).alias("text"))
    docs = docs.selectExpr("id as doc_id", "text").union(docs.selectExpr("cast(5 as bigint)", "'the very same'")).union(
        docs.selectExpr("cast(6 as bigint)", "text"))
    labels = spark.range(0, 2000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    got = X.labelled_sample(docs, labels, F.lit(True), per_class=100).groupBy("y").count().collect()
    assert all(60 <= r["count"] <= 140 for r in got) and len(got) == 2
    whole = X.labelled_sample(docs, labels, F.lit(True), per_class=5000).collect()     # fewer than per_class: all, once
    assert len(whole) == 2000 + 1 + 2000 - 1 and sum(r.text == "the very same" for r in whole) == 1


def naive_hits(lexicon, folded):
    """Every stem tried at every word start, every exception phrase looked up in the text."""
    n = len(folded)
    start = lambda i: i == 0 or not folded[i - 1].isalpha()
    letter = lambda i: i < n and folded[i].isalpha()
    phrases = [X.fold(p) for p in lexicon.exceptions]
    masked = [(i, i + len(p)) for i in range(n) for p in phrases if folded.startswith(p, i) and start(i) and not letter(i + len(p))]
    out = []
    for i in range(n):
        if start(i):
            for s, w in lexicon.stems.items():
                e = i + len(s)
                if folded.startswith(s, i) and not (s in lexicon.whole and letter(e)) and not any(a <= i and e <= b for a, b in masked):
                    out.append((i, e, w))
    return out


def naive_score(lexicon, text):
    folded = X.fold(text or "")
    hits = naive_hits(lexicon, folded)
    z = lexicon.curve[0]
    if hits:
        weight, words = sum(w for _, _, w in hits), len(folded.split())
        z += lexicon.curve[1] * math.log1p(200 * weight / (words + X.SMOOTH_WORDS)) + lexicon.curve[2] * math.log1p(weight)
    return 1 / (1 + math.exp(-max(-60, min(60, z)))), sorted(folded[a:b] for a, b, _ in hits)


@pytest.fixture(scope="module")
def learned(spark):
    sf = "/root/testdata/sf0.01"
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    return X.fit(documents(spark, sf=sf), documents(spark, "labels", sf), learn)


def test_scores_equal_a_plain_search(spark, learned):
    docs = documents(spark)
    more = [(10_000, "trash can, trash Trash bins trash bin idiot-proof clown nose"), (10_001, None), (10_002, " ".join(sorted(learned.stems)[:40]))]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    want = {r.doc_id: naive_score(learned, r.text) for r in docs.collect()}
    got = X.score_toxicity(docs, learned, ["doc_id"]).collect()
    assert learned.stems and any(r.hits for r in got)
    for r in got:
        score, hits = want[r.doc_id]
        assert r.score == pytest.approx(score, abs=1e-12) and sorted(r.hits) == hits and r.predicted == int(score >= 0.7)


def test_fit_does_not_depend_on_the_order_of_rows(spark, learned):
    sf = "/root/testdata/sf0.01"
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    docs = documents(spark, sf=sf).repartition(9, "text").sortWithinPartitions(F.desc("doc_id"))
    assert X.fit(docs, documents(spark, "labels", sf).repartition(5), learn) == learned


def test_columns_with_the_names_of_helpers(spark, learned):
    sf = "/root/testdata/sf0.01"
    names = ("y", "l_id", "l_hash", "id", "hash", "copy", "terms", "weight", "n", "toxic", "term", "tox", "clean", "docs", "least", "k")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    docs = documents(spark, sf=sf).select("*", *[F.lit("x").alias(c) for c in names])
    assert X.fit(docs, documents(spark, "labels", sf), learn) == learned


def test_long_texts_take_linear_time(matcher):
    import time

    t = time.time()
    assert matcher.evidence("trash can " * 300_000)[2] == []
    assert len(matcher.evidence("trash can idiot " * 150_000)[2]) == 150_000
    for one in (" ", "\n", "x", ".", "1", "!"):
        assert matcher.evidence(one * 3_000_000)[2] == []
    assert time.time() - t < 60
