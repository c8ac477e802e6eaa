"""Counts of terms over slices of texts, TF-IDF rows, and cleaning against Python's ``re``."""

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from conftest import col1
from threatlens.functions import text as X
from threatlens.operators import features as FE
from threatlens.operators import model as MD

TEXTS = ["to be or not to be", "To be, to be; x yy", None, "", "one", "é日本 日本 __ a1 a1 a1", "be to be", "not to be or not"]


def _grams(text):
    tok = re.findall(r"\w{2,}", (text or "").lower())
    return tok + [f"{a} {b}" for a, b in zip(tok, tok[1:])]


def _docs(spark):
    return spark.createDataFrame([(k % 6, t, (0, 1, None)[k % 3]) for k, t in enumerate(TEXTS * 40)], "id int, t string, y int")


def test_term_stats_equal_counts_by_text(spark, monkeypatch):
    want = defaultdict(lambda: [0, 0, 0, 0])
    for r in _docs(spark).collect():
        for g, n in Counter(_grams(r.t)).items():
            want[g] = [a + b for a, b in zip(want[g], (1, n, int(r.y == 1), int(r.y == 0)))]
    monkeypatch.setattr(FE, "SLICE_ROWS", 3)
    for size in (1, 50, 1 << 21):
        monkeypatch.setattr(FE, "SLICE_TOKENS", size)
        got = FE.term_stats(_docs(spark), "t", "y").collect()
        assert {r.term: [r.df, r.total_tf, r.df_pos, r.df_neg] for r in got} == want and len(got) == len(want)
    assert FE.term_stats(_docs(spark).where("t is null"), "t", "y").collect() == []


def test_each_term_is_shuffled_once_a_slice_and_not_once_a_text(spark):
    docs = _docs(spark).coalesce(1)
    plan = FE.term_stats(docs, "t", "y")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_tfidf_rows_by_dictionary_equal_the_long_form(spark):
    docs = _docs(spark)
    vocab = MD.vocab_of(FE.term_stats(docs, "t", "y"), docs.count(), 10, 1, 1.0)
    model = MD.fit_log_odds(vocab)
    want = FE.tfidf(FE.term_counts(docs, "id", "t"), vocab)
    key = lambda df: Counter((r.id, r.term, round(r.weight, 9)) for r in df.select("id", "term", "weight").collect())
    assert key(MD.tfidf_weights(docs, "id", "t", model)) == key(want)
    norms = MD.tfidf_weights(docs, "id", "t", model).groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert norms and all(math.isclose(r.n, 1.0) for r in norms)


def test_cleaning_equals_python_re(spark):
    parts = ["a", "é", " ", "  ", "\t", "\r\n", "\r", "\n", "\n\n\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　", "日", "​"]
    texts = [a + b + c + d for a in parts for b in parts for c in ("", "x", "\n", " ") for d in ("", "\t\n y", " \xa0\n\n\n\n z  w ")]

    def body(t):
        t = re.sub(r"\n{3,}", "\n\n", re.sub(r"\r\n?", "\n", t))
        lines = re.sub(r"[ \t]+", " ", t).split("\n")
        return "\n".join(x.strip() for x in lines).strip() or None

    assert col1(spark, texts, X.clean_mail_body) == [body(t) for t in texts]
    assert col1(spark, texts, X.collapse_ws) == [re.sub(r"\s+", " ", t).strip(" ") for t in texts]
    words = lambda t: F.array_join(FE.tokens(F.col(t)), "|")
    assert col1(spark, texts + TEXTS, words) == [None if t is None else "|".join(re.findall(r"\w{2,}", t.lower())) for t in texts + TEXTS]
