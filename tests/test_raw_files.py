"""Raw files and content-keyed ids, streams of raw files, exact cuts with
repeated keys, explanations, pinned fixed values."""

import os
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threatlens import schema as S
from threatlens.operators import canonical as C
from threatlens.operators import features as FE
from threatlens.operators import model as MD
from threatlens.operators import sampling as SP
from threatlens.operators import scoring as SC
from threatlens.sources import files as IO
from threatlens.streaming.streams import canonicalize_files_stream


def folder(name):
    return tempfile.mkdtemp(prefix=f"tl-{name}-")


def sms_ids(spark, path):
    return sorted(r.message_id for r in C.canonical_sms(
        C.parse_labeled_lines(IO.read_labeled_lines(spark, path)), key_col="line_key").collect())


def test_line_ids_do_not_depend_on_files_or_splits(spark):
    lines = [f"ham\tmessage {i % 40}" for i in range(300)] + ["spam\tmessage 1", " ham\tmessage 1"]
    one, many = folder("one"), folder("many")
    with open(os.path.join(one, "a.txt"), "w") as f:
        f.write("\n".join(lines) + "\n")
    for k in range(3):
        with open(os.path.join(many, f"{k}.txt"), "w") as f:
            f.write("\n".join(lines[k::3]) + "\n")
    first = sms_ids(spark, one)
    assert len(set(first)) == len(lines) and first == sms_ids(spark, many)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        assert first == sms_ids(spark, one)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_copies_are_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(IO, "COPY_BLOCK", 10)
    rows = [("a", 1)] * 35 + [("b", None)] * 10 + [(None, 2)] * 11 + [("c", 3)]
    got = IO.number_copies(spark.createDataFrame(rows, "x string, y int")).collect()
    want = Counter((x, y, k) for (x, y), n in Counter(rows).items() for k in range(n))
    assert Counter((r.x, r.y, r.copy_no) for r in got) == want
    assert IO.number_copies(spark.createDataFrame([], "x string")).count() == 0


def test_equal_phishing_rows_have_their_own_ids(spark):
    rows = [("a@b.c", None, "d", "s", "text", 1)] * 3 + [(None, "a@b.c", "d", "s", "text", 1), ("a@b.c", None, "d", "s", None, 1),
                                                        ("a@b.c", None, "d", "s", "  ", 1), ("x@y.z", None, "d", "s", "text", 0)]
    df = IO.number_copies(C.filter_label(spark.createDataFrame(rows, S.PHISHING_CSV_SCHEMA)))
    assert C.canonical_phishing(df).select("message_id").distinct().count() == 6


@pytest.mark.parametrize("kind", ["sms", "phishing"])
def test_streams_of_raw_files_replay_to_the_same_ids(spark, kind):
    src, runs = folder(kind), []
    if kind == "sms":
        for k in range(2):
            with open(os.path.join(src, f"{k}.txt"), "w") as f:
                f.write("ham\tsame\nham\tsame\nspam\twin now\nno label\n")
    else:
        rows = spark.createDataFrame([("a@b.c", "d@e.f", None, "s", 'two "lines"\nhere', 1)] * 2 + [("a", "b", None, "s", "t", 0)], S.PHISHING_CSV_SCHEMA)
        IO.write_table(rows.coalesce(1), src, fmt="csv")
    for _ in range(2):
        out = folder("out")
        canonicalize_files_stream(spark, kind, src, out, folder("ckpt"), null_value=IO.CSV_NULL).awaitTermination()
        runs.append(sorted(r.message_id for r in spark.read.parquet(out).collect()))
    assert runs[0] == runs[1] and len(set(runs[0])) == len(runs[0]) == (6 if kind == "sms" else 2)
    with pytest.raises(ValueError, match="unknown kind"):
        canonicalize_files_stream(spark, "fax", src, folder("out"), folder("ckpt"))


def test_cuts_stay_exact_when_keys_repeat(spark):
    rows = [(f"k{i % 7}", i, i % 2) for i in range(70)]
    df = spark.createDataFrame(rows, "key string, i int, g int")
    for n in (0, 1, 13, 20, 70, 99):
        assert SP.sample_n(df, n, "key").count() == min(n, 70)
    per = SP.smallest_by_hash(df, "key", {0: 12, 1: 0}, "g").where("selected").groupBy("g").count().collect()
    assert {r.g: r["count"] for r in per} == {0: 12}
    order = sorted({r[0] for r in rows}, key=lambda k: __import__("hashlib").md5(f"42|{k}".encode()).hexdigest())
    assert {r.key for r in SP.sample_n(df, 20, "key").collect()} == set(order[:2])
    assert SP.sample_n(df.limit(0), 5, "key").count() == 0


def test_terms_are_counted_per_row(spark):
    docs = spark.createDataFrame([("a", "win win cash"), ("a", "win"), ("b", None), ("c", "")], "id string, t string")
    got = Counter((r.id, r.term, r.tf) for r in FE.term_counts(docs, "id", "t").collect())
    assert got == Counter([("a", "win", 2), ("a", "cash", 1), ("a", "win win", 1), ("a", "win cash", 1), ("a", "win", 1)])


def test_explanations_name_the_strongest_terms(spark, monkeypatch):
    v = spark.createDataFrame([("win", 1.0, 2.0), ("cash", 1.0, 2.0), ("lunch", 1.0, -3.0), ("prize", 1.0, 1.0)], "term string, idf double, coef double")
    msgs = spark.createDataFrame([(0, "prize win lunch"), (1, "lunch"), (2, None), (3, "win cash cash")], "id int, text string")

    def run():
        s = SC.score_messages(msgs, MD.LinearModel(v, 0.0), channel_col=None, mode_col=None, include_explanation=True, explain_terms=2)
        return {r.id: r.explanations for r in s.collect()}

    want = {0: ["win", "prize"], 1: [], 2: [], 3: ["cash", "win"]}
    assert run() == want
    monkeypatch.setattr(MD, "MAX_DICTIONARY_BYTES", 0)   # the long path
    assert run() == want


def test_two_logit_model(spark):
    def make():
        import numpy as np

        return lambda texts: np.array([[0.0, float(len(t)) - 3.0] for t in texts])

    m = SC.SecondModel(make, logits=True)
    raw = spark.createDataFrame([("abc",), ("abcdef",)], "t string").select(m.raw(F.col("t")).alias("r"))
    got = raw.select(m.probability(F.col("r")).alias("p"), m.label(F.col("r")).alias("y")).collect()
    assert [(round(r.p, 6), r.y) for r in got] == [(0.5, 0), (0.952574, 1)]


def test_fixed_values_are_pinned():
    assert S.RISK_TIERS + [(None, S.RISK_TIER_TOP)] == [(0.2, "Low"), (0.5, "Medium"), (0.8, "High"), (None, "Critical")]
    assert S.MODE_THRESHOLDS == {"balanced": 0.95, "high_recall": 0.5, "low_fp": 0.95}
    assert (S.DEFAULT_FIRST_WEIGHT, S.DEFAULT_SECOND_WEIGHT, S.WEIGHT_TOLERANCE) == (0.4, 0.6, 0.001)
    assert (S.MAX_CHAR_LENGTH, S.MAX_REQUEST_CHARS, S.MAX_BATCH) == (10000, 50000, 100)
    assert (S.TEST_SIZE, S.RANDOM_STATE, S.VOCAB_SIZE_V1, S.VOCAB_SIZE_V2, S.MIN_DF, S.MAX_DF) == (0.2, 42, 20000, 30000, 2, 0.95)
    assert S.MAIL_TACTIC_ORDER == ["authority", "urgency", "fear", "reward"] and [t for t, _ in S.SMS_TACTICS] == ["urgency", "fear", "reward"]
    assert [len(S.MAIL_TACTIC_KEYWORDS[t]) for t in S.MAIL_TACTIC_ORDER] == [14, 15, 14, 12]
    assert S.REQUIRED_FIELDS == ["clean_text", "attack_label", "channel"] and len(S.CANONICAL_COLUMNS) == 14
