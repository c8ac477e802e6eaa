"""Corpus build, validation, mail parsing, scoring surface, streams, entry."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from threatlens import schema as S
from threatlens.operators import canonical as C
from threatlens.operators import quality as Q
from threatlens.operators import scoring as SC
from threatlens.operators.model import LinearModel
from threatlens.plans import corpus as CP
from threatlens.plans.fixture import mail_texts, message_view
from threatlens.sources import mail as ML


def test_native_mail_parse_equals_stdlib(spark):
    """Rows routed to the native path must give what the stdlib parser gives."""
    raw = mail_texts(message_view(spark, SF001))
    native = raw.where(ML.native_parse_ok(F.col("message")))
    rows = native.select("message").collect()
    assert len(rows) > 50
    parsed = {r.message: r.mail for r in ML.parse_mail(native).collect()}
    ref = ML._stdlib_parse(pd.Series([r.message for r in rows]))
    for i, r in enumerate(rows):
        got = parsed[r.message]
        for f in ("message_id", "from_addr", "to_addr", "body"):
            assert (getattr(got, f) or None) == (ref[f][i] or None), f


def test_labeled_lines_parse(spark):
    lines = spark.createDataFrame([(0, "ham\thello"), (1, " SPAM \t win now "), (2, "spam\t  "), (3, "junk\tx"),
                                   (4, "nolabel"), (5, ""), (6, "ham\ta\tb")], "line_no long, value string")
    p = C.parse_labeled_lines(lines)
    got = {r.line_no: (r.label, r.message, r.accepted) for r in p.collect()}
    assert got[1] == ("spam", "win now", True) and got[6] == ("ham", "a\tb", True)
    assert not any(got[k][2] for k in (2, 3, 4, 5))
    canon = {r.raw_text: r for r in C.canonical_sms(p).collect()}
    assert canon["win now"].manipulation_tactic == "urgency" and canon["hello"].manipulation_tactic == "none"
    assert list(C.canonical_sms(p).columns) == S.CANONICAL_COLUMNS


def test_schema_and_required_validation(spark):
    srcs = CP.canonical_sources(message_view(spark, SF001))
    with pytest.raises(Q.CorpusValidationError) as e:
        Q.build_master_corpus(srcs, strict=True)
    assert any("clean_text" in v[1] for v in e.value.violations)
    bad = srcs["sms"].select(*reversed(S.CANONICAL_COLUMNS))
    assert ("x", "column message_id is at position 14 instead of 1") in Q.schema_violations(bad, "x")
    assert Q.schema_violations(srcs["sms"].drop("language").withColumn("extra", F.lit(1)), "y") == [
        ("y", "column language is absent"), ("y", "column extra is unknown")]
    assert Q.schema_violations(srcs["sms"], "z") == []


def test_request_validation_bounds(spark):
    rows = [(0, "a" * 50000, "sms", "LOW_FP"), (1, "a" * 50001, None, None), (2, "   ", "email", "balanced"),
            (3, "ok", "fax", "bogus"), (4, "", "sms", None), (5, None, "SMS", "High_Recall")]
    v = {r.id: r for r in Q.validate_requests(spark.createDataFrame(rows, "id int, text string, channel string, mode string")).collect()}
    assert v[0].accepted and v[0].mode_norm == "low_fp"
    assert v[1].violations == ["text: at most 50000 characters"]
    assert v[2].violations == ["text: cannot be empty or whitespace only"]
    assert len(v[3].violations) == 2 and v[4].violations == ["text: at least 1 character"]
    assert v[5].violations == ["text: field required"] and v[5].channel_norm == "sms"
    item = "struct<text:string,channel:string>"
    b = spark.createDataFrame([(0, [], "balanced"), (1, [("x", None)] * 100, "balanced"),
                               (2, [("x", None)] * 101, "balanced"), (3, [("x", None), (" ", None)], None)],
                              f"batch_id int, messages array<{item}>, mode string")
    got = {r.batch_id: r.accepted for r in Q.validate_batches(b).collect()}
    assert got == {0: False, 1: True, 2: False, 3: False}
    items = Q.batch_items(b).collect()
    assert len(items) == 203 and sum(r.item_error is not None for r in items) == 1     # every item has its row


def test_repeated_ids_are_scored_by_themselves(spark):
    m = _model(spark, {"win": 2.0, "lunch": -3.0})
    msgs = spark.createDataFrame([(1, "win"), (1, "lunch lunch"), (2, "win")], "id int, text string")
    got = {r.text: r.probability for r in SC.score_messages(msgs, m, channel_col=None, mode_col=None).collect()}
    assert got == {"win": 0.8808, "lunch lunch": 0.0474}


def test_scoring_does_not_shuffle_and_matches_the_long_form(spark, monkeypatch):
    from threatlens.operators import model as MD

    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    words = spark.createDataFrame([("the", 1.5, 2.0), ("of the", 2.0, -1.0), ("la", 1.0, 0.5), ("zzz", 3.0, 1.0)], "term string, idf double, coef double")
    out = SC.score_messages(docs, LinearModel(words, 0.1), channel_col=None, mode_col=None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    narrow = {r.doc_id: r.probability for r in out.collect()}
    monkeypatch.setattr(MD, "MAX_DICTIONARY_BYTES", 0)
    long = {r.doc_id: r.probability for r in SC.score_messages(docs, LinearModel(words, 0.1), channel_col=None, mode_col=None).collect()}
    assert narrow == long and len(set(narrow.values())) > 10


def test_whole_texts_are_scored_unless_cut(spark):
    m = _model(spark, {"win": 2.0})
    msgs = spark.createDataFrame([(1, "word " * 4000 + "win")], "id int, text string")
    score = lambda **k: SC.score_messages(msgs, m, channel_col=None, mode_col=None, **k).first()
    assert score().probability > 0.5 and not score().was_truncated
    assert score(max_chars=10000).probability == 0.5 and score(max_chars=10000).was_truncated


def test_native_path_takes_ordinary_mime_mail(spark):
    head = "Message-ID: <{}@x>\nDate: Mon, 14 May 2001 16:39:00 -0700\nFrom: a@x.org\nTo: {}\n{}Subject: s\n\nbody line\n{}"
    mime = "Mime-Version: 1.0\nContent-Type: text/plain; charset={}\nContent-Transfer-Encoding: {}\n"
    native = [head.format(i, to, mime.format(cs, enc), i) for i, (to, cs, enc) in enumerate(
        [(to, cs, enc) for to in ("b@y.org", "b@y.org, c@z.org") for cs in ("us-ascii", "utf-8", "iso-8859-1") for enc in ("7bit", "8bit")])]
    native += [native[0].replace("\n", "\r\n"), head.format(99, "", "", "x"), head.format(98, "b@y.org", 'Content-Type: text/plain; charset="us-ascii"; format=flowed\n', "x")]
    coded = [head.format(50, "Bob <b@y.org>", "", "x"), head.format(51, "b@y.org", mime.format("utf-8", "quoted-printable"), "caf=C3=A9"),
             head.format(52, "b@y.org", mime.format("utf-8", "base64"), ""), head.format(53, "b@y.org", mime.format("utf-8", "8bit"), "caf\u00e9"),
             'Message-ID: <54@x>\nFrom: a@x.org\nContent-Type: multipart/alternative; boundary="q"\n\n--q\nContent-Type: text/html\n\n<b>\n--q\n'
             'Content-Type: text/plain\n\nplain\n--q--\n', "", None]
    df = spark.createDataFrame([(m,) for m in native + coded], "message string")
    ok = [r[0] for r in df.select(F.coalesce(ML.native_parse_ok(F.col("message")), F.lit(False))).collect()]
    assert ok == [True] * len(native) + [False] * len(coded)
    got = [r.mail for r in ML.parse_mail(df).collect()]
    want = ML._stdlib_parse(pd.Series(native + coded, dtype=object)).to_dict("records")
    for g, w in zip(got, want):
        assert {k: getattr(g, k) or None for k in w} == {k: (v if v is not None and v == v else None) or None for k, v in w.items()}


def test_crosstab_counts_labels_it_was_not_told(spark):
    df = spark.createDataFrame([("sms", "benign"), ("sms", "vishing"), ("email", "vishing"), ("email", None)], "channel string, attack_label string")
    got = {r.channel: r.asDict() for r in Q.crosstab_margins(df).collect()}
    assert got["All"]["All"] == 3 and got["All"]["vishing"] == 2 and got["sms"]["phishing"] == 0


def test_a_cluster_needs_a_shared_checkpoint_folder(monkeypatch):
    from threatlens import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(Conf)

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.checkpoint_root(Session())


def _model(spark, coefs, intercept=0.0):
    v = spark.createDataFrame([(t, 1.0, c) for t, c in coefs.items()], "term string, idf double, coef double")
    return LinearModel(v, intercept, len(coefs))


def test_scoring_surface(spark):
    m = _model(spark, {"win": 3.0, "cash": 2.0, "meeting": -3.0}, intercept=-0.5)
    msgs = spark.createDataFrame([
        (0, "WIN cash now", "SMS", "high_recall"), (1, "   ", "email", None), (2, None, None, "low_fp"),
        (3, "team meeting", "fax", "balanced"), (4, "win", "sms", "nope"), (5, "unrelated words", "email", "")],
        "id int, text string, channel string, mode string")
    out = {r.id: r for r in SC.score_messages(msgs, m).collect()}
    assert out[1].tfidf_score == 0.0 and out[1].risk_tier == "Low" and out[2].mode_out == "low_fp"
    p0 = 1 / (1 + np.exp(-((3 + 2) / np.sqrt(2) - 0.5)))
    assert out[0].probability == round(p0, 4) and out[0].channel_out == "sms" and out[0].is_malicious
    assert out[3].channel_out == "unknown" and not out[3].is_malicious
    assert out[4].risk_tier == "Error" and out[4].probability is None and out[4].error.startswith("Invalid mode")
    assert out[5].mode_out == "balanced" and out[5].threshold == 0.95
    assert out[5].probability == round(1 / (1 + np.exp(0.5)), 4)


def test_tiers_and_weights(spark):
    vals = [0.2, 0.5, 0.8, 0.95]
    scores = [x for v in vals for x in (np.nextafter(v, 0), v, np.nextafter(v, 1))]
    df = spark.createDataFrame([(float(s),) for s in scores], "s double")
    tiers = [r[0] for r in df.select(SC.risk_tier("s")).collect()]
    assert tiers[:6] == ["Low", "Medium", "Medium", "Medium", "High", "High"]
    assert tiers[6:9] == ["High", "Critical", "Critical"]
    with pytest.raises(ValueError):
        SC.validate_weights(0.5, 0.6)
    SC.validate_weights(0.4, 0.6)


def test_stream_equals_batch(spark):
    from threatlens.plans.queries import QUERIES

    a = sorted(map(tuple, QUERIES["stream_canonical"](spark, SF001).collect()))
    b = sorted(map(tuple, QUERIES["labeled_lines"](spark, SF001).collect()))
    assert a == b


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() == 200 and "risk_tier" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())
