"""Sources, sinks and the response projections."""

import os
import tempfile

import pytest

from threatlens.operators import canonical as C
from threatlens.operators import scoring as SC
from threatlens.operators.model import LinearModel
from threatlens.sources import files as IO


def test_load_many_missing_is_fatal(spark):
    d = tempfile.mkdtemp(prefix="tl-io-")
    spark.range(3).write.parquet(f"{d}/a")
    got = IO.load_many(spark, {"a": f"{d}/a"})
    assert got["a"].count() == 3
    with pytest.raises(FileNotFoundError, match="'b'"):
        IO.load_many(spark, {"a": f"{d}/a", "b": f"{d}/missing"})


def test_read_labeled_lines_newlines_and_bad_utf8(spark):
    d = tempfile.mkdtemp(prefix="tl-lines-")
    with open(os.path.join(d, "sms.txt"), "wb") as f:
        f.write(b"ham\tfirst\r\nspam\tWIN cash now\rham\tbad \xff byte\nnotab\n")
    lines = IO.read_labeled_lines(spark, d)
    p = C.parse_labeled_lines(lines)
    got = sorted((r.label, r.message) for r in p.where("accepted").collect())
    assert got == [("ham", "bad � byte"), ("ham", "first"), ("spam", "WIN cash now")]
    assert lines.select("line_key").distinct().count() == 4


def test_predictions_csv_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="tl-pred-") + "/p"
    df = spark.createDataFrame([(1, 1, 0.75), (0, 1, 0.5), (0, 0, None)], "y int, pred int, prob double")
    IO.write_predictions(df, d, fmt="csv")
    back = sorted(tuple(r) for r in IO.read_predictions(spark, d, fmt="csv").collect())
    assert back == sorted([(1, 1, 0.75), (0, 1, 0.5), (0, 0, None)], key=lambda t: (t[0], t[1], t[2] or 0))


def test_api_projections_and_explanations(spark):
    v = spark.createDataFrame([("win", 1.0, 2.0)], "term string, idf double, coef double")
    m = LinearModel(v, 0.0, 1)
    msgs = spark.createDataFrame([(0, "win", "sms", "balanced")], "id int, text string, channel string, mode string")
    s = SC.score_messages(msgs, m, include_explanation=True)
    r = s.first()
    assert r.explanations == [] and (r.timestamp.endswith("Z") or "+" in r.timestamp)
    assert SC.api_single(s).columns == ["probability", "risk_tier", "mode", "channel", "is_malicious", "roberta_enabled"]
    assert SC.api_batch(s).columns == ["probability", "risk_tier", "is_malicious"]
    rec = SC.audit_records(s).first().value
    assert '"text_length":3' in rec and '"mode":"balanced"' in rec
