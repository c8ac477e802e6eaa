"""Steps that must not put the work of a large table into one task, or do it again."""

import glob

import pytest
from pyspark.sql import functions as F

from threatlens.operators import model as MD
from threatlens.plans import fixture as FX
from threatlens.plans import modelling as ML
from threatlens.plans import queries as Q
from threatlens.session import ship_package


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents in one row group of one file, and their labels."""
    folder = tmp_path_factory.mktemp("tables")
    n = 600
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit('call "now",\n'), F.repeat(F.md5(F.col("id").cast("string")), 20)).alias("text"),
                                 F.lit("en").alias("lang"), F.lit("web").alias("source"))
    docs.coalesce(1).write.parquet(str(folder / "documents.parquet"))
    labels = spark.range(0, n, 3).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"), (F.col("id") % 6 == 0).cast("long").alias("toxic"))
    labels.coalesce(1).write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def _rows_per_partition(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_rows_of_one_row_group_are_dealt_to_all_cores(spark, tables):
    """F7 to F11, F13, F17, F19: more splits than cores, but all rows in one of them."""
    keys = {"spark.sql.files.maxPartitionBytes": "1024", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        docs = spark.read.parquet(f"{tables}/documents.parquet")
        cores = spark.sparkContext.defaultParallelism
        assert docs.rdd.getNumPartitions() > cores and len(_rows_per_partition(docs)) == 1
        held = _rows_per_partition(FX.spread(docs))
        assert sum(held) == 600 and max(held) * cores <= 2 * 600
        even = docs.repartition(2 * cores)
        assert FX.spread(even) is even
        none = docs.where("doc_id < 0")
        assert FX.spread(none).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_evaluations_read_written_scores(spark):
    """F2, F6: the test fold is scored once, not in every pass of the evaluation."""
    split = spark.createDataFrame([(str(i), f"good word{i % 3} bad{i % 2}", "sms", i % 2, "test" if i % 4 < 2 else "train") for i in range(40)],
                                  "id string, clean_text string, channel string, y int, fold string")
    vocab = spark.createDataFrame([("bad0", 0, 1.0, -1.0, 20), ("bad1", 1, 1.0, 1.0, 20)], "term string, idx int, idf double, coef double, df long")
    m = MD.LinearModel(vocab, 0.5)
    f = ML.Fitted(split, 20, m, logistic=m, stepped=m)
    wanted = sorted(tuple(r) for r in MD.predict(split.where("fold = 'test'"), "clean_text", m).select("id", "y", "decision", "prob", "pred").collect())
    for read, name in ((lambda: ML.logistic_predictions(f), "logistic-predictions"),
                       (lambda: ML.stepped_predictions(f, Q.GRADIENT_STEPS, Q.GRADIENT_RATE), "stepped-predictions")):
        p = read()
        assert p is read() and all(name in x for x in p.inputFiles()) and p.inputFiles()
        assert sorted(tuple(r) for r in p.collect()) == wanted and len(wanted) == 20


def test_compared_models_score_the_test_fold_once(spark, monkeypatch):
    """F2: the second model scores the fold in one written step, not in every pass of the three evaluations."""
    preds = spark.createDataFrame([(str(i), f"urgent word{i % 3}", i % 2, i / 20, int(i > 10)) for i in range(20)],
                                  "id string, clean_text string, y int, prob double, pred int")
    monkeypatch.setattr(ML, "fit", lambda *_: None)
    monkeypatch.setattr(ML, "trained_second_model", lambda _: Q.keyword_model())
    monkeypatch.setattr(Q, "_test_preds", lambda *_: preds)
    out = Q.QUERIES["compare_trained_models"](spark, "")
    assert out.inputFiles() and all("compared-scores" in x for x in out.inputFiles())
    assert "EvalPython" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.model for r in out.collect()) == ["contextual", "ensemble", "tfidf"]


def test_a_text_is_normed_once_in_the_fit(spark, monkeypatch):
    """the norm of a text is not summed again for each of its terms."""
    from pyspark.sql.readwriter import DataFrameWriter

    from threatlens.operators import features as FE

    docs = spark.createDataFrame([(str(i), f"good word{i % 3} bad{i % 2} word{i % 5}", i % 2) for i in range(20)], "id string, clean_text string, y int")
    vocab = MD.fit_vocab(FE.term_counts(docs, "id", "clean_text", carry=("y",)), 20, vocab_size=None, min_df=1, max_df=1.0)
    plans, write = [], DataFrameWriter.parquet

    def seen(self, path, *a, **b):
        if "logistic-features" in path:
            plans.append(self._df._jdf.queryExecution().optimizedPlan().toString().lower())
        return write(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    MD.fit_logistic(docs, vocab, max_iter=2)
    assert len(plans) == 1 and "sqrt(aggregate" in plans[0] and "/ sqrt(aggregate" not in plans[0]
    got = docs.select(MD._unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), MD._unit(F.array().cast("array<double>")).alias("none")).first()
    assert got.u == [0.6, 0.8] and got.none == []


def test_a_large_archive_is_written_by_many_tasks(spark, tables, tmp_path, monkeypatch):
    """several files, each of a bounded size, with the rows of the mail table."""
    ship_package(spark)
    written = str(tmp_path / "archive")
    monkeypatch.setattr(Q, "scratch_path", lambda *_: written)
    monkeypatch.setattr(Q, "ARCHIVE_FILE_BYTES", 100_000, raising=False)
    rows = sorted(map(str, Q.QUERIES["mail_csv_splits"](spark, tables).collect()))
    assert len(glob.glob(f"{written}/*.csv")) >= 4
    assert rows == sorted(map(str, Q.QUERIES["mail_canonical"](spark, tables).collect())) and rows
