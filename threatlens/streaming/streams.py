"""Structured Streaming jobs over arriving message files.

* ``score_stream``: requests land as parquet files; each micro-batch is
  validated (rejects to their own table) and scored with the batch plan
  (``foreachBatch``; output path keyed by the batch id, so a replayed batch
  overwrites itself: idempotent under failure and restart).
* ``canonicalize_stream``: numbered label/text lines -> canonical SMS rows; a
  stateless projection, written in append mode. Message ids are md5 keys,
  so a replay produces the same ids.
* ``canonicalize_files_stream``: raw label/text files or phishing CSV files ->
  canonical rows. A file belongs to one micro-batch, and ids follow from file,
  content and copy number, so they do not depend on how files are batched.

All use a checkpoint location and ``availableNow`` by default (process
what is there, then stop); pass ``processing_time`` for a standing query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..operators import canonical as C
from ..operators import quality as Q
from ..operators import scoring as SC
from ..operators.model import LinearModel
from ..sources import files as IO

REQUEST_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("mode", T.StringType()),
])

LINE_SCHEMA = T.StructType([
    T.StructField("line_no", T.LongType()),
    T.StructField("value", T.StringType()),
])


def _trigger(writer, processing_time: str | None):
    return writer.trigger(processingTime=processing_time) if processing_time else writer.trigger(availableNow=True)


def score_stream(spark: SparkSession, source_dir: str, model: LinearModel, out_dir: str, rejects_dir: str,
                 checkpoint_dir: str, second: SC.SecondModel | None = None, processing_time: str | None = None,
                 schema: T.StructType = REQUEST_SCHEMA):
    src = spark.readStream.schema(schema).parquet(source_dir)

    def each_batch(df: DataFrame, batch_id: int) -> None:
        v = Q.validate_requests(df).persist()   # read by both writes
        ok = v.where("accepted").select("id", "text", F.col("channel_norm").alias("channel"),
                                        F.col("mode_norm").alias("mode"))
        scored = SC.score_messages(ok, model, second=second)
        scored.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
        (v.where(~F.col("accepted")).select("id", F.array_join("violations", "; ").alias("violations"))
          .write.mode("overwrite").parquet(f"{rejects_dir}/batch_id={batch_id}"))
        v.unpersist()

    w = src.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint_dir)
    return _trigger(w, processing_time).start()


def canonicalize_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint_dir: str,
                        processing_time: str | None = None, schema: T.StructType = LINE_SCHEMA):
    src = spark.readStream.schema(schema).parquet(source_dir)
    canon = C.canonical_sms(C.parse_labeled_lines(src))
    w = (canon.writeStream.format("parquet").outputMode("append").option("path", out_dir)
         .option("checkpointLocation", checkpoint_dir))
    return _trigger(w, processing_time).start()


def _raw_lines(spark: SparkSession, source_dir: str) -> DataFrame:
    return spark.readStream.text(source_dir).select(F.col("_metadata.file_path").alias("file"), "value")


def _phishing_rows(spark: SparkSession, source_dir: str, null_value: str) -> DataFrame:
    rows = IO.csv_options(spark.readStream, S.PHISHING_CSV_SCHEMA, null_value=null_value).csv(source_dir)
    return rows.select(F.col("_metadata.file_path").alias("file"), *S.PHISHING_CSV_SCHEMA.names)


def canonicalize_files_stream(spark: SparkSession, kind: str, source_dir: str, out_dir: str, checkpoint_dir: str,
                              processing_time: str | None = None, null_value: str = ""):
    """``kind``: 'sms' (label/text lines) or 'phishing' (CSV with a header). Each
    micro-batch writes its own folder, so a replay overwrites itself."""
    if kind not in ("sms", "phishing"):
        raise ValueError(f"unknown kind of file: {kind}")
    src = _raw_lines(spark, source_dir) if kind == "sms" else _phishing_rows(spark, source_dir, null_value)

    def each_batch(df: DataFrame, batch_id: int) -> None:
        if kind == "sms":
            rows = C.canonical_sms(C.parse_labeled_lines(IO.keyed_lines(df)), key_col="line_key")
        else:
            rows = C.canonical_phishing(IO.number_copies(C.filter_label(df)))
        rows.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    w = src.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint_dir)
    return _trigger(w, processing_time).start()
