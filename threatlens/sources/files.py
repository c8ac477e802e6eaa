"""File sources and sinks: label/text lines, CSV with quoted multi-line
text, parquet; every read uses an explicit schema (never inference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from . import csv_splits as CS


COPY_BLOCK = 10_000  # copies of one row that a task numbers at a time


def number_copies(df: DataFrame, out: str = "copy_no") -> DataFrame:
    """Every row with the number (0, 1, ...) of its copy among equal rows.

    Equal rows are interchangeable, so (row, copy number) is a key that depends on
    the content alone: not on files, splits, partitions or retries. Rows are counted
    (partial aggregation, so a row repeated a billion times is no hot key) and
    written out again; rows with many copies are dealt out in blocks first.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    few = counts.where(F.col("_n") <= COPY_BLOCK).select(*cols, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias(out))
    last_block = F.floor((F.col("_n") - 1) / COPY_BLOCK).cast("long")
    blocks = counts.where(F.col("_n") > COPY_BLOCK).select(*cols, "_n", F.explode(F.sequence(F.lit(0).cast("long"), last_block)).alias("_b"))
    first = F.col("_b") * COPY_BLOCK
    many = blocks.repartition(*cols, F.col("_b")).select(
        *cols, F.explode(F.sequence(first, F.least(first + COPY_BLOCK, F.col("_n")) - 1)).alias(out))
    return few.unionByName(many)


def keyed_lines(raw: DataFrame) -> DataFrame:
    """(line_key, value) of text lines: the key is the digest of the line (with its
    file, if there is a ``file`` column) and its copy number."""
    lines = number_copies(raw.withColumn("value", F.make_valid_utf8(F.col("value"))))
    content = F.md5(F.concat_ws("\u001f", *[F.col(c) for c in raw.columns]))
    return lines.select(F.concat_ws("-", content, F.col("copy_no").cast("string")).alias("line_key"), "value")


def read_labeled_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines (LF, CRLF or lone CR end a line), invalid UTF-8 -> U+FFFD, with a
    ``line_key`` that is the same however the lines are dealt to files and splits."""
    return keyed_lines(spark.read.text(path))


CSV_NULL = "\\N"  # null marker written by ``write_table`` (keeps '' apart from null)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
             null_value: str = "") -> DataFrame:
    """CSV with quoted, multi-line fields (a quote inside is doubled).

    An empty field is null by default (external files); pass
    ``null_value=CSV_NULL`` for files written by ``write_table``. Files that fit
    a split go to one task each; if one is larger, its records are dealt to many
    tasks (``csv_splits``; records end at LF or CRLF), unless its quotes do not add up.
    """
    if CS.larger_than_a_split(spark, path):
        records = CS.csv_records(spark, path, header)
        if records is not None:
            return CS.fields(records, schema, csv_field_options(null_value))
    return csv_options(spark.read, schema, header, null_value).csv(path)


def csv_field_options(null_value: str = "") -> dict:
    return {"escape": '"', "mode": "PERMISSIVE", "nullValue": null_value}


def csv_options(reader, schema: T.StructType, header: bool = True, null_value: str = ""):
    """Batch or stream reader set up as in ``read_csv``."""
    return reader.schema(schema).option("header", header).option("multiLine", True).options(**csv_field_options(null_value))


def read_csv_named(spark: SparkSession, path: str, schema: T.StructType = S.MAIL_CSV_NAMED_SCHEMA,
                   null_value: str = "") -> DataFrame:
    """CSV read with imposed column names; a header line stays as a data row."""
    return read_csv(spark, path, schema, header=False, null_value=null_value)


def na_sentinels(df: DataFrame, columns=None) -> DataFrame:
    """Texts a pandas CSV re-read turns into missing values become null."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.select(*[F.when(~F.col(c).isin(*S.NA_SENTINELS), F.col(c)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def load_many(spark: SparkSession, sources: dict[str, str], reader=None) -> dict[str, DataFrame]:
    """Loads each named dataset; a missing path raises (fatal), naming it."""
    from pyspark.errors import AnalysisException

    reader = reader or (lambda p: spark.read.parquet(p))
    out = {}
    for name, path in sources.items():
        try:
            out[name] = reader(path)
        except AnalysisException as e:
            raise FileNotFoundError(f"dataset {name!r} not found at {path}") from e
    return out


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, header: bool = True,
                mode: str = "overwrite") -> None:
    """Parquet by default (optionally partitioned); CSV with quoted text."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        # no whitespace trimming (Spark's default trims), explicit null marker
        (w.option("header", header).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
          .option("ignoreTrailingWhiteSpace", False).option("nullValue", CSV_NULL).csv(path))
    else:
        w.format(fmt).save(path)


def write_predictions(pred: DataFrame, path: str, y: str = "y", p: str = "pred", prob: str = "prob",
                      fmt: str = "parquet") -> None:
    """(true_label, pred_label, prob_malicious) rows."""
    out = pred.select(F.col(y).cast("int").alias("true_label"), F.col(p).cast("int").alias("pred_label"),
                      F.col(prob).cast("double").alias("prob_malicious"))
    write_table(out, path, fmt)


def read_predictions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path, S.PREDICTIONS_SCHEMA, null_value=CSV_NULL)
    return spark.read.schema(S.PREDICTIONS_SCHEMA).parquet(path)


def write_audit_log(records: DataFrame, path: str) -> None:
    """JSON lines (one ``value`` string per prediction)."""
    records.select("value").write.mode("append").text(path)


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.AUDIT_SCHEMA).json(path)
