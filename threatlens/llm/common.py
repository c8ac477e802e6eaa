"""Column helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# ASCII white space of the word rule [^\x20\x09-\x0D]+
WS = " \t\n\x0b\x0c\r"
WS_RE = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: bound to a lambda variable
    instead of being repeated wherever the body (or an inner lambda) uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null and blank texts give []."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS_RE), "")


def n_words(text: Column) -> Column:
    """Number of words; splitting leaves an empty string only at either end."""
    t = F.coalesce(text, F.lit(""))
    lead = F.substring(t, 1, 1).isin(*WS).cast("int")
    tail = F.substring(t, -1, 1).isin(*WS).cast("int")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WS_RE)) - lead - tail).cast("long")


def doc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts the
    lineage with files that every executor reaches."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


# Rows a Python step handles at a time: bounds its lists whatever the Arrow batch holds.
SLICE_ROWS = 256
# Rows of an Arrow batch of whole texts. A batch stands in the JVM, in the worker and in the
# worker's answer at once, so Spark's own 10,000 rows are too many for long texts.
BATCH_ROWS = 1024


def text_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` rows, where the session has not chosen a number itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def map_texts(df: DataFrame, keep: list[str], text: str | list[str], out: str, factory, *args) -> DataFrame:
    """Columns ``keep`` plus the columns ``out`` (DDL) that a per-text function gives.

    ``factory(*args)`` runs once per task on the executor and returns
    f(list of texts) -> one list per output column; with several ``text``
    columns f takes one list of each. Whole texts are handed over; nulls stay None.
    """
    from pyspark.sql import types as T

    text_batches(df.sparkSession)
    new = T.StructType.fromDDL(out)
    texts = [text] if isinstance(text, str) else text
    src = df.select(*[F.col(c) for c in keep], *[F.col(c).alias(fresh(df, f"_text{i}")) for i, c in enumerate(texts)])
    schema = T.StructType([src.schema[c] for c in keep] + list(new.fields))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in new.fields]
        f = factory(*args)
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(at, SLICE_ROWS)
                cols = f(*[part.column(len(keep) + i).to_pylist() for i in range(len(texts))])
                arrays = [part.column(i) for i in range(len(keep))] + [pa.array(c, t) for c, t in zip(cols, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return src.mapInArrow(run, schema)
