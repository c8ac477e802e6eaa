"""CSV records of files of any size, dealt to many tasks.

A record may hold line ends inside quotes, so whether a line begins a record depends
on all quotes before it. Two passes over the splits tell: the first counts quotes per
split, and the running sums of these counts say which splits begin inside a quoted
field; the second groups each split's lines into records. Records that go over the
end of a split are put together from their parts. Spark's CSV functions read the fields.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

SPLITS_PER_SCAN = 100_000        # splits whose state one scan takes along

# kinds of assembled text: a whole record, the rest of one that began before the split, one that goes on after it
WHOLE, REST, OPEN = 0, 1, 2


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _assemble(rows: DataFrame) -> DataFrame:
    """(file, split, kind, first, text): records and parts of records of each split, in a narrow pass.
    ``rows``: file, split, inside (the split begins inside quotes), value as bytes."""

    def run(batches):
        import pyarrow as pa

        names = ["file", "split", "kind", "first", "text"]
        types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]

        def lines():
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    yield from zip(*[b.column(i).slice(at, 1024).to_pylist() for i in range(4)])

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 5, types)], names=names)

        found, held = [], 0
        for (file, split), group in itertools.groupby(lines(), key=lambda r: r[:2]):
            parts, quoted, began, first = [], None, True, split == 0
            for _, _, inside, value in group:
                if quoted is None:
                    quoted, began = inside, not inside
                parts.append(value)
                held += len(value)
                quoted ^= value.count(b'"') % 2 == 1
                if not quoted:
                    found.append((file, split, WHOLE if began else REST, first, b"\n".join(parts)))
                    parts, began, first = [], True, False
                if held > 4 << 20:
                    yield out(found)
                    found, held = [], 0
            if parts:
                found.append((file, split, OPEN if began else REST, first, b"\n".join(parts)))
        yield out(found)

    return rows.mapInArrow(run, "file string, split long, kind int, first boolean, text binary")


def csv_records(spark: SparkSession, path, header: bool) -> DataFrame | None:
    """(record): every record's text without its line end, header records left out; None if a file's
    quotes do not add up, so that lines do not tell where records begin."""
    lines = _lines(spark, path)
    n_quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    splits = written(lines.groupBy("file", "split").agg((F.sum(n_quotes) % 2).alias("odd")), "csv-splits")
    if splits.groupBy("file").agg((F.sum("odd") % 2).alias("odd")).where("odd = 1").head(1):
        return None
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    state = written(splits.select("file", "split", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside")), "csv-state")
    scans = max(1, -(-state.count() // SPLITS_PER_SCAN))
    out = None
    for k in range(scans):
        mine = F.pmod(F.xxhash64("file"), F.lit(scans)) == k
        some = lines.where(mine).join(F.broadcast(state.where(mine)), ["file", "split"]).select(
            "file", "split", "inside", F.col("value").cast("binary").alias("value"))
        part = _assemble(some)
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("file").orderBy("split", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = out.where(F.col("kind") != WHOLE).withColumn("record", F.sum((F.col("kind") == OPEN).cast("int")).over(order))  # two rows a split at most
    joined = parts.groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("split", "kind", "text"))).alias("parts"), F.max("first").alias("first")).select(
        "first", F.array_join(F.transform("parts", lambda p: p["text"].cast("string")), "\n").alias("record"))
    whole = out.where(F.col("kind") == WHOLE).select("first", F.col("text").cast("string").alias("record")).unionByName(joined)
    keep = F.lit(True) if not header else ~F.col("first")
    return whole.where(keep).select(F.regexp_replace("record", r"\r\z", "").alias("record")).where("record <> ''")


def larger_than_a_split(spark: SparkSession, path) -> bool:
    """Whether some file below ``path`` is larger than a split (files are listed, not read)."""
    sizes = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    return (sizes or 0) > _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))


def _bytes(setting: str) -> int:
    number = setting.strip().lower().removesuffix("b")
    for unit, power in (("k", 10), ("m", 20), ("g", 30), ("t", 40)):
        if number.endswith(unit):
            return int(number[:-1]) << power
    return int(number)


def fields(records: DataFrame, schema: T.StructType, options: dict) -> DataFrame:
    """The records' fields by Spark's CSV parser."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = F.from_csv("record", ddl, {**options, "multiLine": "true", "lineSep": "\n", "header": "false"})
    return records.select(parsed.alias("r")).select("r.*")
