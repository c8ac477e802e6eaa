"""One large CSV file over many tasks: the same rows as Spark's reader gives on the whole file."""

import csv
import io
import random

import pytest
from pyspark.sql import types as T

from threatlens.sources import csv_splits as CS
from threatlens.sources import files as IO

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("c", T.IntegerType())])


def text_of(rows, header=True):
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    if header:
        w.writerow(["a", "b\nof two lines", "c"])
    w.writerows(rows)
    return out.getvalue()


def random_rows(seed, n=120):
    rnd = random.Random(seed)
    pool = ["plain", 'a "quoted" word', "line\nline", "\n\n", '"', ",", "é ü", " pad ", "tab\t", "x" * 300, "a\r\nb", "\n" * 40 + "end", '","\n"', ""]
    return [(f"r{i}", rnd.choice(pool) + rnd.choice(pool), rnd.randint(0, 99)) for i in range(n)]


@pytest.fixture
def splits_of(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "0"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("size", [150, 1000])
def test_a_file_in_many_splits(spark, tmp_path, splits_of, size):
    (tmp_path / "one.csv").write_text(text_of(random_rows(size)), newline="")
    (tmp_path / "two.csv").write_text(text_of(random_rows(size + 1, 30)), newline="")
    want = rows_of(IO.csv_options(spark.read, SCHEMA).csv(str(tmp_path)))
    splits_of(size)
    got = IO.read_csv(spark, str(tmp_path), SCHEMA)
    assert CS.csv_records(spark, str(tmp_path), True).rdd.getNumPartitions() > 8
    assert len(want) == 150 and rows_of(got) == want


def test_several_scans_and_no_header(spark, tmp_path, splits_of, monkeypatch):
    for k in range(4):
        (tmp_path / f"{k}.csv").write_text(text_of(random_rows(k, 25), header=False), newline="")
    want = rows_of(IO.csv_options(spark.read, SCHEMA, False).csv(str(tmp_path)))
    splits_of(300)
    monkeypatch.setattr(CS, "SPLITS_PER_SCAN", 5)
    assert rows_of(IO.read_csv(spark, str(tmp_path), SCHEMA, header=False)) == want


def test_crlf_records_and_blank_lines(spark, tmp_path, splits_of):
    (tmp_path / "x.csv").write_text('a,b,c\r\n"1","x ""y""",3\r\n\r\n2,"p\nq",4\r\n3,,\r\n' * 1 + "".join(f'{i},"v{i}",{i}\r\n' for i in range(60)), newline="")
    want = rows_of(IO.csv_options(spark.read, SCHEMA).csv(str(tmp_path)))
    splits_of(100)
    assert rows_of(IO.read_csv(spark, str(tmp_path), SCHEMA)) == want


def test_quotes_that_do_not_add_up_are_left_to_the_whole_file_reader(spark, tmp_path, splits_of):
    (tmp_path / "x.csv").write_text("a,b,c\n" + "".join(f"{i},it is 5\" long,{i}\n" for i in range(61)))
    want = rows_of(IO.csv_options(spark.read, SCHEMA).csv(str(tmp_path)))
    splits_of(200)
    assert CS.csv_records(spark, str(tmp_path), True) is None
    assert rows_of(IO.read_csv(spark, str(tmp_path), SCHEMA)) == want


def test_one_record_over_many_splits(spark, tmp_path, splits_of):
    (tmp_path / "x.csv").write_text(text_of([("1", "line\n" * 400, 1), ("2", "y", 2)]), newline="")
    splits_of(128)
    assert [(r.a, r.b, r.c) for r in IO.read_csv(spark, str(tmp_path), SCHEMA).orderBy("a").collect()] == [("1", "line\n" * 400, 1), ("2", "y", 2)]


@pytest.mark.parametrize("setting,n", [("128MB", 128 << 20), ("16m", 16 << 20), ("134217728b", 134217728), ("1g", 1 << 30), ("5000", 5000)])
def test_sizes(setting, n):
    assert CS._bytes(setting) == n
