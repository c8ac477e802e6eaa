"""Seeded exact samples and stratified splits, defined by md5 order.

"The k rows of a group with the smallest md5(seed, key)" is computed
without sorting a whole group in one task:

1. every row gets a hash and a hash-prefix bucket (2^20 buckets);
2. a histogram (group, bucket) -> count is aggregated (partial aggregation,
   so a hot group costs nothing extra);
3. a running sum over that small histogram finds, per group, the bucket
   where the k-th row falls and how many rows of it are still needed;
4. the hashes of that one bucket (about n / 2^20 per group) are counted and
   summed the same way: the k-th hash is known exactly.

The cut hashes of few groups (classes) come back as scalars, so the mark is the
narrow expression ``hash <= cut``: no join, no window over rows. Those of many
groups are joined.

Rows that share the cut's key are told apart the same way by a hash of their whole
content. Rows equal in that are copies: they are counted per partition, offsets
follow from these counts, and only local numbers are made (two-level ranks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..session import written
from .ordinals import with_ordinals

BUCKET_HEX = 5  # 16^5 = 2^20 buckets
LITERAL_GROUPS = 1000             # groups whose values are constants of the plan; those of more are joined
BROADCAST_BYTES = 8 << 20


def hash_key(key: Column, seed: int = S.RANDOM_STATE) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def _bucket(h: Column) -> Column:
    return F.conv(F.substring(h, 1, BUCKET_HEX), 16, 10).cast("bigint")


def _with_values(d: DataFrame, table: DataFrame, group: str | None, fields: list[str]) -> DataFrame:
    """Adds each group's ``fields`` of ``table`` (one row per group) to the rows of ``d``; null for groups
    without a row there."""
    rows = table.limit(LITERAL_GROUPS + 1).collect()
    if len(rows) <= LITERAL_GROUPS:
        for f in fields:
            value = F.lit(None).cast(table.schema[f].dataType)
            for r in rows:
                here = F.lit(True) if group is None else F.col(group).eqNullSafe(F.lit(r[group]))
                value = F.when(here, F.lit(r[f])).otherwise(value)
            d = d.withColumn(f, value)
        return d
    table = written(table.select(F.col(group).alias("_group"), *fields), "group-values")
    size = table.agg(F.sum(F.coalesce(F.octet_length(F.col("_group").cast("string")), F.lit(0)) + 100)).first()[0]
    return d.join(F.broadcast(table) if size <= BROADCAST_BYTES else table, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")


def _cut(counts: DataFrame, order: str, group: str | None) -> DataFrame:
    """Per group the first value of ``order`` at which the running count reaches ``_k``: (group, order,
    _take = how many of its rows, _of = that it has). ``counts``: group, order, _n, _k."""
    part = Window.partitionBy(*([group] if group else []))
    run = F.sum("_n").over(part.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    k = F.least(F.col("_k"), F.sum("_n").over(part))
    cut = counts.withColumn("_incl", run).withColumn("_least", k).where(
        (F.col("_incl") - F.col("_n") < F.col("_least")) & (F.col("_least") <= F.col("_incl")))
    return cut.select(*([group] if group else []), order, (F.col("_least") - F.col("_incl") + F.col("_n")).alias("_take"), F.col("_n").alias("_of"))


def _first_copies(rows: DataFrame, group: str | None, out: str) -> DataFrame:
    """Marks ``_take`` of each group's rows, which are copies of one another."""
    gcols = [group] if group else []
    rows = written(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "copies")
    by = Window.partitionBy(*gcols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)   # one row per partition
    before = rows.groupBy(*gcols, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(by), F.lit(0)))
    before = before.select("_before", F.col("_part").alias("_p"), *[F.col(g).alias("_g") for g in gcols])
    same = F.col("_part") == F.col("_p")
    if group:
        same = same & F.col(group).eqNullSafe(F.col("_g"))
    local = F.row_number().over(Window.partitionBy(*gcols, "_part").orderBy("_at"))
    return rows.withColumn("_local", local).join(before, same).withColumn(
        out, F.col("_before") + F.col("_local") <= F.col("_take")).drop("_p", "_g", "_part", "_at", "_local", "_before")


def _smallest(d: DataFrame, group: str | None, keys: list[Column], out: str) -> DataFrame:
    """Marks the ``_k`` rows of each group that come first by ``keys`` (hashes; the later decide on ties)."""
    gcols = [group] if group else []
    d = d.withColumn("_h", keys[0])
    buckets = d.groupBy(*gcols, "_k", _bucket(F.col("_h")).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    cut = _cut(buckets, "_b", group)
    edge = _with_values(d.select(*gcols, "_h"), cut.select(*gcols, F.col("_b").alias("_cut"), F.col("_take").alias("_k")), group, ["_cut", "_k"])
    hashes = edge.where(_bucket(F.col("_h")) == F.col("_cut")).groupBy(*gcols, "_k", "_h").agg(F.count(F.lit(1)).alias("_n"))
    last = written(_cut(hashes, "_h", group).withColumnRenamed("_h", "_last"), "cut-hashes")
    d = _with_values(d, last, group, ["_last", "_take", "_of"])
    upto = F.coalesce(F.col("_h") <= F.col("_last"), F.lit(False))
    if not last.where("_take < _of").head(1):
        return d.withColumn(out, upto).drop("_h", "_last", "_take", "_of")
    tied = F.coalesce((F.col("_h") == F.col("_last")) & (F.col("_take") < F.col("_of")), F.lit(False))
    some = d.where(tied).drop("_h", "_last", "_of")
    if len(keys) > 1:
        some = _smallest(some.drop("_k").withColumnRenamed("_take", "_k"), group, keys[1:], out)
    else:
        some = _first_copies(some, group, out).drop("_take")
    return d.where(~tied).withColumn(out, upto).drop("_h", "_last", "_take", "_of").unionByName(some)


def smallest_by_hash(df: DataFrame, key: str, k, group: str | None = None,
                     seed: int = S.RANDOM_STATE, out: str = "selected") -> DataFrame:
    """Marks (``out``) the ``k`` rows of each group with the smallest hash of ``key``; rows that
    share it by a hash of their content; of equal rows any.

    ``k`` is an int (min(k, group size) per group), a dict group value -> k, or a table
    (group, _k). Any number of groups; null is a group of its own.
    """
    content = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    if isinstance(k, dict):
        spark = df.sparkSession
        k = spark.createDataFrame([(g, int(n)) for g, n in k.items()], df.select(group, F.lit(0).cast("long").alias("_k")).schema)
    d = df.withColumn("_k", F.lit(int(k)).cast("long")) if isinstance(k, int) else _with_values(df, k, group, ["_k"])
    d = d.withColumn("_k", F.coalesce("_k", F.lit(0).cast("long")))
    return _smallest(d, group, [hash_key(F.col(key), seed), content], out).select(*df.columns, out)


def sample_n(df: DataFrame, n: int, key: str, seed: int = S.RANDOM_STATE) -> DataFrame:
    """Exactly min(n, rows) rows, reproducible across partitionings."""
    return smallest_by_hash(df, key, n, None, seed).where("selected").drop("selected")


def test_counts(class_counts: list[tuple[int, int]], test_size: float = S.TEST_SIZE) -> dict[int, int]:
    """Test rows per class: total ceil(test_size * n), split by class share
    with floors and the largest remainders (tie -> smaller class value)."""
    import math

    n = sum(c for _, c in class_counts)
    n_test = math.ceil(test_size * n)
    base, rem = {}, []
    for cls, c in class_counts:
        base[cls] = (n_test * c) // n
        rem.append((-((n_test * c) % n), cls))
    left = n_test - sum(base.values())
    for _, cls in sorted(rem)[:left]:
        base[cls] += 1
    return base


def _test_table(counts: DataFrame, label: str, test_size: float) -> DataFrame:
    """(label, _k): ``test_counts`` for any number of classes."""
    import math

    n = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    n_test = math.ceil(test_size * n)
    whole = F.col("_n").cast("decimal(19,0)") * F.lit(n_test)
    parts = counts.withColumn("_k", F.expr(f"cast(_n as decimal(19,0)) * {n_test} div {max(n, 1)}")).withColumn("_rest", whole % F.lit(max(n, 1)))
    left = n_test - parts.agg(F.coalesce(F.sum("_k"), F.lit(0))).first()[0]
    numbered = with_ordinals(parts, [F.desc("_rest"), F.col(label)], "_at")
    return numbered.select(label, (F.col("_k") + (F.col("_at") < left).cast("long")).alias("_k"))


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = S.TEST_SIZE,
                     seed: int = S.RANDOM_STATE) -> DataFrame:
    """Adds ``fold`` ('train' / 'test'): per class, the rows with the smallest
    md5(seed, key) form the test fold; class shares kept exactly."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    rows = counts.limit(LITERAL_GROUPS + 1).collect()
    if len(rows) <= LITERAL_GROUPS:
        k = test_counts([(r[0], r[1]) for r in rows], test_size)
    else:
        k = _test_table(written(counts, "class-counts"), label, test_size)
    marked = smallest_by_hash(df, key, k, label, seed, out="_test")
    return marked.withColumn("fold", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def class_distribution(df: DataFrame, label: str = "y") -> DataFrame:
    """Per fold and class: count and the balanced weight n / (2 * n_c) within the fold."""
    c = df.groupBy("fold", label).agg(F.count(F.lit(1)).alias("count"))
    tot = F.sum("count").over(Window.partitionBy("fold"))
    k = F.count(F.lit(1)).over(Window.partitionBy("fold"))
    return c.withColumn("weight", F.round(tot / (k * F.col("count")), 9))


def class_weights(train: DataFrame, label: str = "y") -> DataFrame:
    """(label, weight) with weight = n / (n_classes * n_c), scikit 'balanced'."""
    c = train.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return c.select(label, (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c"))).alias("weight"))


def first_sample(df: DataFrame, by: str, order: str) -> DataFrame:
    """First row (by ``order``) of each ``by`` value."""
    cols = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.min_by(F.struct(*cols), F.col(order)).alias("r")).select(by, "r.*")
