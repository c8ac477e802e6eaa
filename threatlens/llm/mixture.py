"""Mixing sources to target weights with Efraimidis-Spirakis keys.

Each source gets a share of all words by its weight; what exceeds the most
epochs a source may run is dealt again to the others (a water level). Within a
source, whole epochs come first; the rest of the target is filled by weighted
sampling without replacement: every document draws an exponential key
-ln(u) / quality, and the smallest keys are taken until their prefix sum of
words meets the budget.

No source is sorted as a whole. Keys fall into ``BUCKETS`` ordered buckets, and each
of these into as many again; the running sums of the (source, bucket) totals give
the bucket in which the budget ends, then its part, and only that part's distinct
places (key, id, size, content) are ranked, each with its number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, store

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BUCKETS = 1024
SYMBOLS = "#*$%&|<>"
BROADCAST_BYTES = 8 << 20     # per-source tables up to this size are broadcast
COPIES_A_BLOCK = 10_000       # rows that one task writes of a document that repeats


def quality_weight(text: Column, size: Column) -> Column:
    """Quality in [0.5, 1]: 1 without markup symbols, falling to 0.5 at one
    symbol a word. The bounds keep the key buckets even (no bucket can expect
    more than 2 * sqrt(1 / BUCKETS) of a source's documents)."""
    t = F.coalesce(text, F.lit(""))
    symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
    return 1.0 - 0.5 * F.least(F.lit(1.0), symbols / F.greatest(size, F.lit(1)))


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """Reproducible u in (0, 1) from the id (null id: from the text): 52 bits of an md5."""
    name = F.coalesce(doc_id.cast("string"), F.md5(text.cast("binary")), F.lit(""))
    h = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(2 ** 52))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target): sources by code point, null last, weigh
    ``weights`` repeating and share ``share`` of all words; a target stops at
    ``max_epochs`` times its source's size and the excess is dealt again by
    weight. Solved in closed form: target = min(cap, weight * level), where the
    level follows from the sources in order of cap / weight. Its windows run
    over one row per source."""
    cyc = F.array(*[F.lit(int(w)) for w in weights])
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.get(cyc, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")))
    cap = F.lit(max_epochs) * F.col("source_size")
    by_ratio = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    per = per.withColumn("try", (total * F.lit(float(share)) - before) / rest)
    # "try" is the level if exactly the sources before are capped. It never exceeds
    # the true level (a wrong guess spends too much below it) and equals it once.
    level = F.max("try").over(everything)
    return per.withColumn("level", level).select(
        "source", "source_size", F.least(cap.cast("double"), F.col("weight") * F.col("level")).alias("target"))


def _drawn(docs: DataFrame, doc_id: str, text: str, source: str, seed: int, quality, keep: list[str]) -> DataFrame:
    """Columns ``keep`` plus source, size, bucket, part and place (the order within a source)."""
    content = F.xxhash64(F.col(text), F.to_json(F.struct(*[F.col(c) for c in keep])) if keep else F.lit(""))
    base = docs.select(*[F.col(c) for c in keep], F.col(doc_id).alias("_id"), F.col(source).alias("_source"),
                       F.col(text).alias("_text"), n_words(F.col(text)).alias("_size"), content.alias("_content"))
    key = -F.log(uniform(F.col("_id"), F.col("_text"), seed)) / quality(F.col("_text"), F.col("_size"))
    base = base.select(*keep, "_id", "_source", "_size", "_content", key.alias("_key"))
    fine = F.floor((1.0 - F.exp(-F.col("_key"))) * (BUCKETS * BUCKETS)).cast("long")
    return base.select(*keep, "_source", "_size", F.floor(fine / BUCKETS).cast("int").alias("_bucket"), (fine % BUCKETS).cast("int").alias("_part"),
                       F.struct(F.col("_key").alias("key"), F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"),
                                F.col("_size").alias("size"), F.col("_content").alias("content")).alias("_place"))


def _small(df: DataFrame, source: str) -> DataFrame:
    """``df`` (one row per source), marked for a broadcast if it is small in bytes."""
    size = df.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col(source).cast("string")), F.lit(0)) + 100), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _ends(drawn: DataFrame, cut: DataFrame, level: str) -> DataFrame:
    """Per source the first ``level`` (bucket, or part of the bucket) at which the running words pass the
    budget, and the words before it. At most BUCKETS rows a source are summed."""
    hist = drawn.groupBy("source", level).agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy(level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("through", F.sum("words").over(run))
    first = F.struct(level, (F.col("before") + F.col("through") - F.col("words")).alias("before"))
    return (hist.join(_small(cut, "c_source").withColumnRenamed(level, f"_{level}") if level in cut.columns else _small(cut, "c_source"),
                      F.col("source").eqNullSafe(F.col("c_source")))
            .where(F.col("before") + F.col("through") > F.col("budget"))
            .groupBy("c_source", "budget").agg(F.min(first).alias("cut"))
            .select("c_source", "budget", F.col(f"cut.{level}").alias(f"c_{level}"), F.col("cut.before").alias("before")))


def _plan(drawn: DataFrame, weights, share: float, max_epochs: int) -> DataFrame:
    """One row per source: size, target, whole epochs, the bucket, part and last place that the
    part epoch takes (null: none), and of the last place's rows how many (``last_rows`` of ``last_of``)."""
    drawn = drawn.select(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_bucket").alias("bucket"),
                         F.col("_part").alias("part"), F.col("_place").alias("place"))
    targets = source_targets(drawn, weights, share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    targets = store(targets.withColumnRenamed("source", "t_source"), "mix-targets")
    start = targets.select(F.col("t_source").alias("c_source"), "budget", F.lit(0).cast("long").alias("before"))
    buckets = store(_ends(drawn, start, "bucket"), "mix-buckets")
    inside = drawn.join(_small(buckets.select("c_source", "c_bucket"), "c_source"),
                        F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bucket") == F.col("c_bucket"))).drop("c_source", "c_bucket")
    parts = store(_ends(inside, buckets.drop("c_bucket"), "part"), "mix-parts")

    # distinct places of the one part in which the budget ends, with their rows
    ranked = (inside.join(_small(parts, "c_source"), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("part") == F.col("c_part")))
              .groupBy("c_source", "budget", "before", "c_part", "place", "size").agg(F.count(F.lit(1)).alias("of")))
    order = Window.partitionBy("c_source").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    through = F.col("before") + F.sum(F.col("size") * F.col("of")).over(order)
    ranked = ranked.withColumn("room", F.col("budget") - (through - F.col("size") * F.col("of")))
    # the j-th row of a place is taken if j * size - size / 2 fits into the room left before it
    fits = F.when(F.col("size") > 0, F.floor(F.col("room") / F.col("size") + 0.5)).otherwise(F.col("of")).cast("long")
    last = ranked.withColumn("rows", F.least(fits, F.col("of"))).where("rows > 0").groupBy("c_source").agg(
        F.max(F.struct("place", "rows", "of")).alias("last"))
    ends = buckets.select(F.col("c_source").alias("b_source"), "c_bucket").join(
        _small(parts.select(F.col("c_source").alias("p_source"), "c_part"), "p_source"), F.col("b_source").eqNullSafe(F.col("p_source")), "left").join(
        _small(last.withColumnRenamed("c_source", "l_source"), "l_source"), F.col("b_source").eqNullSafe(F.col("l_source")), "left")
    return store(targets.join(_small(ends, "b_source"), F.col("t_source").eqNullSafe(F.col("b_source")), "left").select(
        "t_source", "source_size", "target", "epochs", "c_bucket", "c_part", F.col("last.place").alias("last"),
        F.col("last.rows").alias("last_rows"), F.col("last.of").alias("last_of")), "mix-plan")


def mix(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights=WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = 17, quality=quality_weight) -> DataFrame:
    """Columns ``keep`` plus size, source_size, target, epochs, selected, taken for every row.

    size: number of words (null or empty text: 0). taken = size * (epochs +
    selected). A document is selected in the part epoch if at least half of it
    fits into what the budget leaves after the documents before it, so a source
    misses its target by half a document at most. Ties in the key fall to the
    smaller id (null last), the smaller size, then a hash of text and ``keep``; of
    rows equal in all of these as many are selected as fit, so repeated rows miss
    no target either. Null sources form one source; null ids draw their key from the
    text; an empty table gives an empty result.

    Planning reads a narrow table (no text); applying the plan is one narrow
    pass over ``docs``, and a second one for the rows of a last place that is taken
    in part: these are counted and written out as often as each outcome occurs.
    """
    plan = _plan(store(_drawn(docs, doc_id, text, source, seed, quality, keep).drop(*keep), "mix-drawn"), weights, share, max_epochs)
    rows = _drawn(docs, doc_id, text, source, seed, quality, keep)
    rows = rows.join(_small(plan, "t_source"), F.col("_source").eqNullSafe(F.col("t_source")))
    here = (F.col("_bucket") == F.col("c_bucket")) & (F.col("_part") == F.col("c_part"))
    earlier = (F.col("_bucket") < F.col("c_bucket")) | ((F.col("_bucket") == F.col("c_bucket")) & (F.col("_part") < F.col("c_part")))
    chosen = F.coalesce(earlier | (here & (F.col("_place") <= F.col("last"))), F.lit(False))

    def out(df, selected):
        return df.select(*keep, F.col("_size").alias("size"), "source_size", "target", "epochs", selected.alias("selected"),
                         (F.col("_size") * (F.col("epochs") + selected.cast("long"))).alias("taken"))

    whole = (F.col("_size") > 0) & chosen
    if not plan.where("last_rows < last_of").head(1):
        return out(rows, whole)
    split = F.coalesce((F.col("last_rows") < F.col("last_of")) & (F.col("_place") == F.col("last")), F.lit(False))
    same = rows.where(split).groupBy(*keep, "_size", "source_size", "target", "epochs", "last_rows").agg(F.count(F.lit(1)).alias("_rows"))
    both = F.explode(F.array(F.struct(F.lit(True).alias("s"), F.col("last_rows").alias("n")),
                             F.struct(F.lit(False).alias("s"), (F.col("_rows") - F.col("last_rows")).alias("n")))).alias("_out")
    blocks = same.select(*keep, "_size", "source_size", "target", "epochs", both).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_out.n") / COPIES_A_BLOCK)))).repartition("_block")
    n = F.least(F.lit(COPIES_A_BLOCK), F.col("_out.n") - F.col("_block") * COPIES_A_BLOCK).cast("int")
    copies = blocks.select("*", F.explode(F.array_repeat(F.lit(1), n)))
    return out(rows.where(~split), whole).unionByName(out(copies, (F.col("_size") > 0) & F.col("_out.s")))
