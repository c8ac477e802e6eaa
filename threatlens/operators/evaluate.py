"""Evaluation of scored predictions: (y, pred, prob) rows.

All metrics are aggregations: confusion counts in one ``agg``, ROC-AUC as a
rank statistic over distinct scores split into score ranges (no pairs, no
single-task global window over rows), and the 101-step threshold sweep in
one pass (every row is bucketed to the largest step it reaches).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S

STEPS = 100  # thresholds i * 0.01, i = 0..100


def _div(a: Column, b: Column) -> Column:
    """a / b, 0.0 when b is 0 (ANSI-safe)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return _div(F.lit(2.0) * p * r, p + r)


def confusion(pred: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """tn, fp, fn, tp in one aggregation."""
    return pred.agg(
        F.count_if((F.col(y) == 0) & (F.col(p) == 0)).alias("tn"),
        F.count_if((F.col(y) == 0) & (F.col(p) == 1)).alias("fp"),
        F.count_if((F.col(y) == 1) & (F.col(p) == 0)).alias("fn"),
        F.count_if((F.col(y) == 1) & (F.col(p) == 1)).alias("tp"),
    )


def class_metrics(cm: DataFrame) -> DataFrame:
    """Precision, recall, F1 of class 1 (0 when undefined) from confusion counts."""
    prec = _div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _div(F.col("tp"), F.col("tp") + F.col("fn"))
    return cm.select("*", prec.alias("precision"), rec.alias("recall")).withColumn(
        "f1", _f1(F.col("precision"), F.col("recall")))


def classification_report(pred: DataFrame, y: str = "y", p: str = "pred",
                          names=("Benign", "Malicious")) -> DataFrame:
    """Per class precision / recall / F1 / support, accuracy, macro and
    weighted averages (rows: class names, 'accuracy', 'macro avg', 'weighted avg')."""
    cm = confusion(pred, y, p)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    rows = []
    for name, (TP, FP, FN, SUP) in zip(names, [(tn, fn, fp, tn + fp), (tp, fp, fn, tp + fn)]):
        pr, rc = _div(TP, TP + FP), _div(TP, TP + FN)
        rows.append(cm.select(F.lit(name).alias("label"), pr.alias("precision"), rc.alias("recall"),
                              _f1(pr, rc).alias("f1"), SUP.alias("support")))
    per = rows[0].unionByName(rows[1])
    acc = cm.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                    F.lit(None).cast("double").alias("recall"), _div(tn + tp, n).alias("f1"), n.alias("support"))
    macro = per.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                    F.sum("support").alias("support"))
    weighted = per.agg(
        F.lit("weighted avg").alias("label"),
        _div(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("precision"),
        _div(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("recall"),
        _div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1"),
        F.sum("support").alias("support"))
    out = per.unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


def _ranked_scores(pred: DataFrame, y: str, score: str, ranges: int, extra=()) -> DataFrame:
    """Per distinct score: pos, neg (+ extra aggregates), and neg_below(s)
    = negatives with a lower score, computed per score range."""
    per = pred.groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"), *extra)
    bounds = []
    if ranges > 1:
        qs = per.approxQuantile("s", [i / ranges for i in range(1, ranges)], 1.0 / (4 * ranges))
        bounds = sorted(set(q for q in qs if q is not None))  # <= ranges - 1 values
    if bounds:
        from pyspark.ml.feature import Bucketizer

        per = Bucketizer(splits=[float("-inf")] + bounds + [float("inf")], inputCol="s", outputCol="rb",
                         handleInvalid="keep").transform(per).withColumn("r", F.col("rb").cast("int")).drop("rb")
    else:
        per = per.withColumn("r", F.lit(0))
    rng = per.groupBy("r").agg(F.sum("neg").alias("rneg"))
    below_r = rng.withColumn(
        "neg_before", F.coalesce(F.sum("rneg").over(
            Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("r", "neg_before")
    within = Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("neg_in", F.coalesce(F.sum("neg").over(within), F.lit(0)))
    return per.join(F.broadcast(below_r), "r")  # one row per range (<= ranges rows)


def _auc_expr() -> Column:
    u2 = F.sum(F.col("pos") * (2 * (F.col("neg_before") + F.col("neg_in")) + F.col("neg")))
    return F.try_divide(u2.cast("double"), (F.lit(2) * F.sum("pos") * F.sum("neg")).cast("double"))


def roc_auc(pred: DataFrame, y: str = "y", score: str = "prob", ranges: int = 1024) -> DataFrame:
    """Area under the ROC curve with ties counted half.

    AUC = sum_s pos(s) * (neg_below(s) + neg(s) / 2) / (P * N). Rows are first
    aggregated per distinct score; distinct scores are split into
    ``ranges`` equal-count score ranges (approximate quantiles, a bounded
    list); a running sum inside each range plus the exact negative count
    of all lower ranges gives neg_below. Integer arithmetic until the end.
    """
    per = _ranked_scores(pred, y, score, ranges)
    return per.agg(_auc_expr().alias("roc_auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def evaluation_summary(pred: DataFrame, y: str = "y", p: str = "pred", score: str = "prob",
                       ranges: int = 1024) -> DataFrame:
    """tn, fp, fn, tp, precision, recall, f1 and roc_auc in one plan (the
    confusion counts ride along in the per-score aggregation)."""
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    extra = [F.count_if((F.col(y) == a) & (F.col(p) == b)).alias(f"_{k}") for k, (a, b) in cells.items()]
    per = _ranked_scores(pred, y, score, ranges, extra)
    agg = per.agg(*[F.sum(f"_{k}").alias(k) for k in cells], _auc_expr().alias("roc_auc"))
    return class_metrics(agg).select("tn", "fp", "fn", "tp", "precision", "recall", "f1", "roc_auc")


def sweep_step(score: Column) -> Column:
    """Largest i in 0..100 with i * 0.01 <= score (double comparison, as in
    the threshold loop), -1 below 0 and for null and NaN."""
    score = F.when(~F.isnan(score), score)    # a missing score reaches no threshold
    i0 = F.floor(score * 100.0).cast("int")
    i1 = F.when((i0 + 1) * 0.01 <= score, i0 + 1).when(i0 * 0.01 > score, i0 - 1).otherwise(i0)
    return F.coalesce(F.least(F.greatest(i1, F.lit(-1)), F.lit(STEPS)), F.lit(-1))


def threshold_sweep(pred: DataFrame, y: str = "y", score: str = "prob") -> DataFrame:
    """tp, fp, fn, tn, precision, recall, F1 at thresholds i * 0.01 (>=).

    One aggregation into <= 102 step buckets, then a reverse running sum
    over them: tp(i) = positives with step >= i. Rows without a usable score
    (null, NaN, negative) are never predicted positive but stay in fn and tn.
    """
    spark = pred.sparkSession
    b = pred.groupBy(sweep_step(F.col(score)).alias("step")).agg(
        F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    steps = spark.range(-1, STEPS + 1).select(F.col("id").cast("int").alias("step"))
    w = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 101 rows
    t = (steps.join(b, "step", "left").na.fill(0, ["p", "n"])
         .withColumn("tp", F.sum("p").over(w)).withColumn("fp", F.sum("n").over(w))
         .withColumn("P", F.sum("p").over(Window.partitionBy()))  # 101 rows
         .withColumn("N", F.sum("n").over(Window.partitionBy()))
         .withColumn("fn", F.col("P") - F.col("tp")).withColumn("tn", F.col("N") - F.col("fp")))
    prec = _div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _div(F.col("tp"), F.col("tp") + F.col("fn"))
    return t.where("step >= 0").select(
        "step", (F.col("step") * F.lit(0.01)).alias("threshold"),
        prec.alias("precision"), rec.alias("recall"), _f1(prec, rec).alias("f1"),
        F.col("fn").cast("bigint").alias("fn"), F.col("fp").cast("bigint").alias("fp"),
        F.col("tp").cast("bigint").alias("tp"), F.col("tn").cast("bigint").alias("tn"))


def best_thresholds(sweep: DataFrame, recall_target: float = 0.99) -> DataFrame:
    """(a) best precision with recall >= target, (b) fewest false negatives,
    (c) best F1, (d) the 0.50 row; ties -> the lowest threshold."""
    row, step = F.struct(*sweep.columns), F.col("step")
    picks = {
        "recall_at_least_99": (F.col("recall") >= recall_target, -F.col("precision")),
        "min_false_negatives": (F.lit(True), F.col("fn")),
        "max_f1": (F.lit(True), -F.col("f1")),
        "default_050": (step == 50, step),
    }
    best = sweep.agg(*[F.min_by(F.when(ok, row), F.when(ok, F.struct(key, step))).alias(name) for name, (ok, key) in picks.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("criterion"), F.col(n).alias("r")) for n in picks])
    return best.select(F.inline(rows)).where(F.col("r").isNotNull()).select("criterion", "r.*")


def threshold_table(sweep: DataFrame, steps=S.THRESHOLD_TABLE_STEPS) -> DataFrame:
    return sweep.where(F.col("step").isin(*steps))


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double column (results compared across engines)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double"
                       else F.col(f.name) for f in df.schema.fields])


# ---------------------------------------------------------------------------
# Inspection
# ---------------------------------------------------------------------------

def top_terms(vocab: DataFrame, k: int = 20) -> DataFrame:
    """k highest and k lowest coefficients (tie: term ascending)."""
    hi = vocab.orderBy(F.desc("coef"), "term").limit(k).select(F.lit("positive").alias("side"), "term", "coef")
    lo = vocab.orderBy(F.asc("coef"), "term").limit(k).select(F.lit("negative").alias("side"), "term", "coef")
    w_hi = Window.partitionBy("side").orderBy(F.desc("coef"), "term")
    w_lo = Window.partitionBy("side").orderBy(F.asc("coef"), "term")
    return (hi.withColumn("rank", F.row_number().over(w_hi))
              .unionByName(lo.withColumn("rank", F.row_number().over(w_lo))))


def ngram_breakdown(top: DataFrame) -> DataFrame:
    """Unigram / bigram counts on each side of the top-term list."""
    kind = F.when(F.col("term").contains(" "), "bigram").otherwise("unigram")
    return top.groupBy("side", kind.alias("kind")).agg(F.count(F.lit(1)).alias("count"))


def error_samples(pred: DataFrame, key: str = "id", text: str = "clean_text", k: int = 5,
                  y: str = "y", p: str = "pred") -> DataFrame:
    """False negatives and false positives: the first ``k`` of each (by key)
    with a 200-character preview, plus the total of each kind."""
    from ..functions.text import preview

    kind = F.when((F.col(y) == 1) & (F.col(p) == 0), "false_negative").when(
        (F.col(y) == 0) & (F.col(p) == 1), "false_positive")
    e = pred.select(kind.alias("kind"), key, "channel", preview(F.col(text), 200).alias("text_preview")).where(
        F.col("kind").isNotNull())
    totals = e.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))  # <= 2 rows
    first = e.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(key))).where(
        F.col("rank") <= k)  # group limit applied before the shuffle
    return first.join(F.broadcast(totals), "kind")
