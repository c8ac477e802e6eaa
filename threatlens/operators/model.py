"""Linear text models over long-form TF-IDF.

A model is a vocabulary table ``(term, idf, coef)`` plus an intercept. A text
is scored inside its row: its n-grams are counted against the dictionary, and

    p = sigmoid(dot / sqrt(norm2) + intercept)

with ``dot = sum(raw_w * coef)`` and ``norm2 = sum(raw_w^2)``. A vocabulary too
large for a dictionary in memory is joined in long form instead.

Two ways to get coefficients:

* ``fit_log_odds``: closed form ln((a + 1) / (b + 1)) with a / b the
  document frequency among malicious / benign training documents
  (intercept 0); exactly reproducible in SQL, used by the oracles;
* ``fit_logistic``: Spark ML ``LogisticRegression`` (L2, L-BFGS, balanced
  class weights, no standardisation, regParam = 1 / n_train), the same
  optimum as a C = 1 scikit-style fit.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from . import features as FE
from . import logistic as LG
from .ordinals import with_ordinals


# Dictionaries up to this size are held by the driver and every executor.
MAX_DICTIONARY_BYTES = 16 << 20


@dataclass
class LinearModel:
    vocab: DataFrame          # term, idf, coef (+ df, total_tf, idx)
    intercept: float = 0.0
    size: int | None = None   # bytes of the vocabulary's terms, counted on first use

    def n_bytes(self) -> int:
        if self.size is None:
            self.size = FE.vocab_bytes(self.vocab)
        return self.size

    def dictionary(self) -> list | None:
        """(term, idf, coef) rows by term, or None if they are too large for the driver."""
        if self.n_bytes() > MAX_DICTIONARY_BYTES:
            return None
        if not hasattr(self, "_rows"):
            self._rows = self.vocab.select("term", "idf", "coef").orderBy("term").collect()
        return self._rows

    def counter(self):
        """Counts the dictionary's terms in an array of n-grams (made once: the terms go to the JVM one by one)."""
        from pyspark.ml.feature import CountVectorizerModel

        if not hasattr(self, "_counter"):
            self._counter = CountVectorizerModel.from_vocabulary(
                [r["term"] for r in self.dictionary()], inputCol="_ngrams", outputCol="_counts", minTF=1.0)
        return self._counter


def top_by_count(kept: DataFrame, k: int) -> DataFrame:
    """The ``k`` terms with the largest total count (tie: term ascending).

    A histogram of the counts (few distinct values) locates the cut count,
    so the final ordered take only sees terms at or above it.
    """
    hist = kept.groupBy("total_tf").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("total_tf")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = hist.withColumn("cum", F.sum("n").over(w)).where(F.col("cum") >= k).agg(F.max("total_tf")).first()[0]
    cand = kept if cut is None else kept.where(F.col("total_tf") >= cut)
    return cand.orderBy(F.desc("total_tf"), "term").limit(k)


def vocab_stats(train_tf: DataFrame, label: str = "y") -> DataFrame:
    """Per term: df, total count, df among label 1 and label 0 documents."""
    return train_tf.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"),
        F.sum("tf").alias("total_tf"),
        F.count_if(F.col(label) == 1).alias("df_pos"),
        F.count_if(F.col(label) == 0).alias("df_neg"),
    )


def fit_vocab(train_tf: DataFrame, n_docs: int, vocab_size: int | None = S.VOCAB_SIZE_V2,
              min_df: int = S.MIN_DF, max_df: float = S.MAX_DF, label: str = "y") -> DataFrame:
    """min_df <= df <= max_df * n, then the top ``vocab_size`` by total count (None:
    all terms); adds idf and the alphabetical column index."""
    return vocab_of(vocab_stats(train_tf, label), n_docs, vocab_size, min_df, max_df)


def vocab_of(stats: DataFrame, n_docs: int, vocab_size: int | None = S.VOCAB_SIZE_V2,
             min_df: int = S.MIN_DF, max_df: float = S.MAX_DF) -> DataFrame:
    """``fit_vocab`` from the terms' counts, which are read several times."""
    kept = stats.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n_docs)))
    top = kept if vocab_size is None else top_by_count(kept, vocab_size)
    idf = F.log((F.lit(1.0) + n_docs) / (F.col("df") + 1.0)) + 1.0
    top = top.select("term", "df", "total_tf", "df_pos", "df_neg", idf.alias("idf"))
    return with_ordinals(top, [F.col("term")], "idx").withColumn("idx", F.col("idx").cast("int"))


def fit_log_odds(vocab: DataFrame) -> LinearModel:
    coef = F.log((F.col("df_pos") + 1.0) / (F.col("df_neg") + 1.0))
    return LinearModel(vocab.withColumn("coef", coef), 0.0)


def _constants(values):
    """An array constant; parsed once when the plan is optimised."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def with_term_weights(docs: DataFrame, text_col: str, model: LinearModel) -> DataFrame:
    """Adds ``_at`` (dictionary positions) and ``_w`` (raw TF-IDF weights) of the
    dictionary's terms in each text: a narrow step in the JVM."""
    rows = model.dictionary()
    if rows is None:
        raise ValueError(f"the vocabulary's terms exceed a dictionary of {MAX_DICTIONARY_BYTES} bytes")
    counter = model.counter()
    none = F.array().cast("array<string>")
    d = docs.withColumn("_tok", F.coalesce(FE.tokens(text_col), none)).withColumn("_ngrams", FE.ngrams_of(F.col("_tok")))
    d = counter.transform(d).withColumn("_sparse", F.unwrap_udt("_counts"))
    idf = _constants(r["idf"] for r in rows)
    w = F.zip_with("_sparse.indices", "_sparse.values", lambda i, tf: (F.lit(1.0) + F.log(tf)) * F.get(idf, i))
    return d.withColumn("_at", F.col("_sparse.indices")).withColumn("_w", w).drop("_tok", "_ngrams", "_counts", "_sparse")


def _unit(w):
    """An array divided by its L2 norm. The norm is bound to a lambda variable: as a column it may be
    put into the division by the optimiser, and is then summed again for every element."""
    norm = F.sqrt(F.aggregate(F.transform(w, lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    return F.flatten(F.transform(F.array(norm), lambda n: F.transform(w, lambda x: x / n)))


def tfidf_weights(docs: DataFrame, id_col: str, text_col: str, model: LinearModel) -> DataFrame:
    """(id, term, weight) of the vocabulary's terms, L2-normalised per id."""
    rows = model.dictionary()
    if rows is None:
        return FE.tfidf(FE.term_counts(docs, id_col, text_col), model.vocab, model.n_bytes()).select("id", "term", "weight")
    if not rows:
        return docs.where("false").select(F.col(id_col).alias("id"), F.lit("").alias("term"), F.lit(0.0).alias("weight"))
    terms = F.from_json(F.lit(json.dumps([r["term"] for r in rows])), "array<string>")
    d = with_term_weights(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")), "_text", model)
    own = F.aggregate("_w", F.lit(0.0), lambda a, w: a + w * w)
    norm = F.sqrt(F.sum("_own").over(Window.partitionBy("id")))         # a row per text, not per term
    d = d.select("id", "_at", "_w", own.alias("_own")).withColumn("_norm", norm)
    x = d.select("id", "_norm", F.explode(F.arrays_zip("_at", "_w")).alias("_x"))
    return x.select("id", F.get(terms, F.col("_x._at")).alias("term"), (F.col("_x._w") / F.col("_norm")).alias("weight"))


def _strongest(pairs, k: int):
    """Terms of the ``k`` largest positive contributions in an array of (value, term);
    equal values (at 9 digits) by term."""
    ranked = F.transform(F.filter(pairs, lambda p: p["value"] > 0),
                         lambda p: F.struct((-F.round(p["value"], 9)).alias("value"), p["term"].alias("term")))
    return F.transform(F.slice(F.array_sort(ranked), 1, k), lambda p: p["term"])


def with_scores(docs: DataFrame, text_col: str, model: LinearModel, explain: int = 0) -> DataFrame:
    """Adds ``_dot`` and ``_norm2`` (null without a known term) to every row, and
    ``_why``: the ``explain`` terms that speak most for a malicious text."""
    rows = model.dictionary()
    if rows is None:
        return _with_scores_long(docs, text_col, model, explain)
    if not rows:
        none = docs.withColumn("_dot", F.lit(None).cast("double")).withColumn("_norm2", F.lit(None).cast("double"))
        return none.withColumn("_why", F.array().cast("array<string>"))
    d = with_term_weights(docs, text_col, model)
    coef = _constants(r["coef"] for r in rows)
    some = F.size("_w") > 0
    add = lambda a, x: a + x
    dot = F.aggregate(F.zip_with("_at", "_w", lambda i, w: w * F.get(coef, i)), F.lit(0.0), add)
    norm2 = F.aggregate(F.transform("_w", lambda w: w * w), F.lit(0.0), add)
    why = F.array().cast("array<string>")
    if explain:
        terms = F.from_json(F.lit(json.dumps([r["term"] for r in rows])), "array<string>")
        why = _strongest(F.zip_with("_at", "_w", lambda i, w: F.struct((w * F.get(coef, i)).alias("value"),
                                                                       F.get(terms, i).alias("term"))), explain)
    return (d.withColumn("_dot", F.when(some, dot)).withColumn("_norm2", F.when(some, norm2)).withColumn("_why", why)
            .drop("_at", "_w"))


def _with_scores_long(docs: DataFrame, text_col: str, model: LinearModel, explain: int = 0) -> DataFrame:
    """The same through long rows, for any vocabulary size. Rows get a number in a
    written table, so rows that share a caller's id stay apart."""
    from ..session import checkpoint_root

    checkpoint_root(docs.sparkSession)
    d = docs.withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    s = vocab_term_scores(d, "_row", text_col, model, explain).select(
        F.col("id").alias("_row"), F.col("dot").alias("_dot"), F.col("norm2").alias("_norm2"), F.col("why").alias("_why"))
    return d.join(s, "_row", "left").withColumn("_why", F.coalesce("_why", F.array().cast("array<string>"))).drop("_row")


def vocab_term_scores(docs: DataFrame, id_col: str, text_col: str, model: LinearModel, explain: int = 0) -> DataFrame:
    """(id, dot, norm2, why) from long rows: one per n-gram and document, joined with
    the vocabulary before they are counted. ``id_col`` must be unique."""
    d = docs.select(F.col(id_col).alias("id"), FE.tokens(text_col).alias("_tok"))
    e = d.select("id", F.explode(FE.ngrams_of(F.col("_tok"))).alias("term"))
    j = FE.join_vocab(e, model.vocab.select("term", "idf", "coef"), model.n_bytes())
    tf = j.groupBy("id", "term", "idf", "coef").agg(F.count(F.lit(1)).alias("tf"))
    w = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")
    value = w * F.col("coef")
    why = F.array().cast("array<string>")
    if explain:   # distinct terms of one document
        why = _strongest(F.collect_list(F.when(value > 0, F.struct(value.alias("value"), "term"))), explain)
    return tf.groupBy("id").agg(F.sum(value).alias("dot"), F.sum(w * w).alias("norm2"), (why if explain else F.first(why)).alias("why"))


def sigmoid(x):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def decision(dot, norm2, intercept: float):
    """w.x + b with x L2-normalised; documents without known terms -> b."""
    return F.coalesce(dot / F.sqrt(norm2), F.lit(0.0)) + F.lit(float(intercept))


def predict(docs: DataFrame, text_col: str, model: LinearModel) -> DataFrame:
    """Adds ``decision``, ``prob`` and ``pred`` (decision > 0) to ``docs``."""
    d = decision(F.col("_dot"), F.col("_norm2"), model.intercept)
    return (with_scores(docs, text_col, model).withColumn("decision", d)
            .withColumn("prob", sigmoid(F.col("decision")))
            .withColumn("pred", (F.col("decision") > 0).cast("int")).drop("_dot", "_norm2", "_why"))


# ---------------------------------------------------------------------------
# Logistic regression on Spark ML
# ---------------------------------------------------------------------------

def fit_logistic(train: DataFrame, vocab: DataFrame, text_col: str = "clean_text", label: str = "y",
                 max_iter: int = 1000, tol: float = 1e-9) -> LinearModel:
    """Balanced, L2 (C = 1) logistic regression on the TF-IDF vectors of ``train``.

    Vectors are assembled in the JVM and written once: the optimiser reads that
    table in every pass, and the coefficients come back through the driver. A
    vocabulary too large for a dictionary is fitted with tables (``logistic``):
    the same optimum, no vector over the terms in one place.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T

    from ..session import scratch_path

    blank = LinearModel(vocab.withColumn("coef", F.lit(0.0)))
    rows = blank.dictionary()
    if rows is None:
        coef, intercept, _ = LG.minimise(LG.entries(train, vocab, text_col, label), tol, max_iter)
        return _with_coefficients(vocab, coef, intercept)
    spark = train.sparkSession
    n_of = {r[0]: r[1] for r in train.groupBy(label).count().collect()}   # one row per class
    n = sum(n_of.values())
    weight = F.create_map(*[F.lit(x) for c, k in n_of.items() for x in (c, n / (len(n_of) * k))])[F.col(label)]
    d = with_term_weights(train.select(label, text_col), text_col, blank)
    features = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(len(rows)).alias("size"), F.col("_at").alias("indices"),
                        _unit(F.col("_w")).alias("values"))
    path = scratch_path(spark, "logistic-features")
    d.select(F.col(label).cast("double").alias("label"), weight.alias("w"), features.alias("features")).write.parquet(path)
    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("w", T.DoubleType()), T.StructField("features", VectorUDT())])
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", regParam=1.0 / n,
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol,
                            fitIntercept=True, family="binomial")
    m = lr.fit(spark.read.schema(schema).parquet(path))
    fitted = spark.createDataFrame([(r["term"], float(c)) for r, c in zip(rows, m.coefficients.toArray())], "term string, coef double")
    return LinearModel(FE.join_vocab(vocab.drop("coef"), fitted), float(m.intercept))


def _with_coefficients(vocab: DataFrame, coef: DataFrame, intercept: float) -> LinearModel:
    c = coef.select(F.col("at").alias("_at"), F.col("w").alias("coef"))
    return LinearModel(vocab.drop("coef").join(c, F.col("idx") == F.col("_at")).drop("_at"), intercept)


def fit_gradient_steps(train: DataFrame, vocab: DataFrame, steps: int, rate: float, text_col: str = "clean_text",
                       label: str = "y") -> LinearModel:
    """A fixed number of plain gradient steps on the objective of ``fit_logistic``, from zero, with tables."""
    return _with_coefficients(vocab, *LG.descend(LG.entries(train, vocab, text_col, label), steps, rate))


def largest_gradient(docs: DataFrame, model: LinearModel, text_col: str = "clean_text", label: str = "y") -> DataFrame:
    """One row (terms, gradient): the largest absolute partial derivative of the
    objective that ``fit_logistic`` minimises (mean balanced loss plus L2 / n) at
    ``model``; 0 at its unique optimum."""
    if model.dictionary() is None:
        e = LG.entries(docs, model.vocab, text_col, label)
        return LG.gradient(e, model.vocab.select(F.col("idx").cast("long").alias("at"), F.col("coef").alias("w")), model.intercept)
    n_of = {r[0]: r[1] for r in docs.groupBy(label).count().collect()}   # one row per class
    n = sum(n_of.values())
    balance = F.create_map(*[F.lit(x) for c, k in n_of.items() for x in (c, n / (len(n_of) * k))])[F.col(label)]
    d = with_term_weights(docs.select(label, text_col), text_col, model)
    coef = _constants(r["coef"] for r in model.dictionary())
    add = lambda a, x: a + x
    norm = F.sqrt(F.aggregate(F.transform("_w", lambda w: w * w), F.lit(0.0), add))
    z = F.aggregate(F.zip_with("_at", "_w", lambda i, w: w * F.get(coef, i)), F.lit(0.0), add)
    d = d.withColumn("_norm", norm).withColumn("_off", balance * (sigmoid(
        F.when(F.col("_norm") > 0, z / F.col("_norm")).otherwise(F.lit(0.0)) + F.lit(float(model.intercept))) - F.col(label)))
    per_term = F.transform(F.arrays_zip("_at", "_w"), lambda x: F.struct(x["_at"].alias("at"), (x["_w"] / F.col("_norm") * F.col("_off")).alias("g")))
    bias = F.array(F.struct(F.lit(-1).alias("at"), F.col("_off").alias("g")))
    sums = d.select(F.explode(F.concat(bias, per_term)).alias("x")).groupBy(F.col("x.at").alias("at")).agg(F.sum("x.g").alias("g"))
    own = F.when(F.col("at") >= 0, F.get(coef, F.col("at"))).otherwise(F.lit(0.0))
    return sums.agg(F.count_if(F.col("at") >= 0).alias("terms"), (F.max(F.abs(F.col("g") + own)) / n).alias("gradient"))


# ---------------------------------------------------------------------------
# Persistence
# ---------------------------------------------------------------------------

def save_model(model: LinearModel, path: str) -> None:
    model.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    spark = model.vocab.sparkSession
    meta = json.dumps({"intercept": model.intercept, "size": model.size})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> LinearModel:
    vocab = spark.read.parquet(f"{path}/vocab")
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return LinearModel(vocab, float(meta["intercept"]), meta.get("size"))
