"""Modelling plan over the master corpus of the fixture.

labelled corpus (clean_text not null, y = malicious) -> stratified split ->
train n-gram counts -> vocabulary (30,000 terms) -> model.
The corpus, the terms' counts, the vocabulary and the predictions are tables
written to the shared folder, so later actions scan them column by column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import canonical as C
from ..operators import features as FE
from ..operators import model as MD
from ..operators import sampling as SP
from ..session import written
from .corpus import master_corpus


@dataclass
class Fitted:
    split: DataFrame       # id, clean_text, channel, y, fold
    n_train: int
    model: MD.LinearModel  # log-odds coefficients, intercept 0
    predictions: DataFrame | None = None   # scored test fold, written on first use
    logistic: MD.LinearModel | None = None  # fitted on first use
    stepped: MD.LinearModel | None = None   # a few gradient steps, on first use
    second: object | None = None            # trained second model, on first use
    logistic_predictions: DataFrame | None = None   # the test fold by these two models, written on first use
    stepped_predictions: DataFrame | None = None


def labelled(spark: SparkSession, sf_dir: str, label=C.label_malicious, sources=None) -> DataFrame:
    corpus = master_corpus(spark, sf_dir)
    if sources:
        corpus = corpus.where(F.col("source_dataset").isin(*sources))
    return C.drop_null_text(corpus).select(
        F.col("message_id").alias("id"), "clean_text", "channel", label().alias("y"))


def split(spark: SparkSession, sf_dir: str, label=C.label_malicious, sources=None) -> DataFrame:
    """The labelled corpus with its fold: a narrow expression over the corpus table."""
    return SP.stratified_split(labelled(spark, sf_dir, label, sources), "y", "id")


_FITTED: dict = {}


def fit(spark: SparkSession, sf_dir: str, vocab_size: int = S.VOCAB_SIZE_V2, label=C.label_malicious,
        sources: tuple[str, ...] | None = None) -> Fitted:
    """Split + vocabulary + model, fitted once per session and input (the
    pieces are checkpointed tables) and reused by every evaluation/scoring query."""
    from .corpus import input_key

    key = input_key(spark, sf_dir) + (vocab_size, label.__name__, sources)
    if key not in _FITTED:
        _FITTED[key] = _fit(spark, sf_dir, vocab_size, label, sources)
    return _FITTED[key]


def _fit(spark: SparkSession, sf_dir: str, vocab_size: int, label, sources) -> Fitted:
    sp = split(spark, sf_dir, label, sources)
    train = sp.where(F.col("fold") == "train")
    n_train = train.count()
    stats = written(FE.term_stats(train, "clean_text", "y").where(F.col("df") >= S.MIN_DF), "term-stats")
    vocab = written(MD.vocab_of(stats, n_train, vocab_size), "vocabulary")
    model = MD.fit_log_odds(vocab)
    return Fitted(sp, n_train, model)


def fit_smishing(spark: SparkSession, sf_dir: str) -> Fitted:
    """The first model generation: smishing only, on SMS and benign mail."""
    return fit(spark, sf_dir, S.VOCAB_SIZE_V1, C.label_smishing, (S.SOURCE_SMS, S.SOURCE_MAIL))


def test_predictions(f: Fitted) -> DataFrame:
    """The test fold with its scores, written once and read by every evaluation."""
    if f.predictions is None:
        test = f.split.where(F.col("fold") == "test")
        f.predictions = written(MD.predict(test, "clean_text", f.model), "test-predictions")
    return f.predictions


def logistic_model(f: Fitted) -> MD.LinearModel:
    if f.logistic is None:
        m = MD.fit_logistic(f.split.where(F.col("fold") == "train"), f.model.vocab.drop("coef"))
        f.logistic = MD.LinearModel(written(m.vocab, "logistic"), m.intercept)
    return f.logistic


def stepped_model(f: Fitted, steps: int, rate: float) -> MD.LinearModel:
    """A fixed number of gradient steps with coefficients in tables."""
    if f.stepped is None:
        m = MD.fit_gradient_steps(f.split.where(F.col("fold") == "train"), f.model.vocab.drop("coef"), steps, rate)
        f.stepped = MD.LinearModel(written(m.vocab, "stepped"), m.intercept)
    return f.stepped


def _fold_scores(f: Fitted, model: MD.LinearModel, name: str) -> DataFrame:
    """(id, y, decision, prob, pred) of the test fold, written: an evaluation reads scores several times."""
    test = f.split.where(F.col("fold") == "test").select("id", "y", "clean_text")
    return written(MD.predict(test, "clean_text", model).drop("clean_text"), name)


def logistic_predictions(f: Fitted) -> DataFrame:
    if f.logistic_predictions is None:
        f.logistic_predictions = _fold_scores(f, logistic_model(f), "logistic-predictions")
    return f.logistic_predictions


def stepped_predictions(f: Fitted, steps: int, rate: float) -> DataFrame:
    if f.stepped_predictions is None:
        f.stepped_predictions = _fold_scores(f, stepped_model(f, steps, rate), "stepped-predictions")
    return f.stepped_predictions


def trained_second_model(f: Fitted):
    """The contextual model trained on the train fold, stored and loaded again."""
    from ..operators import contextual as CX
    from ..session import scratch_path

    if f.second is None:
        spark = f.split.sparkSession
        path = scratch_path(spark, "second-model")
        CX.save_second_model(spark, CX.fit_second_model(f.split.where(F.col("fold") == "train")), path)
        f.second = CX.load_second_model(spark, path)
    return f.second
