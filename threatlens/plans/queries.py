"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

All of them read the driver tables (through the ``msg`` view) so their
work grows with the data. Timestamps are rendered as UTC text and doubles
rounded where a sum order could differ, so results compare exactly with
the SQL oracles in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..operators import canonical as C
from ..operators import evaluate as EV
from ..operators import features as FE
from ..operators import mining as M
from ..operators import model as MD
from ..operators import quality as Q
from ..operators import sampling as SP
from ..operators import scoring as SC
from ..functions import text as X
from ..functions.numbers import round_exact
from ..session import scratch_path, ship_package, written
from ..sources import csv_splits as CS
from ..sources import files as IO
from ..sources.mail import extract_headers
from . import corpus as CP
from . import modelling as ML
from .fixture import mail_texts, message_view, mime_texts, tab_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    """Register ``fn``; the session runs in UTC (dates without an offset are
    read as UTC and timestamps are rendered in UTC)."""
    import functools

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def comparable(df: DataFrame) -> DataFrame:
    """Timestamps -> 'yyyy-MM-dd HH:mm:ss' text (session time zone is UTC)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            cols.append(F.date_format(F.col(f.name), "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _msg(spark, sf_dir):
    return message_view(spark, sf_dir)


def _corpus(spark, sf_dir):
    return CP.master_corpus(spark, sf_dir)


# ---------------------------------------------------------------------------
# Sources and canonical tables
# ---------------------------------------------------------------------------

@query
def labeled_lines(spark, sf_dir):
    """SMS lines of every message -> canonical SMS rows."""
    parsed = C.parse_labeled_lines(tab_lines(_msg(spark, sf_dir)))
    return comparable(C.canonical_sms(parsed))


@query
def line_counts(spark, sf_dir):
    return C.line_counts(C.parse_labeled_lines(tab_lines(_msg(spark, sf_dir))))


@query
def mail_headers(spark, sf_dir):
    raw = mail_texts(_msg(spark, sf_dir)).select(F.col("file").alias("file_path"), F.col("message").alias("raw_message"))
    return extract_headers(raw)


@query
def mail_canonical(spark, sf_dir):
    return comparable(C.canonical_mail(mail_texts(_msg(spark, sf_dir))))


@query
def mail_mime(spark, sf_dir):
    """The messages as base64, quoted-printable and multi-part mail -> canonical mail rows."""
    return comparable(C.canonical_mail(mime_texts(_msg(spark, sf_dir))))


@query
def phishing_canonical(spark, sf_dir):
    m = _msg(spark, sf_dir).select("id", "sender", "receiver", F.col("date_raw").alias("date"), "subject", "body", "label")
    return comparable(C.canonical_phishing(m, key_col="id"))


@query
def master_corpus(spark, sf_dir):
    srcs = CP.canonical_sources(_msg(spark, sf_dir))
    return comparable(Q.build_master_corpus(srcs, strict=False))


# ---------------------------------------------------------------------------
# Raw files -> canonical rows
# ---------------------------------------------------------------------------

def _phishing_rows(msg):
    return msg.select("sender", "receiver", F.col("date_raw").alias("date"), "subject", "body", "label")


@query
def sms_files(spark, sf_dir):
    """Label/text files of every message -> canonical SMS rows; ids follow from the lines."""
    path = scratch_path(spark, "sms-lines")
    tab_lines(_msg(spark, sf_dir)).select("value").write.text(path)
    return comparable(C.canonical_sms(C.parse_labeled_lines(IO.read_labeled_lines(spark, path)), key_col="line_key"))


@query
def mail_csv(spark, sf_dir):
    """Mail archive CSV (file, message) -> canonical benign mail rows."""
    path = scratch_path(spark, "mail-archive")
    IO.write_table(mail_texts(_msg(spark, sf_dir)), path, fmt="csv")
    return comparable(C.canonical_mail(IO.read_csv(spark, path, S.MAIL_CSV_SCHEMA, null_value=IO.CSV_NULL)))


@query
def phishing_csv(spark, sf_dir):
    """Labelled phishing CSV -> canonical phishing rows; ids follow from the rows."""
    path = scratch_path(spark, "phishing-csv")
    IO.write_table(_phishing_rows(_msg(spark, sf_dir)), path, fmt="csv")
    rows = C.filter_label(IO.read_csv(spark, path, S.PHISHING_CSV_SCHEMA, null_value=IO.CSV_NULL))
    return comparable(C.canonical_phishing(IO.number_copies(rows)))


@query
def schema_violations(spark, sf_dir):
    """Sources with a missing, an unknown and misplaced columns: every violation,
    beside the rows that the faulty source holds."""
    srcs = CP.canonical_sources(_msg(spark, sf_dir))
    faulty = {"sms": srcs["sms"].drop("language").withColumn("extra", F.lit(1)),
              "mail": srcs["mail"].select(*reversed(S.CANONICAL_COLUMNS)), "phishing": srcs["phishing"]}
    out = [df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("source_dataset"), "rows",
        F.explode_outer(F.array(*[F.lit(v) for _, v in Q.schema_violations(df, name)]).cast("array<string>")).alias("violation"))
        for name, df in faulty.items()]
    return C.union_sources(out)


@query
def corpus_validation(spark, sf_dir):
    return Q.required_field_report(CP.canonical_sources(_msg(spark, sf_dir)))


@query
def label_distribution(spark, sf_dir):
    return Q.distribution(_corpus(spark, sf_dir))


@query
def channel_crosstab(spark, sf_dir):
    return Q.crosstab_margins(_corpus(spark, sf_dir))


@query
def health_report(spark, sf_dir):
    return Q.health_report(_corpus(spark, sf_dir))


# ---------------------------------------------------------------------------
# Hard-negative mining
# ---------------------------------------------------------------------------

@query
def risk_flags(spark, sf_dir):
    f = M.risk_flags(_corpus(spark, sf_dir))
    return f.select("message_id", "channel", "has_url", "has_phone", "has_authority", "has_urgency",
                    "any_suspicious", "pattern_count", "patterns")


@query
def risk_report(spark, sf_dir):
    return M.risk_report(M.risk_flags(_corpus(spark, sf_dir)))


@query
def risk_samples(spark, sf_dir):
    return M.risk_samples(M.risk_flags(_corpus(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Samples and splits
# ---------------------------------------------------------------------------

SAMPLE_N = 500  # rows drawn from the mail archive by the sampling query


@query
def sample_exact(spark, sf_dir):
    return SP.sample_n(mail_texts(_msg(spark, sf_dir)), SAMPLE_N, "file")


@query
def stratified_split(spark, sf_dir):
    return ML.split(spark, sf_dir).select("id", "y", "fold")


@query
def class_weights(spark, sf_dir):
    return SP.class_distribution(ML.split(spark, sf_dir))


@query
def first_sample(spark, sf_dir):
    c = _corpus(spark, sf_dir).select("attack_label", "message_id", "source_dataset",
                                      F.substring("clean_text", 1, 100).alias("clean_preview"))
    return SP.first_sample(c, "attack_label", "message_id")


# ---------------------------------------------------------------------------
# Features and the linear model
# ---------------------------------------------------------------------------

@query
def ngram_counts(spark, sf_dir):
    lab = ML.labelled(spark, sf_dir).select("id", FE.tokens("clean_text").alias("tok"))
    tok = F.col("tok")
    return lab.select("id", F.size(tok).alias("n_unigrams"),
                      F.greatest(F.size(tok) - 1, F.lit(0)).alias("n_bigrams"),
                      F.size(F.array_distinct(FE.ngrams_of(tok))).alias("n_distinct_terms"))


@query
def vocab(spark, sf_dir):
    f = ML.fit(spark, sf_dir)
    return EV.rounded(f.model.vocab.select("term", "idx", "df", "total_tf", "df_pos", "df_neg", "idf", "coef"))


@query
def tfidf_weights(spark, sf_dir):
    f = ML.fit(spark, sf_dir)
    return EV.rounded(MD.tfidf_weights(f.split.where(F.col("fold") == "train"), "id", "clean_text", f.model))


def _test_preds(spark, sf_dir):
    p = ML.test_predictions(ML.fit(spark, sf_dir))
    return p.withColumn("prob", F.round("prob", 12))


@query
def linear_scores(spark, sf_dir):
    return EV.rounded(_test_preds(spark, sf_dir).select("id", "y", "decision", "prob", "pred"))


# ---------------------------------------------------------------------------
# Evaluation
# ---------------------------------------------------------------------------

@query
def confusion(spark, sf_dir):
    return EV.rounded(EV.class_metrics(EV.confusion(_test_preds(spark, sf_dir))))


@query
def class_report(spark, sf_dir):
    return EV.classification_report(_test_preds(spark, sf_dir))


@query
def roc_auc(spark, sf_dir):
    return EV.rounded(EV.roc_auc(_test_preds(spark, sf_dir)))


@query
def threshold_sweep(spark, sf_dir):
    return EV.rounded(EV.threshold_sweep(_test_preds(spark, sf_dir)))


@query
def best_thresholds(spark, sf_dir):
    return EV.rounded(EV.best_thresholds(EV.threshold_sweep(_test_preds(spark, sf_dir))))


@query
def threshold_table(spark, sf_dir):
    return EV.rounded(EV.threshold_table(EV.threshold_sweep(_test_preds(spark, sf_dir))))


@query
def top_terms(spark, sf_dir):
    return EV.rounded(EV.top_terms(ML.fit(spark, sf_dir).model.vocab))


@query
def ngram_breakdown(spark, sf_dir):
    return EV.ngram_breakdown(EV.top_terms(ML.fit(spark, sf_dir).model.vocab))


@query
def error_samples(spark, sf_dir):
    return EV.error_samples(_test_preds(spark, sf_dir))


# ---------------------------------------------------------------------------
# Scoring
# ---------------------------------------------------------------------------

def requests(msg):
    """Scoring requests derived from the messages: text, channel, mode."""
    i = F.col("id")
    channel = F.when(i % 10 == 0, F.upper("channel")).when(i % 23 == 0, F.lit("fax")).otherwise(F.col("channel"))
    mode = (F.when(i % 29 == 0, F.lit("bogus")).when(i % 31 == 0, F.lit(None).cast("string"))
            .when(i % 4 == 0, F.lit("balanced")).when(i % 4 == 1, F.lit("high_recall"))
            .when(i % 4 == 2, F.lit("LOW_FP")).otherwise(F.lit("")))
    return msg.select("id", F.col("body").alias("text"), channel.alias("channel"), mode.alias("mode"))


def score_cols():
    return ["id", "probability", "risk_tier", "is_malicious", "tfidf_score", "roberta_score",
            F.col("channel_out").alias("channel"), F.col("mode_out").alias("mode"), "threshold", "error",
            "was_truncated"]


@query
def scored_messages(spark, sf_dir):
    f = ML.fit(spark, sf_dir)
    return SC.score_messages(requests(_msg(spark, sf_dir)), f.model).select(*score_cols())


def keyword_model():
    """Stand-in second model with a closed form: logits (0, hits - 1.5), hits =
    number of risk phrases contained in the lower-cased text."""
    def make():
        import numpy as np

        words = S.AUTHORITY_KEYWORDS + S.URGENCY_KEYWORDS

        def predict(texts):
            hits = np.array([sum(w in str(t).lower() for w in words) for t in texts], dtype=float)
            return np.stack([np.zeros(len(hits)), hits - 1.5], axis=1)
        return predict
    return SC.SecondModel(make, batch_size=256, logits=True)


@query
def second_model(spark, sf_dir):
    f = ML.fit(spark, sf_dir)
    out = SC.score_messages(requests(_msg(spark, sf_dir)), f.model, second=keyword_model())
    return out.select(*score_cols(), "roberta_enabled")


@query
def component_scores(spark, sf_dir):
    """Both models' scores and their default blend, beside a verdict with equal weights."""
    f = ML.fit(spark, sf_dir)
    out = SC.score_messages(requests(_msg(spark, sf_dir)), f.model, second=keyword_model(), w_first=0.5, w_second=0.5, components=True)
    return out.where("error is null").select("id", "probability", *[round_exact(f"components.{c}").alias(c) for c in ("first", "second", "ensemble")])


@query
def weight_checks(spark, sf_dir):
    """Pairs of model weights made from the ids, around and off a total of one."""
    first = (F.col("id") % 21) / F.lit(20.0)
    second = F.lit(1.0) - first + (F.col("id") % 5 - 2) * F.lit(0.0006)
    return _msg(spark, sf_dir).select("id", first.alias("first"), F.round(second, 9).alias("second"),
                                      SC.weights_valid(first, second).alias("valid"))


@query
def trained_second_model(spark, sf_dir):
    """Requests scored by the linear model and the trained contextual one."""
    f = ML.fit(spark, sf_dir)
    out = SC.score_messages(requests(_msg(spark, sf_dir)), f.model, second=ML.trained_second_model(f))
    return out.select(*score_cols(), "roberta_enabled")


@query
def compare_trained_models(spark, sf_dir):
    """Precision / recall / F1 / ROC-AUC of the linear model, the trained contextual one
    and their blend on the test fold."""
    f = ML.fit(spark, sf_dir)
    second = ML.trained_second_model(f)
    p = _test_preds(spark, sf_dir).withColumn("pre", X.preprocess("clean_text", None))
    both = p.select("id", "y", "pre", F.col("prob").alias("first"), F.col("pred").alias("first_pred"), second.raw(F.col("pre")).alias("raw"))
    k = written(both.select("id", "y", "first", "first_pred",
                            F.when(F.col("pre") == "", F.lit(0.0)).otherwise(F.round(second.probability(F.col("raw")), 6)).alias("second")),
                "compared-scores")     # each evaluation reads the scores several times
    blend = F.round(SC.ensemble_score(F.col("first"), F.col("second"), True), 6)
    frames = (("tfidf", k.select("id", "y", F.col("first").alias("prob"), F.col("first_pred").alias("pred"))),
              ("contextual", k.select("id", "y", F.col("second").alias("prob"), (F.col("second") > 0.5).cast("int").alias("pred"))),
              ("ensemble", k.select("id", "y", blend.alias("prob"), (blend > 0.5).cast("int").alias("pred"))))
    rows = [EV.evaluation_summary(d).select(F.lit(name).alias("model"), "precision", "recall", "f1", "roc_auc") for name, d in frames]
    return EV.rounded(rows[0].unionByName(rows[1]).unionByName(rows[2]))


@query
def audit_log(spark, sf_dir):
    """Audit records appended to a folder as JSON lines and read back."""
    f = ML.fit(spark, sf_dir)
    path = scratch_path(spark, "audit-log")
    IO.write_audit_log(SC.audit_records(SC.score_messages(requests(_msg(spark, sf_dir)), f.model)), path)
    return IO.read_audit_log(spark, path).drop("timestamp")


EXPLAIN_TERMS = 5


@query
def explained_messages(spark, sf_dir):
    """The 6-field response of every request with the terms that weigh most towards
    malicious, and whether the prediction carries its time."""
    f = ML.fit(spark, sf_dir)
    scored = SC.score_messages(requests(_msg(spark, sf_dir)), f.model, include_explanation=True, explain_terms=EXPLAIN_TERMS)
    return scored.select("id", *SC.api_single(scored).columns[:2], F.col("mode_out").alias("mode"), F.col("channel_out").alias("channel"),
                         "is_malicious", "roberta_enabled", F.array_join("explanations", "; ").alias("explanations"),
                         F.to_timestamp("timestamp").isNotNull().alias("has_time"))


# ---------------------------------------------------------------------------
# Validation, sanitising, labels, sentinels
# ---------------------------------------------------------------------------

@query
def request_validation(spark, sf_dir):
    v = Q.validate_requests(requests(_msg(spark, sf_dir)))
    return v.select("id", "accepted", F.array_join("violations", "; ").alias("violations"),
                    "channel_norm", "mode_norm")


@query
def sanitized_text(spark, sf_dir):
    m = _msg(spark, sf_dir)
    return m.select("id", X.sanitize("body").alias("sanitized"), X.preprocess("body").alias("preprocessed"),
                    X.was_truncated("body").alias("was_truncated"))


@query
def null_sentinels(spark, sf_dir):
    m = _msg(spark, sf_dir).select("id", "body", "subject", "sender", "date_raw", "attack_label")
    return IO.na_sentinels(m, ["body", "subject", "sender", "date_raw", "attack_label"])


@query
def label_columns(spark, sf_dir):
    return _corpus(spark, sf_dir).select("message_id", "attack_label", C.label_smishing().alias("y_smishing"),
                                         C.label_malicious().alias("y_malicious"))


# ---------------------------------------------------------------------------
# File round trips (written to the shared scratch folder, read back)
# ---------------------------------------------------------------------------

@query
def file_roundtrip(spark, sf_dir):
    """Master corpus -> CSV (quoted multi-line text) -> read with the schema."""
    path = scratch_path(spark, "corpus-csv")
    IO.write_table(_corpus(spark, sf_dir), path, fmt="csv")
    return comparable(IO.read_csv(spark, path, S.CANONICAL_SCHEMA, null_value=IO.CSV_NULL))


@query
def corpus_parquet(spark, sf_dir):
    """Master corpus -> parquet partitioned by channel -> read back."""
    path = scratch_path(spark, "corpus-parquet")
    IO.write_table(_corpus(spark, sf_dir), path, partition_by="channel")
    return comparable(spark.read.parquet(path).select(*S.CANONICAL_COLUMNS))


ARCHIVE_FILE_BYTES = 256 << 20   # texts of one file of the archive: a file takes more than a split, its writer no more than this


@query
def mail_csv_splits(spark, sf_dir):
    """The raw mail archive as one CSV file (a large one as several, each larger than a split), its
    records dealt to many tasks -> canonical mail rows."""
    path = scratch_path(spark, "mail-one-csv")
    texts = mail_texts(_msg(spark, sf_dir))
    size = texts.agg(F.sum(F.coalesce(F.octet_length("message"), F.lit(0)))).first()[0] or 0
    files = -(-size // ARCHIVE_FILE_BYTES)
    IO.write_table(texts.repartition(files) if files > 1 else texts.coalesce(1), path, "csv")
    records = CS.csv_records(spark, path, True)
    return comparable(C.canonical_mail(CS.fields(records, S.MAIL_CSV_SCHEMA, IO.csv_field_options(IO.CSV_NULL))))


@query
def mail_csv_headers(spark, sf_dir):
    """Raw mail CSV (header row) read with imposed names: the header line
    stays as data; then the regex header table."""
    path = scratch_path(spark, "mail-csv")
    texts = mail_texts(_msg(spark, sf_dir))
    IO.write_table(texts, path, fmt="csv", header=False)
    # one header line for the archive, however many files its rows go to
    head = spark.createDataFrame([tuple(texts.columns)], ", ".join(f"{c} string" for c in texts.columns))
    IO.write_table(head, path, fmt="csv", header=False, mode="append")
    return extract_headers(IO.read_csv_named(spark, path, null_value=IO.CSV_NULL))


@query
def stored_predictions(spark, sf_dir):
    """Test-fold predictions written as (true_label, pred_label, prob_malicious),
    read back and evaluated: confusion counts, P/R/F1, ROC-AUC."""
    path = scratch_path(spark, "predictions")
    IO.write_predictions(_test_preds(spark, sf_dir), path)
    p = IO.read_predictions(spark, path).select(F.col("true_label").alias("y"), F.col("pred_label").alias("pred"),
                                                 F.col("prob_malicious").alias("prob"))
    return EV.rounded(EV.evaluation_summary(p))


# ---------------------------------------------------------------------------
# Streams (file source -> availableNow -> file sink, read back)
# ---------------------------------------------------------------------------

@query
def stream_scores(spark, sf_dir):
    """Requests arrive as parquet files; validated and scored per micro-batch."""
    from ..streaming.streams import score_stream

    f = ML.fit(spark, sf_dir)
    src, out, rej, ck = (scratch_path(spark, n) for n in ("req-in", "scores-out", "rejects-out", "scores-ckpt"))
    requests(_msg(spark, sf_dir)).write.parquet(src)
    score_stream(spark, src, f.model, out, rej, ck).awaitTermination()
    return spark.read.parquet(out).select(*score_cols())


@query
def stream_rejects(spark, sf_dir):
    """What the scoring stream turns away, with the reasons."""
    from ..streaming.streams import score_stream

    f = ML.fit(spark, sf_dir)
    src, out, rej, ck = (scratch_path(spark, n) for n in ("req-in", "scores-out", "rejects-out", "scores-ckpt"))
    requests(_msg(spark, sf_dir)).write.parquet(src)
    score_stream(spark, src, f.model, out, rej, ck).awaitTermination()
    return spark.read.parquet(rej).select("id", "violations")


def _files_stream(spark, kind, write):
    """Canonical rows of a stream of raw files. Ids contain the file's path, so the
    result tells only whether they are distinct."""
    from ..streaming.streams import canonicalize_files_stream

    src, out, ck = (scratch_path(spark, f"{kind}-{n}") for n in ("in", "out", "ckpt"))
    write(src)
    canonicalize_files_stream(spark, kind, src, out, ck, null_value=IO.CSV_NULL).awaitTermination()
    rows = comparable(spark.read.schema(S.CANONICAL_SCHEMA).parquet(out).select(*S.CANONICAL_COLUMNS))
    ids = rows.groupBy("message_id").agg(F.count(F.lit(1)).alias("ids"))
    return rows.join(ids, "message_id").drop("message_id")


@query
def stream_sms_files(spark, sf_dir):
    lines = tab_lines(_msg(spark, sf_dir)).select("value")
    return _files_stream(spark, "sms", lines.write.text)


@query
def stream_phishing_files(spark, sf_dir):
    rows = _phishing_rows(_msg(spark, sf_dir))
    return _files_stream(spark, "phishing", lambda path: IO.write_table(rows, path, fmt="csv"))


@query
def stream_canonical(spark, sf_dir):
    """SMS lines arrive as files; canonical rows appended by a streaming query."""
    from ..streaming.streams import canonicalize_stream

    src, out, ck = (scratch_path(spark, n) for n in ("lines-in", "canon-out", "canon-ckpt"))
    tab_lines(_msg(spark, sf_dir)).write.parquet(src)
    canonicalize_stream(spark, src, out, ck).awaitTermination()
    return comparable(spark.read.parquet(out))


# ---------------------------------------------------------------------------
# Logistic model (Spark ML) and model comparison
# ---------------------------------------------------------------------------

@query
def logistic_fit(spark, sf_dir):
    """Balanced L2 logistic regression on the train fold; saved and loaded
    back; one row per vocabulary term plus the intercept (term null)."""
    f = ML.fit(spark, sf_dir)
    m = ML.logistic_model(f)
    path = scratch_path(spark, "model")
    MD.save_model(m, path)
    back = MD.load_model(spark, path)
    icpt = spark.createDataFrame([(None, None, float(back.intercept))], "term string, idx int, coef double")
    return EV.rounded(back.vocab.select("term", "idx", "coef").unionByName(icpt), 6)


@query
def logistic_eval(spark, sf_dir):
    """Precision / recall / F1 / ROC-AUC of the logistic model on the test fold."""
    p = ML.logistic_predictions(ML.fit(spark, sf_dir))
    return EV.rounded(EV.evaluation_summary(p.withColumn("prob", F.round("prob", 6))), 4)


@query
def logistic_optimum(spark, sf_dir):
    """Sizes of the folds, number of terms, and whether the fit is at the (unique)
    optimum of its objective: every partial derivative is below 1e-4."""
    f = ML.fit(spark, sf_dir)
    train = f.split.where(F.col("fold") == "train")
    folds = f.split.agg(F.count_if(F.col("fold") == "train").alias("n_train"), F.count_if(F.col("fold") == "test").alias("n_test"))
    grad = MD.largest_gradient(train, ML.logistic_model(f)).select("terms", (F.col("gradient") < 1e-4).alias("at_optimum"))
    both = folds.unionByName(grad, allowMissingColumns=True)   # two rows, folded into one
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


GRADIENT_STEPS, GRADIENT_RATE = 4, 2.0


@query
def logistic_steps(spark, sf_dir):
    """Four gradient steps of the logistic objective with coefficients kept in tables: one row
    per vocabulary term plus the intercept (term null)."""
    m = ML.stepped_model(ML.fit(spark, sf_dir), GRADIENT_STEPS, GRADIENT_RATE)
    icpt = spark.createDataFrame([(None, None, float(m.intercept))], "term string, idx int, coef double")
    return EV.rounded(m.vocab.select("term", "idx", "coef").unionByName(icpt))


@query
def logistic_steps_eval(spark, sf_dir):
    """The model of ``logistic_steps`` on the test fold."""
    p = ML.stepped_predictions(ML.fit(spark, sf_dir), GRADIENT_STEPS, GRADIENT_RATE)
    return EV.rounded(EV.evaluation_summary(p.withColumn("prob", F.round("prob", 9))))


@query
def model_roundtrip(spark, sf_dir):
    """The log-odds model saved, loaded and listed."""
    path = scratch_path(spark, "log-odds")
    MD.save_model(ML.fit(spark, sf_dir).model, path)
    back = MD.load_model(spark, path)
    return EV.rounded(back.vocab.select("term", "idx", "df", "total_tf", "df_pos", "df_neg", "idf", "coef"))


@query
def smishing_eval(spark, sf_dir):
    """The first model generation: smishing against the rest of SMS and benign mail,
    20,000 terms; counts, precision, recall, F1 and ROC-AUC on its test fold."""
    f = ML.fit_smishing(spark, sf_dir)
    return EV.rounded(EV.evaluation_summary(ML.test_predictions(f).withColumn("prob", F.round("prob", 12))))


@query
def compare_models(spark, sf_dir):
    """Precision / recall / F1 / ROC-AUC of the linear model and the second
    (keyword) model on the same test fold."""
    p = _test_preds(spark, sf_dir)
    whole = X.preprocess("clean_text", None)   # both models see the whole text
    second = keyword_model()
    k = p.select("id", "y", (whole == "").alias("blank"), second.raw(whole).alias("raw")).select(
        "id", "y", F.when(F.col("blank"), F.lit(0.0)).otherwise(F.round(second.probability(F.col("raw")), 12)).alias("prob"),
        F.when(F.col("blank"), F.lit(0)).otherwise(second.label(F.col("raw"))).alias("pred"))
    rows = [EV.evaluation_summary(d).select(F.lit(name).alias("model"), "precision", "recall", "f1", "roc_auc")
            for name, d in (("tfidf", p.select("id", "y", "prob", "pred")), ("keyword", k))]
    return EV.rounded(rows[0].unionByName(rows[1]))


# ---------------------------------------------------------------------------
# Loading and batch requests
# ---------------------------------------------------------------------------

@query
def load_sources(spark, sf_dir):
    """Named datasets loaded together (a missing one is fatal); rows per dataset."""
    frames = IO.load_many(spark, {n: f"{sf_dir}/{n}.parquet" for n in ("documents", "labels")})
    return C.union_sources([df.select(F.lit(n).alias("dataset")) for n, df in frames.items()]).groupBy(
        "dataset").agg(F.count(F.lit(1)).alias("rows"))


BATCH_SIZE = 20  # messages per batch request built from the message table


@query
def batch_predictions(spark, sf_dir):
    """Messages grouped into batch requests of BATCH_SIZE (by id order); every item
    gives one row with its input index: a 3-field response, or an error row for
    a bad text or the batch's bad mode."""
    f = ML.fit(spark, sf_dir)
    req = requests(_msg(spark, sf_dir))
    b = F.col("batch_id")
    mode = (F.when(b % 7 == 6, F.lit("bogus")).when(b % 3 == 0, F.lit("balanced"))
            .when(b % 3 == 1, F.lit("high_recall")).otherwise(F.lit("LOW_FP")))
    batches = req.groupBy((F.col("id") / BATCH_SIZE).cast("long").alias("batch_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", "text", "channel"))),   # <= BATCH_SIZE items
                    lambda m: F.struct(m["text"].alias("text"), m["channel"].alias("channel"),
                                       m["id"].alias("id"))).alias("messages")).withColumn("mode", mode)
    scored = SC.score_messages(Q.batch_items(batches), f.model, error_col="item_error")
    return scored.select("batch_id", "index", "id", *SC.api_batch(scored).columns, "error")


FLAGSHIP = "scored_messages"
