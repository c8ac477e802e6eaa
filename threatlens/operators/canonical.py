"""Raw sources -> the 14-column canonical message table, and the union.

Each canonicaliser is a lazy DataFrame -> DataFrame function made of one
projection (plus a row filter); the union of all sources stays one plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import text as X
from ..sources.mail import parse_mail


def _canonical(**cols: Column) -> list[Column]:
    return [cols[name].cast(S.CANONICAL_SCHEMA[name].dataType).alias(name) for name in S.CANONICAL_COLUMNS]


# ---------------------------------------------------------------------------
# SMS label/text lines
# ---------------------------------------------------------------------------

def parse_labeled_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Adds ``label``, ``message`` and ``accepted`` to label-TAB-message lines.

    The line is stripped, split on the first TAB, the label stripped and
    lower-cased; accepted when the label is ham/spam and the message non-blank.
    """
    s = X.py_strip(F.col(value_col))
    parts = F.split(s, "\t", 2)
    label = F.lower(X.py_strip(F.get(parts, 0)))
    message = X.py_strip(F.get(parts, 1))
    accepted = (F.size(parts) == 2) & label.isin("ham", "spam") & (message != "")
    return lines.select("*", label.alias("label"), message.alias("message"),
                        F.coalesce(accepted, F.lit(False)).alias("accepted"))


def canonical_sms(parsed: DataFrame, key_col: str = "line_no") -> DataFrame:
    """Accepted SMS lines -> canonical rows (spam -> smishing/exploit + tactic).

    Rejected lines are dropped by a generator over a 0/1-element array (a
    filter would be pushed below the parse and re-run it)."""
    spam = F.col("label") == "spam"
    msg = F.col("message")
    row = F.struct(*_canonical(
        message_id=X.stable_id(F.lit(S.SOURCE_SMS), F.col(key_col), msg),
        raw_text=msg,
        clean_text=X.clean_sms(msg),
        channel=F.lit("sms"),
        language=F.lit("en"),
        sender_id=F.lit("unknown"),
        receiver_id=F.lit("unknown"),
        sender_role=F.lit("unknown"),
        timestamp=F.lit(None),
        attack_label=F.when(spam, "smishing").otherwise("benign"),
        manipulation_tactic=F.when(spam, X.detect_tactic_sms(msg)).otherwise(F.lit(S.SMS_TACTIC_DEFAULT)),
        intent_stage=F.when(spam, "exploit").otherwise("benign"),
        source_dataset=F.lit(S.SOURCE_SMS),
        confidence_label=F.lit("high"),
    ))
    rows = F.when(F.col("accepted"), F.array(row)).otherwise(F.array().cast(T.ArrayType(S.CANONICAL_SCHEMA)))
    return parsed.select(F.inline(rows))


def line_counts(parsed: DataFrame) -> DataFrame:
    """Parsed and skipped line counts in one pass."""
    return parsed.agg(F.count_if("accepted").alias("lines_parsed"),
                      F.count_if(~F.col("accepted")).alias("lines_skipped"))


# ---------------------------------------------------------------------------
# Benign mail archive (raw RFC-822 text)
# ---------------------------------------------------------------------------

def canonical_mail(raw: DataFrame, message_col: str = "message") -> DataFrame:
    """Parsed mail -> canonical benign rows; unparsable or id-less mail dropped.

    The drop is a generator over a 0/1-element array rather than a filter: a
    filter would be pushed below the parse and re-run its expressions.
    """
    m = parse_mail(raw, message_col)
    keep = F.col("mail.parse_ok") & (F.coalesce(F.col("mail.message_id"), F.lit("")) != "")
    body = F.col("mail.body")
    row = F.struct(*_canonical(
        message_id=F.col("mail.message_id"),
        raw_text=body,
        clean_text=F.when(F.coalesce(body, F.lit("")) != "", X.clean_mail_text(body)),
        channel=F.lit("email"),
        language=F.lit("en"),
        sender_id=X.normalize_address(F.col("mail.from_addr")),
        receiver_id=X.normalize_address(F.col("mail.to_addr")),
        sender_role=F.lit("unknown"),
        timestamp=X.parse_timestamp_utc(F.col("mail.date")),
        attack_label=F.lit("benign"),
        manipulation_tactic=F.lit("none"),
        intent_stage=F.lit("benign"),
        source_dataset=F.lit(S.SOURCE_MAIL),
        confidence_label=F.lit("high"),
    ))
    rows = F.when(F.coalesce(keep, F.lit(False)), F.array(row)).otherwise(F.array().cast(T.ArrayType(S.CANONICAL_SCHEMA)))
    return m.select(F.inline(rows))


# ---------------------------------------------------------------------------
# Labelled phishing mail
# ---------------------------------------------------------------------------

def filter_label(df: DataFrame, value: int = 1, col: str = "label") -> DataFrame:
    return df.where(F.col(col) == value)


def canonical_phishing(df: DataFrame, key_col: str | None = None) -> DataFrame:
    """label = 1 rows -> canonical phishing rows.

    Blank body -> raw ''/clean '[empty]'; tactic over subject + ' ' + body
    (a missing subject prints as 'nan', which matches no keyword). Without a key
    column the id follows from the whole row, with the ``copy_no`` of
    ``number_copies`` (and the ``file`` of a stream) if there are such columns.
    """
    rows = filter_label(df)
    body = F.col("body")
    raw = F.when(X.is_blank(body), F.lit("")).otherwise(body)
    full = F.concat(F.coalesce(F.col("subject"), F.lit("nan")), F.lit(" "), raw)
    whole = ("file", "sender", "receiver", "date", "subject", "body", "copy_no")
    key = [F.col(c) for c in ([key_col] if key_col else whole) if c in df.columns]
    return rows.select(*_canonical(
        message_id=X.stable_id(F.lit(S.SOURCE_PHISHING), *key, raw),
        raw_text=raw,
        clean_text=F.coalesce(X.clean_mail_body(raw), F.lit("[empty]")),
        channel=F.lit("email"),
        language=F.lit("en"),
        sender_id=X.anonymize_address(F.col("sender")),
        receiver_id=X.anonymize_address(F.col("receiver")),
        sender_role=F.lit("unknown"),
        timestamp=X.parse_timestamp_utc(F.col("date")),
        attack_label=F.lit("phishing"),
        manipulation_tactic=X.detect_tactic_mail(full),
        intent_stage=F.lit("exploit"),
        source_dataset=F.lit(S.SOURCE_PHISHING),
        confidence_label=F.lit("high"),
    ))


# ---------------------------------------------------------------------------
# Labels used for modelling
# ---------------------------------------------------------------------------

def drop_null_text(df: DataFrame, col: str = "clean_text") -> DataFrame:
    return df.na.drop(subset=[col])


def label_smishing(col: str = "attack_label") -> Column:
    """1 when the label is smishing; null -> 0."""
    return F.coalesce((F.col(col) == "smishing").cast("int"), F.lit(0))


def label_malicious(col: str = "attack_label") -> Column:
    """1 when the label is smishing or phishing; null -> 0."""
    return F.coalesce(F.col(col).isin(*S.MALICIOUS_LABELS).cast("int"), F.lit(0))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Row concatenation (UNION ALL) by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)
