"""Validation of canonical sources and corpus reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from .canonical import union_sources


class CorpusValidationError(ValueError):
    def __init__(self, violations: list[tuple]):
        self.violations = violations
        lines = "\n".join(f"  - {v[0]}: {v[1]}" for v in violations)
        super().__init__(f"corpus validation failed:\n{lines}")


VIOLATION_SCHEMA = T.StructType([
    T.StructField("source_dataset", T.StringType()),
    T.StructField("violation", T.StringType()),
])


def schema_violations(df: DataFrame, name: str) -> list[tuple[str, str]]:
    """(source, violation) for each column that is absent, unknown or not at its
    canonical position; positions count only when the names are right (metadata only)."""
    place = {c: i for i, c in enumerate(S.CANONICAL_COLUMNS, 1)}
    here = {c: i for i, c in enumerate(df.columns, 1)}
    wrong = [f"column {c} is absent" for c in place if c not in here] + [f"column {c} is unknown" for c in here if c not in place]
    wrong = wrong or [f"column {c} is at position {here[c]} instead of {place[c]}" for c in place if here[c] != place[c]]
    return [(name, w) for w in wrong]


def required_field_report(sources: dict[str, DataFrame], fields=S.REQUIRED_FIELDS) -> DataFrame:
    """Null counts of the required fields for every source, in one pass.

    Sources lacking a field report it as a violation instead of failing.
    Output: (source_name, field, null_count).
    """
    parts = []
    for name, df in sources.items():
        present = [f for f in fields if f in df.columns]
        missing = [f for f in fields if f not in df.columns]
        cols = [F.col(f).isNull().alias(f) for f in present] + [F.lit(None).cast("boolean").alias(f) for f in missing]
        parts.append(df.select(F.lit(name).alias("source_name"), *cols))
    tagged = union_sources(parts)
    agg = tagged.groupBy("source_name").agg(*[F.count_if(F.col(f)).alias(f) for f in fields])
    stack = ", ".join(f"'{f}', `{f}`" for f in fields)
    return agg.select("source_name", F.expr(f"stack({len(fields)}, {stack}) AS (field, null_count)"))


def build_master_corpus(sources: dict[str, DataFrame], strict: bool = True) -> DataFrame:
    """Validate every source (schema and required fields), then UNION ALL.

    In strict mode every violation is reported, then the build fails.
    """
    violations = []
    for name, df in sources.items():
        violations += schema_violations(df, name)
    if strict:
        bad = (required_field_report(sources).where(F.col("null_count") > 0)
               .orderBy("source_name", "field").collect())  # <= sources x fields rows
        violations += [(r["source_name"], f"Field '{r['field']}' has {r['null_count']} null values") for r in bad]
        if violations:
            raise CorpusValidationError(violations)
    elif violations:
        raise CorpusValidationError(violations)
    return union_sources([df.select(*S.CANONICAL_COLUMNS) for df in sources.values()])


def distribution(df: DataFrame, dims=("attack_label", "channel", "manipulation_tactic", "source_dataset")) -> DataFrame:
    """value -> count and percent of all rows (nulls count in the denominator
    but are not listed), for several columns in one scan and one shuffle."""
    stack = ", ".join(f"'{d}', CAST(`{d}` AS STRING)" for d in dims)
    long = df.select(F.expr(f"stack({len(dims)}, {stack}) AS (dimension, value)"))
    counts = long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy("dimension"))
    return (counts.withColumn("percent", F.round(F.col("count") * 100.0 / total, 6))
            .where(F.col("value").isNotNull())
            .orderBy("dimension", F.desc("count"), "value"))


MAX_CROSSTAB_COLUMNS = 1000


def crosstab_margins(df: DataFrame, row: str = "channel", col: str = "attack_label",
                     values=("benign", "phishing", "smishing")) -> DataFrame:
    """row x col counts with an 'All' row and column; pairs with a null dropped.

    ``values`` have a column in any case; every other value found gets one too. With
    more than ``MAX_CROSSTAB_COLUMNS`` values the table comes in long form (``crosstab_long``).
    """
    pairs = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    found = [r[0] for r in pairs.select(col).distinct().limit(MAX_CROSSTAB_COLUMNS + 1).collect()]
    if len(found) > MAX_CROSSTAB_COLUMNS:
        return crosstab_long(df, row, col)
    values = [*values, *sorted(set(found) - set(values))]
    wide = pairs.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1))).na.fill(0, list(values))
    wide = wide.withColumn("All", reduce(lambda a, b: a + b, [F.col(v) for v in values]))
    total = wide.agg(*[F.sum(v).cast("bigint").alias(v) for v in list(values) + ["All"]]).select(
        F.lit("All").alias(row), *list(values), "All")
    return wide.unionByName(total)


def crosstab_long(df: DataFrame, row: str = "channel", col: str = "attack_label") -> DataFrame:
    """(row, col, count) of all pairs without a null, with the margins as rows ('All', col), (row, 'All')
    and ('All', 'All'); for any number of values."""
    pairs = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row, col).agg(F.count(F.lit(1)).alias("_n"))
    sums = pairs.cube(row, col).agg(F.sum("_n").alias("count"), F.grouping(row).alias("_r"), F.grouping(col).alias("_c"))
    name = lambda c, g: F.when(F.col(g) == 1, F.lit("All")).otherwise(F.col(c).cast("string")).alias(c)
    return sums.where("count is not null").select(name(row, "_r"), name(col, "_c"), "count")


def health_report(df: DataFrame, by: str = "source_dataset") -> DataFrame:
    """Per source: totals, non-null texts, missing timestamps, label counts."""
    n = F.count(F.lit(1))

    def pct(c):
        return F.round(F.try_divide(c * 100.0, n), 6)

    return df.groupBy(by).agg(
        n.alias("total_rows"),
        F.count("raw_text").alias("non_null_raw"),
        F.count("clean_text").alias("non_null_clean"),
        F.count_if(F.col("timestamp").isNull()).alias("missing_timestamp"),
        F.count_if(F.col("attack_label") == "benign").alias("benign_rows"),
        F.count_if(F.col("attack_label").isin(*S.MALICIOUS_LABELS)).alias("malicious_rows"),
        pct(F.count("clean_text")).alias("non_null_clean_pct"),
        pct(F.count_if(F.col("timestamp").isNull())).alias("missing_timestamp_pct"),
        pct(F.count_if(F.col("attack_label") == "benign")).alias("benign_pct"),
    )


# ---------------------------------------------------------------------------
# Request validation
# ---------------------------------------------------------------------------

def _text_rules(t):
    from ..functions.text import is_blank

    n = F.length(t)
    return [
        F.when(t.isNull(), F.lit("text: field required")),
        F.when(n < 1, F.lit("text: at least 1 character")),
        F.when(n > S.MAX_REQUEST_CHARS, F.lit(f"text: at most {S.MAX_REQUEST_CHARS} characters")),
        F.when((n >= 1) & (n <= S.MAX_REQUEST_CHARS) & is_blank(t), F.lit("text: cannot be empty or whitespace only")),
    ]


def validate_requests(req: DataFrame, text: str = "text", channel: str = "channel", mode: str = "mode") -> DataFrame:
    """Single prediction requests: text 1..50,000 characters and not blank,
    channel and mode in their sets (case-folded; missing -> default).
    Adds ``violations`` (array), ``accepted`` and the normalised channel/mode."""
    ch = F.coalesce(F.col(channel), F.lit("unknown"))
    md = F.coalesce(F.col(mode), F.lit(S.DEFAULT_MODE))
    rules = _text_rules(F.col(text)) + [
        F.when(~F.lower(ch).isin(*S.CHANNELS), F.lit("channel: must be one of email, sms, unknown")),
        F.when(~F.lower(md).isin(*S.MODE_THRESHOLDS), F.lit("mode: must be one of balanced, high_recall, low_fp")),
    ]
    v = F.array_compact(F.array(*rules))
    return req.select("*", v.alias("violations"), (F.size(v) == 0).alias("accepted"),
                      F.lower(ch).alias("channel_norm"), F.lower(md).alias("mode_norm"))


def validate_batches(batches: DataFrame, messages: str = "messages", mode: str = "mode") -> DataFrame:
    """Batch requests: 1..100 messages, every item's text valid (items have
    no channel rule), mode in its set. Adds ``violations`` and ``accepted``."""
    n = F.size(F.col(messages))
    bad_item = F.exists(F.col(messages), lambda m: F.size(F.array_compact(F.array(*_text_rules(m["text"])))) > 0)
    md = F.coalesce(F.col(mode), F.lit(S.DEFAULT_MODE))
    v = F.array_compact(F.array(
        F.when(F.col(messages).isNull() | (n < 1), F.lit("messages: at least 1 item")),
        F.when(n > S.MAX_BATCH, F.lit(f"messages: at most {S.MAX_BATCH} items")),
        F.when(F.coalesce(bad_item, F.lit(False)), F.lit("messages: invalid item text")),
        F.when(~F.lower(md).isin(*S.MODE_THRESHOLDS), F.lit("mode: must be one of balanced, high_recall, low_fp")),
    ))
    return batches.select("*", v.alias("violations"), (F.size(v) == 0).alias("accepted"))


def batch_items(batches: DataFrame, key: str = "batch_id", messages: str = "messages", mode: str = "mode") -> DataFrame:
    """One row per item of every batch, with its input ``index``, its other fields
    and ``item_error`` (null for an item that can be scored). A bad item or a bad
    mode costs no other row."""
    items = batches.select(key, F.coalesce(F.col(mode), F.lit(S.DEFAULT_MODE)).alias("mode"),
                           F.posexplode(messages).alias("index", "m"))
    fields = batches.schema[messages].dataType.elementType.names
    rest = [F.col(f"m.{f}").alias(f) for f in fields if f not in ("text", "channel")]
    return items.select(key, "index", F.col("m.text").alias("text"),
                        F.coalesce(F.col("m.channel"), F.lit("unknown")).alias("channel"), "mode", *rest,
                        F.coalesce(*_text_rules(F.col("m.text"))).alias("item_error"))
