"""Hard-negative mining: risk wording in benign messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from .canonical import drop_null_text

FLAGS = [("has_url", "URL"), ("has_phone", "Phone"), ("has_authority", "Authority"), ("has_urgency", "Urgency")]


def filter_benign(df: DataFrame, col: str = "attack_label") -> DataFrame:
    return df.where(F.col(col) == "benign")


def risk_flags(corpus: DataFrame, text_col: str = "clean_text") -> DataFrame:
    """Benign rows with non-null text, four flags, any / count / names."""
    b = filter_benign(drop_null_text(corpus, text_col))
    t = F.col(text_col)
    flagged = b.select("*", X.has_url(t).alias("has_url"), X.has_phone(t).alias("has_phone"),
                       X.has_authority(t).alias("has_authority"), X.has_urgency(t).alias("has_urgency"))
    any_ = F.col("has_url") | F.col("has_phone") | F.col("has_authority") | F.col("has_urgency")
    count = sum(F.col(f).cast("int") for f, _ in FLAGS)
    names = F.array_join(F.array_compact(F.array(*[F.when(F.col(f), F.lit(n)) for f, n in FLAGS])), ", ")
    return flagged.select("*", any_.alias("any_suspicious"), count.alias("pattern_count"), names.alias("patterns"))


def risk_report(flags: DataFrame) -> DataFrame:
    """Counts and percents of each flag, of any flag and of two or more flags."""
    n = F.count(F.lit(1))
    cnt = {
        "url": F.count_if("has_url"), "phone": F.count_if("has_phone"),
        "authority": F.count_if("has_authority"), "urgency": F.count_if("has_urgency"),
        "any_suspicious": F.count_if("any_suspicious"), "multi_pattern": F.count_if(F.col("pattern_count") >= 2),
    }
    aggs = [n.alias("total_benign")]
    for k, c in cnt.items():
        aggs.append(c.alias(f"{k}_count"))
        aggs.append(F.round(F.try_divide(100.0 * c, n), 6).alias(f"{k}_pct"))
    return flags.agg(*aggs)


def risk_samples(flags: DataFrame, k: int = S.SAMPLES_PER_CATEGORY, seed: int = S.RANDOM_STATE,
                 key_col: str = "message_id", text_col: str = "clean_text") -> DataFrame:
    """Up to ``k`` seeded examples per flag and for two-or-more flags.

    Rows are exploded into the categories they belong to and ranked by
    md5(seed, key) inside each category; the filter on the rank lets
    Catalyst insert a partial group limit before the shuffle, so a hot
    category never reaches one task whole.
    """
    cats = F.array_compact(F.array(
        *[F.when(F.col(f), F.lit(n)) for f, n in FLAGS],
        F.when(F.col("pattern_count") >= 2, F.lit("Multiple")),
    ))
    e = flags.select(F.explode(cats).alias("category"), key_col, "channel", "patterns",
                     X.preview(F.col(text_col), 300, ellipsis=False, flatten=True).alias("text_preview"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key_col)))
    w = Window.partitionBy("category").orderBy(order, F.col(key_col))
    return (e.withColumn("sample_rank", F.row_number().over(w))
             .where(F.col("sample_rank") <= k))
