"""Quality rules as a bitmask ledger.

Every measurement and rule is evaluated once per document; the ledger stores
the measurements and one failure bit per rule. Policies are versioned bit
masks applied to stored bits, so a new policy or an ablation never reads a
text again. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, let, words

SYMBOLS = "#*$%&|<>"

# rule name -> bit; a bit keeps its meaning for good, new rules get new bits
RULE_BITS = {
    "too_few_words": 0,     # under 50 words
    "repeated_words": 1,    # over half of the words lie in repeated 3-word windows
    "symbols": 2,           # over one markup symbol in ten words
    "word_length": 3,       # mean word shorter than 2 or longer than 20 characters
    "repeated_lines": 4,    # over half of the lines repeat an earlier line
    "exclaiming": 5,        # '!!' after over half of the words
}

POLICIES = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "symbols"),
    "v2": ("too_few_words", "repeated_words", "symbols", "word_length", "repeated_lines", "exclaiming"),
}


def policy_mask(policy) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << RULE_BITS[n] for n in names)


def repeated_window_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more (w: word array).

    Windows are compared by a 64-bit chained hash inside one document. Sorting
    (hash, position) puts equal windows side by side; the covered words follow
    from the gaps between the flagged positions in ascending order.
    """
    last = F.size(w) - 3
    windows = F.transform(F.sequence(F.lit(0), last),
                          lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    def same(s, j, e):
        return F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))

    flagged = let(F.sort_array(windows), lambda s: F.sort_array(F.transform(
        F.filter(s, lambda e, j: same(s, j - 1, e) | same(s, j + 1, e)), lambda e: e["i"])))
    covered = let(flagged, lambda p: F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))),
        F.lit(0), lambda a, x: a + x))
    return F.when(F.size(w) >= 3, covered).otherwise(F.lit(0)).cast("long")


def measure(text: Column) -> Column:
    """All measurements of one text as a struct (null: as the empty text)."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    return let(words(text), lambda w: let(lines, lambda ln: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, WS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(ln).cast("long").alias("n_lines"),
        (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
        repeated_window_words(w).alias("n_repeat_words"),
        ((F.length(t) - F.length(F.replace(t, F.lit("!!"), F.lit("")))) / 2).cast("long").alias("n_exclaims"),
    )))


def rule_failures(m: Column) -> dict[str, Column]:
    """Failure condition of every rule on the measurement struct (whole-number comparisons)."""
    n = m["n_words"]
    return {
        "too_few_words": n < 50,
        "repeated_words": 100 * m["n_repeat_words"] > 50 * n,
        "symbols": 10 * m["n_symbols"] > n,
        "word_length": (m["word_chars"] < 2 * n) | (m["word_chars"] > 20 * n),
        "repeated_lines": 2 * m["n_dup_lines"] > m["n_lines"],
        "exclaiming": 2 * m["n_exclaims"] > n,
    }


def build_ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, measurements..., fail_bits): one row per input row, no shuffle.

    Null texts count as empty (0 words: they fail ``too_few_words``); repeated
    rows and null ids each keep their row; extra columns are ignored; an empty
    table gives an empty ledger.
    """
    m = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(measure(F.col(text)))).alias("m"))
    bits = F.lit(0).cast("long")
    for name, failed in rule_failures(F.col("m")).items():
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << RULE_BITS[name])).otherwise(F.lit(0)).cast("long"))
    return m.select("doc_id", "m.*", bits.alias("fail_bits"))


def passes(fail_bits: Column, policy) -> Column:
    return fail_bits.bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0


def apply_policy(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds base_failed (policy "base"), kept (base and ``policy``) and the policy's version."""
    bits = F.col("fail_bits")
    return (ledger.withColumn("base_failed", ~passes(bits, "base"))
            .withColumn("kept", passes(bits, "base") & passes(bits, policy))
            .withColumn("policy", F.lit(policy)))


def ablations(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """What each rule of a policy does, from the stored bits alone:
    (rule, failing, failing_alone, kept, kept_without). One aggregation to at
    most 2^rules bit patterns, then bit tests per rule."""
    mask = policy_mask(policy)
    patterns = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n"))
    rules = [n for n in (POLICIES[policy] if isinstance(policy, str) else policy)]
    per_rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULE_BITS[r]).cast("long").alias("bit"))
                                   for r in rules])).alias("r")
    x = patterns.select("bits", "n", per_rule).select("bits", "n", "r.rule", "r.bit")
    failing = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    kept = F.col("bits") == 0
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return x.groupBy("rule").agg(count(failing).alias("failing"), count(alone).alias("failing_alone"),
                                 count(kept).alias("kept"), count(kept | alone).alias("kept_without"))
