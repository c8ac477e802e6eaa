"""Word 1-2-gram TF-IDF in long form: (doc, term, weight).

Tokens are maximal runs of two or more word characters of the lower-cased
text (Python ``\\w`` semantics); bigrams join neighbouring tokens with a
space. Weights are sub-linear and smoothed:

    w = (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1),  then L2-normalised per doc

Plan: count inside the row -> explode -> aggregate per term for the
vocabulary (the one shuffle) -> join the capped vocabulary (broadcast only
below a checked size) -> per-doc norms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import WORD

# Vocabularies up to this size are broadcast; larger ones are joined with a
# shuffle. Terms have no length limit, so bytes are counted, not rows.
BROADCAST_VOCAB_BYTES = 32 << 20
TERM_OVERHEAD = 48   # bytes of a row besides the term's characters


def tokens(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(f"{WORD}{{2,}}"), 0)


def ngrams_of(tok: Column) -> Column:
    """Unigrams followed by bigrams of a token-array column (the column must
    be a plain reference: a lambda over an expression would re-evaluate it
    per element)."""
    n = F.size(tok)
    big = F.when(n >= 2, F.zip_with(F.slice(tok, 1, n - 1), F.slice(tok, 2, n - 1),
                                    lambda a, b: F.concat(a, F.lit(" "), b))
                 ).otherwise(F.array().cast("array<string>"))
    return F.concat(tok, big)


def counted(grams: Column) -> Column:
    """Distinct n-grams of an array with their counts, as array of (term, tf): run
    lengths of the sorted array (bound to a lambda variable, so it is sorted once)."""
    def lengths(s):
        placed = F.transform(s, lambda t, i: F.struct(t.alias("term"), i.alias("at")))
        firsts = F.filter(placed, lambda e: ~F.get(s, e["at"] - 1).eqNullSafe(e["term"]))
        return F.transform(F.array(firsts), lambda f: F.transform(f, lambda e, j: F.struct(
            e["term"].alias("term"), (F.coalesce(F.get(f, j + 1)["at"], F.size(s)) - e["at"]).cast("long").alias("tf"))))

    return F.flatten(F.flatten(F.transform(F.array(F.sort_array(grams)), lengths)))


def term_counts(docs: DataFrame, id_col: str, text_col: str, carry=()) -> DataFrame:
    """(id, *carry, term, tf) for every n-gram of every document.

    Counted inside the row: no shuffle, and documents that share an id stay
    apart. ``carry`` columns (e.g. the label) ride along.
    """
    d = docs.select(F.col(id_col).alias("id"), *carry, tokens(text_col).alias("_tok"))
    return d.select("id", *carry, F.explode(counted(ngrams_of(F.col("_tok")))).alias("t")).select("id", *carry, "t.term", "t.tf")


SLICE_TOKENS = 1 << 21      # tokens that a Python task counts at a time
SLICE_ROWS = 128            # texts by which these are gathered
BATCH_ROWS = 1024           # texts of an Arrow batch, where the session has not chosen a number


def _counts_of(tokens, ones, zeros):
    """Columns (term, df, total_tf, df_pos, df_neg) of the unigrams and bigrams of some texts: numbers of
    words stand for the words, and pairs of them for bigrams."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    words = tokens.flatten().dictionary_encode()
    code, k = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(words.dictionary))
    doc = np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
    follows = np.flatnonzero(doc[1:] == doc[:-1])
    pairs, pair = np.unique(code[follows] * k + code[follows + 1], return_inverse=True)
    joined = pc.binary_join_element_wise(words.dictionary.take(pa.array(pairs // k)), words.dictionary.take(pa.array(pairs % k)), " ")

    out = []
    for at, of, n in ((code, doc, len(words.dictionary)), (pair, doc[follows], len(pairs))):
        seen = np.unique(of * max(1, n) + at)               # each text's distinct terms
        of, term = seen // max(1, n), seen % max(1, n)
        out.append([np.bincount(x, minlength=n) for x in (term, at, term[ones[of]], term[zeros[of]])])
    return [pa.concat_arrays([words.dictionary, joined]), *[pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)]]


def term_stats(docs: DataFrame, text_col: str, label: str) -> DataFrame:
    """Per n-gram: df, total count, df among label 1 and label 0 documents. Texts are counted
    in slices, so that a term goes through the shuffle once per slice and not once per text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if docs.sparkSession.conf.get(key) == "10000":
        docs.sparkSession.conf.set(key, str(BATCH_ROWS))
    names = ["term", "df", "total_tf", "df_pos", "df_neg"]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def counted_slice(parts):
            held = pa.Table.from_batches(parts).combine_chunks()
            tok, y = (held.column(i).chunk(0) for i in range(2))
            ones, zeros = (pc.fill_null(pc.equal(y, v), False).to_numpy(zero_copy_only=False).astype(bool) for v in (1, 0))
            return pa.RecordBatch.from_arrays(_counts_of(tok, ones, zeros), names=names)

        parts, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                parts.append(b.slice(at, SLICE_ROWS))
                n += pc.sum(pc.list_value_length(parts[-1].column(0))).as_py() or 0
                if n >= SLICE_TOKENS:
                    yield counted_slice(parts)
                    parts, n = [], 0
        if n:
            yield counted_slice(parts)

    some = docs.select(tokens(text_col).alias("_tok"), F.col(label).cast("long").alias("_y")).mapInArrow(
        run, "term string, " + ", ".join(f"{c} long" for c in names[1:]))
    return some.groupBy("term").agg(*[F.sum(c).alias(c) for c in names[1:]])


def vocab_bytes(vocab: DataFrame) -> int:
    return vocab.agg(F.sum(F.octet_length("term") + TERM_OVERHEAD)).first()[0] or 0


def join_vocab(tf: DataFrame, vocab: DataFrame, size: int | None = None) -> DataFrame:
    """Inner join of term counts with the vocabulary: broadcast only when its
    size in bytes (counted if not given) is small, shuffle join otherwise."""
    size = vocab_bytes(vocab) if size is None else size
    return tf.join(F.broadcast(vocab) if size <= BROADCAST_VOCAB_BYTES else vocab, "term")


def tfidf(tf: DataFrame, vocab: DataFrame, size: int | None = None) -> DataFrame:
    """(id, term, weight) with L2-normalised sub-linear TF-IDF weights."""
    j = join_vocab(tf, vocab.select("term", "idf", *[c for c in vocab.columns if c == "coef"]), size)
    w = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")
    j = j.withColumn("raw_w", w)
    norm = F.sqrt(F.sum(F.col("raw_w") * F.col("raw_w")).over(Window.partitionBy("id")))
    return j.withColumn("weight", F.col("raw_w") / norm).drop("raw_w")
