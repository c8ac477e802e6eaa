"""SimHash near-duplicates found through pivot distance tables.

1. Each text gets a 64-bit fingerprint: bit i is 1 if over half of its shingle
   hashes have bit i. Equal fingerprints are collapsed first, so copies never
   meet as pairs.
2. Fingerprints are cut into ``BLOCKS`` blocks of bits. Two that differ in at
   most d bits agree in some choice of BLOCKS - d blocks, so each is dealt once
   per choice under the bits of that choice: every link meets in a bucket.
3. Inside a bucket the pivot tables decide: the Hamming distances to reference
   fingerprints are known for each member, and by the triangle inequality a
   pair whose distances to any pivot differ by more than d cannot be linked.
   What is left is verified on the fingerprints.
4. A bucket reports a spanning forest of its links (not its pairs), and the
   components follow from the forests by alternating star contractions.

Buckets over ``TILE`` members are split into tile pairs that go to different
tasks.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, store

SHINGLE = 3
MAX_BITS = 3
BLOCKS = 6          # 20 choices of 3 blocks, 32 or 33 key bits each
PIVOTS = 16         # reference fingerprints of the distance table
TILE = 2048
SEED = 42           # of the shingle hash
FLUSH = 1_000_000   # verified pairs held before they are reduced to a forest


# --- fingerprints -------------------------------------------------------------

def shingle_hashes(text: bytes, size: int = SHINGLE):
    """XXH64 values of the shingles of a UTF-8 text, A-Z lower-cased; bytes.split()
    parts at exactly the ASCII white space of the word rule."""
    from itertools import accumulate

    from xxhash import xxh64_intdigest as h

    w = text.lower().split()
    if not w:
        return []
    joined = b" ".join(w)
    if len(w) <= size:
        return [h(joined, SEED)]
    starts = [0, *accumulate(len(x) + 1 for x in w)]
    return [h(joined[a:b - 1], SEED) for a, b in zip(starts, starts[size:])]


def fingerprint_of(text: bytes | None, size: int = SHINGLE) -> int:
    import numpy as np

    hashes = shingle_hashes(text, size) if text else []
    if not hashes:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at:at + 65536], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(size):
    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    return lambda texts: [[signed(fingerprint_of(t, size)) for t in texts]]


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Columns ``keep`` and ``fp`` (the 64 bits as a long); null and blank texts: 0."""
    raw = docs.withColumn(text, F.col(text).cast("binary")) if dict(docs.dtypes)[text] != "binary" else docs
    return map_texts(raw, keep, text, "fp long", _fingerprints, shingle)


def fp_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- links --------------------------------------------------------------------

def block_masks(max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> list[int]:
    """Bit masks of every choice of ``blocks - max_bits`` blocks of the 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - max_bits)]


def pivot_table(fps, n_pivots: int = PIVOTS):
    """Hamming distances of each fingerprint to the pivots (uint8, one row each)."""
    import numpy as np

    pivots = np.random.default_rng(7).integers(0, 1 << 64, n_pivots, dtype=np.uint64, endpoint=False)
    return np.bitwise_count(fps[:, None] ^ pivots[None, :])


def _forest(a, b, n):
    """Labels of the components of n nodes joined by pairs a[i]-b[i] (smallest member)."""
    import numpy as np

    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def bucket_links(keys, fps, max_bits: int = MAX_BITS):
    """Forest links (fp, fp) inside the runs of equal keys of a sorted block.

    Partners are tried by their offset in the run, for all runs at once; the
    pairs that pass the pivot test and the check are reduced to a forest
    whenever ``FLUSH`` of them have gathered, so memory follows the rows.
    """
    import numpy as np

    n = len(keys)
    table = pivot_table(fps)
    heads, pairs_a, pairs_b, held = np.arange(n), [], [], 0
    label = np.arange(n)

    def reduce(label):
        a, b = np.concatenate([*pairs_a, np.arange(n)]), np.concatenate([*pairs_b, label])
        pairs_a.clear()
        pairs_b.clear()
        return _forest(a, b, n)

    step = 0
    while True:
        step += 1
        heads = heads[heads + step < n]
        heads = heads[keys[heads] == keys[heads + step]]
        if not len(heads):
            break
        for at in range(0, len(heads), 262144):
            i = heads[at:at + 262144]
            j = i + step
            near = np.abs(table[i].astype(np.int8) - table[j].astype(np.int8)).max(axis=1) <= max_bits
            i, j = i[near], j[near]
            linked = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
            if linked.any():
                pairs_a.append(i[linked])
                pairs_b.append(j[linked])
                held += len(pairs_a[-1])
        if held > FLUSH:
            label, held = reduce(label), 0
    if pairs_a:
        label = reduce(label)
    own = np.flatnonzero(label != np.arange(n))
    a, b = fps[own], fps[label[own]]
    other = a != b
    return a[other], b[other]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Pairs (a, b) whose components are those of all pairs of ``distinct`` (fp)
    within ``max_bits`` bits."""
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in block_masks(max_bits, blocks)])
    dealt = distinct.select("fp", F.posexplode(masks).alias("choice", "mask")).select(
        "fp", F.xxhash64("choice", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))

    # members of crowded buckets meet in tile pairs; the others keep one bucket
    crowded = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile).select(
        F.col("key").alias("c_key"), F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    placed = dealt.join(crowded, F.col("key") == F.col("c_key"), "left")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    cells = F.when(F.col("tiles").isNull(), F.array(F.col("key"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("tiles") - 1),
                    lambda t: F.xxhash64(F.col("key"), F.least(own, t), F.greatest(own, t))))
    cells = placed.select("fp", F.explode(cells).alias("cell"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rest_k, rest_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def emit(k, f):
            a, b = bucket_links(k, f, max_bits)
            for at in range(0, len(a), 10000):
                yield pa.RecordBatch.from_arrays([pa.array(a[at:at + 10000].view(np.int64)),
                                                  pa.array(b[at:at + 10000].view(np.int64))], names=["a", "b"])

        for batch in batches:
            k = np.concatenate([rest_k, batch.column(0).to_numpy()])
            f = np.concatenate([rest_f, batch.column(1).to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0     # the last run may go on
            yield from emit(k[:cut], f[:cut])
            rest_k, rest_f = k[cut:], f[cut:]
        yield from emit(rest_k, rest_f)

    spark = distinct.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = cells.repartition(parts, "cell").sortWithinPartitions("cell", "fp").select("cell", "fp").mapInArrow(run, "a long, b long")
    return met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n")).select("a", "b")


# --- components ---------------------------------------------------------------

def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star contraction over undirected pairs (a < b). Large: every node links
    its larger neighbours to the smallest of its neighbours and itself. Small:
    every node links its smaller neighbours and itself to the smallest of them."""
    if large:
        arcs = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = arcs.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        out = arcs.where(F.col("b") > F.col("a")).join(low, F.col("a") == F.col("n")).select("m", F.col("b").alias("v"))
    else:
        low = pairs.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
        out = pairs.join(low, F.col("b") == F.col("n")).select("m", F.col("a").alias("v")).unionByName(
            low.select("m", F.col("n").alias("v")))
    out = out.where(F.col("m") != F.col("v"))
    return out.groupBy(F.least("m", "v").alias("a"), F.greatest("m", "v").alias("b")).agg(F.count(F.lit(1)).alias("n")).select("a", "b")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of ``pairs`` (a < b, longs), root the smallest
    node of its component. Rounds of a large and a small star, each written to
    the shared folder, until the pairs no longer change (a logarithmic number)."""
    now, mark = store(pairs, "links"), None
    while True:
        sums = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(sums) == mark or not sums["n"]:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = tuple(sums)
        now = store(_star(_star(now, True), False), "links")


def fingerprint_roots(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(node, root) for the fingerprints (column fp) that link to another one."""
    distinct = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).select("fp")
    return components(links(store(distinct, "distinct-fingerprints"), max_bits))


def component_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                  max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest
    non-null doc_id of the row's component.

    Null and blank texts have fingerprint 0 and are linked like any other.
    Repeated rows keep their rows, null ids stay null, other columns are
    ignored and an empty table gives an empty result. Minima are taken per
    fingerprint first, so a group of copies is one row before it meets others;
    the join back is skewed where a third of all rows are copies, which adaptive
    execution splits.
    """
    rows = store(fingerprints(docs, [doc_id], text, shingle).withColumnRenamed(doc_id, "doc_id"), "fingerprints")
    low = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    low = low.join(fingerprint_roots(rows, max_bits), F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("node"), F.coalesce("root", "fp").alias("root"), "low")
    by_root = low.groupBy("root").agg(F.min("low").alias("component_id")).withColumnRenamed("root", "r")
    ids = low.join(by_root, F.col("root") == F.col("r")).select("node", "component_id")
    return rows.join(ids, F.col("fp") == F.col("node"), "left").select("doc_id", "fp", "component_id")


BROADCAST_ROWS = 200_000   # row numbers that may be broadcast (< 10 MB)


def keep_one(docs: DataFrame, keep: str, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """The column ``keep`` of one row per component: the one with the smallest id
    (nulls last), of rows with the same id the first written.

    Rows are numbered in a written table, so equal rows can be told apart and a
    lost executor does not renumber them. The numbers of the rows to drop are
    broadcast if they are few, else joined by shuffle (each occurs once: no skew).
    """
    rows = fingerprints(docs, [keep, doc_id], text, shingle).withColumnRenamed(doc_id, "k_id")
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    narrow = rows.select("fp", F.struct(F.col("k_id").isNull().alias("none"), F.col("k_id").alias("id"), "row").alias("who"))
    first = narrow.groupBy("fp").agg(F.min("who").alias("who"))
    first = first.join(fingerprint_roots(rows, max_bits), F.col("fp") == F.col("node"), "left").select(
        F.coalesce("root", "fp").alias("root"), "who")
    kept = first.groupBy("root").agg(F.min("who").alias("who")).select(F.col("who.row").alias("k_row"))
    dropped = store(narrow.select(F.col("who.row").alias("row")).join(kept, F.col("row") == F.col("k_row"), "left_anti"), "dropped")
    dropped = dropped.withColumnRenamed("row", "d_row")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return rows.join(dropped, F.col("row") == F.col("d_row"), "left_anti").select(keep)
