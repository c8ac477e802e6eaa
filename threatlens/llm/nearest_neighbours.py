"""Nearest neighbours by randomly rotated one-bit codes.

Each unit vector is rotated at random; the signs of its coordinates, packed to
bits, are its code, and one scalar (how well the code points along the vector)
corrects the estimate of an inner product. The estimate comes with an error
bound. A block of codes is scanned for a group of queries; a candidate is
reranked on the original vectors only if its upper bound reaches the k-th best
lower bound of the block.

The index is a table (id, code, correction, vector); nothing is fitted, the
rotation follows from a seed. Blocks hold about ``BLOCK_ROWS`` rows by a hash of
the id, so equal or crowded vectors cannot make one of them large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

BLOCK_ROWS = 4096
QUERY_ROWS = 512       # queries that travel together
EPSILON = 2.4          # width of the error bound in standard deviations
SEED = 31
ROTATION_BYTES = 64 << 20   # rotations kept per Python worker; then they are made anew

_ROTATIONS: dict = {}


def rotation(dim: int, seed: int = SEED):
    """A random orthogonal matrix (rows: new axes)."""
    import numpy as np

    if (dim, seed) not in _ROTATIONS:
        if sum(r.nbytes for r in _ROTATIONS.values()) > ROTATION_BYTES:
            _ROTATIONS.clear()
        g = np.random.default_rng(seed).standard_normal((dim, dim))
        q, r = np.linalg.qr(g)
        _ROTATIONS[dim, seed] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim, seed]


def encode(vectors, seed: int = SEED):
    """(packed sign bits, correction) of each row: the correction is the inner
    product of the unit vector and its code's unit vector."""
    import numpy as np

    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ rotation(vectors.shape[1], seed).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


def estimate(bits, correction, queries, epsilon: float = EPSILON, seed: int = SEED):
    """(estimates, half width): cosines of each query (rows) with each coded vector
    (columns), from the codes alone, and the bound of each code's error."""
    import numpy as np

    dim = queries.shape[1]
    turned = (queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ rotation(dim, seed).T
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    about = (turned.astype(np.float32) @ signs.T) / np.float32(np.sqrt(dim)) / correction.astype(np.float32)
    spread = np.sqrt(np.maximum(0.0, 1 - correction ** 2)) / correction / np.sqrt(max(1, dim - 1))
    return about, epsilon * spread


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): distinct rows that can take part. Null ids, and vectors that
    are null, empty, zero or hold a null or a non-finite component, do not."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull())
            .select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
            .where((F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0)).distinct())


def build_index(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", seed: int = SEED) -> DataFrame:
    """(vec_id, dim, code, correction, v) of every usable row."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            rows = b.column(1).to_pylist()
            dims = np.array([len(r) for r in rows])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                m = np.array([rows[i] for i in at], dtype=np.float64)
                bits, corr = encode(m, seed)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), pa.array(np.full(len(at), d, np.int32)),
                     pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(corr),
                     b.column(1).take(pa.array(at))], names=["vec_id", "dim", "code", "correction", "v"])

    return usable(vectors, vec_id, embedding).mapInArrow(
        run, "vec_id long, dim int, code binary, correction double, v array<double>")


def block_search(ids, bits, correction, vectors, q_ids, queries, k: int, epsilon: float = EPSILON, seed: int = SEED):
    """Per query (row): [(score, id)] of its k best candidates in the block, ties
    to the smaller id; and the number of reranked candidates."""
    import numpy as np

    about, half = estimate(bits, correction, queries, epsilon, seed)
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    out, reranked = [], 0
    for r, q in enumerate(queries):
        other = ids != q_ids[r]
        low = np.where(other, about[r] - half, -np.inf)
        floor = np.partition(low, -k)[-k] if len(low) > k else -np.inf
        at = np.flatnonzero(other & (about[r] + half >= floor))
        reranked += len(at)
        qn = np.sqrt(np.einsum("i,i->", q, q))
        score = np.einsum("ij,j->i", vectors[at], q) / (norms[at] * qn)
        best = np.lexsort((ids[at], -score))[:k]
        out.append([(float(score[i]), int(ids[at[i]])) for i in best])
    return out, reranked


def search(index: DataFrame, is_query, k: int = 5, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
           epsilon: float = EPSILON, seed: int = SEED) -> DataFrame:
    """The k nearest of every indexed vector that ``is_query`` picks, among all
    others: (query_id, rank, vec_id, score), score the cosine in double precision.

    Rows that repeat an id with the same vector act as one; with different
    vectors each is a query and a candidate, and no candidate shares its
    query's id. Vectors are compared with those of their own length. Fewer
    candidates than k: all of them. An empty table gives an empty result.
    """
    index = store(index, "vector-index")
    # one row per vector length: broadcast, as n different lengths take n * n / 2 components in the table
    blocks = index.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    index = index.join(F.broadcast(blocks), "dim")
    hashed = F.xxhash64("vec_id", "v")
    base = index.groupBy("dim", F.pmod(hashed, F.col("blocks")).cast("int").alias("block")).agg(
        F.collect_list(F.struct("vec_id", "code", "correction", "v")).alias("rows"))
    per_group = F.greatest(F.lit(1), F.ceil(F.col("blocks") * block_rows / (query_rows * 50)).cast("int"))
    queries = index.where(is_query).groupBy("dim", "blocks", F.pmod(F.xxhash64(hashed), per_group).alias("part")).agg(
        F.collect_list(F.struct("vec_id", "v", F.xxhash64("v").alias("key"))).alias("queries"))
    queries = queries.select("dim", "queries", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"))
    # the queries are repeated for every block, which no size estimate knows: they must not be broadcast
    met = base.join(queries.hint("merge"), ["dim", "block"]).select("rows", "queries")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                rows, qs = b.column(0)[i].values, b.column(1)[i].values
                ids = rows.field("vec_id").to_numpy()
                n, m = len(rows), len(qs)
                vectors = rows.field("v").flatten().to_numpy().reshape(n, -1)
                bits = np.frombuffer(b"".join(rows.field("code").to_pylist()), np.uint8).reshape(n, -1)
                q_ids, keys = qs.field("vec_id").to_numpy(), qs.field("key").to_numpy()
                queries = qs.field("v").flatten().to_numpy().reshape(m, -1)
                found, _ = block_search(ids, bits, rows.field("correction").to_numpy(), vectors, q_ids, queries, k, epsilon, seed)
                out = [(int(q_ids[r]), int(keys[r]), v, s) for r, best in enumerate(found) for s, v in best]
                cols = list(zip(*out)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                                                 names=["query_id", "query", "vec_id", "score"])

    best = met.mapInArrow(run, "query_id long, query long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
