import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from threatlens.llm import simhash_dedup as D

from .conftest import CLASHING, documents


def fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    """rows: (doc_id, text) -> [(doc_id, hex, component_id)]"""
    fps = [fingerprint(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3] for i in range(len(rows))]
    seen, out = {}, []
    for i in range(len(rows)):
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                for j in near[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            low = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            seen.update(dict.fromkeys(group, low))
    for i, (d, _) in enumerate(rows):
        out.append((str(d), f"{fps[i]:016x}", str(seen[i])))
    return sorted(out)


def result(docs):
    got = D.component_ids(docs).select("doc_id", D.fp_hex(F.col("fp")), "component_id").collect()
    return sorted((str(a), b, str(c)) for a, b, c in got)


def test_documents_with_near_copies(spark):
    rnd = random.Random(2)
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()][:120]
    for k, (_, t) in enumerate(rows[:40]):
        w = t.split(" ")
        w[rnd.randrange(len(w))] = "changed"
        rows.append((1000 + k, " ".join(w)))
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(rows)


def test_hazards(spark, hazards, no_rows):
    rows = [(r.doc_id, r.text) for r in hazards.collect()]
    assert result(hazards) == brute(rows)
    assert result(no_rows) == []


def test_links_lose_no_component_in_crowded_buckets(spark):
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 1 << 64, 30, dtype=np.uint64)]
    for f in fps[:6]:                                  # chains and crowds of close fingerprints
        at = f
        for _ in range(60):
            for b in rng.integers(0, 64, int(rng.integers(1, 5))):
                at ^= 1 << int(b)
            fps.append(at)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    parent = {f: f for f in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = {f: find(f) for f in signed if any(find(f) == find(g) for g in signed if g != f)}
    for tile in (2, 5, 2048):
        got = {r.node: r.root for r in D.components(D.links(df, tile=tile)).collect()}
        assert {f: got.get(f, f) for f in want} == want and set(got) <= set(want)


def test_components_of_a_long_chain(spark):
    n = 300
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    got = {r.node: r.root for r in D.components(pairs).collect()}
    assert got == {i: 0 for i in range(1, n + 1)}


def test_keep_one_row_of_each_component(spark, hazards):
    docs = hazards.select(F.struct("doc_id", "text", *CLASHING).alias("doc"), "doc_id", "text")
    kept = [r.doc for r in D.keep_one(docs, "doc").collect()]
    groups = {c for _, _, c in brute([(r.doc_id, r.text) for r in hazards.collect()])}
    assert len(kept) == len(groups)
    assert {str(r.doc_id) for r in kept} == groups


def test_forest_is_small_and_connects():
    fps = np.array(sorted({int(1 << a | 1 << b) for a in range(20) for b in range(20)}), dtype=np.uint64)
    a, b = D.bucket_links(np.zeros(len(fps), np.int64), fps)
    assert len(a) == len(fps) - 1


def test_masks_leave_a_common_block_for_any_three_bits():
    masks = D.block_masks()
    rnd = random.Random(4)
    for _ in range(300):
        x = sum(1 << b for b in rnd.sample(range(64), 3))
        assert any(m & x == 0 for m in masks)
