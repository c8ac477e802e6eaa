import math
import re
from collections import defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from threatlens.llm import mixture

from .conftest import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, weights=(1, 2, 3), most=3, seed=17):
    """rows: (doc_id, text, source) -> {index: (size, source_size, target, taken)}; level found by dealing the excess again and again."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    per = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        per[s] += n
    names = sorted((s for s in per if s is not None)) + ([None] if None in per else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total = sum(per.values())
    target, open_, left = {}, set(names), float(total)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * per[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = float(most * per[s])
            left -= target[s]
        open_ -= over
    out = {}
    for s in names:
        epochs = int(target[s] // per[s]) if per[s] else 0
        budget = target[s] - epochs * per[s]

        def place(i):
            doc_id, text, _ = rows[i]
            name = str(doc_id) if doc_id is not None else md5((text or "").encode()).hexdigest()
            u = (int(md5(f"{seed}:{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
            t = text or ""
            q = 1.0 - 0.5 * min(1.0, sum(t.count(c) for c in "#*$%&|<>") / max(size[i], 1))
            return (-math.log(u) / q, doc_id is None, doc_id or 0, size[i])

        run = 0
        for i in sorted((i for i in range(len(rows)) if rows[i][2] == s), key=place):
            run += size[i]
            extra = size[i] > 0 and run - size[i] / 2 <= budget
            out[i] = (size[i], per[s], target[s], size[i] * (epochs + extra))
    return out


def test_mix_matches_brute_force(spark):
    docs = documents(spark).select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect()]
    want = {rows[i][0]: v for i, v in brute(rows).items()}
    got = {r.doc_id: r for r in mixture.mix(docs, ["doc_id"]).collect()}
    assert len(got) == len(rows)
    for k, (size, source_size, target, taken) in want.items():
        r = got[k]
        assert (r["size"], r.source_size, r.taken) == (size, source_size, taken)
        assert r.target == pytest.approx(target, rel=1e-12)
        assert r.taken <= 3 * r["size"]


def test_taken_words_come_near_the_targets(spark):
    got = mixture.mix(documents(spark, sf="/root/testdata/sf0.01"), ["source"]).toPandas()
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), largest=("size", "max"))
    assert ((per.taken - per.target).abs() <= per.largest / 2 + 1).all()
    assert abs(per.target.sum() - got["size"].sum()) < 1e-6 * got["size"].sum()


def test_hazards_and_reruns(spark, hazards):
    a = mixture.mix(hazards, ["doc_id", "score"]).collect()
    b = mixture.mix(hazards.repartition(7), ["doc_id", "score"]).collect()
    assert len(a) == hazards.count()
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert all(r.taken == 0 for r in a if r.doc_id in (1, 2, 3))
    assert len({r.taken for r in a if r.doc_id == 4 and r.source_size == a[0].source_size} or {0}) == 1


def test_empty_table(no_rows):
    assert mixture.mix(no_rows, ["doc_id"]).collect() == []


def test_targets_stop_at_three_sizes_and_excess_is_dealt_again(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 1000), ("b", 10), ("c", 10), ("d", 500)])]
    got = {r.source: r.target for r in mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["source"]).collect()}
    assert got["b"] == 30 and got["c"] == 30
    assert got["a"] == pytest.approx(730) and got["d"] == pytest.approx(730)      # weights 1 and 1 share the rest


def rows_of(spark, groups):
    """(n, doc_id, text, source) -> n equal rows each, over several partitions."""
    return spark.createDataFrame([(i, t, s, "x") for n, i, t, s in groups for _ in range(n)],
                                 "doc_id long, text string, source string, size string").repartition(6)


@pytest.mark.parametrize("groups", [
    [(2000, 7, "a b c", "s"), (500, None, "one two three four", "t")],
    [(20_000, None, "a b", "s"), (3, 1, "x y z", "t"), (100, 2, "w", None)],
    [(3000, 7, "a b c", "s"), (3000, 7, "c b a", "s"), (9000, 8, "q", "t"), (50, 9, "", "t")],
])
def test_repeated_rows_meet_their_targets(spark, groups):
    df = rows_of(spark, groups)
    got = mixture.mix(df, ["doc_id", "source", "text"]).collect()
    assert len(got) == sum(n for n, *_ in groups)
    per, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in got:
        per[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
        assert r.taken <= 3 * r["size"]
    assert all(abs(per[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in per)
    again = mixture.mix(df.repartition(3), ["doc_id", "source", "text"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_tables_too_large_for_a_broadcast(spark, monkeypatch):
    docs = documents(spark).select("doc_id", "text", "source")
    want = sorted(map(str, mixture.mix(docs, ["doc_id"]).collect()))
    monkeypatch.setattr(mixture, "BROADCAST_BYTES", -1)
    assert sorted(map(str, mixture.mix(docs, ["doc_id"]).collect())) == want


def test_very_long_texts(spark):
    rows = [(1, " " * 3_000_000, "s"), (2, "x" * 3_000_000, "s"), (3, "a " * 1_500_000, "s"), (4, "a b", "t")]
    got = {r.doc_id: r["size"] for r in mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"]).collect()}
    assert got == {1: 0, 2: 1, 3: 1_500_000, 4: 2}


def test_columns_with_the_names_of_helpers(spark):
    docs = documents(spark).select("doc_id", "text", "source")
    names = ("size", "target", "epochs", "selected", "taken", "place", "bucket", "part", "last", "last_rows", "of", "room", "t_source",
             "c_source", "c_bucket", "budget", "before", "words", "through", "weight", "level", "try")
    more = docs.select("*", *[F.lit("x").alias(c) for c in names])
    assert sorted(map(str, mixture.mix(more, ["doc_id"]).collect())) == sorted(map(str, mixture.mix(docs, ["doc_id"]).collect()))
