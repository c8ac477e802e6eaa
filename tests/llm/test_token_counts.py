import random

import pytest
from pyspark.sql import functions as F

from threatlens.llm import token_counts as T

from .conftest import TEXTS, TOKENIZERS, documents

V = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def counter():
    return T.Counter.load(V)


def full(counter, text):
    return len(counter._enc.encode_ordinary(text or ""))


def edited(text, edits):
    for a, b, x in reversed(list(edits)):
        text = text[:a] + x + text[b:]
    return text


def test_random_edits_match_full_encoding(counter):
    rnd = random.Random(3)
    letters = " \n\t'sltrem aé1!.日Ω"
    for _ in range(1500):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 150)))
        cuts = sorted(rnd.randint(0, len(t)) for _ in range(2 * rnd.randint(0, 4)))
        edits = [(a, b, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 5)))) for a, b in zip(cuts[::2], cuts[1::2])]
        tree = T.CountTree(t, counter)
        assert tree.total == full(counter, t)
        new, _ = tree.apply(edits)
        assert new == edited(t, edits) and tree.total == full(counter, new)


def test_only_the_touched_region_is_encoded_again(counter):
    t = "some ordinary words in a row " * 5000
    tree = T.CountTree(t, counter)
    new, n = tree.apply([(5, 13, "unusual"), (100000, 100004, "X")])
    assert n <= 12 and tree.total == full(counter, new)


def test_prefix_sums(counter):
    t = "one two, three\n\nfour 55 six " * 40
    tree = T.CountTree(t, counter)
    counts = counter.counts(counter.pattern.findall(t))
    for i in (0, 1, 31, 32, 33, 100, tree.n_pieces - 1):
        assert tree.before(i) == sum(counts[:i])


def test_documents_and_hazards(spark, hazards, no_rows, counter):
    find = T.pattern_edits()
    for docs in (documents(spark), hazards):
        want = sorted((str(r.doc_id), full(counter, r.text), full(counter, edited(r.text or "", find(r.text or "")))) for r in docs.collect())
        got = sorted((str(r.doc_id), r.n_tokens, r.n_tokens_after) for r in T.recount(docs, V, ["doc_id"]).collect())
        assert got == want
    assert T.recount(no_rows, V, ["doc_id"]).collect() == []
    assert T.recount(hazards, V, ["doc_id"]).count() == len(TEXTS)


def test_given_edits(spark, counter):
    df = spark.createDataFrame([(1, "hello brave world", [(6, 11, "new")]), (2, "abc", None), (3, None, [])],
                               f"doc_id long, text string, edits array<{T.EDIT}>")
    got = {r.doc_id: (r.n_edits, r.n_tokens_after) for r in T.recount(df, V, ["doc_id"], edits="edits").collect()}
    assert got == {1: (1, full(counter, "hello new world")), 2: (0, full(counter, "abc")), 3: (0, 0)}


def test_bad_edits_are_refused(counter):
    for edits in ([(2, 1, "")], [(0, 3, "x"), (2, 4, "y")], [(0, 99, "")]):
        with pytest.raises(ValueError):
            T.CountTree("some text", counter).apply(edits)


def test_further_edits_start_from_the_edited_text(counter):
    rnd = random.Random(9)
    letters = " \n\t'sltrem aé1!.日Ω"
    for _ in range(300):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 200)))
        tree = T.CountTree(t, counter)
        for _ in range(4):
            cuts = sorted(rnd.randint(0, len(t)) for _ in range(2 * rnd.randint(0, 4)))
            edits = [(a, b, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 5)))) for a, b in zip(cuts[::2], cuts[1::2])]
            t = edited(t, edits)
            assert tree.apply(edits)[0] == tree.text == t
            fresh = T.CountTree(t, counter)
            assert tree.total == full(counter, t) and tree._locate(len(t) // 2)[2] == fresh._locate(len(t) // 2)[2]
            assert [tree.before(i) for i in range(tree.n_pieces)] == [fresh.before(i) for i in range(fresh.n_pieces)]


def test_only_the_paths_of_touched_leaves_are_summed_again(counter):
    tree = T.CountTree("some ordinary words in a row " * 20_000, counter)
    nodes = 2 * tree._size
    new, _ = tree.apply([(5, 13, "unusual"), (300_000, 300_004, "X")])
    assert 0 < tree.updated < 200 < nodes and tree.total == full(counter, new)
    for i in (0, 3, 4, 100, 40_000, tree.n_pieces):
        assert tree.before(i) == sum(counter.counts(counter.pattern.findall(new))[:i])


def test_many_edits_one_after_another(counter):
    rnd = random.Random(8)
    text = "a few words, 12 numbers\n\n and  blanks " * 60
    tree = T.CountTree(text, counter)
    for step in range(300):
        a = rnd.randint(0, len(text))
        b = min(len(text), a + rnd.choice([0, 0, 1, 5, 400 if step % 50 == 0 else 2]))
        new = rnd.choice(["", " ", "x", "12", "\n", "some words " * (200 if step % 40 == 0 else 1)])
        text = text[:a] + new + text[b:]
        assert tree.apply([(a, b, new)])[0] == text
        assert tree.total == full(counter, text) and tree.n_pieces == len(counter.pattern.findall(text))
    assert tree.apply([(0, len(text), "")])[0] == "" and tree.total == 0
    assert tree.apply([(0, 0, "again and again")])[0] == "again and again" and tree.total == full(counter, "again and again")


@pytest.mark.parametrize("one", [" ", "\n", "x", "!", "7", "é", " x"])
def test_very_long_texts_of_one_class(counter, one):
    t = one * (3_000_000 // len(one)) + "x"
    tree = T.CountTree(t, counter)
    assert tree.total == sum(len(counter._enc._encode_single_piece(p)) for p in counter.pattern.findall(t))
    new, n = tree.apply([(1_500_000, 1_500_001, "ab")])
    assert tree.total == T.CountTree(new, counter).total


def test_long_white_space_through_the_operator(spark):
    df = spark.createDataFrame([(1, "mail me at a@b.cd" + " " * 1_500_000 + "x"), (2, "\n" * 1_500_000 + "y")], "doc_id long, text string")
    got = {r.doc_id: r for r in T.recount(df, V, ["doc_id"]).collect()}
    assert got[1].n_edits == 1 and got[1].n_tokens > 1 and got[2].n_recounted == 0


def test_columns_with_the_names_of_results(spark):
    names = T.OUT.replace(" long", "").split(", ") + ["_text0", "_text1", "edits"]
    rows = documents(spark).select("doc_id", "text", *[F.lit("x").alias(c) for c in names])
    plain = {r.doc_id: tuple(r) for r in T.recount(documents(spark), V, ["doc_id"]).collect()}
    assert {r.doc_id: tuple(r) for r in T.recount(rows, V, ["doc_id"]).collect()} == plain
