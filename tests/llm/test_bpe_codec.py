import random
from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threatlens.llm.bpe_codec import Codec, decode, encode, round_trip

from .conftest import TEXTS, TOKENIZERS, documents

PATH = f"{TOKENIZERS}/word_bpe_49k.json"


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def want(lib, text):
    ids = lib.encode(text or "", add_special_tokens=False).ids
    return array("I", ids).tobytes(), lib.decode(ids, skip_special_tokens=False)


def test_documents_match_the_library(spark, lib):
    docs = documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = round_trip(docs, PATH, ["doc_id"]).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (bytes(r.ids), r.decoded) == want(lib, texts[r.doc_id])


def test_hazards_encode_and_decode(hazards, no_rows, lib):
    texts = {c: t for c, t in hazards.select("score", "text").collect()}
    ids = encode(hazards, PATH, ["score", "doc_id"])
    got = decode(ids, PATH, ["score", "ids"]).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert (bytes(r.ids), r.decoded) == want(lib, texts[r.score])
    assert round_trip(no_rows, PATH, ["doc_id"]).collect() == []


ODD = ["it's we'll THE İstanbul ΣΑΣ ﬁx café cafe\u0301 ½ ²x", "\x1c a\x1fb \x85c \u00a0 \u3000", "🎉👩‍👩‍👧 <|startoftext|> hi<|endoftext|>x <|EndOfText|>",
       "a" * 5000, "ab" * 3000, "é" * 999, "'s'S don't!!'", "ẞ ŉ ǅ Ⅷ ٣ ५ \u200b zero\u200dwidth \ufeff", "\tab " * 3000]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(lib, text):
    c = Codec.load(PATH)
    ids = c.encode(text)
    assert (ids, c.decode(ids)) == want(lib, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aabcd eth'AZé1!日 \n"), st.characters(codec="utf-8")), max_size=80))
def test_any_text(text):
    from tokenizers import Tokenizer

    lib = test_any_text.__dict__.setdefault("lib", Tokenizer.from_file(PATH))
    c = Codec.load(PATH)
    assert (c.encode(text), c.decode(c.encode(text))) == want(lib, text)


def test_caches_may_start_anew(lib, monkeypatch):
    import threatlens.llm.bpe_codec as B

    monkeypatch.setattr(B, "CACHE_WORDS", 50)
    monkeypatch.setattr(B, "MAX_PAIRS", 100)
    monkeypatch.setattr(B, "SEGMENT", 300)
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcdefgh <") for _ in range(900)) for _ in range(40)] + ["<|endoftext|>" * 3]
    assert B.Codec(PATH).encode_many(texts) == [want(lib, t)[0] for t in texts]
