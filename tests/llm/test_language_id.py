import re

from pyspark.sql import functions as F

from threatlens.llm import language_id as L
from threatlens.llm.queries import QUERIES

from .conftest import TEXTS, documents


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op1_language_id"](spark, sf).join(documents(spark, sf=sf).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == documents(spark, sf=sf).count() and len(held) > 100
    assert sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)
    sure = [r for r in held if not r.rejected]
    assert sum(r.lang_pred == r.lang for r in sure) / len(sure) >= 0.97


def test_hazards(spark, hazards, no_rows):
    d = L.learn(documents(spark), F.lit(True))
    got = L.identify(hazards, d, ["doc_id"]).collect()
    assert len(got) == len(TEXTS)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 11)} == {"und"}
    assert all(r.lang_pred in d for r in got if r.doc_id in (4, 5, 8, 9))
    assert L.identify(no_rows, d, ["doc_id"]).collect() == []


def test_nothing_learned(hazards, no_rows):
    assert L.learn(no_rows, F.lit(True)) == {} and L.learn(hazards, F.lit(False)) == {}
    assert {r.lang_pred for r in L.identify(hazards, {}, ["doc_id"]).collect()} == {"und"}


def test_whole_text_counts():
    c = L.Classifier({"a": b"alpha beta gamma delta epsilon " * 20, "b": b"uno dos tres cuatro cinco seis " * 20})
    text = "uno dos " * 10 + "alpha beta gamma delta epsilon eta theta " * 4000
    assert c.predict("uno dos tres")[0] == "b" and c.predict(text)[0] == "a"
    assert c.predict("zzz") [0] in "ab"


def test_ties_fall_to_the_smaller_name():
    c = L.Classifier({"y": b"same words here", "x": b"same words here"})
    assert c.predict("same words") == ("x", 0.0, True)


def test_repeated_rows_are_one_in_the_sample(spark):
    docs = spark.range(0, 200).select(F.col("id").alias("doc_id"), F.concat(F.lit("ordinary words "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    for key in ("cast(null as bigint)", "cast(7 as bigint)"):
        same = spark.range(0, 3000, 1, 4).select(F.expr(key).alias("doc_id"), F.lit("the very same line").alias("text"), F.lit("en").alias("lang"))
        d = L.learn(docs.unionByName(same), F.lit(True), pieces=1000)
        assert d["en"].decode().split("\n").count("the very same line") == 1
        assert len(d["en"].decode().split("\n")) == 201
    assert L.learn(docs, F.lit(True), pieces=50) == L.learn(docs.union(docs), F.lit(True), pieces=50)


def test_a_few_bytes_are_noise(monkeypatch):
    c = L.Classifier({"a": b"alpha beta", "b": b"uno dos"})
    for sizes, rejected in (([30, 30], True), ([30, 31], True), ([32, 30], True), ([30, 33], False), ([9000, 9003], True), ([9000, 9100], False)):
        monkeypatch.setattr(c, "sizes", lambda data: sizes)
        lang, score, no = c.predict("some text")
        assert no == rejected and lang == "ab"[sizes[1] < sizes[0]] and score == min(1.0, abs(sizes[0] - sizes[1]) / (0.1 * max(sizes)))


def plain(text, dictionaries):
    """Every dictionary tried on every block by a compressor made for it; the sizes compared by hand."""
    import zstandard as z

    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0, True
    data = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
    total = {}
    for name, content in dictionaries.items():
        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        total[name] = sum(len(z.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False,
                                               write_dict_id=False).compress(data[i:i + 4096])) for i in range(0, len(data), 4096))
    first = min(total, key=lambda k: (total[k], k))
    others = [total[k] for k in total if k != first]
    other = min(others) if others else 2 * total[first]
    score = min(1.0, (other - total[first]) / (0.10 * other))
    return first, score, score < 0.05 or other - total[first] < 3


def test_predictions_equal_trying_every_dictionary(spark):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = documents(spark)
    d = L.learn(docs, ~held)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got[:120]:
        lang, score, rejected = plain(texts[r.doc_id], d)
        assert (r.lang_pred, r.rejected) == (lang, rejected) and abs(r.score - score) < 1e-12


def test_many_languages_in_several_passes(spark, monkeypatch, hazards):
    docs = documents(spark).select("doc_id", "text", F.concat("lang", F.lit("-"), F.col("doc_id") % 3).alias("lang"), F.lit("x").alias("_two"))
    want = sorted(map(tuple, L.learn_and_identify(docs, F.lit(True), ["doc_id"]).collect()))
    monkeypatch.setattr(L, "LANGUAGES_A_PASS", 2)
    assert sorted(map(tuple, L.learn_and_identify(docs, F.lit(True), ["doc_id"]).collect())) == want
    got = L.learn_and_identify(hazards.withColumn("lang", F.coalesce("lang", "source")), F.lit(True), ["doc_id"]).collect()
    assert len(got) == len(TEXTS) and {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 11)} == {"und"}
