"""Language identification by compression.

Per language a raw-content zstandard dictionary holds sample text. A text is
reduced to lower-case words (digits and signs say nothing about the language)
and cut into blocks, every block is compressed with every dictionary, and the
language whose dictionary gives the fewest bytes in total wins. Where the
runner-up is close, the answer is marked as rejected.

A pass over the texts takes the dictionaries of about ``LANGUAGES_A_PASS`` languages
along; more are dealt to several passes, which hand on the two smallest sizes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_texts, store

SAMPLE_PIECES = 400      # pieces of text per language, in expectation (all if there are fewer)
PIECE_CHARS = 512        # characters of a piece, from a place in the text that its hash chooses
LANGUAGES_A_PASS = 200   # languages whose dictionaries are held at a time, in expectation
BLOCK_BYTES = 4096
LEVEL = 3
FULL_MARGIN = 0.10       # saving over the runner-up that counts as certain
MIN_SCORE = 0.05         # below: rejected
MIN_BYTES = 3            # saving in bytes, below: rejected; of learnable rows that the dictionaries had not seen, 46 % were right below, 99.9 % from there on
UNKNOWN = "und"
TWO = "array<struct<size: bigint, lang: string>>"

_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-case words of a text, separated by single spaces."""
    return _NO_LETTERS.sub(" ", text.lower())


def learn(docs: DataFrame, learnable: Column, lang: str = "lang", text: str = "text", doc_id: str = "doc_id",
          pieces: int = SAMPLE_PIECES, piece_chars: int = PIECE_CHARS, part: tuple[int, int] = (0, 1)) -> dict[str, bytes]:
    """Dictionary content per language from a bounded sample: about ``pieces``
    pieces of ``piece_chars`` characters, chosen by a hash among the distinct
    (id, text) of the language; rows that repeat both are one. One pass counts
    them per language, a narrow one reads the chosen texts. ``part`` (k, n) learns
    the k-th of n classes of languages, dealt by a hash of their names."""
    t = F.col(text)
    h = F.xxhash64(F.col(doc_id), t)
    mine = F.pmod(F.xxhash64(F.col(lang)), F.lit(part[1])) == part[0]
    rows = docs.where(learnable & F.col(lang).isNotNull() & mine)
    keys = rows.select(F.col(lang).alias("lang"), h.alias("h")).distinct()
    rate = store(keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("lang").alias("r_lang"), (F.lit(float(pieces)) / F.col("n")).alias("rate")), "language-rates")   # one row per language of the part
    start = 1 + F.pmod(F.xxhash64(h), F.greatest(F.length(t) - piece_chars, F.lit(1)).cast("long"))
    picked = (rows.select(F.col(lang).alias("lang"), h.alias("h"), t.substr(start.cast("int"), F.lit(piece_chars)).alias("piece"))
              .join(F.broadcast(rate), F.col("lang") == F.col("r_lang"))
              .where(F.pmod(F.col("h"), F.lit(1 << 40)) < F.col("rate") * (1 << 40))
              .where(F.length("piece") > 0).select("lang", "h", "piece").distinct().collect())   # ~ languages x pieces
    out: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["h"], r["piece"])):
        out.setdefault(r["lang"], []).append(letters(r["piece"]))
    return {k: "\n".join(v).encode() for k, v in out.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard as z

        self.langs = sorted(dictionaries)
        self._pack = []
        for k in self.langs:
            d = z.ZstdCompressionDict(dictionaries[k], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self._pack.append(z.ZstdCompressor(level=level, dict_data=d, write_content_size=False,
                                               write_checksum=False, write_dict_id=False).compress)

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i:i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum([len(pack(b)) for b in blocks]) for pack in self._pack]

    def two_smallest(self, text: str | None, known=()) -> list[tuple[int, str]]:
        """The two smallest (size, language), of these languages and of ``known`` pairs."""
        if not text or not any(map(str.isalpha, text)):
            return []
        return sorted([*known, *zip(self.sizes(letters(text).encode()), self.langs)])[:2] if self.langs else sorted(known)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score in 0..1, rejected). Ties fall to the smaller name."""
        return judged(self.two_smallest(text))


def judged(smallest) -> tuple[str, float, bool]:
    if not smallest:
        return UNKNOWN, 0.0, True
    best = smallest[0][0]
    other = smallest[1][0] if len(smallest) > 1 else 2 * best
    score = min(1.0, (other - best) / (FULL_MARGIN * other))
    return smallest[0][1], score, score < MIN_SCORE or other - best < MIN_BYTES


def _classify(dictionaries):
    c = Classifier(dictionaries)

    def run(texts):
        return [list(x) for x in zip(*map(c.predict, texts))]

    return run


def _compare(dictionaries):
    c = Classifier(dictionaries)

    def run(texts, known):
        return [[[{"size": n, "lang": k} for n, k in c.two_smallest(t, [(x["size"], x["lang"]) for x in old or []])]
                 for t, old in zip(texts, known)]]

    return run


def _judge():
    def run(found):
        return [list(x) for x in zip(*[judged([(x["size"], x["lang"]) for x in f or []]) for f in found])]

    return run


def learn_and_identify(docs: DataFrame, learnable: Column, keep: list[str], lang: str = "lang", text: str = "text",
                       doc_id: str = "doc_id") -> DataFrame:
    """``identify`` with what ``learn`` finds, for any number of languages."""
    n = docs.where(learnable & F.col(lang).isNotNull()).select(F.col(lang)).distinct().count()
    parts = max(1, -(-n // LANGUAGES_A_PASS))
    if parts == 1:
        return identify(docs, learn(docs, learnable, lang, text, doc_id), keep, text)
    rows, two = docs, fresh(docs, "_two")
    rows = rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])], F.array().cast(TWO).alias(two))
    for k in range(parts):
        dictionaries = learn(docs, learnable, lang, text, doc_id, part=(k, parts))
        carried = [c for c in rows.columns if c != two]
        rows = map_texts(rows, carried, [text, two], f"{two} {TWO}", _compare, dictionaries)
    return map_texts(rows, keep, two, "lang_pred string, score double, rejected boolean", _judge)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` plus lang_pred, score, rejected; per row, no shuffle.

    Null texts and texts without a letter: ``und``, score 0, rejected; so is
    everything if no language was learned. Texts of any length are compressed
    whole, block by block. Repeated rows keep their rows; extra columns are
    ignored; an empty table gives an empty result.
    """
    return map_texts(docs, keep, text, "lang_pred string, score double, rejected boolean", _classify, dictionaries)
