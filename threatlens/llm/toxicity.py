"""Toxicity by a weighted lexicon.

Texts are folded (lower case, look-alike letters, digits used as letters), a
learned lexicon of word stems is matched by Aho-Corasick, matches inside
exception phrases are dropped, and the weights of the rest, normalised by the
text's length, give a score through a fitted logistic curve.

The lexicon is fitted on a bounded sample of labelled documents: a stem enters
if it is far more frequent in toxic documents than chance allows. Its weight is
the log ratio of the two frequencies.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, store

SAMPLE_DOCS = 2500        # labelled documents per class that the fit reads, in expectation
CAP = 3                   # occurrences of a stem that count in one document of the fit
STEM_LENGTHS = range(4, 10)
MIN_TOXIC_DOCS = 3
MIN_G2 = 20.0             # likelihood ratio statistic of a stem's capped occurrences
MIN_WEIGHT = 1.8          # log ratio of the frequencies
SMOOTH_WORDS = 30         # added to a text's length, so that one hit in a few words is no certainty
THRESHOLD = 0.7

# FIXED VALUES: letters that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʟ": "l", "ո": "n", "օ": "o", "ս": "u",
}
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

# Phrases in which a lexicon word is meant literally.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clownfish", "clown nose", "idiot proof", "pond scum", "soap scum")

_GLYPHS = str.maketrans(HOMOGLYPHS)
_LEET = str.maketrans(LEET)
_FOREIGN = re.compile("[ıɑ-ʯͰ-ԯԱ-և​-‏⁠︀-️！-～\U0001d400-\U0001d7ff]")
_INVISIBLE = re.compile("[­​-‏⁠︀-️]")
_SIGNED = re.compile(r"[\w@$]+(?:![\w@$]+)*")
_SIGN = re.compile(r"[0-9@$]|\w!\w")
_WORD = re.compile(r"[^\W\d_]+")


def _unsign(m: re.Match) -> str:
    s = m[0]
    letters = sum(map(str.isalpha, s))
    return s.translate(_LEET) if letters >= 2 and letters * 3 >= len(s) > letters else s


def fold(text: str) -> str:
    """Lower case with look-alikes and digit substitutions undone. Digits and signs
    change only inside words with two letters or more, and a third of letters."""
    t = text
    if not t.isascii():
        if _FOREIGN.search(t):
            t = unicodedata.normalize("NFKC", _INVISIBLE.sub("", t))
        elif "­" in t:
            t = t.replace("­", "")
        t = t.lower()
        if _FOREIGN.search(t):
            t = t.translate(_GLYPHS)
    else:
        t = t.lower()
    return _SIGNED.sub(_unsign, t) if _SIGN.search(t) else t


@dataclass
class Lexicon:
    """stems: word stem -> weight; whole: stems that must be a whole word;
    exceptions: folded phrases; curve: offset and two slopes (see features)."""
    stems: dict[str, float] = field(default_factory=dict)
    whole: frozenset = frozenset()
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 1.0, 0.0)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon = lexicon
        self._find = ahocorasick.Automaton()
        for s, w in lexicon.stems.items():
            self._find.add_word(s, (len(s), w, s in lexicon.whole))
        for p in lexicon.exceptions:
            p = fold(p)
            old = self._find.get(p, None)
            self._find.add_word(p, (len(p), 0.0, False) if old is None else (len(p), 0.0, old[2]))
        self._some = len(self._find) > 0
        if self._some:
            self._find.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the stems at word starts, outside exception phrases."""
        if not self._some:
            return []
        found, masked, n = [], [], len(folded)
        for end, (k, w, whole) in self._find.iter(folded):
            a, b = end + 1 - k, end + 1
            if a and folded[a - 1].isalpha():
                continue
            after = b < n and folded[b].isalpha()
            if not w:
                if not after:
                    masked.append((a, b))
            elif not (whole and after):
                found.append((a, b, w))
        return outside(found, masked) if masked else found

    def evidence(self, text: str | None) -> tuple[float, int, list[str]]:
        """Summed weight, number of words, and the matched stems."""
        if not text:
            return 0.0, 0, []
        folded = fold(text)
        found = self.hits(folded)
        if not found:
            return 0.0, 0, []
        return sum(w for _, _, w in found), len(folded.split()), [folded[a:b] for a, b, _ in found]

    def score(self, weight: float, n_words: int) -> float:
        z = self.lexicon.curve[0]
        if weight:
            z += sum(c * x for c, x in zip(self.lexicon.curve[1:], features(weight, n_words)))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def outside(found, masked):
    """The hits that no masked stretch holds: of the stretches that begin no later
    than a hit, the one that reaches furthest decides."""
    masked = sorted(masked)
    starts, reach = [a for a, _ in masked], list(accumulate((b for _, b in masked), max))
    kept = []
    for x in found:
        i = bisect_right(starts, x[0])
        if not i or reach[i - 1] < x[1]:
            kept.append(x)
    return kept


def features(weight: float, n_words: int) -> tuple[float, float]:
    """Evidence for its text's length, and evidence as such (both 0 without a hit)."""
    return math.log1p(200.0 * weight / (n_words + SMOOTH_WORDS)), math.log1p(weight)


# --- fit ----------------------------------------------------------------------

def labelled_sample(docs: DataFrame, labels: DataFrame, learnable: Column, label: str = "toxic", doc_id: str = "doc_id",
                    text: str = "text", per_class: int = SAMPLE_DOCS) -> DataFrame:
    """(id, text, y) of about ``per_class`` labelled documents of each class, chosen by a
    hash among the distinct (id, text), so that rows which repeat an id or a whole
    document neither enlarge the sample nor fill it. Only the chosen keys (bounded)
    are broadcast to the documents."""
    known = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & learnable)
             .groupBy(F.col(doc_id).alias("l_id")).agg(F.max(F.col(label).cast("int")).alias("y")))
    rows = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    keys = store(rows.select(F.col("id").alias("l_id"), F.col("hash").alias("l_hash")).distinct().join(known, "l_id"), "toxicity-keys")
    n = {r["y"]: r["n"] for r in keys.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.when(F.col("y") == 1, F.lit(per_class / max(1, n.get(1, 0)))).otherwise(F.lit(per_class / max(1, n.get(0, 0))))
    drawn = keys.where(F.pmod(F.xxhash64(F.col("l_id"), F.col("l_hash"), F.lit(11)), F.lit(1 << 30)) < rate * (1 << 30))
    return (rows.join(F.broadcast(drawn), (F.col("id") == F.col("l_id")) & (F.col("hash") == F.col("l_hash")))
            .groupBy("id", "hash", "y").agg(F.min("text").alias("text")))


def document_terms(text: str) -> tuple[int, dict[str, int]]:
    """(copy key, occurrences): of word stems of STEM_LENGTHS and of whole words
    (with a final space), up to CAP. The key is the least hash of the 3-word
    windows, so that most near copies of a text share it and count once."""
    words = _WORD.findall(fold(text))
    key = min((hash_of(a, b, c) for a, b, c in zip(words, words[1:], words[2:])), default=hash_of(*words))
    terms: Counter = Counter()
    for w, k in Counter(words).items():
        if len(w) >= 3:
            terms[w + " "] += k
        for n in STEM_LENGTHS:
            if len(w) < n:
                break
            terms[w[:n]] += k
    return key, {t: min(k, CAP) for t, k in terms.items()}


def hash_of(*words: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(" ".join(words)) >> 1


def _copy_factory():
    return lambda texts: [[document_terms(t)[0] for t in texts]]


def _terms_factory():
    return lambda texts: [[[{"term": t, "k": n} for t, n in sorted(document_terms(x)[1].items())] for x in texts]]


def _evidence_factory(lexicon):
    m = Matcher(lexicon)

    def run(texts):
        found = [m.evidence(t) for t in texts]
        return [[w for w, _, _ in found], [n for _, n, _ in found]]

    return run


def g2(t: Column, c: Column, n1: int, n0: int) -> Column:
    """Likelihood ratio statistic of a 2 x 2 table, for terms over-represented in toxic documents."""
    t, c, total, out = t.cast("double"), c.cast("double"), float(n1 + n0), F.lit(0.0)
    for seen, row, col in ((t, t + c, n1), (c, t + c, n0), (n1 - t, total - t - c, n1), (n0 - c, total - t - c, n0)):
        out += F.when(seen > 0, seen * F.log(seen * total / F.nullif(row * float(col), F.lit(0.0)))).otherwise(0.0)
    return F.when(t * n0 <= c * n1, F.lit(0.0)).otherwise(2.0 * out)


def choose_stems(rows) -> tuple[dict[str, float], frozenset]:
    """Lexicon from (term, toxic documents, weight). Shorter stems come first and
    stand for their longer forms; a stem is then lengthened while a longer form
    covers as many toxic documents. Short stems that are always whole words stay so."""
    stats = {r[0]: (r[1], r[2]) for r in rows}
    by_length: dict[int, list[str]] = {}
    for t in stats:
        if not t.endswith(" "):
            by_length.setdefault(len(t), []).append(t)
    stems, whole = {}, set()
    for term in sorted(stats, key=lambda s: (len(s.strip()), s.endswith(" "), s)):
        s = term.strip()
        if any(s[:k] in stems for k in range(1, len(s) + 1)):
            continue
        docs, weight = stats[term]
        if term.endswith(" "):
            whole.add(s)
        else:
            while True:
                longer = [x for x in by_length.get(len(s) + 1, []) if x.startswith(s) and stats[x][0] == docs]
                if not longer:
                    break
                s = min(longer)
                weight = stats[s][1]
            if len(s) < 5 and stats.get(s + " ", (0,))[0] == docs:
                whole.add(s)
        stems[s] = weight
    return stems, frozenset(whole)


def fit_curve(evidence, y, ridge: float = 1e-3, rounds: int = 100) -> tuple[float, float, float]:
    """Logistic curve over ``features`` (Newton steps on three numbers)."""
    import numpy as np

    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return Lexicon.curve
    x = np.array([[1.0, *(features(w, n) if w else (0.0, 0.0))] for w, n in evidence])
    c, damp = np.zeros(3), ridge * np.diag([0.1, 1.0, 1.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -50, 50)))
        q = p * (1 - p)
        d = np.linalg.solve((x * q[:, None]).T @ x / len(y) + damp, x.T @ (p - y) / len(y) + damp @ c)
        c = c - d
        if abs(d).max() < 1e-9:
            break
    return tuple(float(v) for v in c)


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, label: str = "toxic", doc_id: str = "doc_id",
        text: str = "text", per_class: int = SAMPLE_DOCS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Lexicon and curve from a bounded labelled sample (``labelled_sample``).

    Terms are counted and tested on the executors; only the terms that pass all
    tests (bounded by the sample's words) and two numbers per sampled document
    reach the driver. Without labels of both classes the lexicon is empty.
    """
    sample = store(labelled_sample(docs, labels, learnable, label, doc_id, text, per_class), "toxicity-sample")
    # of near copies with the same label the one with the least (hash, id) counts; as many keys as the sample has rows at most
    keys = map_texts(sample, ["y", "hash", "id"], "text", "copy long", _copy_factory)
    least = store(keys.groupBy("y", "copy").agg(F.min(F.struct("hash", "id")).alias("least")).select("y", "least.hash", "least.id"), "toxicity-firsts")
    n = {r["y"]: r["n"] for r in least.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Lexicon(exceptions=exceptions)
    firsts = map_texts(sample.join(F.broadcast(least), ["y", "hash", "id"]), ["y"], "text", "terms array<struct<term: string, k: int>>", _terms_factory)
    k, toxic = F.col("t.k"), F.col("y") == 1
    counts = firsts.select("y", F.explode("terms").alias("t")).groupBy(F.col("t.term").alias("term")).agg(
        F.count_if(toxic).alias("docs"), F.sum(F.when(toxic, k).otherwise(0)).alias("tox"),
        F.sum(F.when(toxic, 0).otherwise(k)).alias("clean"))
    weight = F.log(((F.col("tox") + 0.5) / n1) / ((F.col("clean") + 0.5) / n0))
    top = (counts.withColumn("weight", weight)
           .where((F.col("docs") >= MIN_TOXIC_DOCS) & (F.col("weight") >= MIN_WEIGHT)
                  & (g2(F.col("tox"), F.col("clean"), CAP * n1, CAP * n0) >= MIN_G2)).collect())
    stems, whole = choose_stems([(r["term"], r["docs"], r["weight"]) for r in top])
    lexicon = Lexicon(stems, whole, exceptions)
    seen = map_texts(sample, ["y", "hash"], "text", "weight double, n long", _evidence_factory, lexicon).collect()
    seen.sort(key=lambda r: (r["hash"], r["y"]))          # sums of floats come in one order
    lexicon.curve = fit_curve([(r["weight"], r["n"]) for r in seen], [r["y"] for r in seen])
    return lexicon


# --- score --------------------------------------------------------------------

def _scorer(lexicon):
    m = Matcher(lexicon)

    def run(texts):
        found = [m.evidence(t) for t in texts]
        return [[m.score(w, n) for w, n, _ in found], [h for _, _, h in found]]

    return run


def score_toxicity(docs: DataFrame, lexicon: Lexicon, keep: list[str], text: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``keep`` plus score (0..1), hits (matched stems) and predicted (1 if
    score >= threshold); per row, no shuffle.

    Null, empty and blank texts have no evidence and get the curve's lowest
    score. Whole texts are matched at any length; repeated rows keep their rows;
    extra columns are ignored; an empty table gives an empty result.
    """
    out = map_texts(docs, keep, text, "score double, hits array<string>", _scorer, lexicon)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
