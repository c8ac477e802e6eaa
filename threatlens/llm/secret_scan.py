"""Secret scanning: known forms and a token-efficiency test for random strings.

A vocabulary learned from ordinary text spends few tokens on ordinary strings
and many on random ones. Strings without a known form are therefore reported
when they hold few characters per token, with and without their separators, and
their letter pairs are rare in the vocabulary. Only closed forms (UUIDs, dates,
numbers, digests of known lengths) are set aside beforehand.
"""

from __future__ import annotations

import base64
import math
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

KINDS = ("assign", "access", "hex", "random")   # in report order
SPANS = "array<struct<kind: string, start: int, end: int>>"

# FIXED VALUES: the base forms of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")   # the maximal runs of [0-9a-f]+ with 24 characters or more

MIN_CANDIDATE = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CANDIDATE)
DIGEST_HEX = frozenset((32, 40, 56, 64, 96, 128))   # MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DATE = re.compile(r"[0-9]{4}([-/_]?)[0-9]{2}\1[0-9]{2}[T_-]?[0-9]{2}[-_]?[0-9]{2}(?:[-_]?[0-9]{2})?(?:Z|[+-][0-9]{2,4})?")
NUMBER = re.compile(r"[0-9/_=+-]+")
SEPARATORS = re.compile(r"[/_=+-]+")
MIN_PART = 10               # shorter parts between separators are not tested by themselves
MAX_CHARS_PER_TOKEN = 2.2   # ordinary words: 3 and more; random letters and digits: 1.3 to 2
# Bits a letter pair costs, over characters per token. Random strings: 3 to 7; words and names: 1 to 2.
# Fitted on the given documents and on names from source code; 1 in 100 of those names reaches it.
MIN_RARITY = 3.0

_DIGITS = str.maketrans("123456789", "000000000")
_PAIRS: dict[str, dict[str, float]] = {}


def is_closed_form(s: str) -> bool:
    """UUID, date, number, or digest of a known length."""
    return bool(NUMBER.fullmatch(s) or UUID.fullmatch(s) or DATE.fullmatch(s)
                or (len(s) in DIGEST_HEX and not s.strip("0123456789abcdefABCDEF")))


def pair_bits(vocabulary: str, tokens) -> dict[str, float]:
    """Bits of a character after another, from the vocabulary's words: case folded, all digits alike."""
    if vocabulary not in _PAIRS:
        pairs, firsts = Counter(), Counter()
        for t in tokens:
            w = t.strip()
            if w.isalnum() and w.isascii():
                w = w.decode().lower().translate(_DIGITS)
                pairs.update(map("".join, zip(w, w[1:])))
                firsts.update(w[:-1])
        signs = "abcdefghijklmnopqrstuvwxyz0"
        _PAIRS[vocabulary] = {a + b: math.log2((firsts[a] + 0.5 * len(signs)) / (pairs[a + b] + 0.5)) for a in signs for b in signs}
    return _PAIRS[vocabulary]


def stretches(text: str, a: int, b: int, base: list[tuple[int, int]], i: int = 0):
    """What base spans (sorted, from the i-th on) leave of [a, b), in pieces of the
    minimum length; the one separator that joins a piece to a span is not part of it."""
    at, cut = a, False
    for x, y in [*base[i:bisect_left(base, (b, b), i)], (b, b)]:
        end = min(x, b)
        if end > at:
            left = at + (cut and bool(SEPARATORS.match(text, at)))
            right = end - (end < b and bool(SEPARATORS.match(text, end - 1)))
            if right - left >= MIN_CANDIDATE:
                yield left, right
        if y > at:
            at, cut = y, x < b


class Scanner:
    """find(text) -> [(kind, start, end)] in code points, by start, then kind."""

    def __init__(self, vocabulary: str, max_chars_per_token: float = MAX_CHARS_PER_TOKEN):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # candidates hold no white space: one piece is the whole string
        self._enc = tiktoken.Encoding("scan", pat_str=r"[^\s]+", mergeable_ranks=ranks, special_tokens={})
        self._most = max_chars_per_token
        self._bits = pair_bits(vocabulary, ranks)

    def chars_per_token(self, s: str) -> float:
        return len(s) / max(1, len(self._enc.encode_ordinary(s)))

    def pair_cost(self, s: str) -> float:
        """Mean bits of the pairs of letters and digits; two digits in a row say nothing."""
        s = s.lower().translate(_DIGITS)
        bits = [self._bits[p] for p in map("".join, zip(s, s[1:])) if p != "00"]
        return sum(bits) / len(bits) if bits else 0.0

    def looks_random(self, s: str) -> bool:
        if is_closed_form(s):
            return False
        joined = SEPARATORS.sub("", s)
        per = max(self.chars_per_token(s), self.chars_per_token(joined))
        return per <= self._most and self.pair_cost(joined) >= MIN_RARITY * per

    def random_spans(self, text: str, a: int, b: int) -> list[tuple[int, int]]:
        """The whole candidate, or those of its parts that are long enough to be one."""
        s = text[a:b]
        if self.looks_random(s):
            return [(a, b)]
        if is_closed_form(s):
            return []
        parts = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9]+", s) if m.end() - m.start() >= MIN_PART]
        parts = [(x, y) for x, y in parts if y - x < b - a and self.looks_random(s[x:y])]
        if parts and self.chars_per_token(s) <= self._most:
            return [(a, b)]
        return [(a + x, a + y) for x, y in parts if y - x >= MIN_CANDIDATE]

    def find(self, text: str | None) -> list[tuple[str, int, int]]:
        if not text:
            return []
        found = []
        low = text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
        base = sorted((a, b) for _, a, b in found)
        i = 0
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            while i < len(base) and base[i][1] <= a:
                i += 1
            for x, y in stretches(text, a, b, base, i):
                found += [("random", *r) for r in self.random_spans(text, x, y)]
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _finder(vocabulary, most):
    s = Scanner(vocabulary, most)
    return lambda texts: [[[{"kind": k, "start": a, "end": b} for k, a, b in s.find(t)] for t in texts]]


def find_secrets(docs: DataFrame, vocabulary: str, keep: list[str], text: str = "text",
                 max_chars_per_token: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """Columns ``keep`` and ``spans``: array of (kind, start, end), end exclusive.

    Per row, no shuffle: null and empty texts have no spans, repeated rows and
    null ids keep their rows, texts are scanned whole at any length, and an
    empty table gives an empty result.
    """
    return map_texts(docs, keep, text, f"spans {SPANS}", _finder, vocabulary, max_chars_per_token)


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] != "random")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _redactor(vocabulary, most, mark):
    s = Scanner(vocabulary, most)

    def clean(text):
        spans = s.find(text)
        if not spans:
            return text
        out, at = [], 0
        for _, a, b in spans:
            if b <= at:
                continue
            if a >= at:            # overlapping spans share one mark
                out += [text[at:a], mark]
            at = b
        return "".join([*out, text[at:]])

    return lambda texts: [[clean(t) for t in texts]]


def redact(docs: DataFrame, vocabulary: str, keep: list[str], text: str = "text", out: str = "redacted",
           mark: str = "[SECRET]", max_chars_per_token: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """Columns ``keep`` and the text with each found span replaced by ``mark`` (null stays null)."""
    return map_texts(docs, keep, text, f"`{out}` string", _redactor, vocabulary, max_chars_per_token, mark)
