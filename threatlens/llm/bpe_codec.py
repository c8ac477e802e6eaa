"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For each prefix of a word exactly one token can come last in the encoding of
that prefix. It is found among the tokens that are suffixes of the prefix
(from an automaton over all token strings): the one that is compatible with
the last token of the prefix before it, meaning that no merge would have
joined pieces across their border. Following the back-pointers from the whole
word emits the ids that the merge rules give, in time linear in the length.

The vocabulary file is a parameter; this module reads the form with byte-level
symbols and an end-of-word mark: the last symbol of a word is another symbol
than the same byte inside it.
"""

from __future__ import annotations

import json
import re
from array import array

from pyspark.sql import DataFrame

from .common import map_texts

CACHE_WORDS = 200_000   # entries (of about 200 bytes) kept per Python worker and cache; then it starts anew
KEEP_LENGTH = 64        # longer words are not kept
SEGMENT = 1_000_000     # characters that are split into words at a time
MAX_PAIRS = 300_000   # remembered pair tests
NO_LIMIT = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in own:
        out[b] = chr(b)
    for b in range(256):
        if not out[b]:
            out[b] = chr(extra)
            extra += 1
    return out


class BpeModel:
    """Vocabulary, merge rules and the two lookups that the encoder needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        mark = model["end_of_word_suffix"]
        vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.names = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names.update({i: t for t, i in self.special.items()})

        # own numbering: single symbols first, then merged tokens in merge order
        symbol_of = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        made = [a + b for a, b in merges]
        made_set = set(made)
        single = sorted((t for t in vocab if t not in made_set and t not in self.special), key=vocab.get)
        order = single + made
        number = {t: k for k, t in enumerate(order)}
        if len(number) != len(order):
            raise ValueError("two merge rules make the same token")
        self.n_single = len(single)
        self.ids = [vocab[t] for t in order]
        self.left = [0] * self.n_single + [number[a] for a, _ in merges]
        self.right = [0] * self.n_single + [number[b] for _, b in merges]
        self.merge = {(number[a], number[b]): number[a + b] for a, b in merges}
        self.inner: dict[bytes, int] = {}   # token strings inside a word
        self.final: dict[bytes, int] = {}   # token strings that end it
        for t, k in number.items():
            ends = t.endswith(mark)
            s = b"".join(symbol_of[c] for c in (t[: -len(mark)] if ends else t))
            if self._stands(k):
                (self.final if ends else self.inner)[s] = k
        self.final_longest = max(map(len, self.final), default=0)

        # automaton over the inner tokens: a state is a prefix of a token; states are made when first met
        self._prefixes = {s[:i] for s in self.inner for i in range(len(s) + 1)}
        self._states = {b"": 0}
        self._names = [b""]
        self._next: list[dict[int, int]] = [{}]
        self._out: list[tuple] = [()]
        self._fits: dict[int, bool] = {}

    def _stands(self, token: int) -> bool:
        """True if the token's own string encodes to it: its halves grow side by side up to its merge."""
        return token < self.n_single or self._apart(self.left[token], self.right[token], token)

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """True if merging never crosses the border between tokens a and b before step ``limit``.

        Goes back in time along the pieces that touch the border: the piece made
        last is undone first (of equal ones the right one, as merging goes from the
        left), and at each step the touching pair must not have a rule that applies
        before the next change of either piece.
        """
        end_a = end_b = limit
        while True:
            rule = self.merge.get((a, b))
            if rule is not None and rule < end_a and (rule < end_b or rule == end_b < limit):
                return False
            if a > b:
                if a < self.n_single:
                    return True
                end_a, a = a, self.right[a]
            else:
                if b < self.n_single:
                    return True
                end_b, b = b, self.left[b]

    def compatible(self, a: int, b: int) -> bool:
        if len(self._fits) > MAX_PAIRS:
            self._fits.clear()
        ok = self._fits[a << 32 | b] = self._apart(a, b, NO_LIMIT)
        return ok

    def _step(self, state: int, byte: int) -> int:
        s = self._names[state] + bytes([byte])
        while s not in self._prefixes:
            s = s[1:]
        to = self._states.get(s)
        if to is None:
            to = self._states[s] = len(self._names)
            self._names.append(s)
            self._next.append({})
            self._out.append(tuple((len(s) - i, self.inner[s[i:]]) for i in range(len(s)) if s[i:] in self.inner))
        self._next[state][byte] = to
        return to

    def encode_words(self, words) -> dict[bytes, list[int]]:
        """Token ids of each word (the last byte carries the end-of-word mark).

        Words are taken in sorted order, so the table of the prefix that a word
        shares with the one before it is kept.
        """
        out, before, room = {}, b"", 0
        last, length, at = [0], [0], [0]     # by prefix length: last token, its length, automaton state
        nexts, outs, known, test = self._next, self._out, self._fits.get, self.compatible
        for word in sorted(words):
            n = len(word)
            if n > room:
                last += [0] * (n - room)
                length += [0] * (n - room)
                at += [0] * (n - room)
                room = n
            shared, most = 0, min(len(before), n) - 1
            while shared < most and word[shared] == before[shared]:
                shared += 1
            state = at[shared]
            for i in range(shared + 1, n):
                byte = word[i - 1]
                to = nexts[state].get(byte)
                at[i] = state = self._step(state, byte) if to is None else to
                for k, token in outs[state]:
                    if k < i:
                        left = last[i - k]
                        ok = known(left << 32 | token)
                        if ok is None:
                            ok = test(left, token)
                        if not ok:
                            continue
                    last[i], length[i] = token, k
                    break
            for k in range(min(n, self.final_longest), 0, -1):
                token = self.final.get(word[n - k:])
                if token is None:
                    continue
                if k == n:
                    break
                left = last[n - k]
                ok = known(left << 32 | token)
                if ok is None:
                    ok = test(left, token)
                if ok:
                    break
            ids, i = [self.ids[token]], n - k
            while i:
                ids.append(self.ids[last[i]])
                i -= length[i]
            out[word] = ids[::-1]
            before = word
        return out


_MODELS: dict[str, "Codec"] = {}


class Codec:
    """Text to ids and back. Normalisation (NFC, white space, lower case) and the
    split into words follow the vocabulary file; words never span white space, so
    results are kept per blank-separated chunk."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.model = BpeModel(path)
        lib = Tokenizer.from_file(path)
        self._normal, self._pre = lib.normalizer, lib.pre_tokenizer   # for characters beyond Latin
        self._ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
        self._latin = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self._beyond = re.compile("[^\x00-ɏ]")
        # str.split() also parts at U+001C-U+001F, which are no white space here
        self._odd = re.compile("[\x1c-\x1f]")
        self._blank = regex.compile(r"[^\p{White_Space}]+")
        self._cut = re.compile("[ \t-\r]")
        self._special = re.compile("|".join(re.escape(t) for t in self.model.special)) if self.model.special else None
        self._byte_of = {s: b for b, s in enumerate(byte_symbols())}
        self._chunks: dict[str, bytes] = {}
        self._words: dict[bytes, bytes] = {}

    @classmethod
    def load(cls, path: str) -> "Codec":
        if path not in _MODELS:
            _MODELS[path] = cls(path)
        return _MODELS[path]

    def _split(self, chunk: str) -> list[bytes]:
        if chunk.isascii():
            return [w.encode() for w in self._ascii.findall(chunk.lower())]
        if self._beyond.search(chunk):
            pieces = self._pre.pre_tokenize_str(self._normal.normalize_str(chunk))
            return [bytes(self._byte_of[c] for c in p) for p, _ in pieces]
        return [w.encode() for w in self._latin.findall(chunk.lower())]   # below U+0250 NFC changes nothing

    def _learn(self, chunks: set[str]) -> None:
        """Make sure that the ids of all ``chunks`` are known."""
        new = [c for c in chunks if c not in self._chunks]
        if len(self._chunks) + len(new) > CACHE_WORDS:
            self._chunks.clear()
            new = list(chunks)
        split = [self._split(c) for c in new]
        words = {w for ws in split for w in ws}
        fresh = {w for w in words if w not in self._words}
        if len(self._words) + len(fresh) > CACHE_WORDS:
            self._words.clear()
            fresh = words
        for w, ids in self.model.encode_words(fresh).items():
            self._words[w] = array("I", ids).tobytes()
        for c, ws in zip(new, split):
            self._chunks[c] = b"".join([self._words[w] for w in ws])

    def _forget_long(self, chunks: set[str]) -> None:
        for c in [c for c in chunks if len(c) > KEEP_LENGTH]:
            del self._chunks[c]
            for w in self._split(c):
                self._words.pop(w, None)

    def _segments(self, text: str):
        """Parts of at most about SEGMENT characters, cut before white space."""
        at = 0
        while len(text) - at > SEGMENT:
            m = self._cut.search(text, at + SEGMENT)
            if m is None:
                break
            yield text[at:m.start()]
            at = m.start()
        yield text[at:] if at else text

    def _parts(self, text: str):
        """Special ids (bytes) and plain segments of a text, in order."""
        at = 0
        if self._special is not None and "<" in text:
            for m in self._special.finditer(text):
                yield from self._segments(text[at:m.start()])
                yield array("I", [self.model.special[m[0]]]).tobytes()
                at = m.end()
        yield from self._segments(text[at:] if at else text)

    def _encode_segments(self, segments: list[str]) -> list[bytes]:
        split = [self._blank.findall(s) if self._odd.search(s) else s.split() for s in segments]
        chunks = set().union(*split)
        self._learn(chunks)
        out = [b"".join(map(self._chunks.__getitem__, cs)) for cs in split]
        self._forget_long(chunks)
        return out

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is the
        empty text. Strings of special tokens in a text become those tokens."""
        out: list[list[bytes]] = [[] for _ in texts]
        todo: list[str] = []
        where: list[tuple[int, int]] = []
        size = 0

        def flush():
            for (i, j), ids in zip(where, self._encode_segments(todo)):
                out[i][j] = ids
            todo.clear()
            where.clear()

        for i, text in enumerate(texts):
            for part in self._parts(text or ""):
                if isinstance(part, str):
                    where.append((i, len(out[i])))
                    todo.append(part)
                    size += len(part)
                    part = b""
                out[i].append(part)
                if size > SEGMENT:
                    flush()
                    size = 0
        flush()
        return [b"".join(p) for p in out]

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes | None) -> str:
        """The tokens' strings joined by spaces (the file names no decoder)."""
        a = array("I")
        a.frombytes(ids or b"")
        return " ".join(map(self.model.names.__getitem__, a))


def _encoder(path):
    codec = Codec.load(path)
    return lambda texts: [codec.encode_many(texts)]


def _decoder(path):
    codec = Codec.load(path)
    return lambda ids: [[codec.decode(i) for i in ids]]


def _round_trip(path):
    codec = Codec.load(path)

    def run(texts):
        ids = codec.encode_many(texts)
        return [ids, [codec.decode(i) for i in ids]]

    return run


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``ids`` (binary: little-endian uint32). Null and blank
    texts give no ids; repeated rows keep their rows; no shuffle."""
    return map_texts(docs, keep, text, "ids binary", _encoder, path)


def decode(encoded: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """Columns ``keep`` and ``decoded`` (string); null ids give the empty text."""
    return map_texts(encoded, keep, ids, "decoded string", _decoder, path)


def round_trip(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the texts: ``keep``, ids, decoded."""
    return map_texts(docs, keep, text, "ids binary, decoded string", _round_trip, path)
