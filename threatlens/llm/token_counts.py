"""Edit-aware token counting.

A text's pre-tokens (the pieces that the vocabulary's pattern cuts before any
merge) are kept with their token counts in a segment tree. An edit touches the
pre-tokens around it only: the pattern is run again from the last border that
the edit cannot have moved until its borders meet old ones beyond the edit.
Those pieces are counted anew and take the old ones' place in their leaf; the sums
on the leaf's path are updated, all others stay. The root holds the count of the
edited text, which further edits start from.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from itertools import chain

from pyspark.sql import DataFrame

from .common import map_texts

# FIXED VALUE: the pattern that goes with the byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTEXT = 3              # characters beyond a pre-token that its end can depend on
LEAF = 32                # pre-tokens of a leaf
FULL_LEAF = 8 * LEAF     # a leaf that edits have filled beyond this has the tree laid out again (kept counts, no encoding)
CACHE_PIECES = 300_000   # pieces kept per Python worker; then the cache starts anew
KEEP_LENGTH = 64

EDIT = "struct<start: int, end: int, text: string>"

# Personal data that a scrub takes out: (pattern, replacement).
SCRUB = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<EMAIL>"),
    (r"\+[0-9]{1,3} \([0-9]{2,4}\) [0-9]{3}-[0-9]{4}", "<PHONE>"),
    (r"\b[0-9]{13,19}\b", "<NUMBER>"),
)

_COUNTERS: dict[str, "Counter"] = {}


class Counter:
    """Splits texts into pre-tokens and counts the tokens of each piece."""

    def __init__(self, vocabulary: str):
        import regex
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._enc = tiktoken.Encoding("count", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self._known: dict[str, int] = {}

    @classmethod
    def load(cls, vocabulary: str) -> "Counter":
        if vocabulary not in _COUNTERS:
            _COUNTERS[vocabulary] = cls(vocabulary)
        return _COUNTERS[vocabulary]

    def piece(self, s: str) -> int:
        """Tokens of one pre-token. The merges run on its bytes; the pattern, which cannot
        take a million blanks in one piece, does not run again."""
        n = len(self._enc._encode_single_piece(s))
        if len(s) <= KEEP_LENGTH:
            if len(self._known) >= CACHE_PIECES:
                self._known.clear()
            self._known[s] = n
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        known, count = self._known.get, self.piece
        return [known(p) or count(p) for p in pieces]


class CountTree:
    """Segment tree over the pre-tokens of one text: each node sums the characters,
    tokens and pre-tokens below it."""

    def __init__(self, text: str, counter: Counter):
        self._counter, self.text = counter, text
        pieces = counter.pattern.findall(text)
        self._lay_out(list(map(len, pieces)), counter.counts(pieces))

    def _lay_out(self, lengths: list[int], counts: list[int]) -> None:
        cut = range(0, len(counts), LEAF)
        self._lengths = [lengths[i:i + LEAF] for i in cut] or [[]]
        self._counts = [counts[i:i + LEAF] for i in cut] or [[]]
        size = 1
        while size < len(self._counts):
            size *= 2
        self._size = size
        self.updated = 0                                       # nodes whose sums edits have set since
        spare = [0] * (size - len(self._counts))
        self._chars = [0] * size + list(map(sum, self._lengths)) + spare
        self._sums = [0] * size + list(map(sum, self._counts)) + spare
        self._pieces = [0] * size + list(map(len, self._counts)) + spare
        for node in range(size - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        for x in (self._chars, self._sums, self._pieces):
            x[node] = x[2 * node] + x[2 * node + 1]

    @property
    def total(self) -> int:
        return self._sums[1]

    @property
    def n_pieces(self) -> int:
        return self._pieces[1]

    def before(self, piece: int) -> int:
        """Tokens before a pre-token of the present text."""
        node, out = 1, 0
        if piece >= self.n_pieces:
            return self.total
        while node < self._size:
            node *= 2
            if piece >= self._pieces[node]:
                piece -= self._pieces[node]
                out += self._sums[node]
                node += 1
        return out + sum(self._counts[node - self._size][:piece])

    def _locate(self, char: int) -> tuple[int, int, int]:
        """(leaf, place in it, first character) of the pre-token that holds a character;
        at the text's end the place behind the last one."""
        if char >= self._chars[1]:
            return len(self._counts) - 1, len(self._counts[-1]), self._chars[1]
        node, start = 1, 0
        while node < self._size:
            node *= 2
            if char - start >= self._chars[node]:
                start += self._chars[node]
                node += 1
        for i, n in enumerate(self._lengths[node - self._size]):
            if char < start + n:
                break
            start += n
        return node - self._size, i, start

    def _replace(self, start: int, end: int, pieces: list[str]) -> None:
        """The pre-tokens of characters [start, end) give way to new ones, which alone are
        counted; then the sums on the paths of the touched leaves."""
        a, i, _ = self._locate(start)
        b, j, _ = self._locate(end)
        for leaves, new in ((self._lengths, list(map(len, pieces))), (self._counts, self._counter.counts(pieces))):
            rest = leaves[b][j:]
            leaves[a] = leaves[a][:i] + new + (rest if a == b else [])
            for k in range(a + 1, b + 1):
                leaves[k] = rest if k == b else []
        nodes = range(a + self._size, b + self._size + 1)
        for node in nodes:
            leaf = node - self._size
            self._chars[node], self._sums[node], self._pieces[node] = (
                sum(self._lengths[leaf]), sum(self._counts[leaf]), len(self._counts[leaf]))
        while nodes[0] > 1:
            self.updated += len(nodes)
            nodes = range(nodes[0] // 2, nodes[-1] // 2 + 1)
            for node in nodes:
                self._sum(node)
        self.updated += 1

    def apply(self, edits) -> tuple[str, int]:
        """Apply (start, end, replacement) edits, given on the present text, in order
        and without overlap. Returns the new text and the number of pre-tokens that
        were encoded again; the tree then is the new text's, ready for further edits."""
        edits = [e for e in edits if e[0] != e[1] or e[2]]
        if not edits:
            return self.text, 0
        parts, at, new_start, new_end, shift = [], 0, [], [], []
        length = 0
        for a, b, new in edits:
            if not at <= a <= b <= len(self.text):
                raise ValueError("edits must be in order, apart and inside the text")
            parts += [self.text[at:a], new]
            length += a - at
            new_start.append(length)
            length += len(new)
            new_end.append(length)
            shift.append(length - b)
            at = b
        new_text = "".join([*parts, self.text[at:]])
        k, changes = 0, []
        while k < len(edits):
            # first pre-token whose end the edit may have moved
            first = self._locate(max(0, edits[k][0] - CONTEXT))[2]
            moved = shift[k - 1] if k else 0
            pieces, last, done = [], len(self.text), len(edits)
            for m in self._counter.pattern.finditer(new_text, first + moved):
                p = m.start()
                passed = bisect_right(new_end, p)
                if passed > k and (passed == len(edits) or p + CONTEXT < new_start[passed]):
                    old = p - shift[passed - 1]
                    if edits[passed - 1][1] <= old < len(self.text) and self._locate(old)[2] == old:
                        last, done = old, passed
                        break
                pieces.append(m[0])
            changes.append((first, last, pieces))
            k = done
        for change in reversed(changes):                       # places further left stay valid
            self._replace(*change)
        self.text = new_text
        if max(map(len, self._counts)) > FULL_LEAF:
            self._lay_out(list(chain.from_iterable(self._lengths)), list(chain.from_iterable(self._counts)))
        return new_text, sum(len(pieces) for _, _, pieces in changes)


def pattern_edits(rules=SCRUB):
    """A function text -> edits that replace what the rules match (leftmost first, the earlier rule on ties)."""
    import re

    one = re.compile("|".join(f"({p})" for p, _ in rules), re.ASCII)
    marks = [r for _, r in rules]
    return lambda text: [(*m.span(), marks[m.lastindex - 1]) for m in one.finditer(text)]


OUT = "n_tokens long, n_pieces long, n_edits long, n_tokens_after long, n_recounted long"


def _recounter(vocabulary, rules):
    counter = Counter.load(vocabulary)
    find = pattern_edits(rules) if rules else None

    def run(texts, given=None):
        rows = []
        for i, text in enumerate(texts):
            tree = CountTree(text or "", counter)
            before, n_pieces = tree.total, tree.n_pieces
            edits = find(text or "") if find else [(e["start"], e["end"], e["text"]) for e in given[i] or []]
            _, recounted = tree.apply(edits)
            rows.append((before, n_pieces, len(edits), tree.total, recounted))
        return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(5)]

    return run


def recount(docs: DataFrame, vocabulary: str, keep: list[str], text: str = "text", edits: str | None = None,
            rules=SCRUB) -> DataFrame:
    """Columns ``keep`` plus token counts before and after edits: n_tokens, n_pieces
    (pre-tokens), n_edits, n_tokens_after, n_recounted (pre-tokens encoded again).

    Edits come from the column ``edits`` (array of (start, end, text), in order,
    null: none) or, without it, from ``rules``. Per row, no shuffle: null and
    empty texts count 0, whole texts of any length are counted, repeated rows
    keep their rows, and an empty table gives an empty result.
    """
    columns = [text, edits] if edits else text
    return map_texts(docs, keep, columns, OUT, _recounter, vocabulary, () if edits else tuple(rules))
