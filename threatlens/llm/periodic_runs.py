"""Runs of repeated words (the same passage written again and again without a gap).

A run is a stretch of consecutive words with smallest period q, at least
max(min_length, 2 q) words long, that no neighbouring word extends keeping q.

Internal pattern matching, for many documents at once:

* prefix doubling gives every document a suffix array and, per level k, a name
  for each factor of 2^k words; names also answer how far two positions agree
  to the right or to the left (longest common extensions);
* a wavelet tree over the suffix array (word positions in suffix order) answers
  range successor: the first occurrence of a factor at or after a position;
* blocks of b = 2^k words, one every b/2 words, ask for their occurrences 3b/2 - 1
  to 3b - 2 words further on (the smallest level also for the shorter periods).
  A run of period p in that window holds such a block and its copy p words on,
  so every run is met at one level;
* occurrences at most b/2 apart are a progression whose difference is the
  block's own period; the ends of the two stretches with that period leave few
  of its members as candidate periods;
* extensions verify each candidate and give the run's ends.

Words are numbered per document, so no factor is shared between documents.
Memory: 4 bytes x words x (levels of the longest repeat + bits of a position),
for a slice of documents of ``SLICE_WORDS`` words or for one longer document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, map_texts, words

MIN_LENGTH = 12
SLICE_WORDS = 1 << 17

RUN = "struct<start:bigint,length:bigint,period:bigint>"


class _Text:
    """Suffix order and factor names of the documents laid end to end."""

    def __init__(self, symbols, lengths):
        import numpy as np

        n = self.n = len(symbols)
        ends = np.cumsum(lengths)
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.local = np.arange(n) - (ends - lengths)[self.doc]
        self.left = lengths[self.doc] - self.local            # words from here to the document's end
        key = self.doc * (int(symbols.max()) + 1 if n else 1) + symbols
        sa = np.argsort(key, kind="stable")
        rank = np.full(n + 1, -1, dtype=np.int32)
        self.levels = []
        at = np.arange(n)                                     # suffix array slots that are not settled yet
        h = 0
        while True:
            found = sa[at]
            if h:
                key = rank[found].astype(np.int64) * (n + 1)
                inside = self.left[found] > h
                key[inside] += rank[found[inside] + h] + 1
                order = np.argsort(key, kind="stable")
                found, key = found[order], key[order]
                sa[at] = found
            else:
                key = key[found]
            first = np.ones(len(at), dtype=bool)
            first[1:] = key[1:] != key[:-1]
            starts = np.flatnonzero(first)
            sizes = np.diff(np.append(starts, len(at)))
            rank[found] = np.repeat(at[starts], sizes)
            self.levels.append(rank.copy())
            at = at[np.repeat(sizes > 1, sizes)]
            if not len(at):
                break
            h = 2 * h or 1
        bits = max(1, int(lengths.max() - 1).bit_length()) if n else 1
        self._wavelet(self.local[sa], bits)

    def _wavelet(self, a, bits):
        import numpy as np

        self.tree = []
        for b in range(bits - 1, -1, -1):
            bit = (a >> b) & 1
            ones = np.zeros(len(a) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.tree.append((b, ones, len(a) - int(ones[-1])))
            a = np.concatenate((a[bit == 0], a[bit == 1]))
        self.top = 1 << bits

    def successor(self, lo, hi, x):
        """Smallest position >= x in each suffix range [lo, hi); -1: none."""
        import numpy as np

        out = np.full(len(x), -1, dtype=np.int64)
        use = np.flatnonzero(x < self.top)
        lo, hi, x = lo[use], hi[use], x[use]
        left, right, below = lo, hi, np.zeros(len(x), dtype=np.int64)
        for b, ones, zeros in self.tree:                       # how many are smaller than x
            up = (x >> b) & 1 == 1
            ol, oh = ones[left], ones[right]
            below += np.where(up, (right - oh) - (left - ol), 0)
            left, right = np.where(up, zeros + ol, left - ol), np.where(up, zeros + oh, right - oh)
        some = below < hi - lo
        use, left, right, k = use[some], lo[some], hi[some], below[some]
        value = np.zeros(len(k), dtype=np.int64)
        for b, ones, zeros in self.tree:                       # the next one in order
            ol, oh = ones[left], ones[right]
            low = (right - left) - (oh - ol)
            up = k >= low
            k = np.where(up, k - low, k)
            value |= up.astype(np.int64) << b
            left, right = np.where(up, zeros + ol, left - ol), np.where(up, zeros + oh, right - oh)
        out[use] = value
        return out

    def agree_right(self, i, j):
        """Words that agree from i and j on (i < j in one document)."""
        import numpy as np

        same = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names = self.levels[k]
            same += (names[i + same] == names[j + same]).astype(np.int64) << k
        return same

    def agree_left(self, i, j):
        """Words that agree before i and j (i < j in one document)."""
        import numpy as np

        same = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names, a = self.levels[k], i - same - (1 << k)
            same += ((a >= 0) & (names[np.maximum(a, 0)] == names[np.maximum(a + j - i, 0)])).astype(np.int64) << k
        return same


def _rounds(min_length: int, longest: int):
    """(block length, stride, smallest and largest period) per level."""
    b = 4 if min_length >= 9 else 2 if min_length >= 3 else 1
    low = 1
    while 2 * low <= longest:
        high = max(1, 3 * b - 2)
        yield b, max(1, b // 2), low, high
        b, low = 2 * b, high + 1


def _candidates(t: _Text, min_length: int, longest: int):
    """Pairs (position, period) among which is one of every run."""
    import numpy as np

    out_s, out_p = [], []

    def emit(s, p):
        out_s.append(s)
        out_p.append(p)

    for b, stride, low, high in _rounds(min_length, longest):
        k = b.bit_length() - 1
        if k >= len(t.levels):
            break
        names = t.levels[k][:t.n]
        size = np.bincount(names, minlength=t.n)
        s = np.flatnonzero((t.local % stride == 0) & (t.left >= b + low) & (size[names] > 1))
        x = t.local[s] + low
        while len(s):
            lo = names[s].astype(np.int64)
            hi = lo + size[lo]
            y = t.successor(lo, hi, x)
            some = (y >= 0) & (y <= t.local[s] + high)
            s, y, lo, hi = s[some], y[some], lo[some], hi[some]
            if not len(s):
                break
            z = t.successor(lo, hi, y + 1)
            near = (z >= 0) & (z - y <= b // 2)
            emit(s[~near], (y - t.local[s])[~near])
            x = y + 1
            if near.any():
                a, first, d = s[near], y[near], (z - y)[near]
                base = a - t.local[a]
                c = base + first                                # the progression's first member
                l1, r1 = a - t.agree_left(a, a + d), a + d + t.agree_right(a, a + d)
                l2, r2 = c - t.agree_left(c, c + d), c + d + t.agree_right(c, c + d)
                last = c + (r2 - b - c) // d * d
                x[near] = last - base + 1
                p0, p1 = c - a, np.minimum(last - a, high)
                other = l1 != l2
                own = ~other & (d >= low)                       # one stretch: its own period, if it is of this level
                emit(a[own], d[own])
                for p in (r2 - r1, l2 - l1):                    # the stretches end or begin alike
                    ok = other & (p >= p0) & (p <= p1) & ((p - p0) % d == 0)
                    emit(a[ok], p[ok])
                most = np.minimum(np.minimum(p1, (r2 - l1) // 2), np.minimum(r1 - l1, r2 - l2))
                many = np.flatnonzero(other & (r1 >= l2) & (most >= p0))   # the stretches meet
                count = (most[many] - p0[many]) // d[many] + 1
                step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                emit(np.repeat(a[many], count), np.repeat(p0[many], count) + step * np.repeat(d[many], count))
    if not out_s:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(out_s), np.concatenate(out_p)


def find_runs(symbols, lengths, min_length: int = MIN_LENGTH):
    """Runs of documents laid end to end: arrays (document, start, length, period)
    by document, start, period. ``symbols``: word numbers; ``lengths``: words per document."""
    import numpy as np

    lengths = np.asarray(lengths, dtype=np.int64)
    t = _Text(np.asarray(symbols, dtype=np.int64), lengths)
    s, p = _candidates(t, min_length, int(lengths.max()) if len(lengths) else 0)
    before = t.agree_left(s, s + p)
    start, length = s - before, before + p + t.agree_right(s, s + p)
    ok = length >= np.maximum(min_length, 2 * p)
    start, length, p = start[ok], length[ok], p[ok]
    order = np.lexsort((p, length, start))
    start, length, p = start[order], length[order], p[order]
    new = np.ones(len(p), dtype=bool)                           # of equal stretches the smallest period
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, p = start[new], length[new], p[new]
    order = np.lexsort((p, start))
    start, length, p = start[order], length[order], p[order]
    return t.doc[start], t.local[start], length, p


def _worker(min_length: int):
    import numpy as np

    def some(texts):
        """Word counts, runs and collapsed texts of a slice."""
        split = [(t or b"").split() for t in texts]             # splits at exactly [\x20\x09-\x0D]+
        numbers: dict = {}
        symbols = [numbers.setdefault(w, len(numbers)) for ws in split for w in ws]
        lengths = [len(ws) for ws in split]
        runs: list[list] = [[] for _ in texts]
        if symbols:
            for d, s, n, p in zip(*(x.tolist() for x in find_runs(symbols, lengths, min_length))):
                runs[d].append({"start": s, "length": n, "period": p})
        collapsed = []
        for ws, found in zip(split, runs):
            if found:
                keep = np.zeros(len(ws) + 1, dtype=np.int64)    # +1 where a dropped stretch opens, -1 where it ends
                for r in found:
                    keep[r["start"] + r["period"]] += 1
                    keep[r["start"] + r["length"]] -= 1
                ws = [w for w, k in zip(ws, np.cumsum(keep).tolist()) if not k]
            collapsed.append(b" ".join(ws))
        return lengths, runs, collapsed

    def run(texts):
        out = [[], [], []]
        todo, size = [], 0
        for i, t in enumerate(texts):
            todo.append(t)
            size += t.count(b" ") + 1 if t else 0
            if size >= SLICE_WORDS or i == len(texts) - 1:
                for column, part in zip(out, some(todo)):
                    column.extend(part)
                todo, size = [], 0
        return out

    return run


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """Columns ``keep``, n_words, runs (array of start, length, period by start, then
    period; words numbered from 0) and collapsed: the words joined by one space,
    without those that a run holds after its first period.

    One row per row, no shuffle; whole texts of any length. Null and blank texts
    have no words and no run, and "" is left of them; repeated rows are taken alike;
    other columns may have any name; an empty table gives an empty result.
    """
    if min_length < 2:
        raise ValueError("a run has at least two words")
    raw = fresh(docs, "_raw")
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias(raw))
    out = map_texts(src, keep, raw, f"n_words bigint, runs array<{RUN}>, collapsed binary", _worker, min_length)
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def longest_run(runs: Column) -> Column:
    """The run with the greatest length (ties: smallest start, then period); null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(F.size(runs) > 0, F.struct((-best["s"]).alias("start"), best["length"].alias("length"),
                                             (-best["p"]).alias("period")))


def run_lines(runs: Column) -> Column:
    """All runs as lines ``start,length,period``."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")


def with_planted_tail(text: Column, key: Column) -> Column:
    """The contract's texts: of documents whose crc32 of the decimal ``key`` ends in 0,
    the words from number g % n on repeat with period 1 + floor((n - g % n) / (3 + g % 8)),
    g being the crc32 without its last digit. Other texts (and null keys) stay as they are."""
    h = F.crc32(key.cast("string").cast("binary"))

    def tail(w):
        n = F.size(w)
        g = F.floor(h / 10).cast("long")
        a = F.pmod(g, n.cast("long")).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
        return F.when(n > 0, let(F.struct(a.alias("a"), p.alias("p")), lambda v: F.array_join(F.transform(
            w, lambda x, i: F.when(i < v["a"], x).otherwise(F.get(w, v["a"] + F.pmod(i - v["a"], v["p"])))), " ")))

    return F.when(h % 10 == 0, F.coalesce(let(words(text), tail), F.lit(""))).otherwise(text)
