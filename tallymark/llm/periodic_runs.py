"""Periodic runs of words: every maximal repetition of a text, found through Lyndon roots.

A run is a stretch of words in which words one period apart are equal, that no neighbouring word extends, with the
smallest period.  Every run has a Lyndon word of its period's length under one of the two orders of the alphabet,
which is the longest Lyndon word at its first position.  So for each order a stack of Lyndon factors is scanned from
right to left; the factor at a position ends where the next smaller suffix starts.  Each factor that is followed by
itself is extended in both directions, and what comes out long enough is a run.  Suffixes are compared, and factors
extended, by the longest common extension: a few words directly, then a binary search over rolling hashes, whose
answer is always checked against the words themselves.  There is no suffix array.

Work is one text at a time, O(n log n) in its words, and needs a few lists as long as the text.

Defined results: a null, empty or blank text has no runs, and null and empty collapse to the empty text; ties for the
greatest exponent go to the smallest start, then period; repeated rows give repeated results; an empty table gives an
empty one; input columns with the name of an output column give way to it.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm.common import BLANKS, add_columns, texts_of

#: Shortest run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words compared one by one before hashes are asked.
DIRECT = 16
#: Modulus (a Mersenne prime) and base of the rolling hash.
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687

RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])
RUN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Extensions:
    """Longest common extensions of the positions of one word sequence, to the right and to the left."""

    def __init__(self, ids: list[int]):
        self.ids, self.n = ids, len(ids)
        self._hashes: list[int] | None = None

    def _prefixes(self) -> list[int]:
        """Hashes of all prefixes, made when first needed: most texts never do."""
        if self._hashes is None:
            h, out, powers, p = 0, [0], [1], 1
            for x in self.ids:
                h = (h * BASE + x + 1) % PRIME
                p = p * BASE % PRIME
                out.append(h)
                powers.append(p)
            self._hashes, self._powers = out, powers
        return self._hashes

    def _stretch(self, a: int, b: int, step: int, least: int, most: int) -> int:
        """The largest k for which k words from ``a`` and ``b`` have equal hashes, known to hold for ``least``.

        With ``step`` -1 the words end before the two positions.
        """
        h = self._prefixes()
        p, ahead = self._powers, h[a] - h[b]

        def equal(k: int) -> bool:
            if step > 0:
                return not (h[a + k] - h[b + k] - ahead * p[k]) % PRIME
            return not (ahead - (h[a - k] - h[b - k]) * p[k]) % PRIME

        reach = least
        while least < most:  # gallop, then halve what is left
            k = min(most, least + reach)
            if not equal(k):
                most = k - 1
                break
            least, reach = k, reach * 2
        while least < most:
            k = (least + most + 1) // 2
            if equal(k):
                least = k
            else:
                most = k - 1
        return least

    def _verified(self, a: int, b: int, k: int, step: int) -> int:
        """k, or less where the words themselves differ although their hashes agree."""
        if self.ids[a : a + k] == self.ids[b : b + k]:
            return k
        differ = np.flatnonzero(np.array(self.ids[a : a + k]) != np.array(self.ids[b : b + k]))
        return int(differ[0]) if step > 0 else k - 1 - int(differ[-1])

    def right(self, i: int, j: int) -> int:
        """How many words from i < j on are equal."""
        ids, n, k = self.ids, self.n, 0
        while j + k < n and ids[i + k] == ids[j + k]:
            k += 1
            if k == DIRECT:
                k = self._stretch(i, j, 1, k, n - j)
                return self._verified(i, j, k, 1)
        return k

    def left(self, i: int, j: int) -> int:
        """How many words before i < j are equal."""
        ids, k = self.ids, 0
        while k < i and ids[i - 1 - k] == ids[j - 1 - k]:
            k += 1
            if k == DIRECT:
                k = self._stretch(i, j, -1, k, i)
                return self._verified(i - k, j - k, k, -1)
        return k


def lyndon_ends(ids: list[int], reach: Extensions) -> tuple[list[int], list[int]]:
    """For each position where the longest Lyndon word there ends, under the order of the ids and under its reverse.

    That is the start of the next smaller suffix; a suffix that is a prefix of another is the smaller one under both
    orders.  Right to left, the words that end at the stack's positions are joined while the next suffix is greater.
    A suffix and the next one are in one order under one of the two, so one comparison serves both: under the other
    the Lyndon word is a single one.  Where the two words are equal, their suffixes compare as the two after them.
    """
    n = len(ids)
    up, down = [n] * n, [n] * n
    smaller = None  # whether a suffix is below the next one, by the ids; None where the next one is its prefix
    for i in range(n - 2, -1, -1):
        x, y = ids[i], ids[i + 1]
        if x != y:
            smaller = x < y
        if smaller is None:
            up[i] = down[i] = i + 1
        elif smaller:
            down[i] = i + 1
            j = up[i + 1]
            while j < n:
                y = ids[j]
                if x == y:
                    k = reach.right(i, j)
                    if j + k == n or ids[i + k] > ids[j + k]:
                        break
                elif x > y:
                    break
                j = up[j]
            up[i] = j
        else:
            up[i] = i + 1
            j = down[i + 1]
            while j < n:
                y = ids[j]
                if x == y:
                    k = reach.right(i, j)
                    if j + k == n or ids[i + k] < ids[j + k]:
                        break
                elif x < y:
                    break
                j = down[j]
            down[i] = j
    return up, down


def runs_of(words: list, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words and ``periods`` (two or more) periods, sorted."""
    if periods < 2:
        raise ValueError("a run repeats its period at least once")
    n = len(words)
    if n < max(least, periods):
        return []
    distinct = dict.fromkeys(words)
    if len(distinct) == n:
        return []
    ids = list(map(dict(zip(distinct, range(n))).__getitem__, words))
    reach, found = Extensions(ids), set()
    for ends in lyndon_ends(ids, reach):
        covered: dict[int, int] = {}  # period -> where the last run of this period ends
        for i, j in enumerate(ends):
            # In a run of three periods, some root has a whole copy behind it; of two, perhaps its first word only.
            if j == n or ids[i] != ids[j]:
                continue
            p = j - i
            if j + p <= covered.get(p, 0) or periods >= 3 and ids[i:j] != ids[j : j + p]:
                continue
            left, right = reach.left(i, j), reach.right(i, j)
            length = p + left + right
            if length >= periods * p:
                covered[p] = j + right
                if length >= least:
                    found.add((i - left, length, p))
    return sorted(found)


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    inside = np.cumsum(change[:-1]) > 0
    return [w for w, drop in zip(words, inside.tolist()) if not drop]


def periodic_runs(
    df: DataFrame,
    text: str = "text",
    least: int = LEAST_WORDS,
    periods: int = LEAST_PERIODS,
    out: str = "runs",
    collapsed: str = "collapsed",
) -> DataFrame:
    """Add the runs of each text, by start and period, and the text with each run cut to its first period."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        runs, texts = [], []
        for t in texts_of(batch, text):
            words = t.encode().split()
            found = runs_of(words, least, periods)
            runs.append([{"start": s, "length": k, "period": p} for s, k, p in found])
            texts.append(b" ".join(kept_words(words, found)).decode())
        return [pa.array(runs, RUN_ARROW), pa.array(texts, pa.string())]

    fields = [T.StructField(out, T.ArrayType(RUN), False), T.StructField(collapsed, T.StringType(), False)]
    return add_columns(df, fields, make)


def greatest(runs: str = "runs") -> Column:
    """The run with the greatest exact length by period, the first of equals; null where there is none."""

    def better(best: Column, x: Column) -> Column:
        more = x["length"] * best["period"] > best["length"] * x["period"]
        return F.when(best.isNull() | more, x).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def runs_digest(runs: str = "runs") -> Column:
    """SHA-256 over a line ``start,length,period`` for each run."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return F.sha2(F.array_join(lines, "").cast("binary"), 256)


def words_of(text: str = "text") -> Column:
    """The words of a text as an array; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), lambda w: w != "")


__all__ = ["greatest", "kept_words", "lyndon_ends", "periodic_runs", "runs_digest", "runs_of", "words_of"]
