"""Importance resampling towards a target, over hashed n-grams whose CRCs are composed from those of words.

Features are all runs of one to three words, joined by a space and hashed by CRC-32 into buckets.  A word's CRC is
computed once for a batch; the CRC of a longer string follows from those of its parts, as

    crc(a + b) = shift(crc(a), bytes of b) ^ crc(b),

where ``shift`` multiplies by a power of x modulo the CRC's polynomial: a linear map over GF(2), held as a 32 x 32 bit
matrix in four tables of 256 words.  No n-gram is ever made as a string.

Bucket counts of the corpus and of the target are summed over all texts, in each task first.  What comes to the driver
and goes to the tasks are two counts for each of a fixed number of buckets, whatever the input.  A text's weight is the
sum of its features' log ratios, and the texts with the highest weight plus Gumbel noise, derived from a seed and the
id, are drawn: sampling without replacement in proportion to the weights.  Ranks come from a range partitioning and one
offset for each partition, so no task sees more than its range.

Defined results: a null or empty text has no features and weight 0, and is never drawn where ``least`` is above 0; a
null id is hashed like the empty text and sorts before others among equal scores; ties go to the smaller id; repeated
rows are rows of their own, and which of two equal ones comes first is open; an empty corpus gives an empty table, an
empty target a gain from smoothing alone; input columns with the name of an output column give way to it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm.common import add_columns, small_batches, texts_of, without, written
from tallymark.operators.scan import numbered

BUCKETS, LONGEST = 10_000, 3
#: Draw this share of the texts, in hundredths, among those with so many words.
SHARE, LEAST = 5, 20
SEED = 42
#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Shifts by fewer bytes than this have a table of their own; longer ones are put together from powers of two.
NEAR = 64
#: Letters and digits of ASCII, lower-cased, and all bytes beyond ASCII stay; what else there is separates words.
KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Words composed at once; bounds the arrays of a batch.
BLOCK = 1 << 20


def _times(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A GF(2) matrix, as the images of the 32 single bits, by a vector of CRCs."""
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where(x >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def _tables(matrix: np.ndarray) -> np.ndarray:
    """The matrix by the values of each byte of a CRC: four rows of 256."""
    byte = np.arange(256, dtype=np.uint32)
    return np.stack([_times(matrix, byte << np.uint32(8 * k)) for k in range(4)])


class Shifts:
    """What appending so many zero bytes does to a CRC."""

    def __init__(self) -> None:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        step = np.where(bits & np.uint32(1), np.uint32(POLYNOMIAL), bits >> np.uint32(1))  # one zero bit
        for _ in range(3):
            step = _times(step, step)  # two, four, eight: one byte
        self.power, near, here = [step], [], bits
        for _ in range(NEAR):
            near.append(_tables(here))
            here = _times(step, here)
        self.near = np.stack(near).reshape(-1)
        for _ in range(39):  # up to 2^40 bytes
            self.power.append(_times(self.power[-1], self.power[-1]))

    def __call__(self, crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
        at = (n_bytes & (NEAR - 1)) << 10
        near = self.near
        out = near[at + (crc & 255)]
        for k in (1, 2, 3):
            out ^= near[at + (k << 8) + (crc >> np.uint32(8 * k) & 255)]
        far = n_bytes >> 6
        for bit in range(int(far.max(initial=0)).bit_length()):
            some = np.flatnonzero(far >> bit & 1)
            out[some] = _times(self.power[bit + 6], out[some])
        return out


_SHIFTS: Shifts | None = None


def shifts() -> Shifts:
    global _SHIFTS
    if _SHIFTS is None:
        _SHIFTS = Shifts()
    return _SHIFTS


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(KEPT).split()


def ngram_crcs(texts: list[list[bytes]], longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """CRCs of all n-grams of all texts, and the number of the text that each belongs to."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for ws in texts for w in ws), np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in texts])
    shift, n_words = shifts(), len(known)
    crc = np.fromiter((zlib.crc32(w) for w in known), np.uint32, n_words)
    size = np.fromiter((len(w) for w in known), np.int64, n_words)
    blank = np.full(n_words, zlib.crc32(b" "), np.uint32)
    spaced = (shift(blank, size) ^ crc)[ids]  # a blank and the word
    longer, last = size[ids] + 1, crc[ids]
    crcs, owners = [last], [owner]
    for n in range(2, longest + 1):
        k = len(ids) - n + 1
        if k <= 0:
            break
        last = shift(last[:k], longer[n - 1 :]) ^ spaced[n - 1 :]
        whole = owner[:k] == owner[n - 1 :]
        crcs.append(last[whole])
        owners.append(owner[:k][whole])
    return np.concatenate(crcs), np.concatenate(owners)


def _blocks(words: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most BLOCK words together, or one longer text."""
    start = total = 0
    for i, ws in enumerate(words):
        if total and total + len(ws) > BLOCK:
            yield start, i
            start, total = i, 0
        total += len(ws)
    if start < len(words):
        yield start, len(words)


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, the features in it over all texts; each task sums its own texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in small_batches([batch]):
                words = [words_of(t) for t in texts_of(part, text)]
                for a, b in _blocks(words):
                    crcs, _ = ngram_crcs(words[a:b])
                    total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return df.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed frequencies in each bucket, rounded down."""
    b = len(corpus)
    up, down = (target + 1.0) * float(corpus.sum() + b), (corpus + 1.0) * float(target.sum() + b)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def learn(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket.  ``buckets`` rows at most come to the driver, in one job for both tables."""
    both = bucket_counts(docs, text, buckets).withColumn("side", F.lit(0))
    both = both.unionByName(bucket_counts(target, text, buckets).withColumn("side", F.lit(1)))
    counts = np.zeros((2, buckets), np.int64)
    for r in both.collect():
        counts[r.side, r.bucket] = r.n
    return gains(counts[0], counts[1])


def weigh(df: DataFrame, gain: np.ndarray, text: str = "text", drop_text: bool = False) -> DataFrame:
    """Add n_words, n_features and weight."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        words = [words_of(t) for t in texts_of(batch, text)]
        n_words = np.fromiter((len(w) for w in words), np.int64, len(words))
        weight = np.zeros(len(words), np.int64)
        features = np.zeros(len(words), np.int64)
        for a, b in _blocks(words):
            crcs, owner = ngram_crcs(words[a:b])
            np.add.at(weight[a:b], owner, gain[crcs % np.uint32(len(gain))])
            features[a:b] = np.bincount(owner, minlength=b - a)
        return [pa.array(n_words), pa.array(features), pa.array(weight)]

    fields = [T.StructField(n, T.LongType(), False) for n in ("n_words", "n_features", "weight")]
    return add_columns(df, fields, make, drop=(text,) if drop_text else ())


def noise(doc_id: str = "doc_id", seed: int = SEED):
    """Thousandths of a standard Gumbel variate, rounded down, from the first 32 bits of a hash of seed and id."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(scored: DataFrame, eligible, share: int = SHARE, doc_id: str = "doc_id", rank: str = "rank") -> DataFrame:
    """Add the rank of the drawn rows: the highest scores of the eligible ones, ``share`` in a hundred of them."""
    scored = without(scored, rank)
    chosen = F.coalesce(eligible, F.lit(False))
    ranked = numbered(scored.where(chosen), [F.col("score").desc(), F.col(f"`{doc_id}`").asc()], rank, first=1)
    n = scored.where(chosen).count()
    drawn = F.when(F.col(rank) <= share * n // 100, F.col(rank))
    return ranked.withColumn(rank, drawn).unionByName(scored.where(~chosen).withColumn(rank, F.lit(None).cast("long")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    share: int = SHARE,
    least: int = LEAST,
    seed: int = SEED,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The rows of ``docs`` without their texts, with n_words, n_features, weight, score and rank (null: not drawn).

    Weights are written to the shared folder before ranks are given, so that texts are read twice and no more.
    """
    weighed = weigh(docs, learn(docs, target, text, buckets), text, drop_text=True)
    scored = weighed.withColumn("score", F.col("weight") + noise(doc_id, seed))
    return draw(written(scored, "importance"), F.col("n_words") >= least, share, doc_id)
