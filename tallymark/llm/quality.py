"""Quality rules: plain counts with fixed limits, and divergence from what texts of the language look like.

The base rules count words, symbols, repeated lines and words in repeated five-word windows.  The divergence rule
compares two histograms of a text to those of its language by Jensen-Shannon distance (base 2, so from 0 to 1): classes
of characters, and the most common words of the language with one bin for all others.  A short text strays by chance,
so a distance may be a slack over the square root of the number of words above its limit, and below a least number of
words a text is not judged by it at all.

The references are learnt from the table itself, from texts of the least length that pass the base rules: the common
words are those that most texts of a language hold, and each histogram is the mean over texts, so long texts count no
more than short ones.  A text whose exact copies make up a thousandth of the table or more counts once; at most a
thousand such texts can exist, so they fit a list.  References hold a fixed number of figures for each language; they
are written and joined by language, and Spark sends them to all tasks only if their file is small.

Defined results: a null text is an empty one, with no words, and fails the base rules; a null language is one of its
own; a language with fewer than ``least_texts`` texts to learn from judges none, and its texts are kept by the base
rules alone; ties among common words go to the smaller word; repeated rows give repeated results; an empty table gives
an empty one; input columns with the name of an output column give way to it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm.common import LOWER, UPPER, add_columns, small_batches, texts_of, without, written
from tallymark.operators.scan import unused

#: Words of a window in which repetition counts; a base failure has fewer words, or more percent of repeated ones.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
SYMBOLS = b"#*$%&|<>"
#: Common words of a language.
COMMON = 50
#: Words from which on divergence is judged, and texts that a language's reference must come from.
JUDGED_WORDS, LEAST_TEXTS = 50, 30
#: Limit of each distance and the slack over the root of the number of words.
CLASS_LIMIT, WORD_LIMIT = (0.10, 1.6), (0.20, 1.7)
#: A text with this share of all rows, or more, counts once.
HEAVY = 1000
#: Words held by a task before it hands its counts on.
HELD_WORDS = 200_000

_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _classes() -> np.ndarray:
    """The class of a character by the first byte of its UTF-8 form; bytes that continue one are in the last class."""
    groups = [b"\n", b"\t\x0b\x0c\r ", LOWER.encode(), UPPER.encode(), b"0123456789", b".,;:", b"!?", b"'\"()-"]
    of = np.full(256, len(groups), np.int64)  # other ASCII: symbols
    for k, chars in enumerate(groups):
        of[list(chars)] = k
    of[[*range(9), *range(14, 32), 127]] = len(groups) + 1  # control characters
    for k, (low, high) in enumerate(((0xC0, 0xE0), (0xE0, 0xF0), (0xF0, 0x100), (0x80, 0xC0))):
        of[low:high] = len(groups) + 2 + k  # characters of two, three and four bytes, and what continues them
    return of


CLASS_OF = _classes()
CLASSES = int(CLASS_OF.max())

BASE = [T.StructField(n, T.LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of ``width`` words that occur twice or more, all occurrences counted."""
    windows = list(zip(*(words[k:] for k in range(width))))
    count = Counter(windows)
    if len(count) == len(windows):
        return 0
    total = end = 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + width - max(end, i)
            end = i + width
    return total


def base_counts(text: str, data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    blanks = len(data) - len(data.translate(None, b"\t\n\x0b\x0c\r "))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words)


def fails(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def heavy_texts(keyed: DataFrame, key: str) -> dict[int, int]:
    """Hashes of the texts that make up a share of the table, with their numbers of rows: HEAVY entries at most."""
    n = keyed.count()
    rows = keyed.groupBy(key).count().where(F.col("count") > 1).where(F.col("count") * HEAVY >= n).collect()
    return {r[key]: r["count"] for r in rows}


def common_words(keyed: DataFrame, lang: str, key: str, text: str, heavy: dict[int, int], n: int = COMMON) -> DataFrame:
    """lang and its ``n`` words that most texts hold, as an array in the order of their numbers of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in held], pa.string()),
                    pa.array([w for _, w in held], pa.binary()),
                    pa.array(held.values(), pa.float64()),
                ],
                names=["lang", "word", "texts"],
            )

        for batch in batches:
            for part in small_batches([batch]):
                langs, keys = part.column(0).to_pylist(), part.column(1).to_pylist()
                for of, h, t in zip(langs, keys, part.column(2).to_pylist()):
                    data = (t or "").encode()
                    words = data.split()
                    if len(words) < JUDGED_WORDS or 100 * repeated_words(words) > MOST_REPEATED * len(words):
                        continue
                    one = 1.0 / heavy.get(h, 1)
                    for w in set(data.translate(_LOWERED).split()):
                        held[of, w] += one
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    counts = keyed.select(lang, key, text).mapInArrow(run, "lang string, word binary, texts double")
    counts = counts.groupBy("lang", "word").agg(F.round(F.sum("texts"), 6).alias("texts"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("texts"), "word"))
    best = counts.withColumn("place", place).where(F.col("place") <= n)
    words = F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"])
    return best.groupBy("lang").agg(words.alias("words"))


def histograms(df: DataFrame, text: str, lang: str, words: str, keep_text: bool, n: int = COMMON) -> DataFrame:
    """Add the base counts, counts of character classes, and counts of the common words in ``words`` with one for the rest."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        column = batch.schema.get_field_index
        known: dict = {}
        base, classes, commons = [], [], []
        common = batch.column(column(words))
        for i, (of, t) in enumerate(zip(batch.column(column(lang)).to_pylist(), texts_of(batch, text))):
            if of not in known:
                known[of] = {w: k for k, w in enumerate(common[i].as_py() or [])}
            place = known[of]
            data = t.encode()
            base.append(base_counts(t, data, data.split()))
            classes.append(np.bincount(CLASS_OF[np.frombuffer(data, np.uint8)], minlength=CLASSES + 1)[:CLASSES])
            of_words = [0] * (n + 1)
            for w in data.translate(_LOWERED).split():
                of_words[place.get(w, n)] += 1
            commons.append(of_words)
        columns = [pa.array(c, pa.int64()) for c in zip(*base)] if base else [pa.array([], pa.int64())] * len(BASE)
        return [*columns, pa.array([c.tolist() for c in classes], pa.list_(pa.int64())), pa.array(commons, pa.list_(pa.int64()))]

    counts = T.ArrayType(T.LongType(), False)
    fields = [*BASE, T.StructField("class_counts", counts, False), T.StructField("word_counts", counts, False)]
    return add_columns(df, fields, make, drop=(words,) if keep_text else (words, text))


def shares(counts: str) -> Column:
    """The counts of a histogram as shares of their sum."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(counts, lambda x: x / total)


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence, in bits, of two arrays of shares."""

    def part(x: Column, both: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / both)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(a, a + b) + part(b, a + b))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def references(counted: DataFrame, lang: str, weight: Column, n: int = COMMON) -> DataFrame:
    """For each language the mean shares of classes and words over its texts, and how many texts that were."""
    good = counted.where((F.col("n_words") >= JUDGED_WORDS) & ~fails(F.col("n_words"), F.col("n_repeat_words")))
    good = good.select(F.col(lang).alias("lang"), weight.alias("w"), shares("class_counts").alias("c"), shares("word_counts").alias("v"))

    def mean(column: str, size: int) -> Column:
        return F.array(*[F.round(F.sum(F.col("w") * F.col(column)[k]) / F.sum("w"), 9) for k in range(size)])

    return good.groupBy("lang").agg(mean("c", CLASSES).alias("class_ref"), mean("v", n + 1).alias("word_ref"), F.round(F.sum("w"), 6).alias("ref_texts"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", keep_text: bool = True, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """Add the base counts, base_failed, class_distance, word_distance (null: not judged) and kept.

    Texts are read three times: for copies, for common words and for the counts, which are written.
    """
    made = ("class_counts", "word_counts", "base_failed", "class_distance", "word_distance", "kept", *(f.name for f in BASE))
    docs = without(docs, *made)
    own, key, words = unused(docs, "quality_lang"), unused(docs, "quality_key"), unused(docs, "quality_words")
    keyed = docs.withColumn(own, F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(""))).withColumn(key, F.xxhash64(own, f"`{text}`"))
    heavy = heavy_texts(keyed, key)
    common = written(common_words(keyed, own, key, f"`{text}`", heavy).withColumnsRenamed({"lang": own, "words": words}), "quality-words")
    counted = written(histograms(keyed.join(common, own, "left"), text, own, words, keep_text), "quality-counts")
    weight = F.lit(1.0)
    if heavy:
        copies = F.create_map(*[F.lit(x) for pair in heavy.items() for x in pair])
        weight = 1.0 / F.coalesce(copies[F.col(key)], F.lit(1))
    refs = references(counted, own, weight).where(F.col("ref_texts") >= least_texts)
    names = {c: unused(counted, c) for c in ("class_ref", "word_ref", "ref_texts")}
    refs = written(refs.withColumnsRenamed({"lang": own, **names}), "quality-references")
    both = counted.join(refs, own, "left")
    judged = (F.col("n_words") >= JUDGED_WORDS) & F.col(names["ref_texts"]).isNotNull()

    def distance(counts: str, ref: str) -> Column:
        return F.when(judged, js_distance(shares(counts), F.col(names[ref])))

    def within(distance: str, limit: tuple[float, float]) -> Column:
        return F.coalesce(F.col(distance) <= limit[0] + limit[1] / F.sqrt("n_words"), F.lit(True))

    both = both.withColumn("base_failed", fails(F.col("n_words"), F.col("n_repeat_words")))
    both = both.withColumns({"class_distance": distance("class_counts", "class_ref"), "word_distance": distance("word_counts", "word_ref")})
    both = both.withColumn("kept", ~F.col("base_failed") & within("class_distance", CLASS_LIMIT) & within("word_distance", WORD_LIMIT))
    return both.drop("class_counts", "word_counts", own, key, *names.values())
