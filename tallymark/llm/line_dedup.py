"""Fuzzy line deduplication in DataFrame functions only.

A line is normalised (lower case, runs of blanks as one, none at its ends) and known by
a 64-bit hash of its words.  Equal lines are one entry with the occurrence that is kept:
the one whose hash of doc_id, text and place is least.  This exact step takes every line
that is not blank.

Entries of at least ``min_words`` words are also compared.  The hashes of a line's distinct
words give both its SimHash of 63 bits and its blocks: the hashes are put in order, as a ring,
and each run of a few neighbours that begins at a chosen hash is a block.  A hash is chosen by
itself, in longer lines one in two, four, eight and so on, each choice part of the one before:
a line has 10 to 20 blocks however long it is.  A changed word takes one hash out and puts one
in, so it breaks the few blocks around these two places and no others: of enough, some stay whole.
Lines of fewer than ``FEW_WORDS`` words have as blocks their words without any none, one or two of them, so
lines with up to two changed words always share one.  Entries that share a block meet if their
SimHashes, which lines of few words are not given, differ in at most ``BITS`` bits, and if nothing that is known of them without their
texts rules out their edit similarity: the lengths, and two bitmaps of words.  They are linked if their edit similarity is at least ``similarity``.  Each entry first meets
the least one of its key; links make components; then all pairs of a key that lie in
different components meet, in blocks of ``DEAL`` against ``DEAL`` where a key has more.
So every pair of a key is compared or lies in one component already.  Of each connected
group, the occurrence with the least hash is kept.

Edit similarity is 1 - distance / length of the longer line: over characters up to
``LONG`` characters, over words (one character each) beyond.

Defined results: blank lines are always kept; a text of which no line is dropped comes
back as it was; a null text stays null and an empty one empty; rows that agree in doc_id
and text are one document and get the same lines; a null doc_id is a value like others;
different lines whose 64-bit hashes clash are all kept.  Lines of fewer than ``min_words``
words (so lines in scripts without blanks) are only compared exactly.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import sheltered, without, written
from tallymark.llm.graph import components

#: Distinct words below which a line's blocks are its words but up to two, and the least number of words of such a block.
FEW_WORDS, LEAST = 10, 3
#: Lines of 8 to 19 distinct words have a block of 3 at each hash, and those from 16 on blocks of 4 at some (``_one_in``), so that near lines have blocks of one kind.
SHORT, SHORT_BLOCK, LONGER, LONGER_BLOCK = (8, 20), 3, 16, 4
#: Bits of a SimHash, and the widths of the counters that they are added up in, from the narrowest.
SIMHASH, COUNTERS = 63, (7, 9, 21, 63)
#: Bits in which compared lines may differ: at a cosine of 0.8, 12.9 of 63 differ on average, by 3.2 more or less; this is two and a half times that above.
BITS = 21
#: Bits of a word's hash that give its character (``_as_characters``), and bitmaps of 64 bits each that hold which words a line has, by the last of these bits.
CHARACTER, BITMAPS = 12, 2
#: Entries of a key that are compared in one block, on average.
DEAL = 1024
#: Characters up to which distances are taken over characters.
LONG = 120
#: Entries to compare whose places may be broadcast (some 50 bytes each).
FEW = 500_000


def plain(text: Column) -> Column:
    """The text in lower case with spaces for the other blanks of a line."""
    out = F.lower(text)
    for blank in "\t\r\x0b\x0c":
        out = F.replace(out, F.lit(blank), F.lit(" "))
    return out


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _votes(hashes: Column, width: int) -> Column:
    """For each k under ``width`` a number with the counts of bits k, k + width, ..., each in a field of ``width`` bits."""
    ones = F.lit(sum(1 << at for at in range(0, SIMHASH, width))).cast("long")
    one = lambda k: F.aggregate(hashes, F.lit(0).cast("long"), lambda n, x: n + F.shiftrightunsigned(x, k).bitwiseAND(ones))
    return F.array(*[one(k) for k in range(width)])


def _majorities(votes: str, n: Column, width: int) -> Column:
    """The bits that more than half of n hashes have; all fields of a number at once."""
    ones, top = sum(1 << at for at in range(0, SIMHASH, width)), width - 1
    # a field's count is over n / 2 if it reaches its top bit with this added; under 2 ** width hashes it does not go beyond it
    more = F.lit(ones).cast("long") * (F.lit((1 << top) - 1).cast("long") - F.shiftright(n, 1))
    tops = F.lit(ones << top).cast("long")
    over = [F.shiftrightunsigned((F.element_at(votes, k + 1) + more).bitwiseAND(tops), top - k) for k in range(width)]
    return functools.reduce(Column.bitwiseOR, over)


def _by_counter(n: Column, of: Callable[[int], Column]) -> Column:
    """What ``of`` gives for the narrowest counter that holds n."""
    out = of(COUNTERS[-1])
    for width in COUNTERS[-2::-1]:
        out = F.when(n < 1 << width, of(width)).otherwise(out)
    return out


def _blocks(n: Column) -> Column:
    """Hashes of the blocks of a line, from its columns hashes (in order), ring (the same, going on with the first ones), all_words (their exclusive or) and one_in."""

    def run(words: int, x: Column, i: Column) -> Column:
        """The hash of the size and the array of the hashes of a run: that of an array is that of its elements, one after the other."""
        return F.xxhash64(F.lit(words), x, *[F.get("ring", i + k) for k in range(1, words)])

    def few() -> Column:
        one = F.transform("hashes", lambda x: F.col("all_words").bitwiseXOR(x))
        others = lambda i: F.transform(F.slice("hashes", i + 1, n), lambda x: F.col("all_words").bitwiseXOR(F.element_at("hashes", i)).bitwiseXOR(x))
        two = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), others))
        left = F.concat(F.array("all_words"), F.when(n > LEAST, one).otherwise(none), F.when(n > LEAST + 1, two).otherwise(none))
        return F.transform(left, lambda x: F.xxhash64(F.lit(-1), x))

    none = F.array().cast("array<bigint>")
    short = F.when((n >= SHORT[0]) & (n < SHORT[1]), F.transform("hashes", lambda x, i: run(SHORT_BLOCK, x, i))).otherwise(none)
    # those not chosen are 0 and taken out in one go
    chosen = F.transform("hashes", lambda x, i: F.when(x.bitwiseAND(F.col("one_in") - 1) == 0, run(LONGER_BLOCK, x, i)).otherwise(F.lit(0).cast("long")))
    longer = F.when(n >= LONGER, F.array_remove(chosen, F.lit(0).cast("long"))).otherwise(none)
    return F.array_distinct(F.concat(F.when(_few(n), few()).otherwise(none), short, longer))


def _one_in(n: Column) -> Column:
    """Two for lines of up to 39 words, 4 up to 79, 8 up to 159 and so on."""
    return F.greatest(F.lit(2), F.pow(2.0, F.floor(F.log2(n / 40)) + 2)).cast("long")


def _few(n: Column) -> Column:
    return n < FEW_WORDS


def _as_characters(words: Column) -> Column:
    """A string with one character for each word, from a hash to 4096 characters of private use."""
    one = F.transform(words, lambda w: F.hex(F.lit(0xE000) + F.xxhash64(w).bitwiseAND((1 << CHARACTER) - 1)))
    return F.decode(F.unhex(F.array_join(one, "")), "UTF-16BE")


def edit_similar(similarity: float) -> Column:
    def near(x: Column, y: Column) -> Column:
        most = F.floor(F.greatest(F.length(x), F.length(y)) * (1 - similarity) + 1e-9).cast("int")
        return (F.abs(F.length(x) - F.length(y)) <= most) & (F.call_function("levenshtein", x, y, most) >= 0)

    short = F.greatest(F.length("norm_a"), F.length("norm_b")) <= LONG
    return F.when(short, near(F.col("norm_a"), F.col("norm_b"))).otherwise(near(F.col("chars_a"), F.col("chars_b")))


def _bitmap(hashes: Column, k: int) -> Column:
    """Which words a line has, by the last bits of their hashes; those of the other bitmaps are left out."""

    def bit(x: Column) -> Column:
        here = F.shiftrightunsigned(x, 6).bitwiseAND(BITMAPS - 1) == k
        return F.call_function("shiftleft", here.cast("long"), x.bitwiseAND(63).cast("int"))

    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(bit(x)))


#: What is known of an entry without its text.
KNOWN = ("sim", "n_words", "n_chars", *[f"has_{k}" for k in range(BITMAPS)])


def may_be_similar(similarity: float) -> Column:
    """Whether lengths and words leave room for an edit similarity that is high enough; no pair that ``edit_similar`` takes is lost.

    Each character of one line that the other lacks takes an edit, and so does each one that is too many.  Words that share a
    bit of a bitmap share more than their characters do, so the bits that only one line has are no more than its characters that the other lacks.
    """

    def room(n: str, *edits: Column) -> Column:
        x, y = F.col(f"{n}_a"), F.col(f"{n}_b")
        return F.greatest(F.lit(0), F.abs(x - y), *edits) <= F.floor(F.greatest(x, y) * (1 - similarity) + 1e-9)

    def only(x: str, y: str) -> Column:
        return functools.reduce(Column.__add__, [F.bit_count(F.col(f"has_{k}_{x}").bitwiseAND(F.bitwise_not(f"has_{k}_{y}"))) for k in range(BITMAPS)])

    short = F.greatest("n_chars_a", "n_chars_b") <= LONG
    return F.when(short, room("n_chars")).otherwise(room("n_words", only("a", "b"), only("b", "a")))


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, h (the text's hash), place and words of each line that is not blank."""
    words = F.transform(F.split(plain(F.col(text)), "\n"), words_of)
    # the hash is taken before lines are made rows, not once for each; outer, as else the arrays are made again to test that they hold rows
    whole = docs.where(F.col(text).isNotNull()).select("doc_id", F.xxhash64(text).alias("h"), words.alias("lines"))
    rows = whole.select("doc_id", "h", F.posexplode_outer("lines").alias("place", "words"))
    return rows.where(F.size("words") > 0)


def entries_of(docs: DataFrame, text: str) -> DataFrame:
    """A row for each distinct line, with its kept occurrence (doc_id, h, place), lengths, SimHash, bitmaps and blocks."""
    hashes = F.sort_array(F.array_distinct(F.transform("words", lambda w: F.xxhash64(w))))
    seen = _lines(docs, text).select(
        F.xxhash64("words").alias("id"),
        F.xxhash64("words", F.lit(1)).alias("check"),
        "doc_id",
        "h",
        "place",
        F.xxhash64("doc_id", "h", "place").alias("o"),
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", " ")).alias("n_chars"),
        hashes.alias("hashes"),
    )
    n = F.size("hashes")
    ring = F.concat("hashes", F.slice("hashes", 1, LONGER_BLOCK - 1)).alias("ring")
    all_words = F.when(_few(n), F.aggregate("hashes", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))).alias("all_words")
    seen = seen.select("*", ring, all_words, _one_in(n).alias("one_in"), _by_counter(n, lambda width: _votes(F.col("hashes"), width)).alias("votes"))
    sim = F.when(~_few(n), _by_counter(n, lambda width: _majorities("votes", n.cast("long"), width)))
    bitmaps = [_bitmap(F.col("hashes"), k).alias(f"has_{k}") for k in range(BITMAPS)]
    seen = seen.select("id", "check", "o", F.struct("doc_id", "h", "place", "n_words", "n_chars", sim.alias("sim"), *bitmaps, _blocks(n).alias("blocks")).alias("line"))
    # one row for each line and task goes into the shuffle
    each = seen.groupBy("id").agg(F.min("o").alias("o"), F.min_by("line", "o").alias("line"), (F.min("check") != F.max("check")).alias("clash"))
    return written(each.select("id", "o", "clash", "line.*"), "line-entries")


def may_be_near(a: str, b: str) -> Column:
    return F.coalesce(F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= BITS, F.lit(True))


def met(entries: DataFrame) -> DataFrame:
    """A row for each entry and key that holds others: key, id, n and the key's least entry."""
    of_key = Window.partitionBy("key")
    rows = entries.select("id", F.explode("blocks").alias("key"))
    # the rows go through one shuffle, not one to count them and one to join the counts
    rows = rows.select("key", "id", F.count("*").over(of_key).alias("n"), F.min("id").over(of_key).alias("first")).where("n > 1")
    return written(rows, "line-keys")


def stars(rows: DataFrame, entries: DataFrame, similarity: float) -> DataFrame:
    """Near pairs (a, b) of an entry and the least one of its key."""
    pairs = rows.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    side = lambda s: entries.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in KNOWN])
    return pairs.join(side("a"), "a").join(side("b"), "b").where(may_be_near("sim_a", "sim_b") & may_be_similar(similarity)).select("a", "b")


def across(rows: DataFrame, entries: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """All near pairs (a, b) of a key that lie in different components, each once."""
    named = rows.where("n > 2").join(groups, F.col("id") == F.col("node"), "left").select("key", "id", "n", F.coalesce("component", "id").alias("c"))
    named = written(named, "line-met")
    mixed = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
    blocks = F.ceil(F.col("n") / DEAL)
    dealt = named.join(mixed, "key").join(entries.select("id", *KNOWN), "id")
    dealt = dealt.select("key", "id", *KNOWN, "c", (blocks - 1).alias("last"), F.pmod(F.xxhash64("id", F.lit(1)), blocks).alias("place"))
    side = lambda s, *block: dealt.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "c", *KNOWN)], *block)
    x = side("a", F.col("place").alias("lo"), F.explode(F.sequence("place", "last")).alias("hi"))
    y = side("b", F.col("place").alias("hi"), F.explode(F.sequence(F.lit(0).cast("long"), "place")).alias("lo"))
    near = (F.col("c_a") != F.col("c_b")) & may_be_near("sim_a", "sim_b") & may_be_similar(similarity) & ((F.col("lo") < F.col("hi")) | (F.col("id_a") < F.col("id_b")))
    return x.join(y, ["key", "lo", "hi"]).where(near).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _texts(wanted: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """id, norm and chars (a character for each word) of some entries, from the documents of their kept occurrences."""
    n = wanted.count()
    few = n <= FEW
    keyed = docs.where(F.col(text).isNotNull()).select(F.col("doc_id").alias("d"), F.xxhash64(text).alias("th"), F.col(text).alias("whole"))
    here = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("th") == F.col("h"))
    places = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("id", "place")).alias("at"))
    found = keyed.join(F.broadcast(places) if few else places, here)
    # the lines are the one element of an array, so that they are made once for a document, not for each of its places
    pick = lambda lines: F.transform("at", lambda a: F.struct(a["id"].alias("id"), F.element_at(lines, a["place"] + 1).alias("line")))
    own = F.flatten(F.transform(F.array(F.split("whole", "\n")), pick))
    words = found.select(F.explode_outer(own).alias("at")).select("at.id", words_of(plain(F.col("at.line"))).alias("words"))
    texts = written(words.select("id", F.array_join("words", " ").alias("norm"), _as_characters(F.col("words")).alias("chars")), "line-texts")
    return texts if texts.count() == n else texts.dropDuplicates(["id"])  # more only where rows are repeated


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of entries whose edit similarity is high enough."""
    side = lambda n: texts.select(F.col("id").alias(n), F.col("norm").alias(f"norm_{n}"), F.col("chars").alias(f"chars_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return written(both.where(edit_similar(similarity)).select("a", "b"), "line-links")


def links(entries: DataFrame, docs: DataFrame, similarity: float, text: str) -> DataFrame:
    """Verified links (a, b) between entries, as many as their components need."""

    def wanted(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        return entries.join(ids, "id").select("id", "doc_id", "h", "place")

    rows = met(entries)
    pairs = written(stars(rows, entries, similarity), "line-pairs")
    texts = _texts(written(wanted(pairs), "line-ids"), docs, text)
    found = verified(pairs, texts, similarity)
    pairs = written(across(rows, entries, components(found), similarity), "line-pairs")
    # the texts of the first round are not fetched again
    rest = _texts(written(wanted(pairs).join(texts.select("id"), "id", "left_anti"), "line-ids"), docs, text)
    return found.unionByName(verified(pairs, texts.unionByName(rest), similarity))


@sheltered
def dedup_lines(docs: DataFrame, text: str = "text", min_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Documents whose text has only kept lines, with n_lines and n_dropped."""
    docs = without(docs, "n_lines", "n_dropped", "line_key", "kept_places", "kept_id", "kept_h", "kept_lines")
    entries = entries_of(docs, text)
    compared = entries.where((F.col("n_words") >= min_words) & ~F.col("clash"))
    groups = components(links(compared, docs, similarity, text))
    inside = entries.select("id", "o").join(groups, F.col("id") == F.col("node")).select("id", "component", "o")
    first = inside.groupBy("component").agg(F.min(F.struct("o", "id")).alias("keep"))
    lost = inside.join(first, "component").where(F.col("id") != F.col("keep.id")).select("id")
    kept = entries.where("not clash").join(lost, "id", "left_anti").groupBy("doc_id", "h").agg(F.collect_list("place").alias("kept_places"))
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("h").alias("kept_h"), "kept_places")
    docs = docs.withColumn("line_key", F.xxhash64(text))
    joined = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("line_key") == F.col("kept_h")), "left")
    clashes = entries.where("clash").select("id")
    return _only_kept(joined, text, None if clashes.isEmpty() else clashes)


def _only_kept(docs: DataFrame, text: str, clashes: DataFrame | None) -> DataFrame:
    """Texts without the lines outside kept_places; blank lines and those of ``clashes`` stay."""
    lines = F.split(text, "\n")
    places = F.coalesce("kept_places", F.array().cast("array<int>"))
    stay = lambda line, i: F.array_contains(places, i) | (F.size(words_of(plain(line))) == 0)
    if clashes is not None:
        # as one row: by the laws of chance a handful, even among a million million lines
        docs = docs.crossJoin(F.broadcast(clashes.agg(F.collect_set("id").alias("clashes"))))
        stays = lambda line, i: stay(line, i) | F.array_contains("clashes", F.xxhash64(words_of(plain(line))))
    else:
        stays = stay
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    out = docs.withColumn("n_lines", n).withColumn("kept_lines", F.filter(lines, stays))
    out = out.withColumn("n_dropped", F.col("n_lines") - F.when(F.col(text).isNull(), 0).otherwise(F.size("kept_lines")))
    return out.withColumn(text, F.array_join("kept_lines", "\n")).drop("kept_lines", "kept_id", "kept_h", "kept_places", "line_key", "clashes")
