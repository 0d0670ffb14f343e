"""Language-model scores of texts by a hierarchical Pitman-Yor model.

Words are drawn from restaurants, one for each context.  A context is the whole word
before; restaurants whose contexts end in the same two bytes share a parent, those whose
contexts end in the same byte share the next, these share the restaurant of single words, and
that one rests on equal probabilities for all known words and one unknown.  The restaurants
of whole words grow with the corpus, as do all counts by word and context: they stay dealt by
word, and what a restaurant has over all its words is added up where its context is dealt to
and sent to the buckets that hold a word of it.  The others have a fixed bound
(65,536 + 256 + 1), so the driver and the workers hold their totals in full.

Jobs: (1) count words by the word before over the training texts, summed on the map side
and dealt by the word's hash; (2) Gibbs sweeps: in the first all customers of a word
in a context sit down one by one, at a table in use or at a new one, whose dish
goes to the parent as a customer.  In each later sweep every customer by itself
gets up from its table, which is removed with its customer of the parent if it was
alone, and sits down given all others, however many they are; the parent then seats
what came or lets go what went, and moves each of its own customers likewise.  Words of other buckets
and of the same bucket are given as the totals of the sweep before have them,
and parents as they were when their children began;
(3) read all texts again, look words and pairs up in their buckets and add up log10 of
the predictive probabilities.  Those are averaged over the kept sweeps, level by level: what a pair has
of its own, what its context leaves to the parent, and the parent's probability.  The second is
added where the context is looked up as a word, since each token is the context of one; so a pair
never seen needs no row.  Words with more than 1/512 of the training tokens (512 at most) would make
some buckets large; what they have by the last two bytes is sent to all workers and looked up where the text is
read, with the pairs that are as frequent, and their other pairs are dealt by both words.

Discounts come from the counts of counts, as n1 / (n1 + 2 n2) on each level.

Defined results: a null or empty text is its end alone; a null doc_id is never
training; repeated rows are scored each (and counted each in training); an
empty training set gives known counts of 0 and the uniform model; extra columns are carried.
"""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import sheltered, texts_of, written
from tallymark.operators.stored import discard

#: Tokens that a task holds before it passes them on, and texts (they are numbered in 15 bits).
FLUSH, FLUSH_TEXTS, TEXT_BITS = 1_000_000, 30_000, 15
#: Words above this share of the training tokens are looked up on the map side.
FREQUENT = 1 / 512
#: Strength of each level (contexts, last bytes, words).
STRENGTH = 1.0
END = b"\n"
#: The last two bytes in a word's id.
CODE = 0xFFFF
#: Buckets of words for each partition of a shuffle: a task holds one at a time.
BUCKETS = 4
#: Rows of tokens that are looked up at a time.
ROWS = 16
#: Entries side by side under which customers move in a plain loop.
NARROW = 16


def is_training(key: str = "doc_id", parts: int = 10):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts != 0, F.lit(False))


class Tokens:
    """Tokens of some texts: distinct words, the place of each token's word among them, its context and text."""

    def __init__(self):
        self.place: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.of_text: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        words = text.encode().lower().split()
        words.append(END)
        self.of_text.append(np.fromiter(map(self.place.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def done(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words' ids (by place), word and context of each token (their places, one above the other), text of each token.

        An id is 48 bits of the word's hash above its last two bytes.
        """
        words = list(self.place)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)
        code = np.fromiter(((w[-2] << 8 | w[-1]) if len(w) > 1 else w[-1] for w in words), np.int64, len(words))
        code[self.place[END]] = 0  # what follows an end is a start
        sizes = np.array([len(t) for t in self.of_text])
        flat = np.concatenate(self.of_text)
        before = np.empty_like(flat)
        before[1:] = flat[:-1]
        before[np.cumsum(sizes) - sizes] = self.place[END]
        return hashes & ~CODE | code, flat << len(words).bit_length() | before, np.repeat(np.arange(len(sizes)), sizes)


def _bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return ((ids.view(np.uint64) >> np.uint64(16)) % np.uint64(n)).astype(np.int64)


def _home(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Where the restaurants of contexts are added up."""
    return _bucket(ids, buckets) % max(1, buckets // BUCKETS)


def _key(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    """One number for a word and the one before, by their ids."""
    z = word.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + before.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ z >> np.uint64(shift)) * np.uint64(factor)
    return (z ^ z >> np.uint64(31)).view(np.int64)


def _parts(of: np.ndarray) -> Iterator[np.ndarray]:
    """The places of each value, the least first."""
    order = np.argsort(of, kind="stable")
    return np.split(order, _runs(of[order])[1:]) if len(of) else iter(())


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """First place of each run of equal values."""
    return np.flatnonzero(_first(sorted_values)) if len(sorted_values) else np.empty(0, np.int64)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, none under 0, and the place of each key among them.

    Keys are sorted with their places in one number, which is several times as fast as to sort places by keys.
    """
    n, bits = len(keys), len(keys).bit_length()
    if not n or int(keys.max()) >> (63 - bits):
        return np.unique(keys, return_inverse=True)
    both = np.sort(keys << bits | np.arange(n))
    first = _first(both >> bits)
    at = np.empty(n, np.int64)
    at[both & ((1 << bits) - 1)] = np.cumsum(first) - 1
    return both[first] >> bits, at


def _first(sorted_values: np.ndarray) -> np.ndarray:
    """Whether a value is the first of its run."""
    return np.append(True, sorted_values[1:] != sorted_values[:-1])


def _falling(numbers: np.ndarray) -> np.ndarray:
    """The order of numbers, none under 0, from the greatest to the least, equal ones as they come; those of 16 bits in one pass over their digits."""
    if len(numbers) and numbers.max() < 1 << 16:
        return np.argsort((0xFFFF - numbers).astype(np.uint16), kind="stable")
    return np.argsort(-numbers, kind="stable")


def _row(table: pa.Table | pa.RecordBatch, name: str, i: int) -> np.ndarray:
    x = table.column(name)[i].values
    return x.to_numpy(zero_copy_only=False) if x is not None else np.empty(0, np.int64)


#: Words, the contexts of each, and their counts: as a flush has them, and merged, with ``ctx`` as places among ``ids``.
COUNTED = "bucket int, words array<bigint>, n_ctx array<int>, before array<bigint>, counts array<bigint>"
COUNTS = "bucket int, words array<bigint>, n_ctx array<int>, ids array<bigint>, ctx array<int>, counts array<bigint>"


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "double": pa.float64(), "float": pa.float32()}


def _arrow(schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string made of numbers and arrays of numbers."""

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else _ARROW[name]

    return pa.schema([(name, kind(t)) for name, t in (f.split() for f in schema.split(", "))])


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def count_words(train: DataFrame, buckets: int, text: str) -> DataFrame:
    """A row for each bucket of words: its words, the contexts of each and their counts."""

    def flush(tokens: Tokens, schema: pa.Schema) -> pa.RecordBatch:
        ids, pairs, _ = tokens.done()
        pair, n = np.unique(pairs, return_counts=True)
        bits = len(ids).bit_length()
        word, before = pair >> bits, ids[pair & (1 << bits) - 1]
        bucket, rows = _bucket(ids, buckets)[word], []
        for take in _parts(bucket):
            first = np.append(_runs(word[take]), len(take))
            rows.append((int(bucket[take[0]]), ids[word[take[first[:-1]]]], np.diff(first), before[take], n[take]))
        return _batch(schema, rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, tokens = _arrow(COUNTED), Tokens()
        for batch in batches:
            for t in texts_of(batch, text):
                tokens.add(t)
                if tokens.size >= FLUSH:
                    yield flush(tokens, schema)
                    tokens = Tokens()
        if tokens.size:
            yield flush(tokens, schema)

    def merge(table: pa.Table) -> pa.Table:
        whole = lambda c: np.concatenate([_row(table, c, i) for i in range(table.num_rows)])
        names, at = np.unique(whole("words"), return_inverse=True)
        ids, ctx = np.unique(whole("before"), return_inverse=True)
        bits = len(ids).bit_length()
        pair, of = _numbered(np.repeat(at, whole("n_ctx")) << bits | ctx)
        total = np.bincount(of, whole("counts"), len(pair)).astype(np.int64)
        row = (table.column("bucket")[0].as_py(), names, np.bincount(pair >> bits, minlength=len(names)), ids, pair & (1 << bits) - 1, total)
        return pa.Table.from_batches([_batch(_arrow(COUNTS), [row])])

    each = train.select(text).mapInArrow(read, COUNTED)
    return written(each.groupBy("bucket").applyInArrow(merge, COUNTS), "lm-counts")


# --- the model -------------------------------------------------------------------------------------------------


class Totals:
    """Tables and customers of every restaurant but those of whole words, discounts and the number of known words: of fixed size."""

    def __init__(self, n_words: int, n_tokens: int):
        self.n_words, self.n_tokens = n_words, n_tokens
        self.tables = [np.zeros(1 << 16), np.zeros(1 << 8), np.zeros(1)]
        self.customers = [np.zeros(1 << 16), np.zeros(1 << 8), np.zeros(1)]
        self.discounts = [0.5, 0.5, 0.5]
        self.whole = 0.5  # the discount of whole words

    def new_mass(self, level: int, ctx: np.ndarray) -> np.ndarray:
        return STRENGTH + self.discounts[level] * self.tables[level][ctx]

    def all_mass(self, level: int, ctx: np.ndarray) -> np.ndarray:
        return STRENGTH + self.customers[level][ctx]


class Seats:
    """Customers and tables of a set of words on the three levels of last bytes."""

    def __init__(self, words: np.ndarray, n_ctx: np.ndarray, ctx: np.ndarray, customers: np.ndarray):
        self.words = words
        self.pair = np.repeat(np.arange(len(words)), n_ctx) << 16 | ctx
        self.short, self.up = _numbered(self.pair >> 16 << 8 | self.pair & 0xFF)
        self.customers = [customers, None, None]
        self.tables = [np.ones(len(self.pair), np.int64), np.ones(len(self.short), np.int64), np.ones(len(words), np.int64)]
        self.sizes: list[np.ndarray] = []  # customers of each table, by level and entry; none before the first sweep
        self.made: list[np.ndarray] = []
        self.pass_up()

    def pass_up(self) -> None:
        """Each table is a customer of the parent."""
        self.customers[1] = np.bincount(self.up, self.tables[0], len(self.short)).astype(np.int64)
        self.customers[2] = np.bincount(self.short >> 8, self.tables[1], len(self.words)).astype(np.int64)

    def contexts(self) -> list[np.ndarray]:
        return [self.pair & 0xFFFF, self.short & 0xFF, np.zeros(len(self.words), np.int64)]

    def sweep(self, t: Totals, rng: np.random.Generator) -> None:
        """Move every customer, given the other words' seating in the totals; the first time, seat all."""
        ctx, old = self.contexts(), self.tables
        above = [self.above(t, level, ctx, rng) for level in range(3)]  # parents as they were when their children sit down
        for level in range(3):
            others = STRENGTH + t.discounts[level] * (t.tables[level][ctx[level]] - old[level])
            sizes = self.sizes[level] if self.sizes else None
            tables, made = seat_all(self.customers[level], others, *above[level], t.discounts[level], rng, old[level], sizes)
            self.tables = [*self.tables[:level], tables, *self.tables[level + 1 :]]
            self.made.append(made)
            if level < 2:
                at, n = (self.up, len(self.short)) if level == 0 else (self.short >> 8, len(self.words))
                self.customers[level + 1] = np.bincount(at, tables, n).astype(np.int64)
        self.sizes, self.made = self.made, []

    def above(self, t: Totals, level: int, ctx: list[np.ndarray], rng: np.random.Generator, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The parent's probability of each entry's word, and the same with one customer less there (an entry's table just left).

        For entries below the first level (-1), ``of`` has the parent of each.
        """
        if level == 2:
            p = np.full(len(self.words), 1 / (t.n_words + 1))
            return p, p
        of = of if level < 0 else self.up if level == 0 else self.short >> 8
        p, less = self.above(t, level + 1, ctx, rng)
        k, d = level + 1, t.discounts[level + 1]
        full = self.at(t, k, ctx[k], p)
        c, tables = self.customers[k], self.tables[k]
        single = rng.random(len(c)) * c < self.singles(k)  # who gets up sat alone: its table goes too
        own = c - 1 - d * (tables - single)
        new = STRENGTH + d * (t.tables[k][ctx[k]] - single)
        lower = (np.maximum(own, 0) + new * np.where(single, less, p)) / (t.all_mass(k, ctx[k]) - 1)
        return full[of], lower[of]

    def singles(self, level: int) -> np.ndarray:
        """Tables of one customer, by entry."""
        if not self.sizes:
            return (self.customers[level] == 1).astype(np.int64)
        tables = self.tables[level]
        return np.bincount(np.repeat(np.arange(len(tables)), tables), self.sizes[level] == 1, len(tables))

    def at(self, t: Totals, level: int, ctx: np.ndarray, above: np.ndarray) -> np.ndarray:
        own = self.customers[level] - t.discounts[level] * self.tables[level]
        return (own + t.new_mass(level, ctx) * above) / t.all_mass(level, ctx)

    def find(self, words: np.ndarray) -> np.ndarray:
        """Place of each word, or -1."""
        return _find(self.words, words)

    def probability(self, t: Totals, word: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """Predictive probability of words (by place; -1: unknown) in contexts."""
        p = np.full(len(word), 1 / (t.n_words + 1))
        for level, key, names in (
            (2, word, None),
            (1, np.where(word >= 0, word << 8 | ctx & 0xFF, -1), self.short),
            (0, np.where(word >= 0, word << 16 | ctx, -1), self.pair),
        ):
            at = key if names is None else _find(names, key)
            c = (0 * ctx, ctx & 0xFF, ctx)[2 - level]
            own = self.customers[level] - t.discounts[level] * self.tables[level]
            own = np.where(at >= 0, own[np.maximum(at, 0)], 0.0) if len(own) else np.zeros(len(at))
            p = (own + t.new_mass(level, c) * p) / t.all_mass(level, c)
        return p


class Pairs:
    """Customers and tables of a set of words in the restaurants of whole words, and ``below`` them those of last bytes."""

    def __init__(self, words: np.ndarray, n_ctx: np.ndarray, ids: np.ndarray, ctx: np.ndarray, counts: np.ndarray, tables: np.ndarray | None = None):
        self.words, self.ids, self.ctx, self.customers = words, ids, ctx, counts
        self.word = np.repeat(np.arange(len(words)), n_ctx)
        pair, self.up = _numbered(self.word << 16 | ids[ctx] & CODE)
        self.tables = np.ones(len(ctx), np.int64) if tables is None else tables
        self.sizes: np.ndarray | None = None
        self.below = Seats(words, np.bincount(pair >> 16, minlength=len(words)), pair & CODE, self.passed())

    def passed(self) -> np.ndarray:
        """Each table is a customer of the parent."""
        return np.bincount(self.up, self.tables, int(self.up.max(initial=-1)) + 1).astype(np.int64)

    def sums(self) -> np.ndarray:
        """These words' tables in the restaurant of each of ``ids``."""
        return np.bincount(self.ctx, self.tables, len(self.ids)).astype(np.int64)

    def sweep(self, t: Totals, tables: np.ndarray, rng: np.random.Generator) -> None:
        """As ``Seats.sweep``, of all levels; ``tables`` has those of all words in the restaurant of each of ``ids``."""
        above = self.below.above(t, -1, self.below.contexts(), rng, self.up)
        others = STRENGTH + t.whole * (tables[self.ctx] - self.tables)
        self.tables, self.sizes = seat_all(self.customers, others, *above, t.whole, rng, self.tables, self.sizes)
        self.below.customers[0] = self.passed()
        self.below.sweep(t, rng)


def _find(names: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(names):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return np.where(names[at] == keys, at, -1)


def _kept(tables: np.ndarray, sizes: np.ndarray, customers: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table of each customer who stays (by entry), and the tables and their sizes.

    The customers of an entry are in random order: the next sweep takes them in that order, which must not follow the tables.
    Where there are too many, the last ones go.
    """
    entry = np.repeat(np.arange(len(tables)), tables)
    seats, at = np.repeat(np.arange(len(sizes)), sizes), np.repeat(entry, sizes)
    before = np.bincount(entry, sizes, len(tables)).astype(np.int64)
    mixed = np.flatnonzero((tables[at] > 1) & (before[at] > 2))  # two customers, or those of one table, are alike
    seats[mixed] = seats[mixed[np.argsort(at[mixed] << 32 | rng.integers(1 << 32, size=len(mixed)))]]
    if (before > customers).any():
        stay = np.arange(len(at)) - (np.cumsum(before) - before)[at] < customers[at]
        seats = seats[stay]
        sizes = np.bincount(seats, minlength=len(sizes))
        seats = (np.cumsum(sizes > 0) - 1)[seats]
        entry, sizes = entry[sizes > 0], sizes[sizes > 0]
    tables = np.bincount(entry, minlength=len(tables))
    return seats - np.repeat(np.cumsum(tables) - tables, np.minimum(before, customers)), tables, sizes


def seat_all(customers, others, above, less, discount, rng, tables, sizes):
    """``seat``, where an entry of one customer has one table without a draw: whoever is alone opens one."""
    many = customers > 1
    kept = None if sizes is None else sizes[np.repeat(many, tables)]
    t, n = seat(customers[many], others[many], above[many], less[many], discount, rng, tables[many], kept)
    out = np.ones(len(customers), np.int64)
    out[many] = t
    made = np.ones(int(out.sum()), np.int64)
    made[np.repeat(many, out)] = n
    return out, made


def seat(customers, others, above, less, discount, rng, tables=None, sizes=None):
    """Tables of each entry and customers of each table after every customer moved, or sat down for the first time.

    ``customers`` are those of each entry, of whom those in ``sizes`` (of each table, ``tables`` of an entry) are
    seated.  Each of them gets up and sits down at a table of n others with mass n - discount, or at a new one with
    mass (others + discount * tables) * above, where ``others`` is what the restaurant has besides the entry's tables,
    and ``less`` stands for ``above`` if the table left is gone.  Then the rest sit down.  One customer
    of each entry moves at a time; entries are apart, so their steps are taken side by side.
    """
    if sizes is None:
        tables, sizes = np.zeros(len(customers), np.int64), np.empty(0, np.int64)
    place, tables, sizes = _kept(tables, sizes, customers, rng)
    seated = np.bincount(np.repeat(np.arange(len(customers)), tables), sizes, len(customers)).astype(np.int64)
    first = np.cumsum(customers) - customers
    z, n, gone = (np.zeros(int(customers.sum()), np.int32) for _ in range(3))  # table of each customer, customers of each table, tables without any
    z[np.repeat(first - (np.cumsum(seated) - seated), seated) + np.arange(len(place))] = place
    n[np.repeat(first - (np.cumsum(tables) - tables), tables) + np.arange(len(sizes))] = sizes
    order = _falling(customers)
    c, m, start, t, full, left, base = (x[order] for x in (customers, seated, first, tables.astype(np.int64), above, less, others))
    used, n_gone, falling, i = t.copy(), np.zeros(len(c), np.int64), -c, 0
    while (k := int(np.searchsorted(falling, -i, "left"))) >= NARROW:  # entries with a customer of number i
        at, here = start[:k] + i, i < m[:k]
        up = at[here]
        table = start[:k][here] + z[up]
        n[table] -= 1
        empty = np.flatnonzero(here)[n[table] == 0]
        gone[start[empty] + n_gone[empty]] = z[at[empty]]
        n_gone[empty] += 1
        t[empty] -= 1
        there = np.where(here, m[:k] - 1, i)
        p = full[:k].copy()
        p[empty] = left[empty]
        new = (base[:k] + discount * t[:k]) * p
        opens = rng.random(k) * (new + there - discount * t[:k]) < new
        opens |= there == 0
        who = np.flatnonzero(opens)
        again = n_gone[who] > 0
        n_gone[who[again]] -= 1
        slot = np.where(again, gone[start[who] + n_gone[who]], used[who])
        used[who] += ~again
        n[start[who] + slot], z[at[who]] = 1, slot
        t[who] += 1
        who = np.flatnonzero(~opens)
        while len(who):  # the table of any other customer, refused with discount / n, so n - discount in all
            j = (rng.random(len(who)) * there[who]).astype(np.int64)
            j += here[who] & (j >= i)
            slot = z[start[who] + j]
            fine = rng.random(len(who)) * n[start[who] + slot] >= discount
            took = who[fine]
            n[start[took] + slot[fine]] += 1
            z[at[took]] = slot[fine]
            who = who[~fine]
        i += 1
    draw = random.Random(int(rng.integers(1 << 62))).random
    for e in range(k):
        a, size = int(start[e]), int(c[e])
        zs, ns, free = z[a : a + size].tolist(), n[a : a + int(used[e])].tolist(), gone[a : a + int(n_gone[e])].tolist()
        t[e] = _seat_rest(i, int(m[e]), zs, ns, free, int(t[e]), float(base[e]), float(full[e]), float(left[e]), discount, draw)
        n[a : a + len(ns)] = ns
    filled = n > 0
    out = np.empty_like(t)
    out[order] = t
    return out, n[filled].astype(np.int64)


def _seat_rest(i: int, m: int, z: list[int], n: list[int], free: list[int], t: int, base: float, full: float, left: float, d: float, draw) -> int:
    """The steps of ``seat`` for one entry from its customer i on; z, n and free are changed in place."""
    for i in range(i, len(z)):
        p, there = full, i
        if i < m:
            there, s = m - 1, z[i]
            n[s] -= 1
            if not n[s]:
                t -= 1
                free.append(s)
                p = left
        new = (base + d * t) * p
        if not there or draw() * (new + there - d * t) < new:
            if free:
                s = free.pop()
                n[s] = 1
            else:
                s = len(n)
                n.append(1)
            t += 1
        else:
            while True:
                j = int(draw() * there)
                s = z[j + 1 if j >= i else j]  # j is under i where i was not seated
                if draw() * n[s] >= d:
                    break
            n[s] += 1
        z[i] = s
    return t


LEVELS = ("", "0", "1", "2")  # whole words, last two bytes, last byte, none
SUMS = "level int, ctx int, tables double, customers double, ones double, twos double"
#: The seats of a bucket: its tables by context (``sums``, in the order of its ids), by restaurant of last bytes (``level`` and ``at``), and each.
STATE = "bucket int, sweep int, sums array<int>, level array<int>, at array<int>, seen array<int>, " + ", ".join(f"tables{k} array<int>, sizes{k} array<int>" for k in LEVELS)


def _pairs(table, i: int, tables: str | None = None) -> Pairs:
    """The words of a row; ``tables`` has the names of the columns with their tables, for each of ``LEVELS``."""
    columns = (_row(table, c, i) for c in ("words", "n_ctx", "ids", "ctx", "counts"))
    out = Pairs(*columns, tables=None if tables is None else _row(table, tables, i).astype(np.int64))
    if tables is not None:
        out.below.tables = [_row(table, f"{tables}{k}", i).astype(np.int64) for k in LEVELS[1:]]
        out.below.pass_up()
    return out


def _first_totals(counts: DataFrame, totals: Totals) -> Totals:
    """With a table for each entry: sums of tables and customers by restaurant of last bytes, and discounts.

    At most 65,794 rows come to the driver, one of them for whole words.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(SUMS)
        for batch in batches:
            for i in range(batch.num_rows):
                pairs = _pairs(batch, i)
                s = pairs.below
                levels = [(-1, np.zeros(len(pairs.ctx), np.int64), pairs.customers, pairs.tables)]
                levels += [(level, ctx, s.customers[level], s.tables[level]) for level, ctx in enumerate(s.contexts())]
                for level, ctx, c, t in levels:
                    at = np.flatnonzero(np.bincount(ctx))
                    add = lambda x: np.bincount(ctx, x)[at]  # noqa: B023, E731
                    columns = [np.full(len(at), level), at, add(t), add(c), add(c == 1), add(c == 2)]
                    yield pa.RecordBatch.from_arrays([pa.array(x).cast(f.type) for x, f in zip(columns, schema)], schema=schema)

    new = Totals(totals.n_words, totals.n_tokens)
    rows = counts.mapInArrow(sums, SUMS).groupBy("level", "ctx").agg(*[F.sum(c).alias(c) for c in ("tables", "customers", "ones", "twos")]).collect()
    counted = np.zeros((4, 2))  # the last for whole words
    for r in rows:
        if r.level >= 0:
            new.tables[r.level][r.ctx], new.customers[r.level][r.ctx] = r.tables, r.customers
        counted[r.level] += (r.ones, r.twos)
    d = [float(np.clip(a / (a + 2 * b), 0.1, 0.9)) if a else 0.5 for a, b in counted]
    new.discounts, new.whole = d[:3], d[3]
    return new


def _totals(state: DataFrame, before: Totals) -> Totals:
    """Sums of tables and customers by restaurant of last bytes; at most 65,793 rows come to the driver."""
    new = Totals(before.n_words, before.n_tokens)
    new.discounts, new.whole = before.discounts, before.whole
    each = state.select(F.explode(F.arrays_zip("level", "at", "seen")).alias("x")).select("x.*")
    for r in each.groupBy("level", "at").agg(F.sum("seen").alias("seen")).collect():
        (new.tables if r.level < 3 else new.customers)[r.level % 3][r["at"]] = r.seen
    return new


#: Tables of whole words' restaurants for a bucket: from each home those that it asked for; with home -1 those of its own words as contexts.
WHOLE = "bucket int, home int, tables array<bigint>"


def _whole(counts: DataFrame, state: DataFrame | None, buckets: int) -> DataFrame:
    """Add up the tables of each restaurant of whole words at its home, which some buckets share, and send them to where it has words.

    A bucket gives and gets them in the order of ``_home``, then of its ids.
    """

    sent, seated = "home int, bucket int, ids array<bigint>, sums array<bigint>", state is not None

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(sent)
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, ids = batch.column("bucket")[i].as_py(), _row(batch, "ids", i)
                sums = _row(batch, "sums", i) if seated else np.bincount(_row(batch, "ctx", i), minlength=len(ids))
                home = _home(ids, buckets)
                yield _batch(schema, [(int(home[at[0]]), bucket, ids[at], sums[at]) for at in _parts(home)])

    def add(rows: pa.Table) -> pa.Table:
        ids = [_row(rows, "ids", i) for i in range(rows.num_rows)]
        names, at = np.unique(np.concatenate(ids), return_inverse=True)
        total = np.bincount(at, np.concatenate([_row(rows, "sums", i) for i in range(rows.num_rows)])).astype(np.int64)
        home, to, own = rows.column("home")[0].as_py(), rows.column("bucket").to_pylist(), _bucket(names, buckets)
        back = np.split(total[at], np.cumsum([len(x) for x in ids])[:-1])
        out = [(int(own[at[0]]), -1, total[at]) for at in _parts(own)] + [(b, home, x) for b, x in zip(to, back)]
        return pa.Table.from_batches([_batch(_arrow(WHOLE), out)])

    given = counts.select("bucket", "ids").join(state.select("bucket", "sums"), "bucket") if seated else counts.select("bucket", "ids", "ctx")
    asked = given.mapInArrow(up, sent)
    return written(asked.groupBy("home").applyInArrow(add, WHOLE), "lm-whole")


def _received(whole: pa.Table, ids: np.ndarray, buckets: int, sweep: int | None = None) -> np.ndarray:
    """The tables of the restaurant of each of a bucket's ids."""
    home = whole.column("home").to_pylist()
    rows = [i for i in range(len(home)) if home[i] >= 0 and (sweep is None or whole.column("sweep")[i].as_py() == sweep)]
    out = np.empty(len(ids), np.int64)
    out[np.argsort(_home(ids, buckets), kind="stable")] = np.concatenate([_row(whole, "tables", i) for i in sorted(rows, key=home.__getitem__)])
    return out


def _sweep(model: DataFrame, whole: DataFrame, with_state: bool, totals: Totals, number: int, seed: int, buckets: int) -> DataFrame:
    def run(rows: pa.Table, tables: pa.Table) -> pa.Table:
        p, bucket = _pairs(rows, 0, "tables" if with_state else None), rows.column("bucket")[0].as_py()
        if with_state:
            p.sizes = _row(rows, "sizes", 0).astype(np.int64)
            p.below.sizes = [_row(rows, f"sizes{k}", 0).astype(np.int64) for k in LEVELS[1:]]
        p.sweep(totals, _received(tables, p.ids, buckets), np.random.default_rng([seed, number, bucket]))  # a lost task seats as before
        s = p.below
        seats = zip([p.tables, *s.tables], [p.sizes, *s.sizes])
        seen = [np.bincount(ctx, x) for numbers in (s.tables, s.customers) for ctx, x in zip(s.contexts(), numbers)]  # levels 3 to 5 are customers
        at = [np.flatnonzero(x) for x in seen]
        own = (np.repeat(np.arange(6), [len(x) for x in at]), np.concatenate(at), np.concatenate([x[i] for x, i in zip(seen, at)]))
        return pa.Table.from_batches([_batch(_arrow(STATE), [(bucket, number, p.sums(), *own, *(x for pair in seats for x in pair))])])

    model = model.select(*[c for c in model.columns if c not in ("sums", "level", "at", "seen")])
    return written(model.groupBy("bucket").cogroup(whole.where("home >= 0").groupBy("bucket")).applyInArrow(run, STATE), "lm-seats")


class Model:
    """What scores need of each bucket's words (``KNOWN``), and the totals of the kept sweeps."""

    def __init__(self, known: DataFrame, kept: list[Totals], buckets: int, totals: Totals):
        self.known, self.kept, self.buckets, self.totals = known, kept, buckets, totals

    def least(self) -> float:
        return max(2, self.totals.n_tokens * FREQUENT)


def _known_schema(kept: int) -> str:
    """A row for each bucket: its words, how often each occurs, log10 of what it leaves to the parent as a context, their last-byte
    contexts with customers and tables in each kept sweep, and pairs with log10 of what they add to the parent.

    Further rows, without words, have pairs of frequent words; those in bucket -1 are as frequent themselves.
    """
    seats = "".join(f", customers{i} array<bigint>" + "".join(f", s{i}_{k} array<int>" for k in range(3)) for i in range(kept))
    return "bucket int, words array<bigint>, n array<bigint>, back array<double>, n_ctx array<int>, ctx array<int>, keys array<bigint>, gains array<float>" + seats


def _known(counts: DataFrame, kept: list[tuple[DataFrame, DataFrame, Totals]], buckets: int, least: float) -> DataFrame:
    """``kept`` has the state, the tables of whole words and the totals of each kept sweep."""
    totals, model, whole = [t for _, _, t in kept], counts, None
    for i, (state, tables, _) in enumerate(kept):
        model = model.join(state.select("bucket", *[F.col(f"tables{k}").alias(f"seated{i}{k}") for k in LEVELS]), "bucket")
        tables = tables.withColumn("sweep", F.lit(i))
        whole = tables if whole is None else whole.unionByName(tables)
    schema = _known_schema(len(kept))

    def run(rows: pa.Table, tables: pa.Table) -> pa.Table:
        sweeps = [_pairs(rows, 0, f"seated{i}") for i in range(len(totals))]
        p, d, mean = sweeps[0], totals[0].whole, lambda x: sum(x) / len(totals)
        n = np.bincount(p.word, p.customers, len(p.words)).astype(np.int64)
        own = [_row(tables, "tables", i) for i, home in enumerate(tables.column("home").to_pylist()) if home < 0]
        back = np.log10((STRENGTH + d * mean(own)) / (STRENGTH + n))  # each token is the context of one
        s = p.below
        parent = mean([x.below.probability(t, s.pair >> 16, s.pair & CODE) for x, t in zip(sweeps, totals)])[p.up]
        new = STRENGTH + d * mean([_received(tables, p.ids, buckets, i) for i in range(len(totals))])[p.ctx]
        gains = np.log10(1 + (p.customers - d * mean([x.tables for x in sweeps])) / (new * parent)).astype(np.float32)
        keys = _key(p.words[p.word], p.ids[p.ctx])
        cold = n[p.word] < least
        seats = [c for x in sweeps for c in (x.below.customers[0], *x.below.tables)]
        bucket = rows.column("bucket")[0].as_py()
        out = [(bucket, p.words, n, back, np.bincount(s.pair >> 16, minlength=len(p.words)), s.pair & CODE, keys[cold], gains[cold], *seats)]
        hot = np.flatnonzero(~cold)
        to = np.where(p.customers[hot] < least, _bucket(keys[hot], buckets), -1)
        out += [(int(to[at[0]]), *[()] * 5, keys[hot[at]], gains[hot[at]], *[()] * len(seats)) for at in _parts(to)]
        return pa.Table.from_batches([_batch(_arrow(schema), out)])

    return written(model.groupBy("bucket").cogroup(whole.groupBy("bucket")).applyInArrow(run, schema), "lm-known")


def learn(train: DataFrame, text: str = "text", sweeps: int = 3, keep: int = 2, seed: int = 11, buckets: int | None = None) -> Model:
    """Count and run Gibbs sweeps; the last ``keep`` are averaged."""
    buckets = buckets or BUCKETS * int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = count_words(train, buckets, text)
    n = counts.select(F.sum(F.size("words")).alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()
    start = Totals(int(n.v or 0), int(n.n or 0))
    totals, whole = _first_totals(counts, start), _whole(counts, None, buckets)
    model, kept, first = counts, [], whole
    for number in range(sweeps):
        state = _sweep(model, whole, number > 0, totals, number, seed, buckets)
        model = counts.join(state, "bucket")
        totals, whole = _totals(state, totals), _whole(counts, state, buckets)
        kept.append((state, whole, totals))
        if len(kept) > keep:
            discard(*kept.pop(0)[:2])
    out = Model(counts, [t for _, _, t in kept], buckets, totals)
    out.known = _known(counts, kept, buckets, out.least())
    discard(counts, first, *[x for state, whole, _ in kept for x in (state, whole)])
    return out


class Scorer:
    """Predictive probabilities after last bytes averaged over sweeps, what words leave to parents as contexts, counts and base terms."""

    def __init__(self, seats: list[Seats], totals: list[Totals], n: np.ndarray, back: np.ndarray):
        self.seats, self.totals, self.n, self.back = seats, totals, n, back
        self.size = totals[0].n_tokens + 0.1 * (totals[0].n_words + 1)

    def __call__(self, words: np.ndarray, n_ctx: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of the probability, as it is for pairs never seen, and of the base term, and whether known, for each word in each of its contexts."""
        place = self.seats[0].find(words)
        each = np.repeat(place, n_ctx)
        p = sum(s.probability(t, each, ctx & CODE) for s, t in zip(self.seats, self.totals)) / len(self.seats)
        known = lambda x: np.where(place >= 0, x[np.maximum(place, 0)], 0.0) if len(x) else np.zeros(len(place))
        n = known(self.n)
        return np.log10(p) + np.repeat(known(self.back), n_ctx), np.repeat(np.log10((n + 0.1) / self.size), n_ctx), np.repeat(n > 0, n_ctx)


def _scorer(table, i: int, totals: list[Totals]) -> Scorer:
    seats = []
    for k in range(len(totals)):
        s = Seats(_row(table, "words", i), _row(table, "n_ctx", i), _row(table, "ctx", i).astype(np.int64), _row(table, f"customers{k}", i))
        s.tables = [_row(table, f"s{k}_{level}", i).astype(np.int64) for level in range(3)]
        s.pass_up()
        seats.append(s)
    return Scorer(seats, totals, _row(table, "n", i), _row(table, "back", i))


class Gains:
    """What pairs add to the parent, by their keys."""

    def __init__(self, table, rows: list[int]):
        keys = np.concatenate([np.empty(0, np.int64), *[_row(table, "keys", i) for i in rows]])
        order = np.argsort(keys)
        self.keys, self.gains = keys[order], np.concatenate([np.empty(0, np.float32), *[_row(table, "gains", i) for i in rows]])[order]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """log10 of it, 0 for pairs that are not here."""
        at = _find(self.keys, keys)
        return np.where(at >= 0, self.gains[np.maximum(at, 0)], 0).astype(float) if len(self.keys) else np.zeros(len(keys))


def _part(s: Seats, words: np.ndarray) -> Seats:
    """The seating of some of the words (by place, in order)."""
    out = object.__new__(Seats)
    new = np.full(len(s.words), -1)
    new[words] = np.arange(len(words))
    a, b = new[s.pair >> 16] >= 0, new[s.short >> 8] >= 0
    out.words = s.words[words]
    out.pair = new[s.pair[a] >> 16] << 16 | s.pair[a] & 0xFFFF
    out.short = new[s.short[b] >> 8] << 8 | s.short[b] & 0xFF
    out.up = None
    out.customers = [s.customers[0][a], s.customers[1][b], s.customers[2][words]]
    out.tables = [s.tables[0][a], s.tables[1][b], s.tables[2][words]]
    return out


def _frequent(model: Model) -> Scorer | None:
    """The words above FREQUENT (1 / FREQUENT at most), with their seating."""
    totals, least = model.kept, model.least()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, back = _row(batch, "n", i), _row(batch, "back", i)
                hot = np.flatnonzero(n >= least)
                if len(hot):
                    parts = [[x.words, x.pair, x.short, *x.customers, *x.tables] for x in (_part(x, hot) for x in _scorer(batch, i, totals).seats)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], kind) for x, kind in ((parts, pa.list_(pa.list_(pa.list_(pa.int64())))), (n[hot], pa.list_(pa.int64())), (back[hot], pa.list_(pa.float64())))],
                        names=["parts", "n", "back"],
                    )

    known = model.known.where((F.size("words") > 0) & (F.array_max("n") >= least)).drop("keys", "gains")
    got = known.mapInArrow(pick, "parts array<array<array<bigint>>>, n array<bigint>, back array<double>").collect()
    rows = [r.parts for r in got]
    if not rows:
        return None
    seats = []
    for k in range(len(totals)):
        columns = [[np.array(x, np.int64) for x in r[k]] for r in rows]
        sizes = np.cumsum([0, *[len(c[0]) for c in columns]])
        s = object.__new__(Seats)
        words = np.concatenate([c[0] for c in columns])
        place = np.empty(len(words), np.int64)  # words must be in order over all buckets
        place[np.argsort(words)] = np.arange(len(words))
        pair = np.concatenate([place[(c[1] >> 16) + n] << 16 | c[1] & 0xFFFF for c, n in zip(columns, sizes)])
        short = np.concatenate([place[(c[2] >> 8) + n] << 8 | c[2] & 0xFF for c, n in zip(columns, sizes)])
        orders = [np.argsort(pair), np.argsort(short), np.argsort(words)]
        s.words, s.pair, s.short, s.up = words[orders[2]], pair[orders[0]], short[orders[1]], None
        s.customers = [np.concatenate([c[3 + level] for c in columns])[orders[level]] for level in range(3)]
        s.tables = [np.concatenate([c[6 + level] for c in columns])[orders[level]] for level in range(3)]
        seats.append(s)
    n, back = (np.concatenate([np.array(r[c], kind) for r in got])[orders[2]] for c, kind in (("n", np.int64), ("back", float)))
    return Scorer(seats, totals, n, back)


def _frequent_pairs(model: Model) -> Gains:
    """The pairs above FREQUENT (1 / FREQUENT at most)."""
    table = pa.Table.from_pylist([r.asDict() for r in model.known.where("bucket = -1").select("keys", "gains").collect()], _arrow("keys array<bigint>, gains array<float>"))
    return Gains(table, list(range(table.num_rows)))


#: Tokens to look up at a home (>= 0), without words the keys of pairs as ``ctx``; or what is known of a flush's texts already (< 0).
ASKED = (
    "home int, flush bigint, words array<bigint>, n_ctx array<int>, ctx array<bigint>, n_occ array<int>, texts array<smallint>, "
    "rows array<bigint>, sizes array<bigint>, score array<double>, base array<double>, known array<bigint>"
)
#: The part that one home adds to the texts of a flush; ``rows`` and ``sizes`` only from the flush itself.
PARTS = "flush bigint, texts array<smallint>, rows array<bigint>, sizes array<bigint>, score array<double>, base array<double>, known array<bigint>"
SCORED = "row bigint, n_tokens bigint, score double, base_score double, n_known bigint"


@sheltered
def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score and score of whole texts.

    ``docs`` is read twice with its rows numbered by their place, so that equal rows stay apart:
    it must be a table as read, or written first.
    """
    frequent, frequent_pairs, buckets, totals = _frequent(model), _frequent_pairs(model), model.buckets, model.kept
    numbered = docs.withColumn("lm_row", F.monotonically_increasing_id())
    names = [c for c in docs.columns if c != text]

    def flush(tokens: Tokens, rows: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        ids, pairs, of = tokens.done()
        bits, names = len(ids).bit_length(), None
        if 2 * bits + TEXT_BITS > 63:
            names, pairs = _numbered(pairs)
        both = np.sort(pairs << TEXT_BITS | of)  # of texts in order
        pairs, of = both >> TEXT_BITS, both & ((1 << TEXT_BITS) - 1)
        first = _runs(pairs)
        pair, occ = pairs[first], np.diff(np.append(first, len(pairs)))
        pair = pair if names is None else names[pair]
        word, before = pair >> bits, ids[pair & (1 << bits) - 1]
        out, cold = [], np.ones(len(pair), bool)
        sums = [np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows))]
        name, none = int(rows[0]), ((),) * 5  # a row is in one flush only

        def ask(home: np.ndarray, keep: np.ndarray, keys: np.ndarray | None = None) -> None:
            for part in _parts(home):
                take = keep[part]
                start = np.append(_runs(word[take]), len(take))
                n = occ[take]
                places = np.repeat(first[take] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                what = (ids[word[take[start[:-1]]]], np.diff(start), before[take]) if keys is None else ((), (), keys[part])
                out.append((int(home[part[0]]), name, *what, n, of[places].astype(np.int16), *none))

        if frequent is not None:
            cold = frequent.seats[0].find(ids)[word] < 0
            hot = np.flatnonzero(~cold)
            if len(hot):
                at = np.repeat(~cold, occ)
                got = frequent(ids[word[hot]], np.ones(len(hot), np.int64), before[hot])
                keys = _key(ids[word[hot]], before[hot])
                seen = _find(frequent_pairs.keys, keys) >= 0
                sums = [np.bincount(of[at], np.repeat(x, occ[hot]), len(rows)) for x in (got[0] + frequent_pairs(keys), *got[1:])]
                ask(_home(keys[~seen], buckets), hot[~seen], keys[~seen])
        sizes = [len(t) for t in tokens.of_text]
        out.append((-1 - name % buckets, name, *none, rows, sizes, sums[0], sums[1], sums[2].astype(np.int64)))
        keep = np.flatnonzero(cold)
        ask(_home(ids, buckets)[word[keep]], keep)
        return _batch(schema, out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, tokens, rows = _arrow(ASKED), Tokens(), []
        for batch in batches:
            for t, r in zip(texts_of(batch, text), batch.column(batch.schema.get_field_index("lm_row")).to_pylist()):
                tokens.add(t)
                rows.append(r)
                if tokens.size >= FLUSH or len(rows) >= FLUSH_TEXTS:
                    yield flush(tokens, np.array(rows), schema)
                    tokens, rows = Tokens(), []
        if rows:
            yield flush(tokens, np.array(rows), schema)

    def look_up(asked: pa.Table, known: pa.Table) -> pa.Table:
        schema, out, names = _arrow(PARTS), [], asked.column("flush").to_pylist()
        scorers = {known.column("bucket")[i].as_py(): _scorer(known, i, totals) for i in range(known.num_rows) if len(_row(known, "words", i))}
        none = Scorer([_none()] * len(totals), totals, np.empty(0), np.empty(0))
        gains, by_kind = Gains(known, list(range(known.num_rows))), ([], [])
        for i, home in enumerate(asked.column("home").to_pylist()):
            if home < 0:
                out.append((names[i], (), *(_row(asked, c, i) for c in ("rows", "sizes", "score", "base", "known"))))
            else:
                by_kind[len(_row(asked, "words", i)) > 0].append(i)
        for rows in (kind[a : a + ROWS] for kind in by_kind for a in range(0, len(kind), ROWS)):
            words, n_ctx, ctx, n, texts = (np.concatenate([_row(asked, c, i) for i in rows]) for c in ("words", "n_ctx", "ctx", "n_occ", "texts"))
            got = [gains(_key(np.repeat(words, n_ctx), ctx) if len(words) else ctx), np.zeros(len(ctx)), np.zeros(len(ctx))]
            bucket = _bucket(words, buckets)
            for part in _parts(bucket):
                at = np.flatnonzero(np.repeat(bucket == bucket[part[0]], n_ctx))
                for total, x in zip(got, scorers.get(int(bucket[part[0]]), none)(words[part], n_ctx[part], ctx[at])):
                    total[at] += x
            row = np.repeat(np.arange(len(rows)), [len(_row(asked, "texts", i)) for i in rows])
            at, of = _numbered(row << TEXT_BITS | texts)
            sums = [np.bincount(of, np.repeat(x, n), len(at)) for x in got]
            cuts = np.searchsorted(at, np.arange(1, len(rows)) << TEXT_BITS)
            for i, t, s, b, k in zip(rows, *(np.split(x, cuts) for x in (at & (1 << TEXT_BITS) - 1, *sums))):
                out.append((names[i], t, (), (), s, b, k.astype(np.int64)))
        return pa.Table.from_batches([_batch(schema, out)])

    def add_up(parts: pa.Table) -> pa.Table:
        """The sums of all texts of a flush (``FLUSH_TEXTS`` at most)."""
        own = next(i for i in range(parts.num_rows) if len(_row(parts, "rows", i)))
        rows = _row(parts, "rows", own)
        sums = [_row(parts, c, own).copy() for c in ("score", "base", "known")]
        for i in range(parts.num_rows):
            if i != own:
                texts = _row(parts, "texts", i)  # distinct in a part
                for total, c in zip(sums, ("score", "base", "known")):
                    total[texts] += _row(parts, c, i)
        columns = [rows, _row(parts, "sizes", own), *sums]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _arrow(SCORED))], schema=_arrow(SCORED))

    asked = numbered.select("lm_row", text).mapInArrow(read, ASKED)
    known = model.known.where("bucket >= 0").withColumn("home", F.col("bucket") % max(1, buckets // BUCKETS))
    parts = asked.groupBy("home").cogroup(known.groupBy("home")).applyInArrow(look_up, PARTS)
    summed = parts.groupBy("flush").applyInArrow(add_up, SCORED)
    out = numbered.select("lm_row", *names).join(summed, F.col("lm_row") == F.col("row"))
    out = out.withColumn("train_tokens", F.lit(model.totals.n_tokens).cast("long"))
    return out.select(*names, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _none() -> Seats:
    empty = np.empty(0, np.int64)
    return Seats(empty, empty, empty, empty)
