"""Byte-level BPE encoding and decoding from a rank file.

Each match of the split pattern is encoded on its own.  Its bytes are mapped to
Latin-1 so that an automaton over the vocabulary gives the longest token that
starts at a byte.  The encoder walks from longest matches, asking for those of the
bytes that it comes to, and steps back where two neighbours could not stand side by
side in the output of the merges; whether they could is a memoised property of
the pair alone, found by undoing the merges of both.  Each position is given up at most once, so the walk is linear
in the piece's length and gives exactly the tokens of the merge rules.

Defined results: a null or empty text has no tokens and decodes to no bytes;
repeated rows give repeated results; ids outside the vocabulary raise.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm.common import add_columns, texts_of

#: Entries kept in each memo of a worker (some 200 bytes each; an executor runs a worker for each core, and idle ones keep theirs), that of pieces may be given another size.
MEMO = 150_000
#: The rank of a pair that does not merge.
NONE = 1 << 40


class _Memo(dict):
    """A bounded dict that computes what it lacks; entries not asked for in the last half of its size are the ones it loses."""

    def __init__(self, make, size: int | None = None):
        super().__init__()
        self.make, self.size, self.before = make, size or MEMO, {}

    def __missing__(self, key):
        value = self.before.get(key, self)
        if value is self:
            value = self.make(key)
        if len(self) >= self.size // 2:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class BytePairCodec:
    """Encoder and decoder for one rank file (lines of base64 token and rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.most = max(map(len, self.bytes_of), default=0)
        self.vocabulary = pa.array(self.bytes_of, pa.large_binary())
        self.length = [len(t) for t in self.bytes_of]
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        #: The longest other token that begins this one, or -1.
        self.shorter = _Memo(self._shorter, min(memo, MEMO))
        #: The two tokens whose merge made this one; none for a single byte, None where merges in the order of ranks do not lead to it.
        self.halves = _Memo(self._halves, MEMO)
        self.fits = _Memo(self._fits, min(memo, MEMO))
        #: The ids of a piece, as the bytes of an array of int.
        self.pieces = _Memo(lambda piece: array("i", self.encode_bytes(piece.encode())).tobytes(), memo)

    def _shorter(self, token: int) -> int:
        whole = self.bytes_of[token]
        return next((r for n in range(len(whole) - 1, 0, -1) if (r := self.ranks.get(whole[:n])) is not None), -1)

    def merged(self, data: bytes, least: int = 1) -> list[int]:
        """The merge rules as they are defined, down to ``least`` tokens; used on the few bytes of a token or a pair."""
        parts, get = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        ranks = [get(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while len(parts) > least and ranks and (best := min(ranks)) < NONE:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], NONE)
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], NONE)
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, ...] | None:
        whole = self.bytes_of[token]
        if len(whole) < 2:
            return ()
        parts = self.merged(whole, 2)
        return tuple(parts) if len(parts) == 2 and max(parts) < token and None not in (self.halves[parts[0]], self.halves[parts[1]]) else None

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether the merges of both tokens side by side give the two again.

        The merges that made them are undone from the last to the first, on whichever side came later; the pair stands
        if at no time the two parts that met would have merged before that.  Tokens that meet can only merge
        if they are the halves of what they give.
        """
        ranks, bytes_of, halves = self.ranks, self.bytes_of, self.halves
        left, right = pair
        before = NONE  # merges under this come first
        while True:
            both = ranks.get(bytes_of[left] + bytes_of[right])
            if both is not None and both < before and halves[both] == (left, right):
                return False
            a, b = halves[left], halves[right]
            if a is None or b is None or (both is not None and halves[both] is None):  # ranks that are no order of merges
                return self.merged(bytes_of[pair[0]] + bytes_of[pair[1]]) == [*pair]
            # of equal merges, the one on the left comes first, so the right one is undone first
            if a and (left > right or not b):
                before, left = left, a[1]
            elif b:
                before, right = right + 1, b[0]
            else:
                return True

    def longest(self, piece: bytes, at: int) -> int:
        """The longest token that starts at a byte of the piece, or -1; the walk comes to a byte once at most."""
        n, get = self.automaton.longest_prefix(piece[at : at + self.most].decode("latin-1")), self.ranks.get
        while n and (token := get(piece[at : at + n])) is None:
            n -= 1  # some token goes on from here, but none ends here
        return token if n else -1

    def encode_bytes(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n, length, shorter, fits, longest = len(piece), self.length, self.shorter, self.fits, self.longest
        out: list[int] = []
        dead = bytearray(n + 1)  # positions from which no way leads to the end
        at, token = 0, longest(piece, 0)
        while at < n:
            while token >= 0:
                end = at + length[token]
                if not dead[end] and (not out or fits[out[-1], token]):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest(piece, at)
            elif out:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
            else:
                raise ValueError("a byte of the text is missing in the vocabulary")
        return tuple(out)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.split(text))), np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of consecutive stretches of ids, as one array: all tokens are laid out one after the other, and the stretches are cut from them."""
        if len(ids) and ids.min() < 0:
            raise IndexError("an id outside the vocabulary")
        tokens = self.vocabulary.take(pa.array(ids))
        cuts = np.frombuffer(tokens.buffers()[1], np.int64, len(ids) + 1)[ends] if len(ids) else np.zeros(len(ends), np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), tokens.buffers()[2]])


@lru_cache(2)
def codec(path: str, pattern: str, memo: int = MEMO) -> BytePairCodec:
    """The codec of a rank file, built once in each worker."""
    with open(path, "rb") as lines:
        return BytePairCodec({base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}, pattern, memo)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", memo: int = MEMO) -> DataFrame:
    """Add the token ids of ``text`` as an array of int; a worker keeps ``memo`` pieces."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        return [_ids(codec(path, pattern, memo), texts_of(batch, text))]

    return add_columns(df, [T.StructField(out, T.ArrayType(T.IntegerType()), False)], make)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the token ids in ``ids`` stand for; a null list decodes to no bytes."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        return [_decoded(codec(path, pattern), batch.column(batch.schema.get_field_index(ids)))]

    return add_columns(df, [T.StructField(out, T.BinaryType(), False)], make)


def round_trip(
    df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded", memo: int = MEMO, drop: tuple[str, ...] = ()
) -> DataFrame:
    """``encode`` and then ``decode`` in one pass: a task has one worker and that one codec, where two passes have two workers with memos each."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        c = codec(path, pattern, memo)
        found = _ids(c, texts_of(batch, text))
        return [found, _decoded(c, found)]

    return add_columns(df, [T.StructField(ids, T.ArrayType(T.IntegerType()), False), T.StructField(out, T.BinaryType(), False)], make, drop)


def _ids(c: BytePairCodec, texts: list[str]) -> pa.ListArray:
    each = [c.encode(t) for t in texts]
    ends = np.cumsum([0, *map(len, each)], dtype=np.int32)
    flat = np.concatenate(each) if each else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _decoded(c: BytePairCodec, column: pa.ListArray) -> pa.Array:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    if column.null_count:
        flat, ends = _without_nulls(column)
    return c.decode_all(flat[ends[0] : ends[-1]], ends - ends[0]).cast(pa.binary())


def _without_nulls(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and ends of lists of which null ones are empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *sizes])


def digests(ids: str = "ids", decoded: str = "decoded") -> list:
    """The contract's columns from an encoded and decoded table."""
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col(ids).cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    ]
