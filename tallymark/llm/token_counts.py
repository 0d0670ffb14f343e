"""Token counts by a finite-state transducer compiled from a BPE model.

The tokens of a growing text change only near its end.  Reading one more
character, the last token of the new prefix is the one suffix piece that can
follow the last token of the prefix before it, and the number of tokens of the
new prefix follows from the number there.  All of this depends on a short
window alone: the longest suffix that begins a piece, the last token at each of
its positions and the counts there relative to the newest.  These windows are
the states of a deterministic transducer; a transition carries the number of
tokens that it adds (which may be negative, as when a merge takes back two).
States and transitions are made when first met and shared by all texts of a
worker.

A text is cut into chunks.  A chunk's state map sends any entry state to an
exit state and a count.  No piece holds a space after another character, so
from the first such place on, a chunk's exit state does not depend on the entry:
a map is the chunk's head (up to there), the count of the rest and its exit
state.  Maps compose associatively, and a text's count is their product over a
balanced tree, so chunks can be mapped in any order and at the same time.  Here one task
does so for a text, chunk by chunk; texts are what Spark deals.  A worker keeps the counts
of whole words between two spaces that it met, so most words cost one look-up instead of a
walk over transitions; a chunk without a space is one head.  The model's normaliser is
taken to be the identity.

Defined results: a null or empty text has no tokens; characters without a piece
count as one token for each of their bytes, as the library's byte fallback does;
repeated rows get equal counts; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallymark.llm.bpe import _Memo
from tallymark.llm.common import add_columns, texts_of

SPACE = "▁"
#: Characters of one chunk.
CHUNK = 1 << 15
#: A word with the spaces before it: what lies between two places where the state is known.
UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: States kept by a worker before it starts anew.
STATES = 300_000
#: Entries in each memo of a worker; there is one worker for each core here, and no second stage.
MEMO = 600_000


#: The score of a pair that does not merge.
NONE = -1e30


class State:
    """A window; equal windows are one object in a worker, with the transitions met so far."""

    __slots__ = ("node", "last", "count", "to")

    def __init__(self, node: str, last: tuple, count: tuple):
        self.node = node  # the longest suffix of the text that begins a longer piece
        self.last = last  # the last token at each position of node; None where the run starts
        self.count = count  # tokens up to there, less those up to the newest position
        self.to: dict[str, tuple[State, int]] = {}


class ChunkMap(NamedTuple):
    head: str  # read from the entry state
    count: int  # tokens of what follows the head
    exit: State | None  # state after it; None where the chunk is all head


class Transducer:
    def __init__(self, score: dict[str, float]):
        self.score = score
        self.open = {p[:n] for p in score for n in range(len(p))}  # what a longer piece begins with
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in score):
            raise ValueError("a piece runs over a space; texts cannot be split there")
        self.fits = _Memo(self._fits, MEMO)
        self.root = State("", (None,), (0,))
        self.states: dict[tuple, State] = {}
        self.units = _Memo(lambda unit: self.run(self.root, unit)[1], MEMO)

    def merged(self, text: str) -> list[str]:
        """The merge rules as they are defined; used on the few characters of a pair."""
        parts, get = list(text), self.score.get
        scores = [get(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > NONE:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at], NONE)
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1], NONE)
        return parts

    def _fits(self, pair: tuple[str, str]) -> bool:
        return self.merged(pair[0] + pair[1]) == [*pair]

    def step(self, state: State, char: str) -> tuple[State, int]:
        if char not in self.score:
            return self.root, len(char.encode())
        if char == SPACE and not state.node.endswith(SPACE):
            state = self.root  # no piece reaches over the start of a run of spaces
        node, last, count = state.node + char, state.last, state.count
        for start in range(len(node)):  # the longest piece first
            piece = node[start:]
            if piece in self.score and (last[start] is None or self.fits[last[start], piece]):
                added = count[start] + 1
                break
        cut = next(i for i in range(len(node) + 1) if node[i:] in self.open)
        kept = [node[i:] in self.open for i in range(cut, len(node))]  # where a piece may still begin
        key = (
            node[cut:],
            (*(t if k else "" for t, k in zip(last[cut:], kept)), piece),
            (*(c - added if k else 0 for c, k in zip(count[cut:], kept)), 0),
        )
        to = self.states.get(key)
        if to is None:
            if len(self.states) >= STATES:  # forget the transitions; states in hand stay valid
                self.states.clear()
                self.root.to.clear()
            to = self.states[key] = State(*key)
        return to, added

    def run(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for char in text:
            step = state.to.get(char)
            if step is None:
                step = self.step(state, char)
                state.to[char] = step
            state = step[0]
            total += step[1]
        return state, total

    def chunk_map(self, chunk: str) -> ChunkMap:
        units = UNITS.findall(chunk)
        if len(units) < 2:
            return ChunkMap(chunk, 0, None)
        exit_, tail = self.run(self.root, units[-1])
        return ChunkMap(units[0], sum(map(self.units.__getitem__, units[1:-1])) + tail, exit_)

    def after(self, first: ChunkMap, then: ChunkMap) -> ChunkMap:
        """The map of two neighbouring chunks, in this order."""
        if first.exit is None:
            return ChunkMap(first.head + then.head, then.count, then.exit)
        state, count = self.run(first.exit, then.head)
        if then.exit is None:
            return ChunkMap(first.head, first.count + count, state)
        return ChunkMap(first.head, first.count + count + then.count, then.exit)

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        maps = [self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.after(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        whole = maps[0]
        return self.run(self.root, whole.head)[1] + whole.count


@lru_cache(2)
def transducer(path: str) -> Transducer:
    """The transducer of a SentencePiece BPE model with byte fallback, made once in each worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        i
        for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    return Transducer({model.id_to_piece(i): model.get_score(i) for i in plain})


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 4096, chunk: int = CHUNK) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of whole texts."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        count = transducer(path).count
        texts = texts_of(batch, text)
        tokens = np.fromiter((count(t, chunk) for t in texts), np.int64, len(texts))
        return [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens), pa.array(tokens > limit)]

    fields = [
        T.StructField("n_bytes", T.LongType(), False),
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("over_limit", T.BooleanType(), False),
    ]
    return add_columns(df, fields, make)
