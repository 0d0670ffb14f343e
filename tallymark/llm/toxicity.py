"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels mark documents, the field tags tokens.  Token labels come from a cover of
the toxic documents: word features (the word, its beginnings of 3 to 6
characters) that clean documents hardly hold are taken greedily, the one that
explains most documents not explained yet first, so that words which merely
stand in many copies of one toxic document are not taken.  Tokens of toxic
documents with a taken feature are labelled toxic, all others clean.

The field has two tags, one weight for each feature and a table of transitions.
It is fitted by gradient steps over windows of the sampled documents, with
forward-backward for the expected counts.  Scoring runs forward-backward over
the whole of each text; a document's score is a logistic function of the
log-odds of its most toxic token, fitted on the sampled labels; runs of
tokens whose marginal is at least one half are its spans.

The fit reads a sample of at most ``toxic_rows`` and ``clean_rows`` labelled
rows, by the order of a hash of doc_id, in the driver.  Of each sampled text, the cover
and the calibration read all tokens; the gradient steps read at most
``windows_per_text`` windows of ``WINDOW`` tokens around likely words and one at random.
Weights are kept for at most ``max_features`` features.  These bounds concern the fit
alone and hold at every size of the input.

Defined results: a null or empty text has the score of a text without toxic
tokens and no spans; a table without labels gives every text the score 0 and no
spans; repeated rows get equal scores; texts of any length are read to the end.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm.bpe import _Memo
from tallymark.llm.common import add_columns, texts_of

WORD = re.compile(r"\w+")
#: Tokens of a training window.
WINDOW = 24


@dataclass(frozen=True)
class Settings:
    toxic_rows: int = 2000
    clean_rows: int = 3000
    max_features: int = 50_000
    prefixes: tuple[int, ...] = (3, 4, 5, 6)
    windows_per_text: int = 3
    steps: int = 120
    rate: float = 0.15
    l2: float = 0.002
    #: A feature may stand in this share of clean documents, against its share of toxic ones.
    leak: float = 0.02


@dataclass
class Field:
    """A fitted model; small, so it goes to the workers with the task."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -50.0
    #: Log potentials of (clean, clean), (clean, toxic), (toxic, clean), (toxic, toxic).
    moves: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    slope: float = 1.0
    shift: float = 0.0
    prefixes: tuple[int, ...] = (3, 4, 5, 6)

    def __post_init__(self):
        self.odds = _Memo(self._odds)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "odds"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.__post_init__()

    def _odds(self, word: str) -> float:
        total = self.bias + sum(self.weights.get(f, 0.0) for f in features(word, self.prefixes))
        return math.exp(max(-60.0, min(60.0, total)))

    def marginals(self, words: list[str]) -> list[float]:
        """The probability of the toxic tag at each token, by forward-backward in odds."""
        stay, enter, leave, hold = (math.exp(m) for m in self.moves)
        odds = list(map(self.odds.__getitem__, words))
        ahead, back, r = [], 1.0, None
        for o in odds:
            r = o if r is None else o * (enter + hold * r) / (stay + leave * r)
            ahead.append(r)
        for i in range(len(odds) - 1, -1, -1):
            both = ahead[i] * back
            ahead[i] = both / (1.0 + both)
            x = odds[i] * back
            back = (leave + hold * x) / (stay + enter * x)
        return ahead

    def score(self, top: float) -> float:
        top = min(max(top, 1e-12), 1 - 1e-12)
        z = self.slope * math.log(top / (1 - top)) + self.shift
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

    def document(self, text: str) -> tuple[float, list[dict]]:
        p = self.marginals(words(text))
        top = max(p, default=0.0)
        return self.score(top), self.spans(text, p) if top >= 0.5 else []

    def spans(self, text: str, p: list[float]) -> list[dict]:
        found: list[dict] = []
        joined = False
        for x, m in zip(p, WORD.finditer(text)):
            if x >= 0.5 and joined:
                found[-1] |= {"end": m.end(), "p": max(found[-1]["p"], x)}
            elif x >= 0.5:
                found.append({"start": m.start(), "end": m.end(), "p": x})
            joined = x >= 0.5
        return found


def words(text: str) -> list[str]:
    """Words in lower case, one for each match in the text as it is: a few capitals grow in lower case."""
    return [w.lower() for w in WORD.findall(text)]


def features(word: str, prefixes: tuple[int, ...]) -> list[str]:
    return [*(word[:n] for n in prefixes if len(word) >= n), "=" + word]


def sample(docs: DataFrame, labels: DataFrame, s: Settings, text: str = "text") -> list[tuple[str, int]]:
    """The bounded sample of (text, label): the first rows of each class by a hash of doc_id."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    order = F.xxhash64("doc_id"), F.col("doc_id")
    toxic = ids.where("toxic = 1").orderBy(*order).limit(s.toxic_rows)
    clean = ids.where("toxic = 0").orderBy(*order).limit(s.clean_rows)
    chosen = toxic.unionByName(clean).dropDuplicates(["doc_id"])  # at most toxic_rows + clean_rows small rows
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").where("text is not null")
    got = rows.dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").collect()
    return [(r.text, int(r.toxic)) for r in sorted(got, key=lambda r: r.doc_id)]


def _cover(sets: list[np.ndarray], y: np.ndarray, n_features: int, s: Settings) -> np.ndarray:
    """Features (by number) that explain the toxic documents, by greedy cover."""
    n = np.maximum(1, [(y == 0).sum(), (y == 1).sum()])
    empty = [np.empty(0, np.int32)]
    clean, toxic = (np.bincount(np.concatenate([f for f, k in zip(sets, y) if k == v] or empty), minlength=n_features) for v in (0, 1))
    least = max(2, round(0.005 * n[1]))
    fine = (toxic >= least) & (clean / n[0] <= s.leak * toxic / n[1])
    left = [f[fine[f]] for f, k in zip(sets, y) if k]
    counts = np.bincount(np.concatenate(left or empty), minlength=n_features)
    taken = []
    while len(counts) and counts.max() >= least:
        best = int(counts.argmax())  # the first of equals: a shorter beginning stands before longer ones
        taken.append(best)
        covered = [f for f in left if best in f]
        counts -= np.bincount(np.concatenate(covered), minlength=n_features)
        left = [f for f in left if best not in f]
    return np.array(taken, np.int64)


def fit(rows: list[tuple[str, int]], s: Settings = Settings()) -> Field:
    """Fit the field and its calibration to a sample of (text, label)."""
    if len({y for _, y in rows}) < 2:
        return Field(prefixes=s.prefixes)
    rng = np.random.default_rng(7)
    labels = np.array([k for _, k in rows])
    place: defaultdict[str, int] = defaultdict(count().__next__)
    number: defaultdict[str, int] = defaultdict(count().__next__)
    texts = [np.fromiter(map(place.__getitem__, words(t)), np.int32) for t, _ in rows]
    names = list(place)
    of_word = [[number[f] for f in features(w, s.prefixes)] for w in names]
    flat = np.fromiter(chain.from_iterable(of_word), np.int32)
    starts = np.cumsum([0, *map(len, of_word)])
    sets = []
    for ws in texts:
        used = np.unique(ws)
        sets.append(np.unique(np.concatenate([flat[starts[w] : starts[w + 1]] for w in used])) if len(used) else np.empty(0, np.int32))
    taken = np.zeros(len(number), bool)
    taken[_cover(sets, labels, len(number), s)] = True
    del sets
    hot = np.array([taken[fs].any() for fs in of_word], bool)
    near_starts = {names[i][:3] for i in np.flatnonzero(hot)}
    near = np.array([w[:3] in near_starts for w in names], bool)
    windows: list[tuple[list[str], list[int]]] = []
    for ws, k in zip(texts, labels):
        if not len(ws):
            continue
        marks = np.flatnonzero((hot if k else near)[ws])
        for c in [*rng.permutation(marks)[: s.windows_per_text], rng.integers(len(ws))]:
            part = ws[max(0, int(c) - WINDOW // 2) :][:WINDOW]
            windows.append(([names[w] for w in part], [int(k and hot[w]) for w in part]))
    of = {w: features(w, s.prefixes) for w in {w for part, _ in windows for w in part}}
    vocab = {w: i for i, w in enumerate(dict.fromkeys(w for part, _ in windows for w in part))}
    seen = Counter(f for w in vocab for f in of[w])
    kept = [f for f, _ in seen.most_common(s.max_features)]
    index = {f: i for i, f in enumerate(kept)}
    pairs = [(vocab[w], index[f]) for w in vocab for f in of[w] if f in index]
    pair_word, pair_feature = (np.array(x, np.int64) for x in zip(*pairs))

    n = len(windows)
    x = np.zeros((n, WINDOW), np.int64)
    y = np.zeros((n, WINDOW))
    mask = np.zeros((n, WINDOW), bool)
    for i, (part, tags) in enumerate(windows):
        x[i, : len(part)] = [vocab[w] for w in part]
        y[i, : len(part)] = tags
        mask[i, : len(part)] = True
    both = mask[:, 1:]
    seen_moves = np.array([[(both & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)

    w, bias, moves = np.zeros(len(kept)), -3.0, np.zeros((2, 2))
    size = len(kept) + 5
    m1, m2 = np.zeros(size), np.zeros(size)
    for step in range(1, s.steps + 1):
        unary = bias + np.bincount(pair_word, w[pair_feature], len(vocab))
        p, expected = _expectations(np.where(mask, unary[x], 0.0), moves, mask)
        miss = np.where(mask, p - y, 0.0)
        by_word = np.bincount(x.ravel(), miss.ravel(), len(vocab))
        g = np.concatenate(
            [
                np.bincount(pair_feature, by_word[pair_word], len(kept)) / n + s.l2 * w,
                [miss.sum() / n],
                ((expected - seen_moves) / n + s.l2 * moves).ravel(),
            ]
        )
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = s.rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, bias, moves = w - move[: len(kept)], bias - move[len(kept)], moves - move[-4:].reshape(2, 2)
    model = Field({f: float(v) for f, v in zip(kept, w) if abs(v) > 1e-4}, float(bias), tuple(map(float, moves.ravel())), prefixes=s.prefixes)
    tops = np.array([max(model.marginals([names[w] for w in ws]), default=1e-12) for ws in texts])
    model.slope, model.shift = _calibrate(tops, labels.astype(float))
    return model


def _expectations(unary: np.ndarray, moves: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Toxic-tag marginals and expected transition counts of padded windows, by scaled forward-backward."""
    n, length = unary.shape
    local = np.stack([np.ones_like(unary), np.exp(np.clip(unary, -50, 50))], 2)
    move = np.exp(moves)
    ahead, back = np.empty((n, length, 2)), np.ones((n, length, 2))
    ahead[:, 0] = local[:, 0] / local[:, 0].sum(1, keepdims=True)
    for t in range(1, length):
        new = (ahead[:, t - 1] @ move) * local[:, t]
        ahead[:, t] = np.where(mask[:, t, None], new / new.sum(1, keepdims=True), ahead[:, t - 1])
    for t in range(length - 2, -1, -1):
        new = (local[:, t + 1] * back[:, t + 1]) @ move.T
        back[:, t] = np.where(mask[:, t + 1, None], new / new.sum(1, keepdims=True), back[:, t + 1])
    both = ahead * back
    p = both[..., 1] / both.sum(2)
    pair = ahead[:, :-1, :, None] * move * (local * back)[:, 1:, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return p, (pair * mask[:, 1:, None, None]).sum((0, 1))


def _calibrate(top: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic function from a token's log-odds to a document's score."""
    top = np.clip(top, 1e-12, 1 - 1e-12)
    z = np.log(top / (1 - top))
    scale = max(1.0, float(np.abs(z).max()) / 8)
    z = z / scale
    slope, shift = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -50, 50)))
        g = np.array([((p - y) * z).mean() + 1e-3 * slope, (p - y).mean()])
        v = p * (1 - p) + 1e-4
        h = np.array([[(v * z * z).mean() + 1e-3, (v * z).mean()], [(v * z).mean(), v.mean()]])
        move = np.linalg.solve(h, g)
        slope, shift = slope - float(np.clip(move[0], -1, 1)), shift - float(np.clip(move[1], -1, 1))
        if np.abs(move).max() < 1e-6:
            break
    return max(0.05, slope) / scale, shift


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))


def tag(df: DataFrame, model: Field, text: str = "text", score: str = "score", spans: str = "spans") -> DataFrame:
    """Add the document score (0 to 1) and the toxic spans (character offsets, highest marginal) of whole texts."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        done = [model.document(t) for t in texts_of(batch, text)]
        return [pa.array([d[0] for d in done], pa.float64()), pa.array([d[1] for d in done], SPANS)]

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())])
    return add_columns(df, [T.StructField(score, T.DoubleType(), False), T.StructField(spans, T.ArrayType(span), False)], make)


def held_out(key: str = "doc_id", parts: int = 5):
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts == 0


def learn(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), text: str = "text") -> Field:
    """Fit to the labels that are not held out."""
    return fit(sample(docs, labels.where(~held_out()), s, text), s)
