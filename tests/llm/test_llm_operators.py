"""Training-data operators against brute force, exact round trips, held-out accuracy and hard rows."""

import base64
import functools
import hashlib
import itertools
import math
import operator
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tallymark.llm import bpe, license_scan, line_dedup, lm_score, media, mixing, near_dups, queries, token_counts, topk, toxicity
from tallymark.llm.graph import components
from tallymark.llm.queries import BPE_PATH, PIECES_PATH

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [None, "", " ", "a", "  a  b   c", "aaaa" * 300, "\n\n x", "<s> hi </s><0x0A>", "日本語 漢字", "▁▁ x▁y", "a\u0000b", "🙂🙂  🙂", "=" * 80, "word " * 3000, "Ünïcode WÖRDS"]


def docs(spark, texts, source=None):
    rows = [(i, t, "en", source(i) if source else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def hard(spark):
    return docs(spark, HARD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 ---


def test_bpe_is_the_library_s(spark, hard):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE_PATH, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    both = bpe.decode(bpe.encode(hard.withColumn("ids", F.lit(1)), BPE_PATH, P.PATTERN), BPE_PATH, P.PATTERN)
    for r in both.collect():
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_bpe_on_random_bytes_of_few_letters():
    c, rng = bpe.codec(BPE_PATH, P.PATTERN), random.Random(5)
    for _ in range(300):
        piece = "".join(rng.choice("ethans é") for _ in range(rng.randint(1, 40))).encode()
        if piece not in c.ranks:
            assert list(c.encode_bytes(piece)) == c.merged(piece)


def test_pairs_of_tokens_stand_as_the_merges_say():
    """Small vocabularies of two letters, whatever their order of ranks; and no merges are made for a pair of a trained one."""
    in_order = 0
    for seed in range(200):
        rng, ranks = random.Random(seed), {b"a": 0, b"b": 1}
        while len(ranks) < 14:
            ranks.setdefault(rng.choice([*ranks]) + rng.choice([*ranks]), len(ranks))
        c = bpe.BytePairCodec(ranks, P.PATTERN, 1000)
        in_order += all(c.halves[t] is not None for t in range(14))
        for pair in itertools.product(range(14), repeat=2):
            assert c.fits[pair] == (c.merged(c.bytes_of[pair[0]] + c.bytes_of[pair[1]]) == [*pair]), (seed, pair)
    assert 0 < in_order < 200
    c = bpe.codec(BPE_PATH, P.PATTERN)
    for t in range(len(c.bytes_of)):
        c.halves[t]
    c.merged = None
    rng = random.Random(7)
    assert {c._fits((rng.randrange(20_000), rng.randrange(20_000))) for _ in range(3000)} == {True, False}
    del c.merged


def test_decoded_lists_with_nulls_among_them_and_cut_ones(spark):
    df = spark.createDataFrame([(1, [72, 73]), (2, None), (3, []), (4, [50000, 72])], "doc_id long, ids array<int>")
    c = bpe.codec(BPE_PATH, P.PATTERN)
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(df.coalesce(1), BPE_PATH, P.PATTERN).collect()}
    assert got == {1: c.decode([72, 73]), 2: b"", 3: b"", 4: c.decode([50000, 72])}
    flat = np.array([72, 73, 50000], np.int32)
    assert c.decode_all(flat[1:], np.array([0, 0, 2])).to_pylist() == [b"", c.decode([73, 50000])]


def test_memo_is_bounded_and_keeps_what_is_asked_for_often():
    made = Counter()
    memo = bpe._Memo(lambda key: made.update([key]) or -key, 100)
    for i in range(1, 5000):
        assert (memo[i], memo[0]) == (-i, 0)
        assert len(memo) + len(memo.before) <= 101
    assert made[0] == 1


def test_bpe_with_memos_of_a_given_size(spark):
    df = docs(spark, ["some words, and some more words 123", ""])
    small, large = (bpe.encode(df, BPE_PATH, P.PATTERN, memo=n).orderBy("doc_id").collect() for n in (4, 300_000))
    assert small == large and bpe.codec(BPE_PATH, P.PATTERN, 4).pieces.size == 4


def test_round_trip_is_encode_and_decode_with_one_worker_a_task(spark, hard, monkeypatch):
    """Two passes had two workers a task, each with a codec and memos, which idle workers keep through the next stages."""
    two = bpe.decode(bpe.encode(hard, BPE_PATH, P.PATTERN), BPE_PATH, P.PATTERN)
    one = bpe.round_trip(hard, BPE_PATH, P.PATTERN)
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert bpe.round_trip(hard, BPE_PATH, P.PATTERN, drop=("text",)).columns == [c for c in two.columns if c != "text"]
    passes = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    monkeypatch.setattr(queries, "documents", lambda *_: hard)
    assert passes(two) == 2 and passes(queries.op1_byte_bpe(spark, "")) == passes(corpus_pipeline.encode(spark, hard, "")) == 1


def test_bpe_of_nothing(empty):
    assert bpe.decode(bpe.encode(empty, BPE_PATH, P.PATTERN), BPE_PATH, P.PATTERN).collect() == []


# --- 2 ---


def test_lm_score_counts_and_base(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("the of a cat dog ran Sat x1 longword".split()) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    df = docs(spark, [*texts, None, "", "unseen words here", "the cat"])
    scored = lm_score.score(df, lm_score.learn(df.where(lm_score.is_training()))).collect()
    tokens = {i: (re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + ["\n"]) for i, t in enumerate([r.text for r in df.orderBy("doc_id").collect()])}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    count = Counter(w for i in train for w in tokens[i])
    n, v = sum(count.values()), len(count)
    assert len(scored) == len(tokens)
    for r in scored:
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in count for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r.score < 0
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 10 == 0]
    assert sum(r.score for r in held) > 1.2 * sum(r.base_score for r in held)


def test_lm_probabilities_add_up_to_one():
    words = np.arange(5, dtype=np.int64)
    s = lm_score.Seats(words, np.array([2, 1, 1, 1, 2]), np.array([65, 66, 65, 66, 0, 65, 321]), np.array([5, 1, 40, 2, 1, 3, 9]))
    t = lm_score.Totals(5, 61)
    for level, ctx in enumerate(s.contexts()):
        np.add.at(t.customers[level], ctx, s.customers[level])
        np.add.at(t.tables[level], ctx, s.tables[level])
    s.sweep(t, np.random.default_rng(1))
    for level in range(3):
        assert (s.tables[level] >= 1).all() and (s.tables[level] <= s.customers[level]).all()
        t.customers[level][:], t.tables[level][:] = 0, 0
        np.add.at(t.customers[level], s.contexts()[level], s.customers[level])
        np.add.at(t.tables[level], s.contexts()[level], s.tables[level])
    for ctx in (65, 66, 0, 321, 9999):
        p = s.probability(t, np.array([0, 1, 2, 3, 4, -1]), np.full(6, ctx))
        assert p.sum() == pytest.approx(1.0)


@pytest.mark.parametrize("narrow", [1, 10**9])
def test_seating_has_the_distribution_of_the_model(monkeypatch, narrow):
    """Entries of 40 customers, moved one by one, have t tables with the probability of a Pitman-Yor restaurant whose other tables are fixed."""
    monkeypatch.setattr(lm_score, "NARROW", narrow)
    c, others, p, d, lanes = 40, 3.0, 0.3, 0.4, 1500
    ways = np.zeros(c + 1)  # of seating the customers so far at t tables
    ways[1] = others * p
    for n in range(1, c):
        t = np.arange(c + 1)
        more = np.zeros(c + 1)
        more[1:] = ways[:-1] * (others + d * t[:-1]) * p
        ways = ways * np.maximum(n - d * t, 0) + more
        ways /= ways.sum()
    rng = np.random.default_rng(5)
    full = lambda x: np.full(lanes, x)
    tables, sizes = lm_score.seat(np.full(lanes, c), full(others), full(p), full(p), d, rng)
    for _ in range(50):
        tables, sizes = lm_score.seat(np.full(lanes, c), full(others), full(p), full(p), d, rng, tables, sizes)
        assert (np.add.reduceat(sizes, np.cumsum(tables) - tables) == c).all()
    want = ways @ np.arange(c + 1)
    assert abs(tables.mean() - want) < 5 * tables.std() / lanes**0.5
    assert np.abs(np.bincount(tables, minlength=c + 1) / lanes - ways).sum() < 0.2
    fewer, sizes = lm_score.seat(np.full(lanes, 20), full(others), full(p), full(p), d, rng, tables, sizes)
    assert (np.add.reduceat(sizes, np.cumsum(fewer) - fewer) == 20).all() and fewer.mean() < tables.mean()


def test_lm_numbers_and_orders_by_plain_sorts(monkeypatch):
    """As ``np.unique`` and a stable ``argsort`` have it, which were most of the sorting time and are left for wide keys alone."""
    rng = np.random.default_rng(4)
    keys = [rng.integers(0, top, n) for top in (1, 50, 1 << 40, 1 << 62) for n in (0, 1, 2, 999)]
    want = [(np.unique(k, return_inverse=True), np.argsort(-k, kind="stable")) for k in keys]
    for k, ((names, at), order) in zip(keys, want):
        got = lm_score._numbered(k)
        assert (got[0] == names).all() and (got[1] == at).all() and (lm_score._falling(k) == order).all()
    monkeypatch.setattr(np, "unique", None)
    for k in (k for k in keys if len(k) and k.max() < 1 << 40):
        lm_score._numbered(k)
    assert lm_score.FLUSH_TEXTS <= 1 << lm_score.TEXT_BITS


def test_lm_without_training_rows(spark, empty):
    df = docs(spark, ["a b"])
    row = lm_score.score(df, lm_score.learn(empty)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.score == pytest.approx(0.0)


def _after(model, unknown):
    """log10 of the probability of each known word, and of any unknown one (0), after each word, from a model's stored rows."""
    table = model.known.toArrow()
    main = [i for i in range(table.num_rows) if len(lm_score._row(table, "words", i))]
    gains, out, back = lm_score.Gains(table, list(range(table.num_rows))), {}, dict.fromkeys(unknown, 0.0)
    scorers = [lm_score._scorer(table, i, model.kept) for i in main]
    for s in scorers:
        back |= dict(zip(s.seats[0].words.tolist(), s.back.tolist()))
    befores = np.array(sorted(back))
    for s in scorers:
        for word in s.seats[0].words:
            got = s(np.array([word]), np.array([len(befores)]), befores)[0] + gains(lm_score._key(np.repeat(word, len(befores)), befores))
            out |= {(int(word), int(b)): x - back[int(word)] + back[int(b)] for b, x in zip(befores, got)}
    none = scorers[0](np.array([0]), np.array([len(befores)]), befores)[0]
    return out | {(0, int(b)): x + back[int(b)] for b, x in zip(befores, none)}


LM_WORDS = "the of nation version station cat at dog x1 longword".split()


@pytest.fixture(scope="module")
def lm_docs(spark):
    rng = random.Random(8)
    follow = {"nation": "one one one two", "version": "two two two one"}
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rng.randint(0, 30)):
            words.append(rng.choice(LM_WORDS))
            words += [rng.choice(follow[words[-1]].split())] if words[-1] in follow else []
        texts.append(" ".join(words))
    return docs(spark, [*texts, None, "", "unseen words here"])


@pytest.mark.parametrize("buckets", [1, 5])
def test_lm_scores_are_those_of_a_distribution_after_each_whole_word(lm_docs, monkeypatch, buckets):
    """Probabilities of all words after one add up to 1, scores are their sums, and words dealt in either way get the same."""
    scores = []
    for frequent in (lm_score.FREQUENT, 2):
        monkeypatch.setattr(lm_score, "FREQUENT", frequent)
        model = lm_score.learn(lm_docs.where(lm_score.is_training()), buckets=buckets)
        tokens = lm_score.Tokens()
        tokens.add(" ".join([*LM_WORDS, "one two unseen words here"]))
        ids = dict(zip(tokens.place, tokens.done()[0].tolist()))
        log = _after(model, [ids[w.encode()] for w in ("unseen", "words", "here")])
        for before in {b for _, b in log}:
            assert sum(10**x for (_, b), x in log.items() if b == before) == pytest.approx(1.0, abs=1e-5)
        rows = lm_score.score(lm_docs, model).collect()
        texts = {r.doc_id: r.text for r in lm_docs.collect()}
        for r in rows:
            words = [ids[w] for w in (texts[r.doc_id] or "").encode().split()]
            end = ids[lm_score.END]
            pairs = zip([*words, end], [end, *words])
            assert r.score == pytest.approx(sum(log.get((w, b)) or log[0, b] for w, b in pairs), abs=1e-4), texts[r.doc_id]
        scores.append({r.doc_id: r.score for r in rows})
    assert scores[0] == pytest.approx(scores[1])


def test_lm_contexts_are_whole_words(spark, lm_docs):
    """Words whose last two bytes are the same have contexts of their own, as many as there are words."""
    model = lm_score.learn(lm_docs.where(lm_score.is_training()))
    texts = ["nation one", "nation two", "version one", "version two", "station one", "station two"]
    got = {r.doc_id: r.score for r in lm_score.score(docs(spark, texts), model).collect()}
    assert got[0] > got[1] + 0.2 and got[3] > got[2] + 0.2  # three times as likely: 0.48


# --- 3 ---


def test_top_k_against_brute_force_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 8)) * 4) / 16
    x[50:90] = x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [None] * 8), (1002, [float("nan")] * 8), (1100, []), (1200, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, candidates=64, queries=4).collect()}
    q = np.floor(x * 1024).astype(int)
    want = {}
    for i in range(0, 300, 50):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(300) if j != i)[:10]
        want |= {(i, k + 1): (j, -s) for k, (s, j) in enumerate(best)}
    assert got == want


def test_top_k_with_fewer_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2048 * 1024)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).collect() == []


# --- 4 ---


def brute_components(texts, words, threshold):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= threshold * len(a | b) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return sets, label


def family(rng, n, words=80, edits=6):
    base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(1, edits)):
            t[rng.randrange(len(t))] = f"e{rng.randint(0, 5000)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_against_brute_force(spark, words):
    rng = random.Random(words)
    texts = [*family(rng, 60), *family(rng, 40, edits=9), *[f"{i} lone text {i * 7}" for i in range(20)], "A b C", "a B c", None, "", "one", "ONE ", "same same same same same same same", "same same same same same same same same"]
    sets, label = brute_components(texts, words, 80)
    got = {r.doc_id: r for r in near_dups.near_duplicates(docs(spark, texts), words).collect()}
    assert [got[i].component_id for i in range(len(texts))] == label
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert all(got[i].kept == (label[i] == i) for i in got)


def test_blocks_of_a_region_give_the_same_links(monkeypatch):
    rng = random.Random(8)
    texts = family(rng, 30, edits=9)
    n = len(texts)
    mins = np.array([near_dups.minhashes(near_dups.shingles(t, 2)) for t in texts])
    links = near_dups._links_across(list(range(n)), [(True, True)] * n, list(range(n)), texts, mins, 2, 80)
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert label == brute_components(texts, 2, 80)[1]


@pytest.mark.parametrize("holders, block, sets", [(1, 2048, 1_000_000), (30, 2048, 1000), (30, 7, 1_000_000)])
def test_near_duplicates_whose_keys_lead_to_other_documents(spark, monkeypatch, holders, block, sets):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    monkeypatch.setattr(near_dups, "SETS", sets)
    a = [f"w{i}" for i in range(150)]
    sets = near_dups.shingles(" ".join(a), 1)
    least = set(near_dups._SPUN(sets[None, :]).argmin(axis=1))
    passage = [w for w in a if int(np.flatnonzero(sets == near_dups.shingles(w, 1)[0])[0]) in least]
    assert len(passage) < 0.6 * len(a)
    # short holders of the words that make a's keys come first under all of them, and their sizes rule them out
    crowd = [" ".join([*passage, *(f"h{i}-{k}" for k in range(20))]) for i in range(holders)]
    texts = [*crowd, " ".join(a), " ".join([*a, "new", "words"])]
    label = brute_components(texts, 1, 80)[1]
    assert label[-1] == label[-2] == holders
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs(spark, texts), 1).collect()}
    assert [got[i] for i in range(len(texts))] == label


def test_near_duplicates_of_nothing_and_repeated_rows(spark, empty):
    assert near_dups.near_duplicates(empty).collect() == []
    df = spark.createDataFrame([(3, "a b c"), (3, "a b c"), (2, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dups.near_duplicates(df, 2).collect()) == [("2", "2", True), ("3", "2", False), ("3", "2", False), ("None", "None", True)]


def test_components_read_the_links_of_a_group_once(spark, monkeypatch):
    """A hub with 3,000 nodes and a chain of 300: links that lie inside a group are not read in later rounds."""
    from tallymark.llm import graph

    sizes, chain = [], random.Random(4).sample(range(10_000, 10_300), 300)
    keep = graph.written

    def counted(df, name):
        out = keep(df, name)
        if name == "links":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    links = [(0, i) for i in range(1, 3001)] + list(zip(chain, chain[1:]))
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(3001)} | {i: 10_000 for i in range(10_000, 10_300)}
    assert sizes[0] == 2 * len(links) and sum(sizes[1:]) < 2000 and sizes[-1] == 0


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and len(got) == 43
    assert components(links.limit(0)).collect() == []


# --- 5 ---


@pytest.mark.parametrize("chunk", [5, 64, token_counts.CHUNK])
def test_token_counts_are_the_library_s(hard, chunk):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES_PATH)
    for r in token_counts.token_counts(hard, PIECES_PATH, chunk=chunk, limit=20).collect():
        n = len(model.encode(r.text or ""))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 20)


# --- 6 ---


def test_mixing_meets_its_rates_and_is_repeatable(spark):
    df = docs(spark, [f"t{i}" for i in range(3000)], lambda i: "big" if i % 3 else "small")
    weights = {"big": 1.0, "small": 3.0}
    mixed = mixing.mix(df, weights)
    by = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(by["big"] - 750) < 120 and abs(by["small"] - 2250) < 200
    assert [r.mix_key for r in mixed.collect()] == sorted(r.mix_key for r in mixing.mix(df.repartition(3), weights).collect())
    assert mixing.mix(df, {"big": 1.0, "small": 0.0}).where("source = 'small'").isEmpty()


def test_poisson_inverts_the_distribution(spark):
    rates = [0.0, 0.3, 2.5, 16.0, 40.0, 900.0]
    df = spark.range(4000).crossJoin(spark.createDataFrame([(r,) for r in rates], "rate double"))
    got = df.groupBy("rate").agg(F.avg(mixing.copies(F.col("rate"), F.col("id"))).alias("m"), F.variance(mixing.copies(F.col("rate"), F.col("id"))).alias("v")).collect()
    for r in got:
        assert abs(r.m - r.rate) <= 5 * math.sqrt(r.rate / 4000) and abs(r.v - r.rate) <= 0.15 * r.rate
    u = spark.createDataFrame([(0.1,), (0.5,), (0.95,)], "u double")
    cdf = lambda k: sum(math.exp(-2.5) * 2.5**i / math.factorial(i) for i in range(k + 1))
    assert [r[0] for r in u.select(mixing.poisson(F.lit(2.5), F.col("u"))).collect()] == [next(k for k in range(99) if cdf(k) >= x) for x in (0.1, 0.5, 0.95)]


def test_mixing_with_null_sources_many_sources_and_nothing(spark, empty, monkeypatch):
    df = docs(spark, ["a", "b", "c"], lambda i: None if i else "s")
    assert mixing.mix(df, temper=0.0).columns == [*df.columns, "copy", "mix_key"]
    few = sorted(tuple(r) for r in mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "FEW", 0)
    assert sorted(tuple(r) for r in mixing.mix(df).collect()) == few
    assert mixing.mix(empty).collect() == []


# --- 7 ---


def edit_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x):
        last, row[0] = row[0], i + 1
        for j, b in enumerate(y):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (a != b))
    return row[-1]


def edit_alike(x, y, least=0.8):
    units = (x, y) if max(len(x), len(y)) <= line_dedup.LONG else (x.split(), y.split())
    return edit_distance(*units) <= math.floor(max(map(len, units)) * (1 - least) + 1e-9)


def changed_lines(rng, groups, copies, sizes=(6, 60)):
    """Lines of unlike words, and copies with one word in twelve changed, left out or put in."""
    out = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(*sizes))]
        out.append(" ".join(base))
        for _ in range(copies):
            t = list(base)
            for _ in range(max(1, len(t) // 12)):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = [f"e{rng.randint(0, 3000)}" for _ in range(rng.randint(0, 1))] or [t[at]]
            out.append(" ".join(t))
    return sorted(set(out))


@pytest.mark.parametrize("counters", [(9, 21, 63), (3, 21, 63), (3, 7, 63)])
def test_simhash_is_the_majority_of_the_words_in_every_counter(spark, monkeypatch, counters):
    monkeypatch.setattr(line_dedup, "COUNTERS", counters)
    lines = [" ".join(random.Random(i).choices([f"w{j}" for j in range(900)], k=n)) for i, n in enumerate((1, 5, 6, 40, 300, 3000))]
    df = docs(spark, ["\n".join(lines), lines[0], lines[2]])
    got = {r.h: r for r in line_dedup.entries_of(df, "text").select("n_words", "sim", "blocks", F.col("n_words").alias("h")).collect()}
    assert len(got) == len(lines)
    for line in lines:
        words = sorted({*line.split()})
        hashes = [r.x for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("x")).collect()]
        want = sum(1 << k for k in range(63) if 2 * sum((x >> k) & 1 for x in hashes) > len(hashes))
        assert got[len(line.split())].sim == (want if len(words) >= 10 else None)
        # blocks: runs of the ring of hashes that begin at a chosen one
        ring, want = sorted(hashes), set()
        n = len(ring)
        one_in = 2 if n < 40 else 4 << int(math.log2(n / 40))
        for size, chosen in ((3, ring if 8 <= n < 20 else []), (4, [x for x in ring if x % one_in == 0] if n >= 16 else [])):
            want |= {(size, *(ring + ring)[ring.index(x) :][:size]) for x in chosen}
        if len(ring) < 10:
            few = [k for out in range(3) if out == 0 or len(ring) - out >= 3 for k in itertools.combinations(ring, len(ring) - out)]
            want |= {(-1, functools.reduce(operator.xor, k)) for k in few}
        form = lambda xs: f"{xs[0]}L" if len(xs) == 1 else f"array({','.join(f'{x}L' for x in xs)})"
        rows = spark.sql("select inline(array(" + ",".join(f"struct(xxhash64({t}, {form(xs)}) as k)" for t, *xs in sorted(want)[:20]) + "))")
        rows = [r.k for r in rows.collect()]
        blocks = got[len(line.split())].blocks
        assert len(blocks) == len(set(blocks)) == len(want) and set(rows) <= set(blocks)


def test_links_found_by_length_and_share_of_changed_words(spark):
    """At least nine in ten links in every class; words are frequent and rare ones, as in texts."""
    rng = random.Random(23)
    word = lambda: f"w{int(rng.paretovariate(0.6))}"
    classes = {(n, share): [] for n in ((12, 29), (30, 59), (60, 200)) for share in (0.03, 0.08, 0.14)}
    for (sizes, share), pairs in classes.items():
        while len(pairs) < 60:
            base = [word() for _ in range(rng.randint(*sizes))]
            copy = list(base)
            for at in rng.sample(range(len(base)), max(1, round(share * len(base)))):
                copy[at] = word()
            base, copy = " ".join(base), " ".join(copy)
            if base != copy and edit_alike(base, copy):
                pairs.append((base, copy))
    df = docs(spark, [x for pairs in classes.values() for pair in pairs for x in pair])
    entries = line_dedup.entries_of(df, "text")
    names = {r.doc_id: r.id for r in entries.collect()}
    label = {r.node: r.component for r in components(line_dedup.links(entries, df, 0.8, "text")).collect()}
    at = 0
    for name, pairs in classes.items():
        ids = [(names.get(at + 2 * i), names.get(at + 2 * i + 1)) for i in range(len(pairs))]
        assert sum(x in label and label[x] == label.get(y) for x, y in ids) >= 0.9 * len(pairs), name
        at += 2 * len(pairs)


def test_lines_equal_and_alike_stay_once(spark):
    long = " ".join(f"word{i}" for i in range(120))
    near = long.replace("word60", "other")
    texts = [f"A short line\n{long}\nonly here is this one line", f"a  short line\t \r\n{long.upper()}", near, None, "", "x\n\ny", "  \n", "y\r\n \nz"]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    kept = "\n".join(out[i].text for i in range(3)).lower()
    assert kept.count("word1 ") == 1 and kept.count("word119") == 1 and kept.count("short line") == 1
    assert "only here is this one line" in kept
    assert [out[i].text for i in (3, 4, 6)] == [None, "", "  \n"] and out[3].n_lines == out[3].n_dropped == 0
    assert sorted((out[5].text + "\n" + out[7].text).split()) == ["x", "y", "z"] and " " in out[7].text.split("\n")


@pytest.mark.parametrize("deal", [1024, 5])
def test_line_groups_against_brute_force_edit_similarity(spark, monkeypatch, deal):
    monkeypatch.setattr(line_dedup, "DEAL", deal)
    lines = changed_lines(random.Random(11), 60, 4)
    brute = {(a, b) for i, a in enumerate(lines) for b in lines[:i] if abs(len(a) - len(b)) <= 0.3 * len(a) and edit_alike(a, b)}
    label = {x: x for x in lines}
    for _ in lines:
        for a, b in brute:
            label[a] = label[b] = min(label[a], label[b])
    kept = [r.text for r in line_dedup.dedup_lines(docs(spark, lines)).where("n_dropped = 0").collect()]
    assert set(kept) <= set(lines) and {label[x] for x in kept} == set(label.values())  # no line goes without one like it
    groups = len(set(label.values()))
    assert len(lines) - len(kept) >= 0.97 * (len(lines) - groups)
    # links found under shared keys, against all of them
    df = docs(spark, lines)
    entries = line_dedup.entries_of(df, "text")
    sims = {r.id: r.sim for r in entries.collect()}
    rows = [(r.key, r.id, sims[r.id]) for r in line_dedup.met(entries).collect()]
    by = {}
    for key, i, sim in rows:
        by.setdefault(key, []).append((i, sim))
    met = {frozenset((i, j)) for v in by.values() for i, s in v for j, t in v if i != j and (s is None or t is None or (s ^ t).bit_count() <= line_dedup.BITS)}
    name = {r.doc_id: r.id for r in entries.collect()}
    at = {x: name[i] for i, x in enumerate(lines)}
    assert sum(frozenset((at[a], at[b])) in met for a, b in brute) >= 0.9 * len(brute)


def test_pairs_ruled_out_without_their_texts_are_no_links(spark, monkeypatch):
    """Of pairs under one key, whose texts were all fetched and joined before, those of other words or lengths go first; no link goes with them."""
    rng = random.Random(3)
    lines = changed_lines(rng, 12, 3, (6, 30)) + changed_lines(rng, 8, 3, (40, 150)) + ["w1 w2 " * 70, "w1 w2 " * 60, "w2 w1 " * 70]
    df = docs(spark, lines)
    entries = line_dedup.entries_of(df, "text").withColumns({"sim": F.lit(5).cast("long"), "blocks": F.array(F.lit(9).cast("long"))})
    name = {r.doc_id: r.id for r in entries.collect()}
    alike = {frozenset((name[i], name[j])) for i in name for j in name if i < j and edit_alike(" ".join(lines[i].split()), " ".join(lines[j].split()))}
    rows = line_dedup.met(entries)
    nothing = spark.createDataFrame([], "node long, component long")
    left = {frozenset((r.a, r.b)) for r in line_dedup.across(rows, entries, nothing, 0.8).collect()}
    assert alike <= left and len(left) < len(name) * (len(name) - 1) / 8
    first = rows.first()["first"]
    assert {frozenset((r.a, r.b)) for r in line_dedup.stars(rows, entries, 0.8).collect()} == {p for p in left if first in p}


def test_lines_of_a_key_whose_least_entry_is_unlike_them(spark, monkeypatch):
    a, b = [" ".join(f"{c}{i}" for i in range(30)) for c in "ab"]
    lines = [f"{x} {y}" for x in (a, b) for y in ("one", "two", "three")]
    df = docs(spark, lines)
    entries = line_dedup.entries_of(df, "text").withColumns({"sim": F.lit(5).cast("long"), "blocks": F.array(F.lit(9).cast("long"))})
    groups = components(line_dedup.links(entries, df, 0.8, "text"))
    assert groups.count() == 6 and groups.select("component").distinct().count() == 2
    for deal in (1, 2):
        monkeypatch.setattr(line_dedup, "DEAL", deal)
        again = components(line_dedup.links(entries, df, 0.8, "text"))
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, groups.collect()))


def test_keys_of_lines_go_through_one_shuffle(spark, monkeypatch):
    rows = spark.createDataFrame([(1, [7, 8]), (2, [8]), (3, [9, 8, 7]), (4, [])], "id long, blocks array<bigint>")
    plans = []
    monkeypatch.setattr(line_dedup, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    got = {tuple(r) for r in line_dedup.met(rows).collect()}
    assert got == {(7, 1, 2, 1), (7, 3, 2, 1), (8, 1, 3, 1), (8, 2, 3, 1), (8, 3, 3, 1)}
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 1


def test_no_text_of_a_line_is_fetched_twice(spark, monkeypatch):
    fetch, calls = line_dedup._texts, []
    monkeypatch.setattr(line_dedup, "_texts", lambda wanted, *a: calls.append(wanted.count()) or fetch(wanted, *a))
    df = docs(spark, [" ".join([*[f"{c}{i}" for i in range(30)], y]) for c in "ab" for y in ("one", "two", "three")])
    entries = line_dedup.entries_of(df, "text").withColumns({"sim": F.lit(5).cast("long"), "blocks": F.array(F.lit(9).cast("long"))})
    groups = components(line_dedup.links(entries, df, 0.8, "text"))
    assert calls == [6, 0] and groups.count() == 6 and groups.select("component").distinct().count() == 2


def test_simhash_of_lines_just_within_and_beyond_a_counter(spark):
    lines = [" ".join(f"v{n}x{j}" for j in range(n)) for n in (10, 11, 126, 127, 128, 511, 512)]
    got = {r.n_words: r.sim for r in line_dedup.entries_of(docs(spark, lines), "text").collect()}
    assert line_dedup.COUNTERS[0] == 7 and len(got) == len(lines)
    for line in lines:
        words = line.split()
        hashes = [r.x for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("x")).collect()]
        assert got[len(words)] == sum(1 << k for k in range(63) if 2 * sum((x >> k) & 1 for x in hashes) > len(words))


def test_line_hashes_that_clash_drop_nothing(spark):
    docs_ = docs(spark, ["one two\nthree four", "one two", "five six seven"]).withColumn("kept_places", F.array(F.lit(7)))
    clash = docs_.limit(1).select(F.xxhash64(F.array(F.lit("one"), F.lit("two"))).alias("id"))
    out = {r.doc_id: r.text for r in line_dedup._only_kept(docs_, "text", clash).collect()}
    assert out == {0: "one two", 1: "one two", 2: ""}


def test_line_dedup_keeps_distinct_lines_and_columns(spark, empty):
    texts = [f"this is line number {i} of many\nand {i * 31} another {i * 17} one here" for i in range(30)]
    df = docs(spark, texts).withColumn("n_dropped", F.lit("clash"))
    out = line_dedup.dedup_lines(df)
    rows = out.collect()
    assert set(out.columns) == {*df.columns, "n_lines"}
    lines = [x for t in texts for x in t.split("\n")]
    for r in rows:
        stays = r.text.split("\n")
        assert r.n_dropped == 2 - len([x for x in stays if x])
    kept = [x for r in rows for x in r.text.split("\n") if x]
    # one line of each connected group stays: what is left out may be like it through others only
    near = {x: [y for y in lines if x == y or edit_alike(x, y)] for x in lines}
    label = {x: x for x in lines}
    for _ in lines:
        for x in lines:
            label[x] = min(label[y] for y in near[x])
    assert {label[x] for x in kept} == set(label.values()) and len(kept) == len(set(label.values())) < len(set(lines))
    assert line_dedup.dedup_lines(empty).collect() == []


# --- 8 ---


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("th", "on", "er", "lose", "cat") for b in ("in", "at", "ou", "es")]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        t = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if toxic:
            t.insert(rng.randrange(len(t)), "zapfoo" + rng.choice(("a", "bar", "ling", "x")))
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.learn(df, lab)
    got = {r.doc_id: r for r in toxicity.tag(df.withColumn("score", F.lit("clash")), model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i].score >= 0.5) == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    for i in held:
        for s in got[i].spans:
            assert "zapfoo" in rows[i][1][s.start : s.end]
    assert 0 <= got[900].score < 0.5 and got[900].score == got[901].score and got[901].spans == []


def test_spans_refer_to_the_text_as_it_is():
    m = toxicity.Field({"=bad": 9.0}, -4.0, (0.0,) * 4, prefixes=())
    text = "\u0130\u0130\u0130\u0130\u0130 BAD x"
    assert [(x["start"], x["end"]) for x in m.document(text)[1]] == [(6, 9)]


def test_columns_with_clashing_names_repeated_rows_and_empty_tables(spark, empty):
    df = docs(spark, ["a b\nc d e f g h", "a b\nc d e f g h", None]).unionByName(docs(spark, ["a b\nc d e f g h"]))
    clash = df.withColumns({c: F.lit("clash") for c in ("n_tokens", "over_limit", "n_bytes", "tracks", "media_error", "component_id", "kept", "copy", "mix_key")})
    counted = token_counts.token_counts(clash, PIECES_PATH).collect()
    assert len(counted) == 4 and {r.over_limit for r in counted} == {False} and counted[0].n_tokens == counted[1].n_tokens
    assert token_counts.token_counts(empty, PIECES_PATH).collect() == []
    media_rows = media.media_columns(media.wrap_texts(clash)).collect()
    assert len(media_rows) == 4 and all(r.media_error is None and len(r.tracks) == 1 for r in media_rows)
    assert media.media_columns(media.wrap_texts(empty)).collect() == []
    near = {r.doc_id: r.component_id for r in near_dups.near_duplicates(clash, 2).collect()}
    assert near == {0: 0, 1: 0, 2: 2}
    mixed = mixing.mix(clash, {"s": 1.0}).collect()
    assert all(r.copy >= 1 and len(r.mix_key) == 32 for r in mixed)
    assert toxicity.tag(empty, toxicity.Field()).collect() == []


def test_marginals_match_enumeration():
    m = toxicity.Field({"=a": 2.0, "=b": -1.0}, -0.5, (0.3, -0.7, -0.2, 0.9), prefixes=())
    words = ["a", "b", "c", "a"]
    unary = [m.bias + m.weights.get("=" + w, 0) for w in words]
    total, on = 0.0, [0.0] * 4
    for tags in range(16):
        y = [(tags >> k) & 1 for k in range(4)]
        p = math.exp(sum(u * t for u, t in zip(unary, y)) + sum(m.moves[2 * a + b] for a, b in zip(y, y[1:])))
        total += p
        on = [o + p * t for o, t in zip(on, y)]
    assert m.marginals(words) == pytest.approx([o / total for o in on])


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    row = toxicity.tag(df, toxicity.learn(df, spark.createDataFrame([], "doc_id long, toxic int"))).first()
    assert row.score < 0.01 and row.spans == []


# --- 9 ---


def test_licenses_and_inheritance(spark):
    rows = [
        ("a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("a/b/code.py", "nothing here"),
        ("a/b/own.py", "# header\n# Released under the MIT License.\n" + "code\n" * 50),
        ("a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/d/deep.py", None),
        ("z/free.py", ""),
        (None, "text"),
        ("a/b/code.py", "nothing here"),
    ]
    filler = [(f"f/{i}", "the work of the version under this public and general " + str(i)) for i in range(200)]
    df = spark.createDataFrame(rows + filler, "path string, text string").withColumn("cosine", F.lit("clash"))
    got = {(r.path, r.text): (r.license, r.inherited_from) for r in license_scan.scan_licenses(df).collect()}
    assert got[rows[1]] == ("Apache-2.0", "a/LICENSE")
    assert got[rows[2]] == ("MIT", None)
    assert got[rows[4]] == ("GPL-3.0", "a/b/c/COPYING")
    assert got[rows[5]] == got[rows[6]] == (None, None)
    assert license_scan.scan_licenses(df).count() == len(rows) + len(filler)
    assert license_scan.scan_licenses(df.limit(0)).collect() == []


HEADERS = {
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY",
    "ISC": "Copyright (c) 2019 A. Person\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES",
    "BSD-2-Clause": "Copyright (c) 2020, A. Person\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"",
    "MIT": "MIT License\n\nCopyright (c) 2021 A. Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software",
    "Proprietary": "Copyright 2020. All rights reserved.",
}


def test_standard_headers_and_tags(spark):
    code = "\n".join(f"value{i} = compute(item{i}, other{i})" for i in range(40))
    rows = [(f"{n}/{how}/f.c", f"{before}{mark}{h.replace(chr(10), chr(10) + mark)}\n{code}") for n, h in HEADERS.items() for how, before, mark in (("plain", "", ""), ("comment", f"{code}\n", " * "))]
    tags = [("MIT", "// SPDX-License-Identifier: MIT"), ("GPL-2.0-only WITH Linux-syscall-note", "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */"), ("MIT OR Apache-2.0", f"# SPDX-License-Identifier: (MIT OR Apache-2.0)\n{HEADERS['ISC']}")]
    rows += [(f"{n}/tag{i}", f"{t}\n{code}") for i, (n, t) in enumerate(tags)]
    rows += [("none/a", "a domain name is reserved for the licence office, without warranty or copyright of any kind"), ("none/b", code), ("none/c", "license " * 3000)]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: r.own_license for r in license_scan.scan_licenses(df).collect()}
    assert got == {p: None if p.startswith("none") else p.split("/")[0] for p, _ in rows}


def test_license_cosines_against_brute_force(spark):
    texts = [*HEADERS.values(), f"x y {HEADERS['ISC']} z", "copyright all rights", "the license of the domain " * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "scan_row long, text string")
    cut = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    bags = [set(cut(t)) for t in texts]
    templates = [(n, cut(t)) for n, t in license_scan.TEMPLATES]
    known = {w for _, t in templates for w in t}
    idf = lambda w: math.log((1 + len(texts)) / (1 + sum(w in b for b in bags)))
    weight = lambda w: idf(w) if w in known else math.log(1 + len(texts))
    anchor = lambda w: next((a for a in license_scan.ANCHORS if a in w), None)
    assert all(any(anchor(w) for w in t) for _, t in templates)
    want = {}
    for i, text in enumerate(map(cut, texts)):
        for place, word in enumerate(text):
            for k, (_, t) in enumerate(templates):
                offset = next((o for o, w in enumerate(t) if anchor(word) and anchor(w) == anchor(word)), None)
                if offset is None:
                    continue
                a = Counter(text[max(place - offset, 0) : place - offset + len(t)])
                b = Counter(t)
                norms = [math.sqrt(sum((n * weight(w)) ** 2 for w, n in c.items())) for c in (a, b)]
                dot = sum(n * b[w] * weight(w) ** 2 for w, n in a.items())
                want[i, place, k] = dot / (norms[0] * norms[1]) if norms[0] * norms[1] else 0.0
    got = {(r.scan_row, r.place, r.template): r.cosine for r in license_scan._scored(df, "text").collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)


# --- 10 ---


@pytest.mark.parametrize("n", [1, 63, 64, 65, 200])
def test_media_round_trip(n):
    payload = random.Random(n).randbytes(576 * n)
    found, error = media.tracks(media.wrap(payload))
    data = media.wrap(payload)
    assert error is None and b"".join(data[r["start"] : r["start"] + r["length"]] for r in found[0]["runs"]) == payload
    assert (found[0]["codec"], found[0]["kind"], found[0]["n_samples"]) == ("raw ", "soun", n)
    assert found[0]["duration_s"] == pytest.approx(576 * n / 8000)


def test_media_key_frames_large_sizes_and_damage():
    data = media.wrap(bytes(576 * 4))
    box = lambda kind, body: len(body).__add__(8).to_bytes(4, "big") + kind + body
    stss = box(b"stss", bytes(4) + (2).to_bytes(4, "big") + (1).to_bytes(4, "big") + (3).to_bytes(4, "big"))
    # a table of key frames, put in place of the entry of times of the same track
    at = data.index(b"stts") - 4
    size = int.from_bytes(data[at : at + 4], "big")
    swapped = data[:at] + stss + data[at + size :]
    assert len(stss) == size
    keys = media.tracks(swapped)[0][0]["keyframes"]
    start = media.tracks(data)[0][0]["runs"][0]["start"]
    assert keys == [{"start": start, "length": 576}, {"start": start + 1152, "length": 576}]
    wide = (1).to_bytes(4, "big") + b"free" + (16).to_bytes(8, "big")
    assert media.tracks(data + wide) == media.tracks(data)
    for bad in (data[:-1], data[:100], b"no", b"\xff" * 64, data[:28] + b"\xff\xff\xff\xff" + data[32:]):
        assert media.tracks(bad)[0] == [] and media.tracks(bad)[1]
    found, error = media.tracks(data + box(b"moof", box(b"mfhd", bytes(8))))
    assert found == media.tracks(data)[0] and error.startswith("1 fragments")
    assert media.tracks(None) == ([], "empty") and media.tracks(b"") == ([], "empty")


def test_media_columns_of_texts(hard):
    got = media.read_back(media.media_columns(media.wrap_texts(hard))).collect()
    for r in got:
        data = (r.text or "").encode()
        padded = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))


def test_top_k_of_a_block_costs_a_few_products_of_matrices():
    """2,048 candidates and 256 queries of unstructured vectors, of which few are ruled out early."""
    rng = np.random.default_rng(8)
    x, q = (np.floor(1024 * rng.normal(size=(n, 64)) / 8).astype(np.int64) for n in (2048, 256))
    began = time.thread_time()
    i, j, s = topk.block_top(np.arange(2048), x, np.arange(10_000, 10_256), q, 10)
    spent = time.thread_time() - began
    scores = q @ x.T
    for row in range(256):
        got = sorted((-int(v), int(c)) for c, v in zip(j[i == row], s[i == row]))
        assert got == sorted((-int(v), c) for c, v in enumerate(scores[row]))[:10]
    gathered = time.thread_time()
    seen, rows = np.zeros((2048, 256)), rng.permutation(2048)
    for d in range(64):  # the same sums list by list, once
        seen[rows] += x[rows, d, None] * q[None, :, d].ravel()
    assert spent < 2 * (time.thread_time() - gathered)
