"""Quality rules, periodic runs and importance resampling against brute force, and on hard rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import importance, periodic_runs, quality, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [None, "", " ", "a", "  a  b   c", "aaaa" * 300, "\n\n x", "日本語 漢字", "▁▁ x▁y", "a\u0000b", "🙂🙂  🙂", "=" * 80, "word " * 3000, "Ünïcode WÖRDS", "z" * 200 + " y"]


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def hard(spark):
    return docs(spark, HARD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(rng, n, words="the of and to in a is that it was for on".split()):
    return " ".join(rng.choice(words) if rng.random() < 0.4 else "".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(2, 9))) for _ in range(n))


# --- 11 ---


def brute_counts(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {k for i, w in enumerate(windows) if count[w] > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_base_counts_against_brute_force(spark, hard):
    rng = random.Random(4)
    texts = HARD + [" ".join(rng.choice("a b c d* <e> f\n g|".split(" ")) for _ in range(rng.randint(0, 90))) for _ in range(80)]
    for r in quality.judge(docs(spark, texts)).collect():
        want = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.text == texts[r.doc_id] and not (r.base_failed and r.kept)


def brute_distance(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    return math.sqrt(sum(a * math.log2(a / c) for a, c in zip(p, m) if a) / 2 + sum(b * math.log2(b / c) for b, c in zip(q, m) if b) / 2)


def test_distances_against_brute_force(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(40)] + [prose(rng, 300).upper(), " | ".join(prose(rng, 120).split()), prose(rng, 20)]
    got = {r.doc_id: r for r in quality.judge(docs(spark, texts)).collect()}
    words = [t.lower().split() for t in texts]
    taught = [i for i, w in enumerate(words) if len(w) >= 50]
    held = Counter(w for i in taught for w in set(words[i]))
    common = [w for w, _ in sorted(held.items(), key=lambda x: (-x[1], x[0].encode()))[: quality.COMMON]]

    def shares(counts):
        return np.array(counts) / sum(counts)

    of_words = [shares([w.count(c) for c in common] + [sum(x not in common for x in w)]) for w in words]
    of_class = [shares(np.bincount(quality.CLASS_OF[list(t.encode())], minlength=quality.CLASSES)) for t in texts]
    for refs, name in ((of_words, "word_distance"), (of_class, "class_distance")):
        mean = np.mean([refs[i] for i in taught], axis=0)
        for i in range(len(texts)):
            assert (got[i][name] is None) == (len(words[i]) < 50)
            if got[i][name] is not None:
                assert got[i][name] == pytest.approx(brute_distance(refs[i], mean), abs=1e-6)
    assert all(got[i].kept for i in range(40)) and not got[40].kept and not got[41].kept
    assert got[42].kept  # too short to be judged


def test_copies_of_one_text_do_not_move_the_reference(spark):
    rng = random.Random(6)
    clean = [prose(rng, 150) for _ in range(60)]
    junk = " | ".join("".join(rng.choice("wxyz") for _ in range(4)) for _ in range(100))
    alone = {r.doc_id: r.kept for r in quality.judge(docs(spark, [*clean, junk])).collect()}
    many = {r.doc_id: r.kept for r in quality.judge(docs(spark, [*clean, *[junk] * 120])).collect()}
    assert all(alone[i] and many[i] for i in range(60)) and not any(many[i] for i in range(60, 180))


def test_quality_on_hard_rows(spark, hard, empty):
    clash = hard.withColumns({n: F.lit("x") for n in ("kept", "n_words", "word_counts", "quality_lang", "words", "class_ref", "w", "c", "place")})
    rows = quality.judge(clash.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(rows) == len(HARD) and {r.quality_lang for r in rows} == {"x"} and {r.words for r in rows} == {"x"}
    assert quality.judge(empty).collect() == []
    assert "text" not in quality.judge(hard, keep_text=False).columns


# --- 12 ---


def brute_runs(w, least, periods):
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= least and length >= periods * q:
                part = w[i : i + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def random_words(rng):
    w = [rng.randrange(rng.choice((1, 2, 3, 5))) for _ in range(rng.randint(0, 80))]
    if w and rng.random() < 0.6:
        a = rng.randrange(len(w))
        p = 1 + rng.randrange(max(1, (len(w) - a) // 2))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


@pytest.mark.parametrize("least, periods", [(24, 3), (6, 3), (2, 2)])
def test_runs_against_brute_force(least, periods):
    rng = random.Random(least)
    for _ in range(500):
        w = random_words(rng)
        assert periodic_runs.runs_of(w, least, periods) == brute_runs(w, least, periods), w


def test_words_are_asked_where_hashes_agree_by_chance(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PRIME", 7)
    rng = random.Random(9)
    for _ in range(200):
        w = random_words(rng)
        assert periodic_runs.runs_of(w, 6, 3) == brute_runs(w, 6, 3), w


def test_a_long_text_of_one_word_and_of_a_long_period():
    assert periodic_runs.runs_of(["a"] * 50_000) == [(0, 50_000, 1)]
    w = [f"w{i * i % 7919}" for i in range(9000)] * 4
    assert periodic_runs.runs_of(w)[0][2] == 7919 or (0, 36_000, 9000) in periodic_runs.runs_of(w)


def test_periodic_runs_query_form(spark, hard, empty):
    rng = random.Random(12)
    texts = [*HARD, *["x " + " ".join(rng.choice("ab") for _ in range(3)) + " p q r" * 9 + " end" for _ in range(30)]]
    found = periodic_runs.periodic_runs(docs(spark, texts).withColumn("runs", F.lit(1)))
    found = found.select("*", periodic_runs.greatest("runs").alias("best"), periodic_runs.runs_digest("runs").alias("digest"))
    for r in found.collect():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (texts[r.doc_id] or "").encode())
        runs = brute_runs(w[:200], 24, 3) if len(w) < 200 else [(0, len(w), 1)]
        assert [tuple(x) for x in r.runs] == runs
        drop = {i for s, k, p in runs for i in range(s + p, s + k)}
        assert r.collapsed.encode() == b" ".join(x for i, x in enumerate(w) if i not in drop)
        assert r.digest == hashlib.sha256("".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()).hexdigest()
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert (tuple(r.best) if r.best else None) == best
    assert periodic_runs.periodic_runs(empty).collect() == []


def test_tail_repetition_of_the_query(spark):
    rng = random.Random(13)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(200)]
    words = docs(spark, texts).select("doc_id", periodic_runs.words_of("text").alias("words"))
    for r in words.select("doc_id", "words", queries._tail_repeated("words", "doc_id").alias("out")).collect():
        w, h = r.words, zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(r.words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert r.out == w


# --- 13 ---


def brute_features(text, buckets=10_000):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [zlib.crc32(" ".join(w[j : j + n]).encode()) % buckets for n in (1, 2, 3) for j in range(len(w) - n + 1)]


def test_crcs_of_ngrams_are_composed_right():
    rng = random.Random(14)
    for _ in range(40):
        texts = [" ".join("".join(rng.choice("abé漢-Z9") for _ in range(rng.choice((1, 3, 5, 63, 64, 65, 200, 5000)))) for _ in range(rng.randint(0, 12))) for _ in range(4)]
        words = [importance.words_of(t) for t in texts]
        crcs, owner = importance.ngram_crcs(words)
        want = sorted((i, zlib.crc32(b" ".join(w[j : j + n]))) for i, w in enumerate(words) for n in (1, 2, 3) for j in range(len(w) - n + 1))
        assert sorted(zip(owner.tolist(), crcs.tolist())) == want


def test_resampling_against_brute_force(spark):
    rng = random.Random(15)
    texts = [*HARD, *[prose(rng, rng.randint(0, 60)) for _ in range(180)]]
    target = [prose(rng, 50), None, "", "the the the"]
    got = importance.resample(docs(spark, texts), docs(spark, target)).collect()
    features = [brute_features(t) for t in texts]
    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, f in features:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, brute_features(x)[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10_000) / ((s[b] + 1) * (t.sum() + 10_000)))) for b in range(10_000)]
    want = {}
    for i, (n, f) in enumerate(features):
        weight, h = sum(gain[b] for b in f), int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        want[i] = [n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    long = sorted((i for i in want if want[i][0] >= 20), key=lambda i: (-want[i][3], i))
    for k, i in enumerate(long[: 5 * len(long) // 100]):
        want[i][4] = k + 1
    assert {r.doc_id: [r.n_words, r.n_features, r.weight, r.score, r["rank"]] for r in got} == want


def test_resampling_of_hard_rows(spark, hard, empty):
    assert importance.resample(empty, hard).collect() == []
    clash = hard.withColumns({n: F.lit("x") for n in ("rank", "score", "weight", "n_words", "scan_at", "scan_part", "scan_start", "bucket")})
    rows = importance.resample(clash, empty, share=100, least=1).collect()
    assert len(rows) == len(HARD) and {r.scan_at for r in rows} == {"x"}
    assert sorted(r["rank"] for r in rows if r.n_words) == list(range(1, 1 + sum(r.n_words > 0 for r in rows)))
    twice = importance.resample(hard.unionByName(hard), hard, share=100, least=1).collect()
    assert len(twice) == 2 * len(HARD) and len({r["rank"] for r in twice if r.n_words}) == sum(r.n_words > 0 for r in twice)
