import hashlib
import random
import zlib

import numpy as np

from slatewise.llm.queries import llm_queries
from slatewise.llm.runs import collapse, lag_scan, periodic_runs, planted, surviving_segments, word_runs
from slatewise.llm.common import table
from tests.llm.helpers import documents

TINY = "/root/testdata/sf0.001"


def plain_words(text):
    return [w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in text or "").split(" ") if w]


def plain_runs(words):
    """Every maximal stretch of every lag, kept if no smaller lag has the same stretch."""
    found = {}
    for lag in range(1, len(words) // 4 + 1):
        at = 0
        while at + lag < len(words):
            end = at
            while end + lag < len(words) and words[end] == words[end + lag]:
                end += 1
            if end > at and end + lag - at >= max(6, 4 * lag):
                found.setdefault((at, end + lag), lag)
            at = max(end, at + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_collapse(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def plain_planted(doc_id, text):
    words = plain_words(text)
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def plain_row(doc_id, text):
    words = plain_planted(doc_id, text)
    runs = plain_runs(words)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(plain_collapse(words, runs))))


def texts(rng, many):
    """Sequences over few words: squares of squares, runs of runs, nearly periodic stretches and noise."""
    for _ in range(many):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 4)):
            if words and rng.random() < 0.7:
                a = rng.randrange(len(words))
                unit = words[a : a + rng.randint(1, 9)]
                words[a:a] = (unit * rng.randint(2, 9))[: rng.randint(1, 90)]
            words += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))]
        yield words


def test_runs_equal_brute_force():
    seen = 0
    for words in texts(random.Random(5), 1500):
        runs = word_runs(words)
        assert runs == plain_runs(words)
        assert collapse(words, runs) == plain_collapse(words, runs)
        seen += len(runs)
    assert seen > 1000


def test_segments_hold_every_run_and_only_frequent_words():
    for words in texts(random.Random(6), 300):
        segments = surviving_segments(words)
        for a, b in segments:
            assert min(words[a:b].count(w) for w in words[a:b]) >= 4
        for start, length, _ in plain_runs(words):
            assert any(a <= start and start + length <= b for a, b in segments)


def test_long_texts_take_no_quadratic_time():
    """A hundred thousand equal words; a long period; and words that become too rare one after the other."""
    assert word_runs(["a"] * 100_000) == [(0, 100_000, 1)]
    unit = [f"w{i}" for i in range(20_000)]
    assert word_runs(unit * 4 + ["end"]) == [(0, 80_000, 20_000)]
    peeled = [str(i // 2) for i in range(30_000)] + [str(i) for i in range(15_000)] + [str(i) for i in range(15_000)][::-1]
    assert word_runs(peeled) == []
    assert lag_scan(np.array([1, 2] * 50_000)) == [(0, 100_000, 2)]


def test_awkward_rows(spark):
    rng = random.Random(7)
    whole = [None, "", " \n\t ", "one", "a " * 6, "  " * 7 + "\x1c", "x y " * 4, "x y " * 3, " ".join(rng.choice("abcdefgh") for _ in range(3000)), "long " * 1000]
    whole += [" ".join(words) for words in texts(rng, 60)]
    ids = [None, *range(1, len(whole) - 1), 7]
    docs = documents(spark, whole, ids)
    from slatewise.llm.runs import runs_digest

    got = sorted(map(tuple, runs_digest(periodic_runs(planted(docs))).collect()), key=repr)
    assert got == sorted((plain_row(i, t) for i, t in zip(ids, whole)), key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids) > 3
    found = periodic_runs(docs.filter("text LIKE 'x y x y x y x y%'")).select("runs", "collapsed").first()
    assert found["collapsed"] == "x y" and tuple(found["runs"][0]) == (0, 8, 2)
    long = runs_digest(periodic_runs(documents(spark, ["long " * 200_000]))).first()
    assert (long["n_runs"], long["start"], long["length"], long["period"], long["exponent_milli"]) == (1, 0, 200_000, 1, 200_000_000)
    assert runs_digest(periodic_runs(planted(documents(spark, [])))).count() == 0


def test_query_equals_brute_force(spark):
    want = [plain_row(d, t) for d, t in table(spark, TINY, "documents").select("doc_id", "text").collect()]
    got = llm_queries()["op11_periodic_runs"].run(spark, TINY)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
