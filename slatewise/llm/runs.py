"""Runs of words that repeat with a period, by recursive frequency splitting.

A run of period q has at least four times q words (and six), so each of its words stands in it at least four times. A word
that occurs fewer times in a segment is in none of the segment's runs and cuts it; in the smaller segments more words become
too rare, until nothing changes. What survives is scanned lag by lag: four words in a row, each one lag behind the last, are
the sign of a run, whose ends are then found by comparison.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.llm.common import map_rows, text_bytes

#: A run has this many periods and words at least.
PERIODS, SHORTEST = 4, 6


def surviving_segments(words: list[int]) -> list[tuple[int, int]]:
    """Segments [start, end) in which every word occurs at least four times.

    Of the parts of a cut segment only the largest keeps its counts, less what the others took away, so that the work is
    within the logarithm of the length of linear, whatever the text.
    """
    places: dict[int, list[int]] = {}
    for at, word in enumerate(words):
        places.setdefault(word, []).append(at)
    out, work = [], [(0, len(words), {w: len(p) for w, p in places.items()}, list(places))]
    while work:
        start, end, counts, changed = work.pop()
        if end - start < SHORTEST:
            continue
        cuts = []
        for word in changed:
            if 0 < counts[word] < PERIODS:
                known = places[word]
                first = bisect_left(known, start)
                cuts += known[first : first + counts[word]]
        if not cuts:
            out.append((start, end))
            continue
        cuts.sort()
        parts = [(a, b) for a, b in zip([start, *(c + 1 for c in cuts)], [*cuts, end]) if b - a >= SHORTEST]
        if not parts:
            continue
        largest = max(parts, key=lambda part: part[1] - part[0])
        for a, b in parts:
            if (a, b) != largest:
                fresh = Counter(words[a:b])
                work.append((a, b, fresh, list(fresh)))
        lost = words[start : largest[0]] + words[largest[1] : end]
        for word in lost:
            counts[word] -= 1
        work.append((*largest, counts, list(set(lost))))
    return sorted(out)


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements of two equally long arrays agree."""
    done, size = 0, 32
    while done < len(a):
        differ = a[done : done + size] != b[done : done + size]
        if differ.any():
            return done + int(differ.argmax())
        done, size = done + size, size * 4
    return len(a)


def lag_scan(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run of the segment.

    Of a run with period q, four multiples of q in a row hold the same word, so a lag only looks at its multiples. A run is
    not looked at again at multiples of its period: a stretch there that is as long lies within the run.
    """
    found: list[tuple[int, int, int]] = []
    inside: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for lag in range(1, len(words) // PERIODS + 1):
        anchors = words[::lag]
        same = anchors[1:] == anchors[:-1]
        at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * lag
        if not len(at):
            continue
        known = inside.pop(lag, None)
        if known:
            known.sort()
            begins, ends = np.array(known).T
            before = np.searchsorted(begins, at, side="right") - 1
            reach = np.where(before < 0, -1, np.maximum.accumulate(ends)[before])
            at = at[at + lag >= reach]
        done = 0
        for place in at.tolist():
            if place < done:
                continue
            end = place + lag + _agreeing(words[place:-lag], words[place + lag :])
            start = place - _agreeing(words[:place][::-1], words[lag : place + lag][::-1])
            done = end - lag
            if end - start >= max(SHORTEST, PERIODS * lag):
                found.append((start, end, lag))
                for multiple in range(2 * lag, (end - start) // PERIODS + 1, lag):
                    inside[multiple].append((start, end))
    return found


def word_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period."""
    number: dict = {}
    ids = [number.setdefault(word, len(number)) for word in words]
    found = []
    for start, end in surviving_segments(ids):
        found += [(start + a, b - a, period) for a, b, period in lag_scan(np.array(ids[start:end]))]
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that some run holds behind its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, ``runs`` (an array of start, length and period, by start and then period; words are numbered from 0) and
    ``collapsed``, the text's words without the repetitions, joined by single spaces.

    Words are what white space (ASCII) separates. Null and empty texts have no words and no runs. One row per row, repeated
    rows included; columns besides doc_id and ``text`` are ignored. A text is read whole, by the task that holds its row.
    """

    def make():
        def run(ids, texts):
            out = []
            for i, data in zip(ids, texts):
                words = data.split()
                runs = word_runs(words)
                told = [dict(zip(("start", "length", "period"), r)) for r in runs]
                out.append((i, told, b" ".join(collapse(words, runs)).decode()))
            return out

        return run

    schema = "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text)), schema, make)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and ``text`` with a long run put into one document of ten.

    With h the CRC-32 of the decimal doc_id and n words, h % 10 = 0 makes every word i from a = floor(h / 10) % n on the word
    a + (i - a) % p, p = 1 + floor((n - a) / (3 + floor(h / 10) % 8)). Texts without words and rows without doc_id stay.
    """
    words = F.array_remove(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), "")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = chosen.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    split = hashed.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    counted = split.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    begun = counted.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    left = F.col("n") - F.col("a")
    period = begun.withColumn("p", (1 + F.floor(left / (3 + F.col("g") % 8))).cast("int"))
    often = F.ceil(F.col("n") / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), often)), F.lit(1), left.cast("int"))
    joined = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return period.select("doc_id", F.when(F.col("a").isNotNull(), joined).otherwise(F.col("text")).alias("text"))


def runs_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest length (ties: smallest start, then period; null without runs) and digests."""
    runs = F.col("runs")
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    sha = lambda value: F.sha2(value.cast("binary"), 256)
    told: Column = F.col("best")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        told["start"].alias("start"),
        (-told["minus"]).alias("length"),
        told["period"].alias("period"),
        F.floor(-told["minus"] * 1000 / told["period"]).alias("exponent_milli"),
        sha(lines).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
