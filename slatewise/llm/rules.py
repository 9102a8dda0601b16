"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are compared with those of its language. Both
references are counted by Spark over all documents that pass the base rules, for every language that has enough words; the
common words of a language are its most frequent ones. The Jensen-Shannon distance (0 to 1) of the characters must stay below
a fixed limit, that of the words below a share of the distance that a text without any common word has. Texts too short for
a histogram to mean anything, and texts whose language has no reference, are not judged by it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.common import ROWS_AT_ONCE, map_rows, stored
from slatewise.operators.scale import bounded_broadcast, top_n_per_group

CHARACTERS = ("lower", "upper", "digit", "space", "stop", "quote", "symbol", "control", "beyond")
SYMBOLS = b"#*$%&|<>"

_CLASS = np.full(256, 6, dtype=np.uint8)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[32, *range(9, 14)]] = 3
_CLASS[list(b".,;:!?")] = 4
_CLASS[list(b"'\"()-")] = 5
_CLASS[[*range(9), *range(14, 32), 127]] = 7
_CLASS[0xC0:] = 8
_CLASS[0x80:0xC0] = 9
_TRIM = b".,;:!?'\"()-"
_CONTINUATION = bytes(range(0x80, 0xC0))
_NO_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
#: Different words a task counts before it passes the counts on.
COUNTED_AT_ONCE = 100_000


@dataclass(frozen=True)
class Limits:
    """Greatest distance of the characters; greatest distance of the words as a share of that of a text without common words;
    the least characters and words for which a histogram is judged; common words of a language, and the words in all that it
    needs to have a reference."""

    characters: float = 0.3
    words: float = 0.85
    least_characters: int = 200
    least_words: int = 100
    common: int = 30
    reference_words: int = 2000


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur at least twice, first occurrences included."""
    first: dict[tuple, int] = {}
    marked = bytearray(len(words))
    for at, window in enumerate(zip(words, words[1:], words[2:])):
        before = first.setdefault(window, at)
        if before != at:
            marked[before : before + 3] = marked[at : at + 3] = b"\1\1\1"
    return sum(marked)


def measure(data: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = data.split()  # of bytes: space and 09-0D
    lines = [line for line in data.split(b"\n") if line.split()]
    word_chars = len(b"".join(words).translate(None, _CONTINUATION))
    return len(words), word_chars, len(data.translate(None, _NO_SYMBOL)), len(lines) - len(set(lines)), repeated_words(words)


def fails_base(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def character_histogram(data: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=10)[:9]


def plain_words(data: bytes) -> list[bytes]:
    """Words as they are compared: a-z for A-Z, without punctuation around them; some are empty."""
    return [word.strip(_TRIM) for word in data.lower().split()]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of two matrices of counts, to base 2; 0 where a row is empty."""
    totals = a.sum(axis=1), b.sum(axis=1)
    p, q = a / np.maximum(totals[0], 1)[:, None], b / np.maximum(totals[1], 1)[:, None]
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)
    return np.where((totals[0] > 0) & (totals[1] > 0), np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1)), 0.0)


@dataclass(frozen=True)
class Reference:
    """A language's characters by class, its common words, and how often these stand in its documents, all others last."""

    characters: np.ndarray
    place: dict[bytes, int]
    words: np.ndarray

    def word_histogram(self, data: bytes) -> np.ndarray:
        counts = [0] * len(self.words)
        for word, times in Counter(plain_words(data)).items():
            counts[self.place.get(word, -1)] += times
        return np.array(counts)

    def without_common_words(self) -> float:
        """Word distance of a text that has none of the common words."""
        none = np.zeros((1, len(self.words)))
        none[0, -1] = 1
        return float(distance(none, self.words[None])[0])


def _chosen(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("lang").alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def language_counts(docs: DataFrame) -> DataFrame:
    """lang, part, key, n: characters by class (``c``), words (``w``) and words in all (``t``) of the documents that pass the
    base rules. A task adds up its own documents, so what is shuffled grows with vocabularies and tasks, not with texts."""
    schema = "lang string, part string, key binary, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def passed_on() -> pa.RecordBatch:
            rows = [(lang, part, key, n) for (lang, part), c in counts.items() for key, n in c.items()]
            counts.clear()
            columns = zip(*rows) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.int64()))], ["lang", "part", "key", "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                for lang, data in zip(*(batch.slice(start, ROWS_AT_ONCE).column(c).to_pylist() for c in ("lang", "text"))):
                    n_words, *_, n_repeat_words = measure(data)
                    if lang is None or fails_base(n_words, n_repeat_words):
                        continue
                    words = plain_words(data)
                    counts[lang, "w"].update(word for word in words if word)
                    counts[lang, "t"][b""] += len(words)
                    counts[lang, "c"].update({bytes([i]): int(n) for i, n in enumerate(character_histogram(data)) if n})
                if sum(map(len, counts.values())) > COUNTED_AT_ONCE:
                    yield passed_on()
        yield passed_on()

    counted = _chosen(docs).filter("lang IS NOT NULL").select("lang", "text").mapInArrow(run, schema)
    return stored(counted.groupBy("lang", "part", "key").agg(F.sum("n").alias("n")), "language-counts")


def references(docs: DataFrame, limits: Limits = Limits()) -> dict[str, Reference]:
    """References of all languages with ``reference_words`` words or more in documents that pass the base rules; of equally
    frequent words the smaller one in byte order is the more common. A few dozen numbers a language reach the driver."""
    counts = language_counts(docs)
    enough = counts.filter((F.col("part") == "t") & (F.col("n") >= limits.reference_words)).select("lang", F.col("n").alias("total"))
    known = counts.join(bounded_broadcast(enough), "lang")
    top = top_n_per_group(known.filter("part = 'w'"), ["lang"], [F.col("n").desc(), F.col("key")], limits.common)
    rows = known.filter("part = 'c'").withColumn("rank", F.lit(0).cast("long")).unionByName(top).orderBy("lang", "part", "rank", "key").collect()
    out: dict[str, Reference] = {}
    for lang in dict.fromkeys(r["lang"] for r in rows):
        mine = [r for r in rows if r["lang"] == lang]
        characters = np.zeros(len(CHARACTERS))
        for r in mine:
            if r["part"] == "c":
                characters[r["key"][0]] = r["n"]
        words = [(bytes(r["key"]), r["n"]) for r in mine if r["part"] == "w"]
        rest = mine[0]["total"] - sum(n for _, n in words)
        out[lang] = Reference(characters, {w: i for i, (w, _) in enumerate(words)}, np.array([*(n for _, n in words), rest], dtype=np.float64))
    return out


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.

    Null and empty texts have no words and so fail the base rules. Where the language is null or has no reference, both
    distances are 0 and nothing but the base rules judges. Texts are read twice, once for the references. One row per row,
    repeated rows included; an empty table gives none; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(references(docs, limits))  # a few KB a language

    def make():
        known = model.value
        word_limit = {lang: limits.words * r.without_common_words() for lang, r in known.items()}

        def run(ids, langs, texts):
            out = []
            for i, lang, data in zip(ids, langs, texts):
                n_words, word_chars, *others = measure(data)
                base_failed = fails_base(n_words, others[-1])
                reference, chars, words = known.get(lang), 0.0, 0.0
                if reference is not None:
                    chars = float(distance(character_histogram(data)[None], reference.characters[None])[0])
                    words = float(distance(reference.word_histogram(data)[None], reference.words[None])[0])
                odd = reference is not None and (
                    word_chars >= limits.least_characters and chars > limits.characters or n_words >= limits.least_words and words > word_limit[lang]
                )
                out.append((i, n_words, word_chars, *others, base_failed, not base_failed and not odd, chars, words))
            return out

        return run

    schema = (
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "base_failed boolean, kept boolean, char_distance double, word_distance double"
    )
    return map_rows(_chosen(docs).select("doc_id", "lang", "text"), schema, make)
