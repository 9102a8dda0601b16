"""Language identification by hierarchical discrimination.

A text becomes a unit vector of hashed byte trigrams. Linear support vector machines first tell the language's family (one
against the rest); inside the family, one machine for every pair of its languages decides which of the two is likelier, and
the language that wins most duels, then by the larger sum of margins, is the answer.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slatewise.llm.common import map_rows

UNKNOWN = "und"
BITS = 11
BUCKETS = 1 << BITS
#: Rows to learn from: at most so many of a language, and so many in all (a documented bound on the fit alone).
SAMPLE_PER_LANGUAGE = 300
SAMPLE = 3000
#: Every CHECK_FOLDS-th document, by the checksum of its id, is kept from learning.
CHECK_FOLDS = 5
#: Characters at which another limit of the score begins, the share of held-out documents beyond it that sets it, the steps in
#: which margins are counted for it, the parts in which a doubtful text is looked at again, and their least length.
BANDS = (32, 128, 512)
CLEAN_LOSS = 0.01
STEPS = 1 << 16
PASSAGES, LEAST_PASSAGE = 8, 100
#: Text turned into trigrams at once.
AT_ONCE = 1 << 20

# Families of related languages. Any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
FAMILY_OF = {language: family for family, members in FAMILIES.items() for language in members}

# Letters and bytes beyond ASCII stay, all else is a space.
_PLAIN = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")


def trigrams(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams of the whole lower-cased text, roots taken, scaled to length one."""
    data = b" " + text.lower().encode("utf-8", "replace").translate(_PLAIN) + b" "
    counts = np.zeros(BUCKETS)
    for start in range(0, len(data) - 2, AT_ONCE):
        part = np.frombuffer(data, np.uint8, min(AT_ONCE + 2, len(data) - start), start).astype(np.uint32)
        codes = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
        codes = codes[(codes & 0xFFFF) != 0x2020]
        counts += np.bincount((codes * np.uint32(2654435761)) // np.uint32(1 << 32 - BITS), minlength=BUCKETS)
    vector = np.sqrt(counts)
    return (vector / max(np.sqrt(counts.sum()), 1e-12)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 150) -> np.ndarray:
    """Weights (the last one is the offset) of least squared hinge loss over unit vectors, both classes weighing the same."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float32)
    y = y.astype(np.float32)
    weight = y * np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    step = np.float32(1 / (2 * 2 + penalty))
    w = ahead = np.zeros(x.shape[1], dtype=np.float32)
    for i in range(rounds):
        short = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (np.float32(penalty) * ahead - 2 * ((weight * short) @ x))
        ahead = new + np.float32(i / (i + 3)) * (new - w)
        w = new
    return w


class LanguageModel:
    """Machines of one fit. Without languages every text is ``und``; a sole language is every text's answer."""

    def __init__(self, languages: np.ndarray, x: np.ndarray) -> None:
        self.languages = sorted(set(languages))
        family = np.array([FAMILY_OF.get(language, language) for language in languages], dtype=object)
        self.families = sorted(set(family))
        self.members = {f: [la for la in self.languages if FAMILY_OF.get(la, la) == f] for f in self.families}
        self.family_weights = np.array([linear_svm(x, np.where(family == f, 1.0, -1.0)) for f in self.families if len(self.families) > 1])
        self.pair_weights = {}
        for members in self.members.values():
            for a, b in combinations(members, 2):
                of = (languages == a) | (languages == b)
                self.pair_weights[a, b] = linear_svm(x[of], np.where(languages[of] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each row and how sure that is: the logistic value of the smaller of the deciding margins."""
        n = len(x)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n)
        x = np.column_stack([x, np.ones(n)]).astype(np.float32)
        if len(self.families) > 1:
            margins = x @ self.family_weights.T
            chosen, margin = margins.argmax(axis=1), margins.max(axis=1)
        else:
            chosen, margin = np.zeros(n, dtype=int), np.full(n, 10.0)
        out = np.empty(n, dtype=object)
        for number, family in enumerate(self.families):
            rows = np.flatnonzero(chosen == number)
            members = self.members[family]
            if len(rows) and len(members) == 1:
                out[rows] = members[0]
            elif len(rows):
                wins, sums = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
                closest = np.full((len(rows), len(members)), np.inf)
                for (a, b), w in self.pair_weights.items():
                    if a in members:
                        duel = x[rows] @ w
                        for language, value in ((members.index(a), duel), (members.index(b), -duel)):
                            wins[:, language] += value > 0
                            sums[:, language] += value
                            closest[:, language] = np.minimum(closest[:, language], value)
                best = (wins + 1e-6 * np.tanh(sums)).argmax(axis=1)
                out[rows] = np.array(members, dtype=object)[best]
                margin[rows] = np.minimum(margin[rows], closest[np.arange(len(rows)), best])
        return out.tolist(), 1 / (1 + np.exp(-4 * margin))

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        for start in range(0, len(rows), 256):
            part = rows[start : start + 256]
            languages, scores = self.predict(np.stack([trigrams(texts[i]) for i in part]))
            for i, language, score in zip(part, languages, scores):
                out[i] = (language, float(score) if language != UNKNOWN else 0.0)
        return out


def held_out(folds: int = CHECK_FOLDS, rest: int = 0) -> Column:
    """The checksum of doc_id falls on ``rest``. Null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == rest


def _labelled(docs: DataFrame, held: bool) -> DataFrame:
    """The labelled rows whose text has a letter, the held-out ones or the others."""
    mine = held_out() if held else ~held_out()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(mine & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))


def _sample(docs: DataFrame) -> list[tuple[str, np.ndarray]]:
    """Language and trigrams of a hash sample of at most SAMPLE labelled rows that are not held out."""
    labelled = _labelled(docs, held=False)
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE // 20).collect()
    each = min(SAMPLE_PER_LANGUAGE, SAMPLE // max(1, len(counts)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    chance = F.lit(0.0)
    for row in counts:
        chance = F.when(F.col("lang") == row["lang"], F.lit(min(1.0, each / row["count"]))).otherwise(chance)
    sample = labelled.filter(draw < chance).select("lang", "text").limit(2 * SAMPLE)
    rows = map_rows(sample, "lang string, x binary", lambda: lambda langs, texts: [(la, trigrams(t).tobytes()) for la, t in zip(langs, texts)]).collect()
    return [(la, np.frombuffer(x, dtype=np.float32)) for la, x in sorted((r["lang"], bytes(r["x"])) for r in rows)]


def fit_language_model(docs: DataFrame) -> LanguageModel:
    """Learn from text and lang of the documents that are not held out: a hash sample of at most SAMPLE rows in all."""
    rows = _sample(docs)
    x = np.stack([r[1] for r in rows]) if rows else np.empty((0, BUCKETS), dtype=np.float32)
    return LanguageModel(np.array([r[0] for r in rows], dtype=object), x)


def fit_limits(model: LanguageModel, docs: DataFrame) -> np.ndarray:
    """The least score of a recognisable language for each band of lengths: that of half the margin which all but 1 % of the
    held-out labelled documents of the band exceed, of all of them. A band without any has the limit 0.

    Spark counts the margins in steps of 1 / STEPS, so a band's running count has a bounded number of rows.
    """
    limits = np.zeros(len(BANDS) + 1)
    if not model.languages:
        return limits
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        label = sent.value.label
        band = lambda text: int(np.searchsorted(BANDS, len(text), side="right"))
        step = lambda score: int(np.floor(np.log(score / (1 - score)) * STEPS))
        return lambda texts: [(band(t), step(np.clip(score, 1e-12, 1 - 1e-12))) for t, (_, score) in zip(texts, label(texts))]

    steps = map_rows(_labelled(docs, held=True).select("text"), "band int, step bigint", make).groupBy("band", "step").agg(F.count(F.lit(1)).alias("n"))
    placed = steps.withColumn("upto", F.sum("n").over(Window.partitionBy("band").orderBy("step"))).withColumn("all", F.sum("n").over(Window.partitionBy("band")))
    place = (F.col("all") - 1) * CLEAN_LOSS
    at = lambda number: F.min(F.when(F.col("upto") > number, F.col("step")))
    found = placed.groupBy("band").agg(at(F.floor(place)).alias("below"), at(F.ceil(place)).alias("above"), F.max(place - F.floor(place)).alias("share"))
    for row in found.collect():  # a row per band
        below, above = (1 / (1 + np.exp(-row[name] / STEPS)) for name in ("below", "above"))
        low = np.clip(below + (above - below) * row["share"], 0.5, 1 - 1e-12)
        limits[row["band"]] = 1 / (1 + np.exp(-np.log(low / (1 - low)) / 2))
    return limits


def recognisable(model: LanguageModel, limits: np.ndarray, texts: list[str | None]) -> list[bool]:
    """Texts with a letter whose score reaches the limit of their length, as a whole or in at least half of up to PASSAGES parts,
    since a text of two languages has no sure language as a whole. All texts with a letter if nothing was learned."""
    reached = lambda text, score: score >= limits[np.searchsorted(BANDS, len(text), side="right")]
    out = []
    for text, (language, score) in zip(texts, model.label(texts)):
        good = bool(text and _LETTER.search(text)) if not model.languages else language != UNKNOWN
        if good and model.languages and not reached(text, score):
            step = max(LEAST_PASSAGE, -(-len(text) // PASSAGES))
            parts = [text[i : i + step] for i in range(0, len(text), step)] if len(text) >= 2 * LEAST_PASSAGE else []
            sure = [language != UNKNOWN and reached(part, score) for part, (language, score) in zip(parts, model.label(parts))]
            good = 2 * sum(sure) >= len(sure) > 0
        out.append(good)
    return out


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1), one row per row of ``docs``.

    Text that is null or has no letter is ``und`` with score 0, as is every text if there is nothing to learn from. A row
    without doc_id is not held out and not learned from either. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_language_model(docs))  # SAMPLE rows bound the number of languages

    def make():
        label = model.value.label
        return lambda ids, out, texts: [(i, h, *p) for i, h, p in zip(ids, out, label(texts))]

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return map_rows(chosen, "doc_id bigint, held_out boolean, lang_pred string, score double", make)


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a recognisable language, all columns as they are."""
    model = fit_language_model(docs)
    fitted = docs.sparkSession.sparkContext.broadcast((model, fit_limits(model, docs)))

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        return pd.Series(recognisable(*fitted.value, texts.tolist()), dtype=bool)

    return docs.filter(known("text"))
