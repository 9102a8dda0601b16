import numpy as np
from pyspark.sql import functions as F

from slatewise.llm.neighbours import Codes, encode, estimate, index, search

SCHEMA = "vec_id bigint, embedding array<float>, label int, row string, norm string"


def vectors(spark, values, ids=None):
    ids = list(range(len(values))) if ids is None else ids
    return spark.createDataFrame([(i, v, 0, "r", "n") for i, v in zip(ids, values)], SCHEMA).repartition(3)


def plain(values, ids, asked, k=5):
    out = []
    for q in np.flatnonzero(asked):
        found = []
        for c in range(len(values)):
            if ids[c] != ids[q] and len(values[c]) == len(values[q]):
                a, b = np.float32(values[q]).astype(float), np.float32(values[c]).astype(float)
                found.append((-float((a * b).sum() / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum())), ids[c]))
        out += [(ids[q], rank + 1, c, round(-s, 9)) for rank, (s, c) in enumerate(sorted(found)[:k])]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 48))
    values = [list(map(float, centres[i % 20] + rng.normal(size=48))) for i in range(1500)]
    want = plain(values, list(range(1500)), np.arange(1500) % 25 == 0)
    for codes in (Codes(), Codes(query_block=16, item_block=200, slice=64)):
        got = found(search(index(vectors(spark, values)), F.col("vec_id") % 25 == 0, codes=codes))
        assert len(got) == len(want) and len(set(got) & set(want)) >= 0.99 * len(want)


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(2)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 64)))
    items, queries = unit(2000), unit(50)
    packed, correction = encode(items, 4)
    guess, error = estimate(packed, correction, queries, 4)
    off = np.abs(guess - queries @ items.T) / error[None, :]
    assert packed.shape == (2000, 32) and 0.5 < np.sqrt((off**2).mean()) < 1.2 and (off > 4).mean() < 1e-3


def test_awkward_vectors(spark):
    one = [1.0, 0.0, 0.0]
    values = [one, one, one, [0.0] * 3, None, [1.0, None, 0.0], [float("nan"), 1.0, 0.0], [float("inf"), 1.0, 0.0], [], [1.0, 1.0], [0.0, 2.0, 0.0], [3.0, 0.0, 0.0], one]
    ids = [50, 7, 3, 100, 150, 200, 250, 300, 350, 400, 9, 1, None]
    got = found(search(index(vectors(spark, values, ids)), F.col("vec_id") % 50 == 0))
    assert got == [(50, 1, 1, 1.0), (50, 2, 3, 1.0), (50, 3, 7, 1.0), (50, 4, 9, 0.0)]
    twice = found(search(index(vectors(spark, [one, one, one], [50, 50, 3])), F.col("vec_id") % 50 == 0))
    assert twice == [(50, 1, 3, 1.0), (50, 1, 3, 1.0)]
    assert search(index(vectors(spark, [])), F.col("vec_id") % 50 == 0).count() == 0
