import random

import numpy as np
import pytest

from slatewise.llm import near_copies
from slatewise.llm.common import table
from slatewise.llm.near_copies import LANES, drop_near_copies, near_pairs, shingle_set, sketch
from tests.llm.helpers import documents, rows, words_text

SMALL = "/root/testdata/sf0.01"


def plain_sets(texts):
    out = []
    for text in texts:
        words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        out.append((tuple(words), {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()))
    return out


def plain_components(texts):
    """Root position of every text, over all pairs."""
    sets = plain_sets(texts)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, sa) in enumerate(sets):
        for j in range(i):
            b, sb = sets[j]
            if a == b or min(len(sa), len(sb)) >= 0.8 * max(len(sa), len(sb), 1) and len(sa & sb) >= 0.8 * len(sa | sb):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def kept_of(texts):
    return [i for i, r in enumerate(plain_components(texts)) if i == r]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return words


def test_pivots_discard_no_near_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, (40, LANES), dtype=np.uint64)
    flips = (rng.random((40, 5, LANES, 64)) < 0.13).astype(np.uint64) << np.arange(64, dtype=np.uint64)
    prints = np.concatenate([base, (base[:, None] ^ flips.sum(axis=3, dtype=np.uint64)).reshape(-1, LANES)])
    left, right, _ = near_pairs(prints)
    apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    want = {(i, j) for i in range(len(prints)) for j in range(i) if apart[i, j] <= near_copies.RADIUS}
    assert {(max(a, b), min(a, b)) for a, b in zip(left.tolist(), right.tolist())} == want and len(want) > 200


def test_sketches_of_similar_texts_meet():
    """Similarity 0.8 to 0.83: within the radius and in a common band."""
    rng = random.Random(2)
    missed = total = 0
    for _ in range(200):
        words = words_text(rng, 220).split()
        a, b = shingle_set([w.encode() for w in words]), shingle_set([w.encode() for w in edited(rng, words, 4)])
        if near_copies.jaccard(a, b) >= 0.8:
            (fa, ka), (fb, kb) = sketch(a), sketch(b)
            total += 1
            missed += np.bitwise_count(fa ^ fb).sum() > near_copies.RADIUS or not (ka == kb).any()
    assert total > 100 and missed == 0


def test_planted_near_copies(spark):
    """All links of brute force and no other: copies in chains, borderline pairs, short and empty texts, shared passages."""
    rng = random.Random(3)
    texts = [None, "", " \n ", "one", "One", "a b", "a  B", "a b c d e", "a b c d e f", "\x1cx é"]
    passage = words_text(rng, 60)
    for _ in range(40):
        words = words_text(rng, rng.randint(60, 250)).split()
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            words = edited(rng, words, rng.randint(1, 5))
            texts.append(" ".join(words))
    texts += [f"{passage} {words_text(rng, 60)}" for _ in range(30)]
    texts.append("long " + words_text(rng, 30_000))
    texts.append(texts[-1] + " more words")
    assert len(kept_of(texts)) < len(texts) - 30
    docs = documents(spark, texts, [i + 1 for i in range(len(texts))])
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] - 1 for r in kept.select("doc_id").collect()) == kept_of(texts)


@pytest.mark.parametrize("cell", [8, 40])
def test_clusters_larger_than_a_cell(spark, monkeypatch, cell):
    """Groups of near copies dealt into cells, some members joined only through one another, some not at all."""
    monkeypatch.setattr(near_copies, "CELL", cell)
    monkeypatch.setattr(near_copies, "ANCHORS", 4)
    rng = random.Random(4)
    texts = []
    for edits in (1, 3, 5, 6):
        base = words_text(rng, 120).split()
        for _ in range(60):
            texts.append(" ".join(edited(rng, base, edits)))
            if rng.random() < 0.2:
                base = edited(rng, base, 1)
    want = kept_of(texts)
    assert 20 < len(want) < 200
    assert sorted(r["doc_id"] for r in drop_near_copies(documents(spark, texts)).select("doc_id").collect()) == want


def test_awkward_rows(spark):
    docs = documents(spark, ["a b c d", "a b c d", "A b  c d", None, "", "other words stand here now", "x y z", "x y z"], [4, 2, 2, 9, 8, None, 1, None])
    kept = rows(drop_near_copies(docs).select("doc_id", "text"))
    assert [d for d, _ in kept] == [1, 2, 8, None] and {t for _, t in kept} == {"other words stand here now", "x y z", ""} | {t for d, t in kept if d == 2}
    assert drop_near_copies(documents(spark, [])).count() == 0


def test_whole_table(spark):
    docs = table(spark, SMALL, "documents")
    order = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want = [order[i]["doc_id"] for i in kept_of([r["text"] for r in order])]
    assert sorted(r["doc_id"] for r in drop_near_copies(docs).select("doc_id").collect()) == want
