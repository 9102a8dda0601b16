import random

import numpy as np
import xxhash

from slatewise.llm.components import connected_components
from slatewise.llm.simhash import band_masks, drop_near_duplicates, fingerprint, fingerprint_links, near_duplicates
from tests.llm.helpers import documents, rows, words_text


def plain_print(text, n=3):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split(" ")
    words = [w for part in words for w in part.replace("\t", "\n").split("\n") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, bits=3):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(prints))]


def test_masks_leave_no_pair_out():
    masks, rng = band_masks(3, 2), random.Random(0)
    for _ in range(2000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_documents(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "One", "one", "a b", "\x1cx é"]
    for _ in range(15):
        words = words_text(rng, 300).split()
        texts.append(" ".join(words))
        for _ in range(4):
            words = list(words)
            words[rng.randrange(300)] = "zzz"
            texts.append(" ".join(words))
    ids = [None if i % 17 == 5 else 1000 - i for i in range(len(texts))]
    prints = [plain_print(t) for t in texts]
    assert [fingerprint((t or "").encode()) % 2**64 for t in texts] == prints
    want = sorted(((d, p if p < 2**63 else p - 2**64, c) for d, p, c in zip(ids, prints, plain_components(prints, ids))), key=repr)
    assert rows(near_duplicates(documents(spark, texts, ids))) == want
    assert len({c for _, _, c in want}) < len(want) - 20
    assert near_duplicates(documents(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    docs = documents(spark, ["a b c d", "a b c d", "a b c d", None, "", "other words stand here now", "x y z"], [4, 2, 2, 9, 8, None, 1])
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "other words stand here now"), (1, "x y z"), (2, "a b c d"), (8, "")]


def test_crowded_bands_lose_no_link(spark):
    """Chains of fingerprints that agree in most bands, dealt into many small cells."""
    rng = np.random.default_rng(5)
    fps = {0}
    for _ in range(600):
        fps.add(int(rng.choice(sorted(fps))) ^ (1 << int(rng.integers(0, 24))) ^ (1 << int(rng.integers(0, 24))) ^ (1 << int(rng.integers(0, 24))))
    fps = sorted(fps) + [int(x) for x in rng.integers(1 << 50, 1 << 62, 100)]
    table = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    roots = {r["node"]: r["root"] for r in connected_components(fingerprint_links(table, 3, cell=16)).collect()}
    want = plain_components(fps, fps)
    assert [roots.get(f, f) for f in fps] == want
    links = fingerprint_links(table, 3, cell=512).count()
    assert links <= 10 * len(fps)


def test_components(spark):
    links = [(i, i + 1) for i in range(300)] + [(400, 401), (401, 400), (5, 5), (900, 901), (902, 900), (901, 905)] + [(2000, i) for i in range(2001, 2400)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "src bigint, dst bigint")).collect()}
    assert all(found[i] == 0 for i in range(301)) and found[401] == 400 and {found[i] for i in (900, 901, 902, 905)} == {900}
    assert all(found[i] == 2000 for i in range(2000, 2400))
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0
