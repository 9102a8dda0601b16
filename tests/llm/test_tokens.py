import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from slatewise.llm.bpe import ByteBpe, bpe_round_trip, decode_ids, encode_texts
from slatewise.llm.packing import Capacity, best_fit, pack, sequences, token_pieces
from tests.llm.helpers import documents, rows, words_text

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)
PARTS = [" ", "  ", "\n", "\t", " ", "　", "\x85", "\x1c", "a", "thou", "The", "é", "à", "ß", "𝒳", "中文", "1", "½", "'s", "'", "!!", "###", "<|endoftext|>", "_", "don't", " ", "\r\n", "\x0b", "́", "😀", "aaaaaaaa"]


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(open(FILE, "rb").read())


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def mixed(count):
    rng = random.Random(11)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(count)]


def test_encodes_and_decodes_as_the_library(bpe):
    for text in mixed(4000):
        ids = ids_of(text)
        assert bpe.encode(text) == ids, text
        assert bpe.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)
    assert bpe.encode("a" * 100_000) == ids_of("a" * 100_000)
    cut = [i for i in range(0, 50_256, 997)]
    assert bpe.decode(cut) == LIBRARY.decode(cut, skip_special_tokens=False)


def test_short_and_long_merges_agree(bpe):
    rng = random.Random(4)
    for _ in range(300):
        data = [bpe.single[b] for b in bytes(rng.choice(b"aehint ou") for _ in range(rng.randint(1, 40)))]
        assert bpe._merge_short(list(data)) == bpe._merge_long(list(data))
    words = [bytes(rng.choice(b"aehint \xc3\xa9!") for _ in range(rng.randint(1, 40))) for _ in range(500)] + [b"x"]
    assert bpe._merge_many(words) == [np.array(bpe.merge(w), dtype="<u4").tobytes() for w in words]
    assert bpe._merge_many([b"a", b"b"]) == [np.array(bpe.merge(w), dtype="<u4").tobytes() for w in (b"a", b"b")]


def test_batches_encode_as_single_texts():
    texts = mixed(1500) + ["", " ", "  ", "Hello  world ", "voilà à a", "a" * 100, "x", "x ", " x"] + ["the end\n", "one <|endoftext|> two"]
    fresh = ByteBpe(open(FILE, "rb").read())
    for _ in range(2):
        assert [np.frombuffer(p, dtype="<u4").tolist() for p in fresh.encode_batch(texts)] == [ids_of(t) for t in texts]
    assert fresh.encode_batch([]) == [] and fresh.encode_batch([""]) == [b""]


def test_no_token_spans_a_cut(bpe):
    for token in bpe.ids:
        assert bpe.cut(token) == [token]


def test_round_trip_rows(spark):
    texts = [None, "", "Hello  world", "Hello  world", "é <|endoftext|> x", "word " * 50_000]
    ids = [0, 1, 2, 2, None, 5]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(ids_of(t or "")), sha(",".join(map(str, ids_of(t or "")))), sha(t or "")) for i, t in zip(ids, texts)]
    docs = documents(spark, texts, ids)
    assert rows(bpe_round_trip(docs, FILE)) == sorted(want, key=repr)
    assert rows(decode_ids(encode_texts(docs, FILE), FILE)) == sorted(((i, t or "") for i, t in zip(ids, texts)), key=repr)
    assert bpe_round_trip(documents(spark, []), FILE).count() == 0


def test_pieces_and_sequences(spark):
    rng = random.Random(8)
    texts = [None, "", "one", "one", *(words_text(rng, rng.randint(1, 400)) for _ in range(60)), words_text(rng, 9000)]
    ids = [0, 1, 2, 2, *range(4, len(texts))]
    docs = documents(spark, texts, ids)
    pieces = token_pieces(docs, FILE, 256, with_ids=True)
    for shard in (4096, 16):
        packed = pack(pieces, Capacity(tokens=256), shard).toPandas()
        for _, group in packed.groupby("sequence_id"):
            group = group.sort_values("offset")
            assert (group["offset"] == group["length"].cumsum() - group["length"]).all() and group["length"].sum() <= 256
        want = sorted((i, len(ids_of(t or "")) + 1) for i, t in zip(ids, texts))
        assert sorted((d, n) for d, n in packed.groupby("doc_id")["length"].sum().items() if d != 2) == [w for w in want if w[0] != 2]
        assert packed["sequence_id"].nunique() <= 1.1 * packed["length"].sum() / 256 + len(packed) / shard + 1
    for doc, text in ((len(texts) - 1, texts[-1]), (4, texts[4])):
        whole = np.array([*ids_of(text), 0], dtype="<u4")
        for r in packed[packed["doc_id"] == doc].itertuples():
            part = whole[r.start : r.start + r.length]
            assert zlib.crc32(part.tobytes()) == r.ids_crc32 and part.tolist() == list(r.ids)
        assert (packed[packed["doc_id"] == doc].sort_values("piece")["length"].iloc[1:] == 256).all()
    joined = {r["sequence_id"]: r["ids"] for r in sequences(pack(pieces, Capacity(tokens=256))).collect()}
    assert sum(map(len, joined.values())) == packed["length"].sum() and max(map(len, joined.values())) <= 256
    assert pack(token_pieces(documents(spark, []), FILE), Capacity()).count() == 0


@pytest.mark.parametrize("fit", ["norm", "dot"])
def test_every_capacity_holds(fit):
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 100, 500))[::-1]
    capacity = Capacity(100, 3, 6000 + 4000, fit=fit)
    sequence, offset = best_fit(lengths, capacity)
    for s in set(sequence):
        part = lengths[sequence == s]
        assert part.sum() <= 100 and len(part) <= 3 and (part**2).sum() <= 10_000
        assert sorted(offset[sequence == s]) == sorted(np.cumsum(part) - part)
    assert len(set(sequence)) <= 1.15 * max(lengths.sum() / 100, len(lengths) / 3) + 2
    with pytest.raises(ValueError):
        best_fit(np.array([101]), capacity)
