import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from slatewise.llm.common import table
from slatewise.llm.queries import RANKS, llm_queries
from slatewise.llm.ranked_bpe import LONG, RankedBpe, decode_ids, encode_texts, ranked_round_trip
from tests.llm.helpers import documents

TINY = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(RANKS)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return RankedBpe(open(PATH, "rb").read())


def row(library, doc_id, text):
    ids = library.encode_ordinary(text or "")
    return (doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_split_texts_equal_whole_texts(library, bpe):
    """Long texts of every kind of white space, marks and letters, with and without safe boundaries."""
    rng = random.Random(2)
    alphabet = [*"abc019'.-!", "'s", "'ll", " ", "  ", "\n", "\n\n ", "\t", " ", " ", "　", "\x1c", "\x85", "é", "ж", "中", "🙂", "é", "<|endoftext|>"]
    for _ in range(6):
        text = "".join(rng.choice(alphabet) for _ in range(3 * LONG))
        assert len(list(bpe.parts(text))) > 2
        assert bpe.encode(text) == library.encode_ordinary(text)
        assert "".join(bpe.parts(text)) == text
    for text in ["x" * (2 * LONG), " " * (2 * LONG), "1" * LONG + "a b" * LONG, "\n" * (2 * LONG) + "x", " a" * LONG]:
        assert bpe.encode(text) == library.encode_ordinary(text)


@pytest.mark.parametrize("tail", ["", "x", "\n", "1 y"])
def test_white_space_that_the_pattern_engine_cannot_take(library, bpe, tail):
    """What the library says of the same run, shorter: one match of all but the last character before a word."""
    ids = bpe.encode("word" + " " * 1_500_000 + tail)
    assert bpe.decode(ids) == ("word" + " " * 1_500_000 + tail).encode()
    with pytest.raises(BaseException):
        library.encode_ordinary(" " * 1_500_000)
    for wide in (150_000, 120_001):
        text = "word" + " " * wide + tail + " " * wide + tail
        assert bpe.encode(text) == library.encode_ordinary(text)


def test_awkward_rows(spark, library):
    texts = [None, "", " ", "one", "one", "\x00\x1c ", "<|endoftext|>", "é" * 5000, "many words " * 40_000, "日本語のテキスト", "🙂🙂 \U0010ffff"]
    ids = [5, 5, None, *range(len(texts) - 3)]
    docs = documents(spark, texts, ids)
    got = sorted(map(tuple, ranked_round_trip(docs, PATH).collect()), key=repr)
    assert got == sorted((row(library, i, t) for i, t in zip(ids, texts)), key=repr)
    assert ranked_round_trip(documents(spark, []), PATH).count() == 0
    encoded = encode_texts(docs, PATH)
    assert sorted(bytes(r["data"]) for r in decode_ids(encoded, PATH).collect()) == sorted((t or "").encode() for t in texts)
    # Ids of half a character are bytes, not replacement characters.
    half = library.encode_ordinary("🙂")[:1]
    halves = spark.createDataFrame([(1, half), (2, None)], "doc_id bigint, ids array<int>")
    assert {r["doc_id"]: bytes(r["data"]) for r in decode_ids(halves, PATH).collect()} == {1: library.decode_bytes(half), 2: b""}


def test_query_equals_the_library(spark, library):
    want = [row(library, d, t) for d, t in table(spark, TINY, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, llm_queries()["op12_ranked_bpe"].run(spark, TINY).collect())) == sorted(want)
