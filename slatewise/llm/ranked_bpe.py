"""Byte-level BPE by the tiktoken library and a file of ranks.

The library takes a text whole. Long texts are split first, where no match of the pattern can go on: no match holds a
character that is not white space and then white space, so every first white space behind a word is a safe boundary. Runs of
white space too long for the library's pattern engine are one match each by the pattern (all but the last character before a
word), which is encoded on its own. Ids decode to raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from typing import Any

import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.llm.common import map_rows, text_bytes

#: Characters encoded at once, about; longer texts are split.
LONG = 1 << 16
# Fixed value: the Unicode white space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: More white space in a row than this is kept from the library's pattern.
WIDE = 100_000

_SAFE = re.compile(rf"(?<=[^{WHITE}])[{WHITE}]")
_WIDE = re.compile(rf"[{WHITE}]{{{WIDE},}}")


def ranks_of(file: bytes) -> dict[bytes, int]:
    """Rank by token, from lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines()) if token}


class RankedBpe:
    def __init__(self, file: bytes, pattern: str = public_tokenizers.PATTERN) -> None:
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(file), special_tokens={})

    @staticmethod
    def parts(text: str) -> Iterator[str]:
        """``text`` in parts of about LONG characters that end at safe boundaries."""
        begin = 0
        while len(text) - begin > LONG:
            cut = _SAFE.search(text, begin + LONG)
            if cut is None:
                break
            yield text[begin : cut.start()]
            begin = cut.start()
        yield text[begin:]

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG:
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        for part in self.parts(text):
            begin = 0
            for wide in _WIDE.finditer(part):
                end = wide.end() if wide.end() == len(part) else wide.end() - 1
                out += self.encoding.encode_ordinary(part[begin : wide.start()])
                out += self.encoding._encode_single_piece(part[wide.start() : end])
                begin = end
            out += self.encoding.encode_ordinary(part[begin:])
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Raw bytes: ids need not be whole characters."""
        return self.encoding.decode_bytes(ids)


class Ranks:
    """A rank file's bytes, built into an encoding once per Python worker and kept for its later tasks."""

    def __init__(self, file: bytes) -> None:
        self.file, self.built = file, None

    def __getstate__(self) -> dict[str, Any]:
        return {"file": self.file, "built": None}

    def get(self) -> RankedBpe:
        if self.built is None:
            self.built = RankedBpe(self.file)
        return self.built


def shared_ranks(spark: SparkSession, path: str):
    """The file (under a MB, whatever the corpus) as a broadcast; it is read on the driver."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(Ranks(file.read()))


def encode_texts(docs: DataFrame, ranks: str, text: str = "text") -> DataFrame:
    """doc_id and ``ids`` of the whole text (null and empty: none). One row per row; other columns are ignored."""
    shared = shared_ranks(docs.sparkSession, ranks)

    def make():
        encode = shared.value.get().encode
        return lambda docs, texts: [(d, encode(t.decode())) for d, t in zip(docs, texts)]

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text)), "doc_id bigint, ids array<int>", make)


def decode_ids(encoded: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """doc_id and ``data``, the raw bytes of the ids (null and empty: none)."""
    shared = shared_ranks(encoded.sparkSession, ranks)

    def make():
        decode = shared.value.get().decode
        return lambda docs, rows: [(d, decode(r or [])) for d, r in zip(docs, rows)]

    return map_rows(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), ids), "doc_id bigint, data binary", make)


def ranked_round_trip(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: texts are encoded and decoded in one task, only digests leave it.

    Null and empty texts have no ids, and the digests of nothing. One row per row, repeated rows included.
    """
    shared = shared_ranks(docs.sparkSession, ranks)

    def make():
        bpe = shared.value.get()
        digest = lambda data: hashlib.sha256(data).hexdigest()

        def run(docs, texts):
            out = []
            for doc, text in zip(docs, texts):
                ids = bpe.encode(text.decode())
                out.append((doc, len(ids), digest(",".join(map(str, ids)).encode()), digest(bpe.decode(ids))))
            return out

        return run

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()), schema, make)
