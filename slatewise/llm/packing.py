"""Best-fit packing of token pieces into sequences with several capacities.

A piece demands tokens, one document place and attention cost (the square of its length). Pieces are dealt at random into
shards of some thousand pieces, each packed by one task: pieces are placed longest first, each into the open sequence with
the best fit among those that can still take it in every dimension. A shard leaves about one sequence unfilled, so the loss
against packing everything at once is a few in ten thousand and does not grow with the data.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.bpe import shared_vocabulary
from slatewise.llm.common import map_rows, stored, text_bytes

#: Pieces of a shard on average.
SHARD = 4096


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds. By default documents and attention bind no more than the tokens do."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    #: Weights of the dimensions in the fit, each first divided by its capacity.
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    #: "norm": the sequence with the smallest weighted norm of what stays free; "dot": the largest weighted product of
    #: demand and free capacity.
    fit: str = "norm"

    def array(self) -> np.ndarray:
        documents = self.tokens if self.documents is None else self.documents
        attention = self.tokens**2 if self.attention is None else self.attention
        return np.array([self.tokens, documents, attention], dtype=np.float64)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces given longest first. A piece that no empty sequence could take is an error."""
    cap = capacity.array()
    weights = np.array(capacity.weights) / cap**2
    demands = np.column_stack([lengths, np.ones(len(lengths)), lengths.astype(np.float64) ** 2])
    if len(lengths) and (demands > cap).any():
        raise ValueError("a piece exceeds the capacity of an empty sequence")
    free = np.empty((0, 3))
    number = np.empty(0, dtype=np.int64)
    least = demands.min(axis=0) if len(lengths) else cap
    room = 0
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    opened = 0
    for i, demand in enumerate(demands):
        able = np.flatnonzero((free[:room] >= demand).all(axis=1)) if room else ()
        if len(able):
            if capacity.fit == "dot":
                at = able[np.argmax((free[able] * demand) @ weights)]
            else:
                at = able[np.argmin(((free[able] - demand) ** 2) @ weights)]
        else:
            if room == len(free):
                free = np.concatenate([free, np.empty((max(64, room), 3))])
                number = np.concatenate([number, np.empty(max(64, room), dtype=np.int64)])
            at, room = room, room + 1
            free[at], number[at] = cap, opened
            opened += 1
        sequence[i], offset[i] = number[at], cap[0] - free[at, 0]
        free[at] -= demand
        if (free[at] < least).any():  # takes nothing more: the last open sequence takes its row
            room -= 1
            free[at], number[at] = free[room], number[room]
    return sequence, offset


def token_pieces(docs: DataFrame, vocabulary: str, tokens: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Every text's ids and ``end_id``; longer ones cut into pieces of ``tokens``, of which the first may be shorter.

    doc_id, piece, start, length, ids_crc32 and, with ``with_ids``, ids. A null or empty text is one piece of one token.
    """
    shared = shared_vocabulary(docs.sparkSession, vocabulary)

    def make():
        bpe, end = shared.value.get(), np.array([end_id], dtype="<u4").tobytes()

        def run(ids, texts):
            out = []
            for doc, packed in zip(ids, bpe.encode_batch([t.decode() for t in texts])):
                packed += end
                count = len(packed) // 4
                start, piece = 0, 0
                while start < count:
                    stop = start + (count % tokens or tokens) if piece == 0 else start + tokens
                    part = packed[4 * start : 4 * stop]
                    row = (doc, piece, start, stop - start, zlib.crc32(part))
                    out.append((*row, np.frombuffer(part, dtype="<u4").tolist()) if with_ids else row)
                    start, piece = stop, piece + 1
            return out

        return run

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()), schema, make)


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), shard: int = SHARD) -> DataFrame:
    """``pieces`` (a row has its ``length``) with sequence_id and offset. Equal pieces stay apart rows; an empty table packs
    to an empty table. Pieces are stored once, so that the dealing into shards is the same whenever a task is repeated."""
    fixed = stored(pieces, "pieces")
    shards = max(1, -(-fixed.count() // shard))
    dealt = fixed.withColumn("__shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        sequence, offset = best_fit(frame["length"].to_numpy(), capacity)
        return frame.assign(sequence_id=frame["__shard"] * 2**32 + sequence, offset=offset).drop(columns="__shard")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("__shard").applyInPandas(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, from pieces packed ``with_ids``. A group holds one sequence at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
