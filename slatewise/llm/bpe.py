"""Byte-level BPE by forced boundaries.

A pair of bytes that occurs inside no token of the vocabulary can never be merged over, so every such pair in a text is a
certain cut. Texts are cut at the certain boundaries before spaces, the pieces are split by the tokenizer's own pattern,
and what that yields is cut again at every certain boundary; fragments are merged on their own, remembered, and
concatenated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from typing import Any

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.llm.common import map_rows, text_bytes

# Fixed value: the pattern of byte-level pre-tokenization. White space is the Unicode property.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
# Words, and pieces between certain cuts, in one generation of a worker's memory.
REMEMBERED = 200_000
# Longer ones are not remembered.
SHORT = 64
NEVER = np.iinfo(np.int64).max
# Characters that a batch lays out at once; a longer text is a batch of its own.
CHARACTERS_AT_ONCE = 4_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, turned around."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memory:
    """The last entries by use: when the young generation is full, it becomes the old one and what was old is forgotten."""

    def __init__(self, most: int = REMEMBERED) -> None:
        self.most, self.young, self.old = most, {}, {}

    def older(self, key):
        """The value of a key that is not young, made young again; None if it is unknown."""
        known = self.old.get(key)
        if known is not None:
            self.put(key, known)
        return known

    def put(self, key, value: bytes) -> None:
        if len(self.young) >= self.most:
            self.old = dict(self.young)
            self.young.clear()  # the same dictionary, which callers hold
        self.young[key] = value


class ByteBpe:
    """Encodes and decodes as the vocabulary file says; only plain byte-level BPE files are taken."""

    def __init__(self, file: bytes) -> None:
        spec = json.loads(file)
        model = spec["model"]
        pre = spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]
        odd = spec["normalizer"] or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or odd or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("not a plain byte-level BPE vocabulary")
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.ids = {raw(token): i for token, i in model["vocab"].items()}
        #: For a pair of ids (left * width + right): rank * width + the id that it becomes.
        self.width = 1 + max(self.ids.values(), default=0)
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            self.merges[self.ids[left] * self.width + self.ids[right]] = rank * self.width + self.ids[left + right]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: list[bytes] = [b""] * (1 + max(*self.ids.values(), *self.added.values(), 0))
        for token, i in [*self.ids.items(), *((t.encode(), i) for t, i in self.added.items())]:
            self.tokens[i] = token
        self.single = [self.ids[bytes([b])] for b in range(256)]
        #: inside[a][b]: the pair of bytes stands inside some token.
        self.inside = [bytearray(256) for _ in range(256)]
        for token in self.ids:
            for a, b in zip(token, token[1:]):
                self.inside[a][b] = 1
        #: ASCII characters behind which a space begins a new piece.
        self.ends = frozenset(chr(b) for b in range(0x21, 0x7F) if not self.inside[b][0x20])
        self.words = regex.compile(WORDS)
        self.special = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.pieces, self.words_seen = Memory(), Memory()
        self.sorted_pairs: tuple[np.ndarray, np.ndarray] | None = None

    def cut(self, data: bytes) -> list[bytes]:
        """``data`` cut at every pair of bytes that no token holds."""
        inside = self.inside
        cuts = [i for i, (a, b) in enumerate(zip(data, data[1:]), 1) if not inside[a][b]]
        return [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])] if cuts else [data]

    def merge(self, data: bytes) -> list[int]:
        """Merge the best-ranked pair, the leftmost among equals, until none is left."""
        ids = [self.single[b] for b in data]
        return self._merge_long(ids) if len(ids) > SHORT else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        width, get = self.width, self.merges.get
        never = width * width * 2
        ranks = [get(a * width + b, never) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            ids[i : i + 2] = [best % width]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] * width + ids[i + 1], never)
            if i:
                ranks[i - 1] = get(ids[i - 1] * width + ids[i], never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n steps: neighbours as a linked list, pairs in a heap."""
        width, get, n = self.width, self.merges.get, len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            pair = ids[i] * width + ids[after[i]]
            if (found := get(pair)) is not None:
                heapq.heappush(heap, (found, i, pair))

        for i in range(n - 1):
            offer(i)
        while heap:
            found, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or ids[i] * width + ids[j] != pair:
                continue
            ids[i], ids[j], after[i] = found % width, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """``encode_packed`` of every text. The texts are cut at their spaces, every different piece is split into words once,
        every different word is merged once, and the ids are laid out by gathering. A text with an uncertain boundary or a
        special token goes through ``encode_packed``."""
        out: list[bytes] = []
        begin = 0
        while begin < len(texts):
            end, chars = begin + 1, len(texts[begin])
            while end < len(texts) and chars + len(texts[end]) <= CHARACTERS_AT_ONCE:
                chars += len(texts[end])
                end += 1
            out += self._encode_some(texts[begin:end])
            begin = end
        return out

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        parts: list[str] = []
        ends, first = [], []
        for text in texts:
            split = text.split(" ")
            first.append(split[0])
            parts += split[1:]
            ends.append(len(parts))
        codes, unique = pd.factorize(np.array(parts, dtype=object)) if parts else (np.empty(0, np.int64), [])
        closed = np.array([self._closed(u) for u in unique], dtype=bool)
        flat, size = self._encode_unique(unique, closed)
        place = np.cumsum(size) - size
        each = size[codes]
        upto = np.cumsum(each)
        gathered = flat[np.repeat(place[codes] - (upto - each), each) + np.arange(upto[-1] if len(upto) else 0)]
        bounds = np.concatenate([[0], upto])
        open_before = np.concatenate([[0], np.cumsum(~closed[codes])])
        out, begin = [], 0
        for text, head, end in zip(texts, first, ends):
            # Only the last part may end uncertainly: no space follows it.
            uncertain = end > begin and (open_before[end - 1] > open_before[begin] or not self._closed(head))
            if uncertain or (self.special is not None and self.special.search(text)):
                out.append(self.encode_packed(text))
            else:
                out.append((self._piece(head) if head else b"") + gathered[bounds[begin] : bounds[end]].tobytes())
            begin = end
        return out

    def _encode_unique(self, parts, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces (each a space and a part), one behind the other, and how many each has.

        Pieces with certain ends are joined and split into words in one go: a word that begins with a space begins a piece.
        """
        words = self.words.findall("".join([" " + p for p, sure in zip(parts, closed.tolist()) if sure]))
        firsts = [i for i, w in enumerate(words) if w[0] == " "]
        bounds = iter(zip(firsts, [*firsts[1:], len(words)]))
        listed: list[str] = []
        counts = []
        for part, sure in zip(parts, closed.tolist()):
            if sure:
                begin, end = next(bounds)
                counts.append(end - begin)
            else:
                counts.append(-1)
        if -1 in counts:
            begin = 0
            for i, part in enumerate(parts):
                own = words[begin : begin + counts[i]] if counts[i] >= 0 else self.words.findall(" " + part)
                begin += max(counts[i], 0)
                counts[i] = len(own)
                listed += own
            words = listed
        codes, unique = pd.factorize(np.array(words, dtype=object)) if words else (np.empty(0, np.int64), [])
        seen, older = self.words_seen.young, self.words_seen.older
        packed = [w.encode() for w in unique]
        found = [seen.get(w) or older(w) for w in packed]
        fresh = sorted((w for w, f in zip(packed, found) if f is None and len(w) <= SHORT), key=len)
        learnt: dict[bytes, bytes] = {}
        for start in range(0, len(fresh), 10_000):
            some = fresh[start : start + 10_000]
            learnt.update(zip(some, self._merge_many(some)))
        for word, ids in learnt.items():
            self.words_seen.put(word, ids)
        found = [f if f is not None else learnt.get(w) or self._word(w) for w, f in zip(packed, found)]
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        size = np.array([len(f) for f in found], dtype=np.int64) // 4
        place = np.cumsum(size) - size
        each = size[codes]
        upto = np.cumsum(each)
        laid = flat[np.repeat(place[codes] - (upto - each), each) + np.arange(upto[-1] if len(upto) else 0)]
        ends = np.concatenate([[0], upto])[np.cumsum(np.array([0, *counts], dtype=np.int64))]
        return laid, np.diff(ends)

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair becomes, or NEVER."""
        if self.sorted_pairs is None:
            pairs = np.fromiter(self.merges.keys(), np.int64, len(self.merges))
            order = np.argsort(pairs)
            self.sorted_pairs = np.append(pairs[order], NEVER), np.append(np.fromiter(self.merges.values(), np.int64, len(pairs))[order], NEVER)
        pairs, values = self.sorted_pairs
        wanted = np.where((left >= 0) & (right >= 0), left * self.width + right, -1)
        at = np.searchsorted(pairs, wanted)
        return np.where(pairs[at] == wanted, values[at], NEVER)

    def _merge_many(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words of similar length: a row of ids and a row of pair ranks for each, merged in step.

        A pair that no token holds has no rank, so what lies on both sides of a certain cut never meets.
        """
        size = max(map(len, words))
        data = np.zeros((len(words), size), dtype=np.uint8)
        length = np.array([len(w) for w in words])
        inside = np.arange(size)[None, :] < length[:, None]
        data[inside] = np.frombuffer(b"".join(words), np.uint8)
        ids = np.where(inside, np.array(self.single)[data], -1)
        out = ids.copy()
        ranks = np.column_stack([self._ranks_of(ids[:, :-1], ids[:, 1:]), np.full(len(ids), NEVER)])
        rows, column = np.arange(len(words)), np.arange(size)
        while len(rows):
            best = ranks.argmin(axis=1)
            value = ranks[np.arange(len(rows)), best]
            going = value < NEVER
            out[rows[~going]] = ids[~going]
            rows, ids, ranks, best, value = rows[going], ids[going], ranks[going], best[going], value[going]
            if not len(rows):
                break
            at = np.arange(len(rows))
            ids[at, best] = value % self.width
            behind = column[None, :] > best[:, None]
            ids = np.where(behind, np.column_stack([ids[:, 1:], np.full(len(ids), -1)]), ids)
            ranks = np.where(behind, np.column_stack([ranks[:, 1:], np.full(len(ranks), NEVER)]), ranks)
            after = np.minimum(best + 1, size - 1)
            ranks[at, best] = np.where(best + 1 < size, self._ranks_of(ids[at, best], ids[at, after]), NEVER)
            first = np.flatnonzero(best > 0)
            ranks[first, best[first] - 1] = self._ranks_of(ids[first, best[first] - 1], ids[first, best[first]])
        length = (out >= 0).sum(axis=1)
        packed = out.astype("<u4")
        return [row[:n].tobytes() for row, n in zip(packed, length.tolist())]

    def _word(self, word: bytes) -> bytes:
        known = self.words_seen.young.get(word) or self.words_seen.older(word)
        if known is None:
            found = [x for part in self.cut(word) for x in self.merge(part)]
            known = struct.pack(f"<{len(found)}I", *found)
            if len(word) <= SHORT:
                self.words_seen.put(word, known)
        return known

    def _piece(self, piece: str) -> bytes:
        return b"".join([self._word(word.encode()) for word in self.words.findall(piece)])

    def _closed(self, part: str) -> bool:
        """The boundary between ``part`` and a following space is certain: no token holds the pair, no word spans it."""
        last = part[-1:]
        return last in self.ends or last > "\x7f" and not last.isspace() and not self.inside[last.encode()[-1]][0x20]

    def _ordinary(self, text: str) -> list[bytes]:
        young, out, open_parts = self.pieces.young, [], []
        key = ""
        for part in text.split(" "):
            key += part
            if open_parts:
                open_parts.append(key)
                if self._closed(part):
                    out.append(self._piece("".join(open_parts)))
                    open_parts = []
            elif (known := young.get(key)) is not None:
                out.append(known)
            elif self._closed(part):
                known = self.pieces.older(key)
                if known is None:
                    known = self._piece(key)
                    if len(key) <= SHORT:
                        self.pieces.put(key, known)
                out.append(known)
            else:
                open_parts.append(key)
            key = " "
        if open_parts:
            out.append(self._piece("".join(open_parts)))
        return out

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self.special is None or not self.special.search(text):
            return b"".join(self._ordinary(text))
        out, begin = [], 0
        for match in self.special.finditer(text):
            out += self._ordinary(text[begin : match.start()])
            out.append(np.array([self.added[match[0]]], dtype="<u4").tobytes())
            begin = match.end()
        return b"".join(out + self._ordinary(text[begin:]))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


class Vocabulary:
    """A vocabulary file's bytes, built into tables once per Python worker and kept for its later tasks."""

    def __init__(self, file: bytes) -> None:
        self.file = file
        self.built: Any = None

    def __getstate__(self) -> dict:
        return {"file": self.file, "built": None}

    def get(self) -> ByteBpe:
        if self.built is None:
            self.built = ByteBpe(self.file)
        return self.built


def shared_vocabulary(spark: SparkSession, path: str):
    """The file (a few MB, whatever the corpus) as a broadcast; it is read on the driver."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(Vocabulary(file.read()))


def encode_texts(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """doc_id and ``ids``, the token ids of the whole text (null: none). One row per row; other columns are ignored."""
    shared = shared_vocabulary(docs.sparkSession, vocabulary)

    def make():
        encode = shared.value.get().encode_batch
        return lambda ids, texts: [(i, np.frombuffer(p, dtype="<u4").tolist()) for i, p in zip(ids, encode([t.decode() for t in texts]))]

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text)), "doc_id bigint, ids array<int>", make)


def decode_ids(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """doc_id and ``text``, the decoded ``ids``."""
    shared = shared_vocabulary(encoded.sparkSession, vocabulary)

    def make():
        decode = shared.value.get().decode
        return lambda docs, rows: [(d, decode(r or [])) for d, r in zip(docs, rows)]

    return map_rows(encoded.select("doc_id", ids), "doc_id bigint, text string", make)


def bpe_round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: texts are encoded and decoded in one task, only digests leave it.

    Null and empty texts have no ids, and the digests of the empty text.
    """
    shared = shared_vocabulary(docs.sparkSession, vocabulary)

    def make():
        bpe = shared.value.get()
        digest = lambda data: hashlib.sha256(data).hexdigest()

        def run(docs, texts):
            out = []
            for doc, packed in zip(docs, bpe.encode_batch([t.decode() for t in texts])):
                ids = np.frombuffer(packed, dtype="<u4").tolist()
                out.append((doc, len(ids), digest(",".join(map(str, ids)).encode()), digest(bpe.decode(ids).encode())))
            return out

        return run

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()), schema, make)
