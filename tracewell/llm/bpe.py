"""Encoding of texts with a public byte-level BPE vocabulary (problem 6).

Merges are done with a priority queue of merge ranks over a doubly linked list of symbols; entries of the queue that no
longer fit the list are skipped when they come up. Each executor's Python worker loads the vocabulary once, from the
path given, and keeps the ids of pieces it has met.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.plans.runtime import spread

#: Where the public tokenizers lie, and the pattern that splits a text into pieces for byte_bpe_50k.
TOKENIZERS = "/opt/tokenizers"
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces that a worker remembers; when full, the memory starts anew.
REMEMBERED = 400_000

_codecs: dict[str, Codec] = {}


class Codec:
    """Encoder and decoder of one rank file (a line each: base64 of the token's bytes, its id).

    A merge's rank is the id of the joined token, as in the public file. Every single byte is a token, so any text can
    be encoded; an empty text gives no ids.
    """

    def __init__(self, path: str, pattern: str = PIECES):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, length = heapq.heappop(queue)
            left = symbol[i]
            if left is None or (j := after[i]) < 0 or len(left) + len(symbol[j]) != length:
                continue  # stale: one of the two was merged since
            symbol[i] = joined = left + symbol[j]
            symbol[j] = None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get(joined + symbol[k])) is not None:
                    heapq.heappush(queue, (r, i, length + len(symbol[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(symbol[h] + joined)) is not None:
                heapq.heappush(queue, (r, h, len(symbol[h]) + length))
        return [ranks[s] for s in symbol if s is not None]

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; none for an empty or null text. Names of special tokens are plain text."""
        ids: list[int] = []
        known = self.known
        for piece in self.split(text or ""):
            got = known.get(piece)
            if got is None:
                got = self.merge(piece.encode("utf-8", "replace"))
                if len(piece) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = got
            ids += got
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``."""
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(key, ids ARRAY<INT>) of each row of ``df``: a narrow, shuffle-free map.

    An empty or null text gives an empty list; a null key stays; repeated rows stay repeated; other columns are left
    out; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            offsets, flat = [0], []
            for x in b.column(1):
                flat += c.encode(x.as_py())
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    src = spread(df.select(key, text))
    return src.mapInArrow(run, f"`{key}` {src.dtypes[0][1]}, ids array<int>")
