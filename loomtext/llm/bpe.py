"""Problem 7: byte-level BPE encoding of a corpus with a public tokenizer's vocabulary.

A piece of text is a doubly linked list of symbols with a priority queue of merge ranks; entries of the queue whose
symbols have since been merged are stale and skipped.  Decoding concatenates the vocabulary's strings.  Strings of
special tokens inside a text are ordinary text.  Empty and null texts both give an empty list.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import returned, sent, sent_type, ship, spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The largest tokenizer file that is sent along.
VOCABULARY_BYTES = 64 << 20
#: Fixed value: how texts are cut into pieces before merging.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary: itself, or the next one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class ByteBpe:
    """Encoder and decoder; the memo of pieces is bounded and changes nothing but speed."""

    def __init__(self, file: str | bytes = DEFAULT_VOCABULARY, memo: int = 200_000) -> None:
        """``file``: the tokenizer's file, by path or as it is."""
        model = json.loads(Path(file).read_bytes() if isinstance(file, str) else file)["model"]
        self.letters = byte_letters()
        to_byte = {c: i for i, c in enumerate(self.letters)}
        self.vocabulary: dict[str, int] = model["vocab"]
        self.strings: dict[int, bytes] = {}
        for s, i in self.vocabulary.items():
            self.strings[i] = bytes(to_byte[c] for c in s) if all(c in to_byte for c in s) else s.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[self.vocabulary[a], self.vocabulary[b]] = (rank, self.vocabulary[a + b])
        self.of_byte = [self.vocabulary[c] for c in self.letters]
        self.memo: dict[str, list[int]] = {}
        self.memo_size = memo

    def merge(self, piece: bytes) -> list[int]:
        """Merge one piece: lowest rank first, leftmost among equals."""
        ids = [self.of_byte[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        merges, alive, heap = self.merges, [True] * n, []
        for i in range(n - 1):
            if (m := merges.get((ids[i], ids[i + 1]))) is not None:
                heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != left or ids[j] != right:
                continue  # stale: one of the two symbols is no longer what it was
            ids[i] = new
            alive[j] = False
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (m := merges.get((new, ids[k]))) is not None:
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))) is not None:
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [x for x, a in zip(ids, alive) if a]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, out = self.memo, []
        for piece in PIECES.findall(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "replace"))
                if len(memo) >= self.memo_size:
                    memo.clear()
                if len(piece) <= 64:
                    memo[piece] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(file: str | bytes) -> ByteBpe:
    """One for each Python worker."""
    return ByteBpe(file)


def sent_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer's file, read by the driver and sent along, so that workers need no copy; its size is checked."""
    size = Path(path).stat().st_size
    if size > VOCABULARY_BYTES:
        raise ValueError(f"{path} has {size} bytes, more than {VOCABULARY_BYTES}")
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids ARRAY<INT>): one row for each row of ``df``.

    Null and empty texts: an empty list.  Very long texts: encoded whole.  Repeated rows: a row each.  An empty table:
    no rows.  Other columns are not read, so their names cannot clash.
    """
    ship(df.sparkSession)
    file = sent_vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(file.value)
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "ids": [bpe.encode(t) for t in b["t"]]})

    out = spread(df.select(sent(df, key, "k"), F.col(text).alias("t"))).mapInPandas(run, f"k {sent_type(df, key)}, ids array<int>")
    return out.select(returned(df, key, "k"), "ids")


def decode_column(df: DataFrame, key: str, ids: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, text): the inverse of :func:`encode_column`; a null list gives null, an empty one ''."""
    ship(df.sparkSession)
    file = sent_vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(file.value)
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "text": [None if x is None else bpe.decode(x) for x in b["i"]]})

    out = df.select(sent(df, key, "k"), F.col(ids).alias("i")).mapInPandas(run, f"k {sent_type(df, key)}, text string")
    return out.select(returned(df, key, "k"), "text")
