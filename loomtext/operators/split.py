"""Problem 6: cutting oversized items at natural boundaries, with an overlap between consecutive pieces.

Nothing ever needs a whole item in one place.  An item is a row of *cells* of fixed size, and a worker gets a *range* of
cells with halos on both sides.  It finds the natural boundaries of its range; the first good one of a cell is the cell's
anchor, and each stretch from anchor to anchor is cut by offsets alone.  A cell's anchor depends on the text of the cell
and its surroundings only, so two ranges that meet agree on it, and the pieces are the same whatever the ranges are.  A
small table of one row for each range (its pieces, its characters) is stitched by prefix sums and gives every piece its
number and place.  Texts in a column and byte ranges of giant UTF-8 files go through the same steps.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import durable, returned, sent, sent_type, ship

#: Sizes of a range, rounded up to whole cells; of a cell, in pieces; and of the surroundings that decide on a boundary.
RANGE_CHARS = 1 << 18
RANGE_BYTES = 8 << 20
CELL_PIECES = 4
HALO = 256

#: Natural places to end a piece, best first: after a blank line, a line, a sentence, a clause, a word.
_PLACES = (
    regex.compile(r"\r?\n(?:[ \t]*\r?\n)+"),
    regex.compile(r"\r?\n"),
    regex.compile(r"(?<![.!?؟…。！？])[.!?؟…。！？]++[\"'”’»)\]]*\s+"),
    regex.compile(r"[,;:،؛]\s+"),
    regex.compile(r"\s+"),
)
_BAD_BYTE = regex.compile("[\udc80-\udcff]")
_STICKS = regex.compile(r"[\p{M}\p{Cf}\p{EMod}]")


def boundaries(text: str) -> list[list[int]]:
    """For each kind of place, the ascending positions just after one."""
    return [[m.end() for m in p.finditer(text)] for p in _PLACES]


def plan(text: str, places: Sequence[Sequence[int]], start: int, end: int, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces [from, to) of the stretch [start, end) of ``text``: each at most ``max_chars`` long, each beginning
    ``overlap`` before the end of the one before (the first one too, where something lies before it).

    A piece ends at the last place of the best kind in the second half of the room it has, else of the best kind
    anywhere in it, else (no place at all) at its limit, but not inside a letter with its marks."""
    if not 0 <= overlap < max_chars:
        raise ValueError("overlap must be at least 0 and less than max_chars")
    out: list[tuple[int, int]] = []
    done = start
    while done < end:
        a = max(0, done - overlap)
        limit = a + max_chars
        if limit >= end:
            out.append((a, end))
            break
        cut = 0
        for least in (max(done, a + max_chars // 2), done):
            for kind in places:
                k = bisect_right(kind, limit) - 1
                if k >= 0 and kind[k] > least:
                    cut = kind[k]
                    break
            if cut:
                break
        if not cut:
            cut = limit
            while cut > done + 1 and cut > limit - 32 and _STICKS.match(text, cut):
                cut -= 1
        out.append((a, cut))
        done = cut
    return out


def split_text(text: str, max_chars: int, overlap: int = 0) -> list[str]:
    """The pieces of one text (the whole text where it fits)."""
    return [text[a:b] for a, b in plan(text, boundaries(text), 0, len(text), max_chars, overlap)]


def anchor(text: str, start: int, end: int) -> int:
    """First place of the best kind within a cell [start, end) of ``text``, which has its surroundings too; where there is
    none its start, or behind the marks of the letter there."""
    for kind in boundaries(text):
        k = bisect_right(kind, start)
        if k < len(kind) and kind[k] < end:
            return kind[k]
    at = start
    while at + 1 < min(end, start + 32) and _STICKS.match(text, at):
        at += 1
    return at


def cell_size(max_chars: int) -> int:
    return max(CELL_PIECES * max_chars, 2 * HALO)


def cut(text: str, base: int, start: int, end: int, total: int, cell: int, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of the cells that begin in [start, end), as places in the whole item of ``total`` characters.  ``text`` is the
    item from ``base`` on: what lies max(HALO, overlap) before ``start`` up to a cell and a halo behind ``end``."""

    def anchor_of(at: int) -> int:
        if at <= 0 or at >= total:
            return min(max(at, 0), total)
        a, z = max(0, at - HALO), min(total, at + cell + HALO)
        return a + anchor(text[a - base : z - base], at - a, min(total, at + cell) - a)

    out = []
    at = start
    begin = anchor_of(at)
    while at < min(end, total):
        finish = anchor_of(at + cell)
        a = max(0, begin - max(HALO, overlap))
        own = text[a - base : finish - base]
        out += [(a + x, a + y) for x, y in plan(own, boundaries(own), begin - a, finish - a, max_chars, overlap)]
        at, begin = at + cell, finish
    return out


def split_items(items: DataFrame, key: str, text: str, max_chars: int, overlap: int = 0, range_chars: int = RANGE_CHARS) -> DataFrame:
    """(key, piece_no, start_pos, end_pos, piece) of each text longer than ``max_chars``; piece numbers from 0.

    Null, empty and fitting texts: no rows.  Repeated rows of a key: the pieces once (of rows that differ: the longest text).
    An item without natural places is cut at the limit.  Very long texts: cut into ranges where they are read; what is
    shuffled is each range once, with its halos.  An empty table: no rows.  Extra columns are not read.
    """
    spark = items.sparkSession
    ship(spark)
    kind = sent_type(items, key)
    cell = cell_size(max_chars)
    size = -(-range_chars // cell) * cell
    pad = max(HALO, overlap)
    many = -(-(cell + HALO) // size), -(-pad // size)  # ranges that a halo behind, and one before, may reach into

    # 1. ranges with halos, each once
    big = items.select(sent(items, key, "k"), F.length(text).alias("n"), F.xxhash64(text).alias("h"), F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("c")).where(F.length(text) > max_chars)
    before = F.expr(f"right(array_join(slice(c, greatest(1, r + 1 - {many[1]}), least(r, {many[1]})), ''), {pad})")
    behind = F.expr(f"left(array_join(slice(c, r + 2, {many[0]}), ''), {cell + HALO})")
    ranges = big.select("*", F.posexplode("c").alias("r", "own")).select("k", "n", "h", "r", "own", F.when(F.col("r") > 0, before).otherwise("").alias("before"), behind.alias("behind"))
    ranges = ranges.groupBy("k", "r").agg(F.max_by(F.struct("n", "before", "own", "behind"), F.struct("n", "h")).alias("x")).select("k", "r", "x.*")

    # 2. boundaries and pieces of each range
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, no, n, before, own, behind in zip(b["k"], b["r"], b["n"], b["before"], b["own"], b["behind"]):
                start = no * size
                base, whole = start - len(before), before + own + behind
                found = cut(whole, base, start, start + size, n, cell, max_chars, overlap)
                rows += [(k, no, i, x, y, whole[x - base : y - base]) for i, (x, y) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["k", "r", "i", "start_pos", "end_pos", "piece"])

    pieces = durable(ranges.mapInPandas(find, f"k {kind}, r int, i int, start_pos long, end_pos long, piece string"))

    # 3. stitched: one small row for each range but the first
    counts = pieces.groupBy("k", "r").agg((F.max("i") + 1).alias("m"))
    earlier = Window.partitionBy("k").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("k", "r", F.sum("m").over(earlier).alias("first")).where("r > 0").withColumnsRenamed({"k": "_k", "r": "_r"})
    placed = pieces.join(begins, F.col("k").eqNullSafe(F.col("_k")) & (F.col("r") == F.col("_r")), "left")
    number = (F.coalesce("first", F.lit(0)) + F.col("i")).cast("int")
    return placed.select(returned(items, key, "k"), number.alias("piece_no"), "start_pos", "end_pos", "piece")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, as the machine that asks knows it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _bytes(text: str) -> int:
    return len(text.encode("utf-8", "surrogateescape"))


class _Bytes:
    """A file as characters by places in bytes: a character belongs to where it begins; each bad byte is one."""

    def __init__(self, path: str, total: int) -> None:
        system, inner = _opened(path)
        self.file, self.total = system.open_input_file(inner), total

    def __enter__(self) -> _Bytes:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def raw(self, a: int, z: int) -> bytes:
        a, z = max(0, a), min(z, self.total)
        return self.file.read_at(z - a, a) if z > a else b""

    def begin(self, at: int) -> int:
        """Where the first character begins that begins at ``at`` or later."""
        if at <= 0 or at >= self.total:
            return min(max(0, at), self.total)
        low = max(0, at - 3)
        near = self.raw(low, at + 3)
        here = at - low
        for lead in range(here - 1, -1, -1):
            if not 0x80 <= near[lead] < 0xC0:
                after = lead + (4 if near[lead] >= 0xF0 else 3 if near[lead] >= 0xE0 else 2 if near[lead] >= 0xC2 else 1)
                while here < after and here < len(near) and 0x80 <= near[here] < 0xC0:
                    here += 1
                break
        return low + here

    def text(self, a: int, z: int) -> str:
        """The characters that begin in bytes [a, z)."""
        return self.raw(self.begin(a), self.begin(z)).decode("utf-8", "surrogateescape")


def split_files(spark: SparkSession, paths: Sequence[str], max_chars: int, overlap: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, piece_no, start_pos, end_pos, piece) of giant UTF-8 files, by URI (or path) in a file system that all workers reach.

    A worker reads only its byte range and halos; a cell is so many *bytes*.  Positions count code points.  A file that
    fits is one piece; an empty file has none; a missing one is an error.  Bytes that are no UTF-8 are read as U+FFFD.
    """
    ship(spark)
    cell = 4 * cell_size(max_chars)
    size = -(-range_bytes // cell) * cell
    pad = 4 * max(HALO, overlap)
    sizes = []
    for p in dict.fromkeys(paths):
        system, inner = _opened(p)
        info = system.get_file_info(inner)
        if info.type != fs.FileType.File:
            raise FileNotFoundError(p)
        sizes.append((p, info.size))
    files = spark.createDataFrame(sizes, "path string, size long").where("size > 0")
    ranges = files.withColumn("r", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / size).cast("int")))).repartition(F.col("path"), F.col("r"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, total, no in zip(b["path"], b["size"], b["r"]):
                with _Bytes(path, total) as file:

                    def anchor_of(at: int) -> int:
                        if at <= 0 or at >= total:
                            return min(max(0, at), total)
                        left, own, right = file.text(at - 4 * HALO, at)[-HALO:], file.text(at, at + cell), file.text(at + cell, at + cell + 4 * HALO)[:HALO]
                        n = anchor(left + own + right, len(left), len(left) + len(own)) - len(left)
                        return file.begin(at) + _bytes(own[:n])

                    at, chars, cuts = no * size, 0, []
                    begin = anchor_of(at)
                    while at < min((no + 1) * size, total):
                        finish = anchor_of(at + cell)
                        own, before = file.text(begin, finish), file.text(begin - pad, begin)[-max(HALO, overlap) :]
                        t, left = before + own, len(before)
                        for x, y in plan(t, boundaries(t), left, len(t), max_chars, overlap):
                            byte = begin + _bytes(t[left:x]) if x > left else begin - _bytes(t[x:left])
                            cuts.append({"x": chars + x - left, "at": byte, "n": y - x})
                        chars += len(own)
                        at, begin = at + cell, finish
                rows.append((path, total, no, chars, len(cuts), cuts))
            yield pd.DataFrame(rows, columns=["path", "size", "r", "n", "m", "cuts"])

    found = durable(ranges.mapInPandas(find, "path string, size long, r int, n long, m long, cuts array<struct<x:long,at:long,n:long>>"))
    earlier = Window.partitionBy("path").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    begins = found.select("path", "r", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("chars"), F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("first"))
    stitched = found.join(begins, ["path", "r"]).select("path", "size", "chars", "first", "cuts")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, total, chars, first, cuts in zip(b["path"], b["size"], b["chars"], b["first"], b["cuts"]):
                with _Bytes(path, total) as file:
                    for i, c in enumerate(cuts):
                        piece = file.raw(c["at"], c["at"] + 4 * c["n"]).decode("utf-8", "surrogateescape")[: c["n"]]
                        rows.append((path, first + i, chars + c["x"], chars + c["x"] + c["n"], _BAD_BYTE.sub("\ufffd", piece)))
            yield pd.DataFrame(rows, columns=["path", "piece_no", "start_pos", "end_pos", "piece"])

    return stitched.mapInPandas(emit, "path string, piece_no int, start_pos long, end_pos long, piece string")
