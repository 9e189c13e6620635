"""Problem 2: filling containers of fixed capacity with items of varying length.

Planning sees a histogram of lengths, never the items: best fit, longest first, over counts.  Equal containers are one
group with a multiplicity, so a plan is small however many items there are.  Items then take the planned slots by a
join on their rank within (group, length).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import sent, ship

NO_GROUP = "\0"


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Groups (how many containers, {length: items in each}) for lengths from 1 to ``capacity``, longest first into
    the fullest container that still has room."""
    groups: dict[int, list[list]] = {}  # room left -> [[multiplicity, contents]]
    rooms: list[int] = []

    def add(room: int, times: int, contents: dict[int, int]) -> None:
        if times:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append([times, contents])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                times, contents = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(i)
            else:
                room, times, contents = capacity, left, {}
            each = room // length
            full = min(times, left // each)
            add(room - each * length, full, {**contents, length: each})
            left -= full * each
            spare = times - full
            if spare and left and left < each:
                add(room - left * length, 1, {**contents, length: left})
                spare, left = spare - 1, 0
            if contents:
                add(room, spare, contents)
    return [(t, c) for room in rooms for t, c in groups[room]]


def slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Plan rows (length, first rank, end rank, items of it in each container, first container)."""
    rows, taken, container = [], {}, 0
    for times, contents in best_fit({k: n for k, n in histogram.items() if k > 0}, capacity):
        for length, each in contents.items():
            first = taken.get(length, 0)
            taken[length] = first + each * times
            rows.append((length, first, first + each * times, each, container))
        container += times
    if n := histogram.get(0):
        rows.append((0, 0, n, n, 0))  # items without length go into the first container
    return rows


def pack(items: DataFrame, group: str, ids: list[str], length: str, capacity: int, salts: int | None = None) -> DataFrame:
    """(group, ids..., length, request_no): containers numbered from 0 in each group, none above ``capacity``.

    Items longer than ``capacity`` are the caller's to cut (see :func:`pack_texts`); here they raise.  A null length counts
    as 0; items of a null group are a group.  Repeated ids of a group count once, with their greatest length.  Ties are ordered by id.  An empty table: no
    rows.  One group may hold any share of the rows: it is planned from at most ``capacity + 1`` lengths, and ranks
    within a length are counted in ``salts`` parts (as many as there are shuffle partitions) that are then added up.
    Items meet the plan part by part, where they were ranked: one row with the slots of their length.
    """
    spark = items.sparkSession
    ship(spark)
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = items.groupBy(F.coalesce(sent(items, group, "_g").cast("string"), F.lit(NO_GROUP)).alias("_g"), *ids).agg(F.coalesce(F.max(length), F.lit(0)).cast("int").alias("_n"))
    keyed = keyed.withColumn("_s", F.pmod(F.xxhash64(*ids), F.lit(salts)).cast("int"))
    counts = keyed.groupBy("_g", "_n", "_s").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy("_g", "_n").orderBy("_s")) - F.col("_c"))
    ranked = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy("_g", "_n", "_s").orderBy(*ids)) - 1)
    histogram = counts.groupBy("_g", "_n").agg(F.sum("_c").alias("_c")).groupBy("_g").agg(F.collect_list(F.struct("_n", "_c")).alias("_h"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for g, h in zip(b["_g"], b["_h"]):
                own = {int(x["_n"]): int(x["_c"]) for x in h}
                if max(own) > capacity:
                    raise ValueError(f"an item of {max(own)} exceeds the capacity {capacity}")
                rows += [(g, *x) for x in slots(own, capacity)]
            yield pd.DataFrame(rows, columns=["_g", "_n", "_from", "_to", "_each", "_first"])

    planned = histogram.mapInPandas(fill, "_g string, _n int, _from long, _to long, _each long, _first long")
    slots_of = planned.groupBy("_g", "_n").agg(F.array_sort(F.collect_list(F.struct("_from", "_to", "_each", "_first"))).alias("_slots"))
    parts = before.drop("_c").join(slots_of, ["_g", "_n"])
    placed = ranked.join(parts, ["_g", "_n", "_s"]).withColumn("_rank", F.col("_rn") + F.col("_before"))
    slot = F.filter("_slots", lambda x: (F.col("_rank") >= x["_from"]) & (F.col("_rank") < x["_to"]))[0]
    placed = placed.withColumn("_slot", slot)
    number = F.col("_slot._first") + F.floor((F.col("_rank") - F.col("_slot._from")) / F.col("_slot._each"))
    placed = placed.withColumn("_g", F.nullif("_g", F.lit(NO_GROUP)))
    return placed.select(F.col("_g").cast(items.schema[group].dataType).alias(group), *ids, F.col("_n").alias("n_chars"), number.alias("request_no"))


def pack_texts(items: DataFrame, group: str, unit: str, text: str, capacity: int) -> DataFrame:
    """(group, unit, piece_no, n_chars, request_no): as :func:`pack` for texts; a text longer than ``capacity`` is cut at
    natural boundaries without overlap, and its pieces are placed like items; every other text is piece 0, whole."""
    from .split import split_items

    sized = items.select(F.col(group).alias("g"), F.col(unit).alias("u"), F.col(text).alias("t"))
    whole = sized.where(F.coalesce(F.length("t"), F.lit(0)) <= capacity).select("g", "u", F.lit(0).alias("piece_no"), F.coalesce(F.length("t"), F.lit(0)).alias("n"))
    big = sized.where(F.length("t") > capacity).select(F.struct("g", "u").alias("k"), F.col("t"))
    keyed = big.select("k.g", "k.u", F.to_json("k").alias("kj"), "t")
    pieces = split_items(keyed, "kj", "t", capacity)
    names = keyed.select("kj", "g", "u").distinct()
    cut = pieces.join(names, "kj").select("g", "u", "piece_no", (F.col("end_pos") - F.col("start_pos")).cast("int").alias("n"))
    packed = pack(whole.unionByName(cut), "g", ["u", "piece_no"], "n", capacity)
    return packed.select(F.col("g").alias(group), F.col("u").alias(unit), "piece_no", "n_chars", "request_no")
