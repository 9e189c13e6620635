"""Order-dependent operators that do not gather a group: positions, greedy batches and changes, chunk by chunk.

A group (a document, a job) may hold any share of the rows.  Rows are cut into chunks by ranges of their order column,
each chunk is worked on alone, and one small row for each chunk is chained.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import durable, ship

CHUNK = 10_000
#: Chunks whose transitions are composed at a time, so that no row lists all chunks of a group.
FAN = 1_000


def with_position(df: DataFrame, group: str, order: str, name: str = "pos", count: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``df`` with the 0-based position of each row in its group by a unique numeric order column, and the group's size."""
    rows = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    sizes = rows.groupBy(group, "_chunk").agg(F.count("*").alias("_n"))
    chained = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(group).orderBy("_chunk")) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy(group))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(group, "_chunk").orderBy(order)) - 1
    out = rows.withColumn("_inside", inside).join(chained, [group, "_chunk"])
    out = out.withColumn(name, (F.col("_inside") + F.col("_before")).cast("int"))
    if count:
        out = out.withColumn(count, F.col("_all").cast("int"))
    return out.drop("_chunk", "_inside", "_before", "_all")


def _run(costs: list[int], starts: list[int], budget: int, most: int, tokens: int, n: int, first: int) -> tuple[int, int, list[int]]:
    """Greedy batches over ``costs`` with an open batch of ``n`` items and ``tokens``; (tokens, n of the last open batch, starts)."""
    for i, c in enumerate(costs):
        if n and (tokens + c > budget or n >= most):
            tokens = n = 0
        if n == 0:
            starts.append(first + i)
        tokens, n = tokens + c, n + 1
    return tokens, n, starts


def greedy_batches(df: DataFrame, group: str, order: str, cost: str, budget: int, most: int, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(group, order, batch_no): consecutive rows of a group in batches, closed when the next row would exceed ``budget`` or
    the batch has ``most`` rows; a row above the budget is a batch of its own; costs below 1, and null ones, count as 1.

    Ties of the order column are not allowed within a group.  An empty table: no rows.

    Every chunk is run once for each state in which it can be entered: with a fresh batch, or with a batch begun 1 to
    ``most`` rows before it.  Blocks of ``fan`` chunks are composed to one transition each; the chain of a group's blocks,
    then that of each block's chunks, picks the true state of each chunk, and the chunk's rows are numbered.
    """
    if budget < 1 or most < 1:
        raise ValueError("budget and most must be positive")
    ship(df.sparkSession)
    gk = df.schema[group].dataType.simpleString()
    rows = df.select(F.col(group).alias("g"), F.col(order).cast("long").alias("o"), F.greatest(F.lit(1), F.coalesce(F.col(cost), F.lit(1))).cast("long").alias("c"))
    packed = rows.withColumn("k", F.floor(F.col("o") / chunk)).groupBy("g", "k").agg(F.array_sort(F.collect_list(F.struct("o", "c"))).alias("rows"))
    tail = F.expr(f"transform(slice(rows, greatest(1, size(rows) - {most} + 1), {most}), x -> x.c)")
    # the rows just before a chunk may lie in several short chunks: chain the tails, a few numbers for each chunk
    tails = packed.select("g", "k", tail.alias("t"))
    before = tails.withColumn("halo", F.expr(f"flatten(collect_list(t) over (partition by g order by k rows between {most} preceding and 1 preceding))"))
    before = before.select("g", "k", F.expr(f"slice(halo, greatest(1, size(halo) - {most} + 1), {most})").alias("halo"))

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for g, k, own, halo in zip(b["g"], b["k"], b["rows"], b["halo"]):
                costs = [int(x["c"]) for x in own]
                halo = [int(x) for x in halo]
                moves = []
                for held in range(len(halo) + 1):  # a batch of the last `held` rows is open on entry
                    tokens = sum(halo[len(halo) - held :]) if held else 0
                    _, n, starts = _run(costs, [], budget, most, tokens, held, 0)
                    moves.append((held, n, len(starts)))
                out.append((g, k, moves))
            yield pd.DataFrame(out, columns=["g", "k", "moves"])

    moved = packed.join(before, ["g", "k"]).mapInPandas(states, f"g {gk}, k long, moves array<struct<held:int,open:int,starts:int>>")
    # each block of chunks becomes one transition; the blocks of a group are chained, then the chunks of each block
    steps = durable(moved.withColumn("j", F.floor(F.col("k") / fan)))
    in_block = steps.groupBy("g", "j").agg(F.array_sort(F.collect_list(F.struct("k", "moves"))).alias("m"))

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for g, j, m in zip(b["g"], b["j"], b["m"]):
                tables = [{s["held"]: s for s in x["moves"]} for x in m]
                moves = []
                for entry in tables[0]:
                    held, begun = entry, 0
                    for t in tables:
                        begun += t[held]["starts"]
                        held = t[held]["open"]
                    moves.append((entry, held, begun))
                out.append((g, j, moves))
            yield pd.DataFrame(out, columns=["g", "j", "moves"])

    def chain(rows: DataFrame, name: str) -> DataFrame:
        """(g, ``name``, held, begun): the state in which each row of ``rows`` (g, held, begun, m) is entered, m in order."""

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for g, held, begun, m in zip(b["g"], b["held"], b["begun"], b["m"]):
                    for x in m:
                        out.append((g, x["k"], held, begun))
                        step = next(s for s in x["moves"] if s["held"] == held)
                        begun += step["starts"]
                        held = step["open"]
                yield pd.DataFrame(out, columns=["g", name, "held", "begun"])

        return rows.select("g", "held", "begun", "m").mapInPandas(walk, f"g {gk}, {name} long, held int, begun long")

    blocks = in_block.mapInPandas(compose, f"g {gk}, j long, moves array<struct<held:int,open:int,starts:int>>")
    whole = blocks.groupBy("g").agg(F.array_sort(F.collect_list(F.struct(F.col("j").alias("k"), "moves"))).alias("m"))
    entered_blocks = chain(whole.withColumns({"held": F.lit(0), "begun": F.lit(0).cast("long")}), "j")
    entered = chain(in_block.join(entered_blocks, ["g", "j"]), "k")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for g, own, halo, held, begun in zip(b["g"], b["rows"], b["halo"], b["held"], b["begun"]):
                halo = [int(x) for x in halo]
                tokens = sum(halo[len(halo) - held :]) if held else 0
                starts = set(_run([int(x["c"]) for x in own], [], budget, most, tokens, held, 0)[2])
                no = begun - 1
                for i, x in enumerate(own):
                    no += i in starts
                    out.append((g, x["o"], no))
            yield pd.DataFrame(out, columns=["g", "o", "batch_no"])

    numbered = packed.join(before, ["g", "k"]).join(entered, ["g", "k"]).mapInPandas(number, f"g {gk}, o long, batch_no long")
    return numbered.select(F.col("g").alias(group), F.col("o").cast(df.schema[order].dataType).alias(order), F.col("batch_no").cast("int"))


def changes(df: DataFrame, group: str, order: str, values: list[str], chunk: int = CHUNK) -> DataFrame:
    """Rows whose ``values`` differ from those of the row before them in their group (nulls are equal); the first row of a group is a change.  Duplicate rows of one key count once."""
    rows = df.dropDuplicates([group, order]).withColumn("_v", F.struct(*values)).withColumn("_chunk", F.floor(F.col(order) / chunk))
    last = rows.groupBy(group, "_chunk").agg(F.max_by("_v", order).alias("_last"))
    carried = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(group).orderBy("_chunk"))).drop("_last")
    inside = Window.partitionBy(group, "_chunk").orderBy(order)
    seen = rows.withColumn("_prev", F.lag("_v").over(inside)).withColumn("_first", F.row_number().over(inside) == 1).join(carried, [group, "_chunk"])
    before = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_prev"))
    return seen.where(~before.eqNullSafe(F.col("_v"))).drop("_v", "_chunk", "_prev", "_first", "_carried")
