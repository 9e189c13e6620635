"""The newest items of a sequence that fit a budget of tokens together, as JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pytext as P
from ..shared import ship
from .generation import longest_prefix
from .ordered import with_position
from .segments import estimate

#: Fixed values of the JSON form: characters of an item without its texts, of the brackets, of a comma between items.
ITEM, BRACKETS, COMMA = 28, 2, 2


def json_length(text: Column) -> Column:
    """Characters of a text within a JSON string that escapes no more than it must."""
    short = F.length(F.regexp_replace(text, r'[^"\\\\\x08\t\n\f\r]', ""))
    long = F.length(F.regexp_replace(text, r"[^\x00-\x07\x0b\x0e-\x1f]", ""))
    return F.length(text) + short + long * 5


def clip(source: str, target: str, budget: int) -> tuple[str, str] | None:
    """Beginnings of two texts that fit together: each in half of what the empty item leaves, then the longer of the two loses
    its end until they fit; None where not even the empty item does."""
    import json

    size = lambda s, t: estimate(json.dumps([{"source": s, "target": t}], ensure_ascii=False))
    room = max(0, budget - size("", ""))
    s, t = longest_prefix(source, room // 2), longest_prefix(target, room - room // 2)
    while (s or t) and size(s, t) > budget:
        if len(s) >= len(t):
            s = s[:-1]
        else:
            t = t[:-1]
    return (s, t) if size(s, t) <= budget else None


def suffix_window(items: DataFrame, group: str, order: str, keep: list[str], source: str, target: str, budget: int) -> DataFrame:
    """(group, order, keep..., source, target, tokens): the newest items of each group that fit ``budget`` tokens together, and
    the tokens of the JSON from each of them to the newest.  Where the newest alone does not fit, it is clipped.

    Null texts are empty.  A group may be of any size: no item takes less than the signs around it, so only the last few
    places are looked at.  An empty table: no rows."""
    ship(items.sparkSession)
    places = max(1, int((budget + 1) * 2.6) // (ITEM + COMMA) + 1)
    rows = items.select(group, order, *keep, F.coalesce(source, F.lit("")).alias("source"), F.coalesce(target, F.lit("")).alias("target"))
    last = with_position(rows, group, order, "_pos", count="_n").where(F.col("_pos") >= F.col("_n") - places)
    newest_first = Window.partitionBy(group).orderBy(F.desc(order))
    own = F.lit(ITEM + COMMA) + json_length(F.col("source")) + json_length(F.col("target"))
    chars = F.sum(own).over(newest_first) + BRACKETS - COMMA
    sized = last.withColumn("tokens", F.greatest(F.lit(1), F.floor(chars / F.lit(2.6)).cast("int") + 8)).withColumn("_newest", F.col("_pos") == F.col("_n") - 1).drop("_pos", "_n")
    fits = sized.where(F.col("tokens") <= budget).drop("_newest")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [clip(s, t, budget) for s, t in zip(b["source"], b["target"])]
            b = b.assign(source=[x and x[0] for x in both], target=[x and x[1] for x in both])
            yield b[[x is not None for x in both]]

    clipped = sized.where((F.col("tokens") > budget) & F.col("_newest")).drop("_newest")
    done = clipped.mapInPandas(cut, clipped.schema)
    size = F.lit(ITEM + BRACKETS) + json_length(F.col("source")) + json_length(F.col("target"))
    return fits.unionByName(done.withColumn("tokens", F.greatest(F.lit(1), F.floor(size / F.lit(2.6)).cast("int") + 8)))
