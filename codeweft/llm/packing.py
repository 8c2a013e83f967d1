"""Filling containers of fixed capacity by hierarchical residual packing (problem 8).

Items are spread over parts of bounded size. In each part, best fit in decreasing order fills bins; nearly full bins
are emitted. The underfull ones go up a tree as items: the bins left of `FAN_IN` parts meet in one part and are packed
again, and so on to a single part.

A part leaves at most one bin that is not over half full, and no two bins over half full fit together. So of all bins over
half full, no more can still gain than there are others: as many, those with the most room, go up, and the rest are emitted
as they are. What goes up is thus at most about two bins a part, and the root never holds more than its share.

Items larger than the capacity are cut into full containers and a rest that is packed like any other item; nothing
else is split. Items of size 0 (null and empty texts) join a bin of their part. Repeated keys are separate items. An
empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.core import cut

FAN_IN = 8
NEARLY_FULL = 0.99
PART_UNITS = 4_000_000  # size units that one part packs at once
PART_ROWS = 100_000


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each item by best fit in decreasing order; every size is 0..capacity.

    Open bins are kept by the room they have left; a bit mask of the rooms in use finds the smallest that fits.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, bins, out = 0, 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[i]
        fits = used >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            b = rooms[room].pop()
            if not rooms[room]:
                used &= ~(1 << room)
        else:
            room, b, bins = capacity, bins, bins + 1
        out[i] = b
        rooms[room - size].append(b)
        used |= 1 << (room - size)
    return out


def _round(level: int, capacity: int, last: bool, nearly: float):
    floor = int(capacity * nearly)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bin", "id_text", "piece"], kind="stable").reset_index(drop=True)
        part = int(rows["part"].iloc[0])
        items = rows.groupby("bin", sort=True).agg(fill=("size", "sum"))
        items["new"] = best_fit(items["fill"].tolist(), capacity)
        items["full"] = items.groupby("new")["fill"].transform("sum")
        items["id"] = (level << 56) | (part << 28) | items["new"]
        got = items.loc[rows["bin"]]
        rows["bin"], rows["fill"] = got["id"].to_numpy(), got["full"].to_numpy()
        rows["done"] = last | (rows["fill"] >= floor)
        rows["part"] = part // FAN_IN
        return rows

    return pack


def _rising(packed: DataFrame, capacity: int) -> Column:
    """Whether a bin that isn't nearly full goes up: all that are at most half full, and as many over half full by their room.

    The fills are counted by value (at most `capacity` rows). Of bins with the least room that goes up, a share is taken by
    hash that is large enough in all likelihood.
    """
    bins = packed.where("not done").groupBy("bin").agg(F.first("fill").alias("fill"))
    counts = dict(bins.groupBy("fill").agg(F.count("*")).toLocalIterator())
    wanted = sum(n for f, n in counts.items() if 2 * f <= capacity)
    for fill in sorted(f for f in counts if 2 * f > capacity):
        if counts[fill] > wanted:
            share = F.lit(min(1.0, (wanted + 4 * wanted**0.5 + 8 if wanted else 0) / counts[fill]))
            return (F.col("fill") < fill) | ((F.col("fill") == fill) & (F.pmod(F.xxhash64("bin"), F.lit(1 << 20)) < share * (1 << 20)))
        wanted -= counts[fill]
    return F.lit(True)


def pack(items: DataFrame, key: str, size: str, capacity: int, nearly: float = NEARLY_FULL, part_units: int = PART_UNITS) -> DataFrame:
    """(key, piece, start, size, bin_id): `start` is the piece's offset in its item; one row for each piece."""
    kind = items.schema[key].dataType.simpleString()
    src = items.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)).alias("total"))
    n_full = F.expr(f"case when total > {capacity} then cast(floor(total / {capacity}) as bigint) else 0 end")
    src = cut(src.withColumn("n_full", n_full))
    units, rows = src.agg(F.sum("total"), F.count("*")).first()
    parts = max(1, -(-(units or 0) // part_units), -(-rows // PART_ROWS))
    whole = src.where("n_full > 0").select("id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_full") - 1)).alias("piece")).select(
        "id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("size"),
        F.concat_ws("-", F.lit("w"), F.col("id").cast("string"), F.col("piece").cast("string"), F.monotonically_increasing_id().cast("string")).alias("bin_id"),
    )
    rest = src.where(f"n_full = 0 or total % {capacity} > 0").select(
        "id", F.col("id").cast("string").alias("id_text"), F.col("n_full").alias("piece"), (F.col("n_full") * capacity).alias("start"),
        (F.col("total") - F.col("n_full") * capacity).alias("size"),
    )
    live = rest.withColumn("part", F.pmod(F.xxhash64("id", "piece", F.monotonically_increasing_id()), F.lit(parts)).cast("bigint")).withColumn(
        "bin", F.monotonically_increasing_id()
    )
    # items of size 0 of a part stand for one item
    live = cut(live.withColumn("bin", F.when(F.col("size") == 0, -1 - F.col("part")).otherwise(F.col("bin"))))
    schema = f"id {kind}, id_text string, piece bigint, start bigint, size bigint, part bigint, bin bigint, fill bigint, done boolean"
    out, level = [whole], 1
    while True:
        packed = cut(live.groupBy("part").applyInPandas(_round(level, capacity, parts == 1, nearly), schema))
        up = F.lit(False) if parts == 1 else ~F.col("done") & _rising(packed, capacity)
        out.append(packed.where(~up).select("id", "piece", "start", "size", F.concat_ws("-", F.lit("b"), F.col("bin").cast("string")).alias("bin_id")))
        if parts == 1:
            break
        live = packed.where(up).drop("done", "fill")
        parts, level = -(-parts // FAN_IN), level + 1
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result.withColumnRenamed("id", key)
