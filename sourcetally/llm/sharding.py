"""Shards of near equal bytes, tokens and rows: vector bin packing of groups that stay together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcetally.session import stored

#: Lots that small groups are gathered in and least cells that rows are numbered in, per shard; rows of a cell.
LOTS, CELLS, CELL_ROWS = 512, 512, 100_000
MEASURES = ("size", "tokens", "rows")


def place(loads: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each load (a row of measures): the largest loads first, each to the shard whose
    residual capacity has the highest dot product with it, among those with room for its first
    measure, the law.  A load that fits nowhere goes to the shard with the most room by the law, so
    the law ends as even as the last and smallest loads allow, whatever the other measures do.

    Measures are scaled by their totals, so all count alike.  Residuals may fall below zero; equal
    products go to the lowest shard number.
    """
    total = loads.sum(axis=0)
    scaled = loads / np.where(total > 0, total, 1)
    free = np.full((shards, loads.shape[1]), 1.0 / shards)
    out = np.zeros(len(loads), np.int64)
    for i in np.argsort(-scaled.sum(axis=1), kind="stable"):
        fits = free[:, 0] >= scaled[i, 0] - 1e-12
        out[i] = np.argmax(np.where(fits, np.round(free @ scaled[i], 15), -np.inf) if fits.any() else free[:, 0])
        free[out[i]] -= scaled[i]
    return out


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, tokens, rows, text_crc32, unit) of each row: bytes plus one, words, 1, and a digest
    that equal texts share.  A null text is an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                       F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"), F.lit(1).cast("long").alias("rows"),
                       F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("unit"))


def shard(rows: DataFrame, shards: int, lots: int = LOTS, cells: int = CELLS) -> DataFrame:
    """Add shard and slot to ``rows`` (as ``measured`` makes them, further columns stay).

    Rows of one unit share a shard, unless the unit is larger than a shard by any measure; such a
    unit is cut into a part for every shard.  A unit above a share of 1 / (shards * lots) is
    placed by itself: there are at most len(MEASURES) * shards * lots of them.  All smaller units
    are gathered by hash into shards * lots lots, and a lot is placed as one.  So the driver places
    a number of loads that does not depend on the table, and what it sends out is bounded alike.

    Slots count from 0 in each shard without gaps.  Rows are numbered in at least ``cells`` parts of a
    shard, more where a part would exceed CELL_ROWS, each part after the others: no task gets a whole
    shard.  Parts are dealt by a hash of the row's number, so equal rows spread.  Repeated rows and
    null ids get slots of their own.  An empty table gives an empty result.
    """
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "sharding-rows")
    total = rows.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES]).first()
    units = stored(rows.groupBy("unit").agg(*[F.sum(m).alias(m) for m in MEASURES]), "sharding-units")
    share = lambda m: F.col(m) / F.lit(float(max(1, total[m])))
    most = F.greatest(*[share(m) for m in MEASURES])
    large = units.where(most > 1 / (shards * lots)).select("unit", F.when(most * shards * 0.999999 > 1, shards).otherwise(1).alias("parts"))
    lot = F.pmod(F.xxhash64("unit"), F.lit(shards * lots))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("_row"), F.col("parts"))).when(F.col("parts") == 1, F.lit(0))
    named = (rows.join(F.broadcast(large), "unit", "left")
             .withColumn("load", F.when(F.col("parts").isNull(), lot.cast("string")).otherwise(F.concat_ws("/", F.hex("unit"), part.cast("string")))))
    loads = named.groupBy("load").agg(*[F.sum(m).alias(m) for m in MEASURES]).orderBy("load").toPandas()
    placed = place(loads[list(MEASURES)].to_numpy(float).reshape(-1, len(MEASURES)), shards)
    spark = rows.sparkSession
    where = spark.createDataFrame(list(zip(loads["load"].tolist(), placed.tolist())), "load string, shard int")
    cells = max(cells, -(-total["rows"] // (shards * CELL_ROWS)))
    dealt = named.join(F.broadcast(where), "load").withColumn("cell", F.pmod(F.xxhash64("_row", F.lit("cell")), F.lit(cells)).cast("int")).drop("load", "parts", "_row")
    dealt = stored(dealt, "sharding-dealt")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "cell").agg(F.count("*").alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "cell").orderBy("id", "text_crc32", "size")
    return (dealt.withColumn("nth", F.row_number().over(within)).join(offsets, ["shard", "cell"])
            .withColumn("slot", (F.col("first") + F.col("nth") - 1).cast("long")).drop("first", "nth", "cell"))
