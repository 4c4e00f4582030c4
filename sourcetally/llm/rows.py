"""Rows of a table of documents: one for each id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcetally.session import stored


#: Ids or hashes that are sent to every task at most: 8 bytes each.
SENT = 4_000_000


def few(keys: DataFrame, name: str) -> DataFrame:
    """Distinct ``keys`` (one column of ids or hashes), written.  Up to SENT of them are marked to be sent
    to the tasks of a join, so the other side stays where it is; more are joined as Spark sees fit."""
    keys = stored(keys.distinct(), name)
    return F.broadcast(keys) if keys.count() <= SENT else keys


def repeated_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash): ids that several rows share, and the smallest hash of their texts, null ones as empty.
    Texts are read only if there are such ids, and hashed only for those."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    several = stored(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated-ids")
    if several.isEmpty():
        return several.withColumn("hash", F.lit(None).cast("long"))
    return stored(rows.join(several, "id", "left_semi").groupBy("id").agg(F.min(F.xxhash64("text")).alias("hash")), "repeated-ids")


def one_row_an_id(docs: DataFrame, id_col: str, text_col: str, repeated: DataFrame | None = None) -> DataFrame:
    """(id, text) of rows with an id, null texts as empty ones; of rows that share an id, the text
    with the smallest hash.  Texts move only if some ids repeat, and then only those."""
    repeated = repeated_ids(docs, id_col, text_col) if repeated is None else repeated
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if repeated.isEmpty():
        return rows
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    chosen = hashed.join(repeated, ["id", "hash"], "left_semi").dropDuplicates(["id"]).select("id", "text")
    return rows.join(repeated, "id", "left_anti").unionByName(chosen)
