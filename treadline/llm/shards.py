"""A reproducible shuffle into shards."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treadline.llm.common import number_rows_globally, permuted


def place(number: Column, n: Column, shards: int, seed: int) -> tuple[Column, Column]:
    """Shard and slot of row ``number`` of ``n``: its place in a Feistel permutation, dealt out in turn."""
    at = permuted(number, n, seed)
    return (at % shards).cast("int"), F.floor(at / shards).cast("long")


def row_at(shard: Column, slot: Column, n: Column, shards: int, seed: int) -> Column:
    """The row number that :func:`place` puts at ``(shard, slot)``."""
    return permuted(slot * shards + shard, n, seed, inverse=True)


def shard_rows(df: DataFrame, shards: int = 24, seed: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``size``, ``text_crc32``, ``row_number``, ``law`` ('rows'), ``shard``, ``slot``, ``grown_shard`` (null).

    Rows are numbered in the order of id, checksum and size; the number alone decides shard and slot, through a permutation of all
    numbers. Shards differ by at most one row and slots have no gaps. Only ids, sizes and checksums are shuffled, never texts.
    Copies of a text are rows like any other and are dealt like them, so a large group of copies is spread evenly.

    ``size`` is the UTF-8 length of the text (null: 0) plus 8; the checksum of a null text is that of the empty one. Null ids are numbered
    first. Repeated rows are interchangeable: each gets a place of its own. An empty table gives an empty result.
    """
    octets = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    narrow = df.select(F.col(id_col).alias(id_col), (F.octet_length(octets) + 8).cast("long").alias("size"),
                       F.crc32(octets).alias("text_crc32"))
    rows = number_rows_globally(narrow, [F.col(id_col), F.col("text_crc32"), F.col("size")], "row_number")
    n = F.lit(df.count()).cast("long")
    shard, slot = place(F.col("row_number"), n, shards, seed)
    return rows.select(id_col, "size", "text_crc32", "row_number", F.lit("rows").alias("law"), shard.alias("shard"), slot.alias("slot"),
                       F.lit(None).cast("int").alias("grown_shard"))
