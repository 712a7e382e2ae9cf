"""Exact duplicates by a content sort."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treadline.llm.common import partitions
from treadline.session import cut_lineage

#: Leading bytes of the text in the splitters that the range partitioner samples.
HEAD = 24


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add to every row the group of rows with the identical text: ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Content sort. Sampled splitters range-partition the rows by the leading bytes of the text and a hash of the rest of it;
    inside a partition an external sort by the whole text puts equal texts side by side, and the window compares each row with its
    neighbour by the full text. Splitters hold a bounded part of a text, so the sample stays small however long texts are.

    A key with more than a quarter of an average partition is dealt over all partitions by its ids. There are fewer such keys than
    four times the partitions, which bounds the broadcast tables; equality between the parts of such a key is settled by
    the SHA-256 of the text. No group is gathered in one task.

    * A null text counts as empty; empty texts form a group like any other.
    * Of a group, the row with the largest id stays. Null ids lose; if all ids of a group are null, one of its rows stays and
      ``keep_id`` is null. Of repeated rows with the same id and text exactly one stays.
    * All columns of the input are returned; those named like a result column are replaced.
    """
    n = partitions(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = ["keep_id", "group_size", "kept", "text_sha256"]
    carried = [c for c in df.columns if c.lower() not in made]
    rows = df.select(F.struct(*carried).alias("row") if carried else F.struct(F.lit(0).alias("_none")).alias("row"),
                     F.col(id_col).alias("id"), text.alias("content"))
    rows = rows.withColumns({"head": F.substring(F.encode("content", "UTF-8"), 1, HEAD), "rest": F.xxhash64("content")})

    total = df.count()
    heavy = cut_lineage(rows.groupBy("head", "rest").agg(F.count(F.lit(1)).alias("copies"))
                        .where(F.col("copies") * (4 * n) > total).select("head", "rest", F.lit(True).alias("heavy")))
    rows = (rows.join(F.broadcast(heavy), ["head", "rest"], "left")
            .withColumn("slot", F.when(F.col("heavy"), F.pmod(F.xxhash64("id"), F.lit(n))).otherwise(F.lit(0).cast("long"))))

    same = Window.partitionBy("head", "rest", "slot", "content").orderBy(F.col("id").desc_nulls_last())
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = (rows.repartitionByRange("head", "rest", "slot")
             .select("row", "id", "heavy", "content", F.row_number().over(same).alias("nth"),
                     F.max("id").over(whole).alias("local_keep"), F.count(F.lit(1)).over(whole).alias("local_size"))
             .withColumn("sha", F.sha2("content", 256)).drop("content"))

    spread = (df.select(F.col(id_col).alias("id"), text.alias("content"))
              .withColumns({"head": F.substring(F.encode("content", "UTF-8"), 1, HEAD), "rest": F.xxhash64("content")})
              .join(F.broadcast(heavy), ["head", "rest"])
              .groupBy(F.sha2("content", 256).alias("sha"))
              .agg(F.max("id").alias("all_keep"), F.count(F.lit(1)).alias("all_size")).withColumn("found", F.lit(True)))
    out = local.join(F.broadcast(spread), "sha", "left")
    keep = F.when(F.col("found"), F.col("all_keep")).otherwise(F.col("local_keep"))
    size = F.when(F.col("found"), F.col("all_size")).otherwise(F.col("local_size"))
    return out.select(*[F.col("row")[c].alias(c) for c in carried], keep.alias("keep_id"), size.alias("group_size"),
                      (F.col("id").eqNullSafe(keep) & (F.col("nth") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that :func:`exact_groups` keeps, with the columns of ``df`` and their own values, whatever they are called. Nulls, empty texts, ties and repeated rows are as there; an empty table gives none."""
    # Under names of their own, columns can't meet those of the result.
    own = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    kept = exact_groups(df.toDF(*own.values()), own[id_col], own[text_col]).where("kept")
    return kept.select(*[F.col(o).alias(c) for c, o in own.items()])
