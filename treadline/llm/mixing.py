"""Mixing sources to target weights by blocks of equal length."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treadline.llm.common import WORD_RUN, number_rows_globally, permuted
from treadline.session import materialise

BLOCK = 64
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Add ``target`` to one row per source (``key``, ``source``, ``source_size``).

    Sources in code-point order, null last, take the weights in turn and share ``share`` times all words. A target stops at ``cap`` times its
    source; the excess goes to the others by weight until none is above. Each round is one aggregation over the sources.
    """
    ranked = number_rows_globally(sizes, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialise(ranked.withColumn("weight", weight))
    limit = F.col("source_size") * cap
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, stopped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * level >= limit
        n, filled, free = ranked.agg(F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, limit)), F.lit(0.0)),
                                     F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == stopped or free == 0:
            break
        level, stopped = (total - filled) / free, n
    target = limit if level is None else F.least(F.col("weight") * level, limit)
    return ranked.withColumn("target", target.cast("double"))


def block_quotas(targets: DataFrame, block: int = BLOCK, shards: int = 1) -> DataFrame:
    """Add ``seats``, the blocks that each source gives to the mix, and ``shard_quotas``, the blocks in each shard.

    Sainte-Laguë: seats go one by one to the source with the highest ``target / (2 * seats + 1)``. For the house whose divisor is the block length,
    the seats so given are the targets in blocks, rounded to the nearest, which needs no rounds. Seats are numbered source by source and dealt
    to the shards in turn: a source's quotas differ by at most one, and so do the shards' sums.
    """
    seats = targets.withColumns({"seats": F.floor(F.col("target") / block + 0.5).cast("long"),
                                 "blocks": F.ceil(F.col("source_size") / block).cast("long")})
    if shards == 1:
        return seats.withColumn("shard_quotas", F.array("seats"))
    # Only the first seat's number modulo the shards is needed of all earlier sources.
    ordered = number_rows_globally(seats, [F.col("rank")], "_n").drop("_n")
    before = F.coalesce(F.sum(F.col("seats") % shards).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % shards
    quota = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)),
                        lambda h: F.floor((F.col("seats") + F.pmod(F.col("_first") - h - 1, F.lit(shards))) / shards).cast("long"))
    return ordered.withColumn("_first", before).withColumn("shard_quotas", quota).drop("_first")


def times_taken(block_no: Column, blocks: Column, seats: Column, seed: int) -> Column:
    """How often a block is in the mix: whole passes over the source, and one more for the first of a seeded permutation of its blocks."""
    passes = F.floor(seats / F.greatest(blocks, F.lit(1).cast("long"))).cast("long")
    rest = seats - passes * blocks
    extra = F.when(rest > 0, (permuted(block_no, blocks, seed) < rest).cast("long")).otherwise(F.lit(0).cast("long"))
    return passes + extra


def mixed(df: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = 6,
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, ``size`` in words, ``source_size``, ``target``, ``taken``, and where its words lie.

    The words of a source, documents in seeded order, form a stream that is cut into blocks of ``block`` words, the last one shorter. Targets become
    whole blocks (:func:`block_quotas`), blocks are chosen by :func:`times_taken`, and a document gives the words that lie in chosen blocks:
    ``first_word`` is its place in the stream and ``pieces`` lists block, offset in the document, words and times. Streams are added up
    by source and by range of the seeded order, so a hot source is not one task; texts are not shuffled.

    A null source is a source of its own, after all others. Null and empty texts have no words and give none. Repeated rows stand
    side by side in the stream. An empty table gives an empty result.
    """
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    size = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.regexp_count(F.col(text_col), F.lit(WORD_RUN))).cast("long")
    order = F.xxhash64(F.lit(seed), F.col(id_col))
    narrow = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"), order.alias("at"))
    narrow = materialise(narrow.withColumns({"key": key, "range": F.shiftright("at", 52)}))
    ranges = narrow.groupBy("key", "source", "range").agg(F.sum("size").alias("words"))
    sources = ranges.groupBy("key", "source").agg(F.sum("words").alias("source_size"))
    quotas = block_quotas(source_targets(sources, weights, share, cap), block)
    # At most 4,096 ranges of a source.
    before = F.sum("words").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = (ranges.select("key", "range", F.coalesce(before, F.lit(0)).alias("before"))
              .join(quotas.select("key", "source_size", "target", "seats", "blocks"), "key"))
    within = F.sum("size").over(Window.partitionBy("key", "range").orderBy("at", "id", "tie").rowsBetween(Window.unboundedPreceding, 0))
    rows = (narrow.withColumn("within", within - F.col("size")).join(starts, ["key", "range"])
            .withColumn("first_word", F.col("before") + F.col("within")))
    last = F.col("first_word") + F.col("size")

    def piece(b: Column) -> Column:
        left = F.greatest(b * block, F.col("first_word"))
        right = F.least((b + 1) * block, last)
        return F.struct(b.alias("block"), (left - F.col("first_word")).alias("offset"), (right - left).alias("words"),
                        times_taken(b, F.col("blocks"), F.col("seats"), seed).alias("times"))

    spans = F.sequence(F.floor(F.col("first_word") / block).cast("long"), F.floor((last - 1) / block).cast("long"))
    none = F.expr("cast(array() as array<bigint>)")
    rows = rows.withColumn("pieces", F.transform(F.when(F.col("size") > 0, spans).otherwise(none), piece))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + p["words"] * p["times"])
    return rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.alias("taken"), "first_word", "tie", "pieces")


def mixed_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself, with the columns of ``df``: a row for each pass in which a row gives words, its text cut to the words taken.

    Words keep the whitespace that follows them; a text that is taken whole is unchanged. Documents that give no words go. Rows meet
    their pieces by id and a hash of the text, so ids that repeat with different texts stay apart; repeated rows are cut alike, each by
    its own pieces.
    """
    chosen = mixed(df, id_col=id_col, text_col=text_col, source_col=source_col, **options).where("taken > 0")
    chosen = chosen.select(F.col(id_col).alias("_mid"), F.col("source").alias("_msource"), F.col("tie").alias("_mtie"), F.col("size").alias("_msize"),
                           F.col("pieces").alias("_mpieces"), F.col("first_word").alias("_mfirst"))
    # One non-null key; the number of a repeated row is compared beside it, so that texts are shuffled once.
    key = lambda tie: F.xxhash64(F.col("_mid"), tie, F.col("_msource"))
    chosen = chosen.withColumn("_mkey", key(F.col("_mtie")))
    chosen = chosen.withColumn("_mnth", F.row_number().over(Window.partitionBy("_mkey").orderBy("_mfirst"))).drop("_mid", "_mtie", "_msource")
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).alias("_mid"), F.col(source_col).cast("string").alias("_msource"))
    rows = rows.withColumn("_mkey2", key(F.xxhash64(F.coalesce(F.col("row")[text_col], F.lit("")))))
    rows = rows.withColumn("_mnth2", F.row_number().over(Window.partitionBy("_mkey2").orderBy("_mid"))).drop("_mid", "_msource")
    on = (F.col("_mkey") == F.col("_mkey2")) & (F.col("_mnth") <= F.col("_mnth2")) & (F.col("_mnth") >= F.col("_mnth2"))
    both = rows.join(chosen, on).select("row", "_msize", "_mpieces")
    both = both.withColumn("_mpass", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max(F.transform("_mpieces", lambda p: p["times"])))))
    given = F.filter("_mpieces", lambda p: p["times"] >= F.col("_mpass"))
    whole = F.aggregate(given, F.lit(0).cast("long"), lambda s, p: s + p["words"]) == F.col("_msize")
    text = F.col("row")[text_col]
    words = F.regexp_extract_all(text, F.lit(WORD_RUN + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.concat_ws("", F.flatten(F.transform(given, lambda p: F.slice(words, (p["offset"] + 1).cast("int"), p["words"].cast("int")))))
    out = both.withColumn("_mtext", F.when(whole, text).otherwise(cut))
    value = {text_col: F.col("_mtext"), "n_chars": F.char_length("_mtext").cast("long")}
    return out.select(*[value[c].alias(c) if c in value else F.col("row")[c].alias(c) for c in df.columns])
