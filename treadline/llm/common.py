"""Helpers that several corpus operators share."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StructType

from treadline.session import materialise, shared_folder

#: Whitespace of the contracts: space and the controls from tab to carriage return.
WORD_RUN = r"[^\x20\x09-\x0D]+"

_ROUNDS = 8
_PRIME = (1 << 31) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def new_folder(spark: SparkSession) -> str:
    """A fresh path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame, *folders: str) -> tuple[DataFrame, str]:
    """``df`` written once to the shared folder, in ``folders`` by those columns, and read back; and the path, for :func:`delete`."""
    path = new_folder(df.sparkSession)
    df.write.partitionBy(*folders).parquet(path)
    kinds = [f for f in df.schema.fields if f.name not in folders] + [df.schema[c] for c in folders]
    return df.sparkSession.read.schema(StructType(kinds)).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Delete what :func:`written` wrote, once no later step reads it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def number_rows_globally(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the row's number from 0 in the order of ``order``, over the whole table.

    Rows are range-partitioned and sorted, and the numbered partitions are written once; the only rows that one task sees
    together afterwards are one count per partition. Rows that tie on every column of ``order`` are numbered in any order.
    """
    ranged = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per partition, whatever the table's size.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    return (placed.join(F.broadcast(offsets), part == F.col("_of"))
            .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_at", "_of", "_before"))


def _keys(seed: int) -> list[int]:
    """Four constants below the prime for each round, drawn from the seed by a linear congruential generator."""
    state, out = seed % _PRIME, []
    for _ in range(4 * _ROUNDS):
        state = (state * 48271 + 11) % _PRIME
        out.append(state or 1)
    return out


def _round_value(half: Column, i: Column, keys: Column) -> Column:
    key = lambda j: F.element_at(keys, (i * 4 + (j + 1)).cast("int"))
    t = (half * key(0) + key(1)) % F.lit(_PRIME)
    return (t * t % F.lit(_PRIME) + t * key(2) % F.lit(_PRIME) + key(3)) % F.lit(_PRIME)


def _radices(n: Column) -> tuple[Column, Column]:
    n = F.greatest(n.cast("long"), F.lit(1).cast("long"))
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    return a, F.expr("0L") + F.floor((n + a - 1) / a).cast("long")


def _scramble(x: Column, a: Column, b: Column, seed: int, inverse: bool) -> Column:
    """One pass of the network over the numbers below ``a * b``; halves are a digit below ``a`` and one below ``b``.

    Even rounds add to the first digit, modulo ``a``, a value made of the second; odd rounds the other way round.
    """
    keys = F.array(*[F.lit(k).cast("long") for k in _keys(seed)])
    order = F.sequence(F.lit(_ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(_ROUNDS - 1))
    sign = -1 if inverse else 1

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        hi = F.when(even, F.pmod(acc["hi"] + _round_value(acc["lo"], i, keys) * sign, a)).otherwise(acc["hi"])
        lo = F.when(even, acc["lo"]).otherwise(F.pmod(acc["lo"] + _round_value(acc["hi"], i, keys) * sign, b))
        return F.struct(hi.alias("hi"), lo.alias("lo"))

    start = F.struct(F.floor(x / b).cast("long").alias("hi"), (x % b).cast("long").alias("lo"))
    return F.aggregate(order, start, step, lambda acc: acc["hi"] * b + acc["lo"])


def permuted(x: Column, n: Column, seed: int, inverse: bool = False) -> Column:
    """Where a seeded permutation of ``0 .. n-1`` puts ``x``: a Feistel network with cycle walking.

    The network permutes ``0 .. a*b-1`` for the smallest fitting ``a = ceil(sqrt n)`` and ``b``, less than ``a`` numbers more
    than ``n``. A value at or above ``n`` is passed through the network again until it falls below. A cycle holds at most the
    ``a*b - n`` numbers that lie above, so that many further passes always suffice and none is cut off.
    """
    a, b = _radices(n)
    first = _scramble(x.cast("long"), a, b, seed, inverse)
    walk = F.sequence(F.lit(1).cast("long"), F.greatest(a * b - n, F.lit(1).cast("long")))
    return F.when(first < n, first).otherwise(
        F.aggregate(walk, first, lambda p, _: F.when(p < n, p).otherwise(_scramble(p, a, b, seed, inverse))))


def worker_cache(key, build):
    """``build()`` once per Python worker, until another key is asked for; kernels are shipped by value, so their own globals don't outlive a task.

    Spark reuses workers, so only the tables of the operator at work are held, not those of all operators that ran before.
    """
    import sys
    import types
    kept = sys.modules.setdefault("_treadline_worker", types.ModuleType("_treadline_worker")).__dict__
    if key not in kept:
        kept.clear()
        kept[key] = build()
    return kept[key]
