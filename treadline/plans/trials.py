"""Many trials in one run: those with faults are reported, and the rest goes on."""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treadline.session import materialise


def trial_status(rows: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row per trial: ``status`` (ok or error), ``message`` (names of the rules that are broken, with the number of rows that break each) and ``n_rows``.

    A rule is a condition that each row must meet; a missing answer counts as broken. Counts are summed map-side, so a trial of any length is one row per task.
    """
    broken = {name: F.sum((~F.coalesce(rule, F.lit(False))).cast("long")) for name, rule in rules.items()}
    d = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[n.alias(f"_b{i}") for i, n in enumerate(broken.values())])
    said = [F.when(F.col(f"_b{i}") > 0, F.concat(F.lit(f"{name}: "), F.col(f"_b{i}"))) for i, name in enumerate(broken)]
    message = F.nullif(F.concat_ws("; ", *said), F.lit("")) if said else F.lit(None).cast("string")
    d = d.withColumn("message", message)
    return d.select(*keys, F.when(F.col("message").isNull(), "ok").otherwise("error").alias("status"), "message", "n_rows")


def each_trial(rows: DataFrame, keys: Sequence[str], rules: Mapping[str, Column], plan: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Results of ``plan`` for the trials that meet all rules, and the status of every trial.

    ``rows`` come from a permissive read, so that a line that can't be parsed is a row that breaks a rule and not a failed job. The status is stored, one row per trial, and
    decides which rows go on; trials with a missing key are reported and not run.
    """
    status = materialise(trial_status(rows, keys, rules))
    good = status.where("status = 'ok'").select(*keys)
    return plan(rows.join(good, list(keys), "left_semi")), status
