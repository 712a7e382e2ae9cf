"""Ordered operators that never put a whole recording into one task.

A recording ("trial") can hold a third of all rows, so no window here is partitioned by the trial alone over frame rows.
Frames are cut into fixed-size chunks; windows run inside ``(keys, chunk)``, and what must cross a chunk edge travels
either as a *halo* (the few rows next to the edge are copied to the neighbouring chunk before the shuffle) or as a
*carry* (one summary row per chunk, scanned over the chunks of a trial). Summary rows are ``1/size`` of the input, so a
window over all chunks of one trial stays small whatever the trial's length.

``keys`` are the columns that identify one ordered channel, e.g. ``["trial_id", "limb"]``; ``frame`` is unique in it.
"""
from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treadline.session import materialise

CHUNK = 1 << 16
_UNB = Window.unboundedPreceding
_END = Window.unboundedFollowing
_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def _chunk(frame: str, size: int) -> Column:
    return F.floor(F.col(frame) / F.lit(size))


def _given(columns: Sequence[str]) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in columns])


def with_chunk(df: DataFrame, frame: str = "frame", size: int = CHUNK) -> DataFrame:
    return df.withColumn("_chunk", _chunk(frame, size))


def chunk_window(keys: Sequence[str], frame: str = "frame") -> Window:
    return Window.partitionBy(*keys, "_chunk").orderBy(frame)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], slot: Column, name: str = "frame",
                start: int = 0) -> DataFrame:
    """``row_number`` over ``keys`` ordered by ``order``, without sorting a whole key in one task.

    ``slot`` is any expression that does not decrease along ``order`` (an hour, a minute, a range bucket). Rows are
    counted per ``(keys, slot)`` first; the running count of earlier slots is the offset of the numbers in a slot.
    """
    base = df.withColumn("_slot", slot)
    counts = base.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(
        F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slot").rowsBetween(_UNB, -1)), F.lit(0))
    offsets = counts.select(*keys, "_slot", before.alias("_before"))
    in_slot = F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy(*order))
    # The window comes first: its order serves the join, so rows are sorted once.
    return (base.withColumn("_in_slot", in_slot).join(offsets, [*keys, "_slot"])
            .withColumn(name, (F.col("_before") + F.col("_in_slot") - 1 + start).cast("int"))
            .drop("_slot", "_in_slot", "_before"))


def middle(values: Column) -> Column:
    """Median of an array without nulls; null for an empty one.

    For moving medians: gathering a short window is cheap on every row, and its sort is only paid on rows that use the result. The aggregate function would count and sort each window anew.
    """
    s = F.sort_array(values)
    n = F.size(values)
    low, high = (F.get(s, F.floor(k / 2).cast("int")).cast("double") for k in (n - 1, n))
    return F.when(n > 0, low * 0.5 + high * 0.5)


def quantile(df: DataFrame, keys: Sequence[str], value: str, slot: Column, name: str, share: float = 0.5) -> DataFrame:
    """Exact quantile per key by rank, between neighbours by straight line: one row per key with at least one value.

    The built-in aggregate holds all distinct values of a key in one buffer. Here equal values are counted first, so a value that
    most rows have is one row; a key is then ranked in slots of its values (``slot`` must not decrease with the value),
    and only the one or two values around the wanted rank go on.
    """
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), slot.alias("_slot"))
    d = d.groupBy(*keys, "_slot", "_v").agg(F.count(F.lit(1)).alias("_n"))
    counts = d.groupBy(*keys, "_slot").agg(F.sum("_n").alias("_rows"))
    w = Window.partitionBy(*keys)
    seen = F.sum("_rows").over(w.orderBy("_slot").rowsBetween(_UNB, 0))
    counts = counts.select(*keys, "_slot", (seen - F.col("_rows")).alias("_before"), (F.sum("_rows").over(w) - 1).alias("_last"), "_rows")
    at = F.col("_last") * F.lit(float(share))
    lo, hi = F.floor(at), F.ceil(at)
    # Only the slots that hold a wanted row are ranked.
    counts = counts.where((F.col("_before") <= hi) & (F.col("_before") + F.col("_rows") > lo)).drop("_rows")
    to = F.sum("_n").over(Window.partitionBy(*keys, "_slot").orderBy("_v").rowsBetween(_UNB, 0)) + F.col("_before")
    d = d.join(counts, [*keys, "_slot"]).withColumn("_to", to)
    d = d.where((F.col("_to") - F.col("_n") <= hi) & (F.col("_to") > lo))
    g = d.groupBy(*keys).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.max(at - lo).alias("_w"))
    between = F.col("_a") * (1 - F.col("_w")) + F.col("_b") * F.col("_w")
    return g.select(*keys, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(between).alias(name))


def median(df: DataFrame, keys: Sequence[str], value: str, slot: Column, name: str) -> DataFrame:
    """Exact median per key, as :func:`quantile` finds it."""
    return quantile(df, keys, value, slot, name)


def halo(df: DataFrame, frame: str = "frame", before: int = 0, after: int = 0, size: int = CHUNK) -> DataFrame:
    """Tag rows with ``_chunk`` and copy the ``before`` / ``after`` rows at chunk edges into the next / previous chunk.

    Copies carry ``_halo = true`` and are to be dropped once the window values have been computed.
    """
    if max(before, after) > size:
        raise ValueError("halo wider than a chunk")
    chunk = _chunk(frame, size)
    rest = F.col(frame) - chunk * size
    target = lambda c, h: F.array(F.struct(c.alias("c"), F.lit(h).alias("h")))
    # No lambda function here: with one, Spark doesn't see that two branches read the same shuffle.
    copy = lambda c, near: F.slice(target(c, True), F.lit(1), near.cast("int"))
    targets = [target(chunk, False)]
    if before:
        targets.append(copy(chunk + 1, rest >= size - before))
    if after:
        targets.append(copy(chunk - 1, (rest < after) & (chunk > 0)))
    return (df.withColumn("_t", F.explode(F.concat(*targets)))
            .withColumn("_chunk", F.col("_t.c")).withColumn("_halo", F.col("_t.h")).drop("_t"))


def over_halo(df: DataFrame, keys: Sequence[str], columns: Mapping[str, object], frame: str = "frame",
              before: int = 0, after: int = 0, size: int = CHUNK) -> DataFrame:
    """Add window columns that look at most ``before`` frames back and ``after`` frames ahead on a dense channel.

    Each value of ``columns`` is a function from the chunk window to a Column.
    """
    w = chunk_window(keys, frame)
    out = halo(df, frame, before, after, size)
    out = out.withColumns({name: make(w) for name, make in columns.items()})
    return out.where(~F.col("_halo")).drop("_halo", "_chunk")


def carry(df: DataFrame, keys: Sequence[str], summaries: Mapping[str, Column], carried: Mapping[str, object]) -> DataFrame:
    """Join to every row of a chunked table values computed over the *other* chunks of its key.

    ``summaries`` aggregates each ``(keys, _chunk)``; ``carried`` maps a name to a function from the two windows over
    chunks (ascending, descending) to a Column on those summaries. "All later chunks" is read with the descending
    window, because a frame that starts at the current row and is open at the end costs quadratic time.

    The summary reads every column of ``df`` (a hash that is never null). Column pruning would otherwise give it a
    narrower shuffle of its own, and everything upstream would run twice; this way Spark reuses the one shuffle. For the
    same reason the join's filter on null keys stands before the branches: Spark would push it below the shuffle in one only.
    """
    df = df.where(_given([*keys, "_chunk"]))
    per_chunk = (df.groupBy(*keys, "_chunk")
                 .agg(*[c.alias(n) for n, c in summaries.items()], F.max(F.xxhash64(*df.columns)).alias("_all"))
                 .where("_all is not null"))
    up = Window.partitionBy(*keys).orderBy("_chunk")
    down = Window.partitionBy(*keys).orderBy(F.desc("_chunk"))
    side = per_chunk.select(*keys, "_chunk", *[make(up, down).alias(n) for n, make in carried.items()])
    return df.join(side, [*keys, "_chunk"])


def with_totals(df: DataFrame, keys: Sequence[str], totals: Mapping[str, tuple[str, Column]], frame: str = "frame",
                size: int = CHUNK) -> DataFrame:
    """Join per-key totals (``"sum" | "min" | "max"``) back to the rows, spread by chunk rather than by key."""
    d = with_chunk(df, frame, size)
    d = carry(d, keys, {f"_t_{n}": _MERGE[k](c) for n, (k, c) in totals.items()},
              {n: (lambda up, _, n=n, k=k: _MERGE[k](f"_t_{n}").over(up.rowsBetween(_UNB, _END)))
               for n, (k, _) in totals.items()})
    return d.drop("_chunk")


def running_sum(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], frame: str = "frame",
                size: int = CHUNK) -> DataFrame:
    """Cumulative sums along a channel: the sum inside the chunk plus the total of the earlier chunks."""
    d = with_chunk(df, frame, size).withColumns({f"_v_{n}": c for n, c in sums.items()})
    d = carry(d, keys, {f"_s_{n}": F.sum(f"_v_{n}") for n in sums},
              {f"_b_{n}": (lambda up, _, n=n: F.coalesce(F.sum(f"_s_{n}").over(up.rowsBetween(_UNB, -1)), F.lit(0)))
               for n in sums})
    w = chunk_window(keys, frame).rowsBetween(_UNB, 0)
    d = d.withColumns({n: F.sum(f"_v_{n}").over(w) + F.col(f"_b_{n}") for n in sums})
    return d.drop("_chunk", *[f"_v_{n}" for n in sums], *[f"_b_{n}" for n in sums])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from sorted Arrow batches, with the row at which each group begins.

    The group a batch ends in is held back and joined to the next, so a task holds one batch and one group.
    """
    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        before = [held[-1].slice(held[-1].num_rows - 1)] if held else []
        seen = pa.concat_tables([*before, t]).select(list(keys)).combine_chunks()
        new = np.zeros(seen.num_rows, dtype=bool)
        new[0] = not held
        for k in keys:
            new[1:] |= pc.not_equal(seen[k].slice(1), seen[k].slice(0, seen.num_rows - 1)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(new[len(before):])
        if len(at):
            whole = [*held, t.slice(0, at[-1])]
            whole = pa.concat_tables(whole).combine_chunks()
            if whole.num_rows:
                done = at[:-1] + whole.num_rows - at[-1]
                yield whole, np.append([0], done) if held else done
            held = []
        held.append(t.slice(at[-1] if len(at) else 0))
    if held:
        yield pa.concat_tables(held).combine_chunks(), np.array([0])


def _known(t: pa.Table, value: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values, which of them are there, and the nearest earlier and later row of the group with one (-1, past the end)."""
    column, n = t[value], t.num_rows
    ok = column.is_valid().to_numpy()
    x = pc.cast(column, pa.float64(), safe=False).fill_null(0.0).to_numpy()
    row, size = np.arange(n), np.diff(np.append(starts, n))
    before = np.maximum.accumulate(np.where(ok, row, -1))
    after = np.minimum.accumulate(np.where(ok, row, n)[::-1])[::-1]
    before = np.where(before >= np.repeat(starts, size), before, -1)
    after = np.where(after < np.repeat(starts + size, size), after, n)
    return x, ok, before, after


_SIDES = ("_first_f", "_first_v", "_last_f", "_last_v")
_CARRIED = ("_pf", "_pv", "_nf", "_nv")


def interpolated(df: DataFrame, keys: Sequence[str], values: Sequence[str], frame: str = "frame", size: int = CHUNK) -> DataFrame:
    """Missing values on the straight line between the nearest earlier and later ones; ends hold the nearest value, and a
    channel without any value becomes 0.

    Chunks are sorted once and filled as arrays, all columns in one pass. Only chunks of channels with more than one chunk get the
    nearest values of the other chunks, on their first row.
    """
    names, values, group = df.columns, list(values), [*keys, "_chunk"]
    d = with_chunk(df.where(_given(keys)), frame, size).repartition(*group)
    fields = {f.name: f.dataType.simpleString() for f in d.schema}
    head = ", ".join(f"`{k}` {fields[k]}" for k in group)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, group):
            n, f = t.num_rows, t[frame].to_numpy()
            stops = np.append(starts[1:], n)
            parts: list[list] = [[], [], [], []]
            for v in values:
                ok = np.flatnonzero(t[v].is_valid().to_numpy())
                x = pc.cast(t[v], pa.float64(), safe=False).fill_null(0.0).to_numpy()
                first, past = np.searchsorted(ok, starts), np.searchsorted(ok, stops)
                none = first == past
                for i, at in ((0, first), (2, past - 1)):
                    at = np.zeros(len(starts), int) if not len(ok) else ok[np.where(none, 0, at)]
                    parts[i].append((f[at], none))
                    parts[i + 1].append((x[at], none))
            offsets = pa.array(np.arange(len(starts) + 1) * len(values), pa.int32())
            lists = []
            for i, part in enumerate(parts):
                flat, none = (np.stack(c, axis=1).ravel() for c in zip(*part))
                lists.append(pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float64() if i % 2 else pa.int64(), mask=none)))
            rows = t.select(group).take(pa.array(starts)).combine_chunks()
            columns = [rows[k].chunk(0) for k in group] + [pa.array(f[starts], pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=[*group, "_at", *_SIDES])

    lists = ", ".join(f"{n} array<{'bigint' if n.endswith('_f') else 'double'}>" for n in _SIDES)
    side = d.sortWithinPartitions(*group, frame).mapInArrow(ends, f"{head}, _at bigint, {lists}")
    whole = Window.partitionBy(*keys)
    side = side.withColumn("_chunks", F.count(F.lit(1)).over(whole)).where("_chunks > 1")
    up, down = (whole.orderBy(o).rowsBetween(_UNB, -1) for o in ("_chunk", F.desc("_chunk")))
    near = lambda c, w: F.array(*[F.last(F.get(c, F.lit(i)), ignorenulls=True).over(w) for i in range(len(values))])
    side = side.select(*group, "_at", *[near(c, w).alias(n) for n, c, w in zip(
        _CARRIED, ("_last_f", "_last_v", "_first_f", "_first_v"), (up, up, down, down))])
    # Empty arrays on all other rows, not nulls: Spark's Arrow writer takes quadratic time for the null lists of a batch.
    d = d.join(side, group, "left").withColumns({n: F.coalesce(F.when(F.col(frame) == F.col("_at"), F.col(n)), F.array().cast(
        f"array<{'bigint' if n.endswith('f') else 'double'}>")) for n in _CARRIED}).drop("_at")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, group):
            n, f = t.num_rows, t[frame].to_numpy()
            row, size_of, far = np.arange(n), np.diff(np.append(starts, n)), None
            if pc.max(pc.list_value_length(t[_CARRIED[0]])).as_py():
                none = [None] * len(values)
                far = [np.array([r or none for r in t[c].take(pa.array(starts)).to_pylist()], dtype=float) for c in _CARRIED]
            for v in values:
                if not t[v].null_count:
                    done = pc.cast(t[v], pa.float64(), safe=False)
                else:
                    x, ok, before, after = _known(t, v, starts)
                    back, ahead = before >= 0, after < n
                    before, after = np.where(back, before, row), np.where(ahead, after, row)
                    pf, pv, nf, nv = f[before], x[before], f[after], x[after]
                    if far is not None:
                        lf, lv, rf, rv = (np.repeat(c[:, values.index(v)], size_of) for c in far)
                        pf, pv, nf, nv = np.where(back, pf, lf), np.where(back, pv, lv), np.where(ahead, nf, rf), np.where(ahead, nv, rv)
                        back, ahead = back | ~np.isnan(lf), ahead | ~np.isnan(rf)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        line = pv + (nv - pv) * (f - pf) / (nf - pf)
                    done = np.where(ok, x, np.where(back & ahead, line, np.where(back, pv, np.where(ahead, nv, 0.0))))
                t = t.set_column(t.column_names.index(v), v, done if isinstance(done, pa.ChunkedArray) else pa.chunked_array([done]))
            yield from t.select(names).to_batches()

    schema = ", ".join(f"`{c}` {'double' if c in values else fields[c]}" for c in names)
    return d.sortWithinPartitions(*group, frame).mapInArrow(fill, schema)


def neighbours(df: DataFrame, keys: Sequence[str], order: str, shifts: Mapping[str, tuple[Column | str, int]],
               size: int = CHUNK, totals: Mapping[str, tuple[str, Column]] | None = None) -> DataFrame:
    """``lag`` (negative offset) and ``lead`` (positive offset) on a *sparse* ordered table, e.g. a table of runs.

    The neighbour of a row may sit many chunks away, so each chunk's first and last few rows are carried over the
    (non-empty) chunks of the key. ``totals`` are per-key totals (see :func:`with_totals`) taken along in the same pass.
    """
    back = max((-o for _, o in shifts.values() if o < 0), default=0)
    ahead = max((o for _, o in shifts.values() if o > 0), default=0)
    as_col = {n: (F.col(c) if isinstance(c, str) else c) for n, (c, _) in shifts.items()}
    d = with_chunk(df, order, size).withColumn(
        "_row", F.struct(F.col(order).alias("_o"), *[c.alias(n) for n, c in as_col.items()]))
    w = chunk_window(keys, order)
    d = d.withColumns({"_rn": F.row_number().over(w),
                       "_cnt": F.count(F.lit(1)).over(Window.partitionBy(*keys, "_chunk"))})
    summaries = {f"_t_{n}": _MERGE[k](c) for n, (k, c) in (totals or {}).items()}
    carried = {n: (lambda up, _, n=n, k=k: _MERGE[k](f"_t_{n}").over(up.rowsBetween(_UNB, _END)))
               for n, (k, _) in (totals or {}).items()}
    if ahead:
        summaries["_heads"] = F.array_sort(F.collect_list(F.when(F.col("_rn") <= ahead, F.col("_row"))))
        carried["_after"] = lambda w, _: F.flatten(F.collect_list("_heads").over(w.rowsBetween(1, ahead)))
    if back:
        summaries["_tails"] = F.array_sort(F.collect_list(
            F.when(F.col("_cnt") - F.col("_rn") < back, F.col("_row"))))
        carried["_before"] = lambda w, _: F.flatten(F.collect_list("_tails").over(w.rowsBetween(-back, -1)))
    d = carry(d, keys, summaries, carried)
    cols = {}
    for name, (_, off) in shifts.items():
        if off > 0:
            far = F.get("_after", (F.lit(off - 1) - (F.col("_cnt") - F.col("_rn"))).cast("int"))
            row = F.coalesce(F.lead("_row", off).over(w), F.when(F.col("_cnt") - F.col("_rn") < off, far))
        else:
            k = -off
            far = F.get("_before", (F.size("_before") - (F.lit(k) - (F.col("_rn") - 1))).cast("int"))
            missing = F.lit(k) - (F.col("_rn") - 1)
            row = F.coalesce(F.lag("_row", k).over(w),
                             F.when((missing > 0) & (missing <= F.size("_before")), far))
        cols[name] = row.getField(name)
    d = d.withColumns(cols)
    return d.drop("_chunk", "_row", "_rn", "_cnt", "_after", "_before")


def islands(df: DataFrame, keys: Sequence[str], frame: str = "frame", last: str | None = None,
            value: str | None = None, gap: int = 1, aggs: Mapping[str, tuple[str, Column]] | None = None,
            size: int = CHUNK, stored: bool = False) -> DataFrame:
    """Gaps and islands: maximal stretches with steps of at most ``gap`` frames and, if given, one ``value``.

    Rows are frames, or intervals ``[frame, last]`` that do not overlap. Every chunk yields its own stretches
    ("fragments"); only the first and last fragment of a chunk can continue in another chunk, so only those are merged
    over the chunks of a key. ``aggs`` maps a name to ``("sum" | "min" | "max" | "start", Column)``, computed per island;
    ``start`` is the value on its first row. ``stored`` writes the fragments and the merged ones to the shared folder, so
    that the rows are read, shuffled and sorted once.

    Returns ``keys, start, end`` (exclusive), ``n_rows``, ``value`` if given, and the aggregates.
    """
    def merge(kind: str, c: str, order: str) -> Column:
        return F.min_by(c, order) if kind == "start" else _MERGE[kind](c)

    aggs = dict(aggs or {})
    stop = last or frame
    d = with_chunk(df, frame, size).withColumns({f"_a_{n}": c for n, (_, c) in aggs.items()})
    d = d.select(*dict.fromkeys([*keys, "_chunk", frame, stop, *([value] if value else []),
                                 *[f"_a_{n}" for n in aggs]]))
    w = chunk_window(keys, frame)
    prev = F.lag(stop).over(w)
    brk = prev.isNull() | (F.col(frame) - prev > gap)
    if value:
        brk = brk | ~F.lag(value).over(w).eqNullSafe(F.col(value))
    d = d.withColumn("_brk", brk.cast("int"))
    d = d.withColumn("_frag", F.sum("_brk").over(w.rowsBetween(_UNB, 0)))
    vals = [F.first(value).alias(value)] if value else []
    frag = d.groupBy(*keys, "_chunk", "_frag").agg(
        F.min(frame).alias("_s"), F.max(stop).alias("_e"), F.count(F.lit(1)).alias("n_rows"), *vals,
        *[merge(k, f"_a_{n}", frame).alias(n) for n, (k, _) in aggs.items()])
    top = F.max("_frag").over(Window.partitionBy(*keys, "_chunk"))
    frag = frag.withColumn("_edge", (F.col("_frag") == 1) | (F.col("_frag") == top))
    frag = materialise(frag) if stored else frag
    cols = [*keys, "_s", "_e", "n_rows", *([value] if value else []), *aggs]
    inner = frag.where(~F.col("_edge")).select(*cols)

    we = Window.partitionBy(*keys).orderBy("_s")
    edge = frag.where(F.col("_edge"))
    pe = F.lag("_e").over(we)
    ebrk = (pe.isNull() | (F.col("_s") - pe > gap) | F.lag("_chunk").over(we).eqNullSafe(F.col("_chunk")))
    if value:
        ebrk = ebrk | ~F.lag(value).over(we).eqNullSafe(F.col(value))
    edge = edge.withColumn("_brk", ebrk.cast("int"))
    edge = edge.withColumn("_isl", F.sum("_brk").over(we.rowsBetween(_UNB, 0)))
    merged = edge.groupBy(*keys, "_isl").agg(
        F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.sum("n_rows").alias("n_rows"), *vals,
        *[merge(k, n, "_s").alias(n) for n, (k, _) in aggs.items()]).select(*cols)
    merged = materialise(merged) if stored else merged
    return (inner.unionByName(merged)
            .withColumn("start", F.col("_s")).withColumn("end", F.col("_e") + 1)
            .select(*keys, "start", "end", "n_rows", *([value] if value else []), *aggs))


def stretch_starts(df: DataFrame, keys: Sequence[str], gap: int, frame: str = "frame", name: str = "_stretch",
                   size: int = CHUNK) -> DataFrame:
    """Tag every row with the first frame of its stretch (steps of at most ``gap`` frames); frames may repeat.

    A chunk knows its own stretches; only its first one can have begun earlier, which one summary row per chunk resolves.
    """
    d = with_chunk(df, frame, size)
    w = chunk_window(keys, frame)
    prev = F.lag(frame).over(w)
    d = d.withColumn("_open", F.when(prev.isNull() | (F.col(frame) - prev > gap), F.col(frame)))
    d = d.withColumn("_own", F.last("_open", ignorenulls=True).over(w.rowsBetween(_UNB, 0)))
    side = d.groupBy(*keys, "_chunk").agg(F.min(frame).alias("_f0"), F.max(frame).alias("_l0"), F.max("_own").alias("_o"))
    up = Window.partitionBy(*keys).orderBy("_chunk")
    side = side.withColumn("_joined", F.coalesce(F.col("_f0") - F.lag("_l0").over(up) <= gap, F.lit(False)))
    side = side.withColumn("_tail", F.when(~F.col("_joined") | (F.col("_o") != F.col("_f0")), F.col("_o")))
    side = side.select(*keys, "_chunk", "_f0", F.when(F.col("_joined"), F.last("_tail", ignorenulls=True).over(
        up.rowsBetween(_UNB, -1))).alias("_from"))
    d = d.join(side, [*keys, "_chunk"])
    first = (F.col("_own") == F.col("_f0")) & F.col("_from").isNotNull()
    return (d.withColumn(name, F.when(first, F.col("_from")).otherwise(F.col("_own")))
            .drop("_chunk", "_open", "_own", "_f0", "_from"))


def expand(df: DataFrame, start: str = "start", end: str = "end", name: str = "frame", size: int = CHUNK) -> DataFrame:
    """One row per frame of every interval ``[start, end)``; long intervals are first split by chunk, so that no single
    row holds a long sequence and the pieces can be spread."""
    d = df.withColumn("_c", F.explode(F.sequence(_chunk(start, size), F.floor((F.col(end) - 1) / size))))
    lo = F.greatest(F.col(start), F.col("_c") * size)
    hi = F.least(F.col(end) - 1, (F.col("_c") + 1) * size - 1)
    return d.withColumn(name, F.explode(F.sequence(lo.cast("int"), hi.cast("int")))).drop("_c")
