"""Cross-limb metrics on the wide contact table: one row per frame with one 0/1 column per limb."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treadline.operators import contact, ordered
from treadline.operators.ordered import CHUNK
from treadline.schemas import LIMBS

# The six regular footfall orders.
STEP_PATTERNS = {
    "CA": ("RF", "LF", "RH", "LH"),
    "CB": ("LF", "RF", "LH", "RH"),
    "AA": ("RF", "RH", "LF", "LH"),
    "AB": ("LF", "RH", "RF", "LH"),
    "RA": ("RF", "LF", "LH", "RH"),
    "RB": ("LF", "RF", "RH", "LH"),
}
# Limb sets whose joint stance is reported.
DUAL = (("LF", "LH"), ("RF", "RH"), ("LF", "RH"), ("RF", "LH"))
TRIPLE = (("LF", "LH", "RF"), ("LF", "LH", "RH"), ("RF", "RH", "LF"), ("RF", "RH", "LH"))
# Limb pairs of the coordination metrics.
COORDINATION = (("LH", "RH", "homologous"), ("LH", "LF", "ipsilateral_lh_lf"), ("RH", "RF", "ipsilateral_rh_rf"),
                ("LH", "RF", "diagonal_lh_rf"), ("RH", "LF", "diagonal_rh_lf"))

COLS = {limb: limb.lower() for limb in LIMBS}


def to_wide(df: DataFrame, trial: Sequence[str], measures: Mapping[str, str] | None = None, limb: str = "limb",
            value: str = "in_stance", frame: str = "frame") -> DataFrame:
    """Long contact rows to one row per frame; a limb without a row is 0. ``measures`` maps a column to its suffix."""
    picks = [F.coalesce(F.max(F.when(F.col(limb) == n, F.col(value))), F.lit(0)).alias(c) for n, c in COLS.items()]
    for col, suffix in (measures or {}).items():
        picks += [F.coalesce(F.max(F.when(F.col(limb) == n, F.col(col))), F.lit(0.0)).alias(f"{c}_{suffix}")
                  for n, c in COLS.items()]
    return df.groupBy(*trial, frame).agg(*picks)


def _all(limbs: Sequence[str]) -> Column:
    c = F.col(COLS[limbs[0]]) == 1
    for n in limbs[1:]:
        c = c & (F.col(COLS[n]) == 1)
    return c


def any_contact() -> Column:
    return (F.col("lf") + F.col("rf") + F.col("lh") + F.col("rh")) > 0


def joint_stance(wide: DataFrame, trial: Sequence[str]) -> DataFrame:
    """Share of the frames with any contact on which a set of limbs is in stance together; no contact, no row."""
    sets = {("dual_" if len(s) == 2 else "triple_") + "_".join(s).lower() + "_pct": s for s in (*DUAL, *TRIPLE)}
    g = wide.groupBy(*trial).agg(F.count_if(any_contact()).alias("total_active_frames"),
                                 *[F.count_if(_all(s)).alias(n) for n, s in sets.items()])
    return g.where("total_active_frames > 0").select(
        *trial, "total_active_frames", *[(100.0 * F.col(n) / F.col("total_active_frames")).alias(n) for n in sets])


def support_patterns(wide: DataFrame, trial: Sequence[str]) -> DataFrame:
    """Share of all frames per support category; the two-limb categories overlap with three- and four-limb support."""
    n = F.col("lf") + F.col("rf") + F.col("lh") + F.col("rh")
    pair = lambda a, b: _all((a, b))
    cats = {
        "zero": n == 0, "single": n == 1, "diagonal": pair("LF", "RH") | pair("RF", "LH"),
        "girdle": pair("LF", "RF") | pair("LH", "RH"), "lateral": pair("LF", "LH") | pair("RF", "RH"),
        "three": n == 3, "four": n == 4}
    return wide.groupBy(*trial).agg(
        *[(100.0 * F.count_if(c) / F.count(F.lit(1))).alias(f"support_{k}_pct") for k, c in cats.items()])


def base_of_support(wide: DataFrame, trial: Sequence[str], suffix: str = "x", px_per_mm: float = 1.0) -> DataFrame:
    """Mean lateral distance of the fore and of the hind pair while both limbs are in stance, in cm."""
    def width(a: str, b: str) -> Column:
        d = F.abs(F.col(f"{a}_{suffix}") - F.col(f"{b}_{suffix}"))
        mean = F.avg(F.when((F.col(a) == 1) & (F.col(b) == 1), d))
        return F.coalesce(mean / float(px_per_mm) / 10.0, F.lit(0.0))
    return wide.groupBy(*trial).agg(width("lf", "rf").alias("bos_front_cm"), width("lh", "rh").alias("bos_hind_cm"))


def coordination(wide: DataFrame, trial: Sequence[str], frame: str = "frame", size: int = CHUNK) -> DataFrame:
    """Share of a limb's stance (swing) onsets at which the other limb is in stance (swing); 0 without onsets."""
    d = wide.select(*trial, frame, *COLS.values(), *[(1 - F.col(c)).alias(f"{c}_sw") for c in COLS.values()])
    d = contact.onsets(d, trial, (*COLS.values(), *[f"{c}_sw" for c in COLS.values()]), frame, size)

    def pct(on: str, other: str) -> Column:
        both = F.count_if((F.col(on) == 1) & (F.col(other) == 1))
        return F.coalesce(F.try_divide(100.0 * both, F.sum(on)), F.lit(0.0))

    return d.groupBy(*trial).agg(*[
        c for a, b, n in COORDINATION for c in (
            pct(f"{COLS[a]}_on", COLS[b]).alias(f"{n}_stance_pct"),
            pct(f"{COLS[a]}_sw_on", f"{COLS[b]}_sw").alias(f"{n}_swing_pct"))])


def onset_regularity(wide: DataFrame, trial: Sequence[str], fixed: bool = False, frame: str = "frame",
                     size: int = CHUNK) -> DataFrame:
    """Share of touchdown frames with a regular support pattern.

    A touchdown frame is any frame but the first on which some limb enters stance. The compatible set of regular
    patterns has LF, RF or LH alone in stance; ``fixed=True`` also accepts RH alone.
    """
    shift = {f"_{c}": (lambda w, c=c: F.lag(c).over(w)) for c in COLS.values()}
    d = ordered.over_halo(wide.select(*trial, frame, *COLS.values()), trial, shift, frame, before=1, size=size)
    lands = F.lit(False)
    for c in COLS.values():
        lands = lands | ((F.col(c) == 1) & (F.col(f"_{c}") == 0))
    alone = (F.col("lf") + F.col("rf") + F.col("lh") + F.col("rh")) == 1
    regular = alone if fixed else alone & (F.col("rh") == 0)
    lands = F.coalesce(lands, F.lit(False))
    return d.groupBy(*trial).agg(
        F.coalesce(F.try_divide(100.0 * F.count_if(lands & regular), F.count_if(lands)), F.lit(0.0))
        .alias("regularity_index_pct"))


def contact_offsets(wide: DataFrame, trial: Sequence[str], a: str, b: str, fps: float, frame: str = "frame",
                    size: int = CHUNK) -> DataFrame:
    """Forward as-of join: for every onset of ``a`` the first onset of ``b`` strictly later, within one second.

    The tolerance bounds how far ahead a match can lie, so a halo of that many frames makes the chunks independent.
    """
    reach = max(int(fps), 1)
    d = contact.onsets(wide.select(*trial, frame, a, b), trial, (a, b), frame, size)
    d = d.where((F.col(f"{a}_on") == 1) | (F.col(f"{b}_on") == 1))
    d = ordered.halo(d, frame, after=reach, size=max(size, reach))
    back = ordered.Window.partitionBy(*trial, "_chunk").orderBy(F.desc(frame))
    nxt = F.last(F.when(F.col(f"{b}_on") == 1, F.col(frame)), ignorenulls=True).over(
        back.rowsBetween(ordered.Window.unboundedPreceding, -1))
    d = d.withColumn("_b", nxt)
    gap = F.col("_b") - F.col(frame)
    return (d.where(~F.col("_halo") & (F.col(f"{a}_on") == 1) & (gap <= reach))
            .select(*trial, F.col(frame).alias("a_frame"), F.col("_b").alias("b_frame"),
                    (100.0 * gap / float(reach)).alias("offset_pct")))


def phase_dispersion(wide: DataFrame, trial: Sequence[str], fps: float, frame: str = "frame",
                     size: int = CHUNK) -> DataFrame:
    """Population deviation of the touchdown offsets LF->RF and LH->RH; 0 without offsets."""
    parts = None
    for a, b in (("lf", "rf"), ("lh", "rh")):
        o = contact_offsets(wide, trial, a, b, fps, frame, size).select(
            *trial, F.lit(f"{a}_{b}").alias("pair"), "offset_pct")
        parts = o if parts is None else parts.unionByName(o)
    sd = lambda p: F.coalesce(F.stddev_pop(F.when(F.col("pair") == p, F.col("offset_pct"))), F.lit(0.0))
    all_trials = wide.select(*trial).distinct()
    g = parts.groupBy(*trial).agg(sd("lf_rf").alias("phase_dispersion_lf_rf_pct"),
                                  sd("lh_rh").alias("phase_dispersion_lh_rh_pct"))
    return all_trials.join(g, list(trial), "left").na.fill(0.0)


def step_sequences(wide: DataFrame, trial: Sequence[str], frame: str = "frame", size: int = CHUNK) -> DataFrame:
    """Every window of four successive touchdowns with its footfall order, named if it is one of the six regular ones.

    Touchdowns are ordered by frame, then by limb name. Windows in which a limb occurs twice are left out.
    """
    d = contact.onsets(wide.select(*trial, frame, *COLS.values()), trial, tuple(COLS.values()), frame, size)
    rank = {n: i for i, n in enumerate(sorted(COLS))}
    hits = F.array_compact(F.array(*[
        F.when(F.col(f"{c}_on") == 1, F.struct((F.col(frame).cast("long") * 4 + rank[n]).alias("o"), F.lit(n).alias("limb")))
        for n, c in COLS.items()]))
    ev = d.select(*trial, frame, F.explode(hits).alias("h")).select(*trial, frame, "h.o", "h.limb")
    ev = ordered.neighbours(ev, trial, "o", {f"_l{i}": ("limb", i) for i in (1, 2, 3)}, size * 4)
    four = F.array("limb", "_l1", "_l2", "_l3")
    ev = ev.where("_l3 is not null").where(F.size(F.array_distinct(four)) == 4)
    name = F.create_map(*[F.lit(v) for p, seq in STEP_PATTERNS.items() for v in ("-".join(seq), p)])
    order = F.array_join(four, "-")
    return ev.select(*trial, F.col(frame).alias("start"), order.alias("footfalls"), name[order].alias("pattern"))


def sequence_shares(sequences: DataFrame, trial: Sequence[str]) -> DataFrame:
    """Share of each regular order among the windows, and of all of them together (the regularity index)."""
    n = F.count(F.lit(1))
    return sequences.groupBy(*trial).agg(
        *[(100.0 * F.count_if(F.col("pattern") == p) / n).alias(p.lower()) for p in STEP_PATTERNS],
        (100.0 * F.count("pattern") / n).alias("regular"))
