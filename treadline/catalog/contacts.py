"""Step, support and coordination metrics on four contact channels per recording."""
from __future__ import annotations

from pyspark.sql import functions as F

from treadline.catalog import views as v
from treadline.catalog.registry import query
from treadline.operators import gait, steps, support

# A power of two, so that times are exact binary fractions and their sums do not depend on the order.
FPS = 128.0


def r6(df, *skip):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


STEPS = v.BOUTS + """,
nb AS (SELECT r.*, lead(s, 1) OVER w AS nx, lead(s, 2) OVER w AS td FROM runs r WINDOW w AS (PARTITION BY trial_id, limb ORDER BY s)),
agg AS (SELECT trial_id, limb, run, max(intensity) AS imax, sum(intensity) AS isum, arg_min(cx, frame) AS x0,
          max(area_px) AS amax, sum(area_px) AS asum, min(frame) AS s FROM marked GROUP BY trial_id, limb, run),
peak AS (SELECT trial_id, limb, run, min(frame) AS pk FROM
   (SELECT m.*, max(intensity) OVER (PARTITION BY trial_id, limb, run) AS mx FROM marked m) WHERE intensity = mx GROUP BY trial_id, limb, run),
b0 AS (SELECT nb.trial_id, nb.limb, nb.s, nb.e, nb.n, nb.nx, nb.td, agg.amax, agg.asum, imax, isum, pk,
         coalesce(abs(c.cx - agg.x0), 0.0) AS stride
       FROM nb JOIN agg USING (trial_id, limb, s) JOIN peak USING (trial_id, limb, run)
       LEFT JOIN contact c ON c.trial_id = nb.trial_id AND c.limb = nb.limb AND c.frame = nb.td WHERE nb.v = 1),
b1 AS (SELECT trial_id, limb, s, e, n, amax, asum, n / 128.0::DOUBLE AS stand_s, stride, coalesce(td - e, 0) AS swf,
         coalesce(td - e, 0) / 128.0::DOUBLE AS swing_s,
         CASE WHEN nx IS NULL THEN 0.0 ELSE imax END AS max_intensity, CASE WHEN nx IS NULL THEN 0.0 ELSE isum / n END AS mean_intensity,
         CASE WHEN nx IS NULL THEN 0.0 ELSE isum / 128.0::DOUBLE END AS auc,
         CASE WHEN nx IS NULL THEN 0.0 ELSE (pk - s) / 128.0::DOUBLE END AS br, CASE WHEN nx IS NULL THEN 0.0 ELSE (e - 1 - pk) / 128.0::DOUBLE END AS pr
       FROM b0),
steps AS (SELECT *, stand_s + swing_s AS cyc, CASE WHEN swing_s > 0 THEN stride / swing_s ELSE 0.0 END AS ssp,
         CASE WHEN stand_s + swing_s > 0 THEN stride / (stand_s + swing_s) ELSE 0.0 END AS spd,
         CASE WHEN br + pr > 0 THEN br / (br + pr) ELSE 0.0 END AS bi, CASE WHEN br + pr > 0 THEN pr / (br + pr) ELSE 0.0 END AS pi
       FROM b1)"""


def small(df, big=6):
    """Round: areas and stand indices are small and get nine digits, everything else six."""
    fine = ("cm2", "stand_index")
    return df.select(*[F.round(c, 9 if c.endswith(fine) else big).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


def bouts(spark, sf_dir, area=None):
    return steps.bouts(v.contact_long(spark, sf_dir), v.LIMB, FPS, area=area, size=v.SIZE)


@query("step_metrics", f"""WITH {STEPS}
SELECT trial_id, limb, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", CAST(n AS INTEGER) AS stance_frames, round(stand_s, 6) AS stand_s,
  stride AS stride_length_mm, CAST(swf AS INTEGER) AS swing_frames, round(swing_s, 6) AS swing_s, round(cyc, 6) AS step_cycle_s,
  round(ssp, 6) AS swing_speed_mm_s, round(spd, 6) AS speed_mm_s, max_intensity, round(mean_intensity, 6) AS mean_intensity,
  round(auc, 6) AS area_under_curve, round(br, 6) AS braking_s, round(pr, 6) AS propulsion_s, round(bi, 6) AS braking_index,
  round(pi, 6) AS propulsion_index FROM steps""")
def _(spark, sf_dir):
    return r6(steps.step_metrics(bouts(spark, sf_dir), v.LIMB))


def _pm(c):
    return f"coalesce(avg(CASE WHEN {c} > 0 THEN {c} END), 0.0)"


AGG_SQL = f"""
g AS (SELECT trial_id, limb, count(*) AS n_steps, max(amax) / 100.0::DOUBLE AS max_contact_area_cm2, sum(asum) / sum(n) / 100.0::DOUBLE AS avg_contact_area_cm2,
   sum(n) / 128.0::DOUBLE AS total_contact_s, max(stand_s) AS max_contact_s, {_pm('cyc')} AS step_cycle_s, {_pm('stride')} / 10 AS stride_length_cm, {_pm('stride')} / 10 AS step_length_cm,
   avg(stand_s) AS avg_stance_s, {_pm('swing_s')} AS avg_swing_s, avg(br) AS avg_braking_s, avg(pr) AS avg_propulsion_s, avg(bi) AS braking_index,
   avg(pi) AS propulsion_index, {_pm('ssp')} / 10 AS avg_swing_speed_cm_s, {_pm('spd')} / 10 AS avg_instantaneous_speed_cm_s, sum(stride) / 10 AS tot,
   max(ssp) / 10 AS peak_swing_speed_cm_s, max(max_intensity) AS max_intensity, {_pm('max_intensity')} AS avg_max_intensity, sum(auc) AS total_auc
  FROM steps GROUP BY trial_id, limb),
ag AS (SELECT t.trial_id, t.limb, coalesce(n_steps, 0) AS n_steps,
   coalesce(total_contact_s * 100 / (n_frames / 128.0::DOUBLE), 0.0) AS contact_time_pct, coalesce(tot / (n_frames / 128.0::DOUBLE), 0.0) AS total_speed_cm_s,
   coalesce(CASE WHEN step_cycle_s > 0 THEN avg_stance_s * 100 / step_cycle_s END, 0.0) AS duty_cycle_pct,
   coalesce(CASE WHEN step_cycle_s > 0 THEN avg_swing_s * 100 / step_cycle_s END, 0.0) AS swing_phase_pct,
   {', '.join(f'coalesce({c}, 0.0) AS {c}' for c in steps.LIMB_METRICS if c not in ('n_steps', 'contact_time_pct', 'total_speed_cm_s', 'duty_cycle_pct', 'swing_phase_pct'))}
  FROM total t LEFT JOIN g USING (trial_id, limb))"""


@query("limb_contact_metrics", f"""WITH {STEPS}, {AGG_SQL}
SELECT trial_id, limb, CAST(n_steps AS INTEGER) AS n_steps, {', '.join(f"round({c}, {9 if c.endswith('cm2') else 6}) AS {c}" for c in steps.LIMB_METRICS if c != 'n_steps')} FROM ag""")
def _(spark, sf_dir):
    return small(steps.limb_aggregates(bouts(spark, sf_dir, "area_px"), v.LIMB, FPS))


PRESSURE = STEPS + """,
pp AS (SELECT b0.trial_id, b0.limb, b0.s, b0.e, b0.n, b0.n / 128.0::DOUBLE AS stand_s, imax AS max_intensity, isum / b0.n AS mean_intensity,
        b0.amax / (1.0007::DOUBLE * 1.0007::DOUBLE) / 100.0::DOUBLE AS ca,
        b0.asum / 128.0::DOUBLE / (1.0007::DOUBLE * 1.0007::DOUBLE) / 100.0::DOUBLE AS pa FROM b0),
pr AS (SELECT *, mean_intensity * pa * stand_s AS si FROM pp)"""


def pressure(spark, sf_dir):
    return steps.step_pressure(v.contact_long(spark, sf_dir), v.LIMB, FPS, px_per_mm=1.0007, size=v.SIZE)


@query("step_pressure", f"""WITH {PRESSURE}
SELECT trial_id, limb, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", n AS stance_frames, round(stand_s, 6) AS stand_s, max_intensity,
  round(mean_intensity, 6) AS mean_intensity, round(ca, 9) AS max_contact_area_cm2, round(pa, 9) AS print_area_cm2, round(si, 9) AS stand_index FROM pr""")
def _(spark, sf_dir):
    return small(pressure(spark, sf_dir))


@query("limb_pressure", f"""WITH {PRESSURE},
m AS (SELECT *, max(ca) OVER (PARTITION BY trial_id, limb) AS mca FROM pr)
SELECT trial_id, limb, round(max(ca), 9) AS max_contact_area_cm2, round(sum(pa), 9) AS print_area_cm2, round(avg(mean_intensity), 6) AS mean_intensity,
  max(max_intensity) AS max_intensity, max(CASE WHEN ca = mca THEN max_intensity END) AS max_contact_max_intensity,
  round(avg(si), 9) AS avg_stand_index, round(sum(si), 9) AS total_stand_index FROM m GROUP BY trial_id, limb""")
def _(spark, sf_dir):
    return small(steps.limb_pressure(pressure(spark, sf_dir), v.LIMB))


@query("step_numbers", f"""WITH {STEPS}
SELECT trial_id, limb, CAST(s AS INTEGER) AS start, CAST(row_number() OVER (PARTITION BY trial_id, limb ORDER BY s) AS INTEGER) AS step_num FROM steps""")
def _(spark, sf_dir):
    d = steps.step_metrics(bouts(spark, sf_dir), v.LIMB).select("trial_id", "limb", "start")
    return steps.number_steps(d, v.LIMB, v.SIZE)


def _joint(limbs):
    return " AND ".join(f"{x.lower()} = 1" for x in limbs)


@query("joint_stance", f"""WITH {v.WIDE},
g AS (SELECT trial_id, count(*) FILTER (lf + rf + lh + rh > 0) AS total_active_frames,
 {', '.join(f"count(*) FILTER ({_joint(s)}) AS {('dual_' if len(s) == 2 else 'triple_') + '_'.join(s).lower()}" for s in (*support.DUAL, *support.TRIPLE))}
 FROM wide GROUP BY trial_id)
SELECT trial_id, total_active_frames,
 {', '.join(f"100.0::DOUBLE * {n} / total_active_frames AS {n}_pct" for n in (('dual_' if len(s) == 2 else 'triple_') + '_'.join(s).lower() for s in (*support.DUAL, *support.TRIPLE)))}
FROM g WHERE total_active_frames > 0""")
def _(spark, sf_dir):
    return support.joint_stance(v.contact_wide(spark, sf_dir), v.TRIAL)


@query("support_patterns", f"""WITH {v.WIDE}
SELECT trial_id, 100.0::DOUBLE * count(*) FILTER (lf + rf + lh + rh = 0) / count(*) AS support_zero_pct,
 100.0::DOUBLE * count(*) FILTER (lf + rf + lh + rh = 1) / count(*) AS support_single_pct,
 100.0::DOUBLE * count(*) FILTER (lf + rh = 2 OR rf + lh = 2) / count(*) AS support_diagonal_pct,
 100.0::DOUBLE * count(*) FILTER (lf + rf = 2 OR lh + rh = 2) / count(*) AS support_girdle_pct,
 100.0::DOUBLE * count(*) FILTER (lf + lh = 2 OR rf + rh = 2) / count(*) AS support_lateral_pct,
 100.0::DOUBLE * count(*) FILTER (lf + rf + lh + rh = 3) / count(*) AS support_three_pct,
 100.0::DOUBLE * count(*) FILTER (lf + rf + lh + rh = 4) / count(*) AS support_four_pct FROM wide GROUP BY trial_id""")
def _(spark, sf_dir):
    return support.support_patterns(v.contact_wide(spark, sf_dir), v.TRIAL)


@query("base_of_support", f"""WITH {v.LONG},
p AS (SELECT trial_id, frame, {', '.join(f"max(CASE WHEN limb = '{n}' THEN in_stance END) AS {n}, max(CASE WHEN limb = '{n}' THEN cy END) AS {n}_x" for n in ('LF', 'RF', 'LH', 'RH'))}
      FROM contact GROUP BY trial_id, frame)
SELECT trial_id, coalesce(avg(CASE WHEN LF = 1 AND RF = 1 THEN abs(LF_x - RF_x) END) / 1.0::DOUBLE / 10.0::DOUBLE, 0.0) AS bos_front_cm,
  coalesce(avg(CASE WHEN LH = 1 AND RH = 1 THEN abs(LH_x - RH_x) END) / 1.0::DOUBLE / 10.0::DOUBLE, 0.0) AS bos_hind_cm FROM p GROUP BY trial_id""")
def _(spark, sf_dir):
    wide = support.to_wide(v.contact_long(spark, sf_dir), v.TRIAL, {"cy": "x"})
    return support.base_of_support(wide, v.TRIAL)


def _coord(a, b, n):
    a, b = a.lower(), b.lower()
    return (f"coalesce(100.0::DOUBLE * count(*) FILTER ({a} = 1 AND p_{a} = 0 AND {b} = 1) / nullif(count(*) FILTER ({a} = 1 AND p_{a} = 0), 0), 0.0) AS {n}_stance_pct, "
            f"coalesce(100.0::DOUBLE * count(*) FILTER ({a} = 0 AND q_{a} = 1 AND {b} = 0) / nullif(count(*) FILTER ({a} = 0 AND q_{a} = 1), 0), 0.0) AS {n}_swing_pct")


@query("coordination", f"""WITH {v.WIDE},
l AS (SELECT *, {', '.join(f'coalesce(lag({c}) OVER w, 0) AS p_{c}, coalesce(lag({c}) OVER w, 1) AS q_{c}' for c in ('lf', 'rf', 'lh', 'rh'))}
      FROM wide WINDOW w AS (PARTITION BY trial_id ORDER BY frame))
SELECT trial_id, {', '.join(_coord(*c) for c in support.COORDINATION)} FROM l GROUP BY trial_id""")
def _(spark, sf_dir):
    return support.coordination(v.contact_wide(spark, sf_dir), v.TRIAL, size=v.SIZE)


@query("onset_regularity", f"""WITH {v.WIDE},
l AS (SELECT *, {', '.join(f'lag({c}) OVER w AS p_{c}' for c in ('lf', 'rf', 'lh', 'rh'))} FROM wide WINDOW w AS (PARTITION BY trial_id ORDER BY frame)),
o AS (SELECT *, (lf = 1 AND p_lf = 0) OR (rf = 1 AND p_rf = 0) OR (lh = 1 AND p_lh = 0) OR (rh = 1 AND p_rh = 0) AS lands FROM l)
SELECT trial_id, coalesce(100.0::DOUBLE * count(*) FILTER (lands AND lf + rf + lh + rh = 1 AND rh = 0) / nullif(count(*) FILTER (lands), 0), 0.0)
 AS regularity_index_pct FROM o GROUP BY trial_id""")
def _(spark, sf_dir):
    return support.onset_regularity(v.contact_wide(spark, sf_dir), v.TRIAL, size=v.SIZE)


OFFSETS = v.WIDE + """,
l AS (SELECT *, lf = 1 AND coalesce(lag(lf) OVER w, 0) = 0 AS lf_on, rf = 1 AND coalesce(lag(rf) OVER w, 0) = 0 AS rf_on,
   lh = 1 AND coalesce(lag(lh) OVER w, 0) = 0 AS lh_on, rh = 1 AND coalesce(lag(rh) OVER w, 0) = 0 AS rh_on
  FROM wide WINDOW w AS (PARTITION BY trial_id ORDER BY frame)),
nx AS (SELECT *, min(CASE WHEN rf_on THEN frame END) OVER w AS rf_next, min(CASE WHEN rh_on THEN frame END) OVER w AS rh_next FROM l
  WINDOW w AS (PARTITION BY trial_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
off AS (SELECT trial_id, frame AS a, rf_next AS b, 'lf_rf' AS pair FROM nx WHERE lf_on AND rf_next - frame <= 7
  UNION ALL SELECT trial_id, frame, rh_next, 'lh_rh' FROM nx WHERE lh_on AND rh_next - frame <= 7)"""


@query("next_contact_offsets", f"""WITH {OFFSETS}
SELECT trial_id, CAST(a AS INTEGER) AS a_frame, CAST(b AS INTEGER) AS b_frame, 100.0::DOUBLE * (b - a) / 7.0::DOUBLE AS offset_pct FROM off WHERE pair = 'lf_rf'""")
def _(spark, sf_dir):
    return support.contact_offsets(v.contact_wide(spark, sf_dir), v.TRIAL, "lf", "rf", 7, size=v.SIZE)


@query("phase_dispersion", f"""WITH {OFFSETS}
SELECT t.trial_id, round(coalesce(stddev_pop(CASE WHEN pair = 'lf_rf' THEN 100.0::DOUBLE * (b - a) / 7.0::DOUBLE END), 0.0), 6) AS phase_dispersion_lf_rf_pct,
  round(coalesce(stddev_pop(CASE WHEN pair = 'lh_rh' THEN 100.0::DOUBLE * (b - a) / 7.0::DOUBLE END), 0.0), 6) AS phase_dispersion_lh_rh_pct
FROM (SELECT DISTINCT trial_id FROM wide) t LEFT JOIN off USING (trial_id) GROUP BY t.trial_id""")
def _(spark, sf_dir):
    return r6(support.phase_dispersion(v.contact_wide(spark, sf_dir), v.TRIAL, 7, size=v.SIZE))


SEQ = v.LONG + """,
on4 AS (SELECT trial_id, frame, limb FROM (SELECT *, coalesce(lag(in_stance) OVER (PARTITION BY trial_id, limb ORDER BY frame), 0) AS p FROM contact)
        WHERE in_stance = 1 AND p = 0),
w4 AS (SELECT trial_id, frame, limb AS a, lead(limb, 1) OVER w AS b, lead(limb, 2) OVER w AS c, lead(limb, 3) OVER w AS d FROM on4
       WINDOW w AS (PARTITION BY trial_id ORDER BY frame, limb)),
seq AS (SELECT trial_id, frame, a || '-' || b || '-' || c || '-' || d AS footfalls FROM w4 WHERE d IS NOT NULL AND a NOT IN (b, c, d) AND b NOT IN (c, d) AND c <> d),
named AS (SELECT *, CASE footfalls """ + " ".join(
    f"WHEN '{'-'.join(s)}' THEN '{p}'" for p, s in support.STEP_PATTERNS.items()) + " END AS pattern FROM seq)"


@query("step_sequences", f"WITH {SEQ} SELECT trial_id, CAST(frame AS INTEGER) AS start, footfalls, pattern FROM named")
def _(spark, sf_dir):
    return support.step_sequences(v.contact_wide(spark, sf_dir), v.TRIAL, size=v.SIZE)


@query("step_sequence_shares", f"""WITH {SEQ}
SELECT trial_id, {', '.join(f"100.0::DOUBLE * count(*) FILTER (pattern = '{p}') / count(*) AS {p.lower()}" for p in support.STEP_PATTERNS)},
 100.0::DOUBLE * count(pattern) / count(*) AS regular FROM named GROUP BY trial_id""")
def _(spark, sf_dir):
    return support.sequence_shares(support.step_sequences(v.contact_wide(spark, sf_dir), v.TRIAL, size=v.SIZE), v.TRIAL)


@query("limb_drift_speed", f"""WITH {v.LONG},
g AS (SELECT trial_id, limb, abs(arg_max(cx, frame) - arg_min(cx, frame)) / 1.0::DOUBLE / ((max(n) - 1) / 128.0::DOUBLE) AS sp FROM
   (SELECT *, count(*) OVER (PARTITION BY trial_id, limb) AS n FROM contact) WHERE cx > 0 GROUP BY trial_id, limb)
SELECT trial_id, coalesce(median(sp), 0.0) AS body_speed_mm_s FROM g GROUP BY trial_id""")
def _(spark, sf_dir):
    return gait.limb_drift_speed(v.contact_long(spark, sf_dir), v.TRIAL, "limb", "cx", FPS)


@query("intensity_summary", f"""WITH {v.LONG},
g AS (SELECT trial_id, limb, sum(intensity + area_px) AS s, sum(intensity + area_px) / count(*) AS m, max(intensity + area_px) AS x, max(area_px) AS a
  FROM contact GROUP BY trial_id, limb),
h AS (SELECT trial_id, sum(s) AS stand_index, avg(m) AS mean_intensity, max(x) AS max_intensity, max(a) AS max_contact_area_px,
  sum(CASE WHEN limb = 'LF' THEN s END) AS l, sum(CASE WHEN limb = 'RF' THEN s END) AS r FROM g GROUP BY trial_id)
SELECT trial_id, stand_index, round(mean_intensity, 5) AS mean_intensity, max_intensity, max_contact_area_px,
  round(CASE WHEN l + r > 0 THEN abs(l - r) / (l + r) ELSE 0.0 END, 9) AS intensity_asymmetry_lf_rf FROM h""")
def _(spark, sf_dir):
    d = v.contact_long(spark, sf_dir).withColumn("intensity", F.col("intensity") + F.col("area_px"))
    d = gait.intensity_summary(d, v.TRIAL, area="area_px")
    return d.withColumns({"mean_intensity": F.round("mean_intensity", 5),
                          "intensity_asymmetry_lf_rf": F.round("intensity_asymmetry_lf_rf", 9)})


BASICS4 = v.BOUTS + """,
a4 AS (SELECT trial_id, limb, count(*) FILTER (v = 1) AS k, sum(CASE WHEN v = 1 THEN n ELSE 0 END) AS st, min(CASE WHEN v = 1 THEN s END) AS f,
   max(CASE WHEN v = 1 THEN e END) - 1 AS l, max(CASE WHEN v = 1 THEN s END) AS lo FROM runs GROUP BY trial_id, limb),
b4 AS (SELECT trial_id, limb, greatest(k - 1, 0) AS n_strides,
  CASE WHEN k > 1 THEN CAST(st AS DOUBLE) / (k - 1) * 1000.0::DOUBLE / 128.0::DOUBLE ELSE 0.0 END AS stance_ms,
  CASE WHEN k > 1 THEN CAST(l - f + 1 - st AS DOUBLE) / (k - 1) * 1000.0::DOUBLE / 128.0::DOUBLE ELSE 0.0 END AS swing_ms,
  CASE WHEN k > 1 THEN CAST(k - 1 AS DOUBLE) / ((lo - f) / 128.0::DOUBLE) ELSE 0.0 END AS stride_hz FROM a4),
sym AS (SELECT trial_id, max(CASE WHEN limb = 'LF' THEN stance_ms END) AS a, max(CASE WHEN limb = 'RF' THEN stance_ms END) AS b,
   max(CASE WHEN limb = 'LF' THEN swing_ms END) AS c, max(CASE WHEN limb = 'RF' THEN swing_ms END) AS d,
   max(CASE WHEN limb = 'LH' THEN stance_ms END) AS e, max(CASE WHEN limb = 'RH' THEN stance_ms END) AS f,
   max(CASE WHEN limb = 'LH' THEN swing_ms END) AS g, max(CASE WHEN limb = 'RH' THEN swing_ms END) AS h FROM b4 GROUP BY trial_id)"""


@query("trial_symmetry", f"""WITH {BASICS4}
SELECT trial_id, round(((CASE WHEN a + b = 0 OR c + d = 0 THEN 0.0 ELSE (1 - abs(a - b) / (a + b) + 1 - abs(c - d) / (c + d)) / 2 END)
 + (CASE WHEN e + f = 0 OR g + h = 0 THEN 0.0 ELSE (1 - abs(e - f) / (e + f) + 1 - abs(g - h) / (g + h)) / 2 END)) / 2, 9) AS gait_symmetry FROM sym""")
def _(spark, sf_dir):
    b = gait.gait_basics(v.contact_long(spark, sf_dir), v.LIMB, FPS, size=v.SIZE)
    return gait.trial_symmetry(b, v.TRIAL).withColumn("gait_symmetry", F.round("gait_symmetry", 9))
