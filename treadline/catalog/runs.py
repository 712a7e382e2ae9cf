"""Runs, contact signals and timing on the events table."""
from __future__ import annotations

from pyspark.sql import functions as F

from treadline.catalog import views as v
from treadline.catalog.registry import query
from treadline.operators import contact, gait, ordered

FPS = 100.0

# Contact of the samples: in stance when k < 50.
SIGNAL = v.SAMPLES + """,
sig AS (SELECT trial_id, frame, x, k, CASE WHEN k < 50 THEN 1 ELSE 0 END AS v FROM samples),
fl AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY trial_id ORDER BY frame) THEN 0 ELSE 1 END AS brk FROM sig),
mk AS (SELECT *, sum(brk) OVER (PARTITION BY trial_id ORDER BY frame) AS run FROM fl),
runs AS (SELECT trial_id, run, min(frame) AS s, max(frame) + 1 AS e, min(v) AS v, count(*) AS n, sum(x) AS sx
         FROM mk GROUP BY trial_id, run)"""


def signal(spark, sf_dir):
    return v.samples(spark, sf_dir).withColumn("in_stance", (F.col("k") < 50).cast("int"))


@query("frame_numbering", f"WITH {v.SAMPLES} SELECT trial_id, frame, x, k FROM samples")
def _(spark, sf_dir):
    return v.samples(spark, sf_dir)


@query("contact_runs", f"""WITH {SIGNAL}
SELECT trial_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", CAST(v AS INTEGER) AS in_stance,
       n AS n_rows, sx AS sum_x FROM runs""")
def _(spark, sf_dir):
    return contact.contact_runs(signal(spark, sf_dir), v.TRIAL, aggs={"sum_x": ("sum", F.col("x"))}, size=v.SIZE)


@query("stance_segments", f"""WITH {SIGNAL}
SELECT trial_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM runs WHERE v = 1
 AND trial_id IN (SELECT trial_id FROM sig GROUP BY trial_id HAVING count(*) >= 2)""")
def _(spark, sf_dir):
    return contact.stance_segments(signal(spark, sf_dir), v.TRIAL, size=v.SIZE)


@query("stance_onsets", f"""WITH {SIGNAL}
SELECT trial_id, CAST(frame AS INTEGER) AS frame FROM
 (SELECT *, coalesce(lag(v) OVER (PARTITION BY trial_id ORDER BY frame), 0) AS p FROM sig) WHERE v = 1 AND p = 0""")
def _(spark, sf_dir):
    d = contact.onsets(signal(spark, sf_dir), v.TRIAL, size=v.SIZE)
    return d.where("in_stance_on = 1").select("trial_id", "frame")


@query("trend_contact", f"""WITH {v.SAMPLES}
SELECT trial_id, frame, CASE WHEN lead(x) OVER (PARTITION BY trial_id ORDER BY frame) < x THEN 1 ELSE 0 END AS in_stance
FROM samples""")
def _(spark, sf_dir):
    return contact.trend_contact(v.samples(spark, sf_dir), v.TRIAL, size=v.SIZE).select("trial_id", "frame", "in_stance")


@query("displacement_contact", f"""WITH {v.SAMPLES},
d AS (SELECT trial_id, frame, abs(x - lag(x) OVER (PARTITION BY trial_id ORDER BY frame)) AS d FROM samples),
m AS (SELECT trial_id, sum(d) / count(d) AS m FROM d GROUP BY trial_id)
SELECT trial_id, frame, CASE WHEN d < m THEN 1 ELSE 0 END AS in_stance FROM d JOIN m USING (trial_id)""")
def _(spark, sf_dir):
    d = v.samples(spark, sf_dir).withColumn("y", F.lit(0.0))
    return contact.displacement_contact(d, v.TRIAL, size=v.SIZE).select("trial_id", "frame", "in_stance")


@query("gap_interpolation", f"""WITH {v.SAMPLES},
g AS (SELECT trial_id, frame, CASE WHEN k >= 30 THEN x END AS x FROM samples),
n AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN frame END) OVER (PARTITION BY trial_id ORDER BY frame) AS pf,
        min(CASE WHEN x IS NOT NULL THEN frame END) OVER (PARTITION BY trial_id ORDER BY frame
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nf FROM g)
SELECT n.trial_id, n.frame, CASE WHEN n.x IS NOT NULL THEN n.x
   WHEN pf IS NOT NULL AND nf IS NOT NULL THEN p.x + (q.x - p.x) * (n.frame - pf) / (nf - pf)
   ELSE coalesce(p.x, q.x, 0.0) END AS x
FROM n LEFT JOIN g p ON p.trial_id = n.trial_id AND p.frame = pf LEFT JOIN g q ON q.trial_id = n.trial_id AND q.frame = nf""")
def _(spark, sf_dir):
    d = v.samples(spark, sf_dir).select("trial_id", "frame", F.expr("CASE WHEN k >= 30 THEN x END").alias("x"))
    return contact.fill_gaps(d, v.TRIAL, ["x"], size=v.SIZE).select("trial_id", "frame", "x")


CORRECTED = SIGNAL + """,
st AS (SELECT trial_id, count(*) AS k, sum(n) AS nf FROM runs GROUP BY trial_id),
nb AS (SELECT r.*, st.k, ceil(st.nf / st.k / 4.0) AS thr,
        lag(n) OVER w AS ln, lead(n) OVER w AS rn, lag(v) OVER w AS lv, lead(v) OVER w AS rv
       FROM runs r JOIN st USING (trial_id) WINDOW w AS (PARTITION BY trial_id ORDER BY s)),
fixed AS (SELECT *, CASE WHEN k >= 3 AND n <= thr AND ln > thr AND rn > thr AND lv = rv THEN lv ELSE v END AS cv FROM nb)"""


@query("run_correction", f"""WITH {CORRECTED}
SELECT mk.trial_id, CAST(mk.frame AS INTEGER) AS frame, CAST(fixed.cv AS INTEGER) AS in_stance
FROM mk JOIN fixed ON mk.trial_id = fixed.trial_id AND mk.run = fixed.run""")
def _(spark, sf_dir):
    return contact.auto_correct(signal(spark, sf_dir), v.TRIAL, size=v.SIZE)


BASICS_SQL = """
rr AS (SELECT trial_id, s, e, cv, CASE WHEN cv = lag(cv) OVER (PARTITION BY trial_id ORDER BY s) THEN 0 ELSE 1 END AS opens
       FROM fixed),
agg AS (SELECT trial_id, coalesce(sum(CASE WHEN cv = 1 THEN opens END), 0) AS k,
   sum(CASE WHEN cv = 1 THEN e - s ELSE 0 END) AS st, min(CASE WHEN cv = 1 THEN s END) AS f,
   max(CASE WHEN cv = 1 THEN e END) - 1 AS l, max(CASE WHEN cv = 1 AND opens = 1 THEN s END) AS lo
  FROM rr GROUP BY trial_id)
SELECT trial_id, CAST(greatest(k - 1, 0) AS INTEGER) AS n_strides,
  CASE WHEN k > 1 THEN CAST(st AS DOUBLE) / (k - 1) * 1000.0::DOUBLE / 100.0::DOUBLE ELSE 0.0 END AS stance_ms,
  CASE WHEN k > 1 THEN CAST(l - f + 1 - st AS DOUBLE) / (k - 1) * 1000.0::DOUBLE / 100.0::DOUBLE ELSE 0.0 END AS swing_ms,
  CASE WHEN k > 1 THEN CAST(k - 1 AS DOUBLE) / ((lo - f) / 100.0::DOUBLE) ELSE 0.0 END AS stride_hz FROM agg"""


@query("gait_basics", f"WITH {SIGNAL}, fixed AS (SELECT *, v AS cv FROM runs), {BASICS_SQL}")
def _(spark, sf_dir):
    return gait.gait_basics(signal(spark, sf_dir), v.TRIAL, FPS, size=v.SIZE)


@query("gait_basics_corrected", f"WITH {CORRECTED}, {BASICS_SQL}")
def _(spark, sf_dir):
    runs = contact.stored_runs(signal(spark, sf_dir), v.TRIAL, size=v.SIZE)
    return gait.gait_basics_of_runs(contact.correct_runs(runs, v.TRIAL, size=v.SIZE), v.TRIAL, FPS)


@query("stride_table", f"""WITH {SIGNAL},
n AS (SELECT *, lead(s, 2) OVER (PARTITION BY trial_id ORDER BY s) AS s2 FROM runs)
SELECT trial_id, CAST(s AS INTEGER) AS start, CAST(e - s AS INTEGER) AS stance_frames,
  CAST(s2 - e AS INTEGER) AS swing_frames, (s2 - s) / 100.0::DOUBLE AS stride_s FROM n WHERE v = 1 AND s2 IS NOT NULL""")
def _(spark, sf_dir):
    return gait.stride_table(signal(spark, sf_dir), v.TRIAL, FPS, size=v.SIZE)


STRIDES = SIGNAL + """,
sr AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY trial_id) AS kk, min(s) OVER (PARTITION BY trial_id) AS f,
        lead(s) OVER w AS s_next, lag(e) OVER w AS e_prev FROM runs WHERE v = 1 WINDOW w AS (PARTITION BY trial_id ORDER BY s)),
cut AS (SELECT trial_id, CASE WHEN f = 0 OR i = 1 THEN s ELSE e_prev END AS b, CASE WHEN f = 0 THEN s_next ELSE e END AS z
        FROM sr WHERE kk >= 2),
strides AS (SELECT c.trial_id, c.b, c.z, sqrt((q.x - p.x) * (q.x - p.x) + (q.k - p.k) * (q.k - p.k)) AS len
            FROM cut c JOIN samples p ON p.trial_id = c.trial_id AND p.frame = c.b
            JOIN samples q ON q.trial_id = c.trial_id AND q.frame = c.z)"""


def strides(spark, sf_dir, **kw):
    d = signal(spark, sf_dir).withColumn("y", F.col("k").cast("double"))
    return gait.stride_lengths(d, v.TRIAL, FPS, size=v.SIZE, **kw)


@query("stride_lengths", f"""WITH {STRIDES}
SELECT trial_id, CAST(b AS INTEGER) AS start, CAST(z AS INTEGER) AS "end", round(len, 6) AS stride_length FROM strides""")
def _(spark, sf_dir):
    return strides(spark, sf_dir).withColumn("stride_length", F.round("stride_length", 6))


@query("stride_lengths_treadmill", f"""WITH {STRIDES}
SELECT trial_id, CAST(b AS INTEGER) AS start, CAST(z AS INTEGER) AS "end", 250.0::DOUBLE * ((z - b) / 100.0::DOUBLE) AS stride_length
FROM strides""")
def _(spark, sf_dir):
    return strides(spark, sf_dir, belt_speed=250.0)


@query("stride_length_frames", f"""WITH {STRIDES}
SELECT samples.trial_id, samples.frame, round(coalesce(len, 0.0), 6) AS stride_length
FROM samples LEFT JOIN strides ON strides.trial_id = samples.trial_id AND frame >= b AND frame < z""")
def _(spark, sf_dir):
    d = gait.stride_length_frames(v.samples(spark, sf_dir), strides(spark, sf_dir), v.TRIAL, size=v.SIZE)
    return d.withColumn("stride_length", F.round("stride_length", 6))


@query("stride_summary", f"""WITH {STRIDES}
SELECT trial_id, round(coalesce(sum(CASE WHEN len > 0 THEN len * (z - b) END) / sum(CASE WHEN len > 0 THEN z - b END), 0.0), 6)
   AS stride_length_mean, round(coalesce(stddev_samp(len), 0.0), 6) AS stride_length_variability, count(*) AS n_lengths
FROM strides GROUP BY trial_id""")
def _(spark, sf_dir):
    d = gait.stride_summary(strides(spark, sf_dir), v.TRIAL)
    return d.withColumns({c: F.round(c, 6) for c in ("stride_length_mean", "stride_length_variability")})


@query("standard_error", f"""WITH {v.SAMPLES}
SELECT trial_id, round(CASE WHEN count(x) < 2 THEN 0 ELSE stddev_samp(x) / sqrt(count(x)) END, 6) AS sem_x,
  round(coalesce(stddev_samp(x), 0), 6) AS sd_x FROM samples GROUP BY trial_id""")
def _(spark, sf_dir):
    return v.samples(spark, sf_dir).groupBy("trial_id").agg(
        F.round(gait.sem(F.col("x")), 6).alias("sem_x"), F.round(gait.variability(F.col("x")), 6).alias("sd_x"))


@query("body_speed", f"""WITH {v.SAMPLES}
SELECT trial_id, CASE WHEN count(*) > 1 THEN (arg_max(x, frame) - arg_min(x, frame)) / ((count(*) - 1) / 100.0::DOUBLE)
  ELSE 0.0 END AS body_speed_mm_s FROM samples GROUP BY trial_id""")
def _(spark, sf_dir):
    return gait.body_speed(v.samples(spark, sf_dir), v.TRIAL, "x", FPS)


@query("traversals", f"""WITH {v.SAMPLES},
a AS (SELECT trial_id, frame, frame - lag(frame) OVER (PARTITION BY trial_id ORDER BY frame) AS gap FROM samples WHERE k < 30),
m AS (SELECT *, sum(CASE WHEN gap <= 4 THEN 0 ELSE 1 END) OVER (PARTITION BY trial_id ORDER BY frame) AS isl FROM a),
i AS (SELECT trial_id, min(frame) AS s, max(frame) + 1 AS e FROM m GROUP BY trial_id, isl),
n AS (SELECT trial_id, max(frame) + 1 AS n FROM samples GROUP BY trial_id),
z AS (SELECT trial_id, s + 1 AS s, CASE WHEN n - e < 4 THEN n ELSE e END AS e, n - e < 4 AS flushed FROM i JOIN n USING (trial_id))
SELECT trial_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", flushed FROM z WHERE e - s >= 5""")
def _(spark, sf_dir):
    return contact.traversals(v.samples(spark, sf_dir), v.TRIAL, F.col("k") < 30, min_frames=5, empty_frames=4,
                              size=v.SIZE)


@query("active_bounds", f"""WITH {v.SAMPLES}
SELECT trial_id, CAST(coalesce(min(CASE WHEN k < 20 THEN frame END), 0) AS INTEGER) AS start,
  CAST(coalesce(max(CASE WHEN k < 20 THEN frame END) + 1, 0) AS INTEGER) AS "end" FROM samples GROUP BY trial_id""")
def _(spark, sf_dir):
    return contact.active_bounds(v.samples(spark, sf_dir), v.TRIAL, F.col("k") < 20)


@query("contact_spine", f"""WITH {v.SAMPLES},
limbs AS (SELECT unnest(['LF', 'RF', 'LH', 'RH']) AS limb),
hit AS (SELECT DISTINCT trial_id, frame, CASE k % 4 WHEN 0 THEN 'LF' WHEN 1 THEN 'RF' WHEN 2 THEN 'LH' ELSE 'RH' END AS limb
        FROM samples WHERE x >= 1000)
SELECT s.trial_id, l.limb, s.frame, CASE WHEN hit.limb IS NULL THEN 0 ELSE 1 END AS in_stance
FROM samples s CROSS JOIN limbs l LEFT JOIN hit ON hit.trial_id = s.trial_id AND hit.frame = s.frame AND hit.limb = l.limb""")
def _(spark, sf_dir):
    s = v.samples(spark, sf_dir)
    limb = F.element_at(F.array(*[F.lit(n) for n in ("LF", "RF", "LH", "RH")]), F.col("k") % 4 + 1)
    det = s.select("trial_id", "frame", limb.alias("limb"), (F.col("x") >= 1000).alias("is_in_stance"))
    trials = s.groupBy("trial_id").agg((F.max("frame") + 1).alias("n_frames"))
    return contact.contact_spine(det, trials, ("LF", "RF", "LH", "RH"), v.SIZE)


@query("edited_contact", f"""WITH {SIGNAL},
ed AS (SELECT trial_id, frame, count(*) AS c FROM sig WHERE k % 10 = 3 GROUP BY trial_id, frame)
SELECT sig.trial_id, sig.frame, CAST(xor(v, CAST(coalesce(c % 2, 0) AS INTEGER)) AS INTEGER) AS in_stance, c IS NOT NULL AS edited
FROM sig LEFT JOIN ed ON ed.trial_id = sig.trial_id AND ed.frame = sig.frame""")
def _(spark, sf_dir):
    s = signal(spark, sf_dir)
    edits = s.where("k % 10 = 3").select("trial_id", "frame")
    return contact.apply_edits(s, edits, v.TRIAL).select("trial_id", "frame", "in_stance", "edited")
