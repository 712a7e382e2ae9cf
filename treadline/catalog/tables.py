"""Export layouts, the table store, parsed text sources and streams on the driver tables."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from treadline.catalog import views as v
from treadline.catalog.contacts import AGG_SQL, FPS, PRESSURE, STEPS, bouts, pressure
from treadline.catalog.cycles import CYC, DET, det
from treadline.catalog.registry import query
from treadline.catalog.series import PIXEL, PX, ROLES, W, pixel_series
from treadline.operators import contact, cycles, pixels, steps
from treadline.plans import trials
from treadline.session import materialise, shared_folder
from treadline.sources import readers, sinks, store
from treadline.streaming import live

C = F.col


@query("displayed_pressure", f"""WITH {v.LONG}
SELECT trial_id, frame, {', '.join(f"CASE WHEN abs(max(CASE WHEN limb = '{n}' THEN cx END)) < 100 THEN round(max(CASE WHEN limb = '{n}' THEN cx END), 4) ELSE round(max(CASE WHEN limb = '{n}' THEN cx END), 2) END AS {n}_x" for n in ('LF', 'RF', 'LH', 'RH'))}
FROM contact GROUP BY trial_id, frame""")
def _(spark, sf_dir):
    return sinks.pressure_table(pixels.pressure_rows(v.contact_long(spark, sf_dir), v.TRIAL, {"cx": "x"}))


@query("contact_export", f"""WITH {v.LONG} SELECT trial_id, frame, {', '.join(f"max(CASE WHEN limb = '{n}' THEN in_stance END) AS {n}_stance" for n in ('LF', 'RF', 'LH', 'RH'))}
FROM contact GROUP BY trial_id, frame""")
def _(spark, sf_dir):
    return sinks.contact_table(v.contact_long(spark, sf_dir))


@query("step_export", f"""WITH {STEPS} SELECT trial_id, limb AS paw, CAST(row_number() OVER (PARTITION BY trial_id, limb ORDER BY s) AS INTEGER) AS step_num, CAST(s AS INTEGER) AS start_frame,
 CAST(e AS INTEGER) AS end_frame, stride / 10.0::DOUBLE AS stride_length_cm, round(ssp / 10, 6) AS swing_cm, max_intensity FROM steps""")
def _(spark, sf_dir):
    t = sinks.step_table(steps.step_metrics(bouts(spark, sf_dir), v.LIMB), v.SIZE)
    return t.select("trial_id", "paw", "step_num", "start_frame", "end_frame", "stride_length_cm", F.round("swing_speed_cm_s", 6).alias("swing_cm"), "max_intensity")


LIMB_NUMBERS = ("avg_stance_s", "avg_swing_s", "duty_cycle_pct", "stride_length_cm", "step_length_cm", "avg_swing_speed_cm_s", "mean_intensity", "max_intensity",
                "max_contact_max_intensity", "avg_stand_index", "total_stand_index", "max_contact_area_cm2", "print_area_cm2")


@query("limb_export", f"""WITH {PRESSURE}, {AGG_SQL},
m AS (SELECT *, max(ca) OVER (PARTITION BY trial_id, limb) AS mca FROM pr),
p AS (SELECT trial_id, limb, max(ca) AS p_area, sum(pa) AS print_area_cm2, avg(mean_intensity) AS mean_intensity, max(max_intensity) AS p_top,
  max(CASE WHEN ca = mca THEN max_intensity END) AS max_contact_max_intensity, avg(si) AS avg_stand_index, sum(si) AS total_stand_index FROM m GROUP BY trial_id, limb)
SELECT ag.trial_id, ag.limb AS paw, CAST(n_steps AS INTEGER) AS n_steps, round(avg_instantaneous_speed_cm_s, 6) AS avg_instantaneous_speed_cm_s,
 {', '.join(f"round({ {'max_contact_area_cm2': 'p_area', 'max_intensity': 'p_top'}.get(c, c)}, 6) AS {c}" for c in LIMB_NUMBERS)} FROM ag LEFT JOIN p USING (trial_id, limb)""")
def _(spark, sf_dir):
    t = sinks.limb_table(steps.limb_aggregates(bouts(spark, sf_dir, "area_px"), v.LIMB, FPS), steps.limb_pressure(pressure(spark, sf_dir), v.LIMB))
    return t.select("trial_id", "paw", "n_steps", *[F.round(c, 6).alias(c) for c in ("avg_instantaneous_speed_cm_s", *LIMB_NUMBERS)])


@query("cycle_export", f"""WITH {CYC} SELECT trial_id, CAST(row_number() OVER (PARTITION BY trial_id ORDER BY td, track_id) AS INTEGER) AS cycle_id, '' AS paw_id, td AS touchdown_frame, lo AS liftoff_frame,
 pa AS peak_area_frame, ma AS max_area_px, CAST(n AS INTEGER) AS n_frames FROM cyc""")
def _(spark, sf_dir):
    c = cycles.number_cycles(cycles.build_cycles(det(spark, sf_dir), ["trial_id"], size=v.SIZE), ["trial_id"], size=v.SIZE)
    return sinks.cycle_table(c).select("trial_id", "cycle_id", "paw_id", "touchdown_frame", "liftoff_frame", "peak_area_frame", "max_area_px", "n_frames")


@query("print_index", r"""SELECT l_suppkey AS trial_id, l_orderkey AS print_id, l_linenumber AS touchdown_frame, l_linenumber + 7 AS liftoff_frame, l_linenumber + 5 AS true_liftoff_frame, 8 AS n_frames,
 CAST(l_orderkey % 4 AS INTEGER) AS n_extension_frames, printf('%.4f', l_quantity) AS duration_s, printf('%.3f', l_extendedprice) AS max_area_mm2, printf('%.3f', l_quantity) AS peak_centroid_x_mm, printf('%.3f', l_discount) AS peak_centroid_y_mm,
 printf('%.3f', l_tax) AS peak_pressure, CASE WHEN l_linenumber = 3 THEN '' ELSE printf('%.4f', l_tax) END AS decay_tau_ms, CASE WHEN l_linenumber = 3 THEN '' ELSE printf('%.4f', l_discount) END AS decay_r2,
 CAST(l_returnflag = 'A' AS INTEGER) AS is_clean_liftoff, 'prints/print_' || lpad(CAST(l_orderkey AS VARCHAR), CAST(greatest(3, length(CAST(l_orderkey AS VARCHAR))) AS INTEGER), '0') AS dir_path FROM lineitem""")
def _(spark, sf_dir):
    li = v.table(spark, sf_dir, "lineitem")
    p = li.select(C("l_suppkey").alias("trial_id"), C("l_orderkey").alias("print_id"), C("l_linenumber").alias("touchdown_frame"), (C("l_linenumber") + 7).alias("liftoff_frame"),
                  (C("l_linenumber") + 5).alias("true_liftoff_frame"), F.lit(8).alias("n_frames"),
                  F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i < C("l_orderkey") % 4).alias("decay_phase_mask"), C("l_quantity").alias("duration_s"),
                  C("l_extendedprice").alias("max_area_mm2"), C("l_quantity").alias("peak_centroid_x_mm"), C("l_discount").alias("peak_centroid_y_mm"), C("l_tax").alias("peak_pressure"),
                  F.when(C("l_linenumber") != 3, C("l_tax")).alias("decay_tau_ms"), F.when(C("l_linenumber") != 3, C("l_discount")).alias("decay_r2"), (C("l_returnflag") == "A").alias("is_clean_liftoff"))
    return sinks.print_index(p)


@query("footprint_export", """SELECT l_suppkey AS trial_id, l_orderkey AS frame, CASE WHEN l_linenumber <= 2 THEN l_returnflag ELSE 'blob_' || l_linenumber END AS paw, CAST(l_quantity AS INTEGER) AS area_px, printf('%.2f', l_quantity) AS area_mm2,
 printf('%.1f', l_quantity) AS mean_intensity, l_extendedprice AS max_intensity, printf('%.1f', l_quantity) AS sum_intensity, CAST(l_quantity >= 30 AS INTEGER) AS is_in_stance FROM lineitem""")
def _(spark, sf_dir):
    f = v.table(spark, sf_dir, "lineitem").select(
        C("l_suppkey").alias("trial_id"), C("l_orderkey").alias("frame"), F.when(C("l_linenumber") <= 2, C("l_returnflag")).alias("limb"), C("l_linenumber").alias("label"), C("l_quantity").cast("int").alias("area_px"),
        C("l_quantity").alias("area_mm2"), C("l_quantity").alias("intensity_mean"), C("l_extendedprice").alias("intensity_max"), C("l_quantity").alias("intensity_total"), (C("l_quantity") >= 30).alias("is_in_stance"))
    return sinks.footprint_table(f)


@query("label_lines", f"""WITH {DET}, c AS (SELECT trial_id, frame, area_px, greatest(0, least(x1 - 1, 14)) AS x1, greatest(0, least(y1 - 1, 9)) AS y1, greatest(0, least(x2, 14)) AS x2, greatest(0, least(y2, 9)) AS y2 FROM det WHERE area_px >= 5),
l AS (SELECT *, printf('0 %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f', x1 / 15.0::DOUBLE, y1 / 10.0::DOUBLE, x2 / 15.0::DOUBLE, y1 / 10.0::DOUBLE, x2 / 15.0::DOUBLE, y2 / 10.0::DOUBLE, x1 / 15.0::DOUBLE, y2 / 10.0::DOUBLE) AS line FROM c WHERE x2 > x1 AND y2 > y1)
SELECT trial_id, 'frame_' || lpad(CAST(frame AS VARCHAR), 4, '0') AS file_name, string_agg(line, chr(10) ORDER BY area_px DESC, x1, y1, x2, y2) AS content FROM l GROUP BY trial_id, frame""")
def _(spark, sf_dir):
    d = det(spark, sf_dir).withColumns({"x1": C("x1") - 1, "y1": C("y1") - 1})
    return sinks.label_lines(d, width=15, height=10)


@query("subject_labels", r"""SELECT o_orderkey, regexp_replace(o_orderpriority || '-' || o_orderstatus, '[^\p{L}\p{N}]', '', 'g') AS subject,
 CASE WHEN o_orderkey % 5 = 0 THEN 'ses-01' ELSE 'ses-' || strftime(o_orderdate, '%Y%m%d') END AS session FROM orders""")
def _(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders")
    date = F.when(C("o_orderkey") % 5 == 0, "unknown").otherwise(C("o_orderdate").cast("string"))
    return o.select("o_orderkey", sinks.subject_label(F.concat_ws("-", "o_orderpriority", "o_orderstatus")).alias("subject"), sinks.session_label(date).alias("session"))


@query("cycle_documents")
def _(spark, sf_dir):
    d = materialise(det(spark, sf_dir))
    c = cycles.number_cycles(cycles.build_cycles(d, ["trial_id"], size=v.SIZE), ["trial_id"], size=v.SIZE)
    cop = cycles.pressure_centre_path(d, ["trial_id"], size=v.SIZE)
    c = materialise(c.join(cop, ["trial_id", "track_id"]))
    f = cycles.frame_records(d).join(c.select("trial_id", "track_id", "cycle_id"), ["trial_id", "track_id"])
    return sinks.cycle_documents(c, f)


@query("store_round_trip", f"""WITH {DET} SELECT trial_id, track_id AS cycle_id, frame, area_px, mean_intensity, '2.0' AS schema_version FROM det WHERE trial_id IN (1, 4)""")
def _(spark, sf_dir):
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    d = det(spark, sf_dir).select("trial_id", C("track_id").alias("cycle_id"), "frame", "area_px", "mean_intensity")
    store.write_table(d, root, "cycle_frame", buckets=8)
    return store.read_table(spark, root, "cycle_frame", trials=[1, 4], buckets=8)


@query("joint_count_check", """SELECT l_orderkey AS trial_id, count(DISTINCT l_linenumber) AS n_joints, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) <> 4 OR count(*) <> 4""")
def _(spark, sf_dir):
    li = v.table(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("trial_id"), C("l_linenumber").alias("joint"))
    return store.check_joint_count(li, ["trial_id"], 4)


@query("sheet_truth", r"""WITH s AS (SELECT user_id AS trial_id, event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, value FROM events), f AS (SELECT * FROM s WHERE value - 1 > 0 AND k - 20 > 0)
SELECT trial_id, CAST(row_number() OVER (PARTITION BY trial_id ORDER BY event_id) - 1 AS INTEGER) AS print_id, greatest(1, CAST(round_even((value - 1) * 60, 0) AS INTEGER) + 1) AS frame_idx, k::DOUBLE AS cx_px, k + 0.5::DOUBLE AS cy_px, 'LF' AS paw_id FROM f""")
def _(spark, sf_dir):
    k = F.regexp_extract("props", "([0-9]+)", 1)
    e = v.table(spark, sf_dir, "events").select(
        C("user_id").alias("trial_id"), C("event_id").alias("row"), F.lit(" LF ").alias("limb"), (C("value") - 1).alias("touchdown_s"), (k.cast("int") - 20).alias("stride_cm"),
        F.concat(F.lit("("), k, F.lit(", "), k, F.lit(".5)")).alias("position"))
    return readers.truth_from_sheet(e)


@query("tracker_events", r"""WITH s AS (SELECT event_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)
SELECT event_id, CASE event_type WHEN 'view' THEN 'progress' WHEN 'click' THEN 'progress' ELSE 'result' END AS event, CASE WHEN event_type = 'view' THEN 'train' ELSE '' END AS stage, CASE WHEN event_type IN ('view', 'click') THEN k ELSE 0 END AS current,
 CASE WHEN event_type = 'view' THEN 50 WHEN event_type = 'click' THEN 0 ELSE 1 END AS total, CASE WHEN event_type = 'view' THEN k / 50.0::DOUBLE WHEN event_type = 'click' THEN k::DOUBLE ELSE 0.0 END AS fraction, CASE WHEN event_type = 'view' THEN value END AS loss,
 CASE WHEN event_type = 'purchase' THEN k::DOUBLE END AS map50 FROM s WHERE event_type IN ('view', 'click', 'purchase')""")
def _(spark, sf_dir):
    k, t = F.regexp_extract("props", "([0-9]+)", 1), C("event_type")
    line = (F.when(t == "view", F.concat(F.lit('  {"event": "progress", "stage": "train", "epoch": '), k, F.lit(', "total_epochs": 50, "loss": '), C("value").cast("string"), F.lit("}")))
            .when(t == "click", F.concat(F.lit('{"event": "progress", "frame": '), k, F.lit(', "total_frames": 0}')))
            .when(t == "purchase", F.concat(F.lit('{"event": "result", "metrics": {"map50": '), k, F.lit(', "note": "n/a"}}')))
            .when(t == "error", F.lit("{not json")).otherwise(F.concat(F.lit("step "), k)))
    e = v.table(spark, sf_dir, "events").select("event_id", line.alias("value"))
    d = readers.tracker_events(e)
    return d.select("event_id", "event", "stage", "current", "total", "fraction", "loss", F.try_element_at("metrics", F.lit("map50")).alias("map50"))


@query("traversal_frames", f"""WITH {v.SAMPLES},
a AS (SELECT trial_id, frame, frame - lag(frame) OVER (PARTITION BY trial_id ORDER BY frame) AS gap FROM samples WHERE k < 30),
m AS (SELECT *, sum(CASE WHEN gap <= 4 THEN 0 ELSE 1 END) OVER (PARTITION BY trial_id ORDER BY frame) AS isl FROM a),
i AS (SELECT trial_id, min(frame) AS s, max(frame) + 1 AS e FROM m GROUP BY trial_id, isl), n AS (SELECT trial_id, max(frame) + 1 AS n FROM samples GROUP BY trial_id),
z AS (SELECT trial_id, s + 1 AS s, CASE WHEN n - e < 4 THEN n ELSE e END AS e FROM i JOIN n USING (trial_id))
SELECT samples.trial_id || '#' || s AS trial_id, CAST(frame + 1 - s AS INTEGER) AS frame, x FROM samples JOIN z ON z.trial_id = samples.trial_id AND frame + 1 BETWEEN s AND e WHERE e - s >= 5""")
def _(spark, sf_dir):
    s = v.samples(spark, sf_dir)
    runs = contact.traversals(s, v.TRIAL, C("k") < 30, min_frames=5, empty_frames=4, size=v.SIZE)
    return contact.frames_of_traversals(s, runs, size=v.SIZE).select("trial_id", "frame", "x")


def _event_stream(spark, sf_dir):
    schema = v.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _replay(df):
    """A table as a stream of two overlapping micro-batches or more: the rows are written as files to the shared folder, the later frames first, some of them twice."""
    folder = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    late = F.pmod(F.floor(C("frame") / 7), F.lit(2)) == 1
    df.where(late | (C("frame") % 5 == 0)).repartition(2).write.parquet(f"{folder}/a")
    df.where(~late | (C("frame") % 3 == 0)).repartition(2).write.parquet(f"{folder}/b")
    return (df.sparkSession.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 2).parquet(folder))


def _drain(df):
    """Run a stream over all that is there, into a table of the shared folder, and read it."""
    root = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/out")


# A frame is a quarter of an hour here; two frames within eight belong together.
@query("stream_traversals", """WITH s AS (SELECT DISTINCT user_id AS trial_id, CAST(floor(epoch_us(ts) / 900000000.0) AS BIGINT) AS frame FROM events WHERE CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) < 90),
a AS (SELECT *, frame - lag(frame) OVER (PARTITION BY trial_id ORDER BY frame) AS gap FROM s), m AS (SELECT *, sum(CASE WHEN gap <= 40 THEN 0 ELSE 1 END) OVER (PARTITION BY trial_id ORDER BY frame) AS isl FROM a),
i AS (SELECT trial_id, min(frame) AS a, max(frame) AS b FROM m GROUP BY trial_id, isl)
SELECT trial_id, a + 1 AS start, b + 1 AS "end" FROM i WHERE b - a >= 20""")
def _(spark, sf_dir):
    frames = lambda e: e.select(C("user_id").alias("trial_id"), F.floor(F.unix_micros(C("ts").cast("timestamp")) / 900000000.0).alias("frame"),
                                F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    closed = _drain(live.stream_traversals(frames(_event_stream(spark, sf_dir)), C("k") < 90, empty_frames=40))
    return closed.unionByName(live.open_traversals(frames(v.table(spark, sf_dir, "events")), closed, C("k") < 90, empty_frames=40))


@query("stream_camera_sets", f"""WITH {ROLES}
SELECT frame_number, CAST(n AS INTEGER) AS n_roles, round(max(abs(2 * t - m2)) / 2000000.0::DOUBLE, 6) AS worst_ms FROM one JOIN md USING (frame_number) WHERE n >= 3 GROUP BY frame_number, n""")
def _(spark, sf_dir):
    frames = lambda e: e.select(C("event_type").alias("role"), F.floor(C("event_id") / 5).alias("frame_number"), C("ts").cast("timestamp").alias("ts"),
                                (F.unix_micros(C("ts").cast("timestamp")) * 1000).alias("timestamp_ns"))
    closed = _drain(live.stream_camera_sets(frames(_event_stream(spark, sf_dir)), "1 day", n_roles=3))
    d = closed.unionByName(live.open_camera_sets(frames(v.table(spark, sf_dir, "events")), closed, n_roles=3))
    return d.withColumn("worst_ms", F.round("worst_ms", 6))


@query("stream_background", f"""WITH {PIXEL},
m AS (SELECT x, y, frame, CASE WHEN frame >= 1 AND (frame < 30 OR (frame + 1) % 5 = 0) THEN median(g) {PX} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS m FROM px)
SELECT x, y, frame, last_value(m IGNORE NULLS) {PX} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS background FROM m""")
def _(spark, sf_dir):
    px = pixel_series(spark, sf_dir).select("x", "y", "frame", "g")
    return _drain(live.stream_background(_replay(px), ["x", "y"], "g"))


@query("stream_frame_rate", f"""WITH {v.SAMPLES}, s AS (SELECT trial_id, frame, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM samples),
w AS (SELECT trial_id, frame, t, first_value(t) {W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS f, count(*) {W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS n FROM s)
SELECT trial_id, frame, round(CASE WHEN n >= 2 AND t > f THEN (n - 1) / (t - f) END, 9) AS fps FROM w""")
def _(spark, sf_dir):
    s = v.samples(spark, sf_dir, "ts").select("trial_id", "frame", (F.unix_micros(C("ts").cast("timestamp")) / 1000000.0).alias("seconds"))
    return _drain(live.stream_frame_rate(_replay(s), v.TRIAL, "seconds")).withColumn("fps", F.round("fps", 9))


@query("contact_append", f"WITH {v.SAMPLES} SELECT trial_id, frame, k < 30 AS in_stance FROM samples")
def _(spark, sf_dir):
    s = v.samples(spark, sf_dir).select("trial_id", "frame", (C("k") < 30).alias("in_stance"))
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    live.append_contact(_replay(s), f"{root}/contact", f"{root}/log", {"availableNow": True}, v.TRIAL, watermark="365 days").awaitTermination()
    return spark.read.parquet(f"{root}/contact").select("trial_id", "frame", "in_stance")


# Trials with a frame of 99 have a line that can't be read: its place is lost.
FAULTY = f"""{v.SAMPLES}, f AS (SELECT *, k <> 99 OR trial_id % 3 <> 0 AS readable FROM samples),
s AS (SELECT trial_id, count(*) AS n_rows, count(*) FILTER (NOT readable) AS lost, count(*) FILTER (readable AND x > 40000) AS far FROM f GROUP BY trial_id),
z AS (SELECT trial_id, n_rows, nullif(concat_ws('; ', CASE WHEN lost > 0 THEN 'a place in every frame: ' || lost END, CASE WHEN lost + far > 0 THEN 'inside the arena: ' || (lost + far) END), '') AS message FROM s)"""


def _run_trials(spark, sf_dir):
    s = v.samples(spark, sf_dir).withColumn("x", F.when((C("k") != 99) | (C("trial_id") % 3 != 0), C("x")))
    rules = {"a place in every frame": C("x").isNotNull(), "inside the arena": C("x") <= 40000}
    return trials.each_trial(s, v.TRIAL, rules, lambda d: d.groupBy("trial_id").agg(F.max("x").alias("reach"), F.count(F.lit(1)).alias("n_frames")))


@query("trial_status", f"WITH {FAULTY} SELECT trial_id, CASE WHEN message IS NULL THEN 'ok' ELSE 'error' END AS status, message, n_rows FROM z")
def _(spark, sf_dir):
    return _run_trials(spark, sf_dir)[1]


@query("trial_results", f"WITH {FAULTY} SELECT trial_id, max(x) AS reach, count(*) AS n_frames FROM f JOIN z USING (trial_id) WHERE message IS NULL GROUP BY trial_id")
def _(spark, sf_dir):
    return _run_trials(spark, sf_dir)[0]
