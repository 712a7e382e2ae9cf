"""Linking detections over frames.

The trackers are sequential by definition: a frame depends on the one before. A recording is cut exactly where nothing
can carry over, and what is left is run in chunks of frames that start from a guessed state (:func:`in_chunks`): a chunk is run again only where
its guess turns out to differ from the state in which the chunk before it ended. So a task holds a chunk, however long a recording goes on.
"""
from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treadline.functions.geometry import distance
from treadline.operators import ordered
from treadline.operators.ordered import CHUNK
from treadline.session import cut_lineage, materialise


def bursts(det: DataFrame, trial: Sequence[str], max_gap: int, size: int = CHUNK) -> DataFrame:
    """Add ``_burst``: the first frame of the stretch of activity. More than ``max_gap`` frames without any detection
    close every track, so bursts are independent. They are found on the distinct frames, however many detections a frame has."""
    frames = det.select(*trial, "frame").distinct()
    return det.join(ordered.stretch_starts(frames, trial, max_gap, name="_burst", size=size).select(*trial, "frame", "_burst"), [*trial, "frame"])


#: Frames of a chunk, and frames before it from which its entry state is guessed.
FRAMES, WARM = 1024, 64

_SUMMARY = ("_entry array<struct<name:string,digest:string>>, _exit array<struct<slot:int,own:string,digest:string>>, "
            "_bound boolean, _state binary")
_PLAN = "_redo boolean, _from bigint, _order array<int>, _names array<string>"


def _walk(chunks: list[dict], named: bool) -> list[tuple]:
    """Follow the states through the chunks of a recording, in order.

    A chunk's result holds if the tracks with which it began are those that the chunk before it left: the same ones in any order, or, where
    an order or a name decided something (``_bound``), in the same order and under the same names. Returns for each chunk whether it must be run again,
    from which chunk's end, in which order of its tracks, and the names of the tracks at its start.
    """
    out, before, left = [], None, []  # left: (place in the exit list of ``before``, name, digest), oldest first
    for chunk in chunks:
        began = [(t["name"], t["digest"]) for t in chunk["_entry"]]
        free: dict[str, list[int]] = {}
        for slot in range(len(began) - 1, -1, -1):
            free.setdefault(began[slot][1], []).append(slot)
        slots = [free[d].pop() if free.get(d) else None for _, _, d in left]
        holds = len(left) == len(began) and None not in slots
        if holds and chunk["_bound"]:
            holds = slots == list(range(len(slots))) and (not named or [n for n, _ in began] == [n for _, n, _ in left])
        names: list[str | None] = [None] * len(began)
        if holds:
            for slot, (_, name, _) in zip(slots, left):
                names[slot] = name
            out.append((False, before, None, names))
            rank = {slot: i for i, slot in enumerate(slots)}
        else:
            out.append((True, before, [i for i, _, _ in left], [n for _, n, _ in left]))
            # The walk goes on with what the chunk says now, so that later chunks are compared in the same round.
            names = [n or f"?{chunk['_chunk']}:{i}" for i, (n, _) in enumerate(began)]
            rank = {slot: slot for slot in range(len(began))}
        exits = [(rank.get(t["slot"], len(began) + i), i, names[t["slot"]] if t["slot"] >= 0 else t["own"], t["digest"]) for i, t in enumerate(chunk["_exit"])]
        left = [t[1:] for t in sorted(exits)]
        before = chunk["_chunk"]
    return out


def in_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], tracker: Callable[[], object],
              frames: int = FRAMES, warm: int = WARM, drop: Sequence[str] = ()) -> DataFrame:
    """Run a sequential ``tracker`` over the frames of each key, exactly, in chunks of ``frames``: adds ``_who``, the name of each row's track.

    Every chunk first runs from a state guessed by the ``warm`` frames before it. Its tracks at the start are known by their place only. Then one summary row per chunk is
    followed along the recording (:func:`_walk`): where the guess had the tracks that really were there, names are passed on; other chunks are run again from the real state, until none
    is left. Each round settles at least the first open chunk, so the result is that of one pass over the recording. A task holds a chunk and one chunk's live tracks.
    """
    frame, named = order[0], tracker().named
    kept = [f for f in df.schema if f.name not in drop]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", _chunk bigint, _slot int, _own string, " + _SUMMARY
    own = F.floor(F.col(frame) / frames).cast("long")
    late = F.pmod(F.col(frame), F.lit(frames)) >= frames - warm
    here, there = F.struct(own.alias("c"), F.lit(False).alias("w")), F.struct((own + 1).alias("c"), F.lit(True).alias("w"))
    d = df.withColumn("_p", F.explode(F.when(late, F.array(here, there)).otherwise(F.array(here))))
    d = d.withColumns({"_chunk": F.col("_p.c"), "_warm": F.col("_p.w")}).drop("_p")
    group = [*keys, "_chunk"]

    def run(rows: pa.Table, state: tuple | None) -> pa.Table:
        ahead = int(pa.compute.sum(rows["_warm"]).as_py() or 0)
        if ahead == len(rows):
            return empty
        chunk = rows["_chunk"][0].as_py()
        steps, number = [rows[c].to_pandas().to_numpy() for c in inputs], rows[frame].to_numpy()
        cut = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        t, slots, owns = tracker(), [], []
        if state is not None:
            t.load(*state)
        for a, b in zip(cut, np.r_[cut[1:], len(rows)]):
            if a == ahead and state is None:
                # What the frames ahead left is the guess.
                t.load(*t.dump(chunk * frames)[1:])
            if a >= ahead or state is None:
                got = t.step(int(number[a]), *[x[a:b] for x in steps])
                if a >= ahead:
                    slots += [s for s, _ in got]
                    owns += [o for _, o in got]
        left, content, _ = t.dump((chunk + 1) * frames)
        real = rows.slice(ahead).select([*names, "_chunk"])
        none = [pa.nulls(len(real), f.type) for f in empty.schema][-4:]
        linked = pa.table([*real.columns, pa.array(slots, pa.int32()), pa.array(owns, pa.string()), *none], schema=empty.schema)
        summary = [rows[c][-1:] if c in group else pa.nulls(1, empty.schema.field(c).type) for c in [*names, "_chunk"]] + [
            pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.array([t.entry], empty.schema.field("_entry").type), pa.array([left], empty.schema.field("_exit").type),
            pa.array([t.bound]), pa.array([pickle.dumps(content)], pa.binary())]
        return pa.concat_tables([linked, pa.table(summary, schema=empty.schema)])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not len(rows):
                continue
            own = pa.concat_tables([held[-1].slice(len(held[-1]) - 1), rows] if held else [rows]).select(group).to_pandas().to_numpy()
            cut = np.flatnonzero((own[1:] != own[:-1]).any(1)) + (0 if held else 1)
            done = []
            for a, b in zip([0, *cut], [*cut, len(rows)]):
                if a or (held and len(cut) and cut[0] == 0):
                    done.append(run(pa.concat_tables(held), None))
                    held = []
                if b > a:
                    held.append(rows.slice(a, b - a))
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
        if held:
            yield from run(pa.concat_tables(held), None).combine_chunks().to_batches()

    def again(rows: pa.Table, states: pa.Table) -> pa.Table:
        content = pickle.loads(states["_state"][0].as_py() or pickle.dumps([]))
        rows = rows.sort_by([(c, "ascending") for c in order])
        return run(rows, ([content[i] for i in states["_order"][0].as_py()], states["_names"][0].as_py()))

    def walk(chunks: pa.Table) -> pa.Table:
        chunks = chunks.sort_by("_chunk")
        plan = _walk(chunks.select(["_chunk", "_entry", "_exit", "_bound"]).to_pylist(), named)
        new = [pa.array(x, kind) for x, kind in zip(zip(*plan), (pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())))]
        return pa.table([*[chunks[c] for c in [*group, "_v"]], *new], names=[*group, "_v", "_redo", "_from", "_order", "_names"])

    empty = df.sparkSession.createDataFrame([], schema).toArrow()
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name in group)
    # The number of partitions is the session's, not coalesced: the work is Python, not bytes.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ahead = d.repartition(n, *group).sortWithinPartitions(*group, F.desc("_warm"), *order)
    parts = [materialise(ahead.mapInArrow(first, schema)).withColumn("_v", F.lit(0))]
    stored = None
    while True:
        done = reduce(DataFrame.unionByName, parts)
        latest = (done.where("_bound IS NOT NULL").groupBy(*group)
                  .agg(F.max_by(F.struct("_v", "_entry", "_exit", "_bound"), "_v").alias("s")).select(*group, "s.*"))
        plan = materialise(latest.groupBy(*keys).applyInArrow(walk, f"{kinds}, _v int, {_PLAN}"))
        redo = plan.where("_redo")
        if redo.isEmpty():
            break
        states = done.where("_bound IS NOT NULL").groupBy(*group).agg(F.max_by("_state", "_v").alias("_state"))
        states = redo.join(states.withColumnRenamed("_chunk", "_from"), [*keys, "_from"], "left").select(*group, "_order", "_names", "_state")
        stored = stored or materialise(d.where(~F.col("_warm")))
        rows = stored.join(redo.select(*group), group, "left_semi")
        more = rows.groupBy(*group).cogroup(states.groupBy(*group)).applyInArrow(again, schema)
        parts.append(materialise(more).withColumn("_v", F.lit(len(parts))))
    rows = done.where("_bound IS NULL").join(plan.select(*group, "_v", "_names"), [*group, "_v"])
    who = F.coalesce("_own", F.get("_names", F.col("_slot")))
    return rows.select(*names, who.alias("_who"))


class _Tracker:
    """Live tracks, oldest first. A track at the start of a chunk has a ``slot``, its place there; one that begins in the chunk has an ``own`` name."""

    #: Whether decisions can depend on the names of tracks.
    named = False

    def __init__(self) -> None:
        self.live: list[dict] = []
        self.entry: list[dict] = []
        #: Whether the order or the names of the tracks at the start decided anything.
        self.bound = False

    def load(self, contents: list[tuple], names: list[str]) -> None:
        self.live = [{"slot": i, "own": None, **self.unpack(c)} for i, c in enumerate(contents)]
        self.entry = [{"name": n, "digest": _digest(c)} for c, n in zip(contents, names)]
        self.bound = False

    def dump(self, frame: int) -> tuple[list[dict], list[tuple], list[str]]:
        """What is left for ``frame``: each track's summary, content and name."""
        live = self.alive(frame)
        contents = [self.pack(t) for t in live]
        return ([{"slot": t["slot"], "own": t["own"], "digest": _digest(c)} for t, c in zip(live, contents)], contents,
                [t["own"] or self.entry[t["slot"]]["name"] for t in live])

    def alive(self, frame: int) -> list[dict]:
        return [t for t in self.live if frame - t["last"] <= self.max_gap]

    def start(self, own: str) -> dict:
        self.live.append({"slot": -1, "own": own})
        return self.live[-1]

    def tie(self, score: np.ndarray, ti: np.ndarray, di: np.ndarray) -> None:
        """Note whether two tracks of the start have the same score for a detection, so that their order decides."""
        if self.bound or not self.entry:
            return
        old = np.array([t["slot"] >= 0 for t in self.live], bool)[ti]
        score, di = score[old], di[old]
        o = np.lexsort((score, di))
        self.bound = bool(((di[o][1:] == di[o][:-1]) & (score[o][1:] == score[o][:-1])).any())


def _digest(content: tuple) -> str:
    return hashlib.sha256(pickle.dumps(content, protocol=5)).hexdigest()


def _overlaps(refs: list[np.ndarray], masks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shared pixels of every overlapping (reference, mask) pair, by a sort-merge on pixel numbers. Pairs without a shared pixel take no memory."""
    rp, mp = np.concatenate(refs), np.concatenate(masks)
    ro, mo = (np.repeat(np.arange(len(x)), [len(a) for a in x]) for x in (refs, masks))
    o = np.argsort(mp, kind="stable")
    mp, mo = mp[o], mo[o]
    lo = np.searchsorted(mp, rp, side="left")
    n = np.searchsorted(mp, rp, side="right") - lo
    at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    hit, both = np.unique(np.repeat(ro, n) * len(masks) + mo[at], return_counts=True)
    return hit // len(masks), hit % len(masks), both


#: Candidate pairs that a tracker holds at a time. Better ones are settled first, the others only between what is still free.
PAIRS = 1 << 19


def _same(sets: list[np.ndarray]) -> tuple[list[np.ndarray], list[list[int]]]:
    """The distinct ones, and which of the given ones are equal to each."""
    found: dict[bytes, int] = {}
    first, members = [], []
    for i, s in enumerate(sets):
        c = found.setdefault(s.tobytes(), len(first))
        if c == len(first):
            first.append(s)
            members.append([])
        members[c].append(i)
    return first, members


def _best_pairs(refs: list[np.ndarray], masks: list[np.ndarray], low: float, high: float, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(reference, mask, IoU) with IoU below ``high``, from the best one down to the returned floor; ``low`` where all fit into some ``pairs``."""
    size_r, size_m = (np.array([len(x) for x in s]) for s in (refs, masks))
    pixel, at = np.unique(np.concatenate(masks), return_inverse=True)
    # Masks that mostly overlap are multiplied as a table of their pixels, others met pixel by pixel.
    seen = np.bincount(at)
    dense = len(pixel) * len(masks) <= 16 * pairs and float((seen * seen).sum()) > len(masks) * len(masks) / 8
    if dense:
        table = np.zeros((len(pixel), len(masks)), np.float32)
        table[at, np.repeat(np.arange(len(masks)), size_m)] = 1
    step = max(pairs // (len(masks) if dense else max(int(seen.max()) * int(size_r.max()), 1)), 1)
    got, held = [], 0
    for start in range(0, len(refs), step):
        part = refs[start:start + step]
        if dense:
            r = np.concatenate(part)
            to = np.minimum(np.searchsorted(pixel, r), len(pixel) - 1)
            hit = pixel[to] == r
            own = np.zeros((len(part), len(pixel)), np.float32)
            own[np.repeat(np.arange(len(part)), size_r[start:start + step])[hit], to[hit]] = 1
            both = own @ table
            ti, di = np.nonzero(both)
            both = both[ti, di].astype(np.int64)
        else:
            ti, di, both = _overlaps(part, masks)
        ti = ti + start
        iou = (both / (size_r[ti] + size_m[di] - both)).astype(np.float32).astype(float)
        keep = (iou >= low) & (iou < high)
        got.append((ti[keep], di[keep], iou[keep]))
        held += int(keep.sum())
        if held > 2 * pairs:
            ti, di, iou = (np.concatenate(x) for x in zip(*got))
            low = float(np.partition(iou, len(iou) - pairs)[len(iou) - pairs])
            keep = iou >= low
            got, held = [(ti[keep], di[keep], iou[keep])], int(keep.sum())
    return *(np.concatenate(x) for x in zip(*got)), low


def _by_overlap(refs: list[np.ndarray], masks: list[np.ndarray], old: list[bool], iou_min: float, pairs: int = 0) -> tuple[list[int | None], bool]:
    """The reference of each mask: pairs are taken greedily by IoU, then later reference, then later mask. Also whether two old references tied for a mask.

    Equal sets are one candidate."""
    (ref, tracks), (mask, dets) = _same(refs), _same(masks)
    owner: list[int | None] = [None] * len(masks)
    bound, high = False, np.inf
    while True:
        us, vs = ([i for i, m in enumerate(x) if m] for x in (tracks, dets))
        if not us or not vs:
            return owner, bound
        u, v, iou, low = _best_pairs([ref[i] for i in us], [mask[i] for i in vs], iou_min, high, pairs or PAIRS)
        u, v = np.array(us)[u], np.array(vs)[v]
        # Old tracks with the same score for a detection: their order decides.
        if not bound and any(old):
            count = np.array([sum(old[t] for t in m) for m in tracks])[u]
            o = np.lexsort((iou, v))
            new = np.r_[True, (v[o][1:] != v[o][:-1]) | (iou[o][1:] != iou[o][:-1])][:len(o)]
            bound = bool(len(o)) and bool((np.add.reduceat(count[o], np.flatnonzero(new)) > 1).any())
        o = np.argsort(-iou, kind="stable")
        u, v, iou = u[o], v[o], iou[o]
        a = 0
        while a < len(iou):
            b = int(np.searchsorted(-iou, -iou[min(a + 16384, len(iou)) - 1], side="right"))
            open_ = np.array([bool(m) for m in tracks])[u[a:b]] & np.array([bool(m) for m in dets])[v[a:b]]
            i, j, score = u[a:b][open_], v[a:b][open_], iou[a:b][open_]
            for x, y in zip(*(np.r_[e].astype(int).tolist() for e in ((0, np.flatnonzero(np.diff(score)) + 1), (np.flatnonzero(np.diff(score)) + 1, len(score))))) if len(score) else ():
                to: dict[int, list[int]] = {}
                for m, n in zip(i[x:y].tolist(), j[x:y].tolist()):
                    to.setdefault(m, []).append(n)
                for t, m in sorted(((t, m) for m in to for t in tracks[m]), reverse=True):
                    n = max((n for n in to[m] if dets[n]), key=lambda n: dets[n][-1], default=None)
                    if n is not None:
                        owner[dets[n].pop()] = t
                        tracks[m].remove(t)
            a = b
        if low <= iou_min:
            return owner, bound
        high = low


class _IouTracker(_Tracker):
    def __init__(self, iou_min: float, max_gap: int, memory: int) -> None:
        super().__init__()
        self.iou_min, self.max_gap, self.memory = iou_min, max_gap, memory

    @staticmethod
    def pack(t: dict) -> tuple:
        return t["last"], [m.astype("<i8").tobytes() for m in t["recent"]]

    def unpack(self, content: tuple) -> dict:
        return self.seen({}, [np.frombuffer(m, "<i8") for m in content[1]], content[0])

    def seen(self, t: dict, recent: list[np.ndarray], frame: int) -> dict:
        t["recent"] = recent[-self.memory:]
        t["ref"] = np.unique(np.concatenate(t["recent"])) if len(t["recent"]) > 1 else t["recent"][0]
        t["last"] = frame
        return t

    def step(self, frame: int, ids: np.ndarray, raw: np.ndarray) -> list[tuple]:
        self.live = self.alive(frame)
        masks = [np.unique(m) for m in raw]
        owner: list[dict | None] = [None] * len(masks)
        if self.live:
            to, bound = _by_overlap([t["ref"] for t in self.live], masks, [t["slot"] >= 0 for t in self.live], self.iou_min)
            owner = [None if i is None else self.live[i] for i in to]
            self.bound |= bound and bool(self.entry)
        for di, m in enumerate(masks):
            t = owner[di]
            if t is None:
                t = owner[di] = self.start(f"{frame}:{ids[di]}")
            self.seen(t, [*t.get("recent", []), m], frame)
        return [(t["slot"], t["own"]) for t in owner]


def _by_first_detection(linked: DataFrame) -> DataFrame:
    """A track is named by the frame and number of its first detection."""
    key = F.split("_who", ":")
    return linked.withColumns({"_tf": key[0].cast("int"), "_td": key[1].cast("int")}).drop("_who")


def number_tracks(linked: DataFrame, trial: Sequence[str], size: int = CHUNK) -> DataFrame:
    """Turn the key of a track's first detection into rising ids per trial, from 0. The tracker has stored its rows, so it
    does not run again for each step that reads them."""
    t = linked.select(*trial, "_tf", "_td").distinct()
    t = ordered.number_rows(t, trial, ["_tf", "_td"], F.floor(F.col("_tf") / size), name="track_id")
    return linked.join(t, [*trial, "_tf", "_td"]).drop("_tf", "_td")


#: Pixel numbers of a strip.
STRIP = 1 << 15


def mask_parts(det: DataFrame, keys: Sequence[str], strip: int = STRIP, size: int = CHUNK) -> DataFrame:
    """Add ``_part``: detections of different parts share no pixel.

    Pixel numbers are cut into strips of ``strip``. Strips with a mask that reaches from one into the next are one part, named by its first strip; masks that
    fill the image leave one part.
    """
    at = lambda end: F.floor(end / F.lit(strip))
    d = det.withColumns({"_lo": at(F.array_min("mask")), "_hi": at(F.array_max("mask"))})
    # A crossed border is named by the strip before it.
    crossed = d.where("_hi > _lo").select(*keys, F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)).alias("frame")).distinct()
    runs = ordered.stretch_starts(crossed, keys, 1, name="_run", size=size)
    strips = runs.select(*keys, F.explode(F.array(F.col("frame"), F.col("frame") + 1)).alias("_lo"), "_run").distinct()
    # A mask without pixels overlaps nothing, so it can be in any part.
    part = F.coalesce("_run", "_lo", F.lit(0)).cast("long")
    return d.join(strips, [*keys, "_lo"], "left").withColumn("_part", part).drop("_lo", "_hi", "_run")


def link_by_iou(det: DataFrame, trial: Sequence[str], iou_min: float = 0.3, max_gap: int = 3, memory: int = 5,
                size: int = CHUNK, frames: int = FRAMES, warm: int = WARM, strip: int = STRIP,
                keep: Sequence[str] = ()) -> DataFrame:
    """Link detections to tracks by mask overlap.

    ``det`` has ``frame, det_id`` and ``mask`` (pixel numbers). In each frame, pairs of a live track (union of its last
    ``memory`` masks) and a detection are taken greedily by IoU, then by younger track, then by later detection, down to
    ``iou_min``. Other detections open tracks. A track closes once idle for more than ``max_gap`` frames.
    Only masks that share a pixel can be linked, so the parts of an image that no mask connects (:func:`mask_parts`) are tracked apart.
    Columns named in ``keep`` go along.
    """
    d = mask_parts(bursts(det.select(*trial, "frame", "det_id", *keep, "mask"), trial, max_gap, size), [*trial, "_burst"], strip, size)
    linked = in_chunks(d, [*trial, "_burst", "_part"], ("frame", "det_id"), ("det_id", "mask"), lambda: _IouTracker(iou_min, max_gap, memory), frames, warm, drop=("mask",))
    return number_tracks(_by_first_detection(linked).drop("_burst", "_part"), trial, size)


def _within(ref: np.ndarray, xy: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every (reference, point) pair within ``radius`` and its distance, in the order of the pairs; only points of the nine cells around a reference are compared."""
    # Cells are a little wider than the radius, so that rounding puts no pair two cells apart.
    ref_ok, xy_ok = np.flatnonzero(np.isfinite(ref).all(1)), np.flatnonzero(np.isfinite(xy).all(1))
    side = radius * 1.001 or 1.0
    cells = np.floor(np.concatenate([ref[ref_ok], xy[xy_ok]]) / side)
    names = [np.unique(cells[:, k], return_inverse=True) for k in (0, 1)]
    own = [inverse[len(ref_ok):] for _, inverse in names]
    width = len(names[1][0]) + 1
    cell = own[0] * width + own[1]
    o = np.argsort(cell, kind="stable")
    cell, pairs = cell[o], []
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            want, there = [], np.ones(len(ref_ok), bool)
            for (values, _), k, by in zip(names, (0, 1), (i, j)):
                to = cells[:len(ref_ok), k] + by
                at = np.minimum(np.searchsorted(values, to), max(len(values) - 1, 0))
                there &= values[at] == to if len(values) else False
                want.append(at)
            r = np.flatnonzero(there)
            code = want[0][r] * width + want[1][r]
            lo = np.searchsorted(cell, code, side="left")
            n = np.searchsorted(cell, code, side="right") - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            t, d = ref_ok[np.repeat(r, n)], xy_ok[o[at]]
            far = np.hypot(ref[t, 0] - xy[d, 0], ref[t, 1] - xy[d, 1])
            keep = far <= radius
            pairs.append((t[keep], d[keep], far[keep]))
    t, d, far = (np.concatenate(x) for x in zip(*pairs))
    o = np.lexsort((d, t))
    return t[o], d[o], far[o]


def _reached(ref: np.ndarray, xy: np.ndarray, radius: float) -> int:
    """At least the number of pairs within ``radius``: those of neighbouring cells."""
    side = radius * 1.001 or 1.0
    (a, n), (b, m) = (np.unique(np.floor(p[np.isfinite(p).all(1)] / side).astype(np.int64), axis=0, return_counts=True) for p in (ref, xy))
    known = {tuple(c): k for c, k in zip(b.tolist(), m.tolist())}
    return sum(k * known.get((x + i, y + j), 0) for (x, y), k in zip(a.tolist(), n.tolist()) for i in (-1, 0, 1) for j in (-1, 0, 1))


class _CentroidTracker(_Tracker):
    def __init__(self, radius: float, max_gap: int) -> None:
        super().__init__()
        self.radius, self.max_gap = radius, max_gap

    @staticmethod
    def pack(t: dict) -> tuple:
        return t["last"], t["xy"]

    @staticmethod
    def unpack(content: tuple) -> dict:
        return {"last": content[0], "xy": content[1]}

    def coincident(self, ref: np.ndarray, xy: np.ndarray, owner: list[dict | None]) -> tuple[np.ndarray, np.ndarray]:
        """Give detections to tracks at the same place, in the order of both, however many there are; returns the tracks and detections left."""
        places = np.unique(np.concatenate([ref, xy]), axis=0, return_inverse=True)[1].ravel()
        finite = np.isfinite(np.concatenate([ref, xy])).all(1)
        at: dict[int, list[int]] = {}
        for i in np.flatnonzero(finite[:len(ref)])[::-1].tolist():
            at.setdefault(int(places[i]), []).append(i)
        n_old = np.bincount(places[:len(ref)][[t["slot"] >= 0 for t in self.live] & finite[:len(ref)]], minlength=places.max() + 1)
        there = places[len(ref):][finite[len(ref):]]
        self.bound |= bool(self.entry) and bool((n_old[there] > 1).any())
        free = np.ones(len(ref), bool)
        for j in np.flatnonzero(finite[len(ref):]).tolist():
            tracks = at.get(int(places[len(ref) + j]))
            if tracks:
                i = tracks.pop()
                owner[j], free[i] = self.live[i], False
        return np.flatnonzero(free), np.array([j for j, t in enumerate(owner) if t is None], int)

    def step(self, frame: int, ids: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> list[tuple]:
        self.live = self.alive(frame)
        owner: list[dict | None] = [None] * len(ids)
        xy = np.column_stack([cx, cy]).astype(float)
        if self.live:
            ref = np.array([t["xy"] for t in self.live])
            free, left = self.coincident(ref, xy, owner)
            far, reached = self.radius, 0.0
            while len(free) and len(left):
                # Nearer pairs first; what they leave free is thinner, so the next step can reach further.
                while far > reached and _reached(ref[free], xy[left], far) > PAIRS and far - reached > self.radius * 1e-3:
                    far = (far + reached) / 2
                ti, di, d = _within(ref[free], xy[left], far)
                ti, di = free[ti], left[di]
                self.tie(d, ti, di)
                o = np.lexsort((di, ti, d))
                used = set()
                for i, j in zip(ti[o].tolist(), di[o].tolist()):
                    if i not in used and owner[j] is None:
                        used.add(i)
                        owner[j] = self.live[i]
                free, left = free[~np.isin(free, list(used))], left[[owner[j] is None for j in left.tolist()]]
                if far >= self.radius:
                    break
                reached, far = far, min(self.radius, 2 * far)
        for di in range(len(ids)):
            t = owner[di]
            if t is None:
                t = owner[di] = self.start(f"{frame}:{ids[di]}")
            t["xy"], t["last"] = (float(cx[di]), float(cy[di])), frame
        return [(t["slot"], t["own"]) for t in owner]


def link_by_centroid(strong: DataFrame, trial: Sequence[str], radius: float = 50.0, max_gap: int = 3,
                     size: int = CHUNK, frames: int = FRAMES, warm: int = WARM) -> DataFrame:
    """Link strong blobs (``frame, det_id, cx, cy``) to the nearest live track within ``radius``, nearest pair first."""
    d = bursts(strong, trial, max_gap, size)
    linked = in_chunks(d, [*trial, "_burst"], ("frame", "det_id"), ("det_id", "cx", "cy"), lambda: _CentroidTracker(radius, max_gap), frames, warm)
    return number_tracks(_by_first_detection(linked).drop("_burst"), trial, size)


def _nearest(q: dict[str, np.ndarray], c: dict[str, np.ndarray], radius: float, gaps: Sequence[int], ratio: tuple[float, float] | None, pairs: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """For each query the candidate (-1 for none), its gap and distance: first gap, then distance, then place in ``c``, within ``radius`` and ``ratio``.

    Cells start small and double until no nearer candidate can be outside, so a crowd costs a query a few candidates; ``pairs`` are held at a time."""
    n = len(q["f"])
    to, gap, far = np.full(n, -1), np.zeros(n, np.int64), np.full(n, np.inf)
    low, high = ratio or (0.0, np.inf)
    side = radius * 1.001 or 1.0
    extent = max(np.ptp(c["x"]), np.ptp(c["y"]), side)
    levels = int(np.clip(np.ceil(np.log2(side / (extent / np.sqrt(len(c["x"]) / len(np.unique(c["f"])) / 4)))), 0, 12))
    # Bins of the weight: of three or four neighbouring ones only about half can fail the ratio.
    wide = np.log(high / low) / 2 if ratio else 1.0
    own, first = (np.log(c["w"]) / wide, np.log(q["w"] * low) / wide - 1e-9) if ratio else (np.zeros(len(c["x"])), np.zeros(n))
    f0 = min(q["f"].min() + min(gaps), c["f"].min())
    for step in gaps:
        todo = np.flatnonzero(to < 0)
        for level in range(levels, -1, -1):
            s = side / 2 ** level
            place = lambda d: [np.floor(d[k] / s + 0.37).astype(np.int64) for k in ("x", "y")]  # noqa: E731,B023
            (ca, cb), (qa, qb), cw, qw = place(c), place({k: q[k][todo] for k in ("x", "y")}), np.floor(own).astype(np.int64), np.floor(first[todo]).astype(np.int64)
            base = [min(u.min(), v.min() if len(v) else u.min()) - 1 for u, v in ((ca, qa), (cb, qb), (cw, qw))]
            span = [max(u.max(), v.max() if len(v) else u.max()) - m + 6 for (u, v), m in zip(((ca, qa), (cb, qb), (cw, qw)), base)]
            code = lambda f, a, b, w: (((f - f0) * span[0] + a - base[0]) * span[1] + b - base[1]) * span[2] + w - base[2]  # noqa: E731,B023
            key = code(c["f"], ca, cb, cw)
            order = np.argsort(key, kind="stable")
            key = key[order]
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    # The bins of the weight lie next to each other.
                    want = code(q["f"][todo] + step, qa + i, qb + j, qw)
                    lo, hi = np.searchsorted(key, want, side="left"), np.searchsorted(key, want + (3 if ratio else 0), side="right")
                    count = hi - lo
                    a = 0
                    total = np.cumsum(count)
                    while a < len(todo):
                        b = max(int(np.searchsorted(total, (total[a - 1] if a else 0) + pairs, side="right")), a + 1)
                        k = count[a:b]
                        who = np.repeat(todo[a:b], k)
                        near = order[np.repeat(lo[a:b] - np.cumsum(k) + k, k) + np.arange(k.sum())]
                        dx, dy = q["x"][who] - c["x"][near], q["y"][who] - c["y"][near]
                        d = np.sqrt(dx * dx + dy * dy)
                        keep = (d <= radius) & (d <= far[who])
                        if ratio:
                            share = c["w"][near] / q["w"][who] if step > 0 else q["w"][who] / c["w"][near]
                            keep &= (share >= low) & (share <= high)
                        who, near, d = who[keep], near[keep], d[keep]
                        o = np.lexsort((near, d, who))
                        who, near, d = who[o], near[o], d[o]
                        top = np.flatnonzero(np.r_[True, who[1:] != who[:-1]][:len(who)])
                        who, near, d = who[top], near[top], d[top]
                        better = (d < far[who]) | (to[who] < 0) | (near < to[who])
                        to[who[better]], far[who[better]], gap[who[better]] = near[better], d[better], step
                        a = b
            if level:
                rest = [q[k][todo] / s + 0.37 - v for k, v in (("x", qa), ("y", qb))]
                edge = s * (1 + np.minimum.reduce([rest[0], 1 - rest[0], rest[1], 1 - rest[1]]) - 1e-6)
                todo = todo[far[todo] >= edge]
    return to, gap, far


def nearest_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], radius: float, gaps: Sequence[int] = (0,),
                 ratio: tuple[float, float] | None = None, frames: int = 16) -> DataFrame:
    """``keys, id, to, gap, d``: for each row of ``left`` (``id, f, x, y, w``) the nearest row of ``right`` (``to, f, x, y, w``) ``gaps`` frames later.

    The first gap with a row within ``radius`` counts, then the distance, then the smaller ``to``; ``ratio`` bounds the later row's ``w`` over the earlier
    one's. Blocks of ``frames`` frames are searched by cells, so no pair is a row.
    """
    group = [*keys, "_b"]
    used = [*keys, "f", "x", "y", *(["w"] if ratio else [])]
    cast = [F.col("f").cast("long").alias("f"), *[F.col(c).cast("double").alias(c) for c in used if c in ("x", "y", "w")]]
    q = left.dropna(subset=used).select(*keys, "id", *cast).withColumn("_b", F.floor(F.col("f") / frames))
    c = right.dropna(subset=used).select(*keys, "to", *cast)
    c = c.withColumn("_b", F.explode(F.sequence(F.floor((F.col("f") - max(gaps)) / frames), F.floor((F.col("f") - min(gaps)) / frames))))
    kinds = {f.name: f.dataType.simpleString() for d in (q, c) for f in d.schema}
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in [*keys, "id", "to"]) + ", gap bigint, d double"

    def search(rows: pa.Table) -> pa.Table:
        asks = rows["id"].is_valid()
        a, b = rows.filter(asks), rows.filter(pa.compute.invert(asks)).sort_by("to")
        to = np.full(len(a), -1)
        if len(a) and len(b):
            to, gap, far = _nearest(*({n: t[n].to_numpy() for n in ("f", "x", "y", *(["w"] if ratio else []))} for t in (a, b)), radius, gaps, ratio)
        got = np.flatnonzero(to >= 0)
        if not len(got):
            gap = far = np.zeros(0)
        out = a.take(pa.array(got)).select([*keys, "id"])
        for name, col in (("to", b["to"].take(pa.array(to[got]))), ("gap", pa.array(gap[got], pa.int64())), ("d", pa.array(far[got], pa.float64()))):
            out = out.append_column(name, col)
        return out

    return q.unionByName(c, allowMissingColumns=True).groupBy(*group).applyInArrow(search, schema)


def attach_weak(tracked: DataFrame, weak: DataFrame, trial: Sequence[str], reach: float = 24.0) -> DataFrame:
    """Weak blobs within ``reach`` of a strong blob of their frame belong to the nearest one's track; others are noise."""
    keys = [*trial, "frame"]
    place = [F.col("frame").alias("f"), F.col("cx").alias("x"), F.col("cy").alias("y")]
    best = nearest_rows(weak.select(*trial, F.struct("frame", "det_id").alias("id"), *place), tracked.select(*trial, F.col("track_id").alias("to"), *place), trial, float(reach))
    best = best.groupBy(*trial, "id").agg(F.min(F.struct("d", "to")).alias("m"))
    best = best.select(*trial, "id.frame", "id.det_id", F.col("m.to").alias("track_id"), F.col("m.d").alias("distance_px"))
    return weak.join(best, [*keys, "det_id"], "left").withColumn("is_noise", F.col("track_id").isNull())


def two_level_summary(tracked: DataFrame, attached: DataFrame, trial: Sequence[str], valid_frames: int = 5) -> DataFrame:
    """Strong and weak blobs per track; a track of at least ``valid_frames`` frames is valid."""
    s = tracked.groupBy(*trial, "track_id").agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("n_strong"))
    w = attached.where(~F.col("is_noise")).groupBy(*trial, "track_id").agg(F.count(F.lit(1)).alias("n_weak"))
    return (s.join(w, [*trial, "track_id"], "left").na.fill(0, ["n_weak"])
            .withColumn("is_valid", F.col("n_strong") >= valid_frames))


def track_predictions(strong: DataFrame, trial: Sequence[str]) -> DataFrame:
    """One prediction per track: median centroid of its strong blobs, at the frame of the largest."""
    keys = [*trial, "track_id"]
    # Stored once, so that what led to the blobs does not run again for each median.
    strong = materialise(strong.select(*keys, "frame", "area_px", "cx", "cy"))
    g = strong.groupBy(*keys).agg(F.max_by("frame", F.struct("area_px", -F.col("frame"))).alias("frame_idx"),
                                  F.count(F.lit(1)).alias("n_strong"))
    for c in ("cx", "cy"):
        g = g.join(ordered.median(strong, keys, c, F.floor(c), c), keys)
    return g


def merge_tracks(blobs: DataFrame, trial: Sequence[str], max_gap: int = 5, max_distance: float = 60.0,
                 ratio: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """Chain tracks that continue each other: ``(trial, track_id) -> merged_id`` (the first track of the chain).

    A track end is joined to a start at most ``max_gap`` frames later and ``max_distance`` away with a similar mean area.
    An end takes its nearest start (gap, distance, id) and a start its nearest end; both must agree. Tracks without a
    strong blob are dropped. Chains are resolved by pointer doubling.
    """
    keys = list(trial)
    ends = blobs.where("is_strong").groupBy(*keys, "track_id").agg(
        F.min("frame").alias("s"), F.max("frame").alias("e"), F.min_by(F.struct("cx", "cy"), "frame").alias("a"),
        F.max_by(F.struct("cx", "cy"), "frame").alias("z"), F.avg("area_px").alias("area"))
    ends = materialise(ends)
    start = [F.col("s").alias("f"), F.col("a.cx").alias("x"), F.col("a.cy").alias("y"), F.col("area").alias("w")]
    end = [F.col("e").alias("f"), F.col("z.cx").alias("x"), F.col("z.cy").alias("y"), F.col("area").alias("w")]
    # No mean area, no ratio.
    sized = ends.where("area > 0")
    rows = lambda name, place: sized.select(*keys, F.col("track_id").alias(name), *place)
    gaps = range(1, max_gap + 1)
    out = nearest_rows(rows("id", end), rows("to", start), keys, float(max_distance), list(gaps), ratio)
    out = out.select(*keys, F.col("id").alias("l"), F.col("to").alias("r"))
    back = nearest_rows(rows("id", start), rows("to", end), keys, float(max_distance), [-g for g in gaps], ratio)
    back = back.select(*keys, F.col("id").alias("r"), F.col("to").alias("l"))
    link = out.join(back, [*keys, "l", "r"])
    head = ends.select(*keys, "track_id").join(
        link.select(*keys, F.col("r").alias("track_id"), F.col("l").alias("merged_id")), [*keys, "track_id"], "left")
    head = cut_lineage(head.withColumn("merged_id", F.coalesce("merged_id", "track_id")))
    while True:
        up = head.select(*keys, F.col("track_id").alias("merged_id"), F.col("merged_id").alias("_up"))
        nxt = cut_lineage(head.join(up, [*keys, "merged_id"])
                          .select(*keys, "track_id", F.col("_up").alias("merged_id"),
                                  (F.col("_up") != F.col("merged_id")).alias("_moved")))
        moved = nxt.where("_moved").limit(1).count()
        head = nxt.drop("_moved")
        if not moved:
            return head


class _IdentityTracker(_Tracker):
    """Names and their last positions, in the order in which the names appeared. Positions never expire."""

    named = True

    def __init__(self, max_distance: float) -> None:
        super().__init__()
        self.max_distance = max_distance

    @staticmethod
    def pack(t: dict) -> tuple:
        return t["xy"]

    @staticmethod
    def unpack(content: tuple) -> dict:
        return {"xy": content}

    def alive(self, frame: int) -> list[dict]:
        return self.live

    def _named(self, name: str) -> dict:
        """The track of that name, a new one if there is none."""
        for t in self.live:
            if (t["own"] or self.entry[t["slot"]]["name"]) == name:
                return t
        return self.start(name)

    def step(self, _frame: int, limbs: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> list[tuple]:
        known, out = list(self.live), [(-1, str(name)) for name in limbs]
        costs = sorted((float(np.hypot(cx[i] - t["xy"][0], cy[i] - t["xy"][1])), i, j) for i in range(len(out)) for j, t in enumerate(known))
        rows, taken, matched = set(), set(), {}
        self.bound |= len({(cost, i) for cost, i, _ in costs}) < len(costs)
        for cost, i, j in costs:
            if i in rows or j in taken:
                continue
            rows.add(i)
            taken.add(j)
            if cost <= self.max_distance:
                matched[i] = known[j]
                out[i] = (known[j]["slot"], known[j]["own"])
        for i, t in matched.items():
            t["xy"] = (float(cx[i]), float(cy[i]))
        # A foot without a match takes over its tentative name, so names decide.
        for i, name in enumerate(limbs):
            if i not in matched:
                self.bound = True
                t = self._named(str(name))
                t["xy"] = (float(cx[i]), float(cy[i]))
        return out


def carry_identity(feet: DataFrame, trial: Sequence[str], max_distance: float = 50.0, frames: int = FRAMES, warm: int = WARM) -> DataFrame:
    """``identity``: limb names carried from frame to frame by nearest centroid, cheapest pair first, within a distance.

    A foot that matches nothing keeps its tentative ``limb`` name and becomes the latest position of that name. Positions
    never expire, so a recording is one sequence with at most one position per limb name as state.
    """
    linked = in_chunks(feet, trial, ("frame", "limb_ord"), ("limb", "cx", "cy"), lambda: _IdentityTracker(max_distance), frames, warm)
    return linked.withColumnRenamed("_who", "identity")
