"""Near duplicates by BagMinHash signatures, banding and exact verification of multiset overlap."""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treadline.llm.common import number_rows_globally, worker_cache
from treadline.session import cut_lineage, materialise

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 21, 6
#: Nodes of a bucket's main component that are probed first; nodes in a block of a bucket that is compared in blocks.
PROBES, BLOCK = 8, 256
_WORD = re.compile(r"\w+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        data = word.encode()
        h = self[word] = zlib.crc32(data) << 32 | zlib.adler32(data, 7)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str, kept: dict, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the text's runs of ``size`` words, folded to lower case, and how often each occurs.

    A text with fewer words, but at least one, has one shingle of all its words; one without words has none.
    """
    h = np.array([kept[w] for w in _WORD.findall(text.lower())], np.uint64)
    if not len(h):
        return h, np.zeros(0, np.int64)
    size, h = min(size, len(h)), _mix(h)
    total = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        total = total * _GOLDEN + h[k: len(h) - size + 1 + k]
    return np.unique(_mix(total), return_counts=True)


def signature(element: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """BagMinHash: ``m`` values, two of which agree with the probability of the bags' weighted Jaccard similarity.

    Each element has a Poisson process over weight levels and time. Levels are split into dyadic ranges (0,1], (1,2], (2,4], ..., each with a process of its
    own whose rate is the range's length, generated in order of time from counters alone; of a range that reaches past
    the weight, points above the weight are dropped. So bags share exactly the points below their common weight. A point falls to one of the ``m`` places,
    and each place keeps its earliest. Points are made up to a time by which every place should be met; if one isn't, up to twice that time.
    """
    levels = [np.zeros(len(element), np.int64)]
    which = [np.arange(len(element))]
    for j in range(1, int(weight.max()).bit_length() + 1):
        deep = np.flatnonzero(weight > 1 << (j - 1))
        if not len(deep):
            break
        which.append(deep)
        levels.append(np.full(len(deep), j))
    which, levels = np.concatenate(which), np.concatenate(levels)
    low = np.where(levels > 0, 1 << np.maximum(levels - 1, 0), 0)
    length = np.where(levels > 0, low, 1).astype(float)
    source = _mix(element[which] + levels.astype(np.uint64) * _M2 + _GOLDEN)
    top = weight[which]
    # Points come at a rate of the bag's weight; m (ln m + 4) of them meet all places in 98 of 100 cases.
    limit = m * (np.log(m) + 4) / float(weight.sum())
    while True:
        active, begun, count = np.arange(len(source)), np.zeros(len(source)), 0
        times, places, values = [], [], []
        while len(active):
            # As many points at once as an active process is likely to have.
            ahead = int(1.2 * limit * length[active].mean()) + 2
            r = _mix(source[active, None] + (np.arange(count + 1, count + ahead + 1, dtype=np.uint64) * _GOLDEN)[None, :])
            t = np.cumsum(-np.log((r >> np.uint64(11)) * 2.0 ** -53 + 2.0 ** -54), axis=1) / length[active, None] + begun[:, None]
            row, column = np.nonzero(t <= limit)
            s = _mix(r[row, column] + _M1)
            own = active[row]
            below = low[own] + (s >> np.uint64(32)) * 2.0 ** -32 * length[own] < top[own]
            times.append(t[row, column][below])
            places.append(((s[below] & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64))
            values.append(s[below])
            on = t[:, -1] <= limit
            active, begun, count = active[on], t[on, -1], count + ahead
        t, place, value = np.concatenate(times), np.concatenate(places), np.concatenate(values)
        late_first = np.argsort(-t, kind="stable")
        earliest = np.full(m, -1)
        earliest[place[late_first]] = late_first
        if (earliest >= 0).all():
            return value[earliest]
        limit *= 2


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(bands, dtype=np.uint64) * _M2
    for k in range(rows):
        h = _mix(h * np.uint64(3) + sig[k::rows][:bands] + _GOLDEN)
    return h.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags; 0 if either is empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def _signed(df: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_cache("neardup words", _Hashes)
        for batch in batches:
            out = []
            for text in batch.column(2):
                e, w = shingles(text.as_py(), kept)
                out.append(bands_of(signature(e, w, bands * rows), bands, rows) if len(e) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["id", "sha", "bands"])

    content = F.coalesce(F.col(text_col), F.lit(""))
    kind = dict(df.dtypes)[id_col]
    return (df.select(F.col(id_col).alias("id"), F.unhex(F.sha2(content, 256)).alias("sha"), content.alias("content"))
            .mapInArrow(run, f"id {kind}, sha binary, bands array<bigint>"))


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` with their ``overlap``, computed from the whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, bags = worker_cache("neardup words", _Hashes), {}
        for batch in batches:
            rows, found = [batch.column(k) for k in range(4)], []
            for i in range(batch.num_rows):
                a = rows[0][i].as_py()
                if a not in bags:
                    bags.clear()
                    bags[a] = shingles(rows[2][i].as_py(), kept)
                found.append(overlap(bags[a], shingles(rows[3][i].as_py(), kept)))
            yield pa.RecordBatch.from_arrays([*rows[:2], pa.array(found, pa.float64())], ["a", "b", "overlap"])

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("content").alias("ta")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("content").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, overlap double")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node it is connected to, for every node of the edges ``a``, ``b``.

    Labels spread along edges and jump to their label's label, so the rounds grow with the logarithm of a component's
    width. A hub's edges are summed up before they are shuffled.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        spread = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near")))
        new = (labels.join(spread, labels["node"] == spread["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("via")))
        goal = labels.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        new = cut_lineage(new.join(goal, "via").select("node", "old", F.least("via", "beyond").alias("label")))
        settled = new.where("old != label").isEmpty()
        labels = new.select("node", "label")
        if settled:
            return labels


def _open_pairs(members: DataFrame, labels: DataFrame, similarity: float, probing: bool) -> tuple[DataFrame, DataFrame] | None:
    """What to compare in buckets that aren't one component, and the members of those with many nodes outside the main one; None if all are one.

    ``far`` is a member's distance to its bucket's first leader. One minus the overlap is a metric, so members whose distances to the leader
    differ by more than a link may be long are no link and aren't compared. With ``probing``, where many nodes are outside the main component of a bucket, they are
    compared with a few nodes of it, which joins most of them to it.
    """
    found = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = found.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("all")).where(F.col("most.n") < F.col("all"))
    state = main.select("bucket", F.col("most.label").alias("main"), F.col("all").alias("size"), (F.col("all") - F.col("most.n")).alias("outside"))
    opened = materialise(found.join(state, "bucket"))
    others = opened.where("label != main")
    if others.isEmpty():
        return None
    apart = (F.col("label") != F.col("label_a")) & (F.abs(F.col("far") - F.col("far_a")) <= 1 - similarity + 1e-9)
    pick = lambda df: df.select("bucket", F.col("node").alias("a"), F.col("label").alias("label_a"), F.col("far").alias("far_a"))
    few = F.col("outside") <= PROBES
    pairs = opened.where(few).join(pick(others.where(few)), "bucket").where(apart)
    if probing:
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("node")))
        probes = pick(opened.where(~few & (F.col("label") == F.col("main"))).withColumn("rank", rank).where(F.col("rank") <= PROBES))
        pairs = pairs.select("a", "node").union(others.where(~few).join(probes, "bucket").where(apart).select("a", "node"))
    pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    return materialise(pairs), opened.where(~few)


def _linked_in_blocks(opened: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links ``a``, ``b`` between the components of a bucket, over all pairs, block by block.

    Nodes outside the main component and those in it are dealt to blocks by hash; a task compares two blocks of a bucket, at least one of them outside, and the texts
    of a block are sent once per block it meets rather than once per pair.
    """
    side = (F.col("label") != F.col("main")).cast("int")
    blocks = F.ceil(F.when(side == 1, F.col("outside")).otherwise(F.col("size") - F.col("outside")) / BLOCK)
    placed = opened.select("bucket", "node", "label", side.alias("side"), F.pmod(F.xxhash64("node"), F.greatest(blocks, F.lit(1))).alias("block"))
    known = placed.select("bucket", "side", "block").distinct()
    met = (known.where("side = 1").select("bucket", F.col("block").alias("first"))
           .join(known.select("bucket", F.col("side").alias("other_side"), F.col("block").alias("second")), "bucket")
           .where("other_side = 0 or second >= first"))
    left = met.withColumns({"side": F.lit(1), "block": F.col("first"), "role": F.lit(0)})
    right = met.withColumns({"side": F.col("other_side"), "block": F.col("second"), "role": F.lit(1)})
    rows = left.union(right).join(placed, ["bucket", "side", "block"]).join(texts, "node")

    def compare(found: pd.DataFrame) -> pd.DataFrame:
        kept, sets = worker_cache("neardup words", _Hashes), []
        for text in found["content"]:
            e, w = shingles(text, kept)
            if len(e):
                # The k-th occurrence of a shingle is an element of its own, so that bags become sets.
                nth = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
                e = np.repeat(e, w) + nth.astype(np.uint64) * _GOLDEN
            sets.append(e)
        size = np.array([len(x) for x in sets])
        values, at = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        a, b = (np.flatnonzero(found["role"].to_numpy() == k) for k in (0, 1))
        both = np.zeros((len(a), len(b)), np.float32)
        step = 4096
        for low in range(0, len(values), step):
            i, j = np.searchsorted(at, [low, low + step])
            dense = np.zeros((len(sets), step), np.float32)
            dense[row[i:j], at[i:j] - low] = 1
            both += dense[a] @ dense[b].T
        near = both >= similarity * (size[a][:, None] + size[b][None, :] - both) - 1e-6
        node, label = found["node"].to_numpy(np.int64), found["label"].to_numpy(np.int64)
        i, j = np.nonzero(near & (both > 0) & (label[a][:, None] != label[b][None, :]))
        # One link between two components is enough.
        _, one = np.unique(np.stack([label[a[i]], label[b[j]]], axis=1), axis=0, return_index=True)
        return pd.DataFrame({"a": node[a[i[one]]], "b": node[b[j[one]]]})

    return rows.groupBy("bucket", "first", "other_side", "second").applyInPandas(compare, "a bigint, b bigint")


def near_classes(df: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``class_id``, ``class_size``, ``kept``, ``text_sha256``.

    Texts are linked if their bags of five-word shingles, folded to lower case, overlap by ``similarity`` or more, or if they are
    identical; a class is a connected component, named by its smallest id. Signatures of ``bands * rows`` places propose the links: a pair at 0.8 is missed by all
    21 bands of 6 with a probability of 0.2 %, one at 0.9 in none of 10 million. Every proposed pair is verified on the whole texts.

    Copies of a text are one node. In a bucket, all nodes are compared with its smallest one. Where that doesn't make it one component, the nodes outside
    the largest component are compared with a few of its nodes, and what that leaves outside with all the rest: pair by pair, but for
    pairs that the triangle inequality rules out, or block by block where many are left. No link of a bucket is given up, and no bucket is
    gathered in a task.

    Null and empty texts and texts without words form classes of identical texts only. Texts with fewer than five words have one shingle. Null
    ids sort first and are ids like any other; ``kept`` marks one row of each class, one with the smallest id.
    """
    base = materialise(_signed(df, id_col, text_col, bands, rows))
    first = F.min(F.struct(F.col("id").isNotNull().alias("known"), F.col("id").alias("id")))
    nodes = base.groupBy("sha").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    nodes = materialise(number_rows_globally(nodes, [F.col("first"), F.col("sha")], "node"))
    members = nodes.where("bands is not null").select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = materialise(members.join(shared, "bucket").select("bucket", "node"))

    place = lambda i, s: F.xxhash64(i, s)
    wanted = (nodes.join(members.select("node").distinct(), "node", "left_semi")
              .select("node", place(F.col("first.id"), F.col("sha")).alias("place"), F.col("sha").alias("node_sha")))
    content = F.coalesce(F.col(text_col), F.lit(""))
    texts = df.select(F.unhex(F.sha2(content, 256)).alias("sha"), F.col(id_col).alias("id"), content.alias("content"))
    # Copies have ids of their own, so their rows don't meet in one place; repeated rows give a pair twice.
    texts = materialise(texts.withColumn("place", place(F.col("id"), F.col("sha"))).join(wanted, "place").where("sha = node_sha").select("node", "content"))

    labels = None
    if not members.isEmpty():
        lead = members.groupBy("bucket").agg(F.min("node").alias("leader"))
        led = materialise(members.join(lead, "bucket").where("node != leader"))
        compared = materialise(_compared(led.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), texts))
        edges = compared.where(F.col("overlap") >= similarity).select("a", "b")
        labels = components(edges)
        # Members other than the leader, with their distance to it; leaders have been compared with all.
        known = compared.select(F.col("a").alias("leader"), F.col("b").alias("node"), (1 - F.col("overlap")).alias("far"))
        members = led.join(known, ["leader", "node"]).select("bucket", "node", "far")
        for probing in (True, False):
            left = _open_pairs(members, labels, similarity, probing)
            if left is None:
                break
            new = _compared(left[0], texts).where(F.col("overlap") >= similarity).select("a", "b")
            if not probing:
                new = new.union(_linked_in_blocks(left[1], texts, similarity))
            edges = materialise(edges.union(new))
            labels = components(edges)

    classed = nodes.select("sha", "first", "copies", "node")
    if labels is not None:
        classed = classed.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        sizes = classed.groupBy("label").agg(F.sum("copies").alias("class_size"), F.min("first").alias("head"), F.min(F.struct("first", "sha")).alias("top"))
        classed = classed.join(sizes, "label").select("sha", F.col("head.id").alias("class_id"), "class_size", (F.col("top.sha") == F.col("sha")).alias("leads"))
    else:
        classed = classed.select("sha", F.col("first.id").alias("class_id"), F.col("copies").alias("class_size"), F.lit(True).alias("leads"))
    # Repeated rows of a class's first text: the first of them stays.
    nth = F.row_number().over(Window.partitionBy("id", "sha").orderBy("class_id"))
    out = base.select("id", "sha").join(classed, "sha").withColumn("nth", nth)
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", (F.col("leads") & F.col("id").eqNullSafe(F.col("class_id")) & (F.col("nth") == 1)).alias("kept"),
                      F.lower(F.hex("sha")).alias("text_sha256"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that :func:`near_classes` keeps, one of each class, with the columns of ``df``."""
    keep = near_classes(df, id_col=id_col, text_col=text_col, **options).where("kept")
    keep = keep.select(F.xxhash64(F.col(id_col), F.unhex("text_sha256")).alias("place")).distinct()
    sha = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    rows = df.select(F.struct(*df.columns).alias("row"), F.xxhash64(F.col(id_col), sha).alias("place"))
    # Repeated rows share a place; one of them stays.
    rows = rows.join(keep, "place").withColumn("nth", F.row_number().over(Window.partitionBy("place").orderBy("place")))
    return rows.where("nth = 1").select("row.*")
