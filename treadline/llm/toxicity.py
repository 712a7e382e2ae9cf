"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated bigram models, one of toxic and one of ordinary texts. Each level discounts its counts and adds those of the level below, c being the class::

    p_c(w | v)  ~  n_c(v, w) - discount + (KAPPA + discount) * (share of c among p_c(w) * n_c(v))          after v
    p_c(w)      ~  n_c(w)    - discount + (KAPPA + discount) * (share of c)

``n_c(v, w)`` is the number of texts that have the pair, ``n_c(v)`` its sum over what follows v. ``n_c(w)`` is Kneser-Ney's continuation count, the number of different
words before ``w`` in class c, but at most the number of texts that have ``w``. The backoff counts, :data:`KAPPA` for each expression, are shared: a rare
expression gets them in the proportion of the level below, so it is hardly evidence for either class, and a pair that no training text has says what its word says.

The log-likelihoods are normalised by length: their difference is the mean over a passage of :data:`PASSAGE` words (shorter texts: their own words,
:data:`LEAST` at least), where a word that is repeated within a passage counts once, and a text is as toxic as its most toxic passage, so that a
long text doesn't hide one. A logistic curve
fitted to the training rows turns it into a score.

The classifier is fitted on a bounded sample of the labelled rows: of each class, the :data:`FIT_ROWS` rows with the smallest hash of their id, as far as their whole texts
have :data:`FIT_LETTERS` / 2 letters (``fit_rows`` and ``fit_letters`` of :func:`scored` change both). Counts cover all words and pairs of these rows, exactly, keyed by the words themselves. That bounds
the model: no more words and no more pairs than half the letters, 16 bytes a pair. So it is broadcast, and all texts are scored where they are read, whole and without a shuffle.
"""
from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treadline.llm.common import worker_cache
from treadline.session import materialise

KAPPA, DISCOUNT = 30.0, 0.75
PASSAGE, LEAST = 32, 24
#: The bound of the fit: labelled rows of each class, and letters of both classes together. A text of over a sixteenth of these letters is scored, but not learnt from.
FIT_ROWS, FIT_LETTERS = 8192, 1 << 26
#: Before a text's first word, and in place of a pair's first word where the row is about the word alone. Neither is a word.
START, ALONE = "", " "
_WORD = re.compile(r"\w+")
_COUNTED = ("n0", "n1", "d0", "d1", "a0", "a1")


class _Ids(dict):
    """Words numbered as they come; :data:`START` is 0."""

    def __init__(self) -> None:
        self[START] = 0

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        return i

    def of(self, text: str) -> np.ndarray:
        return np.array([self[w] for w in _WORD.findall(text.lower())], np.int64)

    def words(self) -> pa.Array:
        return pa.array(list(self), pa.string())


class _Known(dict):
    """The numbers of the model's words; any other word has the next number."""

    def __missing__(self, word: str) -> int:
        return len(self)

    def of(self, text: str) -> np.ndarray:
        found = _WORD.findall(text.lower())
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def _stored(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _pairs(h: np.ndarray) -> np.ndarray:
    """Each word's number with that of the word before it."""
    return np.concatenate([[0], h[:-1]]) << 32 | h


def _unpacked(text: bytes) -> str:
    return zlib.decompress(text).decode()


def held_out(id_col: str) -> Column:
    """Whether the rest of the CRC-32 of the id, written as text, by 5 is 0."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def training_ids(df: DataFrame, labels: DataFrame, id_col: str, label_col: str, fit_rows: int) -> tuple[DataFrame, np.ndarray]:
    """``id``, ``toxic`` and ``hash`` of the rows to learn from, at most ``fit_rows`` of each class, and how many labelled rows each class has.

    Labelled are ids of ``df`` with a label of 0 or 1 that aren't held out; of several labels of an id the highest counts. Only ids and labels are shuffled. Where the cut
    lies is found from counts in 65536 cells of the hash, so that few more rows than are taken are ever sorted.
    """
    marks = (labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("id"))
             .agg(F.max(F.col(label_col).cast("int")).alias("toxic")))
    marks = materialise(marks.join(df.select(F.col(id_col).alias("id")), "id", "left_semi").withColumn("hash", F.xxhash64(F.lit("fit"), "id")))
    cell = F.shiftright("hash", 48)
    found = marks.groupBy("toxic", cell.alias("cell")).count().orderBy("toxic", "cell").toArrow()
    labelled, chosen = np.zeros(2, np.int64), None
    for k in (0, 1):
        cells, n = (found[c].to_numpy()[found["toxic"].to_numpy() == k] for c in ("cell", "count"))
        labelled[k] = n.sum()
        last = int(cells[min(np.searchsorted(np.cumsum(n), fit_rows), len(n) - 1)]) if len(n) else 0
        own = marks.where((F.col("toxic") == k) & (cell <= last)).orderBy("hash", "id").limit(fit_rows)
        chosen = own if chosen is None else chosen.unionByName(own)
    return materialise(chosen), labelled


def training_texts(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int = FIT_ROWS,
                   fit_letters: int = FIT_LETTERS) -> tuple[DataFrame, np.ndarray]:
    """Compressed text (``packed``) and ``toxic`` of the rows to learn from, and for each class how many labelled rows one of them stands for.

    The ids are broadcast, at most ``2 * fit_rows`` of them, so texts stay where they are. Of each class, ids are taken in the order of their hash until
    their texts have ``fit_letters / 2`` letters.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            packed = pa.array([zlib.compress(t.encode(), 1) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array([len(t) for t in texts], pa.int64())], ["id", "packed", "letters"])

    chosen, labelled = training_ids(df, labels, id_col, label_col, fit_rows)
    ids = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("content")).join(F.broadcast(chosen.select("id")), "id", "left_semi")
    texts = materialise(ids.mapInArrow(pack, f"id {dict(ids.dtypes)['id']}, packed binary, letters bigint"))
    sizes = texts.groupBy("id").agg(F.sum("letters").alias("letters")).where(F.col("letters") <= fit_letters // 16)
    # At most fit_rows ids a class.
    so_far = Window.partitionBy("toxic").orderBy("hash", "id").rowsBetween(Window.unboundedPreceding, 0)
    kept = chosen.join(sizes, "id").withColumn("letters", F.sum("letters").over(so_far)).where(F.col("letters") <= fit_letters // 2)
    kept = materialise(kept.select("id", "toxic"))
    taken = {r.toxic: r["count"] for r in kept.groupBy("toxic").count().collect()}
    weights = labelled / np.maximum([taken.get(k, 0) for k in (0, 1)], 1)
    return texts.join(F.broadcast(kept), "id").select("packed", "toxic"), weights


def expression_counts(labelled: DataFrame) -> DataFrame:
    """In how many texts of each class (``n0``, ``n1``) each pair ``before``, ``word`` occurs; rows with :data:`ALONE` count the word itself.

    Texts are summed up per batch before they are shuffled; no pair and no word is left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pairs, alone = _Ids(), [[], []], [[], []]
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                h = ids.of(_unpacked(text.as_py()))
                if len(h):
                    pairs[toxic].append(np.unique(_pairs(h)))
                    alone[toxic].append(np.unique(h))
            words = ids.words()
            for toxic in (0, 1):
                if pairs[toxic]:
                    both, n = np.unique(np.concatenate(pairs[toxic]), return_counts=True)
                    own, m = np.unique(np.concatenate(alone[toxic]), return_counts=True)
                    before = pa.concat_arrays([words.take(pa.array(both >> 32)), pa.array([ALONE] * len(own), pa.string())])
                    word = words.take(pa.array(np.concatenate([both & 0xFFFFFFFF, own])))
                    n = np.concatenate([n, m])
                    counts = [pa.array(n), pa.array(np.zeros(len(n), np.int64))]
                    yield pa.RecordBatch.from_arrays([before, word, *(counts if toxic == 0 else counts[::-1])], ["before", "word", "n0", "n1"])

    return (labelled.mapInArrow(run, "before string, word string, n0 bigint, n1 bigint").groupBy("before", "word")
            .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def expression_table(labelled: DataFrame) -> DataFrame:
    """The counts of pairs and words. A word's row also has its different words before (``d0``, ``d1``) and the sums over the pairs that it begins (``a0``, ``a1``)."""
    counts = materialise(expression_counts(labelled))  # read as pairs, and for each word's sums
    zero = F.lit(0).cast("long")
    pairs, alone = counts.where(F.col("before") != ALONE), counts.where(F.col("before") == ALONE)
    ends = F.struct("word", *[(F.col(f"n{k}") > 0).cast("long").alias(f"d{k}") for k in (0, 1)], zero.alias("a0"), zero.alias("a1"))
    begins = F.struct(F.col("before").alias("word"), zero.alias("d0"), zero.alias("d1"), *[F.col(f"n{k}").alias(f"a{k}") for k in (0, 1)])
    sides = pairs.select(F.explode(F.array(ends, begins)).alias("s")).select("s.*", zero.alias("n0"), zero.alias("n1"))
    words = sides.unionByName(alone.select("word", "n0", "n1", *[zero.alias(c) for c in ("d0", "d1", "a0", "a1")]))
    words = words.groupBy("word").agg(*[F.sum(c).alias(c) for c in _COUNTED])
    none = [F.lit(None).cast("long").alias(c) for c in ("d0", "d1", "a0", "a1")]
    return pairs.select("before", "word", "n0", "n1", *none).unionByName(words.withColumn("before", F.lit(ALONE)))


def _said_before(h: np.ndarray) -> np.ndarray:
    """Which words stand at most a passage behind the same word."""
    order = np.argsort(h, kind="stable")
    again = (h[order[1:]] == h[order[:-1]]) & (order[1:] - order[:-1] <= PASSAGE)
    out = np.zeros(len(h), bool)
    out[order[1:]] = again
    return out


def _discounted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts less the discount, in proportion to the classes, and what was freed."""
    total = n.sum(0)
    freed = np.minimum(DISCOUNT, total)
    return n * (1 - freed / np.maximum(total, 1)), freed


class Model:
    """The counts, numbered and broadcast, with the sums of continuation counts and the curve. Tasks get the two broadcasts, never the model."""

    def __init__(self, table: DataFrame, weights: np.ndarray) -> None:
        context, self.key, self.weights = table.sparkSession.sparkContext, uuid.uuid4().hex, weights
        alone = F.col("before") == ALONE
        words = table.where(alone).select("word", *[F.col(c).cast("int") for c in _COUNTED]).toArrow().sort_by("word")
        if not words.num_rows:
            words = pa.table([[START], *[pa.array([0], pa.int32())] * 6], names=words.column_names)
        n = [words[f"n{k}"].to_numpy() for k in (0, 1)]
        self.total = np.array([[max(1.0, float(np.minimum(n[k], words[f"d{k}"].to_numpy()).sum()))] for k in (0, 1)])
        self.words = context.broadcast(_stored(words))
        names, key = self.words, self.key

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = worker_cache(f"toxic words {key}", lambda: _numbered(names.value)[0])
            codes, counts = [], []
            for batch in batches:
                v, w = (np.fromiter(map(ids.__getitem__, batch.column(i).to_pylist()), np.int64, batch.num_rows) for i in (0, 1))
                codes.append(v << 32 | w)
                counts.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)]))
            if codes:
                yield pa.RecordBatch.from_arrays([pa.array([_pair_table(np.concatenate(codes), np.concatenate(counts, 1))], pa.binary())], ["part"])

        pairs = table.where(~alone).select("before", "word", F.col("n0").cast("int"), F.col("n1").cast("int"))
        parts = [_pair_counts(p) for p in pairs.mapInArrow(number, "part binary").toArrow()["part"].to_pylist()]
        # A code that no pair has, for models without pairs.
        parts.append((np.array([-1]), np.zeros((2, 1), np.int32)))
        self.pairs = context.broadcast(_pair_table(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts], 1)))
        self.slope, self.middle = 1.0, 0.0


def _pair_table(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Pairs sorted by code, as steps from one code to the next, which compress well."""
    order = np.argsort(codes)
    return _stored(pa.table([np.diff(codes[order], prepend=0), *counts[:, order]], names=["step", "n0", "n1"]))


def _pair_counts(stored: bytes) -> tuple[np.ndarray, np.ndarray]:
    table = pa.ipc.open_stream(stored).read_all()
    return np.cumsum(table["step"].to_numpy()), np.stack([table["n0"].to_numpy(), table["n1"].to_numpy()])


def _numbered(stored: bytes) -> tuple[_Known, np.ndarray]:
    """The words' numbers, :data:`START` being 0, and their counts with a last column of zeros for other words."""
    table = pa.ipc.open_stream(stored).read_all()
    counts = np.stack([table[c].to_numpy() for c in _COUNTED])
    return _Known(zip(table["word"].to_pylist(), range(table.num_rows))), np.pad(counts, ((0, 0), (0, 1))).astype(float)


def _ratios(total: np.ndarray, texts: np.ndarray, before: np.ndarray, begun: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """log p_1(w | v) - log p_0(w | v) for each place in a text; a row per class and a column per place.

    Of the word at the place ``texts`` and different words ``before``, of the word before it the pairs ``begun``, and the texts with the ``pair``.
    """
    share = total / total.sum()
    own, freed = _discounted(np.minimum(texts, before))
    lower = (own + share * (KAPPA + freed)) / total
    after = begun + share * KAPPA
    own, freed = _discounted(pair)
    expected = after * lower
    p = (own + expected / expected.sum(0) * (KAPPA + freed)) / after
    return np.log(p[1] / p[0])


def evidence(h: np.ndarray, ratios: np.ndarray) -> float:
    """The largest mean of the ``ratios`` over a passage; 0 for a text without words."""
    if not len(h):
        return 0.0
    sums = np.concatenate([[0.0], np.cumsum(np.where(_said_before(h), 0, ratios), dtype=float)])
    if len(h) <= PASSAGE:
        return float(sums[-1] / max(len(h), LEAST))
    return float((sums[PASSAGE:] - sums[:-PASSAGE]).max() / PASSAGE)


def _text_evidence(h: np.ndarray, total: np.ndarray, words: np.ndarray, codes: np.ndarray, pairs: np.ndarray, label: int | None) -> float:
    """``words`` has texts, words before and pairs begun by the number of the word, ``pairs`` the texts with each of the sorted ``codes``; other pairs are in none.

    With a ``label``, the text is one of the training texts of that class, and is itself left out of the counts.
    """
    if not len(h):
        return 0.0
    code = _pairs(h)
    v, at = code >> 32, np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    texts, before, begun, pair = words[0:2, h], words[2:4, h], words[4:6, v], pairs[:, at] * (codes[at] == code).astype(float)
    if label is not None:
        own, place = np.unique(code, return_index=True)
        names, number = np.unique(np.concatenate([h, v]), return_inverse=True)
        # A word loses a word before it where no other text of the class has the pair; pairs that begin with a word are one fewer each.
        alone = pair[label, place] == 1
        lost = np.bincount(number[:len(h)][place], alone, len(names))
        gone = np.bincount(number[len(h):][place], minlength=len(names))
        for counts, less in ((texts, 1), (before, lost[number[:len(h)]]), (begun, gone[number[len(h):]]), (pair, 1)):
            counts[label] = np.maximum(counts[label] - less, 0)
    return evidence(h, _ratios(total, texts, before, begun, pair))


def train(labelled: DataFrame, weights: np.ndarray) -> Model:
    """Fit the models to :func:`training_texts`. Without texts of one of the classes, every text scores alike."""
    return _fit_curve(Model(expression_table(labelled), weights), labelled)


def _fit_curve(model: Model, labelled: DataFrame) -> Model:
    """A logistic curve of the label over the evidence, from a histogram of all training rows in cells of 1/1024, each text left out of its own counts.

    Each row counts for as many labelled rows as it stands for. The middle is where the fewest lie on the wrong side, which wrong labels don't move; the slope is the most likely one.
    """
    cell = F.floor(F.least(F.greatest(F.col("evidence"), F.lit(-16.0)), F.lit(16.0)) * 1024)
    n = [F.sum((F.col("toxic") == k).cast("long")).alias(f"n{k}") for k in (0, 1)]
    found = _evidence(labelled, model, "toxic", text="packed", leave_out=True).groupBy(cell.alias("cell")).agg(*n).where("cell is not null").toArrow()
    cells = {c: found[c].to_numpy().astype(np.int64, copy=False) for c in found.column_names}
    order = np.argsort(cells["cell"])
    x, n0, n1 = (cells["cell"][order] + 0.5) / 1024, *(cells[f"n{k}"][order] * model.weights[k] for k in (0, 1))
    model.slope = 0.0
    if not n1.sum() or not n0.sum():
        return model
    # Errors with the threshold before cell i: ordinary rows from i on, toxic rows before it.
    wrong = np.concatenate([[n0.sum()], n0.sum() - np.cumsum(n0) + np.cumsum(n1)])
    best = np.flatnonzero(wrong == wrong[1:].min())
    edges = np.concatenate([[x[0] - 1 / 1024], (x[1:] + x[:-1]) / 2, [x[-1] + 1 / 1024]])
    model.middle = float(edges[best[len(best) // 2]])
    z = x - model.middle
    slopes = np.geomspace(0.1, 1000, 200)
    loss = [(n1 * np.logaddexp(0, -a * z) + n0 * np.logaddexp(0, a * z)).sum() for a in slopes]
    model.slope = float(slopes[int(np.argmin(loss))])
    return model


def _evidence(df: DataFrame, model: Model, *carried: str, text: str = "content", leave_out: bool = False) -> DataFrame:
    """``evidence`` beside the ``carried`` columns; with ``leave_out``, the first of these is the label of a training text."""
    key, names, expressions, total = model.key, model.words, model.pairs, model.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, words), (codes, pairs) = worker_cache(f"toxic {key}", lambda: (_numbered(names.value), _pair_counts(expressions.value)))
        for batch in batches:
            own = batch.column(1).to_pylist() if leave_out else [None] * batch.num_rows
            found = (t.as_py() for t in batch.column(0))
            e = [_text_evidence(ids.of(t if isinstance(t, str) else _unpacked(t)), total, words, codes, pairs, k) for t, k in zip(found, own)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(e, pa.float64())], [*carried, "evidence"])

    kinds = dict(df.dtypes)
    return df.select(text, *carried).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in carried) + ", evidence double")


def scored(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS,
           fit_letters: int = FIT_LETTERS) -> DataFrame:
    """One row per row of ``df``: id, ``held_out``, ``score`` from 0 to 1, ``predicted``.

    Models are fitted on rows whose id has a label of 0 or 1 and isn't held out, ``fit_rows`` of each class and ``fit_letters`` letters at most; of an id with several labels the
    highest counts. Only the text enters the score. Null and empty texts and texts without words have no evidence and get the score of none; null ids are scored, never
    trained on. Very long texts are read whole. If the labels lack a class, all rows score 0.5 less a little, and none is predicted toxic.
    """
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    model = train(*training_texts(df, labels, id_col, text_col, label_col, fit_rows, fit_letters))
    out = _evidence(texts, model, "id")
    slope, middle = float(model.slope), float(model.middle)
    score = 1 / (1 + F.exp(-F.least(F.greatest((F.col("evidence") - middle) * slope, F.lit(-30.0)), F.lit(30.0))))
    score = F.lit(0.49) if slope == 0 else score
    return (out.select(F.col("id").alias(id_col), score.cast("double").alias("score"))
            .withColumns({"held_out": held_out(id_col), "predicted": (F.col("score") >= 0.5).cast("int")}))


def without_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are not predicted toxic. Each row is judged by its own text."""
    model = train(*training_texts(df, labels, id_col, text_col, "toxic"))
    if model.slope == 0:
        return df
    own = [f"c{i}" for i in range(len(df.columns))]
    rows = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("content"), *[F.col(c).alias(o) for c, o in zip(df.columns, own)])
    judged = _evidence(rows, model, *own).where(F.col("evidence") < float(model.middle))
    return judged.select(*[F.col(o).alias(c) for c, o in zip(df.columns, own)])
