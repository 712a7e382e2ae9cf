"""Language-model scores by a weighted backoff automaton over word pairs.

**Model.** Pairs are smoothed by absolute discounting over single words, which are counted from one up::

    p(w)     = (c(w) + 1) / (N + V + 1)                                 at the root; also the base score
    p(w | v) = max(c(v w) - D, 0) / c(v) + D * T(v) / c(v) * p(w)       in state v;  T(v): different words after v,  D = n1 / (n1 + 2 n2)

Each state's probabilities sum to 1 over the known words, the end, and one unknown word.

**Automaton.** A word with training tokens is a state, as are the start of a text and the root. A pair of the training texts is an arc of its first word's state, weighted by the logarithm of
its smoothed probability; a word without an arc follows the state's failure arc, of weight ``log10(D T(v) / c(v))``, to the root, where every word has an arc. One traversal from left to
right carries the state, which after each word is that word's own or else the root, and adds up the weights.

**Tables.** Texts are packed into blocks of :data:`BLOCK` bytes. A block numbers its words and asks for the different ones, and then for its different pairs, in one message per *part*; the messages hold what the block
counted too, so one shuffle both counts and asks. A part adds up its share of all words or pairs, by a digest of them, and answers each block in the order of its questions. A frequent word or pair
is one number in each message. Parts and blocks hold a fixed amount, so their number grows with the input; nothing of the tables reaches the driver but their sums.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treadline.llm.common import delete, written

#: Bytes of text in a block, and bytes of text whose words and pairs a part has, on average.
BLOCK, PART = 1 << 23, 1 << 24
#: The end of a text among the words; no word is a space. The start of a text among their numbers; words count from 1.
END, START = b" ", 0
#: The discount where no pair occurs once.
PLAIN_DISCOUNT = 0.5
_SPACE = re.compile(rb"[\x09-\x0D ]")
_SCHEMA = "kind int, block bigint, part int, a binary, b binary, sums array<bigint>"
BODY, ASK, TELL, ANSWER, SUMS = range(5)


def learned_from(id_col: str) -> Column:
    """Whether the rest of the CRC-32 of the id, written as text, by 7 is not 2; null where the id is."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 7 != 2


def words_of(text: str, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece. Bytes are lower-cased and split at the contract's letters and spaces only."""
    data, at = text.encode(), 0
    while at < len(data):
        end = at + piece
        space = _SPACE.search(data, end) if end < len(data) else None
        end = space.start() if space else len(data)
        yield data[at:end].lower().split()
        at = end


def pack(*arrays: np.ndarray) -> bytes:
    """Non-negative whole numbers, as planes of bytes that compress well."""
    out = []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        planes = max(1, (top.bit_length() + 7) // 8)
        out.append(np.array([len(a), planes], "<i8").tobytes() + a.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), []
    while len(raw):
        n, planes = (int(x) for x in raw[:16].view("<i8"))
        a = np.zeros((n, 8), np.uint8)
        a[:, :planes] = raw[16:16 + n * planes].reshape(planes, n).T
        out.append(a.view("<i8").reshape(-1))
        raw = raw[16 + n * planes:]
    return out


def steps(codes: np.ndarray) -> np.ndarray:
    """Rising numbers as their differences; ``np.cumsum`` takes them back."""
    return np.diff(codes, prepend=0)


def part_of(codes: np.ndarray, parts: int) -> np.ndarray:
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def _rows(kind: int, block: int | None, rows: list[tuple]) -> list[tuple]:
    return [(kind, block, part, a, b, None) for part, a, b in rows]


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["kind", "block", "part", "a", "b", "sums"])


def _by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each part that has any, in their own order."""
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if edges[p] < edges[p + 1]:
            yield p, order[edges[p]:edges[p + 1]]


class _Words(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i


def _pack_blocks(parts: int, size: int):
    """Texts to blocks: a body each, and its words with their training counts in a message per part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, learned, texts, words, held = [], [], [], _Words(), 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts], np.int64)
            tokens = np.concatenate(texts)
            counts = np.bincount(tokens[np.repeat(np.array(learned, bool), lengths)], minlength=len(words))
            spelled = list(words)
            part = np.array([zlib.crc32(w) % parts for w in spelled], np.int64)
            table = pa.table([pa.chunked_array(ids), pa.array(learned, pa.bool_())], names=["id", "learned"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            asks = [(p, zstandard.ZstdCompressor(level=1).compress(b"\n".join([spelled[i] for i in at])), pack(counts[at])) for p, at in _by_part(part, parts)]
            rows = [(BODY, block, -1, sink.getvalue().to_pybytes(), pack(lengths, tokens, part), None), *_rows(ASK, block, asks)]
            return _table(rows).combine_chunks().to_batches()[0]

        for batch in batches:
            start = 0
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                pieces = [np.fromiter(map(words.__getitem__, piece), np.int32, len(piece)) for piece in words_of(text)]
                texts.append(np.concatenate([*pieces, np.array([words[END]], np.int32)]))
                learned.append(bool(batch.column(2)[i].as_py()))
                held += len(text)
                if held >= size:
                    ids.append(batch.column(0).slice(start, i + 1 - start))
                    yield flush()
                    ids, learned, texts, words, held = [], [], [], _Words(), 0
                    start, block = i + 1, block + 1
            if start < batch.num_rows:
                ids.append(batch.column(0).slice(start))
        if texts:
            yield flush()
    return run


def _add_words(parts: int):
    """One part: number its words, frequent ones first, and answer with numbers and counts."""
    def run(asked: pa.Table) -> pa.Table:
        part, words, lists, counts = asked["part"][0].as_py(), _Words(), [], []
        for a, b in zip(asked["a"], asked["b"]):
            spelled = zstandard.ZstdDecompressor().decompress(a.as_py()).split(b"\n")
            lists.append(np.fromiter(map(words.__getitem__, spelled), np.int64, len(spelled)))
            counts.append(unpack(b.as_py())[0])
        total = np.bincount(np.concatenate(lists), np.concatenate(counts), len(words)).astype(np.int64)
        spelled = list(words)
        number = np.empty(len(words), np.int64)
        number[sorted(range(len(words)), key=lambda i: (-total[i], spelled[i]))] = 1 + part + parts * np.arange(len(words))
        if number.max() >= 1 << 31:
            raise ValueError("more words than 31-bit numbers; use larger parts")
        rows = [(ANSWER, block, part, pack(number[own], total[own]), None, None) for block, own in zip(asked["block"].to_pylist(), lists)]
        rows.append((SUMS, None, part, None, None, [int(total.sum()), int((total > 0).sum()), int(total[words[END]]) if END in words else 0]))
        return _table(rows)
    return run


class Sums:
    """What is known of the training texts as a whole: tokens ``n``, different ones ``v``, ``texts``, and the ``discount``."""

    def __init__(self, n: int, v: int, texts: int) -> None:
        self.n, self.v, self.texts, self.discount = n, v, texts, PLAIN_DISCOUNT

    def root(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.n + self.v + 1)


def _pairs(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each token with the one before it, ``START`` before the first of a text."""
    before = np.roll(tokens, 1)
    before[np.cumsum(lengths) - lengths] = START
    return before << 32 | tokens


def _ask_pairs(parts: int, sums: Sums):
    """A block that knows its words: the base score of each text, and questions about its words as states and about its pairs."""
    def run(body: pa.Table, answers: pa.Table) -> pa.Table:
        block = body["block"][0].as_py()
        texts = pa.ipc.open_stream(body["a"][0].as_py()).read_all()
        lengths, tokens, part = unpack(body["b"][0].as_py())
        number, counts = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        places = dict(_by_part(part, parts))
        for p, a in zip(answers["part"].to_pylist(), answers["a"]):
            number[places[p]], counts[places[p]] = unpack(a.as_py())
        # Words in the order of their numbers, from 1; 0 is the start.
        order = np.argsort(number)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        tokens, number, counts = rank[tokens], np.concatenate([[START], number[order]]), np.concatenate([[sums.texts], counts[order]])
        first = np.cumsum(lengths) - lengths
        texts = texts.append_column("n_tokens", pa.array(lengths)).append_column("n_known", pa.array(np.add.reduceat((counts[tokens] > 0).astype(np.int64), first)))
        texts = texts.append_column("base_score", pa.array(np.add.reduceat(np.log10(sums.root(counts))[tokens], first)))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, texts.schema) as out:
            out.write_table(texts)
        codes, at = np.unique(_pairs(tokens, lengths), return_inverse=True)
        learned = np.repeat(texts["learned"].to_numpy(), lengths).astype(float)
        pairs = np.bincount(at, learned, len(codes)).astype(np.int64)
        codes = number[codes >> 32] << 32 | number[codes & 0xFFFFFFFF]
        states = [(p, pack(steps(number[own])), None) for p, own in _by_part(number % parts, parts)]
        arcs = [(p, pack(steps(codes[own]), pairs[own]), None) for p, own in _by_part(part_of(codes, parts), parts)]
        return _table([(BODY, block, -1, sink.getvalue().to_pybytes(), pack(lengths, tokens, steps(number), counts), None), *_rows(ASK, block, arcs), *_rows(TELL, block, states)])
    return run


def _add_pairs(parts: int):
    """One part: add up its pairs, answer with their counts, and tell each state's part how many different words follow it here."""
    def run(asked: pa.Table) -> pa.Table:
        part, lists = asked["part"][0].as_py(), [unpack(a.as_py()) for a in asked["a"]]
        codes, at = np.unique(np.concatenate([np.cumsum(d) for d, _ in lists]), return_inverse=True)
        total = np.bincount(at, np.concatenate([n for _, n in lists]), len(codes)).astype(np.int64)
        edges = np.cumsum([len(d) for d, _ in lists])[:-1]
        rows = [(ANSWER, block, part, pack(total[own]), None, None) for block, own in zip(asked["block"].to_pylist(), np.split(at, edges))]
        states, follow = np.unique(codes[total > 0] >> 32, return_counts=True)
        rows += [(TELL, None, p, pack(steps(states[own]), follow[own]), None, None) for p, own in _by_part(states % parts, parts)]
        rows.append((SUMS, None, part, None, None, [int((total == 1).sum()), int((total == 2).sum())]))
        return _table(rows)
    return run


def _add_states(told: pa.Table) -> pa.Table:
    """One part: add up what follows its states, and answer the blocks that asked."""
    part, blocks, lists = told["part"][0].as_py(), told["block"].to_pylist(), [unpack(a.as_py()) for a in told["a"]]
    known = [(np.cumsum(x[0]), x[1]) for block, x in zip(blocks, lists) if block is None]
    states, at = np.unique(np.concatenate([s for s, _ in known] or [np.zeros(0, np.int64)]), return_inverse=True)
    follow = np.bincount(at, np.concatenate([n for _, n in known] or [np.zeros(0)]), len(states)).astype(np.int64)
    follow, states = np.append(follow, 0), np.append(states, np.iinfo(np.int64).max)
    rows = []
    for block, x in zip(blocks, lists):
        if block is not None:
            own = np.cumsum(x[0])
            i = np.searchsorted(states, own)
            rows.append((TELL, block, part, pack(np.where(states[i] == own, follow[i], 0)), None, None))
    return _table(rows)


class Automaton:
    """States, arcs and failure arcs for the words and pairs that a block of texts can meet."""

    def __init__(self, sums: Sums, pairs: np.ndarray, times: np.ndarray, counts: np.ndarray, follow: np.ndarray) -> None:
        """``pairs`` are the codes of state and word, ``times`` their counts; ``counts`` and ``follow`` belong to each word as a word and as a state."""
        known = (counts > 0) & (follow > 0)
        kept, backoff = np.maximum(counts, 1), np.where(known, sums.discount * follow / np.maximum(counts, 1), 1.0)
        v, w = pairs >> 32, pairs & 0xFFFFFFFF
        root = sums.root(counts)
        #: Weights of the arcs, nan where the state has none; of the failure arcs, 0 where the word is no state and the root is carried; of the root's arcs.
        with np.errstate(divide="ignore", invalid="ignore"):
            self.arc = np.where(times > 0, np.log10((times - sums.discount) / kept[v] + backoff[v] * root[w]), np.nan)
        self.failure, self.root = np.log10(backoff), np.log10(root)

    @staticmethod
    def traverse(arcs: list[float], failures: list[float], roots: list[float]) -> float:
        """Sum of the weights along a text; the lists have, for each token, the arc, failure arc and root arc that the carried state offers."""
        total = 0.0
        for arc, failure, root in zip(arcs, failures, roots):
            total += arc if arc == arc else failure + root
        return total


def _score(parts: int, sums: Sums):
    """A block with all answers: build its automaton and traverse each text."""
    def run(body: pa.Table, answers: pa.Table) -> pa.Table:
        texts = pa.ipc.open_stream(body["a"][0].as_py()).read_all()
        lengths, tokens, number, counts = unpack(body["b"][0].as_py())
        number = np.cumsum(number)
        codes, at = np.unique(_pairs(tokens, lengths), return_inverse=True)
        shared = number[codes >> 32] << 32 | number[codes & 0xFFFFFFFF]
        arcs, states = dict(_by_part(part_of(shared, parts), parts)), dict(_by_part(number % parts, parts))
        times, follow = np.zeros(len(codes), np.int64), np.zeros(len(number), np.int64)
        for kind, p, a in zip(answers["kind"].to_pylist(), answers["part"].to_pylist(), answers["a"]):
            (times if kind == ANSWER else follow)[(arcs if kind == ANSWER else states)[p]] = unpack(a.as_py())[0]
        model = Automaton(sums, codes, times, counts, follow)
        scores, first = [], 0
        for n in lengths.tolist():
            own = slice(first, first + n)
            scores.append(model.traverse(model.arc[at[own]].tolist(), model.failure[codes[at[own]] >> 32].tolist(), model.root[tokens[own]].tolist()))
            first += n
        return texts.drop_columns(["learned"]).append_column("score", pa.array(scores, pa.float64()))
    return run


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", learned: Column | None = None, block: int = BLOCK, part: int = PART) -> DataFrame:
    """One row per row of ``df``: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    The model is learned from the rows for which ``learned`` holds (null: not), all rows are scored. Null and empty texts are their end alone; texts of any length are read whole; repeated rows count again and
    get equal scores; a null id is scored, and neither learned from nor held out. Without rows to learn from, every token is unknown. An empty table gives no rows. Only id and text are read, and columns of other names may be called anything.
    """
    spark, id_kind = df.sparkSession, dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("content"), (learned_from(id_col) if learned is None else learned).alias("learned"))
    parts = 1 + (rows.agg(F.sum(F.length("content"))).first()[0] or 0) // part

    def kind(table: DataFrame, k: int) -> DataFrame:
        return table.where(F.col("kind") == k)

    packed, packed_at = written(rows.mapInArrow(_pack_blocks(parts, block), _SCHEMA), "kind")
    words, words_at = written(kind(packed, ASK).groupBy("part").applyInArrow(_add_words(parts), _SCHEMA), "kind")
    sums = Sums(*[x or 0 for x in kind(words, SUMS).agg(*[F.sum(F.col("sums")[i]) for i in range(3)]).first()])
    asking = kind(packed, BODY).groupBy("block").cogroup(kind(words, ANSWER).groupBy("block")).applyInArrow(_ask_pairs(parts, sums), _SCHEMA)
    asked, _ = written(asking, "kind")
    delete(spark, packed_at)
    delete(spark, words_at)
    pairs, _ = written(kind(asked, ASK).groupBy("part").applyInArrow(_add_pairs(parts), _SCHEMA), "kind")
    once, twice = (x or 0 for x in kind(pairs, SUMS).agg(*[F.sum(F.col("sums")[i]) for i in range(2)]).first())
    sums.discount = once / (once + 2 * twice) if once else PLAIN_DISCOUNT
    states = kind(asked, TELL).unionByName(kind(pairs, TELL)).groupBy("part").applyInArrow(_add_states, _SCHEMA)
    answers = kind(pairs, ANSWER).unionByName(states)
    scored = kind(asked, BODY).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(parts, sums), f"id {id_kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    held = F.coalesce(~learned_from("id"), F.lit(False)) if learned is None else F.lit(None).cast("boolean")
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "n_tokens", "n_known", F.lit(sums.n).cast("long").alias("train_tokens"), "base_score", "score")
