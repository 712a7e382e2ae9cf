"""Token ids in binary shards with a minimal perfect hash index.

A shard is a pair of files. ``NNNNN.ids`` holds the ids of its documents end to end, as raw little-endian unsigned integers of 2 bytes, or 4 if the vocabulary
needs them. ``NNNNN.mph`` maps a document key to its place there in constant time and without storing keys: a header of six 64-bit integers
(magic, keys, buckets, seed, bytes per id, tokens), then per bucket one signed 64-bit displacement, then per slot a 32-bit fingerprint of the key,
the 64-bit start in tokens, and the 64-bit length.
"""
from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treadline.llm.common import new_folder, partitions, worker_cache
from treadline.session import materialise

MAGIC = 0x314449544C4D50
PER_BUCKET = 4
_ODD_SPACE = re.compile("[\x1c-\x1f]")
LONGEST_KEPT, WORDS = 48, 1 << 19
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def key_hashes(ids: np.ndarray, nth: np.ndarray, null: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of document id, its number among rows of that id, and whether the id is null."""
    x = _mix(np.where(null, 0, ids).astype(np.int64).view(np.uint64) ^ np.uint64(seed))
    return _mix(x ^ _mix(nth.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64)))


def _slots(h: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    return (_mix(h ^ _mix(pilots.astype(np.uint64))) % np.uint64(n)).astype(np.int64)


def build_index(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements per bucket and the slot of each key: a bijection onto ``0 .. n-1``.

    Buckets are placed by falling size; a displacement is the first number that sends all keys of a bucket to free slots. The last
    buckets have one key each and take any free slot, stored as a negative number.
    """
    n = len(hashes)
    buckets = max(1, -(-n // PER_BUCKET))
    of = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=buckets)
    firsts = np.cumsum(sizes) - sizes
    taken, slot, shift = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(buckets, np.int64)
    by_size = np.argsort(-sizes, kind="stable")
    for b in by_size[: int((sizes > 1).sum())]:
        keys = order[firsts[b]: firsts[b] + sizes[b]]
        at, step = 0, 8
        while True:
            tries = np.arange(at, at + step)
            where = _slots(hashes[keys][None, :], tries[:, None], n)
            fine = ~taken[where].any(axis=1)
            for t in np.flatnonzero(fine):
                if len(set(where[t].tolist())) == len(keys):
                    break
            else:
                at, step = at + step, min(step * 2, 4096)
                continue
            shift[b], slot[keys], taken[where[t]] = tries[t], where[t], True
            break
    ones = by_size[int((sizes > 1).sum()): int((sizes > 0).sum())]
    free = np.flatnonzero(~taken)
    shift[ones] = -free - 1
    slot[order[firsts[ones]]] = free
    return shift, slot


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri)


class LibraryEncoder:
    """The tokenizers library, asked once per run of text without white space: such runs are encoded apart, so short ones are kept."""

    def __init__(self, path: str, width: int) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind, self.letter = f"<u{width}", "H" if width == 2 else "I"
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if _ODD_SPACE.search(text):  # white space to Python, letters to the library
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        chunks = text.split()
        kept = self.kept
        missing = {c for c in chunks if c not in kept}
        if missing:
            made = {c: self.older[c] for c in missing if c in self.older}
            new = [c for c in missing if c not in made]
            for c, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False) if new else ()):
                ids = e.ids
                made[c] = struct.pack(f"<{len(ids)}{self.letter}", *ids)
            if len(kept) + len(missing) > WORDS:
                # The full table becomes the older one; this text's runs go on in the new one.
                self.older, self.kept = kept, {c: kept[c] for c in chunks if c in kept}
                kept = self.kept
            kept.update(made)
        out = b"".join([kept[c] for c in chunks])
        for c in missing:
            if len(c) > LONGEST_KEPT:
                del kept[c]
        return out


def write_shards(df: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``df`` in ascending id order to shards in ``folder``; returns one row per shard: number, first and last id, documents, tokens.

    Rows are range-partitioned by id and sorted; a task writes one shard under a name of its own and renames it when it is whole, so a repeated or lost
    task leaves the same files. Texts pass one batch at a time; a shard's index needs about 40 bytes a document. Null ids
    come first, rows of one id side by side; null and empty texts have the end id only. The number of shards is that of shuffle partitions.
    """
    from tokenizers import Tokenizer
    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    kind = f"<u{width}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext
        task = TaskContext.get()
        encoder = worker_cache(("library", tokenizer, width), lambda: LibraryEncoder(tokenizer, width))
        end = np.array([end_id], kind).tobytes()
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        name = f"{base}/{task.partitionId():05d}"
        own = f"{name}.{task.taskAttemptId()}"
        ids, nulls, lengths = [], [], []
        with fs.open_output_stream(f"{own}.ids") as out:
            for batch in batches:
                keys = batch.column(0)
                nulls.append(np.array(keys.is_null()))
                ids.append(keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                for text in batch.column(1):
                    data = encoder.encode(text.as_py() or "") + end
                    lengths.append(len(data) // width)
                    out.write(data)
        if not lengths:
            fs.delete_file(f"{own}.ids")
            return
        key, null, length = np.concatenate(ids), np.concatenate(nulls), np.array(lengths, np.int64)
        change = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (null[1:] != null[:-1])]))
        nth = np.arange(len(key)) - np.repeat(change, np.diff(np.append(change, len(key))))
        seed = 1
        while len(np.unique(hashes := key_hashes(key, nth, null, seed))) < len(key):
            seed += 1
        shift, slot = build_index(hashes)
        start = np.cumsum(length) - length
        columns = [np.zeros(len(key), t) for t in ("<u4", "<i8", "<i8")]
        for column, value in zip(columns, ((hashes >> np.uint64(32)).astype("<u4"), start, length)):
            column[slot] = value
        with fs.open_output_stream(f"{own}.mph") as out:
            out.write(np.array([MAGIC, len(key), len(shift), seed, width, int(length.sum())], "<i8").tobytes())
            out.write(shift.astype("<i8").tobytes())
            for column in columns:
                out.write(column.tobytes())
        for kind_of in ("ids", "mph"):
            fs.move(f"{own}.{kind_of}", f"{name}.{kind_of}")
        yield pa.RecordBatch.from_arrays(
            [pa.array([task.partitionId()], pa.int32()), pa.array([None if null[0] else int(key[0])], pa.int64()),
             pa.array([None if null[-1] else int(key[-1])], pa.int64()), pa.array([len(key)], pa.int64()), pa.array([int(length.sum())], pa.int64())],
            ["shard", "first_id", "last_id", "documents", "tokens"])

    by_id = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("content"))
    ranged = by_id.repartitionByRange(partitions(df.sparkSession), "id").sortWithinPartitions("id", "content")
    # Written, so that the files are not made again when the rows are read twice.
    return materialise(ranged.mapInArrow(write, "shard int, first_id bigint, last_id bigint, documents bigint, tokens bigint"))


class Shard:
    """A shard opened for keyed reads."""

    def __init__(self, folder: str, number: int) -> None:
        fs, base = _filesystem(folder)
        with fs.open_input_file(f"{base}/{number:05d}.mph") as f:
            data = f.read()
        magic, self.n, buckets, self.seed, self.width, self.tokens = (int(x) for x in np.frombuffer(data, "<i8", 6))
        if magic != MAGIC:
            raise ValueError(f"shard {number}: not an index of token ids")
        at = 48
        self.shift = np.frombuffer(data, "<i8", buckets, at)
        at += 8 * buckets
        self.mark = np.frombuffer(data, "<u4", self.n, at)
        self.start = np.frombuffer(data, "<i8", self.n, at + 4 * self.n)
        self.length = np.frombuffer(data, "<i8", self.n, at + 12 * self.n)
        self.ids = fs.open_input_file(f"{base}/{number:05d}.ids")

    def find(self, ids: np.ndarray, nth: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is there, its start in tokens, and its length. An unknown key passes for known once in 4 billion times."""
        h = key_hashes(ids, nth, null, self.seed)
        shift = self.shift[(h % np.uint64(len(self.shift))).astype(np.int64)]
        slot = np.where(shift < 0, -shift - 1, _slots(h, np.maximum(shift, 0), self.n))
        return self.mark[slot] == (h >> np.uint64(32)).astype("<u4"), self.start[slot], self.length[slot]

    def read(self, start: int, length: int) -> np.ndarray:
        return np.frombuffer(self.ids.read_at(length * self.width, start * self.width), f"<u{self.width}")


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame, keys: DataFrame, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Look up every row of ``keys`` (an id column, repeats allowed): id, ``start`` in the whole corpus, ``n_tokens``, ``ids_crc32``, with ``keep_ids`` the ids.

    Keys are dealt over all shuffle partitions: they are small, but what they fetch is not. The n-th row of an id reads the n-th document of that id. Keys without a document have null results. The manifest has a row per
    shard, so as many as there were shuffle partitions; only it reaches the driver.
    """
    shards = sorted((r.shard, r.first_id, r.last_id, r.tokens) for r in manifest.collect())
    last = np.array([np.iinfo(np.int64).min if s[2] is None else s[2] for s in shards], np.int64)
    before = np.cumsum([0] + [s[3] for s in shards])
    numbers = [s[0] for s in shards]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_now: dict[int, Shard] = {}
        for batch in batches:
            null = np.array(batch.column(0).is_null())
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            nth = batch.column(1).to_numpy(zero_copy_only=False)
            rows = [[None] * len(ids) for _ in range(4)]
            # Null ids come first in the order of the shards.
            at = np.where(null, 0, np.searchsorted(last, ids))
            for k in np.unique(at):
                if k >= len(numbers):
                    continue
                if k not in open_now:
                    open_now.clear()
                    open_now[k] = Shard(folder, numbers[k])
                shard, pick = open_now[k], np.flatnonzero(at == k)
                known, start, length = shard.find(ids[pick], nth[pick], null[pick])
                for i, ok, s, n in zip(pick.tolist(), known.tolist(), start.tolist(), length.tolist()):
                    if ok:
                        data = shard.read(s, n)
                        rows[0][i], rows[1][i] = int(before[k]) + s, n
                        rows[2][i] = zlib.crc32(data.astype("<u4").tobytes())
                        rows[3][i] = data.astype(np.int32) if keep_ids else None
            columns = [batch.column(0), *(pa.array(r, pa.int64()) for r in rows[:3])]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(rows[3], pa.list_(pa.int32()))] if keep_ids else []), names)

    names = [id_col, "start", "n_tokens", "ids_crc32"] + (["ids"] if keep_ids else [])
    per_id = keys.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("copies"))
    each = per_id.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("nth"))
    sorted_keys = each.repartitionByRange(partitions(spark), "id").sortWithinPartitions("id", "nth")
    return sorted_keys.mapInArrow(read, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if keep_ids else ""))


def round_trip(df: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``df`` to shards in the shared folder and read every document back by its key."""
    folder = new_folder(df.sparkSession)
    manifest = write_shards(df, folder, tokenizer, end_id, id_col, text_col)
    return read_documents(df.sparkSession, folder, manifest, df.select(id_col), id_col)
