"""Spelling variants: words one edit apart, found by an index of variable-length grams, and the usual form of each.

**Dictionary.** Grams have :data:`SHORTEST` to :data:`LONGEST` letters. All shortest grams are in it, longer ones only where the gram that they extend is *frequent*:
at more than one in :data:`SHARE` of all places. So at most ``SHARE`` grams of each length are frequent, whatever the words, and only those travel to the tasks.

**Decomposition.** A word, between two marks for its ends, gives at each place the longest gram of the dictionary that starts there, unless it lies within the gram before.
Whether a gram is taken depends on its own letters, and on whether an earlier one covers it.

**Affected grams.** An edit at a place can only change grams that contain the place, or that lie right of it within reach of a changed one: those that end at most ``LONGEST`` letters
behind it. The others are the same in both words. So the bound of a place is a number of grams kept on the left and one on the right, and words that
differ there are in the lists of all of these. The lists of a place are merged at once: the key of a row of the index is the digest of all grams that the place doesn't affect, and
of how many letters remain, and a join on it gives the candidates. Digests that collide only add candidates; each candidate is verified by its edit distance.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treadline.session import materialise

SHORTEST, LONGEST, SHARE = 2, 3, 4096
LEAST_LETTERS, LEAST_N, OFTEN = 7, 2, 10
#: Places up to here have lists of their own; later ones share them in doubling ranges, which changes the number of candidates and no result.
PLACES = 48
#: The letters that a run consists of; fixed by the contract.
LETTERS = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS) -> DataFrame:
    """``word`` and ``n`` of all results of the runs of letters of ``df``, a letter deleted in those that the digest of id and run picks.

    Null texts have no runs; a null id is written as nothing. Counts are summed map-side, so a frequent word is a row per task.
    """
    # A run below the least length can't give a word: deletion only shortens it.
    runs = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
                     F.explode(F.expr(f"regexp_extract_all(`{text_col}`, '[{LETTERS}]{{{least},}}', 0)")).alias("_run"))
    runs = runs.withColumn("_run", F.translate("_run", _UPPER, _LOWER))
    runs = runs.withColumn("_h", F.crc32(F.encode(F.concat("_id", F.lit(":"), "_run"), "UTF-8")))
    at = (F.col("_h") % F.length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    word = F.when(F.col("_h") % 31 == 0, cut).otherwise(F.col("_run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def marked(word: str) -> str:
    return f"^{word}$"


def frequent_grams(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, share: int = SHARE) -> frozenset[str]:
    """The frequent grams of each length below ``longest``: at most ``share`` a length."""
    found: set[str] = set()
    places = words.agg(F.sum(F.length("word") + 2)).first()[0] or 0
    for length in range(shortest, longest):
        known, first = frozenset(found), length == shortest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts: Counter[str] = Counter()
                for word in batch.column(0).to_pylist():
                    s = marked(word)
                    counts.update(g for g in (s[i:i + length] for i in range(len(s) - length + 1)) if first or g[:-1] in known)
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["gram", "n"])

        grams = words.select("word").mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
        found |= {r.gram for r in grams.where(F.col("n") * share > places).select("gram").collect()}
    return frozenset(found)


def decompose(word: str, frequent: frozenset[str], shortest: int = SHORTEST, longest: int = LONGEST) -> list[tuple[int, int]]:
    """Start and end of each variable gram of the marked word; both rise strictly."""
    s, out, last = marked(word), [], 0
    for start in range(len(s) - shortest + 1):
        end = start + shortest
        while end < len(s) and end - start < longest and s[start:end] in frequent:
            end += 1
        if end > last:
            out.append((start, end))
            last = end
    return out


def place_ranges(top: int) -> Iterator[tuple[int, int]]:
    """The places 1 to ``top``, first and last: one by one up to :data:`PLACES`, then in ranges that double, so that a very long word has few keys. They don't depend on ``top``, but for the end."""
    first = 1
    while first <= top:
        last = min(first if first <= PLACES else 2 * first - 1, top)
        yield first, last
        first = last + 1


def unaffected(grams: list[tuple[int, int]], letters: int, longest: int = LONGEST) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
    """How many grams on the left, and from which on to the right, an edit in a range of places leaves alone: one pair for each range of letters that can go, one for each of gaps that a letter can fill.

    Letters of the marked word are 1 to ``letters``, and gap ``g`` is before letter ``g``.
    """
    def kept(gap: int) -> set[tuple[int, int]]:
        out, left, right, end = set(), 0, 0, len(grams)
        for first, last in place_ranges(letters + gap):
            # Both sides move right with the place, since starts and ends of grams rise.
            while left < end and grams[left][1] <= first:
                left += 1
            while right < end and (grams[right][1] <= last + longest - gap or grams[right][0] <= last - gap):
                right += 1
            out.add((left, right))
        return out

    return kept(0), kept(1)


def index_keys(word: str, frequent: frozenset[str], shortest: int = SHORTEST, longest: int = LONGEST) -> list[tuple[int, bool]]:
    """The keys of a word in the index, and whether each is about a gap."""
    s, grams = marked(word), decompose(word, frequent, shortest, longest)
    # Grams are joined by a mark that no word has.
    spelled, out = [s[a:b] for a, b in grams], []
    for gap, pairs in enumerate(unaffected(grams, len(word), longest)):
        for left, right in pairs:
            key = f"{len(word) - 1 + gap} {'|'.join(spelled[:left])} {'|'.join(spelled[right:])}"
            out.append((xxhash.xxh64_intdigest(key.encode()) - (1 << 63), bool(gap)))
    return out


def gram_index(words: DataFrame, frequent: frozenset[str], shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """A row for each word and merged list: ``key``, ``gap``, ``word``, ``n``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, gaps, rows = [], [], []
            for row, word in enumerate(batch.column(0).to_pylist()):
                for key, gap in index_keys(word, frequent, shortest, longest):
                    keys.append(key)
                    gaps.append(gap)
                    rows.append(row)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(gaps, pa.bool_()), batch.column(0).take(at), batch.column(1).take(at)],
                                             ["key", "gap", "word", "n"])
    return words.select("word", "n").mapInArrow(run, "key bigint, gap boolean, word string, n bigint")


def near_words(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, share: int = SHARE) -> DataFrame:
    """``word``, ``near`` and ``near_n`` for each ordered pair of words exactly one edit apart, once."""
    index = gram_index(words, frequent_grams(words, shortest, longest, share), shortest, longest)
    one, other = index.where(~F.col("gap")).drop("gap").alias("a"), index.alias("b")
    # A letter replaced is a letter that goes in both; a letter inserted is one that goes in the longer word and a gap of the shorter.
    pairs = one.join(other, F.expr("a.key = b.key AND (b.gap OR a.word < b.word) AND levenshtein(a.word, b.word, 1) = 1"))
    sides = F.array(*[F.struct(F.col(f"{x}.word").alias("word"), F.col(f"{y}.word").alias("near"), F.col(f"{y}.n").alias("near_n")) for x, y in ("ab", "ba")])
    return pairs.select(F.explode(sides).alias("p")).select("p.*").groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def _roots(links: DataFrame) -> DataFrame:
    """``word`` and ``root`` for the words with a form. A form is at least :data:`OFTEN` times as frequent as its word, so chains are short; each round doubles the reach."""
    links = materialise(links.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        longer = materialise(links.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        if longer.where("moved").isEmpty():
            return longer.drop("moved")
        links = longer.drop("moved")


def variant_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS, least_n: int = LEAST_N, often: int = OFTEN,
                   shortest: int = SHORTEST, longest: int = LONGEST, share: int = SHARE) -> DataFrame:
    """One row per word of at least ``least`` letters that occurs ``least_n`` times: ``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``.

    ``form`` is the near word of largest ``n``, of equal ones the smallest in code-point order, if that is ``often`` times the word's own ``n``; ``root`` follows
    forms to the last, and is the word itself if it has none. Null and empty texts and those without letters have no words, null ids are read as empty, repeated rows count again, texts of any
    length are read whole, and an empty table gives no rows. Only id and text are read, whatever the other columns are called.
    Words are short here; with ``least`` below ``longest`` some edits leave no gram alone, and then all words of a length share a key.
    """
    words = materialise(words_of(df, id_col, text_col, least).where(F.col("n") >= least_n))
    # Of equal counts the smaller word: strings compare by their bytes, which is the order of code points.
    best = near_words(words, shortest, longest, share).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    usual = -F.col("best.less") >= F.col("n") * often
    found = materialise(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(usual, F.col("best.near")).alias("form"),
                                     F.when(usual, -F.col("best.less")).alias("form_n")))
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
