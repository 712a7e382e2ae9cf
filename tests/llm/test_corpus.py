"""Corpus operators on small inputs, next to plain Python."""
import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from treadline.llm import bpe, exact, mixing, neardup, shards, tokens, topk, toxicity, urls, warc
from treadline.llm.common import permuted

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, id string"
#: Nulls, empty and repeated rows, copies, a long text, special tokens, odd white space; columns named like inner ones.
ROWS = [(1, "a b c d e f g", "en", "s1", 13, "x", "y"), (2, "a b c d e f g", "en", "s2", 13, None, "y"), (3, None, None, None, None, None, None),
        (4, "", "de", "s1", 0, "", ""), (None, "Straße É́ <|endoftext|> 'tis\x1c½", "de", None, 5, "q", "q"), (5, "word " * 3000 + "x" * 5000, "en", "s1", 20000, "x", "x"),
        (6, "same text here", "en", "s3", 14, "r", "r"), (6, "same text here", "en", "s3", 14, "r", "r"), (7, "  \t\n ", "fr", "s2", 5, "r", "r"), (8, "ΣΑΣ ΟΔΟΣ 😀🏳️", "el", "s4", 9, "r", "r")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_exact_groups(docs, none):
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_groups(docs).collect())
    groups, seen, want = collections.defaultdict(list), set(), collections.Counter()
    for r in ROWS:
        groups[r[1] or ""].append(r[0])
    for r in ROWS:
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        kept = r[0] == keep and (r[1] or "") not in seen
        if kept:
            seen.add(r[1] or "")
        want[(r[0], keep, len(ids), kept, hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    assert got == want
    assert exact.drop_copies(docs).columns == docs.columns
    assert exact.exact_groups(none).count() == 0


def test_kept_rows_keep_their_own_columns(spark):
    df = spark.createDataFrame([(1, "a", "mine", 7), (2, "a", "yours", None), (3, None, None, 9)], "doc_id bigint, text string, kept string, group_size int")
    got = exact.drop_copies(df)
    assert got.dtypes == df.dtypes and {tuple(r) for r in got.collect()} == {(2, "a", "yours", None), (3, None, None, 9)}


def test_exact_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    out = exact.exact_groups(df)
    assert out.where("kept").count() == 2001
    assert out.where("text = 'hot'").select("keep_id", "group_size").distinct().collect() == [(2997, 1000)]


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        x = spark.range(n).select(F.col("id"), permuted(F.col("id"), F.lit(n), 5).alias("p"))
        back = x.select("id", "p", permuted(F.col("p"), F.lit(n), 5, inverse=True).alias("q")).collect()
        assert sorted(r.p for r in back) == list(range(n))
        assert all(r.q == r.id for r in back)


def test_shards(docs, none):
    rows = shards.shard_rows(docs, shards=3).collect()
    assert len(rows) == len(ROWS)
    per = collections.defaultdict(list)
    for r in rows:
        per[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in per.values()) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    again = shards.shard_rows(docs, shards=3).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert shards.shard_rows(none).count() == 0
    n = F.lit(len(ROWS))
    df = shards.shard_rows(docs, shards=3, seed=9)
    assert df.where(shards.row_at(F.col("shard"), F.col("slot"), n, 3, 9) != F.col("row_number")).count() == 0


def test_mixture(spark, docs, none):
    rows = mixing.mixed(docs, block=2).collect()
    assert collections.Counter((r.doc_id, r.size) for r in rows) == collections.Counter((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in ROWS)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 4 for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(r.size for r in rows)) < 1e-6
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixing.mixed_texts(docs, block=2).collect())
    assert words == sum(taken.values())
    assert mixing.mixed(none).count() == 0 and mixing.mixed_texts(none).count() == 0


def test_quotas_per_shard(spark):
    targets = spark.createDataFrame([("a", "a", 0, 1000, 700.0), ("b", "b", 1, 500, 333.0), ("c", "c", 2, 90, 64.0)], "key string, source string, rank long, source_size long, target double")
    rows = mixing.block_quotas(targets, block=10, shards=4).collect()
    assert all(sum(r.shard_quotas) == r.seats and max(r.shard_quotas) - min(r.shard_quotas) <= 1 for r in rows)
    sums = [sum(r.shard_quotas[k] for r in rows) for k in range(4)]
    assert max(sums) - min(sums) <= 1
    seats, house = collections.Counter(), sum(r.seats for r in rows)
    for _ in range(house):  # highest quotients, one by one
        seats[max(rows, key=lambda r: r.target / (2 * seats[r.key] + 1)).key] += 1
    assert seats == {r.key: r.seats for r in rows}


def test_encoding_and_decoding(docs, none, library):
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoded(docs, PATH).collect())
    want = collections.Counter()
    for r in ROWS:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[(r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert got == want
    assert bpe.encoded(none, PATH).count() == 0
    kept = {r.doc_id: r.decoded for r in bpe.encoded(docs, PATH, keep_ids=True, piece=3).collect()}
    assert kept[1] == "a b c d e f g "


def test_transducer_equals_the_definition():
    rng = np.random.default_rng(3)
    for _ in range(60):
        letters, vocab, rules = "abc", {}, []
        for c in letters:
            vocab[c], vocab[c + "_"] = len(vocab), len(vocab) + 1
        for _ in range(int(rng.integers(1, 25))):
            left = str(rng.choice([t for t in vocab if not t.endswith("_")]))
            right = str(rng.choice(list(vocab)))
            if left + right not in vocab and len(left + right) <= 8:
                vocab[left + right] = len(vocab)
                rules.append((left, right))
        merges = bpe.Merges(vocab, rules, "_")
        machine = bpe.Transducer(merges)
        for window in (1, 4, merges.lookahead + 8):
            machine.window = window
            word = "".join(rng.choice(list(letters), 120))
            assert np.frombuffer(machine.word(word.encode()), "<u4").tolist() == merges.merge(word[:-1] + chr(256 + ord(word[-1])))


def test_pieces_of_texts_and_forgotten_states(library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 7)
    monkeypatch.setattr(bpe, "STATES", 40)
    encoder = bpe.Encoder(PATH)
    rng = np.random.default_rng(5)
    alphabet = list("aabcdeeinorst") + list(" \t\u00a0\u0085\x1c'.,!7") + ["\u00e9", "e\u0301", "\u03a3", "\u0130", "\u6f22", "\U0001f600", "<|endoftext|>", "'ll", "\ud55c", "\u1112\u1161"]
    for n in [0, 1, 2, 5, *rng.integers(5, 400, 300).tolist()]:
        text = "".join(rng.choice(alphabet, n))
        parts = list(encoder.pieces(text))
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    for run in ("ab" * 3000, "\u00e9lan" * 900, "x" * 5000 + " y " + "'s" * 2000):
        assert np.frombuffer(encoder.encode(run), "<u4").tolist() == library.encode(run, add_special_tokens=False).ids
    assert len(encoder.transducer.states) <= 40 and 0 < encoder.transducer.most_kept <= 2 * encoder.transducer.window + 1


def test_token_shards(docs, none, library):
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.round_trip(docs, PATH).collect())
    want, at = [], 0
    for r in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((at, r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert tokens.round_trip(none, PATH).count() == 0


def test_full_tables_are_turned_over(library, monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 5)
    encoder = tokens.LibraryEncoder(PATH, 2)
    for text in ["a b c", "c d e f", "a g h i j k l m", "b c a x", "n o p", "a b " + "z" * 60, "q r s a b c d " + "z" * 60] * 3:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_index_is_minimal_and_perfect():
    for n in (1, 2, 5, 100, 5000):
        h = tokens.key_hashes(np.arange(n) * 7, np.zeros(n, np.int64), np.zeros(n, bool), 1)
        _, slot = tokens.build_index(h)
        assert sorted(slot.tolist()) == list(range(n))


def _docs_with_toxic(spark, n=600):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{k}" for k in range(300)]
    rows, marks = [], []
    for i in range(n):
        words = list(rng.choice(vocabulary, 60))
        bad = i % 5 == 0
        if bad:
            for k in rng.choice(60, 5, replace=False):
                words[k] = str(rng.choice(["foul", "vile", "rotten"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, toxic int"), dict(marks)


def test_toxicity(spark, docs, none):
    df, labels, truth = _docs_with_toxic(spark)
    rows = toxicity.scored(df, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.97 * len(out)
    assert toxicity.without_toxic(df, labels).columns == df.columns
    assert toxicity.scored(docs, labels).count() == len(ROWS)
    assert toxicity.scored(none, labels).count() == 0
    assert toxicity.scored(docs, labels.where("toxic = 0")).where("predicted = 1").count() == 0


def _found_toxic(spark, texts, n=600, bad=lambda i: i % 5 == 0):
    """Which held-out documents are predicted toxic, of ``texts(rng, i, bad)``, and which are."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(texts(rng, i, bad(i)))) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(bad(i))) for i in range(n)], "doc_id bigint, toxic int")
    out = toxicity.scored(df, labels).where("held_out").collect()
    return {r.doc_id for r in out if r.predicted}, {r.doc_id for r in out if bad(r.doc_id)}


def _close(found, truth):
    return len(found ^ truth) <= 0.05 * len(truth) + 1


def test_toxic_word_beside_words_of_its_checksum(spark):
    """The low bits of the checksum of a toxic word are those of ordinary words, too."""
    low = lambda w: zlib.crc32(w.encode()) & (1 << 19) - 1
    alike = [w for w in (f"o{k}" for k in range(4_000_000)) if low(w) == low("foul")][:3]

    def texts(rng, i, bad):
        words = [f"w{k}" for k in rng.integers(0, 300, 60)]
        for at in rng.choice(60, 6, replace=False):
            words[at] = "foul" if bad else str(rng.choice(alike))
        return words
    assert _close(*_found_toxic(spark, texts))


def test_toxic_expression_of_ordinary_words(spark):
    def texts(rng, i, bad):
        words = [f"w{k}" for k in rng.integers(0, 100, 60)]
        for at in rng.choice(20, 5, replace=False) * 3:
            words[at:at + 2] = ("go", "die") if bad else ("go", words[at + 1])
        for at in rng.choice(20, 5, replace=False) * 3 if not bad else ():
            words[at:at + 2] = ("let", "die")
        return words
    assert _close(*_found_toxic(spark, texts))


def test_expressions_are_counted_exactly(spark):
    """Texts with each pair and word, and different words before: beyond any fixed counter, and keyed by the words."""
    rng = np.random.default_rng(8)
    rows = [(zlib.compress(" ".join(["x" if k % 2 else f"p{k}" for k in rng.integers(0, 900, 80)]).encode()), int(i % 3 == 0)) for i in range(90)]
    got = {(r.before, r.word): r for r in toxicity.expression_table(spark.createDataFrame(rows, "packed binary, toxic int")).collect()}
    n, begun = collections.Counter(), collections.Counter()
    for packed, k in rows:
        w = zlib.decompress(packed).decode().split()
        n.update({(k, *p) for p in zip(["", *w], w)} | {(k, toxicity.ALONE, x) for x in w})
    before = collections.Counter((k, w) for k, v, w in n if v != toxicity.ALONE)
    for (k, v, _), c in n.items():
        begun[k, v] += c
    assert before[0, "x"] > 251
    assert {(v, w) for _, v, w in n} | {(toxicity.ALONE, "")} == set(got)
    for (v, w), r in got.items():
        assert (r.n0, r.n1) == (n[0, v, w], n[1, v, w])
        if v == toxicity.ALONE:
            assert (r.d0, r.d1, r.a0, r.a1) == (before[0, w], before[1, w], begun[0, w], begun[1, w])


def test_rare_words_and_words_after_one_word(spark):
    def texts(rng, i, bad):
        words = [f"w{k}" for k in rng.integers(0, 100, 60)]
        for at in rng.choice(20, 4, replace=False) * 3:
            words[at:at + 2] = ("you", "slur") if bad else ("you", words[at + 1])
        return words
    assert _close(*_found_toxic(spark, texts))
    total = np.array([[9000.0], [1000.0]])

    def ratio(texts, before, pair):
        counts = [np.array([[0.0], [float(x)]]) for x in (texts, before, pair)]
        return float(toxicity._ratios(total, counts[0], counts[1], np.array([[90.0], [10.0]]), counts[2])[0])
    steps = [ratio(k, k, 0) for k in range(7)]
    assert steps[0] == pytest.approx(0, abs=1e-9) and all(0 < b - a < 0.5 for a, b in zip(steps, steps[1:]))
    assert ratio(1, 1, 1) > ratio(1, 1, 0) and ratio(1000, 1, 1000) > 2


def _plain_evidence(text, training):
    """The evidence of a text by the formulas of the module, from dictionaries of all training texts."""
    n, before, begun = collections.Counter(), collections.defaultdict(set), collections.Counter()
    for other, k in training:
        w = other.split()
        for pair in set(zip(["", *w], w)):
            n[k, pair] += 1
            before[k, pair[1]].add(pair[0])
            begun[k, pair[0]] += 1
        n.update((k, x) for x in set(w))
    least = lambda k, w: min(n[k, w], len(before[k, w]))
    total = [sum(least(k, w) for w in {x for t, _ in training for x in t.split()}) for k in (0, 1)]
    share = [t / sum(total) for t in total]

    def level(counts):
        freed = min(toxicity.DISCOUNT, sum(counts))
        return [c * (1 - freed / max(sum(counts), 1)) for c in counts], toxicity.KAPPA + freed
    words, out = text.split(), []
    for i, (v, w) in enumerate(zip(["", *words], words)):
        own, mass = level([least(k, w) for k in (0, 1)])
        after = [begun[k, v] + share[k] * toxicity.KAPPA for k in (0, 1)]
        expected = [after[k] * (own[k] + share[k] * mass) / total[k] for k in (0, 1)]
        own, mass = level([n[k, (v, w)] for k in (0, 1)])
        p = [(own[k] + expected[k] / sum(expected) * mass) / after[k] for k in (0, 1)]
        out.append(0 if w in words[max(0, i - toxicity.PASSAGE):i] else np.log(p[1] / p[0]))
    if len(out) <= toxicity.PASSAGE:
        return sum(out) / max(len(out), toxicity.LEAST) if out else 0
    return max(sum(out[i:i + toxicity.PASSAGE]) for i in range(len(out) - toxicity.PASSAGE + 1)) / toxicity.PASSAGE


def test_evidence_is_that_of_plain_counts(spark):
    """Known and unknown words and pairs, repeated words, texts shorter and longer than a passage; and each training text left out of its own counts."""
    rng = np.random.default_rng(9)
    text = lambda size, top: " ".join(f"w{k}" for k in rng.integers(0, top, size))
    training = [(text(int(rng.integers(1, 70)), 40), int(i % 4 == 0)) for i in range(60)]
    rows = [(zlib.compress(t.encode()), k) for t, k in training]
    labelled = spark.createDataFrame(rows, "packed binary, toxic int")
    model = toxicity.Model(toxicity.expression_table(labelled), np.ones(2))
    asked = [text(int(size), 60) for size in rng.integers(0, 90, 30)] + ["", "none of these"]
    got = toxicity._evidence(spark.createDataFrame(list(enumerate(asked)), "id int, content string"), model, "id").collect()
    assert len(got) == len(asked)
    for r in got:
        assert r.evidence == pytest.approx(_plain_evidence(asked[r.id], training), abs=1e-9)


def test_fit_is_bounded_and_weighted(spark):
    df, labels, truth = _docs_with_toxic(spark)
    df = df.union(spark.createDataFrame([(1001, "foul " * 5000)], df.schema))
    labels = labels.union(spark.createDataFrame([(1001, 1), (2000, 0)], labels.schema))
    train = {k: {i for i, t in truth.items() if t == k and zlib.crc32(str(i).encode()) % 5} for k in (0, 1)}
    own = {0: len(train[0]), 1: len(train[1]) + 1}
    texts, weights = toxicity.training_texts(df, labels, "doc_id", "text", "toxic", fit_rows=40)
    n = collections.Counter(r.toxic for r in texts.collect())
    assert n[0] == 40 and n[1] == 40 and weights.tolist() == [own[0] / 40, own[1] / 40]
    # 16,000 letters: 8,000 of each class, and a text of 25,000 isn't learnt from.
    texts, weights = toxicity.training_texts(df, labels, "doc_id", "text", "toxic", fit_letters=16000)
    sizes = collections.defaultdict(list)
    for r in texts.collect():
        sizes[r.toxic].append(len(zlib.decompress(r.packed)))
    assert all(7500 < sum(sizes[k]) <= 8000 and max(sizes[k]) <= 1000 for k in (0, 1))
    assert weights.tolist() == [own[k] / len(sizes[k]) for k in (0, 1)]
    out = toxicity.scored(df, labels, fit_rows=60).where("doc_id < 1000 and held_out").collect()
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.95 * len(out)
    again = toxicity.scored(df.repartition(3), labels.repartition(2), fit_rows=60).where("doc_id < 1000 and held_out").collect()
    assert {r.doc_id: round(r.score, 9) for r in again} == {r.doc_id: round(r.score, 9) for r in out}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 6, 400), rng.integers(0, 6, 400)
    keys = np.arange(1, 401, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sa, sb = (neardup.signature(keys[w > 0], w[w > 0], 4096) for w in (a, b))
    assert abs((sa == sb).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def _classes(rows):
    bags = []
    for _, text in rows:
        w = re.findall(r"\w+", (text or "").lower())
        bags.append(collections.Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else None)
    head = list(range(len(rows)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            if rows[i][1] == rows[j][1] or (a and b and sum((a & b).values()) >= 0.8 * sum((a | b).values())):
                head[find(i)] = find(j)
    return {rows[i][0]: min(rows[k][0] for k in range(len(rows)) if find(k) == find(i)) for i in range(len(rows))}


def test_near_classes(spark, docs, none):
    rng = np.random.default_rng(4)
    rows, base = [], [f"v{k}" for k in rng.integers(0, 5000, 150)]
    for i in range(120):  # a family of near copies with outliers, copies, and others
        words = list(base) if i < 80 else [f"u{k}" for k in rng.integers(0, 5000, 40)]
        for k in rng.choice(len(words), 1 + i % 9 if i < 80 else 0, replace=False):
            words[k] = f"z{i}"
        rows.append((i, " ".join(words)))
    rows += [(200, rows[100][1]), (201, ""), (202, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = neardup.near_classes(df).collect()
    assert {r.doc_id: r.class_id for r in got} == _classes(rows)
    assert sum(r.kept for r in got) == len(set(_classes(rows).values())) == neardup.one_of_each(df).count()
    assert neardup.near_classes(docs).where("kept").count() == 7
    assert neardup.one_of_each(docs).columns == docs.columns
    assert neardup.near_classes(none).count() == 0


def test_blocks_link_like_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"v{k}" for k in range(200)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.choice(200, 3 if i < 30 else 8, replace=False):
            words[k] = f"z{i}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(neardup, "PROBES", 0)
    got = {r.doc_id: r.class_id for r in neardup.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == _classes(rows)


def test_revisits(spark):
    head = lambda **h: h
    rows = [(1, "http://www.A.org/x#f", 10, "response", "t1", None, head(etag="t1", server="old", **{"content-length": "9"}), "body1"),
            (2, "https://a.org:443/x?utm_source=q", 20, "revisit", "t1", None, head(server="new", **{"content-length": "0"}), None),
            (3, "http://a.org/x", 20, "response", "t2", None, head(etag="t2"), "body3"), (4, "http://a.org/x", 30, "revisit", "t1", None, None, None),
            (5, "http://a.org/x", 10, "revisit", "t1", None, None, None), (6, None, 40, "revisit", None, None, None, None), (7, None, 1, "response", None, None, None, "n"),
            (8, "http://b.org", 1, "response", None, 5, None, "b"), (9, "http://b.org/", 2, "revisit", "t", 5, head(date="d"), None), (9, "http://b.org/", 2, "revisit", "t", 5, head(date="d"), None)]
    df = spark.createDataFrame(rows, "record_id bigint, url string, at bigint, kind string, etag string, last_modified bigint, headers map<string,string>, payload string")
    got = collections.Counter((r.record_id, r.status, r.refers_to, r.payload, tuple(sorted((r.headers or {}).items()))) for r in warc.resolve_revisits(df).collect())
    assert got == {(2, "resolved", 1, "body1", (("content-length", "9"), ("etag", "t1"), ("server", "new"))): 1, (4, "mismatch", 3, None, ()): 1, (5, "missing", None, None, ()): 1,
                   (6, "missing", None, None, ()): 1, (9, "resolved", 8, "b", (("date", "d"),)): 2}
    assert warc.resolve_revisits(df.limit(0)).count() == 0
    extra = df.withColumns({"answer": F.lit(1), "place": F.lit("p"), "part": F.lit(None), "url_key": F.lit("k"), "carried": F.lit(0), "_bid": F.lit(7)})
    assert warc.resolve_revisits(extra).where("status = 'resolved'").count() == 3


def test_revisits_of_one_url_over_many_partitions(spark):
    """A hot URL, visited after every tenth response, with payloads of 100,000 letters."""
    df = spark.range(4000).select(F.col("id").alias("record_id"), F.lit("http://hot.org/").alias("url"), F.col("id").alias("at"), F.when(F.col("id") % 10 == 9, "revisit").otherwise("response").alias("kind"),
                                  (F.floor(F.col("id") / 10)).cast("string").alias("etag"), F.lit(None).cast("bigint").alias("last_modified"), F.expr("cast(null as map<string,string>)").alias("headers"),
                                  F.when(F.col("id") % 10 == 8, F.repeat(F.lit("x"), 100000)).alias("payload"))
    got = warc.resolve_revisits(df.repartition(16)).select("record_id", "refers_to", "status", F.length("payload").alias("n")).collect()
    assert {tuple(r) for r in got} == {(k, k - 1, "resolved", 100000) for k in range(9, 4000, 10)} and len(got) == 400


def test_sections_keep_query_and_fragment(spark):
    pages = spark.createDataFrame([(1, "http://a.org/en/1/2?page=2&utm_source=feed#top", None), (2, "http://a.org/en", "<li>"), (3, None, "")], "page_id bigint, url string, html string")
    assert {r.record_id: r.url for r in warc.captures(pages).collect()} == {1: "http://a.org/en?page=2&utm_source=feed#top", 2: "http://a.org/en", 3: None}
    key = warc.captures(pages).select(warc.canonical_url(F.col("url")).alias("k")).where("k is not null").collect()
    assert {r.k for r in key} == {"a.org/en?page=2", "a.org/en"}


def test_top_k(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 0.2, 16 if i % 7 else 9).tolist()) for i in range(400)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 16), (403, [float("inf")]), (404, []), (405, rows[3][1]), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asks = F.col("vec_id") % 40 == 0
    got = sorted(tuple(r) for r in topk.top_k(df, asks, k=5, shard=50, block=4).select("query_id", "rank", "vec_id", "score").collect())
    good = {i: np.floor(1024 * np.array(v, float)).astype(int) for i, v in rows if i is not None and i not in (400, 401, 402, 403)}
    want = []
    for q in sorted(i for i in good if i % 40 == 0):
        dots = sorted((-int(sum(a * b for a, b in zip(good[q], v))), i) for i, v in good.items() if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(dots)]
    assert got == want
    assert topk.top_k(df.limit(0), asks).count() == 0


def test_urls(spark):
    given = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/#", "http://org", "org/", None, "",
             "http://blog.casino-win.example.net/en", "http://notexample.org/es/", "http://x.com:80/fr/", "://Ä.ORG/a/ES/"]
    df = spark.createDataFrame(list(enumerate(given)), "page_id bigint, url string")
    for per_pass in (3, 100_000):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, per_pass=per_pass).collect()}
        assert [got[k][2:] for k in range(13)] == [
            ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "allow"), (None, "allow"),
            (None, "allow"), (None, "allow"), (None, "block"), ("org/", "allow"), (None, "allow"), ("org/", "allow")]
        assert got[1][:2] == ("example.org", "/en/12") and got[6][:2] == ("", "") and got[12][:2] == ("Ä.org", "/a/ES/")


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline
    df, labels, truth = _docs_with_toxic(spark, 300)
    full = df.select("doc_id", "text", F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("doc_id") % 4).alias("source"), F.length("text").cast("long").alias("n_chars"))
    copies = full.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 1000)
    full.union(copies).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.toxic(spark, at, str(tmp_path))
    assert kept.where("doc_id % 5 = 0 and doc_id < 1000").count() <= 3 and kept.where("doc_id % 5 != 0 and doc_id < 1000").count() >= 236
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ids and all(i >= 1000 or i >= 20 for i in ids)
