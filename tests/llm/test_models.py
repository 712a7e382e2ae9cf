"""Language-model scores, spelling variants and centroid clustering next to plain Python."""
import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest

from treadline.llm import clustering, ngrams, spelling

#: Columns named like those of the operators; nulls, empty and repeated rows, odd white space, a long text and a long word.
SCHEMA = "doc_id bigint, text string, id string, word string, n int, kind string, block string"
TEXTS = [(1, "the cat sat on the mat"), (2, "The CAT sat\x0bon  the mat"), (3, None), (4, ""), (None, "the cat"), (5, "the dog\x1cx sat É é"), (6, "word " * 4000 + "y" * 3000),
         (7, "the cat sat on the mat"), (7, "the cat sat on the mat"), (8, " \t\n "), (9, "unseen words here"), (10, "on the mat the cat")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y", 1, None, "z") for i, t in TEXTS], SCHEMA)


def by_hand(rows):
    texts = [(i, (t or "").encode().lower().split() + [b" "]) for i, t in rows]
    learned = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    words, pairs, begun = collections.Counter(), collections.Counter(), 0
    for i, t in texts:
        if learned(i):
            words.update(t)
            pairs.update(zip([None, *t], t))
            begun += 1
    n, v = sum(words.values()), len(words)
    once, twice = (sum(c == k for c in pairs.values()) for k in (1, 2))
    d = once / (once + 2 * twice) if once else 0.5
    after, times = collections.Counter(a for a, _ in pairs), dict(words) | {None: begun}

    def smooth(a, b):
        p = (words[b] + 1) / (n + v + 1)
        return p, max(pairs[a, b] - d, 0) / times[a] + d * after[a] / times[a] * p if times.get(a) else p

    out = collections.Counter()
    for i, t in texts:
        p = [smooth(a, b) for a, b in zip([None, *t], t)]
        out[i, i is not None and not learned(i), len(t), sum(w in words for w in t), n, *(round(sum(math.log10(x[k]) for x in p), 6) for k in (0, 1))] += 1
    return out, smooth, words


@pytest.mark.parametrize("block, part", [(1 << 23, 1 << 24), (40, 60), (1, 1)])
def test_lm_scores(docs, block, part):
    want, smooth, words = by_hand(TEXTS)
    got = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
                              for r in ngrams.lm_scores(docs, block=block, part=part).collect())
    assert got == want
    # Each state's probabilities add up to 1 over the known words and an unknown one.
    for state in (None, b"the", b"word", b"never"):
        for k in (0, 1):
            assert math.isclose(sum(smooth(state, w)[k] for w in [*words, b"never seen"]), 1)


def test_lm_without_training(spark, docs):
    held = spark.createDataFrame([(9, "a b"), (None, "c")], "doc_id bigint, text string").where("doc_id IS NULL")
    rows = ngrams.lm_scores(held).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows] == [(2, 0, 0, 0.0, 0.0)]
    assert ngrams.lm_scores(docs.where("false")).collect() == []


def test_pieces_and_packing():
    text = "ab  c\td " * 50 + "x" * 100
    assert [w for p in ngrams.words_of(text, 7) for w in p] == text.encode().split()
    for a in (np.zeros(0, np.int64), np.array([0, 5, 1 << 40]), np.arange(300)):
        assert ngrams.unpack(ngrams.pack(a, a))[1].tolist() == a.tolist()


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def variants_by_hand(rows, least=7):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= 2}
    near = {w: [v for v in n if distance_one(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root))
    return out


def test_variants(spark):
    rng = np.random.default_rng(5)
    stems = ["straße", "colouration", "étranger", "÷ration", "xaaaaaa", "aaaaaaa", "Überall"]
    texts = []
    for i in range(400):
        words = [stems[int(rng.integers(len(stems)))] + ("ing" if rng.random() < 0.5 else "") for _ in range(20)]
        for k in range(0, 20, 7):
            w, at = words[k], int(rng.integers(len(words[k])))
            words[k] = [w[:at] + w[at + 1:], w[:at] + "é" + w[at:], w[:at] + "a" + w[at + 1:]][int(rng.integers(3))]
        texts.append((i, " ".join(words)))
    texts += [(None, "colourations colourations"), (1, None), (2, ""), (3, "1 2 3"), (4, "abcdefg" * 5000), (4, "abcdefg" * 5000), *[(1000 + i, "colouration " * 10 + "colourbtion " * (i < 2)) for i in range(100)]]
    df = spark.createDataFrame([(i, t, "x", "y", 1, None, "z") for i, t in texts], SCHEMA)
    want = variants_by_hand(texts)
    got = spelling.variant_groups(df).collect()
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want and len(got) == len(want)
    assert sum(r[3] is not None for r in want) > 20
    assert spelling.variant_groups(df.where("false")).collect() == []


def test_unaffected_grams_are_shared():
    words = ["".join(w) for w in itertools.product("ab", repeat=7)] + ["abcabcab", "aacbabc"]
    frequent = frozenset({"^a", "ab", "ba", "b$"})
    keys = {w: set(spelling.index_keys(w, frequent)) for w in words}
    for w in words:
        for at in range(len(w)):
            for v in (w[:at] + "x" + w[at + 1:], w[:at] + w[at + 1:], w[:at] + "b" + w[at:]):
                other = {k for k, _ in spelling.index_keys(v, frequent)}
                assert v == w or other & {k for k, _ in keys[w]}


def lloyd(vectors, k=8, rounds=10):
    """``vectors``: id and whole components."""
    start = sorted(vectors, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [c for _, c in start]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for step in range(rounds + 1):
        own = [min(range(len(centres)), key=lambda j: (square(v, centres[j]), j)) for _, v in vectors]
        if step < rounds:
            for j in range(len(centres)):
                mine = [v for (_, v), o in zip(vectors, own) if o == j]
                if mine:
                    centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    apart = [square(v, centres[o]) for (_, v), o in zip(vectors, own)]
    each = collections.Counter()
    for o, d in zip(own, apart):
        each[o] += d
    return collections.Counter((i, o, d, each[o], sum(apart), hashlib.sha256(",".join(map(str, centres[o])).encode()).hexdigest()) for (i, _), o, d in zip(vectors, own, apart))


def test_clusters(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=64) + (i % 5) * (i % 3)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(50)] + [(7, rows[9][1]), (None, rows[5][1])]
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    bad = [(900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [None]), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, [])]
    schema = "vec_id bigint, embedding array<float>, cluster string, id string, v int"
    df = spark.createDataFrame([(i, v, "c", "d", 1) for i, v in rows + bad], schema)
    got = clustering.clusters(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert collections.Counter(tuple(r) for r in got.collect()) == lloyd(usable)
    few = df.where("vec_id < 3")
    assert collections.Counter(tuple(r) for r in clustering.clusters(few).collect()) == lloyd(usable[:3])
    assert clustering.clusters(df.where("vec_id >= 900")).collect() == []


def test_bounds_spare_distances(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 64)) * 3
    rows = [(i, (centres[i % 8] + rng.normal(size=64) * 0.1).astype(np.float32).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = clustering.fit(clustering.whole_vectors(df, "vec_id", "embedding"))
    assert found.worked[0] == 8 * 400 and sum(found.worked[1:]) < 10 * 8 * 400 / 3


def test_too_large_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        clustering.clusters(df).collect()
