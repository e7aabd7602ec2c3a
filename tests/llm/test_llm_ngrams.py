"""The n-gram join against brute force, its signatures against random similar sets, and odd tables."""
from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from trajlake.llm import ngram_join as join

SCHEMA = "doc_id long, text string, row long, node string, bucket string, key string, features string"


def components(sets, ids, similar=85):
    owners, links = defaultdict(list), []
    for b, s in enumerate(sets):
        common = Counter(a for g in s for a in owners[g])
        links += [(a, b) for a, k in common.items() if 100 * k >= similar * (len(s) + len(sets[a]) - k)]
        for g in s:
            owners[g].append(b)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [d if not s else low.get(find(i)) for i, (d, s) in enumerate(zip(ids, sets))]


def grams(text, size=4):
    words = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def check(spark, rows, **options):
    out = join.ngram_join(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    sets = [grams(t) for _, t, *_ in rows]
    want = sorted(zip([r[0] for r in rows], map(len, sets), components(sets, [r[0] for r in rows])), key=str)
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and sorted(map(tuple, out.collect()), key=str) == want


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 12, 13, 20, 40, 44, 60, 100, 255, 300, 700, 3000])
def test_similar_sets_share_a_signature(n):
    rng = np.random.default_rng(n)
    signer = join.Signatures(85)
    for _ in range(60):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        extra = rng.integers(0, n * 15 // 85 + 1) if n > 1 else 0
        most = int((100 * len(a) - 85 * (len(a) + extra)) // 100)  # features that may go so that the pair stays similar
        gone = rng.integers(0, most + 1) if most > 0 else 0
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**63, extra, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        assert 100 * both >= 85 * (len(a) + len(b) - both)
        assert len(np.intersect1d(signer.of(a), signer.of(b)))


def test_bands_adjoin():
    for similar in (60, 80, 85, 95):
        found = join.bands(similar, 7000)
        assert found[0][0] == 1 and all(b[0] == a[1] + 1 for a, b in zip(found, found[1:]))
        at = {n: i for i, (x, y) in enumerate(found) for n in range(x, y + 1)}
        assert all(at[100 * n // similar] - at[n] <= 1 for n in range(1, 4000))


def test_sketches_never_differ_more_than_the_sets():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 900), dtype=np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[:rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(0, 200), dtype=np.uint64)]))
        if len(b):
            assert join.sketch_distance(join.sketch(a, 85), join.sketch(b, 85)) <= len(np.setxor1d(a, b))


def test_features_are_those_of_words():
    for size in (1, 2, 4):
        tool = join.Grams(size)
        texts = ["", None, " \t", "a", "A b", "a b c d e a b c d e", "ab c", "a bc", "É é É é x y", "b a", "x\x1cy z w", "w " * 3000 + "end", "\U0001d518 漢字 a\u3000b c d"]
        for x in texts:
            assert len(tool.features(x)) == len(grams(x, size))
            for y in texts:
                assert len(np.intersect1d(tool.features(x), tool.features(y))) == len(grams(x, size) & grams(y, size)), (x, y)


def test_overlaps():
    rng = np.random.default_rng(4)
    left, right = ([np.unique(rng.integers(0, 60, rng.integers(1, 40), dtype=np.uint64)) for _ in range(n)] for n in (17, 9))
    for first, rows in join.overlaps(left, right, step=200):
        assert all(rows[i][j] == len(np.intersect1d(left[first + i], right[j])) for i in range(len(rows)) for j in range(9))


@pytest.mark.parametrize("small, tiny, cell", [(8, 16, 512), (0, 0, 3)])
def test_documents(spark, small, tiny, cell):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rng, more = random.Random(3), []
    for i, t in texts:
        words = t.split()
        for _ in range(rng.randrange(3)):
            copy = list(words)
            for _ in range(rng.randrange(max(1, len(words) // 20) + 1)):
                copy[rng.randrange(len(copy))] = "other"
            more.append((1000 + len(more), " ".join(copy[: len(copy) - rng.randrange(max(1, len(copy) // 12))])))
    check(spark, [(i, t, 0, "x", "x", "x", "x") for i, t in texts + more], small=small, tiny=tiny, cell=cell)


def test_group_of_near_copies(spark):
    """A large group whose members differ from each other, below and above the threshold, around one passage."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = [w if rng.random() > 0.012 else f"x{rng.randrange(9)}" for w in base]
        rows.append((i, " ".join(words), 1, None, None, None, None))
    check(spark, rows, tiny=4, cell=16)


def test_odd_rows(spark):
    long = "lorem ipsum dolor sit amet " * 3000
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, "One two three"), (5, "one two\vthree"), (5, "one two three"), (4, "ONE two three"), (6, long), (7, long + "end"), (None, "null only here"),
            (None, "null only here"), (8, "word"), (9, "WORD"), (10, "É é"), (11, "é é"), (12, "a b c d"), (13, "a b c d e"), (13, None)]
    check(spark, [(*r, 1, "clash", None, "k", "f") for r in rows])
    assert join.ngram_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_katz_bucket_works_by_pair_not_by_occurrence():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from trajlake.llm import katz

    n, words = 400_000, np.arange(1, 41, dtype=np.uint64)
    which, docs = np.arange(40, dtype=np.uint32), np.tile(np.arange(1000, dtype=np.uint32), n // 1000)
    part = katz._pack(words=words, which=which, histories=np.array([7], dtype=np.uint64), pairs=np.array([40], dtype=np.uint32), times=np.full(40, n // 40, dtype=np.uint32),
                      docs=docs, held=np.zeros(1000, dtype=bool), ids=[(i, i) for i in range(1000)])
    table = lambda data: pa.table({"data": pa.array([data], pa.binary())})
    left, right = table(part), table(katz._pack(words=words, counts=np.full(40, n // 40)))
    tracemalloc.start()
    out = katz._count(katz.Unigrams({0: n, 7: 40, 8: n - 0.4}), np.array([katz.BEGIN], dtype=np.uint64), np.zeros(1))((pa.scalar(0),), left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert katz._unpack(out.column("data").to_pylist()[0])["tokens"].sum() == n
    assert peak / n < 50


def test_only_nodes_that_share_a_bucket_move_their_texts(spark, monkeypatch):
    kept, plain = {}, join.staged
    monkeypatch.setattr(join, "staged", lambda df, tag: kept.setdefault(tag, plain(df, tag)) if tag == "kinds" else plain(df, tag))
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base + " more"), (3, " ".join(f"x{i}" for i in range(60))), (4, " ".join(f"y{i}" for i in range(60)))]
    got = {r.doc_id: r.component_id for r in join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    assert sorted(join._text(bytes(r.text)) for r in kept["kinds"].collect()) == [base, base + " more"]
