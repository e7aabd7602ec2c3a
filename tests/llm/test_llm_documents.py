"""Operators on documents against brute force, and on odd tables."""
from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.llm import graph, katz, line_dedup, minhash_dedup, packing, piece_sampling, toxicity, training_order
from trajlake.llm.exact_dedup import exact_dedup
from trajlake.llm.word_ids import tokenizer_path, word_ids

LONG = "lorem ipsum dolor " * 6000
ODD = [(1, None, None, "a", None, 7), (2, "", "en", "b", 0, 7), (3, " \t\n ", "en", "b", 4, 7), (None, "One two  three four five six", "en", "c", 1, 7),
       (5, "one two three four five six", "en", "c", 1, 7), (5, "one two three four five six", "en", "c", 1, 7), (4, "One two\tthree four five six", "xx", None, 1, 7),
       (6, LONG, "en", "d", 1, 7), (7, LONG + "end", "en", "d", 1, 7), (8, "word", "en", "e", 1, 7), (9, "WORD", "en", "e", 1, 7), (10, "漢字 𝔘 ▁x <|endoftext|>", "zh", "e", 1, 7)]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and column names the operators use inside."""
    names = ("row", "digest", "seat", "node", "key", "bucket", "component", "slot", "at", "held")
    frame = spark.createDataFrame(ODD, ODD_SCHEMA)
    return frame.selectExpr("*", *(f"'clash' AS `{n}`" for n in names))


@pytest.fixture(scope="module")
def texts(spark):
    """Some 400 documents with copies and near copies."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    more = [(1000 + i, t if i % 3 == 0 else re.sub(r"(\w+)$", "changed", t) if i % 3 == 1 else " ".join(t.split()[: -max(1, len(t.split()) // 9)])) for i, t in rows]
    return rows + more


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(5)


def unite(pairs, ids):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def normal(t):
    return re.sub("[\t-\r ]+", " ", t or "")


@pytest.mark.parametrize("local_chars", [10, 48_000_000])
def test_exact_dedup(docs, texts, odd, local_chars):
    groups = defaultdict(list)
    for i, t in texts:
        groups[normal(t)].append(i)
    for r in exact_dedup(docs, local_chars=local_chars, salts=2).collect():
        t = normal(dict(texts)[r.doc_id])
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(groups[t]), len(groups[t]), r.doc_id == min(groups[t]), hashlib.sha256(t.encode()).hexdigest())
    got = exact_dedup(odd.repartition(3), local_chars=local_chars).collect()
    assert len(got) == len(ODD) and sum(r.kept for r in got) == len({normal(x[1]) for x in ODD})
    assert {r.keep_id for r in got if r.doc_id == 5} == {5} and sum(r.kept for r in got if r.doc_id == 5) == 1
    assert next(r for r in got if r.doc_id is None).keep_id == 4 and exact_dedup(odd.limit(0)).count() == 0


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if w else set()


@pytest.mark.parametrize("size,small", [(2, 8), (5, 0)])
def test_minhash_dedup(docs, texts, odd, size, small):
    sets = {i: shingles(t, size) for i, t in texts}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and sets[b] and 100 * (k := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - k)]
    want = unite(links, ids)
    got = minhash_dedup.minhash_dedup(docs, size=size, small=small).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in ids} and len(links) > 100
    if size == 2:
        got = minhash_dedup.minhash_dedup(odd, size=2).collect()
        assert sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in got) == sorted(str(x) for x in (
            (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 5, 4, False), (5, 5, 4, False), (5, 5, 4, False), (4, 5, 4, True), (6, 3, 6, True), (7, 4, 7, True), (8, 1, 8, True), (9, 1, 8, False), (10, 3, 10, True)))
        kept = minhash_dedup.without_near_copies(odd, size=2)
        assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8, 10]
        assert minhash_dedup.minhash_dedup(odd.limit(0), size=2).count() == 0


def test_sequential_comparison_keeps_similar_pairs():
    needed = minhash_dedup.fewest_matches(miss=1e-4)
    rng = np.random.default_rng(3)
    matches = rng.random((20000, 128)) < 0.8
    assert np.mean([all(m[:n].sum() >= k for n, k in needed.items()) for m in matches]) > 0.999
    assert np.mean([all(m[:n].sum() >= k for n, k in needed.items()) for m in rng.random((2000, 128)) < 0.5]) < 0.01


def lines_of(text):
    return [(n, i) for i, line in enumerate((text or "").split("\n")) if len(n := re.sub("[\t-\r ]+", " ", line.lower()).strip(" ")) >= 10] if text is not None else []


def test_lines_are_similar_in_every_window(spark):
    """Lines of equal beginnings or without spaces, against all windows of all pairs."""
    same = ["https://example.org/a/very/long/path/page-0001.html?from=list", "\u6211\u4eec\u4eca\u5929\u5728\u5b66\u6821\u91cc\u5b66\u4e60\u6c49\u8bed\u548c\u6570\u5b66\u8bfe\u7a0b"]
    kinds = ["isbn 9781234567890", "isbn 9781234561111", same[0], same[0].replace("list", "lisu"), "https://example.org/other", same[1], same[1][:9] + "\u8001\u5e08\u8bf4\u660e\u5929\u4e0d\u4e0a\u8bfe", same[1] + "\u3002",
             "\U0001d518" * 3 + "abcdefghijklmnop", "\U0001d518" * 3 + "abcdefgzyxwvutsr", "abcdefghij", "abcdefghik"]
    sets = [{n[i:i + 9] for i in range(len(n) - 8)} for n in kinds]
    links = [(a, b) for b, s in enumerate(sets) for a in range(b) if 100 * len(s & sets[a]) >= 80 * len(s | sets[a])]
    part = unite(links, range(len(kinds)))
    rows = spark.createDataFrame(list(enumerate(kinds)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.dropped for r in line_dedup.line_report(rows).collect()}
    assert links == [(2, 3), (5, 7)] and got == {i: [] if part[i] == i else [0] for i in part}
    assert [r.n for r in rows.select("doc_id", F.array_distinct(line_dedup.shingles(F.col("text"))).alias("n")).orderBy("doc_id").collect()] == [list(dict.fromkeys(n[i:i + 9] for i in range(len(n) - 8))) for n in kinds]
    assert rows.limit(1).select(line_dedup.shingles(F.lit("short")).alias("n")).first().n == ["short"]


def test_unlike_members_of_a_bucket_make_no_rows(spark):
    """What cannot be similar is ruled out inside the join, and nothing similar is."""
    rng = np.random.default_rng(5)
    base = "".join(map(chr, rng.integers(97, 123, 260)))
    kinds = [base] + [base[:at] + "".join(map(chr, rng.integers(97, 123, n))) + base[at + n:] for n in (1, 4, 9, 20, 60, 120) for at in (0, 70, 130)]
    texts = spark.createDataFrame(list(enumerate(kinds)), "node long, line string")
    sets = [{k[i:i + 9] for i in range(len(k) - 8)} for k in kinds]
    profiles = line_dedup._profiles(texts, 9)
    assert {r.node: r.size for r in profiles.collect()} == {i: len(s) for i, s in enumerate(sets)}
    buckets = texts.selectExpr("1 AS bucket", "node")
    none = texts.limit(0).selectExpr("node AS id", "node AS component")
    got = {(r.a, r.b): r.total for r in graph.residual_pairs(buckets, none, profiles, lambda x, y: line_dedup.may_link(x, y, 80)).collect()}
    pairs = [(i, j) for j in range(len(kinds)) for i in range(j)]
    alike = {(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert alike and alike <= set(got) and all(got[i, j] == len(sets[i]) + len(sets[j]) for i, j in got)
    assert len(got) < len(alike) + (len(pairs) - len(alike)) // 5
    cut = line_dedup.windows(spark.createDataFrame([(1, 1, base + "𝔘漢 " + base), (2, 2, "short")], "k1 long, k2 long, line string")).collect()
    text = base + "𝔘漢 " + base
    assert sorted(r.s for r in cut) == sorted([*(text[i:i + 9] for i in range(len(text) - 8)), "short"])


def test_strips_hold_the_hashes_of_the_windows(spark):
    base = "".join(chr(97 + i * i % 26) + str(i % 7) for i in range(60))
    rows = [(1, 1, base + "𝔘漢 " + base), (2, 2, "short")] + [(n, 3, base[:n]) for n in (9, 10, 15, 16, 17, 24, 63, 64, 65, 72, 73)]
    lines = spark.createDataFrame(rows, "k1 long, k2 long, line string")
    of = lambda df: sorted((r.k1, r.k2, sorted(set(r.xs))) for r in df.collect())
    xs = F.array(*(f"x{j}" for j in range(1, line_dedup.STRIP + 1)))
    got = line_dedup.strips(lines).groupBy("k1", "k2").agg(F.flatten(F.collect_list(xs)).alias("xs"), F.count(F.lit(1)).alias("n"))
    assert of(got) == of(line_dedup.windows(lines).groupBy("k1", "k2").agg(F.collect_list(F.hash("s")).alias("xs")))
    assert {(r.k1, r.n) for r in got.collect()} >= {(2, 1), (9, 1), (16, 1), (17, 2), (24, 2)}


def test_line_dedup_in_every_window(spark, docs, texts, odd):
    """The documents against brute force over every nine-character window of a line."""
    found = [(i, at, n) for i, t in sorted(texts) for n, at in lines_of(t)]
    kinds = sorted({n for *_, n in found})
    sets = [frozenset(n[i:i + 9] for i in range(len(n) - 8)) for n in kinds]
    owners, links = defaultdict(list), []
    for b, s in enumerate(sets):
        common = Counter(a for g in s for a in owners[g])
        links += [(a, b) for a, k in common.items() if 100 * k >= 80 * (len(s) + len(sets[a]) - k)]
        for g in s:
            owners[g].append(b)
    part, number = unite(links, range(len(kinds))), {n: i for i, n in enumerate(kinds)}
    first, dropped = set(), defaultdict(set)
    for i, at, n in found:
        dropped[i] |= {at} if part[number[n]] in first else set()
        first.add(part[number[n]])
    report = {r.doc_id: set(r.dropped) for r in line_dedup.line_report(docs).collect()}
    assert report == {i: dropped[i] for i, _ in texts} and any(dropped.values()) and links
    new = {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()}
    assert all(new[i] == "\n".join(x for at, x in enumerate(t.split("\n")) if at not in dropped[i]) for i, t in texts)
    out = line_dedup.line_dedup(odd)
    assert out.columns == odd.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert (4, "One two\tthree four five six") in got and (None, "") in got and got.count((5, "")) == 2 and (1, None) in got and (2, "") in got and (8, "word") in got
    assert line_dedup.line_dedup(odd.limit(0)).count() == 0
    plan = line_dedup.line_report(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_katz_scores(docs, texts, odd):
    train = {i for i, _ in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    words = {i: (t or "").encode().lower().split() + [b"</s>"] for i, t in texts}
    one, two, history = Counter(), Counter(), Counter()
    for i in train:
        one.update(words[i])
        pairs = list(zip([b"<s>", *words[i]], words[i]))
        two.update(pairs)
        history.update(h for h, _ in pairs)
    n, v = sum(one.values()), len(one)
    d1, d2 = (katz.discounts([0.0] + [float(sum(c == r for c in x.values())) for r in range(1, 7)]) for x in (one, two))
    cut = lambda c, d: c - katz.REST if c > 5 else d[c] * c
    p = {w: cut(c, d1) / n for w, c in one.items()}
    unknown, after = 1 - sum(p.values()), defaultdict(list)
    for (h, w), c in two.items():
        after[h].append((w, c))
    back = {h: (1 - sum(cut(c, d2) for _, c in x) / history[h]) / (1 - sum(p[w] for w, _ in x)) for h, x in after.items()}
    for r in katz.katz_scores(docs, bucket_bytes=50_000).collect():
        score, h = 0.0, b"<s>"
        for w in words[r.doc_id]:
            c = two.get((h, w), 0)
            score += math.log10(cut(c, d2) / history[h] if c else p.get(w, unknown) * back.get(h, 1.0))
            h = w
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in words[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id not in train, len(words[r.doc_id]), sum(w in one for w in words[r.doc_id]), n)
        assert r.score == pytest.approx(score, rel=1e-9) and r.base_score == pytest.approx(base, rel=1e-9)
    for h in list(after)[:50]:
        seen = dict(after[h])
        assert sum(cut(c, d2) for c in seen.values()) / history[h] + back[h] * (unknown + sum(q for w, q in p.items() if w not in seen)) == pytest.approx(1.0)
    got = katz.katz_scores(odd).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) for r in got) and katz.katz_scores(odd.limit(0)).count() == 0


@pytest.mark.parametrize("bucket_bytes", [10**9, 40_000])
def test_katz_scores_of_triples(docs, texts, odd, bucket_bytes):
    train = {i for i, _ in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    words = {i: (t or "").encode().lower().split() + [b"</s>"] for i, t in texts}
    one, two, three = Counter(), Counter(), Counter()
    for i in train:
        ws = [b"<s>", *words[i]]
        one.update(words[i])
        two.update(zip(ws, ws[1:]))
        three.update(zip(ws, ws[1:], ws[2:]))
    d1, d2, d3 = (katz.discounts([0.0] + [float(sum(c == r for c in x.values())) for r in range(1, 7)]) for x in (one, two, three))
    cut = lambda c, d: c - katz.REST if c > 5 else d[c] * c
    n, size, after = sum(one.values()), Counter(), defaultdict(list)
    for g, c in [*two.items(), *three.items()]:
        size[g[:-1]] += c
        after[g[:-1]].append((g[-1], c))
    unknown, back = 1 - sum(cut(c, d1) for c in one.values()) / n, {}

    def p(*g):
        c, d = ((one, d1), (two, d2), (three, d3))[len(g) - 1]
        seen = c.get(g if len(g) > 1 else g[0], 0)
        if len(g) == 1:
            return cut(seen, d) / n if seen else unknown
        if seen:
            return cut(seen, d) / size[g[:-1]]
        return (weight(g[:-1], d) if g[:-1] in after else 1.0) * p(*g[1:])

    def weight(h, d):
        if h not in back:
            back[h] = (1 - sum(cut(c, d) for _, c in after[h]) / size[h]) / (1 - sum(p(*h[1:], w) for w, _ in after[h]))
        return back[h]

    for r in katz.katz_scores(docs.repartition(3), bucket_bytes=bucket_bytes, order=3).collect():
        ws = [b"<s>", *words[r.doc_id]]
        assert r.score == pytest.approx(sum(math.log10(p(*ws[max(0, k - 2):k + 1])) for k in range(1, len(ws))), rel=1e-9)
    for h in [h for h in after if len(h) == 2][:5]:
        assert sum(p(*h, w) for w in one) + weight(h, d3) * (weight(h[1:], d2) if h[1:] in after else 1.0) * unknown == pytest.approx(1.0)
    got = katz.katz_scores(odd, order=3).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) for r in got) and katz.katz_scores(odd.limit(0), order=3).count() == 0


def test_katz_tells_a_block_all_in_one_row(docs, monkeypatch):
    """A row per bucket and block of documents, not per bucket and document; blocks of one task and of several buckets meet again."""
    schemas, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, work, schema, *a, **b: (schemas.append(schema), plain(self, work, schema, *a, **b))[1])
    whole = {r.doc_id: r for r in katz.katz_scores(docs, bucket_bytes=10**9).collect()}
    assert schemas[-1] == "block long, data binary"
    split = katz.katz_scores(docs.repartition(3), bucket_bytes=20_000).collect()
    assert len(split) == len(whole)
    for r in split:
        assert (r.held_out, r.n_tokens, r.n_known) == whole[r.doc_id][1:4]
        assert r.score == pytest.approx(whole[r.doc_id].score, rel=1e-9) and r.base_score == pytest.approx(whole[r.doc_id].base_score, rel=1e-9)


def test_packing(docs, texts, odd):
    tokenizer = word_ids(tokenizer_path()).tokenizer
    for frame, rows, most in ((docs, texts, 2048), (odd, [(x[0], x[1]) for x in ODD], 64)):
        got = packing.pack(frame, max_tokens=most, with_ids=True).collect()
        sequences, pieces = defaultdict(list), defaultdict(list)
        for r in got:
            assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
            sequences[r.sequence_id].append((r.offset, r.length))
            pieces[r.doc_id].append((r.start, bytes(r.ids)))
        assert sorted(sequences) == list(range(len(sequences)))
        for s in sequences.values():
            ends = [0, *np.cumsum([n for _, n in sorted(s)])]
            assert [o for o, _ in sorted(s)] == ends[:-1] and ends[-1] <= most
        want = defaultdict(bytes)
        for i, t in rows:
            want[i] += np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert {i: sum(len(x) for _, x in p) for i, p in pieces.items()} == {i: len(x) for i, x in want.items()}
        assert all(b"".join(x for _, x in sorted(pieces[i])) == want[i] for i in want if i != 5)
    assert packing.pack(odd.limit(0)).count() == 0
    padding = lambda plan, most: sum((most - sum(q)) * c for q, c in plan)
    plan = packing.plan_patterns({n: 50 for n in range(1, 200)}, 256)
    assert Counter({n: 50 for n in range(1, 200)}) == sum((Counter({n: q.count(n) * c for n in q}) for q, c in plan), Counter()) and padding(plan, 256) < 0.02 * sum(50 * n for n in range(200))


def test_word_ids_equal_the_tokenizer():
    words = word_ids(tokenizer_path())
    rng = np.random.default_rng(5)
    alphabet = [*"abAÉé .,;!'\n\t ́İß漢1<|>ΣσĲ", "<|endoftext|>", "'s", "\x85", "\x1c", "é"]
    for text in ["", " ", LONG, *("".join(rng.choice(alphabet, rng.integers(0, 25))) for _ in range(3000))]:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_training_order(docs, texts, odd):
    for n in (1, 2, 3, 7, 100, 1000, 65537):
        assert sorted(training_order.slots(np.arange(n), n).tolist()) == list(range(n))
    assert training_order.slots(np.arange(1000), 1000).tolist() != training_order.slots(np.arange(1000), 1000, key=9).tolist()
    encoding = training_order._encoding(tokenizer_path(training_order.BYTE_BPE))
    from trajlake.llm.common import new_path
    manifest = training_order.write_shards(docs, new_path(docs.sparkSession, "test"), shard=100)
    rows = training_order.read_shards(manifest).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and all(r.shard == r.slot // 100 for r in rows)
    got = defaultdict(dict)
    for r in rows:
        got[r.doc_id][r.sequence] = bytes(r.ids)
    for i, t in texts:
        assert b"".join(got[i][k] for k in range(len(got[i]))) == np.array([*encoding.encode_ordinary(t), training_order.END_ID], "<u2").tobytes()
    part = training_order.read_shards(manifest, start=150, stop=320).collect()
    assert sorted(map(str, part)) == sorted(str(r) for r in rows if 150 <= r.slot < 320)
    out = training_order.training_order(odd).collect()
    assert Counter(r.doc_id for r in out if r.sequence == 0) == Counter(x[0] for x in ODD) and training_order.training_order(odd.limit(0)).count() == 0


def test_piece_sampling(odd):
    pieces = piece_sampling.Pieces(tokenizer_path(piece_sampling.PIECES))
    weights = np.array([-3.0 - len(p) * 0.4 - (i % 13) / 5 for i, p in enumerate(pieces.text)])
    lattice, text, k, n = piece_sampling.Lattice(pieces, weights), "ab then", 3, 6000

    def all_of(chunk):
        return [((), 0.0)] if not chunk else [((pieces.ids[chunk[:m]], *r), weights[pieces.ids[chunk[:m]]] + x) for m in range(1, len(chunk) + 1) if chunk[:m] in pieces.ids for r, x in all_of(chunk[m:])]

    full = [((), 0.0)]
    for chunk in piece_sampling._CHUNK.findall(piece_sampling.prepared(text)):
        full = [(a + b, x + y) for a, x in full for b, y in all_of(chunk)]
    total = np.logaddexp.reduce([x for _, x in full])
    chance = {a: x - total for a, x in full}
    seeds = np.random.default_rng(1).integers(0, 2**63, n).astype(np.uint64)
    first, weighted, pairs = Counter(), Counter(), Counter()
    for at in range(0, n, 500):
        for rows in piece_sampling.sample_texts(lattice, [text] * 500, seeds[at:at + 500], k):
            ids = [tuple(np.frombuffer(r[0], "<u4").tolist()) for r in rows]
            assert len(set(ids)) == k and all(r[2] == pytest.approx(chance[i]) for r, i in zip(rows, ids)) and rows[0][3] >= rows[1][3] >= rows[2][3]
            first[ids[0]] += 1
            pairs[ids[0], ids[1]] += 1
            for r, i in zip(rows, ids):
                weighted[i] += math.exp(r[2]) / r[4]
    best = sorted(chance, key=chance.get)[::-1]
    for a in best[:8]:
        p = math.exp(chance[a])
        assert abs(first[a] / n - p) < 4 * math.sqrt(p / n) and abs(weighted[a] / n - p) < 0.15 * p + 4 * math.sqrt(p / n)
    p, q = math.exp(chance[best[0]]), math.exp(chance[best[1]])
    assert abs(pairs[best[0], best[1]] / n - p * q / (1 - p)) < 4 * math.sqrt(p * q / n)
    got = piece_sampling.sample_segmentations(odd).collect()
    assert all(r.round_trip for r in got) and Counter(r.doc_id for r in got if r.sample == 0) == Counter(x[0] for x in ODD)
    assert len({str((bytes(r.ids), r.sample)) for r in got if r.doc_id == 5}) == 2 and [r.inclusion for r in got if r.doc_id == 2] == [1.0]
    assert piece_sampling.sample_segmentations(odd.limit(0)).count() == 0


def test_toxicity(spark, odd):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.toxicity(d, labels).collect()}
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) >= 0.93
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    again = {r.doc_id: r.score for r in toxicity.toxicity(d, flipped).collect()}
    assert all(again[i] == pytest.approx(r.score, abs=1e-9) for i, r in got.items())
    some = spark.createDataFrame([(None, 1), (4, None), (6, 1), (8, 0), (8, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(odd, some).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.toxicity(odd.limit(0), some.limit(0)).count() == 0 and toxicity.without_toxic(odd, some).columns == odd.columns


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(2)
    y = rng.random(40000) < 0.15
    votes = np.stack([rng.random(len(y)) < np.where(y, a, b) for a, b in ((0.8, 0.03), (0.7, 0.02), (0.6, 0.05), (0.5, 0.01), (0.75, 0.04))], axis=1)
    votes = np.concatenate([votes, np.where(rng.random((len(y), 1)) < 0.9, votes[:, :1], rng.random((len(y), 1)) < 0.1)], axis=1)  # a near copy of the first voter
    masks, n = np.unique(votes @ (1 << np.arange(6)), return_counts=True)
    model = toxicity.LabelModel(6)
    for _ in range(25):
        model.learn(model.counts(masks, n.astype(float)))
    assert model.parent[5] == 0 or model.parent[0] == 5
    assert abs(model.prior - 0.15) < 0.03
    p = dict(zip(masks.tolist(), model.posterior(masks)))
    assert np.mean([(p[m] >= 0.5) == t for m, t in zip((votes @ (1 << np.arange(6))).tolist(), y)]) > 0.95
