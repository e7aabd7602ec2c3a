"""Archives, vector search and the pipeline against brute force, and on odd tables."""
from __future__ import annotations

import gzip
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from trajlake.llm import topk_search, warc
from trajlake.llm.common import new_path


def test_archives(spark):
    big = "<p>" + "x é " * 400
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (None, "u", big), (8, "u", big + "z"), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "'s' AS sha1", "'f' AS first").repartition(3)
    folder = new_path(spark, "warc-test")
    manifest = warc.write_archives(pages, folder, roll_bytes=300)
    got = Counter(tuple(r) for r in warc.read_archives(manifest).collect())
    sizes = {i: ((h or "").encode()) for i, _, h in rows}
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        last = max((j for j, _, g in rows if j is not None and (g or "").encode() == data), default=None) if len(data) >= 1000 else None
        revisit = i is not None and last is not None and i < last
        want[(i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None)] += 1
    assert got == want and len(sizes) == 10
    files = [r.path for r in manifest.collect()]
    assert len(files) > 3 and sum(r.records for r in manifest.collect()) == len(rows)
    text = b"".join(gzip.open(f.removeprefix("file://")).read() for f in files)
    assert text.count(b"WARC-Type: revisit") == 2 and b"WARC-Refers-To-Target-URI: urn:unknown" in text and b"\r\nX: y" not in text
    assert warc.deduplicated_archives(pages.limit(0)).count() == 0


def brute(rows, every, k):
    out = []
    for q, v in rows:
        if q % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block,cell", [(7, 2), (256, 128)])
def test_topk_search(spark, monkeypatch, block, cell):
    monkeypatch.setattr(topk_search, "CELL_BLOCKS", cell)
    monkeypatch.setattr(topk_search, "CELL_QUERIES", 4)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    rows = [(i, [float(x) for x in np.round(centres[i % 6] + rng.normal(size=12) * 0.2, 2)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(30)]  # ties
    bad = [(None, rows[1][1]), (450, None), (500, [float("nan")] * 12), (550, [None] * 12), (600, [float("inf")] * 12)]
    short = [(650, [1.0, -2.0]), (700, [])]
    frame = spark.createDataFrame(rows + bad + short, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS v", "1 AS r", "2 AS id")
    ints = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows + short]
    got = sorted(tuple(r) for r in topk_search.topk_search(frame, block=block, pivots=5).collect())
    assert got == brute(ints, 50, 5)
    assert topk_search.topk_search(frame.filter("vec_id IN (0, 50, 7)")).count() == 4
    assert topk_search.topk_search(frame.limit(0)).count() == 0


def test_cells_skip_blocks():
    rng = np.random.default_rng(6)
    blocks = []
    for b in range(40):
        m = (rng.normal(size=(16, 8)) * 2 + (200 if b == 3 else 0)).astype(np.int64)
        blocks.append((np.arange(b * 16, b * 16 + 16), m, m.max(axis=0), m.min(axis=0)))
    seen, query = [], np.full((1, 8), 10)
    dot = topk_search._dot
    topk_search._dot, kept = (lambda a, b: (seen.append(len(b)), dot(a, b))[1]), dot
    try:
        best = topk_search.search_cell((np.array([-1]), query), np.array([-2**62]), blocks, 5, 8)
    finally:
        topk_search._dot = kept
    want = sorted(((-int(s), int(i)) for b in blocks for s, i in zip(b[1] @ query[0], b[0])))[:5]
    assert [(-int(s), int(i)) for s, i in zip(*best[0])] == want
    assert sum(n == 16 for n in seen) == 1  # one block of 40 was scored


def test_pipeline(spark, tmp_path):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    folder = str(tmp_path)
    extra = [(10_000, d.filter("doc_id = 1").first().text, "en", "copy", 1), (10_001, None, None, None, None), (10_002, "", "en", "s", 0)]
    d.unionByName(spark.createDataFrame(extra, d.schema)).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, rows, counts = docs.columns, docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, rows, folder).write.parquet(f"{folder}/{name}")
        rows = spark.read.parquet(f"{folder}/{name}")
        assert rows.columns == names
        counts.append({r.doc_id: r.text for r in rows.collect()})
    toxic, lines, near = counts
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum(truth.get(i) == 0 for i in toxic) >= 0.95 * sum(x == 0 for x in truth.values())
    assert set(lines) == set(toxic) and all(len(lines[i] or "") <= len(toxic[i] or "") for i in toxic)
    assert 10_000 not in toxic or (lines[10_000] == "" and 1 in near)
    assert {10_001, 10_002} <= set(near) <= set(lines)
    packed = defaultdict(int)
    for r in corpus_pipeline.run(spark, folder).collect():
        packed[r.doc_id] += r.length
    assert set(packed) == set(near)
