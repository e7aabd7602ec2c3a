"""Token alignment against brute force over token occurrences, and on odd tables."""
from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest

from trajlake.llm import token_alignment as alignment
from trajlake.llm.word_ids import tokenizer_path

SCHEMA = "doc_id long, text string, span int, a string, posting string"
ODD = [None, "", " ", "  ", "\n\t ", "word", "Word word", "<|endoftext|> and <s> </s> <unk>", "▁ spelled", "a▁b", "漢字 𝔘 é́", "x​ y", "\r\n\r\n  tab\t\tend  ", "don't DON'T 'S", "\u0000\u0001\u0085", "x" * 3000, "ab " * 2000, "12345,678.90!!", "word"]


@pytest.fixture(scope="module")
def rows(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    return [(i if i != 3 else None, t, 1, "clash", "clash") for i, t in enumerate([*ODD, *texts[:120]])] + [(5, "word", 1, "clash", None)] * 3


def tokens(raw, ids, pieces):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(pieces[i]), i))
        at += len(pieces[i])
    return out if b"".join(pieces[i] for i in ids) == raw else None


def expected(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(tokenizer_path(alignment.BYTES)), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(alignment.PIECES))
    one.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = dict(zip([chr(b) for b in plain] + [chr(256 + i) for i in range(256 - len(plain))], [*plain, *(b for b in range(256) if b not in plain)]))
    decoder = {i: bytes(letters[c] for c in one.id_to_token(i)) for i in range(one.get_vocab_size() - 1)}
    pieces = {i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in range(two.get_piece_size())}
    docs, holders = [], Counter()
    for doc_id, text, *_ in rows:
        raw = (" " + (text or "")).encode()
        a, b = (tokens(raw, one.encode(" " + text, add_special_tokens=False).ids, decoder), tokens(raw, two.encode(text, num_threads=1), pieces)) if text else (None, None)
        if a is None or b is None:
            docs.append((doc_id, [], [], [], []))
            continue
        links, first = [], 0
        for x, y, i in a:
            while b[first][1] <= x:
                first += 1
            at = first
            while at < len(b) and b[at][0] < y:
                links.append((i, b[at][2]))
                at += 1
        ends, groups = sorted({y for _, y, _ in a} & {y for _, y, _ in b}), defaultdict(lambda: ([], []))
        for side, found in enumerate((a, b)):
            at = 0
            for x, y, i in found:
                at += y > ends[at]
                groups[at][side].append(str(i))
        docs.append((doc_id, a, b, [",".join(x) + "|" + ",".join(y) for _, (x, y) in sorted(groups.items())], links))
        holders.update(set(links))
    best = Counter()
    for (a, _), n in holders.items():
        best[a] = max(best[a], n)
    got = [(i, len(a), len(b), len(g), len(k), sum(holders[p] == best[p[0]] for p in k), sum(holders[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, a, b, g, k in docs]
    return got, holders, Counter(p for *_, k in docs for p in k)


@pytest.mark.parametrize("range_docs", [alignment.RANGE_DOCS, 7])
def test_alignment_equals_brute_force(spark, rows, range_docs):
    """Nulls, blanks, special strings, characters outside the vocabulary, long runs, repeated rows, and clashing columns."""
    docs, pairs = alignment.align_tokenizers(spark.createDataFrame(rows, SCHEMA).repartition(3), range_docs=range_docs)
    want, holders, links = expected(rows)
    assert docs.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, docs.collect()), key=str) == sorted(want, key=str)
    assert {(r.a, r.b): (r.docs, r.links) for r in pairs.collect()} == {p: (n, links[p]) for p, n in holders.items()}


def test_bitmaps_and_planes():
    import numpy as np
    rng = np.random.default_rng(2)
    for share in (0.001, 0.05, 0.5, 1.0):
        docs = np.flatnonzero(rng.random(5000) < share)
        counts = rng.integers(1, 300, len(docs))
        data = alignment.pack_bitmap(docs, 5000)
        planes = alignment.pack_planes(docs, counts, 5000) if len(docs) else []
        assert (alignment.unpack_bitmap(data) == docs).all() and alignment.popcount(data) == len(docs) and len(data) <= 626
        assert (alignment.unpack_counts(docs, planes, 5000) == counts).all()
        assert len(docs) + sum(alignment.popcount(p) << k for k, p in enumerate(planes)) == counts.sum()


def test_empty_table(spark):
    docs, pairs = alignment.align_tokenizers(spark.createDataFrame([], SCHEMA))
    assert docs.count() == 0 and pairs.count() == 0
