"""Two tokenizers aligned over a corpus: inverted bitmaps of the documents that hold an id pair, and the pairs' counts back to them."""
from __future__ import annotations

import base64
import hashlib

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, staged
from .piece_sampling import PIECES, SPACE
from .word_ids import tokenizer_path

BYTES, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: A range of document numbers ends at so many documents or so many linked pairs, whichever comes first; numbers in it take 16 bits.
RANGE_DOCS, RANGE_PAIRS = 8192, 2_000_000
NAMES = ["span", "id", "doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "width", "bitmap", "planes"]
#: Chunks whose pieces a worker keeps.
CHUNKS = 400_000


class Aligner:
    """Ids of both tokenizers with the byte ranges they cover."""

    def __init__(self, path_a: str, path_b: str):
        import re

        import numpy as np
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.np = np
        self.exact = Tokenizer.from_file(path_a)
        self.exact.encode_special_tokens = True
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(RANKS), "rb"))}
        self.bytes_a = self._byte_level(self.exact)
        # The same vocabulary as ranks gives the same ids several times faster; another vocabulary takes the slower way.
        same = len(ranks) == len(self.bytes_a) - 1 and all(ranks.get(t, i) == i for i, t in enumerate(self.bytes_a))
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if same else None
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = self.model.get_piece_size()
        text = [self.model.id_to_piece(i) for i in range(size)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(text)]
        self.width_a = np.array([len(t) for t in self.bytes_a], dtype=np.int64)
        self.width_b = np.array([len(t) for t in self.bytes_b], dtype=np.int64)
        # Every id as text with what follows it: a comma inside a group, a bar behind its last A, a semicolon behind its last B.
        names = [f"{i}{mark}".encode() for n, marks in ((len(self.bytes_a), ",|"), (size, ",;")) for mark in marks for i in range(n)]
        self.names = np.array(names).view(np.uint8).reshape(len(names), -1)  # padded with zero bytes
        # No piece joins a letter with a space behind it, so what begins with spaces is encoded on its own.
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for i, p in enumerate(text) if not self.model.is_byte(i))
        self.chunk = re.compile(" +[^ ]*")
        self.chunks: dict[str, bytes] = {}

    @staticmethod
    def _byte_level(tokenizer) -> list[bytes]:
        """The bytes of every entry: printable bytes stand for themselves, the others for the letters from U+0100 on."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        out = []
        for i in range(tokenizer.get_vocab_size()):
            token = tokenizer.id_to_token(i)
            out.append(bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode())
        return out

    def ids_a(self, text: str):
        """The ids, or None where they do not spell the space and the text."""
        np, text = self.np, " " + text
        if self.fast is not None:
            try:
                ids = self.fast.encode_ordinary(text)
                return np.array(ids, dtype=np.int64) if self.fast.decode_bytes(ids) == text.encode() else None
            except ValueError:  # a run too long for its pattern engine
                pass
        ids = self.exact.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=np.int64) if b"".join([self.bytes_a[i] for i in ids]) == text.encode() else None

    def _ids_b(self, text: str) -> bytes | None:
        """The ids of a text behind one space, which the model adds itself; a lone space would be the empty text."""
        ids = self.model.encode(text[1:], num_threads=1) if text != " " else [self.model.piece_to_id(SPACE)]
        return self.np.array(ids, dtype="<u2").tobytes() if b"".join([self.bytes_b[i] for i in ids]) == text.encode() else None

    def ids_b(self, text: str):
        """The ids, or None where they do not spell the space and the text."""
        np, text = self.np, " " + text
        if not self.apart or SPACE in text:
            data = self._ids_b(text)
        else:
            known, parts = self.chunks, self.chunk.findall(text)
            try:
                data = b"".join([known[p] for p in parts])
            except KeyError:  # new chunks, or some that cannot be spelled and never enter
                new = {p for p in parts if p not in known}
                if len(known) + len(new) > CHUNKS:
                    known.clear()
                    new = set(parts)
                learned = {p: self._ids_b(p) for p in new}
                known.update((p, ids) for p, ids in learned.items() if ids is not None)
                data = None if None in learned.values() else b"".join([known[p] for p in parts])
        return None if data is None else np.frombuffer(data, dtype="<u2").astype(np.int64)

    def align(self, text: str | None):
        """``(ids a, ids b, a of each link, b of each link, a's of each group, b's of each group)``, or None without tokens.

        Both id sequences cover the same bytes. The ends of both, in order, cut the text into stretches; each stretch lies in
        one token of either side and is their link: two ranges overlap in one stretch only. The last two are running counts."""
        np = self.np
        if not text:
            return None
        a, b = self.ids_a(text), self.ids_b(text)
        if a is None or b is None:
            return None
        end_a, end_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        marks = np.zeros(int(end_a[-1]) + 1, dtype=np.int8)
        marks[end_a] = 1
        marks[end_b] += 2
        kinds = marks[np.flatnonzero(marks)]
        done_a, done_b, both = np.cumsum((kinds & 1) > 0), np.cumsum(kinds >= 2), kinds == 3
        return a, b, a[np.concatenate([[0], done_a[:-1]])], b[np.concatenate([[0], done_b[:-1]])], done_a[both], done_b[both]

    def groups(self, found) -> str:
        """``a1,a2|b1;a3|b2``: the ids of both sides by group."""
        np = self.np
        a, b, _, _, upto_a, upto_b = found
        size_a, size_b = len(self.bytes_a), len(self.bytes_b)
        code_a, code_b = a.copy(), b + 2 * size_a
        code_a[upto_a - 1] += size_a
        code_b[upto_b - 1] += size_b
        # A's of a group stand behind the B's of the groups before it, its B's behind its own A's too.
        per_a, per_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        codes[np.arange(len(a)) + np.repeat(upto_b - per_b, per_a)] = code_a
        codes[np.arange(len(b)) + np.repeat(upto_a, per_b)] = code_b
        text = self.names[codes]
        return text[text > 0].tobytes()[:-1].decode()


_OPEN: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker."""
    if (path_a, path_b) not in _OPEN:
        _OPEN[path_a, path_b] = Aligner(path_a, path_b)
    return _OPEN[path_a, path_b]


def pack_bitmap(docs, span: int) -> bytes:
    """Sorted document numbers of a range as the shorter of a bit string and a list of 16-bit numbers, behind a byte that tells which."""
    import numpy as np
    if 2 * len(docs) > (span + 7) // 8:
        bits = np.zeros(span, dtype=np.uint8)
        bits[docs] = 1
        return b"\1" + np.packbits(bits, bitorder="little").tobytes()
    return b"\0" + docs.astype("<u2").tobytes()


def unpack_bitmap(data: bytes):
    """The document numbers of a bitmap; their count is its popcount."""
    import numpy as np
    if data[:1] == b"\1":
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=1), bitorder="little"))
    return np.frombuffer(data, dtype="<u2", offset=1).astype(np.int64)


def popcount(data: bytes) -> int:
    return int.from_bytes(data[1:], "little").bit_count() if data[:1] == b"\1" else len(data) // 2


def pack_planes(docs, counts, span: int) -> list[bytes]:
    """Bit-sliced link counts, less one: plane k holds the documents whose count less one has bit k."""
    out, left = [], counts - 1
    while left.any():
        out.append(pack_bitmap(docs[(left & 1) > 0], span))
        left = left >> 1
    return out


def unpack_counts(docs, planes: list[bytes], span: int):
    import numpy as np
    counts = np.ones(span, dtype=np.int64)
    for k, plane in enumerate(planes):
        counts[unpack_bitmap(plane)] += 1 << k
    return counts[docs]


def _read(path_a: str, path_b: str, range_docs: int, range_pairs: int):
    """Documents to a row each (``a`` null) and, per range of document numbers, a row for each linked id pair."""
    def read(batches):
        import numpy as np
        import pyarrow as pa

        tool, base, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 32, 0
        docs: dict[str, list] = {n: [] for n in ("id", "doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        keys, owners, counts, held = [], [], [], 0
        kind = None

        def flush():
            nonlocal docs, keys, owners, counts, held, number
            n = len(docs["doc"])
            where = [base + number] * n
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.concat_arrays(docs["id"]) if docs["id"] else pa.array([], kind), pa.array(docs["doc"], pa.int32()),
                                              *(pa.array(docs[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(docs["groups_sha256"], pa.string()),
                                              *(pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary())))], names=NAMES)
            if keys:
                key, owner, count = np.concatenate(keys), np.concatenate(owners), np.concatenate(counts)
                order = np.argsort(key, kind="stable")  # document numbers rise within a pair
                key, owner, count = key[order], owner[order], count[order]
                begin = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
                for some in range(0, len(begin) - 1, 50_000):
                    edges = begin[some:some + 50_001].tolist()
                    first = key[edges[:-1]]
                    bitmaps, planes = [], []
                    for x, y in zip(edges, edges[1:]):
                        bitmaps.append(pack_bitmap(owner[x:y], n))
                        planes.append(pack_planes(owner[x:y], count[x:y], n))
                    m = len(first)
                    none = (pa.nulls(m, t) for t in (kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, base + number)), *none,
                                                      pa.array((first >> 32).astype(np.int32)), pa.array((first & 0xFFFFFFFF).astype(np.int32)), pa.array(np.full(m, n, dtype=np.int32)),
                                                      pa.array(bitmaps, pa.binary()), pa.array(planes, pa.list_(pa.binary()))], names=NAMES)
            docs, keys, owners, counts, held = {c: [] for c in docs}, [], [], [], 0
            number += 1

        for batch in batches:
            kind = batch.schema.field("id").type
            for at, text in enumerate(batch.column("text").to_pylist()):
                found, doc = tool.align(text), len(docs["doc"])
                docs["id"].append(batch.column("id").slice(at, 1))
                docs["doc"].append(doc)
                if found is None:
                    row = (0, 0, 0, 0, "")
                else:
                    a, b, link_a, link_b, upto, _ = found
                    row = (len(a), len(b), len(upto), len(link_a), hashlib.sha256(tool.groups(found).encode()).hexdigest())
                    key, count = np.unique((link_a << 32) | link_b, return_counts=True)
                    keys.append(key)
                    counts.append(count)
                    owners.append(np.full(len(key), doc, dtype=np.int64))
                    held += len(key)
                for c, v in zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256"), row):
                    docs[c].append(v)
                if doc + 1 >= range_docs or held >= range_pairs:
                    yield from flush()
        if docs["doc"]:
            yield from flush()
    return read


def _merge(batches):
    """Range bitmaps of pairs to document and link counts, one row per pair and batch."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        bitmaps, planes = batch.column("bitmap").to_pylist(), batch.column("planes").to_pylist()
        docs = np.array([popcount(x) for x in bitmaps], dtype=np.int64)
        links = docs + np.array([sum(popcount(p) << k for k, p in enumerate(x)) for x in planes], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(docs), pa.array(links)], names=["a", "b", "docs", "links"])


def _scores(batches):
    """Scored bitmaps, sorted by range: what every document of a range gets from its pairs. A range is added up as it streams by."""
    import numpy as np
    import pyarrow as pa

    span, best, total = None, None, None

    def close():
        rows = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), span)), pa.array(rows.astype(np.int32)), pa.array(best[rows]), pa.array(total[rows])], names=["span", "doc", "n_best", "count_sum"])

    for batch in batches:
        for at, width, bitmap, planes, count, top in zip(*(batch.column(c).to_pylist() for c in ("span", "width", "bitmap", "planes", "docs", "top"))):
            if at != span:
                if span is not None:
                    yield close()
                span, best, total = at, np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)
            docs = unpack_bitmap(bitmap)
            links = unpack_counts(docs, planes, width) if planes else 1
            total[docs] += count * links
            if count == top:
                best[docs] += links
    if span is not None:
        yield close()


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None,
                     range_docs: int = RANGE_DOCS, range_pairs: int = RANGE_PAIRS) -> tuple[DataFrame, DataFrame]:
    """``(documents, pairs)`` for the byte-level tokenizer A and the piece tokenizer B.

    ``documents``: a row per input row with ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``,
    ``groups_sha256``. ``pairs(a, b, docs, links, top)``: for each linked id pair how many documents hold it, how many links
    there are, and the highest document count of its ``a``. A null or empty text, or one whose tokens do not spell the
    space and the text, has no tokens: zeros and an empty digest. Null ids and repeated rows are documents of their own; other
    columns are ignored; an empty table gives no rows.

    Documents are numbered within ranges. A range keeps, per pair, a bitmap of the documents that link it and bit planes of
    how often each does. Ranges are disjoint, so a pair's bitmaps are merged by adding popcounts, partially per task; a pair
    that every document holds is one row per range. The counts then go back along the same postings, range by range.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    path = new_path(docs.sparkSession, "aligned")
    schema = (f"span long, id {kind}, doc int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, b int, width int, bitmap binary, planes array<binary>")
    read = rows.mapInArrow(_read(path_a or tokenizer_path(BYTES), path_b or tokenizer_path(PIECES), range_docs, range_pairs), schema)
    read.withColumn("posting", F.col("a").isNotNull()).write.partitionBy("posting").option("compression", "zstd").parquet(path)
    both = docs.sparkSession.read.schema(read.schema.add("posting", "boolean")).parquet(path)
    postings = both.filter("posting").select("span", "a", "b", "width", "bitmap", "planes")
    counted = postings.select("a", "b", "bitmap", "planes").mapInArrow(_merge, "a int, b int, docs long, links long")
    pairs = staged(counted.groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links")), "pairs")
    pairs = staged(pairs.join(pairs.groupBy("a").agg(F.max("docs").alias("top")), "a").select("a", "b", "docs", "links", "top"), "pairs-top")
    scored = postings.join(pairs.select("a", "b", "docs", "top").hint("merge"), ["a", "b"]).select("span", "width", "bitmap", "planes", "docs", "top")
    sums = scored.repartition("span").sortWithinPartitions("span").mapInArrow(_scores, "span long, doc int, n_best long, count_sum long")
    out = both.filter("NOT posting").join(sums, ["span", "doc"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), pairs
