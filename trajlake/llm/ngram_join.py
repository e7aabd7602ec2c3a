"""Jaccard join on word n-grams by PartEnum: signatures over enumerated parts of a partitioned feature domain."""
from __future__ import annotations

import hashlib
from itertools import combinations

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .graph import asking_pairs, components

SIZE, SIMILAR, SALTS = 4, 85, 32
#: Sets up to this difference have one part with its subparts enumerated in pairs; beyond it parts are two or three subparts each.
ONE_PART = 6
#: Sets of a band that ends here or earlier have three subparts to a part, larger ones two.
THREE_PARTS = 256
#: Up to ``TINY`` nodes of components of at most ``SMALL`` in a bucket are paired; all else meets in cells of about ``CELL`` nodes a side.
SMALL, TINY, CELL = 8, 16, 512
#: Set digests a task remembers to name the first of equal sets.
SEEN = 2_000_000


def bands(similar: int, longest: int) -> list[tuple[int, int]]:
    """Size bands ``(least, most)``: similar sets lie in one band or in two that adjoin."""
    out, least = [], 1
    while not out or out[-1][1] < longest:
        out.append((least, 100 * least // similar))
        least = out[-1][1] + 1
    return out


def scheme(most: int, similar: int) -> tuple[int, int, int, int]:
    """``(parts, subparts, chosen, spare)`` for sets of at most ``most`` features.

    Similar sets of these sizes differ in at most k features. With (k // allowed) + 1 + spare parts, where a part allows
    ``subparts - chosen`` differences, more than ``spare`` parts differ in no more than that, and each of those agrees in
    some choice of ``chosen`` subparts."""
    k = 2 * most * (100 - similar) // (100 + similar)
    if k <= ONE_PART:
        return 1, k + 2, 2, 0
    subparts, chosen = (3, 2) if most <= THREE_PARTS else (2, 1)
    least = k // (subparts - chosen + 1) + 1
    spare = 1 + least // 32 if chosen == 2 else 4 + least // 64
    return least + spare, subparts, chosen, spare


class Signatures:
    def __init__(self, similar: int):
        import numpy as np
        self.np, self.similar, self.bands, self.schemes, self.starts = np, similar, [], {}, np.zeros(0, dtype=np.int64)

    def _mix(self, x, salt: int):
        np = self.np
        x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))

    def of(self, features):
        """64-bit signatures of a set of 64-bit features, in the scheme of its own size band and in that of the next.

        A choice of subparts without a feature says nothing. It is left out where no more than ``spare`` parts have such a
        choice: then a part is left in which a similar set agrees in features."""
        np, out = self.np, []
        if not len(self.bands) or self.bands[-1][1] < len(features):
            self.bands = bands(self.similar, len(features))
            self.starts = np.array([least for least, _ in self.bands])
        own = int(np.searchsorted(self.starts, len(features), side="right")) - 1
        if own + 1 == len(self.bands):
            least = self.bands[-1][1] + 1
            self.bands.append((least, 100 * least // self.similar))
            self.starts = np.append(self.starts, least)
        values = self._mix(features, 1)
        for band in (own, own + 1):
            if band not in self.schemes:
                parts, subparts, chosen, spare = scheme(self.bands[band][1], self.similar)
                picks = list(combinations(range(subparts), chosen))
                tags = self._mix(np.arange(parts * len(picks), dtype=np.uint64) + np.uint64(band << 32), 2).reshape(parts, len(picks))
                self.schemes[band] = parts, subparts, np.array(picks), spare, tags
            parts, subparts, picks, spare, tags = self.schemes[band]
            place = self._mix(features, 3 + band)
            seat = ((place % np.uint64(parts)) * np.uint64(subparts) + (place >> np.uint64(40)) % np.uint64(subparts)).astype(np.int64)
            sums = np.zeros(parts * subparts, dtype=np.uint64)
            np.add.at(sums, seat, values)
            filled = np.bincount(seat, minlength=parts * subparts).reshape(parts, subparts)[:, picks].sum(axis=2) > 0
            keys = self._mix(sums.reshape(parts, subparts)[:, picks].sum(axis=2, dtype=np.uint64) ^ tags, 4)
            out.append(keys[filled] if spare and (~filled).any(axis=1).sum() <= spare else keys.ravel())
        return np.concatenate(out)


_OPEN: dict[int, Signatures] = {}


class Grams:
    """Word n-grams of a text as 64-bit hashes.

    A word's hash is a polynomial over random values of its bytes, taken from running sums over the text, so that a text is
    hashed in a few passes over arrays. An n-gram mixes its words' hashes by position."""

    def __init__(self, size: int):
        import numpy as np
        self.np, self.size = np, size
        rng = np.random.default_rng(20240229)
        value = rng.integers(1, 2**63, 256, dtype=np.uint64)
        value[65:91] = value[97:123]  # A-Z count as a-z
        self.value, self.space = value, np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
        self.base, self.places = int(rng.integers(1, 2**62)) * 2 + 1, rng.integers(1, 2**62, max(size, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.inverse = pow(self.base, -1, 2**64)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _reach(self, n: int) -> None:
        np = self.np
        while len(self.powers) < n:
            at = len(self.powers)
            self.powers = np.concatenate([self.powers, self.powers * np.uint64(pow(self.base, at, 2**64))])
            self.inverses = np.concatenate([self.inverses, self.inverses * np.uint64(pow(self.inverse, at, 2**64))])

    @staticmethod
    def mix(x):
        import numpy as np
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def words(self, text: str | None):
        np = self.np
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        inside = np.concatenate([[False], ~self.space[raw], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edges[::2], edges[1::2]
        self._reach(len(raw) + 1)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.value[raw] * self.powers[:len(raw)], dtype=np.uint64)])
        return self.mix((sums[end] - sums[begin]) * self.inverses[begin] + (end - begin).astype(np.uint64))

    def features(self, text: str | None):
        """The distinct n-grams, sorted; a text with fewer words is one n-gram of them all."""
        np, words = self.np, self.words(text)
        if not len(words):
            return words
        n = min(self.size, len(words))
        total = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            total += words[i:len(words) - n + 1 + i] * self.places[i]
        return np.unique(self.mix(total))


def difference(a: int, b: int, similar: int) -> int:
    """How many features similar sets of these sizes differ in at most."""
    return (a + b) * (100 - similar) // (100 + similar)


def sketch_bits(n: int, similar: int) -> int:
    return 1 << max(6, (4 * difference(n, n, similar)).bit_length())


def sketch(features, similar: int) -> bytes:
    """Parities of the features that fall on each bit: sketches of two sets differ in no more bits than the sets in features."""
    import numpy as np
    bits = sketch_bits(len(features), similar)
    count = np.bincount((features >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(count.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer folded to the length of the shorter."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, m = 8 * len(a), 8 * len(b)
    while n != m:
        if n > m:
            n //= 2
            x = (x >> n) ^ (x & ((1 << n) - 1))
        else:
            m //= 2
            y = (y >> m) ^ (y & ((1 << m) - 1))
    return (x ^ y).bit_count()


def _packed(text: str | None) -> bytes:
    import zstandard
    return zstandard.compress((text or "").encode("utf-8", "surrogatepass"), 3)


def _text(packed: bytes) -> str:
    import zstandard
    return zstandard.decompress(packed).decode("utf-8", "surrogatepass")


_GRAMS: dict[int, Grams] = {}


def _grams(size: int) -> Grams:
    if size not in _GRAMS:
        _GRAMS[size] = Grams(size)
    return _GRAMS[size]


def _read(size: int, similar: int):
    def read(batches):
        import numpy as np
        import pyarrow as pa

        tool, base, row, seen = _grams(size), TaskContext.get().partitionId() << 40, 0, set()
        for batch in batches:
            counts, keys, first, sketches, packed = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                features = tool.features(text)
                counts.append(len(features))
                keys.append(hashlib.blake2b(features.tobytes(), digest_size=16).digest() if len(features) else None)
                first.append(len(features) > 0 and keys[-1] not in seen)
                sketches.append(sketch(features, similar) if first[-1] else None)
                packed.append(_packed(text) if first[-1] else None)
                seen.add(keys[-1])
            if len(seen) > SEEN:
                seen.clear()
            rows = np.arange(base + row, base + row + len(counts))
            row += len(counts)
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column("id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(first, pa.bool_()), pa.array(sketches, pa.binary()), pa.array(packed, pa.binary())],
                                             names=["row", "id", "n_shingles", "key", "first", "sketch", "text"])
    return read


def _sign(size: int, similar: int):
    def sign(batches):
        import numpy as np
        import pyarrow as pa

        tool, signer = _grams(size), _OPEN.setdefault(similar, Signatures(similar))
        for batch in batches:
            found, owners, held = [], [], 0
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
                found.append(signer.of(tool.features(_text(text))))
                owners.append(np.full(len(found[-1]), node))
                held += len(found[-1])
                if held > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(owners))], names=["bucket", "node"])
                    found, owners, held = [], [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(owners))], names=["bucket", "node"])
    return sign


def _close(similar: int):
    def close(batches):
        import pyarrow as pa

        for batch in batches:
            keep = [100 * min(n, m) >= similar * max(n, m) and sketch_distance(x, y) <= difference(n, m, similar)
                    for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "sketch_a", "sketch_b")))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return close


def _sets(size: int):
    def sets(batches):
        import pyarrow as pa

        tool = _grams(size)
        for batch in batches:
            found = pa.array([tool.features(_text(t)).astype("<u8").tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), found], names=["node", "features"])
    return sets


def _verify(similar: int):
    def verify(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for one, other in zip(batch.column("features_a").to_pylist(), batch.column("features_b").to_pylist()):
                a, b = np.frombuffer(one, dtype="<u8"), np.frombuffer(other, dtype="<u8")
                both = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= similar * max(len(a), len(b)) else 0
                keep.append(100 * both >= similar * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return verify


def overlaps(left, right, step: int = 4_000_000):
    """Intersection sizes of all left with all right sets, rows of ``len(right)`` at a time: ``(first left, matrix)``.

    The right features stand in one sorted list with their owners; a left feature meets only the sets that hold it."""
    import numpy as np
    values = np.concatenate(right)
    order = np.argsort(values, kind="stable")
    owners, values, width = np.repeat(np.arange(len(right)), [len(x) for x in right])[order], values[order], len(right)
    at = 0
    while at < len(left):
        spans, total, end = [], 0, at
        while end < len(left) and (end == at or total < step):
            low, high = np.searchsorted(values, left[end], side="left"), np.searchsorted(values, left[end], side="right")
            spans.append((low, high - low))
            total += int((high - low).sum())
            end += 1
        out = np.zeros((end - at, width), dtype=np.int64)
        for i, (low, n) in enumerate(spans):
            upto = np.cumsum(n)
            where = np.repeat(low - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)
            out[i] = np.bincount(owners[where], minlength=width)
        yield at, out
        at = end


def _ask(similar: int, ordered: bool):
    """Links of the nodes of a cell with members of other components: one per node and component is enough to join them."""
    def ask(left, right):
        import numpy as np
        import pandas as pd

        links: list[tuple[int, int]] = []
        if len(left) and len(right):
            sets = lambda frame: [np.frombuffer(x, dtype="<u8") for x in frame["features"]]
            mine, others = sets(left), sets(right)
            sizes, names, parts = np.array([len(x) for x in others]), right["node"].to_numpy(), right["component"].to_numpy()
            nodes, own = left["node"].to_numpy(), left["mine"].to_numpy()
            for first, both in overlaps(mine, others):
                for i, row in enumerate(both, first):
                    close = np.flatnonzero((100 * row >= similar * (len(mine[i]) + sizes - row)) & (parts != own[i]) & ((names < nodes[i]) | (not ordered)))
                    links += [(int(nodes[i]), int(names[m])) for m in close[np.unique(parts[close], return_index=True)[1]]]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")
    return ask


class _Nodes:
    """Nodes by number: sizes and sketches of all, full sets of those asked for."""

    def __init__(self, kinds: DataFrame, size: int, similar: int):
        self.kinds, self.size, self.similar = kinds, size, similar

    def sets(self, wanted: DataFrame) -> DataFrame:
        """``node, features`` for the distinct ``wanted(node)``; a written table, so a small one is broadcast and no text is shuffled."""
        texts = self.kinds.select("node", "text").join(staged(wanted.select("node").distinct(), "wanted"), "node")
        return staged(texts.mapInArrow(_sets(self.size), "node long, features binary"), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The ``pairs(a, b)`` whose full sets are similar. Sketches go first: a pair whose sketches differ in more bits than
        similar sets may differ in features is none. The set of ``a``, a leader of many, goes once to every (a, salt)."""
        short = lambda x: self.kinds.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
        salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))

        def with_ends(rows: DataFrame, end_a: DataFrame, end_b: DataFrame) -> DataFrame:
            rows = salted(rows)
            return rows.join(end_b, "b").join(rows.select("a", "salt").distinct().join(end_a, "a"), ["a", "salt"])

        both = with_ends(pairs, short("a"), short("b")).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
        close = staged(both.mapInArrow(_close(self.similar), "a long, b long"), "close")
        sets = self.sets(close.select(F.explode(F.array("a", "b")).alias("node")))
        full = lambda x: sets.select(F.col("node").alias(x), F.col("features").alias(f"features_{x}"))
        both = with_ends(close, full("a"), full("b")).select("a", "b", "features_a", "features_b")
        return staged(both.mapInArrow(_verify(self.similar), "a long, b long"), "links")

    def cells(self, left: DataFrame, right: DataFrame, key: str, grid: DataFrame, ask) -> DataFrame:
        """Every left row of a key meets every right row of it in one cell of the key's ``grid(key, rows, columns)``."""
        deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
        copy = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        one = left.join(grid, key).select(F.col(key).alias("key"), "node", "mine", deal("rows").alias("r"), copy("columns").alias("c"))
        two = right.join(grid, key).select(F.col(key).alias("key"), "node", "component", deal("columns").alias("c"), copy("rows").alias("r"))
        sets = self.sets(one.select("node").unionByName(two.select("node")))
        fresh = lambda df, *names: df.select(*(F.col(n).alias(n) for n in names))
        one = fresh(one.join(fresh(sets, "node", "features"), "node"), "key", "r", "c", "node", "mine", "features")
        two = fresh(two.join(fresh(sets, "node", "features"), "node"), "key", "r", "c", "node", "component", "features")
        return staged(one.groupBy("key", "r", "c").cogroup(two.groupBy("key", "r", "c")).applyInPandas(ask, "a long, b long"), "links")


def _remaining(buckets: DataFrame, parts: DataFrame, tried: DataFrame, nodes: _Nodes, small: int, tiny: int, cell: int) -> DataFrame:
    """Links between components that share a bucket and are still apart."""
    asks, members, crowd = asking_pairs(buckets, parts, small)
    x, y = (crowd.filter(F.col("m") <= tiny).select("bucket", F.col("node").alias(n), F.col("component").alias(f"c{n}")) for n in "xy")
    few = x.join(y, "bucket").filter("x < y AND cx <> cy").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    links = nodes.links(staged(few, "pairs"))
    grid = asks.groupBy("component", "n").agg(F.count(F.lit(1)).alias("asking"))
    grid = staged(grid.select("component", F.ceil(F.col("asking") / cell).alias("rows"), F.ceil(F.col("n") / cell).alias("columns")), "grid")
    links = links.unionByName(nodes.cells(asks.select("component", "node", "mine"), members, "component", grid, _ask(nodes.similar, False)))
    crowd = crowd.filter(F.col("m") > tiny)
    side = F.ceil(F.col("m") / cell)
    grid = staged(crowd.select("bucket", side.alias("rows"), side.alias("columns")).distinct(), "grid")
    crowd = crowd.select("bucket", "node", "component")
    return links.unionByName(nodes.cells(crowd.withColumnRenamed("component", "mine"), crowd, "bucket", grid, _ask(nodes.similar, True)))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similar: int = SIMILAR, small: int = SMALL, tiny: int = TINY, cell: int = CELL) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``component_id``.

    N-grams are ``size`` words (A-Z in lower case, ASCII white space apart). Texts without a word, and null texts, have none
    and are linked with nothing. Texts link when 100 * intersection >= ``similar`` * union on their full sets; n-grams
    are compared as 64-bit hashes. ``component_id`` is the smallest id reachable; a null id names a component only where all its
    ids are null. Repeated rows fall into one component; other columns are ignored; an empty table gives no rows.

    The first of equal sets in a task is a node, and those of several tasks are linked by their digest. Every similar pair of nodes shares a signature (``Signatures``); none is lost. Buckets
    of the same nodes count once. Members of a bucket are verified against its smallest, its largest and a random node;
    components that share a bucket and are still apart are held against each other in cells of bounded size.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    read = staged(rows.mapInArrow(_read(size, similar), f"row long, id {kind}, n_shingles long, key binary, first boolean, sketch binary, text binary"), "read")
    firsts = read.filter("first").select("key", F.col("row").alias("node"))
    classes = staged(firsts.groupBy("key").agg(F.min("node").alias("class")), "classes")
    same = firsts.join(classes, "key").filter("node <> class").select(F.col("class").alias("a"), F.col("node").alias("b"))
    kinds = read.filter("first").select(F.col("row").alias("node"), "n_shingles", "sketch", "text")
    signed = kinds.select("node", "text").mapInArrow(_sign(size, similar), "bucket long, node long")
    # Buckets of the same nodes are one: the bucket's name becomes a hash of its members.
    bucket = Window.partitionBy("bucket")
    shared = signed.select("node", F.count(F.lit(1)).over(bucket).alias("n"), F.bit_xor(F.xxhash64("node")).over(bucket).alias("bucket"))
    buckets = staged(shared.filter("n > 1").select("bucket", "node").distinct(), "buckets")
    # Only nodes that share a bucket are ever compared: their texts are moved once, and later joins read no others.
    nodes = _Nodes(staged(kinds.join(buckets.select("node").distinct(), "node"), "kinds"), size, similar)
    some = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.min(F.struct(F.xxhash64("node").alias("x"), "node")).alias("third"))
    leaders = buckets.join(some, "bucket").select("node", F.explode(F.array("low", "high", "third.node")).alias("leader")).filter("node <> leader")
    tried = staged(leaders.select(F.greatest("node", "leader").alias("b"), F.least("node", "leader").alias("a")).distinct(), "pairs")
    links = staged(nodes.links(tried).unionByName(same), "links")
    # With its smallest and largest every pair of up to three nodes is tried; larger buckets may hold untried ones.
    larger = staged(buckets.join(some.filter("n > 3").select("bucket"), "bucket"), "larger")
    links = links.unionByName(_remaining(larger, components(links), tried, nodes, small, tiny, cell))
    parts = components(links)
    placed = classes.join(parts.withColumnRenamed("id", "class"), "class", "left").select("key", F.coalesce("component", "class").alias("part"))
    members = staged(read.select("row", "id", "n_shingles", "key").join(placed, "key", "left"), "members")
    lowest = members.filter("part IS NOT NULL").groupBy("part").agg(F.min("id").alias("component_id"))
    out = members.join(lowest, "part", "left").withColumn("component_id", F.when(F.col("part").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id")
