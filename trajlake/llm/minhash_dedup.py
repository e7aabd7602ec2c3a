"""MinHash near-duplicates with sequential Bayesian verification of banded candidates."""
from __future__ import annotations

import hashlib
from math import comb

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .graph import asking_pairs, components, leader_pairs

HASHES, ROWS, STEP = 128, 5, 32
#: Posterior probability below which a pair is given up: the chosen miss probability of a comparison step.
MISS = 1e-5
SIMILAR = 80
SALTS = 32
#: Up to ``TINY`` nodes of components of at most ``SMALL`` in a bucket are paired; all else meets in cells of about ``CELL`` nodes a side.
SMALL, TINY, CELL = 8, 16, 1024
#: Words whose numbers a Python worker keeps.
WORDS = 1_500_000


class _Shingles:
    """Exact shingle sets of texts as sorted pairs of word numbers, and 64-bit hashes of the same shingles."""

    def __init__(self, size: int):
        import numpy as np
        import xxhash

        self.np, self.size, self.hash = np, size, xxhash.xxh3_64_intdigest
        self.numbers: dict[bytes, int] = {}
        self.hashes = np.zeros(1 << 16, dtype=np.uint64)

    def words(self, text: str | None):
        np, numbers = self.np, self.numbers
        words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
        if len(numbers) > WORDS:
            numbers.clear()
        new = [w for w in dict.fromkeys(words) if w not in numbers]
        if new:
            at = len(numbers)
            while at + len(new) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.hashes[at:at + len(new)] = [self.hash(w) for w in new]
            numbers.update(zip(new, range(at, at + len(new))))
        return np.array([numbers[w] for w in words], dtype=np.int64)

    def sets(self, text: str | None):
        """The distinct shingles as rows of word numbers; a text with fewer words than a shingle is one shingle of them all."""
        np, ids = self.np, self.words(text)
        if not len(ids):
            return np.zeros((0, self.size), dtype=np.int64)
        if len(ids) < self.size:
            return np.concatenate([ids, np.full(self.size - len(ids), -1)])[None, :]
        rows = np.lib.stride_tricks.sliding_window_view(ids, self.size)
        if self.size == 2:
            keys = np.unique((rows[:, 0] << 32) | rows[:, 1])
            return np.stack([keys >> 32, keys & 0xFFFFFFFF], axis=1)
        return np.unique(rows, axis=0)

    def hashed(self, rows):
        np = self.np
        out = np.full(len(rows), 0x9E3779B97F4A7C15, dtype=np.uint64)
        for column in rows.T:
            word = np.where(column >= 0, self.hashes[np.maximum(column, 0)], np.uint64(0x5851F42D4C957F2D))
            out = (out ^ word) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
            out *= np.uint64(0x94D049BB133111EB)
            out ^= out >> np.uint64(32)
        return out


_OPEN: dict[int, _Shingles] = {}


def _shingles(size: int) -> _Shingles:
    if size not in _OPEN:
        _OPEN[size] = _Shingles(size)
    return _OPEN[size]


def _family(hashes: int):
    import numpy as np
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, hashes, dtype=np.uint64)


def _sign(size: int, hashes: int):
    def sign(batches):
        import numpy as np
        import pyarrow as pa

        tool, (a, b) = _shingles(size), _family(hashes)
        base, row = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            counts, keys, signatures = [], [], []
            for text in batch.column("text").to_pylist():
                sets = tool.sets(text)
                counts.append(len(sets))
                if not len(sets):
                    keys.append(None)
                    signatures.append(None)
                    continue
                hashed = np.sort(tool.hashed(sets))
                keys.append(hashlib.blake2b(hashed.tobytes(), digest_size=16).digest())
                best = np.full(hashes, 2**32 - 1, dtype=np.uint64)
                for at in range(0, len(hashed), 4096):
                    best = np.minimum(best, ((hashed[at:at + 4096, None] * a + b) >> np.uint64(32)).min(axis=0))
                signatures.append(best.astype("<u4").tobytes())
            rows = np.arange(base + row, base + row + len(counts))
            row += len(counts)
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column("id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), batch.column("text")],
                                             names=["row", "id", "n_shingles", "key", "signature", "text"])
    return sign


def _matrix(column):
    import numpy as np
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(len(column), -1)


def _bands(rows_per_band: int):
    def band(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            signatures = _matrix(batch.column("signature")).astype(np.uint64) if batch.num_rows else np.zeros((0, rows_per_band), dtype=np.uint64)
            bands = signatures.shape[1] // rows_per_band
            out = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(signatures), 1))
            for i in range(rows_per_band):
                out = (out ^ signatures[:, i:bands * rows_per_band:rows_per_band]) * np.uint64(0xD6E8FEB86659FD93)
                out ^= out >> np.uint64(32)
            node = np.repeat(batch.column("node").to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(out.astype(np.int64, copy=False).ravel() if out.dtype == np.int64 else out.view(np.int64).ravel()), pa.array(node)], names=["bucket", "node"])
    return band


def fewest_matches(similar: int = SIMILAR, hashes: int = HASHES, step: int = STEP, miss: float = MISS) -> dict[int, int]:
    """By number of compared hashes: the fewest matches at which the posterior of ``similarity >= similar / 100`` (uniform prior) is at least ``miss``."""
    out, t = {}, similar / 100
    for n in range(step, hashes + 1, step):
        below = lambda m: sum(comb(n + 1, j) * t**j * (1 - t)**(n + 1 - j) for j in range(m + 1, n + 2))  # noqa: B023, E731  P(s < t)
        out[n] = next(m for m in range(n + 1) if 1 - below(m) >= miss)
    return out


def _compare(needed: dict[int, int]):
    def compare(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = _matrix(batch.column("sig_a")), _matrix(batch.column("sig_b"))
            alive, matches, before = np.arange(len(left)), np.zeros(len(left), dtype=np.int64), 0
            for n, least in needed.items():
                matches[alive] += (left[alive, before:n] == right[alive, before:n]).sum(axis=1)
                alive, before = alive[matches[alive] >= least], n
            keep = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])
    return compare


def _verify(size: int, similar: int):
    def verify(batches):
        import pyarrow as pa

        tool, last = _shingles(size), (None, frozenset())
        for batch in batches:
            a, b, out = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for i, (one, other) in enumerate(zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())):
                before = len(tool.numbers)
                if last[0] != a[i]:
                    last = (a[i], frozenset(map(tuple, tool.sets(one).tolist())))
                second = frozenset(map(tuple, tool.sets(other).tolist()))
                if len(tool.numbers) < before:  # numbers started anew: both sides need the new ones
                    last, second = (a[i], frozenset(map(tuple, tool.sets(one).tolist()))), frozenset(map(tuple, tool.sets(other).tolist()))
                both = len(last[1] & second)
                if 100 * both >= similar * (len(last[1]) + len(second) - both):
                    out.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in out], pa.int64()), pa.array([b[i] for i in out], pa.int64())], names=["a", "b"])
    return verify


def _links(pairs: DataFrame, nodes: DataFrame, size: int, similar: int, needed: dict[int, int]) -> DataFrame:
    """The pairs that pass the sequential comparison and then the exact one on full sets.

    The text of ``a`` (a leader of many pairs) goes once to every (a, salt), not once to every pair."""
    spread = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))

    def with_ends(rows: DataFrame, column: str, name: str) -> DataFrame:
        ends = rows.select("a", "salt").distinct().join(nodes.select(F.col("node").alias("a"), F.col(column).alias(f"{name}_a")), "a")
        return rows.join(nodes.select(F.col("node").alias("b"), F.col(column).alias(f"{name}_b")), "b").join(ends, ["a", "salt"])

    close = staged(with_ends(spread, "signature", "sig").select("a", "b", "sig_a", "sig_b").mapInArrow(_compare(needed), "a long, b long"), "close")
    close = close.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    return staged(with_ends(close, "text", "text").select("a", "b", "text_a", "text_b").mapInArrow(_verify(size, similar), "a long, b long"), "links")


def _ask(size: int, similar: int, needed: dict[int, int], ordered: bool):
    """Nodes of a cell against members of other components: sequential comparison, then exact sets from the likeliest on.

    One link per node and component is enough. ``ordered``: both sides are alike, and a node looks at smaller ones only."""
    def ask(left, right):
        import numpy as np
        import pandas as pd

        links: list[tuple[int, int]] = []
        if len(left) and len(right):
            tool = _Shingles(size)
            stack = lambda frame: np.frombuffer(b"".join(frame["signature"]), dtype="<u4").reshape(len(frame), -1)
            members, names, texts, parts = stack(right), right["node"].to_numpy(), right["text"].to_list(), right["component"].to_numpy()
            sets: dict[int, frozenset] = {}
            exact = lambda text: frozenset(map(tuple, tool.sets(text).tolist()))
            for node, mine, signature, text in zip(left["node"], left["mine"], stack(left), left["text"]):
                alive = np.flatnonzero((parts != mine) & ((names < node) | (not ordered)))
                matches, before = np.zeros(len(members), dtype=np.int64), 0
                for n, least in needed.items():
                    matches[alive] += (members[alive, before:n] == signature[before:n]).sum(axis=1)
                    alive, before = alive[matches[alive] >= least], n
                if not len(alive):
                    continue
                if len(tool.numbers) > WORDS // 2:  # no renumbering while sets are held
                    tool, sets = _Shingles(size), {}
                own, done, wanted = exact(text), set(), len(np.unique(parts[alive]))
                for m in alive[np.argsort(-matches[alive], kind="stable")].tolist():
                    if parts[m] in done:
                        continue
                    if m not in sets:
                        sets[m] = exact(texts[m])
                    both = len(own & sets[m])
                    if 100 * both >= similar * (len(own) + len(sets[m]) - both):
                        links.append((int(node), int(names[m])))
                        done.add(parts[m])
                        if len(done) == wanted:
                            break
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")
    return ask


def _cells(left: DataFrame, right: DataFrame, key: str, grid: DataFrame, nodes: DataFrame, ask) -> DataFrame:
    """Every left row of a key meets every right row of it in one cell of the key's ``grid(key, rows, columns)``."""
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    slot = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    mine = "component" if key == "bucket" else "mine"

    def side(rows: DataFrame, component: str, own: str, spread: str, name: str) -> DataFrame:
        ends = nodes.select(*(F.col(x).alias(x) for x in ("node", "signature", "text")))
        dealt = rows.join(grid, key).select(F.col(key).alias("key"), "node", F.col(component).alias(name), slot(own).alias("r" if own == "rows" else "c"), upto(spread).alias("c" if own == "rows" else "r"))
        return dealt.join(ends, "node").select(*(F.col(x).alias(x) for x in ("key", "r", "c", "node", name, "signature", "text")))

    cells = side(left, mine, "rows", "columns", "mine").groupBy("key", "r", "c").cogroup(side(right, "component", "columns", "rows", "component").groupBy("key", "r", "c"))
    return staged(cells.applyInPandas(ask, "a long, b long"), "links")


def _remaining_links(buckets: DataFrame, parts: DataFrame, tried: DataFrame, nodes: DataFrame, size: int, similar: int, needed: dict[int, int], small: int, tiny: int) -> DataFrame:
    """Links between components that share a bucket: one per asking node and component is enough to join them."""
    asks, members, crowd = asking_pairs(buckets, parts, small)
    x, y = (crowd.filter(F.col("m") <= tiny).select("bucket", F.col("node").alias(n), F.col("component").alias(f"c{n}")) for n in "xy")
    few = x.join(y, "bucket").filter("x < y AND cx <> cy").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    links = _links(staged(few, "pairs"), nodes, size, similar, needed)
    grid = asks.groupBy("component", "n").agg(F.count(F.lit(1)).alias("asking"))
    grid = staged(grid.select("component", F.ceil(F.col("asking") / CELL).alias("rows"), F.ceil(F.col("n") / CELL).alias("columns")), "grid")
    links = links.unionByName(_cells(asks.select("component", "node", "mine"), members, "component", grid, nodes, _ask(size, similar, needed, False)))
    crowd = crowd.filter(F.col("m") > tiny)
    side = F.ceil(F.col("m") / CELL)
    grid = staged(crowd.select("bucket", side.alias("rows"), side.alias("columns")).distinct(), "grid")
    crowd = crowd.select("bucket", "node", "component")
    return links.unionByName(_cells(crowd, crowd, "bucket", grid, nodes, _ask(size, similar, needed, True)))


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similar: int = SIMILAR, hashes: int = HASHES,
                  rows_per_band: int = ROWS, miss: float = MISS, small: int = SMALL, tiny: int = TINY) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``component_id``, ``kept``, ``text_key`` (xxhash64 of the text).

    Shingles are ``size`` words (A-Z in lower case, ASCII white space apart). Texts without a word, and null texts, have
    none and stay alone. Two texts are linked when 100 * intersection >= ``similar`` * union on their full sets; the smallest
    id of a component is its ``component_id`` and stays. Null ids never name a component unless they are its only ids;
    repeated rows fall into one component and all carry its name. Other columns are ignored; an empty table gives no rows.

    Equal sets become one node first (128-bit digest of the sorted set), so copies never pair up. Banding brings candidates;
    every member of a bucket is compared with three leaders of it; components that share a bucket and are still apart are then
    held against each other, the smaller one's members of that bucket against all of the larger one. A pair is
    compared ``STEP`` hashes at a time and given up once the posterior of the similarity falls below ``miss``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = staged(rows.mapInArrow(_sign(size, hashes), f"row long, id {kind}, n_shingles long, key binary, signature binary, text string"), "signed")
    classes = staged(signed.filter("key IS NOT NULL").groupBy("key").agg(F.min("row").alias("node")), "classes")
    seats = classes.select(F.col("node").alias("row"))
    signatures = staged(signed.select("row", "signature").join(seats, "row").select(F.col("row").alias("node"), "signature"), "signatures")
    banded = signatures.mapInArrow(_bands(rows_per_band), "bucket long, node long")
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    buckets = staged(banded.join(shared, "bucket"), "buckets")
    wanted = buckets.select(F.col("node").alias("row")).distinct()
    nodes = staged(signed.select("row", "signature", "text").join(wanted, "row").withColumnRenamed("row", "node"), "nodes")
    needed = fewest_matches(similar, hashes, STEP, miss)
    tried = staged(leader_pairs(buckets), "pairs")
    links = _links(tried, nodes, size, similar, needed)
    links = links.unionByName(_remaining_links(buckets, components(links), tried, nodes, size, similar, needed, small, tiny))
    parts = components(links)
    placed = classes.join(parts.withColumnRenamed("id", "node"), "node", "left").select("key", F.coalesce("component", "node").alias("part"))
    members = staged(signed.select("row", "id", "n_shingles", "key", F.xxhash64("text").alias("text_key")).join(placed, "key", "left"), "members")
    lowest = members.filter("part IS NOT NULL").groupBy("part").agg(F.min("id").alias("component_id"))
    out = members.join(lowest, "part", "left").withColumn("component_id", F.when(F.col("part").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``minhash_dedup`` keeps, with all their columns: one id of every component, and all texts without a word."""
    gone = minhash_dedup(docs, id_col, text_col, **options).filter("NOT kept").select(F.col(id_col).alias("__id"), F.col("text_key").alias("__key"))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]) & (F.xxhash64(docs[text_col]) == gone["__key"]), "left_anti")
