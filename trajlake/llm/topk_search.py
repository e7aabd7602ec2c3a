"""Exact top-k inner products by block-at-a-time pruning: document-range blocks in order of their bound, scored until none can win."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

BLOCK, PIVOTS = 256, 64
#: Blocks and queries of one grid cell: what a task holds at a time.
CELL_BLOCKS, CELL_QUERIES = 128, 2048
#: Components up to this size are multiplied in double precision without rounding (products of 4,096 of them stay below 2^53).
EXACT = 2**20


def _quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.filter(fine).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(lists, width: int):
    import numpy as np

    out = np.zeros((len(lists), width), dtype=np.int64)
    for i, v in enumerate(lists):
        out[i, :len(v)] = v
    return out


def _near(pivots: list[list[int]], width: int):
    def near(batches):
        import numpy as np
        import pyarrow as pa

        centres = _matrix(pivots, width).astype(float)
        half = (centres**2).sum(axis=1) / 2
        for batch in batches:
            rows = _matrix(batch.column("v").to_pylist(), width).astype(float)
            at = (rows @ centres.T - half).argmax(axis=1) if len(rows) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(at.astype(np.int32))], names=["id", "v", "pivot"])
    return near


def _blocks(width: int, size: int):
    """Rows come sorted by pivot: consecutive ones form a block with its forward index, its largest and its smallest values."""
    def block(batches):
        import numpy as np
        import pyarrow as pa

        ids, rows = np.zeros(0, dtype=np.int64), np.zeros((0, width), dtype=np.int64)

        def out(n):
            some = rows[:n]
            return ids[:n].tobytes(), some.tobytes(), some.max(axis=0).tobytes(), some.min(axis=0).tobytes()

        for batch in batches:
            ids = np.concatenate([ids, batch.column("id").to_numpy()])
            rows = np.concatenate([rows, _matrix(batch.column("v").to_pylist(), width)])
            made = []
            while len(ids) >= size:
                made.append(out(size))
                ids, rows = ids[size:], rows[size:]
            yield _binary(made)
        yield _binary([out(len(ids))] if len(ids) else [])
    return block


def _binary(rows):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in range(4)], names=["ids", "forward", "high", "low"])


def _dot(left, right):
    import numpy as np

    if max(np.abs(left).max(initial=0), np.abs(right).max(initial=0)) <= EXACT and left.shape[1] <= 4096:
        return (left.astype(float) @ right.astype(float).T).astype(np.int64)
    return left @ right.T


def _best(scores, ids, k: int):
    """The k best by (score descending, id ascending)."""
    import numpy as np
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search_cell(queries, floors, blocks, k: int, width: int):
    """Best ``k`` of the blocks for each ``(query id, vector)``; ``floors`` holds scores that k other rows already reach.

    Blocks are visited by their upper bound, the sum over terms of the larger of query times block maximum and query times
    block minimum. Queries that still want the same block are scored together; a query stops at the first bound below its
    k-th score (an equal bound may still bring a smaller id)."""
    import numpy as np

    ids, vectors = queries
    high, low = np.array([b[2] for b in blocks]), np.array([b[3] for b in blocks])
    bounds = _dot(np.maximum(vectors, 0), high) + _dot(np.minimum(vectors, 0), low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in ids]
    floor, alive = floors.copy(), np.arange(len(ids))
    for step in range(len(blocks)):
        at = order[alive, step]
        keep = bounds[alive, at] >= floor[alive]
        alive, at = alive[keep], at[keep]
        if not len(alive):
            break
        for b in np.unique(at):
            rows = alive[at == b]
            names, forward = blocks[b][0], blocks[b][1]
            scores = _dot(vectors[rows], forward)
            for r, own in zip(rows, scores):
                hit = (own >= floor[r]) & (names != ids[r])
                if hit.any():
                    best[r] = _best(np.concatenate([best[r][0], own[hit]]), np.concatenate([best[r][1], names[hit]]), k)
                    if len(best[r][0]) == k:
                        floor[r] = max(floor[r], best[r][0][-1])
    return best


def _cell(k: int, width: int):
    def cell(left, right):
        import numpy as np
        import pandas as pd

        ints = lambda data: np.frombuffer(data, dtype=np.int64)
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        blocks = [(ints(i), ints(f).reshape(-1, width), ints(h), ints(s)) for i, f, h, s in zip(right["ids"], right["forward"], right["high"], right["low"])]
        found = search_cell((left["id"].to_numpy(), np.stack([ints(v) for v in left["v"]])), left["floor"].to_numpy(), blocks, k, width)
        sizes = [len(b[0]) for b in found]
        return pd.DataFrame({"query_id": np.repeat(left["id"].to_numpy(), sizes), "vec_id": np.concatenate([b[1] for b in found]), "score": np.concatenate([b[0] for b in found])})
    return cell


def topk_search(vectors: DataFrame, queries_every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
                block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best rows for every row whose id is divisible by ``queries_every``.

    Components become floor(``scale`` * x); the score is their inner product. Rows with a null id, a null vector or a null or
    non-finite component take no part. A shorter vector counts as zero where it ends, an empty one everywhere. Ties go to the
    smaller id, a query never finds its own id, fewer than ``k`` rows are all returned; rows that repeat an id and a vector
    count once. Other columns are ignored; an empty table gives no rows.

    Rows are dealt by their nearest pivot (a bounded sample) so that blocks are tight. Blocks and queries meet in a grid: a
    cell holds some blocks and some queries, both bounded, and every block meets every query in exactly one cell. A query's
    floor, the k-th best score among the pivots other than itself, prunes before the first block is scored. Only ``k`` rows
    per query leave a cell."""
    rows = _quantised(vectors, id_col, vector_col, scale).distinct()
    dealt = rows.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    width, total = max(dealt[0] or 1, 1), dealt[1]
    sample = rows.filter(F.pmod(F.xxhash64("id", "v"), F.lit(max(1, total // pivots))) == 0).limit(2 * pivots).collect()
    near = rows.mapInArrow(_near([r["v"] for r in sample] or [[0]], width), "id long, v array<long>, pivot int")
    parts = max(1, -(-total // (block * CELL_BLOCKS)))
    sort = near.repartitionByRange(parts, "pivot", F.xxhash64("id")).sortWithinPartitions("pivot", F.xxhash64("id"))
    blocks = staged(sort.mapInArrow(_blocks(width, block), "ids binary, forward binary, high binary, low binary").withColumn("r", F.spark_partition_id()), "blocks")
    wanted = rows.filter(F.pmod("id", F.lit(queries_every)) == 0)
    columns = max(1, -(-total // (queries_every * CELL_QUERIES)))

    def floors(batches):
        import numpy as np
        import pyarrow as pa

        known, names = _matrix([r["v"] for r in sample], width), np.array([r["id"] for r in sample], dtype=np.int64)
        for batch in batches:
            own, ids = _matrix(batch.column("v").to_pylist(), width), batch.column("id").to_numpy()
            scores = _dot(own, known)
            least = []
            for q, s in zip(ids, scores):
                others = np.sort(s[names != q])
                least.append(int(others[-k]) if len(others) >= k else -2**62)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([v.tobytes() for v in own], pa.binary()), pa.array(least, pa.int64())], names=["id", "v", "floor"])

    queries = staged(wanted.mapInArrow(floors, "id long, v binary, floor long").withColumn("c", F.pmod(F.xxhash64("id"), F.lit(columns)).cast("int")), "queries")
    left = queries.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = blocks.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    found = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInPandas(_cell(k, width), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
