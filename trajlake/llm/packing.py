"""Shortest-pack-first packing over the length histogram: patterns are planned from counts, documents meet them by rank."""
from __future__ import annotations

import heapq
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .word_ids import tokenizer_path, word_ids

MAX_TOKENS, END_ID, SALTS = 2048, 1, 64


def plan_patterns(histogram: dict[int, int], max_tokens: int) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, how many packs)``: lengths are placed longest first, each into the shortest open packs that hold it.

    Works on counts alone: a step moves as many packs as the length and the pattern both have. When no open pack has room,
    new packs open. Its cost depends on the number of lengths, not on the number of documents."""
    open_packs: list[tuple[int, int, tuple[int, ...], int]] = []
    serial = 0
    for length in sorted(histogram, reverse=True):
        left, moved = histogram[length], []
        while left:
            if open_packs and -open_packs[0][0] >= length:
                space, _, pattern, count = heapq.heappop(open_packs)
                n = min(left, count)
                if count > n:
                    heapq.heappush(open_packs, (space, serial, pattern, count - n))
                    serial += 1
                space = -space - length
            else:
                pattern, n, space = (), left, max_tokens - length
            heapq.heappush(open_packs, (-space, serial, (*pattern, length), n))
            serial += 1
            left -= n
    return [(pattern, count) for _, _, pattern, count in sorted(open_packs, key=lambda p: (p[2], p[1]))]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """By length, in rank order: ``(first rank, first sequence, offset)``; ranks from there on take the following sequences."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rank = taken.get(length, 0)
            out.setdefault(length, []).append((rank, sequence, offset))
            taken[length] = rank + count
            offset += length
        sequence += count
    return out


def _pieces(path: str, max_tokens: int, end_id: int, with_ids: bool):
    def cut(batches):
        import pyarrow as pa

        words, end = word_ids(path), end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for at, text in enumerate(batch.column("text").to_pylist()):
                ids = words.encode(text or "") + end
                for start in range(0, len(ids), 4 * max_tokens):
                    piece = ids[start:start + 4 * max_tokens]
                    for column, value in zip(rows, (at, start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece if with_ids else None)):
                        column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            at, *rest = (pa.array(c, k) for c, k in zip(rows, kinds))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), *rest], names=["id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
    return cut


def _place(found: dict[int, list[tuple[int, int, int]]]):
    def place(batches):
        import numpy as np
        import pyarrow as pa

        tables = {length: np.array(rows, dtype=np.int64).T for length, rows in found.items()}
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for one in np.unique(length):
                rows = np.flatnonzero(length == one)
                first, start, at = tables[int(one)]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = start[k] + rank[rows] - first[k], at[k]
            keep = [i for i, n in enumerate(batch.schema.names) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)],
                                             names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])
    return place


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = END_ID,
         path: str | None = None, with_ids: bool = False, salts: int = SALTS) -> DataFrame:
    """One row per piece: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, and with
    ``with_ids`` the piece's little-endian 32-bit ``ids``.

    A document is its token ids and ``end_id``; a null or empty text is that id alone. Documents over ``max_tokens`` are cut
    into full pieces and a rest, nothing is dropped. Null ids and repeated rows are documents of their own; other columns are
    ignored; an empty table gives no rows. Every sequence fills from offset 0 without gaps; only its end may be padded.

    The plan is made from the histogram of piece lengths (``max_tokens`` numbers at most, whatever the input). Pieces meet it
    by their rank among those of their length. Ranks are counted per (length, salt), so a length that many pieces share is
    spread over ``salts`` tasks or as many as there are shuffle partitions.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = staged(rows.mapInArrow(_pieces(path or tokenizer_path(), max_tokens, end_id, with_ids),
                                    f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"), "pieces")
    salts = max(salts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    cell = Window.partitionBy("length", "salt").orderBy("id", "start", "ids_crc32")
    ranked = (salted.withColumn("own", F.row_number().over(cell)).join(before, ["length", "salt"])
              .withColumn("rank", F.col("before") + F.col("own") - 1).drop("before", "own", "salt"))
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, {'ids binary, ' if with_ids else ''}sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(_place(slots(plan_patterns(histogram, max_tokens))), schema).withColumnRenamed("id", id_col)
