"""Exact duplicates by skew-safe combining: local, then salted, then global, the full content compared at every stage."""
from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_space, staged

SALTS = 64
#: Characters of texts that a task holds for its local comparison; beyond that it starts anew, and the later stages merge.
LOCAL_CHARS = 48_000_000


def _seats(local_chars: int):
    """Local stage: the first row of every text in a task becomes its seat and keeps the text; copies name the seat."""
    def combine(batches):
        import pyarrow as pa

        base, row, held, seats = TaskContext.get().partitionId() << 40, 0, 0, {}
        for batch in batches:
            digests, texts = batch.column("digest").to_pylist(), batch.column("text").to_pylist()
            rows, of, kept = [], [], []
            for digest, text in zip(digests, texts):
                same = seats.setdefault(digest, [])
                seat = next((s for t, s in same if t == text), None)
                rows.append(base + row)
                kept.append(text if seat is None else None)
                if seat is None:
                    seat = base + row
                    same.append((text, seat))
                    held += len(text)
                of.append(seat)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), batch.column("id"), batch.column("digest"), pa.array(of, pa.int64()), pa.array(kept, pa.string())],
                                             names=["row", "id", "digest", "seat", "text"])
            if held > local_chars:
                held, seats = 0, {}
    return combine


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, local_chars: int = LOCAL_CHARS) -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they agree after every run of ASCII white space has become one space. A null text is the empty
    text; empty texts form a group like any other. The smallest id of a group stays; a null id stays only where all ids of
    its group are null. Of repeated rows with the smallest id exactly one stays. Other columns are ignored, whatever their
    names; an empty table gives no rows.

    The local stage leaves at most one row per text and task, so a text that a third of all rows share arrives at the
    shuffle as one row per task. Only digests that several tasks hold are compared further: their texts are merged per
    (digest, salt), then the salt winners per digest. The text is a grouping key in both, so a digest collision merges nothing.
    """
    rows = docs.select(F.col(id_col).alias("id"), one_space(F.col(text_col)).alias("text")).withColumn("digest", F.sha2("text", 256))
    kind = docs.schema[id_col].dataType.simpleString()
    local = staged(rows.mapInArrow(_seats(local_chars), f"row long, id {kind}, digest string, seat long, text string"), "exact")
    first = F.struct(F.col("id").isNull().alias("void"), "id", "row")
    seats = local.groupBy("seat", "digest").agg(F.min(first).alias("best"), F.count(F.lit(1)).alias("n"))
    several = seats.groupBy("digest").agg(F.count(F.lit(1)).alias("tasks")).filter("tasks > 1").select("digest")
    texts = local.filter(F.col("text").isNotNull()).select("seat", "digest", "text").join(several, "digest", "left_semi")
    open_ = staged(texts.join(seats.drop("digest"), "seat"), "exact-open")
    salted = open_.groupBy("digest", F.pmod(F.xxhash64("seat"), F.lit(salts)).alias("salt"), "text").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    groups = salted.groupBy("digest", "text").agg(F.min("best").alias("keep"), F.sum("n").alias("group_size"))
    merged = open_.select("seat", "digest", "text").join(groups, ["digest", "text"]).select("seat", "keep", "group_size")
    final = seats.join(merged, "seat", "left").select("seat", F.coalesce("keep", "best").alias("keep"), F.coalesce("group_size", "n").alias("group_size"))
    return (local.select("row", "id", "digest", "seat").join(final, "seat")
            .select(F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), F.col("digest").alias("text_sha256")))
