"""Token sequences in training order: a keyed Feistel permutation gives every sequence a slot, range partitions write fixed-stride shards."""
from __future__ import annotations

import posixpath
import struct

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, staged
from .word_ids import tokenizer_path

BYTE_BPE, END_ID = "byte_bpe_50k.tiktoken", 50256
STRIDE, SHARD, ROUNDS, KEY = 256, 65_536, 6, 0x5DEECE66D
#: Record header: document id, sequence number in the document, tokens in the record; a negative count marks a null id.
HEAD = "<qii"
_OPEN: dict[str, object] = {}


def _encoding(path: str):
    if path not in _OPEN:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _OPEN[path] = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _OPEN[path]


def slots(index, size: int, key: int = KEY, rounds: int = ROUNDS):
    """A keyed permutation of 0..size-1: a balanced Feistel network on the next even power of two, walked until the value is inside."""
    import numpy as np

    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    x = np.asarray(index).astype(np.uint64)
    out, open_ = x.copy(), np.ones(len(x), dtype=bool)
    while open_.any():
        left, right = out[open_] >> shift, out[open_] & mask
        for r in range(rounds):
            f = (right + np.uint64((key + r * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(27)
            f *= np.uint64(0x94D049BB133111EB)
            f ^= f >> np.uint64(31)
            left, right = right, left ^ (f & mask)
        out[open_] = left << shift | right
        open_ = out >= size
    return out.astype(np.int64)


def _tokens(batches, path: str, end_id: int):
    import numpy as np
    encoding = _encoding(path)
    for batch in batches:
        for row_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            yield row_id, np.array([*encoding.encode_ordinary(text or ""), end_id], dtype="<u2")


def _sizes(path: str, end_id: int, stride: int):
    def sizes(batches):
        import pyarrow as pa
        n = sum(-(-len(ids) // stride) for _, ids in _tokens(batches, path, end_id))
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [n]}, schema=pa.schema([("part", pa.int32()), ("n", pa.int64())]))
    return sizes


def _records(path: str, end_id: int, stride: int, first: dict[int, int], size: dict[int, int], total: int, key: int):
    def records(batches):
        import numpy as np
        import pyarrow as pa

        part = TaskContext.get().partitionId()
        at, made = first.get(part, 0), []

        def out():
            place = slots(np.arange(at - len(made), at), total, key)
            return pa.RecordBatch.from_arrays([pa.array(place), pa.array(made, pa.binary())], names=["slot", "record"])

        for row_id, ids in _tokens(batches, path, end_id):
            for number, begin in enumerate(range(0, len(ids), stride)):
                some = ids[begin:begin + stride]
                made.append(struct.pack(HEAD, row_id or 0, number, -len(some) if row_id is None else len(some)) + some.tobytes() + bytes(2 * (stride - len(some))))
                at += 1
            if len(made) >= 8192:
                yield out()
                made = []
        yield out()
        if at - first.get(part, 0) != size.get(part, 0):
            raise ValueError("the input was split otherwise than when it was counted; write it to a table first")
    return records


def _writer(folder: str, stride: int, shard: int):
    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        attempt, out, now, begun, count, done = TaskContext.get().taskAttemptId(), None, None, 0, 0, []

        def close():
            out.close()
            store.move(posixpath.join(root, f".{now:08d}-{attempt}"), posixpath.join(root, f"shard-{now:08d}.bin"))
            done.append((now, f"{folder}/shard-{now:08d}.bin", begun, count))

        for batch in batches:
            for slot, record in zip(batch.column("slot").to_pylist(), batch.column("record").to_pylist()):
                if now != slot // shard:
                    if out is not None:
                        close()
                    now, begun, count = slot // shard, slot, 0
                    out = store.open_output_stream(posixpath.join(root, f".{now:08d}-{attempt}"), compression=None)
                out.write(record)
                count += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"shard": [d[0] for d in done], "path": [d[1] for d in done], "first_slot": [d[2] for d in done], "records": [d[3] for d in done]},
                                         schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("first_slot", pa.int64()), ("records", pa.int64())]))
    return write


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", stride: int = STRIDE, shard: int = SHARD, key: int = KEY,
                 path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write all sequences below ``folder`` and return the manifest ``shard, path, first_slot, records``.

    A document is its byte-level ids and ``end_id``, cut every ``stride`` ids; the last sequence is padded with zeros and its
    header holds the true length, so a null or empty text is one sequence. Ids must be integers; null ids are marked.
    Repeated rows are documents of their own, other columns are ignored, an empty table writes no shard.

    Sequences are numbered in scan order. The first pass counts them per input split, one number each; the second knows where
    its split begins, permutes the numbers and sends each record straight to its shard: only records are shuffled, once. A
    shard is sorted by slot, written under the attempt's name and then renamed, so a repeated task writes the same file.
    """
    path = path or tokenizer_path(BYTE_BPE)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = {r["part"]: r["n"] for r in rows.mapInArrow(_sizes(path, end_id, stride), "part int, n long").collect()}
    first, total = {}, 0
    for part in sorted(size):
        first[part], total = total, total + size[part]
    records = rows.mapInArrow(_records(path, end_id, stride, first, size, max(total, 1), key), "slot long, record binary")
    placed = records.repartitionById(max(1, -(-total // shard)), F.expr(f"cast(slot div {shard} as int)")).sortWithinPartitions("slot")
    return staged(placed.mapInArrow(_writer(folder, stride, shard), "shard long, path string, first_slot long, records long"), "shards")


def _reader(start: int, stop: int | None, stride: int, chunk: int = 4096):
    def read(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        width = struct.calcsize(HEAD) + 2 * stride
        form = np.dtype([("id", "<i8"), ("sequence", "<i4"), ("length", "<i4"), ("ids", f"V{2 * stride}")])
        for batch in batches:
            for row in batch.to_pylist():
                at = max(row["first_slot"], start)
                end = row["first_slot"] + row["records"] if stop is None else min(row["first_slot"] + row["records"], stop)
                if at >= end:
                    continue
                store, name = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(name) as file:
                    file.seek((at - row["first_slot"]) * width)
                    while at < end:
                        got = np.frombuffer(file.read(min(chunk, end - at) * width), dtype=form)
                        length = np.abs(got["length"])
                        ids = [x.tobytes()[:2 * n] for x, n in zip(got["ids"], length.tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(got))), pa.array(np.full(len(got), row["shard"])), pa.array(got["id"].copy(), mask=got["length"] < 0),
                                                          pa.array(got["sequence"].copy()), pa.array(length), pa.array(ids, pa.binary())], names=["slot", "shard", "id", "sequence", "length", "ids"])
                        at += len(got)
    return read


def read_shards(manifest: DataFrame, start: int = 0, stop: int | None = None, id_col: str = "doc_id", stride: int = STRIDE) -> DataFrame:
    """``slot, shard, id_col, sequence, length, ids`` (little-endian 16-bit) from slot ``start`` on: a seek in one shard, then sequential reads."""
    spark: SparkSession = manifest.sparkSession
    wanted = manifest.filter(F.col("first_slot") + F.col("records") > start)
    wanted = wanted if stop is None else wanted.filter(F.col("first_slot") < stop)
    files = wanted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")
    return files.mapInArrow(_reader(start, stop, stride), f"slot long, shard long, {id_col} long, sequence int, length int, ids binary")


def training_order(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the shards below ``folder`` (the shared folder if None) and read them back in slot order."""
    manifest = write_shards(docs, folder or new_path(docs.sparkSession, "tokens"), **options)
    return read_shards(manifest, id_col=options.get("id_col", "doc_id"), stride=options.get("stride", STRIDE))
