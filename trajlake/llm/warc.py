"""WARC archives without repeated payloads: headers meet by payload digest, copies become revisit records of one response."""
from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, staged

MIN_BYTES = 1000
ROLL_BYTES = 64_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """One row per id and payload digest: ``id``, ``sha1``, ``sha256``, ``payload_bytes``, ``refers_to`` (null: a response), ``first_url``.

    Equal means the same SHA-1, SHA-256 and size. Only these headers are shuffled; the largest id of a digest is found by a
    partial maximum, so a payload that a third of all pages share costs one row per task."""
    html = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    heads = pages.select(F.col(id_col).alias("id"), F.sha1(html).alias("sha1"), F.sha2(html, 256).alias("sha256"), F.length(html).cast("long").alias("payload_bytes"), F.col(url_col).alias("url"))
    digest = ["sha1", "sha256", "payload_bytes"]
    heads = heads.groupBy("id", *digest).agg(F.max("url").alias("url"))
    first = heads.filter(F.col("payload_bytes") >= min_bytes).groupBy(*digest).agg(F.max(F.struct("id", "url")).alias("first"))
    refers = F.col("id") < F.col("first.id")
    return heads.drop("url").join(first, digest, "left").select("id", *digest, F.when(refers, F.col("first.id")).alias("refers_to"), F.when(refers, F.col("first.url")).alias("first_url"))


def _urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}')}>"


def _uri(url: str | None) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "urn:unknown")


def record(page_id, url: str | None, payload: bytes, sha1: str, size: int, refers_to, first_url: str | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP header of the original and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url)}",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}", f"Page-ID: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"Refers-To-Page-ID: {refers_to}", f"WARC-Refers-To-Target-URI: {_uri(first_url)}", f"WARC-Refers-To-Date: {date}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, date: str, roll_bytes: int):
    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        task = TaskContext.get()
        out, name, size, count, number = None, "", 0, 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    out, size, count, number = store.open_output_stream(posixpath.join(root, name), compression=None), 0, 0, number + 1
                packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                payload = b"" if row["refers_to"] is not None else (row["html"] or "").encode()
                data = packer.compress(record(row["id"], row["url"], payload, row["sha1"], row["payload_bytes"], row["refers_to"], row["first_url"], date)) + packer.flush()
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= roll_bytes:
                    out.close()
                    done.append((name, count))
                    out = None
        if out is not None:
            out.close()
            done.append((name, count))
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{n}" for n, _ in done], "records": [c for _, c in done]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))
    return write


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = MIN_BYTES, date: str = "1970-01-01T00:00:00Z", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write one record per page into gzip members below ``folder``; returns the manifest ``path, records``.

    The manifest names the files of the attempts that ended, so a lost or repeated task leaves no record twice or out. Null
    payloads are empty, null urls ``urn:unknown``. Pages under ``min_bytes`` are always responses, and so are pages with a
    null id and repeated rows of the largest id: they have no larger id to refer to. Other columns are ignored; an empty
    table writes no file. ``folder`` is a URI that pyarrow can open; its files are the only thing written outside Spark.
    """
    digest = ["id", "sha1", "sha256", "payload_bytes"]
    heads = resolve(pages, id_col, url_col, payload_col, min_bytes)
    html = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"), F.sha1(html).alias("sha1"),
                        F.sha2(html, 256).alias("sha256"), F.length(html).cast("long").alias("payload_bytes"))
    same = [rows[c].eqNullSafe(heads[c]) for c in digest]
    full = rows.join(heads, (same[0]) & same[1] & same[2] & same[3]).select(rows["id"], "url", F.when(heads["refers_to"].isNull(), rows["html"]).alias("html"), rows["sha1"], rows["payload_bytes"], "refers_to", "first_url")
    return staged(full.mapInArrow(_writer(folder, date, roll_bytes), "path string, records long"), "warc-manifest")


def _members(stream, chunk: int = 1 << 20):
    """The gzip members of a stream, one at a time."""
    unpack, out, data = zlib.decompressobj(31), [], stream.read(chunk)
    while data:
        out.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(out)
            data, unpack, out = unpack.unused_data or stream.read(chunk), zlib.decompressobj(31), []
        else:
            data = stream.read(chunk)
    if any(out):
        raise ValueError("an archive ends inside a record")


def parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"fields": fields, "http": http, "payload": payload}


def _reader(batches):
    import pyarrow as pa
    from pyarrow import fs

    kinds = pa.schema([("id", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("sha1", pa.string()), ("refers_to", pa.string())])
    rows: list[dict] = []
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_stream(name, compression=None) as stream:
                for member in _members(stream):
                    got = parse(member)
                    fields, whole = got["fields"], got["fields"]["warc-type"] == "response"
                    rows.append({"id": fields["page-id"] or None, "record_type": fields["warc-type"], "payload_bytes": len(got["payload"]) if whole else None,
                                 "sha1": hashlib.sha1(got["payload"]).hexdigest() if whole else None, "refers_to": fields.get("refers-to-page-id")})
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows = []
    yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def read_archives(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record; revisits take size and digest of their original."""
    spark: SparkSession = manifest.sparkSession
    files = manifest.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    got = staged(files.mapInArrow(_reader, "id string, record_type string, payload_bytes long, sha1 string, refers_to string"), "warc-read")
    whole = got.filter("record_type = 'response'")
    firsts = whole.filter("id IS NOT NULL").select(F.col("id").alias("refers_to"), "payload_bytes", "sha1")
    wanted = got.filter("record_type = 'revisit'").select("id", "record_type", "refers_to")
    firsts = firsts.join(wanted.select("refers_to").distinct(), "refers_to", "left_semi").distinct()
    columns = ["id", "payload_bytes", "sha1", "record_type", "refers_to"]
    out = whole.select(*columns).unionByName(wanted.join(firsts, "refers_to", "left").select(*columns))
    return out.select(F.col("id").cast(id_type).alias("page_id"), "payload_bytes", F.col("sha1").alias("payload_digest"), "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))


def deduplicated_archives(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the archives below ``folder`` (the shared folder if None) and read them back."""
    return read_archives(write_archives(pages, folder or new_path(pages.sparkSession, "warc"), **options), pages.schema[options.get("id_col", "page_id")].dataType.simpleString())
