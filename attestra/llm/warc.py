"""WARC archives with one Zstandard frame per record and the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard as zstd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.rows import only
from attestra.session import cut_lineage, shared_folder

#: Fixed values of the formats.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: An archive is closed after so many payload bytes; a longer payload gets an archive of its own.
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 32 << 10
#: The dictionary is trained on the start of each of an archive's first payloads.
TRAIN_PAYLOADS, TRAIN_BYTES = 200, 8 << 10
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a 40-digit hex string: five digits give four characters."""
    out = []
    for group in range(8):
        value = F.conv(F.substring(digest, 1 + 5 * group, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1
            out.append(F.substr(F.lit(BASE32), at, F.lit(1)))
    return F.concat(*out)


def with_roles(pages: DataFrame, id_column: str, payload: Column, smallest: int) -> DataFrame:
    """``(id, url, payload, sha1, refers_to)``: which payloads are written, and which only referred to.

    Of equal payloads of at least ``smallest`` bytes the largest id is the response and the others refer to
    it. Rows that repeat that id with that payload are responses too. Rows without an id refer to it, and
    are responses if no row of their payload has one.
    """
    rows = pages.withColumn("payload", payload)
    rows = rows.withColumn("sha1", F.sha1("payload"))
    large = F.octet_length("payload") >= smallest
    winners = (
        rows.filter(large).groupBy("sha1").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    joined = rows.join(winners.select("sha1", "winner"), "sha1", "left")
    refers = F.when(large & F.col("winner").isNotNull() & ~F.col("id").eqNullSafe(F.col("winner")), F.col("winner"))
    return joined.select("id", "url", "payload", "sha1", refers.alias("refers_to"))


def _record(record_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha1.decode())).decode()
    headers = [
        VERSION, "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <urn:page:{record_id}>",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        headers.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(0x21, 0x7F)))))
    block = HTTP % len(payload)
    if refers_to is None:
        block += payload
    else:
        headers += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    headers.append(f"Content-Length: {len(block)}")
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(payloads: list[bytes]) -> zstd.ZstdCompressionDict | None:
    samples = [p[:TRAIN_BYTES] for p in payloads[:TRAIN_PAYLOADS] if p]
    if len(samples) < 16:
        return None
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstd.ZstdError:  # too little or too uniform a sample
        return None


def archive(records: list[bytes], payloads: list[bytes]) -> bytes:
    """One archive: the skippable frame with the dictionary, if there is one, then a frame per record."""
    dictionary = _dictionary(payloads)
    out = []
    if dictionary is not None:
        data = dictionary.as_bytes()
        out.append(struct.pack("<II", SKIPPABLE, len(data)) + data)
    packer = zstd.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
    out += [packer.compress(r) for r in records]
    return b"".join(out)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    uri = folder if "://" in folder else re.sub(r"^(\w+):/+", r"\1:///", folder)
    return fs.FileSystem.from_uri(uri)


def write(
    pages: DataFrame, folder: str, id_column: str = "page_id", url: str = "url", payload: str = "html", smallest: int = 0
) -> DataFrame:
    """Write one record per row into archives below ``folder``; returns their manifest ``(path, records)``.

    Payloads are the UTF-8 bytes, null counting as empty. Equal payloads are written once (``with_roles``);
    a payload that a large part of all rows share costs one small revisit record per row. Each task
    writes archives of about ARCHIVE_BYTES of payload. A file's name holds the task's attempt, and only files
    in the manifest, which is materialised, are read: what a lost or doubled attempt left is ignored.
    Rows without an id get the id ``None`` in the archive. Ids are whole numbers.
    """
    rows = only(pages, id_column, url, payload).toDF("id", "url", "_payload")
    roles = with_roles(rows, "id", F.coalesce(F.col("_payload").cast("binary"), F.lit(b"")), smallest)
    run_id = uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        task = TaskContext.get()
        stem = f"{run_id}-{task.partitionId():06d}-{task.taskAttemptId()}"
        records: list[bytes] = []
        payloads: list[bytes] = []
        size = number = 0

        def close() -> pa.RecordBatch:
            nonlocal size, number
            name = f"{stem}-{number:05d}.warc.zst"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{name}", compression=None) as file:
                file.write(archive(records, payloads))
            done = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([len(records)], pa.int64())})
            records.clear()
            payloads.clear()
            size, number = 0, number + 1
            return done

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for record_id, target, body, sha1, refers_to in zip(*columns, strict=True):
                records.append(_record(record_id, target, body, sha1.encode(), refers_to))
                if refers_to is None:
                    payloads.append(body)
                    size += len(body)
                size += 256
                if size >= ARCHIVE_BYTES:
                    yield close()
        if records:
            yield close()

    return cut_lineage(roles.mapInArrow(run, "path string, records bigint"))


def _frames(data: bytes) -> Iterator[tuple[int, int, bool]]:
    """``(start, end, skippable)`` of each frame, from the frame and block headers alone."""
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError(f"cut-off frame at byte {at}")
        magic, length = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end, skip = at + 8 + length, True
        elif magic == FRAME:
            checksum = data[at + 4] >> 2 & 1
            end, skip, last = at + zstd.frame_header_size(data[at : at + 18]), False, 0
            while not last:
                if end + 3 > len(data):
                    raise ValueError(f"cut-off block at byte {end}")
                head = int.from_bytes(data[end : end + 3], "little")
                last, kind, size = head & 1, head >> 1 & 3, head >> 3
                end += 3 + (1 if kind == 1 else size)
            end += 4 * checksum
        else:
            raise ValueError(f"no frame at byte {at}")
        if end > len(data):
            raise ValueError(f"cut-off frame at byte {at}")
        yield at, end, skip
        at = end


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of one archive. A leading skippable frame holds the dictionary, itself compressed or not."""
    dictionary = None
    for start, end, skip in _frames(data):
        if skip:
            if start == 0 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
                raw = data[8:end]
                if raw[:4] == struct.pack("<I", FRAME):
                    raw = zstd.ZstdDecompressor().decompressobj().decompress(raw)
                dictionary = zstd.ZstdCompressionDict(raw)
            continue
        unpacker = zstd.ZstdDecompressor(dict_data=dictionary) if dictionary else zstd.ZstdDecompressor()
        yield unpacker.decompressobj().decompress(data[start:end])


REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def parse(record: bytes) -> dict:
    """Headers and payload of one record, with the first thing found wrong as ``problem``."""
    out: dict = {"record_id": None, "record_type": None, "url": None, "refers_to": None, "digest": None, "payload": None}
    out["problem"] = None
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return out | {"problem": f"header without a colon: {line[:40]}"}
        headers.setdefault(name.strip().lower(), value.strip())
    out |= {
        "record_id": headers.get("warc-record-id", "").strip("<>") or None, "record_type": headers.get("warc-type"),
        "url": headers.get("warc-target-uri"), "refers_to": headers.get("warc-refers-to", "").strip("<>") or None,
        "digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
    }
    missing = [name for name in REQUIRED if name not in headers]
    length = headers.get("content-length", "")
    if not gap or not re.fullmatch(r"WARC/\d+\.\d+", lines[0]):
        out["problem"] = "no WARC header"
    elif missing:
        out["problem"] = f"no {missing[0]}"
    elif not re.fullmatch(r"\d+", length) or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        out["problem"] = "length differs from Content-Length"
    else:
        http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
        declared = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
        if not gap:
            out["problem"] = "no HTTP header"
        elif out["record_type"] == "response":
            out["payload"] = payload
            if declared and int(declared[1]) != len(payload):
                out["problem"] = "payload length differs from its HTTP header"
            elif out["digest"] and base64.b32encode(hashlib.sha1(payload).digest()).decode() != out["digest"]:
                out["problem"] = "payload digest differs"
        elif out["record_type"] == "revisit" and (not out["refers_to"] or "warc-profile" not in headers):
            out["problem"] = "revisit without target or profile"
    return out


RECORDS = (
    "path string, record_id string, record_type string, url string, refers_to string, payload_digest string, "
    "payload binary, problem string"
)


def read(spark: SparkSession, manifest: DataFrame | None = None, paths: list[str] | None = None) -> DataFrame:
    """The records of archives, one row each (RECORDS), from a manifest of ``write`` or from paths.

    A record with a wrong header, length or digest is a row with its ``problem``; an archive that breaks
    off gives its whole records and one row with the problem. Archives are read one at a time, and
    payloads leave a task in batches of about ARCHIVE_BYTES. Manifest rows are dealt out over the tasks.
    """
    if manifest is None:
        manifest = spark.createDataFrame([(p,) for p in paths or []], "path string")
    manifest = manifest.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = pa.schema([(n, pa.binary() if k == "binary" else pa.string()) for n, k in (c.split() for c in RECORDS.split(", "))])
    names = ("record_id", "record_type", "url", "refers_to", "digest", "payload", "problem")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, where = _open(path)
                with store.open_input_stream(where, compression=None) as file:
                    data = file.read()
                rows, size = [], 0
                try:
                    for record in records_of(data):
                        found = parse(record)
                        rows.append((path, *(found[n] for n in names)))
                        size += len(record)
                        if size >= ARCHIVE_BYTES:
                            yield batch_of(rows)
                            rows, size = [], 0
                except (ValueError, zstd.ZstdError) as error:
                    rows.append((path, *[None] * 6, str(error)))
                if rows:
                    yield batch_of(rows)

    return manifest.mapInArrow(run, RECORDS)


def payload_report(records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` per record that ``write`` wrote.

    A revisit's payload length is that of the response it refers to. A record with a problem, and a revisit
    whose response is missing, stop the query.
    """
    page = "try_cast(nullif(regexp_extract({}, '^urn:page:(-?[0-9]+)$', 1), '') AS bigint)"
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "problem")).cast("long"))
    rows = records.select(
        F.expr(page.format("record_id")).alias("page_id"),
        F.coalesce(checked, F.octet_length("payload").cast("long")).alias("own_bytes"),
        "payload_digest", "record_type",
        F.expr(page.format("refers_to")).alias("refers_to"),
    )
    rows = cut_lineage(rows)
    sizes = (
        rows.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("own_bytes").alias("full_bytes"))
    )
    referred = rows.filter("record_type = 'revisit'").join(sizes, "payload_digest", "left").withColumn(
        "payload_bytes", F.coalesce("full_bytes", F.raise_error(F.lit("a revisit's response is missing")).cast("long"))
    )
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = rows.filter("record_type = 'response'").withColumn("payload_bytes", F.col("own_bytes"))
    return responses.select(*out).unionByName(referred.select(*out))


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
