"""WARC archives compressed record by record with a Zstandard dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import file_system, new_folder, sliced, write_file, written

#: The frame that carries an archive's dictionary, as the WARC specification for Zstandard has it.
DICT_FRAME = 0x184D2A5D
#: Payload bytes from which equal payloads are revisits, bytes of records in an archive (a longer record makes
#: a longer archive), of the records that its dictionary is built from, and of the dictionary.
LEAST_REVISIT, ARCHIVE_BYTES, SAMPLE_BYTES, DICT_BYTES, LEVEL = 1000, 32_000_000, 4_000_000, 65_536, 3
#: Longer records are cut into pieces of so many bytes for the sample.
SAMPLE_PIECE = 131_072
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = "none"
#: Tasks that read, a file each up to this bound.
MOST_READERS = 10_000
DATE = "2020-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit has headers only and names the response."""
    block = b"" if refers_to is not None else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{NO_ID if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or 'urn:none').translate({10: '%0A', 13: '%0D'})}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:n]


def sample_of(records: list[bytes], piece: int) -> list[bytes]:
    """Pieces of the records, every so many, that add up to about SAMPLE_BYTES at most."""
    pieces = [r[i : i + piece] for r in records for i in range(0, len(r), piece)]
    return pieces[:: max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))]


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from the records of an archive: trained, or, where they are too few or too alike to train on, their
    own bytes, which Zstandard takes as a dictionary of plain content."""
    for piece in (SAMPLE_PIECE, 256):
        sample = sample_of(records, piece)
        try:
            return zstandard.train_dictionary(max(1024, min(DICT_BYTES, sum(map(len, sample)) // 10)), sample)
        except zstandard.ZstdError:
            continue
    return zstandard.ZstdCompressionDict(b"".join(sample_of(records, SAMPLE_PIECE))[-DICT_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> list[bytes]:
    """Bytes of an archive: the dictionary's frame, then a frame for each record."""
    made = build_dictionary(records)
    # the dictionary itself is compressed without one, as the specification allows
    packed = zstandard.ZstdCompressor(level=19).compress(made.as_bytes())
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True, write_content_size=True)
    return [struct.pack("<II", DICT_FRAME, len(packed)) + packed, *(squeeze.compress(r) for r in records)]


def read_archive(stream) -> Iterator[bytes]:
    """Records of an archive one after another; ``stream`` has read(n). Only one record is held at a time."""
    head = stream.read(8)
    if not head:
        return
    kind, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    pending, trained = head, None
    if kind == DICT_FRAME:
        data = stream.read(size)
        if data[:4] == zstandard.FRAME_HEADER:
            data = zstandard.ZstdDecompressor().decompress(data)
        trained, pending = zstandard.ZstdCompressionDict(data), b""
    opener = zstandard.ZstdDecompressor(dict_data=trained) if trained is not None else zstandard.ZstdDecompressor()
    while True:
        if not pending and not (pending := stream.read(1 << 16)):
            return
        frame, parts = opener.decompressobj(), []
        while not frame.eof:
            if not pending and not (pending := stream.read(1 << 16)):
                raise ValueError("an archive ends within a record")
            parts.append(frame.decompress(pending))
            pending = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def revisits(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """``df`` with page_id, payload_digest, payload_bytes and refers_to: of equal payloads the largest id is the response.

    Digests are counted with partial sums; only those of several pages come back to the rows by the join.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).cast("binary")
    rows = df.withColumn("payload", payload).withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    large = rows.where(F.col("payload_bytes") >= LEAST_REVISIT)
    shared = large.groupBy(F.col("payload_digest").alias("d")).agg(F.max(id_col).alias("response"), F.count("*").alias("n")).where("n > 1").select("d", "response")
    key = F.when(F.col("payload_bytes") >= LEAST_REVISIT, F.col("payload_digest"))
    joined = rows.join(shared, key == F.col("d"), "left")
    return joined.withColumn("refers_to", F.when(~F.col("response").eqNullSafe(F.col(id_col)), F.col("response"))).drop("d", "response")


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for each row; one row a file: path, n_records.

    Null payloads are empty, null urls and ids stand as ``none``; a row without id is a revisit like others, but no
    row can refer to it, so equal payloads of rows without ids alone are all responses. Rows with equal ids and
    payloads are revisits of none, as they bear the response's id.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{payload_col}`").alias("html"))
    rows = revisits(rows, "page_id", "html").select("page_id", "url", "payload", "payload_digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, size = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal n, size, held
            name = write_file(f"{folder}/pages-{part:06d}-{n:06d}", ".warc.zst", archive(held))
            row = pa.RecordBatch.from_pylist([{"path": name, "n_records": len(held)}], pa.schema([("path", pa.string()), ("n_records", pa.int64())]))
            n, size, held = n + 1, 0, []
            return row

        for batch in sliced(batches, 200):
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(*x))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(run, "path string, n_records long")


def read_archives(files: DataFrame) -> DataFrame:
    """Per record of the archives, from their headers and blocks: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are taken from its block and held against its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)))
        for batch in batches:
            for path, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = file_system(path)
                rows: list[dict] = []
                with system.open_input_stream(at, compression=None) as f:
                    for data in read_archive(f):
                        headers, block = parse(data)
                        digest, n = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                        if headers["WARC-Type"] == "response" and (len(block) != n or hashlib.sha1(block).hexdigest() != digest):
                            raise ValueError(f"{path}: the payload of {headers['WARC-Record-ID']} differs from its headers")
                        of = lambda key: int(x) if (x := headers.get(key, NO_ID).removeprefix("<urn:page:").removesuffix(">")) != NO_ID else None  # noqa: B023, E731
                        rows.append(dict(zip(names, (of("WARC-Record-ID"), n, digest, headers["WARC-Type"], of("WARC-Refers-To")), strict=True)))
                if len(rows) != count:
                    raise ValueError(f"{path}: {len(rows)} records instead of {count}")
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return files.repartitionByRange(max(1, min(MOST_READERS, files.count())), "path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def through_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all rows to archives in the shared folder, then read every record back from them."""
    folder = new_folder(df.sparkSession, "warc")
    return read_archives(written(write_archives(df, folder, id_col, url_col, payload_col), "archives"))
