"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a footer table of frame sizes, in a
skippable frame, lets a reader go to any frame. The writer returns an index that
maps record ids to file, frame and place within the frame.

Each task writes its own files in the shared folder under names of their own, and
only files named in the index count: a repeated or lost task leaves at most a file
that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.plans.shared import reliable, scratch_path

#: Bytes of records in a frame, and of compressed frames in a file, before the next begins.
FRAME, BUNDLE = 1 << 18, 1 << 28
#: Compressed bytes that a reading task is given, about 100 MB of pages.
READ_BYTES = 16 << 20
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed value: profile of a record whose payload another record has.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id long, file string, frame long, frame_offset long, frame_bytes long, at long, length long"
RECORD = "record_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, which has the HTTP header but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if record_id is None else record_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names) and block of the record at a place, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    stop = end + 4 + int(head["content-length"])
    return head, data[end + 4 : stop], stop + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """Footer of (compressed, plain) sizes of frames."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _row_of(head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    number = lambda key: int(m[1]) if (m := re.search(r"<urn:page:(-?\d+)>", head.get(key, ""))) else None
    http, _, payload = block.partition(b"\r\n\r\n")
    if head["warc-type"] == "revisit":
        digest, size = head["warc-payload-digest"].removeprefix("sha1:"), int(re.search(rb"Content-Length: (\d+)", http)[1])
        payload = None
    else:
        digest, size = base32_sha1(payload), len(payload)
        if head["warc-payload-digest"] != f"sha1:{digest}":
            raise ValueError("a payload differs from its digest")
    return number("warc-record-id"), head.get("warc-target-uri"), head["warc-type"], number("warc-refers-to"), digest, size, payload if with_payload else None


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["record_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)


def with_roles(pages: DataFrame, page_id: str, payload: Column, least: int) -> DataFrame:
    """(row, payload, refers_to): of equal payloads the largest id stands for all; shorter ones than ``least`` stand alone."""
    rows = pages.select(F.struct("*").alias("row"), F.coalesce(payload.cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("id", F.col(f"row.`{page_id}`").cast("long"))
    first = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.max("id").alias("holder"))
    joined = rows.join(first, "digest", "left")
    same = F.col("holder").isNull() | F.col("holder").eqNullSafe(F.col("id"))
    refers = F.when((F.length("payload") >= least) & ~same, F.col("holder"))
    return joined.select("row", "id", "payload", refers.alias("refers_to"))


def write(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0,
    date: str = "1970-01-01T00:00:00Z", level: int = 3,
) -> DataFrame:
    """Write one record per row into bundles in ``folder`` (shared by all executors); returns the index, itself stored.

    A null payload is empty, a null url has no header, a null id is an empty one.
    Rows that repeat a payload become revisits, but not those with the id of the
    response itself, so repeated rows are all responses. No rows give no files.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _place(folder)
        files.create_dir(base, recursive=True)
        coder = zstandard.ZstdCompressor(level=level)
        state = {"out": None, "name": None, "sizes": [], "offset": 0}
        buffer, pending, index = bytearray(), [], []

        def flush() -> None:
            if not buffer:
                return
            if state["out"] is None:
                state.update(name=f"bundle-{uuid.uuid4().hex}.warc.zst", sizes=[], offset=0)
                state["out"] = files.open_output_stream(f"{base}/{state['name']}.part")
            frame = coder.compress(bytes(buffer))
            state["out"].write(frame)
            index.extend((i, state["name"], len(state["sizes"]), state["offset"], len(frame), at, n) for i, at, n in pending)
            state["sizes"].append((len(frame), len(buffer)))
            state["offset"] += len(frame)
            buffer.clear()
            pending.clear()
            if state["offset"] >= BUNDLE:
                close()

        def close() -> None:
            if state["out"] is not None:
                state["out"].write(seek_table(state["sizes"]))
                state["out"].close()
                files.move(f"{base}/{state['name']}.part", f"{base}/{state['name']}")
                state["out"] = None

        def told() -> pa.RecordBatch:
            columns = list(zip(*index)) if index else [()] * 7
            index.clear()
            kinds = [pa.int64(), pa.string()] + [pa.int64()] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["record_id", "file", "frame", "frame_offset", "frame_bytes", "at", "length"]
            )

        for batch in batches:
            for i in range(batch.num_rows):
                rid, link, payload, refers = (batch.column(c)[i].as_py() for c in range(4))
                made = record(rid, link, payload, refers, date)
                pending.append((rid, len(buffer), len(made)))
                buffer += made
                if len(buffer) >= FRAME:
                    flush()
            if index:
                yield told()
        flush()
        close()
        yield told()

    rows = with_roles(pages, page_id, F.col(f"`{html}`"), least)
    return reliable(rows.select("id", F.col(f"row.`{url}`").cast("string").alias("url"), "payload", "refers_to").mapInArrow(bundle, INDEX))


def frames(files: DataFrame, folder: str) -> DataFrame:
    """(file, frame_offset, frame_bytes) of all frames, from the seek tables of the bundles in ``files`` (file)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _place(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{base}/{name}") as f:
                    size = f.size()
                    f.seek(size - 9)
                    n, flags, magic = struct.unpack("<IBI", f.read(9))
                    if magic != SEEKABLE:
                        raise ValueError(f"{name} has no seek table")
                    width = 12 if flags & 128 else 8
                    f.seek(size - 9 - n * width)
                    table = f.read(n * width)
                sizes = [struct.unpack_from("<I", table, i * width)[0] for i in range(n)]
                offsets = [sum(sizes[:0])]
                for s in sizes:
                    offsets.append(offsets[-1] + s)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(offsets[:-1], pa.int64()), pa.array(sizes, pa.int64())], ["file", "frame_offset", "frame_bytes"])

    return files.mapInArrow(look, "file string, frame_offset long, frame_bytes long")


def read(folder: str, files: DataFrame, payload: bool = True) -> DataFrame:
    """All records of the bundles in ``files`` (file), frame by frame; payloads are checked against their digests."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _place(folder)
        decoder = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, offset, size in zip(*[c.to_pylist() for c in batch.columns]):
                with store.open_input_file(f"{base}/{name}") as f:
                    f.seek(offset)
                    data = decoder.decompress(f.read(size))
                rows, at = [], 0
                while at < len(data):
                    head, block, at = parse(data, at)
                    rows.append(_row_of(head, block, payload))
                yield _table(rows)

    found = reliable(frames(files, folder))  # a few numbers a frame, read twice
    # Rows of a few bytes stand for whole frames, so the number of tasks is given: by size, Spark would take one.
    tasks = max(1, math.ceil((found.agg(F.sum("frame_bytes")).first()[0] or 0) / READ_BYTES))
    return found.repartition(tasks, "file", "frame_offset").mapInArrow(records, RECORD)


def fetch(folder: str, entries: DataFrame) -> DataFrame:
    """The records of some index rows, each read from its own frame only."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _place(folder)
        decoder = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for e in batch.to_pylist():
                with store.open_input_file(f"{base}/{e['file']}") as f:
                    f.seek(e["frame_offset"])
                    data = decoder.decompress(f.read(e["frame_bytes"]))
                head, block, _ = parse(data[e["at"] : e["at"] + e["length"]])
                rows.append(_row_of(head, block, True))
            yield _table(rows)

    return entries.select("file", "frame_offset", "frame_bytes", "at", "length").mapInArrow(one, RECORD)


def archive(pages: DataFrame, least: int = 0) -> tuple[str, DataFrame]:
    """Write ``pages`` to a new folder of the session's shared storage; gives the folder and the index."""
    folder = scratch_path(pages.sparkSession, "warc")
    return folder, write(pages, folder, least=least)
