"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of at most FRAME_BYTES
of records each; a bundle ends with the format's seek table, a skippable frame
that lists the compressed and plain size of every frame. An index maps each
record identifier to its bundle, frame and offset within the frame, so one
record is read by decompressing one frame.

Defined results: null html is an empty payload. Of equal payloads of at least
``min_revisit`` bytes, the record with the largest page_id is the response and
the others revisit it; rows that repeat that page_id with that payload are
responses too. Null page_ids revisit a response with an id; if no copy has an
id, all of them are responses. A record larger than a frame has a frame of its
own. An empty table gives no bundles and no rows. Only page_id, url and html
are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkeep.llm.shared import bounded, fresh_dir, map_pandas, stash
from driftkeep.llm.tables import table

FRAME_BYTES, BUNDLE_BYTES, TASK_BYTES, LEVEL = 1 << 20, 128 << 20, 16 << 20, 6
#: Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed value of WARC 1.1.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def open_file(path: str, mode: str):
    """A file of a local path, a file: URI, or any store that pyarrow knows."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return open(path, mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_output_stream(inner) if mode == "wb" else store.open_input_file(inner)


def record(record_id: str, url: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record; a revisit carries the payload's digest and size but not the payload."""
    clean = " ".join((url or "").split())
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    block = HTTP_HEAD
    if refers_to:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that begins at an offset."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(head["Content-Length"])
    end = stop + 4 + size
    return head, data[stop + 4 : end], end + 4


class Bundle:
    """A seekable file being written: frames, then the seek table."""

    def __init__(self, path: str):
        self.path, self._out = path, open_file(path, "wb")
        self._frames: list[tuple[int, int]] = []
        self._held: list[bytes] = []
        self._size = self.written = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset in it of a record."""
        if self._held and self._size + len(data) > FRAME_BYTES:
            self._flush()
        at = len(self._frames), self._size
        self._held.append(data)
        self._size += len(data)
        return at

    def _flush(self) -> None:
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(self._held))
        self._out.write(packed)
        self._frames.append((len(packed), self._size))
        self.written += len(packed)
        self._held, self._size = [], 0

    def close(self) -> None:
        if self._held:
            self._flush()
        body = b"".join(struct.pack("<II", c, d) for c, d in self._frames) + struct.pack("<IBI", len(self._frames), 0, SEEKABLE)
        self._out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self._out.close()


def seek_table(f) -> tuple[list[int], list[int]]:
    """Offset and compressed size of each frame, read from a bundle's footer."""
    f.seek(0, 2)
    end = f.tell()
    f.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    f.seek(end - 9 - n * width)
    raw = f.read(n * width)
    sizes = [struct.unpack_from("<I", raw, i * width)[0] for i in range(n)]
    starts = [0]
    for s in sizes[:-1]:
        starts.append(starts[-1] + s)
    return starts[:n], sizes


def read_frame(f, start: int, size: int) -> bytes:
    f.seek(start)
    return zstandard.ZstdDecompressor().decompress(f.read(size))


def read_record(entry, path: str | None = None) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record of an index row: one seek, one frame."""
    with open_file(path or entry.bundle, "rb") as f:
        starts, sizes = seek_table(f)
        head, block, _ = parse(read_frame(f, starts[entry.frame], sizes[entry.frame]), entry.offset)
    return head, block


def with_kind(pages: DataFrame, min_revisit: int) -> DataFrame:
    """page_id, url, html, sha1 and the page_id of the response that a row revisits (else null)."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("sha1"))
    # Partial sums meet per payload, so copies don't gather; single payloads don't come back, and payloads stay where they are while those met twice are few.
    twice = rows.filter(F.length("html") >= min_revisit).groupBy("sha1").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & F.col("top").isNotNull()).select("sha1", "top")
    found = rows.join(bounded(stash(twice, "warc-copies"), 250_000), "sha1", "left")
    return found.withColumn("refers_to", F.when(F.col("top").isNotNull() & ~F.col("top").eqNullSafe(F.col("page_id")), F.col("top"))).drop("top")


def _writer(folder: str, date: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ctx = TaskContext.get()
        task = f"{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        bundle, serial, unnamed = None, 0, 0
        for pdf in batches:
            out = []
            for page_id, url, html, sha1, refers in zip(pdf.page_id, pdf.url, pdf.html, pdf.sha1, pdf.refers_to, strict=True):
                if bundle is None or bundle.written >= BUNDLE_BYTES:
                    if bundle:
                        bundle.close()
                    # A name of the attempt's own: a repeated task never touches another's file.
                    bundle = Bundle(f"{folder}/warc-{task}-{serial}.warc.zst")
                    serial += 1
                unnamed += pd.isna(page_id)
                name = f"urn:page:{f'null-{task}-{unnamed}' if pd.isna(page_id) else page_id}"
                data = record(name, url if isinstance(url, str) else "", bytes(html), base64.b32encode(bytes.fromhex(sha1)).decode(), None if pd.isna(refers) else f"urn:page:{refers}", date)
                frame, offset = bundle.add(data)
                out.append((name, None if pd.isna(page_id) else page_id, bundle.path, frame, offset, len(data)))
            yield pd.DataFrame(out, columns=["record_id", "page_id", "bundle", "frame", "offset", "length"])
        if bundle:
            bundle.close()

    return run


def write_bundles(pages: DataFrame, folder: str | None = None, min_revisit: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write every page and return the index, which is kept beside the bundles.

    Bundles of task attempts that failed stay unread: the index names those
    of the attempts that counted.
    """
    spark = pages.sparkSession
    folder = folder or fresh_dir(spark, "warc")
    spark.createDataFrame([], "x int").write.parquet(f"{folder}/bundles")  # makes the folder, by Spark's own file system
    index = map_pandas(with_kind(pages, min_revisit), _writer(f"{folder}/bundles", date), INDEX, ("page_id", "refers_to"))
    index.write.option("compression", "zstd").parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def _number(urn: str | None) -> str | None:
    tail = (urn or "").strip("<>").removeprefix("urn:page:")
    return tail if tail.lstrip("-").isdigit() else None


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, frames in pdf.groupby("bundle").frame:
            with open_file(path, "rb") as f:
                starts, sizes = seek_table(f)
                for i in sorted(set(frames)):
                    data, at, out = read_frame(f, starts[i], sizes[i]), 0, []
                    while at < len(data):
                        head, block, at = parse(data, at)
                        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(head["X-Payload-Length"])
                        if kind == "response":
                            payload = block[len(HTTP_HEAD) :]
                            size = len(payload)
                            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"damaged payload in {path}, frame {i}")
                        out.append((_number(head["WARC-Record-ID"]), size, digest, kind, _number(head.get("WARC-Refers-To"))))
                    yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the indexed bundles: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The frames are dealt to a task for each TASK_BYTES of records, neighbours together.
    """
    frames = index.groupBy("bundle", "frame").agg(F.sum("length").alias("n"))
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // TASK_BYTES))
    return map_pandas(frames.select("bundle", "frame").repartitionByRange(tasks, "bundle", "frame"), _reader, PAGES, ("page_id", "refers_to"))


def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_bundles(write_bundles(table(spark, sf_dir, "pages")))
