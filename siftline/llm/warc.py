"""Dictionary-compressed WARC archives.

Each task writes one .warc.zst file: a skippable frame that holds a Zstandard dictionary, then one frame for each record, which is
compressed with it. The dictionary is built from the file's own first records, at most SAMPLE_BYTES of them. Files have a name
for each attempt of a task, and the manifest that a task returns names the file it wrote, so that a repeated attempt leaves a
file which no manifest names rather than a broken archive.

Of rows with equal payloads of at least MIN_REVISIT bytes, those with the smallest page_id are responses and all others are
revisits of it, which carry no payload but its digest and length. Smaller payloads are always responses. A null html is an empty
payload; a null url has no target line. Repeated rows each get a record, and if they have the smallest page_id, each is a
response. A null page_id counts as larger than any other; records that have equal payloads and only null ids are all
responses. An empty table gives no records. Only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm._shared import fresh_path, partitions, settle, small_batches

MIN_REVISIT = 100
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
#: So many payloads with copies are broadcast; beyond that a payload's rows are dealt to SALTS tasks.
BROADCAST_DIGESTS = 500_000
SALTS = 32
LEVEL = 3
#: Fixed values of the formats: the first of the sixteen magic numbers of skippable frames that archives use, and a zero date.
SKIPPABLE = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def with_targets(spark: SparkSession, pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html and refers_to: the smallest page_id with an equal payload, null for responses. Digests are grouped first, so a
    payload that a third of all rows share is reduced where it is read. Payloads with copies are broadcast if they are counted to be few,
    and no page moves; else rows move by digest and salt. Payloads too small for revisits have no digest to meet in."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    digest = F.when(F.octet_length("html") >= min_revisit, F.unhex(F.sha2("html", 256)))
    keys = rows.select("page_id", digest.alias("digest")).filter("digest is not null")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    first = settle(spark, first, "first-pages")
    # A row without a digest gets one of its own that no payload has.
    own = F.coalesce(digest, F.concat(F.lit("small "), F.coalesce(F.col("page_id"), F.lit(0)).cast("string")).cast("binary"))
    keyed = rows.withColumns({"digest": own, "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")})
    if first.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        copies = keyed.join(F.broadcast(first), "digest", "left")
    else:
        copies = keyed.join(first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["digest", "salt"], "left")
    return copies.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page}')}>"


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit carries the headers of the response alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    if page is not None:
        head.append(f"X-Page: {page}")
    head += [f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    if len(records) < 8 or sum(map(len, records)) < 8 * 1024:
        return None  # too few to learn from
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, records)) // 16))
    try:
        return zstandard.train_dictionary(size, records, k=256, d=8)
    except zstandard.ZstdError:
        return None


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        uri = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        store, path = pafs.FileSystem.from_uri(uri)
        out, compress, at, held, size = None, None, 0, [], 0

        def start() -> None:
            nonlocal out, compress, at
            store.create_dir(path.rpartition("/")[0], recursive=True)
            out = store.open_output_stream(path)
            learnt = _dictionary([r for _, r in held])
            if learnt is not None:
                frame = zstandard.ZstdCompressor(level=LEVEL).compress(learnt.as_bytes())
                out.write(struct.pack("<II", SKIPPABLE, len(frame)) + frame)
                at = 8 + len(frame)
            compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=learnt, write_checksum=True)

        def flush() -> pa.RecordBatch:
            nonlocal at, size
            rows: list[tuple] = []
            for page, data in held:
                frame = compress.compress(data)
                out.write(frame)
                rows.append((page, uri, at, len(frame)))
                at += len(frame)
            held.clear()
            size = 0
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["page_id", "path", "place", "length"])

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(k) for k in range(4))):
                data = record(page.as_py(), url.as_py(), html.as_py().encode(), refers.as_py())
                held.append((page.as_py(), data))
                size += len(data)
                if size >= SAMPLE_BYTES:
                    if out is None:
                        start()
                    yield flush()
        if held:
            if out is None:
                start()
            yield flush()
        if out is not None:
            out.close()

    return run


def write_archives(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives; the manifest (page_id, path, place, length) has a row for each record."""
    small_batches(spark)
    return settle(spark, with_targets(spark, pages).mapInArrow(_writer(folder), "page_id long, path string, place long, length long"), "warc-manifest")


def read_frames(stream) -> Iterator[bytes]:
    """The records of an archive, one after the other, whatever its frames' lengths; the leading skippable frame gives the dictionary."""
    data, learnt = stream.read(8), None
    if len(data) == 8 and struct.unpack("<II", data)[0] == SKIPPABLE:
        learnt = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(stream.read(struct.unpack("<II", data)[1])))
        data = b""
    decompressor = zstandard.ZstdDecompressor(dict_data=learnt)
    while data := data or stream.read(1 << 20):
        one, parts = decompressor.decompressobj(), []
        while not one.eof:
            if not data:
                data = stream.read(1 << 20)
                if not data:
                    raise ValueError("the archive ends inside a record")
            parts.append(one.decompress(data))
            data = one.unused_data if one.eof else b""
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """A record's headers, in lower case, and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    return fields | {"payload": block.partition(b"\r\n\r\n")[2]}


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            store, path = pafs.FileSystem.from_uri(uri)
            rows: list[tuple] = []
            with store.open_input_stream(path) as stream:
                for data in read_frames(stream):
                    one = parse(data)
                    page, refers = one.get("x-page"), one.get("x-refers-to-page")
                    if one["warc-type"] == "response":
                        size, digest = len(one["payload"]), hashlib.sha256(one["payload"]).hexdigest()
                    else:
                        size, digest = int(one["x-payload-length"]), one["warc-payload-digest"].removeprefix("sha256:")
                    rows.append((int(page) if page else None, one.get("warc-target-uri"), size, digest, one["warc-type"], int(refers) if refers else None))
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)
                        rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Read whole archives back, a file a task: page_id, url, payload_bytes, payload_digest, record_type, refers_to. Responses' digests
    are taken from the bytes read."""
    return manifest.select("path").distinct().repartition(partitions(spark)).mapInArrow(_reader, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write every page to archives in the shared folder, then read them back."""
    folder = fresh_path(spark, "warc")
    return read_archives(spark, write_archives(spark, pages, folder))
