"""WARC archives under Zstandard: a dictionary in a leading skippable frame, one frame per record.

Archives are rows of a name and their bytes, which is what ``spark.read.format("binaryFile")`` gives
for files; ``write_files`` turns rows into such files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from phrasewell.llm.common import stored
from phrasewell.llm.quality import let
from phrasewell.operators.lookup import lookup
from phrasewell.session import fits

# The magic number of the skippable frame that holds a dictionary, and that of a frame.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528

# The profile of a revisit by equal payload, and the version line of a record.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"

#: Payload bytes after which a task begins another archive; a single record may be longer.
ARCHIVE_BYTES = 8_000_000

RECORD = "archive string, record int, page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def payload_digest(payload: bytes) -> str:
    """SHA-1 in base32, without the name of the hash."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digest_column(payload: Column) -> Column:
    """``payload_digest`` of a binary column, JVM-side: the hash, taken once, in four numbers of eight letters each."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    letter = lambda number, i: F.substr(alphabet, F.shiftright(number, 35 - 5 * i).bitwiseAND(31).cast("int") + 1, F.lit(1))
    number = lambda h, part: F.conv(F.substring(h, 1 + 10 * part, 10), 16, 10).cast("bigint")
    eight = lambda x: F.concat(*[letter(x, i) for i in range(8)])
    return let(F.sha1(payload), lambda h: F.array_join(F.transform(F.array(*[number(h, part) for part in range(4)]), eight), ""))


def fit_dictionary(pages: DataFrame, html: str, size: int = 65_536, samples: int = 256, sample_bytes: int = 16_384) -> bytes:
    """A Zstandard dictionary of at most ``size`` bytes, trained on the first ``sample_bytes`` of ``samples`` pages.

    The pages are those with the smallest hashes. Where there is too little to train on, it is empty
    and the archives have no dictionary frame. Only how well archives compress depends on it.
    """
    hashed = pages.where(F.length(html) > 64).select(F.xxhash64(html).alias("hash"), F.substring(html, 1, sample_bytes).alias("head"))
    least = [r["hash"] for r in hashed.select("hash").distinct().orderBy("hash").limit(samples).collect()]
    picked = hashed.where(F.col("hash").isin(least)).dropDuplicates(["hash"]).orderBy("hash")
    texts = [r["head"].encode() for r in picked.collect()]
    if len(texts) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, texts)) // 4), texts).as_bytes()
    except zstandard.ZstdError:
        return b""


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None, revisit: bool) -> bytes:
    """One record. A revisit has the response's header lines, which tell the full length, but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http if revisit else http + payload
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        lines += [f"X-Refers-To-Page-Id: {refers_to}"] if refers_to is not None else []
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def classified(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages as page_id, url, payload, payload_digest, payload_bytes, refers_to and revisit.

    Of pages with equal payloads that with the largest id is the response and the others revisit it;
    a null payload is an empty one. Null ids are smaller than any other. Where the largest id itself
    is repeated, one of its rows is the response.

    Which row revisits which is told from digests and row numbers alone, with popular digests salted.
    Payloads stay where they lie if the revisits fit in a broadcast; else they are joined by row number,
    of which there is one per row, so a payload that many pages share is spread like any other.
    """
    row = "_row"
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    read = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    read = read.withColumn("payload_digest", digest_column(F.col("payload"))).withColumn(row, F.monotonically_increasing_id())
    read = stored(read, "pages")
    rank = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("id"), F.col(row).alias("row"))
    first = read.groupBy("payload_digest").agg(F.max(rank).alias("top"), F.count("*").alias("same"))
    # Payloads that only one page has need no join.
    shared = first.where("same > 1").select("payload_digest", F.col("top.row").alias("_first"), F.col("top.id").alias("_id"))
    known = F.when(F.col("_id") > -(1 << 63), F.col("_id"))
    again = lookup(read.select("payload_digest", row), shared, "payload_digest", "inner")
    again = stored(again.where(F.col("_first") != F.col(row)).select(row, known.alias("refers_to"), F.lit(True).alias("revisit")), "revisits")
    joined = read.join(F.broadcast(again) if fits(again) else again, row, "left")
    revisit = F.coalesce("revisit", F.lit(False))
    return joined.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "payload_digest",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"), "refers_to", revisit.alias("revisit"),
    )


def archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", dictionary: bytes | None = None) -> DataFrame:
    """Rows (archive, content): the pages as archives of about ``ARCHIVE_BYTES`` of payload each.

    Each task fills its own archives from the rows it has and holds one at a time. Columns other
    than the three are not read; repeated rows keep a record each; no page gives no archive.
    """
    given = fit_dictionary(pages, html) if dictionary is None else dictionary
    shared = pages.sparkSession.sparkContext.broadcast(given)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        known = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        make = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=True, write_checksum=True)
        head = struct.pack("<II", DICTIONARY_MAGIC, len(shared.value)) + shared.value if shared.value else b""
        parts, size = [head], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"archive": [f"part-{task:05d}-{number:05d}.warc.zst"], "content": [b"".join(parts)]},
                pa.schema([("archive", pa.string()), ("content", pa.binary())]),
            )

        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                record = make_record(r["page_id"], r["url"], r["payload"], r["payload_digest"], r["payload_bytes"], r["refers_to"], r["revisit"])
                parts.append(make.compress(record))
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield done()
                    parts, size, number = [head], 0, number + 1
        if len(parts) > 1:
            yield done()

    return classified(pages, key, url, html).mapInArrow(write, "archive string, content binary")


def frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive, each decoded from a frame of its own."""
    at, known = 0, None
    magic = struct.unpack_from("<I", content, 0)[0] if len(content) >= 4 else None
    if magic == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", content, 4)[0] if len(content) >= 8 else len(content)
        if 8 + size > len(content):
            raise ValueError("the dictionary frame is cut off")
        raw, at = content[8 : 8 + size], 8 + size
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 26)
        known = zstandard.ZstdCompressionDict(raw)
    view = memoryview(content)
    while at < len(content):
        if len(content) - at >= 8 and 0x184D2A50 <= struct.unpack_from("<I", content, at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", content, at + 4)[0]
            continue
        one = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
        record = one.decompress(view[at:])
        if not one.eof:
            raise ValueError(f"the frame at byte {at} is cut off")
        yield record
        at = len(content) - len(one.unused_data)


def parse_record(record: bytes) -> dict:
    """Header fields, block and payload of a record; raises ValueError where they contradict each other."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header line without a name")
        fields[name.strip().lower().decode()] = value.strip().decode()
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if needed not in fields:
            raise ValueError(f"no {needed}")
    if not fields["content-length"].isdigit():
        raise ValueError("no length")
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"the block has other than {size} bytes")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{payload_digest(block)}":
        raise ValueError("the block has another digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    found = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http)
    length = int(found[1]) if found else len(payload)
    if fields["warc-type"] == "response":
        if len(payload) != length:
            raise ValueError(f"the payload has other than {length} bytes")
        if "warc-payload-digest" in fields and fields["warc-payload-digest"] != f"sha1:{payload_digest(payload)}":
            raise ValueError("the payload has another digest")
    return {"fields": fields, "payload": payload, "length": length}


def records(files: DataFrame, name: str = "archive", content: str = "content", payloads: bool = True) -> DataFrame:
    """A row per record of all archives: where it stands, page_id, url, type, length, digest, refers_to, payload.

    Every header and length is validated, and a fault raises an error that names the archive and the
    record. Length and digest are those of the full payload, for revisits too. A null or empty
    archive has no records. ``payloads=False`` leaves the payload null, once it has been checked.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("archive", pa.string()), ("record", pa.int32()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string())]
        kinds += [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
        schema = pa.schema(kinds)
        rows, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                archive, n = batch.column(0)[i].as_py(), 0
                for n, record in enumerate(frames(batch.column(1)[i].as_py() or b"")):
                    try:
                        found = parse_record(record)
                    except ValueError as wrong:
                        raise ValueError(f"{archive}, record {n}: {wrong}") from wrong
                    f = found["fields"]
                    number = lambda k: int(f[k]) if k in f else None  # noqa: E731, B023
                    rows.append((archive, n, number("x-page-id"), f.get("warc-target-uri"), f["warc-type"], found["length"],
                                 f.get("warc-payload-digest", "").removeprefix("sha1:") or payload_digest(found["payload"]),
                                 number("x-refers-to-page-id"), found["payload"] if payloads else None))
                    size += len(record)
                    if size > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)

    return files.select(F.col(name), F.col(content)).mapInArrow(read, RECORD)


def write_files(made: DataFrame, folder: str) -> DataFrame:
    """Write archives as files under ``folder``, a URI that every executor reaches; gives their paths.

    A name depends on the task alone and a file is put in place by a move, so a task that runs again
    replaces what it had written. Read them with ``spark.read.format("binaryFile")``.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            paths = []
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                aside = f"{root}/.{archive}.{uuid.uuid4().hex}"
                with store.open_output_stream(aside) as out:
                    out.write(content.as_buffer())
                store.move(aside, f"{root}/{archive}")
                paths.append(f"{root}/{archive}")
            yield pa.RecordBatch.from_pydict({"path": paths}, pa.schema([("path", pa.string())]))

    return made.select("archive", "content").mapInArrow(write, "path string")
