"""WARC archives with a Zstandard dictionary.

Each task writes the records of its partition to files below one folder. A file starts with a
skippable frame that holds the dictionary, built from the file's first records; each record is a
frame of its own, compressed with it, so a reader may start at any record. Of pages with the same
payload (from REVISIT_BYTES on) one is stored, the others as revisits that refer to it.

Files go through pyarrow's file systems to the shared folder. A task writes under names of its own
attempt and hands on the names of finished files only, so what a lost task left is never read.
"""

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.scratch import new_dir, settle

REVISIT_BYTES = 1000
# Pages of one payload are joined with what they refer to in parts of about so many.
PART_PAGES = 10_000
# A file is closed after so many bytes of records; the dictionary has at most so many bytes and is
# built from the file's first records, up to so many bytes of them.
FILE_BYTES = 256 << 20
DICT_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
LEVEL = 6
SKIPPABLE = 0x184D2A5D
CHUNK = 1 << 20

WRITTEN = "file string, records long"
READ = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
        "payload_digest string, payload binary")


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def header(kind: str, fields: dict[str, str], length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items()),
             f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record(page_id, url, payload: bytes, size: int, digest: str, kind: str, refers_to) -> bytes:
    """One record; a revisit has no content, only the digest and size of what it refers to."""
    fields = {
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": str(size),
    }
    if url is not None:
        # A line cannot hold a line break.
        fields["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    if kind == "revisit":
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
        payload = b""
    return header(kind, fields, len(payload)) + payload + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]):
    """A trained dictionary; of few or odd samples, which cannot train one, their own bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(
            b"".join(samples)[:DICT_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_file(sink, records: Iterator[bytes]) -> int:
    """Write records to a binary sink until FILE_BYTES are reached or no record is left."""
    import zstandard

    first, held = [], 0
    for r in records:
        first.append(r)
        held += len(r)
        if held >= SAMPLE_BYTES:
            break
    if not first:
        return 0
    trained = build_dictionary(first)
    raw = trained.as_bytes()
    sink.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
    n = 0
    for r in first:
        sink.write(press.compress(r))
        n += 1
    while held < FILE_BYTES and (r := next(records, None)) is not None:
        sink.write(press.compress(r))
        held += len(r)
        n += 1
    return n


def read_records(source) -> Iterator[bytes]:
    """The records of a file, one at a time, with the dictionary from its first frame."""
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    held = zstandard.ZstdCompressionDict(source.read(size))
    open_, rest = zstandard.ZstdDecompressor(dict_data=held), b""
    while True:
        rest = rest or source.read(CHUNK)
        if not rest:
            return
        frame, parts = open_.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := source.read(CHUNK)):
                raise ValueError("the file ends inside a record")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data
        yield b"".join(parts)


def parse(raw: bytes) -> tuple:
    """A row of READ from a record; the digest of stored content is computed anew and must hold."""
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = body[:int(fields["Content-Length"])]
    number = lambda name: fields[name].removeprefix("<urn:page:").removesuffix(">")
    page_id, kind = number("WARC-Record-ID"), fields["WARC-Type"]
    size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
        raise ValueError(f"record of page {page_id} is damaged")
    refers = int(number("WARC-Refers-To")) if kind == "revisit" else None
    return (int(page_id) if page_id else None, fields.get("WARC-Target-URI"), kind, refers, size,
            digest, payload if kind == "response" else None)


def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with size, digest, kind and refers_to. Payloads are compared by
    SHA-256 and length. Only keys of repeated payloads are aggregated, and only pages of REVISIT_BYTES
    or more are joined with those, a payload with very many pages in parts; shorter ones pass by."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", payload.alias("payload")).withColumns({
        "size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    long_ = F.col("size") >= REVISIT_BYTES
    keys = ["key", "size"]
    full = keyed.where(long_).withColumn("key", F.sha2("payload", 256))
    counted = settle(full.groupBy(*keys).agg(
        F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 AND kept IS NOT NULL"))
    # One row for every PART_PAGES pages at most; the first part of a payload has its other rows' number too.
    parts = F.ceil(F.col("n") / PART_PAGES).cast("int")
    hot = settle(counted.where(F.col("n") > PART_PAGES).select(*keys, parts.alias("parts")))
    repeated = counted.select(*keys, "kept", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    if hot.isEmpty():
        full = full.withColumn("part", F.lit(0))
    else:
        full = full.join(hot, keys, "left").withColumn(
            "part", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    joined = full.join(repeated, [*keys, "part"], "left").select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("kept")).alias("refers_to"))
    return joined.unionByName(keyed.where(~long_).withColumns({
        "kind": F.lit("response"), "refers_to": F.lit(None).cast("long")}))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) below ``folder`` and return the
    files written: file, records. A NULL html is the empty payload; a NULL page_id or url is left
    out of the record. Rows repeated with one page_id are each a record, all responses if that
    page_id is the largest of their payload. No rows give no files."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = _open(folder)
        system.create_dir(path, recursive=True)

        def records() -> Iterator[bytes]:
            for batch in batches:
                for r in batch.astype(object).itertuples(index=False):
                    clean = lambda v: None if v is None or v != v else v
                    refers = clean(r.refers_to)
                    page_id = clean(r.page_id)
                    yield record(
                        None if page_id is None else int(page_id), clean(r.url), clean(r.payload) or b"",
                        int(r.size), r.digest, r.kind, None if refers is None else int(refers))

        left = records()
        while True:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with system.open_output_stream(f"{path}/{name}") as sink:
                n = write_file(sink, left)
            if not n:
                system.delete_file(f"{path}/{name}")
                return
            yield pd.DataFrame({"file": [name], "records": [n]})

    # Settled, so that reading the list of files never writes them again.
    return settle(with_revisits(pages).withColumnRenamed("size", "bytes").select(
        "page_id", "url", "payload", F.col("bytes").alias("size"), "digest", "kind", "refers_to",
    ).mapInPandas(write, WRITTEN))


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """The records of the listed files as rows of READ; a file is read by one task, as a stream."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = _open(folder)
        columns = [c.split()[0] for c in READ.split(", ")]
        for batch in batches:
            for name in batch["file"]:
                rows, held = [], 0
                with system.open_input_stream(f"{path}/{name}") as source:
                    for raw in read_records(source):
                        rows.append(parse(raw))
                        held += len(raw)
                        if held > 8 << 20:
                            yield pd.DataFrame(rows, columns=columns).astype(object)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns).astype(object)

    spread = files.sparkSession.sparkContext.defaultParallelism * 4
    return files.select("file").repartition(spread, "file").mapInPandas(read, READ)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives below ``folder`` (a new one in the shared folder if none is given)
    and read them back: rows of READ."""
    folder = folder or new_dir(pages.sparkSession, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    return read_archives(write_archives(pages, folder), folder)
