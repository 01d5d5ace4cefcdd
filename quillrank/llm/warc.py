"""WARC archives with one Zstandard frame per record and a shared dictionary.

An archive starts with a skippable frame that holds the dictionary, then a
warcinfo record, then one frame per record, so a reader can decompress any
record alone. Payloads that were archived before become revisit records.

Every writing task puts whole archives into the shared folder under names of
its own attempt and returns their list; only listed archives are read, so a
repeated or lost attempt leaves at most an unlisted file.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import with_facts
from .storage import fresh_path, shared_dir, stored

# Frame numbers of the Zstandard and WARC-Zstandard formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
LEVEL, DICTIONARY_BYTES = 3, 65536
#: The dictionary is built from so many records' first bytes at most.
SAMPLE_RECORDS, SAMPLE_BYTES = 512, 8192
ARCHIVE_BYTES, LEAST_REVISIT = 64 << 20, 100


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary; raw content of the samples where training has too few."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 4), samples).as_bytes() if len(samples) >= 16 else b"".join(samples)[:size]
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def leading_frame(dictionary: bytes) -> bytes:
    return DICTIONARY_FRAME.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def _header(fields: list[tuple[str, object]]) -> bytes:
    clean = ((k, "".join(c if c >= " " else "%%%02X" % ord(c) for c in str(v))) for k, v in fields if v is not None)
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean) + "\r\n").encode()


_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool, date: str) -> bytes:
    """One response or revisit record, uncompressed."""
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Page-ID", page), ("Payload-Length", len(payload)),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers, digest)), ("Refers-To-Page-ID", refers)]
    return _header([*fields, ("Content-Length", len(block))]) + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block; raises if the record is cut or malformed."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    if not found or lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC/1.1 record")
    return fields, rest[:size]


def _store(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class _Writer:
    def __init__(self, folder: str, dictionary: bytes, date: str):
        import zstandard

        self.folder, self.dictionary, self.date = folder, dictionary, date
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True).compress
        self.out, self.listed = None, []

    def put(self, record: bytes) -> None:
        if self.out is None:
            self.uri = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
            system, path = _store(self.uri)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            self.out, self.records = system.open_output_stream(path, compression=None), 0
            info = b"software: quillrank\r\nformat: WARC File Format 1.1\r\n"
            fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.uri)), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]
            self.out.write(leading_frame(self.dictionary) + self.compress(_header(fields) + info + b"\r\n\r\n"))
        self.out.write(self.compress(record))
        self.records += 1
        if self.out.tell() >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            size = self.out.tell()
            self.out.close()
            self.listed.append((self.uri, self.records, size))
            self.out = None


def _write(folder: str, dictionary: bytes, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder, dictionary, date)
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to", "revisit")]
            for page, url, html, digest, refers, revisit in zip(*columns, strict=True):
                payload = (html.as_py() or "").encode()
                writer.put(page_record(page.as_py(), url.as_py(), payload, digest.as_py(), refers.as_py(), revisit.as_py(), date))
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in writer.listed], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    return run


def frames(stream, most: int = 1 << 20) -> Iterator[tuple[bytes, bytes]]:
    """(dictionary, record) for every record of an archive, one at a time."""
    import zstandard

    lead = stream.read(8)
    if len(lead) < 8 or int.from_bytes(lead[:4], "little") != DICTIONARY_FRAME:
        raise ValueError("the archive has no leading dictionary frame")
    dictionary = stream.read(int.from_bytes(lead[4:], "little"))
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    waiting = b""
    while waiting or (waiting := stream.read(most)):
        one, made = reader.decompressobj(), []
        while True:
            made.append(one.decompress(waiting))
            if one.eof:
                waiting = one.unused_data
                break
            if not (waiting := stream.read(most)):
                raise ValueError("the archive ends inside a record")
        yield dictionary, b"".join(made)


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, warc_record_id string, payload binary"


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                system, path = _store(uri)
                rows, size = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for _, raw in frames(stream):
                        fields, block = parse_record(raw)
                        kind = fields["WARC-Type"]
                        if kind not in ("response", "revisit"):
                            continue
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(fields["Payload-Length"])):
                            raise ValueError(f"{uri}: the payload of {fields['WARC-Record-ID']} is damaged")
                        page, refers = fields.get("Page-ID"), fields.get("Refers-To-Page-ID")
                        rows.append((page and int(page), fields.get("WARC-Target-URI"), int(fields["Payload-Length"]), digest, kind, refers and int(refers), fields["WARC-Record-ID"], payload if with_payload and kind == "response" else None))
                        size += len(payload) * with_payload
                        if len(rows) >= 5000 or size > 8 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archive every page below ``folder`` (a URI all executors share).

    ``pages`` needs ``page_id``, ``url``, ``html`` (null: empty payload);
    other columns are ignored. Of equal payloads of at least 100 bytes the one
    with the smallest page_id (null only if all are) is the response, as are
    repeated rows of it; the others revisit it. Smaller payloads are all
    responses. Returns the written archives: ``archive``, ``records``,
    ``bytes``; none for an empty table.
    """
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = whole.withColumn("digest", F.sha2(payload, 256)).withColumn("size", F.length(payload))
    firsts = keyed.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = stored(firsts, "firsts")
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    roles = with_facts(keyed, firsts, "digest", "n", total, F.xxhash64("page_id", "url"))
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    rows = roles.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    there = keyed.where("size > 0")
    chosen = [r["digest"] for r in there.select("digest").distinct().orderBy("digest").limit(SAMPLE_RECORDS).collect()]
    heads = there.where(F.col("digest").isin(chosen)).groupBy("digest").agg(F.first(F.substring("html", 1, SAMPLE_BYTES)).alias("head")).orderBy("digest")
    dictionary = train_dictionary([r["head"].encode() for r in heads.collect()])  # SAMPLE_RECORDS rows at most
    return stored(rows.mapInArrow(_write(folder, dictionary, date), "archive string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Every response and revisit of ``archives(archive)``, payloads verified.

    Raises if an archive is cut, damaged or lacks its dictionary. ``payload``
    is null for revisits and unless ``payloads``.
    """
    spark = archives.sparkSession
    listed = archives.select("archive")
    spread = listed.repartition(max(1, min(listed.count(), 4 * spark.sparkContext.defaultParallelism)))
    return spread.mapInArrow(_read(payloads), _READ)


def archive_folder(pages: DataFrame) -> str:
    """A new archive folder below the session's shared one."""
    spark = pages.sparkSession
    where = fresh_path(spark, "warc")
    if "://" not in where and not where.startswith("/"):
        raise ValueError(f"{shared_dir(spark)} must be a URI or an absolute path")
    return where if "://" in where else f"file://{where}"
