"""WARC archives under Zstandard: one frame per record, the dictionary in the leading skippable frame.

Writing: equal payloads are found by digest; the record of the largest id is a response, the
others are revisits that refer to it. Records become frames in tasks and go through Spark's text
sink as raw bytes, one row a frame, with an empty skippable frame as line separator. So
files appear in any store Spark writes to, by its commit protocol, and a lost task leaves nothing.
Every file starts with the dictionary, trained on a bounded sample of payloads
(``sample`` payloads of at most ``longest`` bytes, the smallest digests).

Reading: files come from the ``binaryFile`` source, one per row, as large as a partition of the
input made them. The reader walks the frame and block headers, takes the dictionary from the first
frame (plain or compressed), decodes one frame at a time and checks version line, required
headers, Content-Length, record end, and digest and length of the payload. What fails is a row
with ``error`` and no other value.

Null payloads are empty. With a least size for revisits, smaller payloads are all responses. Rows of
the same largest id and payload are all responses; a null id is never referred to unless all are
null, and then its records are responses. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from takeup.llm.common import bounded_batches, stage
from takeup.session import new_path

DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
ZSTD_MAGIC = 0xFD2FB528
#: An empty skippable frame; all its bytes are ASCII, so it can be a line separator.
SEPARATOR = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, uri string, record_type string, refers_to string, digest string, payload_bytes long, error string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def format_record(number, uri: str | None, payload: bytes, refers_to) -> bytes:
    """One record; a revisit has headers only and the digest and length of the full payload."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if number is None else number}>",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join((uri or '').split())}",
             f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Checked fields of one record; raises ``ValueError`` on what does not fit."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line[:40]!r}")
        fields[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(fields)
    if missing:
        raise ValueError(f"missing header {min(missing)}")
    size = int(fields["content-length"])
    if size < 0 or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"length {len(rest) - 4} instead of {size}")
    kind, body = fields["warc-type"], rest[:size]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        length = int(fields.get("x-payload-length", -1))
        if length < 0 or "warc-refers-to" not in fields or len(digest) != 32:
            raise ValueError("revisit without reference, digest or length")
    else:
        length = size
        if digest and digest != digest_of(body):
            raise ValueError("payload digest differs")
    plain = lambda v: None if v is None else v.strip("<>").removeprefix("urn:page:")
    return {"record_id": plain(fields["warc-record-id"]), "uri": fields.get("warc-target-uri"), "record_type": kind,
            "refers_to": plain(fields.get("warc-refers-to")), "digest": digest or digest_of(body), "payload_bytes": length,
            "error": None}


# -- frames -----------------------------------------------------------------------

def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


def frame_end(data: memoryview, at: int) -> int:
    """End of the Zstandard or skippable frame that starts at ``at``."""
    magic, = struct.unpack_from("<I", data, at)
    if magic in SKIPPABLE:
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    elif magic == ZSTD_MAGIC:
        flags = data[at + 4]
        single = flags >> 5 & 1
        size_bytes = (single, 2, 4, 8)[flags >> 6]
        end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + size_bytes
        last = False
        while not last:
            header = int.from_bytes(data[end:end + 3], "little")
            if end + 3 > len(data):
                raise ValueError("truncated frame")
            last, kind, size = header & 1, header >> 1 & 3, header >> 3
            if kind == 3:
                raise ValueError("reserved block type")
            end += 3 + (1 if kind == 1 else size)
        end += 4 * (flags >> 2 & 1)
    else:
        raise ValueError(f"no frame at byte {at}")
    if end > len(data):
        raise ValueError("truncated frame")
    return end


def read_archive(content: bytes) -> Iterator[dict]:
    """Records of one archive; an unreadable rest is one row with ``error``."""
    import zstandard

    data, at, dictionary = memoryview(content), 0, None
    decoder = zstandard.ZstdDecompressor()
    while at < len(data):
        try:
            end = frame_end(data, at)
        except (ValueError, struct.error, IndexError) as e:
            yield {"error": f"frame: {e}"}
            return
        magic, = struct.unpack_from("<I", data, at)
        if magic == DICTIONARY_FRAME and at == 0:
            raw = bytes(data[8:end])
            if raw[:4] == struct.pack("<I", ZSTD_MAGIC):
                raw = decoder.decompressobj().decompress(raw)
            dictionary = zstandard.ZstdCompressionDict(raw)
            decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
        elif magic == ZSTD_MAGIC:
            try:
                # content size may be absent in archives of others
                yield parse_record(decoder.decompressobj().decompress(data[at:end]))
            except (ValueError, zstandard.ZstdError) as e:
                yield {"error": f"record: {e}"[:200]}
        at = end


# -- Spark ------------------------------------------------------------------------

def train_dictionary(pages: DataFrame, payload: str, sample: int = 400, longest: int = 1 << 16, size: int = 1 << 15) -> bytes:
    """Dictionary from a bounded sample; empty where there is too little to learn from."""
    import zstandard

    few = pages.select(F.col(payload).alias("p"), F.sha1(payload).alias("d")).where(
        F.octet_length("p").between(1, longest)).dropDuplicates(["d"]).select("d")
    chosen = stage(few.orderBy("d").limit(sample), "warc_sample")
    rows = pages.select(F.col(payload).alias("p"), F.sha1(payload).alias("d")).join(F.broadcast(chosen), "d").dropDuplicates(["d"])
    samples = [bytes(r["p"]) for r in rows.orderBy("d").collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (``id``, ``payload``) with ``refers_to`` where a record is a revisit."""
    keyed = pages.withColumn("d", F.sha1("payload"))
    groups = keyed.where(F.octet_length("payload") >= min_bytes).groupBy("d").agg(
        F.max("id").alias("original"), F.count("*").alias("n"))
    repeated = stage(groups.where("n > 1 and original is not null").select("d", "original"), "warc_repeated")
    rows = keyed.join(repeated, "d", "left")
    return rows.withColumn("refers_to", F.expr("case when not (id <=> original) then original end")).drop("d", "original")


def write_archives(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url",
                   payload_column: str = "html", min_bytes: int = 0, level: int = 3) -> None:
    """One archive per task below ``path``."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"),
                        F.coalesce(F.col(payload_column).cast("binary"), F.lit(b"")).alias("payload"))
    dictionary = train_dictionary(rows, "payload")

    def frames(batches):
        import pyarrow as pa
        import zstandard

        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        encoder = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True)
        first = [dictionary_frame(dictionary)] if dictionary else []
        for batch in batches:
            out = first + [encoder.compress(format_record(*(column.as_py() for column in row)))
                           for row in zip(*(batch.column(c) for c in ("id", "url", "payload", "refers_to")))]
            first = []
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], ["frame"])

    done = with_originals(rows, min_bytes).select("id", "url", "payload", "refers_to").mapInArrow(frames, "frame binary")
    # a binary cast to string keeps its bytes; the sink writes them as they are
    done.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives below ``path``."""
    bounded_batches(spark)
    names = [part.split()[0] for part in RECORD.split(", ")]

    def records(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                rows: list[dict] = []
                for record in read_archive(content.as_py()):
                    rows.append({n: record.get(n) for n in names})
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema(pa))
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema(pa))

    def schema(pa):
        return pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.string()) for n in names])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, RECORD)


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """What the archives of ``pages`` say once written and read back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, **options)
    rows = read_archives(spark, path)
    return rows.select(F.expr("try_cast(record_id as bigint)").alias("page_id"), "payload_bytes",
                       F.col("digest").alias("payload_digest"), "record_type",
                       F.expr("try_cast(refers_to as bigint)").alias("refers_to"), "error")
