"""WARC archives: one gzip member per record, and a splittable reader.

The writer leaves the files to Spark's text writer, so that they go to any file system, are committed
once and survive lost executors: a member is written as a line whose separator is the zero byte that
ends it. The reader lets Spark cut the files into byte ranges and at every gzip magic; a task owns
the members that start inside its range, tells real starts from chance ones by decoding headers,
and hands the rare member that a chance magic cuts across two ranges to a stitching step.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkledger.llm.common import stored, text_bytes

MAGIC = b"\x1f\x8b\x08"
#: Fixed value: a gzip member without content; it ends in zero bytes.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
#: Files named *.gz are to be read as they are, in byte ranges. Hadoop looks a codec up under the last
#: suffix that sorts before the (reversed) name; one that sorts just behind ".gz" and fits no name
#: stands in its way.
RAW = {
    "io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec",
    # the option's name in Hadoop itself and in the relocated client that Spark ships
    "io.compress.passthrough.extension": ".!.gz",
    "org.apache.hadoop.shaded.io.compress.passthrough.extension": ".!.gz",
}
VERSION = b"WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORD = (
    "record_id string, record_type string, target_uri string, date string, refers_to_id string, payload_digest string, "
    "payload_bytes long, page_id string, payload binary, error string"
)
FIELDS = [f.split()[0] for f in RECORD.split(", ")]


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str | None) -> str:
    """A header value on one line."""
    return "" if value is None else "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def member(record: dict) -> bytes:
    """One gzip member, ending in a zero byte, that holds the record."""
    payload, again = record["payload"], record["record_type"] == "revisit"
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    block = "\r\n".join([*head, "", ""]).encode() + (b"" if again else payload)
    fields = [
        ("WARC-Type", record["record_type"]), ("WARC-Record-ID", f"<{record['record_id']}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", _line(record["target_uri"])), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if again:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", f"<{record['refers_to_id']}>"))
    if record["page_id"] is not None:
        fields.append(("X-Page-Id", _line(record["page_id"])))
    fields.append(("Content-Length", str(len(block))))
    text = VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(text) + packer.flush()
    return out if out.endswith(b"\x00") else out + EMPTY_MEMBER


def parsed(text: bytes) -> dict:
    """The record in an uncompressed member; ``error`` says what is wrong with it."""
    out = dict.fromkeys(FIELDS)
    head, _, block = text.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    values = {}
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        values[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    kind = values.get("warc-type")
    out |= {
        "record_id": values.get("warc-record-id", "").strip("<>") or None, "record_type": kind,
        "target_uri": values.get("warc-target-uri"), "date": values.get("warc-date"), "page_id": values.get("x-page-id"),
        "refers_to_id": values.get("warc-refers-to", "").strip("<>") or None,
        "payload_digest": values.get("warc-payload-digest", "").removeprefix("sha1:") or None,
    }
    try:
        block = block[: int(values["content-length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        declared = [v for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"]
        if kind == "revisit":
            out["payload_bytes"] = int(declared[0])
        else:
            out["payload"], out["payload_bytes"] = payload, len(payload)
            if declared and int(declared[0]) != len(payload):
                out["error"] = "payload is cut"
            elif out["payload_digest"] not in (None, digest_of(payload)):
                out["error"] = "payload differs from its digest"
    except (KeyError, ValueError, IndexError) as e:
        out["error"] = f"bad header: {e!r}"
    return out


class Members:
    """Puts members together again out of the chunks between gzip magics, in order."""

    def __init__(self) -> None:
        self.open = None
        self.held: list[bytes] = []
        self.text = b""

    @staticmethod
    def starts(raw: bytes) -> bool:
        """Whether the chunk begins a member: its gzip header decodes and a WARC version follows."""
        if len(raw) < 10 or raw[3] & 0xE0:
            return False
        try:
            begin = zlib.decompressobj(31).decompress(raw[:4096], 16)
        except zlib.error:
            return False
        return begin.startswith(b"WARC/") or raw.startswith(EMPTY_MEMBER)

    def feed(self, raw: bytes) -> list[bytes | int]:
        """Contents of the members that the chunk completes; sizes of what turns out to be broken."""
        if self.open is None:
            if not self.starts(raw):
                return [len(raw)]
            self.open, self.held, self.text = zlib.decompressobj(31), [], b""
        try:
            self.text += self.open.decompress(raw)
        except zlib.error:
            broken, again = sum(map(len, self.held)), bool(self.held) and self.starts(raw)
            self.open = None
            return [broken, *self.feed(raw)] if again else [broken + len(raw)]
        self.held.append(raw)
        if not self.open.eof:
            return []
        self.open = None
        return [self.text]


def _row(done: bytes | int) -> dict | None:
    """The record row of what ``Members.feed`` gives; None for an empty member."""
    if isinstance(done, int):
        return dict.fromkeys(FIELDS) | {"error": f"{done} bytes that are no record"}
    return parsed(done) if done else None


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    for batch in batches:
        for file, begin, piece in zip(*(batch.column(c) for c in range(3))):
            yield file.as_py(), begin.as_py(), piece.as_py()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that start and end in a byte range; chunks that belong to the range before, or run on."""
    names = [*FIELDS, "_file", "_range", "_place", "_loose"]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    out: list[list] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * len(names)
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
        out.clear()
        return made

    def loose(chunks: list[bytes]) -> None:
        for chunk in chunks:
            out.append([None] * len(FIELDS) + [where[0], where[1], place, chunk])

    where, reader, begun, place, size = None, Members(), False, 0, 0
    for file, begin, piece in _pieces(batches):
        if where != (file, begin):
            if reader.open is not None:
                loose(reader.held)
            where, reader, begun, place = (file, begin), Members(), False, 0
        place += 1
        raw = MAGIC + piece
        if not piece and place == 1 and begin == 0:
            continue  # what stands before the first magic of a file
        begun = begun or reader.starts(raw)
        if not begun:
            loose([raw])
            continue
        for found in map(_row, reader.feed(raw)):
            if found:
                out.append([found[f] for f in FIELDS] + [file, begin, place, None])
                size += found["payload_bytes"] or 0
        if size > 1 << 24:
            yield batch()
            size = 0
    if reader.open is not None:
        loose(reader.held)
    yield batch()


def _stitched(group: pd.DataFrame) -> pd.DataFrame:
    """Records out of the loose chunks of a file, in order of range and place."""
    reader, rows = Members(), []
    for raw in group.sort_values(["_range", "_place"], kind="stable")["_loose"]:
        rows += filter(None, map(_row, reader.feed(raw)))
    if reader.open is not None:
        rows.append(dict.fromkeys(FIELDS) | {"error": "the last record is cut"})
    return pd.DataFrame(rows, columns=FIELDS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under ``path``.

    Broken or cut members become rows with ``error`` set and no record; an archive without records
    gives none. Only chunks of members that a chance magic splits across two byte ranges are brought
    together, per file; they are a handful in a file.
    """
    pieces = (
        spark.read.options(**RAW).option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
        .select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("value"))
    )
    rows = pieces.mapInArrow(_records, f"{RECORD}, _file string, _range long, _place long, _loose binary")
    rows = stored(rows, "records")
    whole = rows.where("_loose is null").select(*FIELDS)
    rest = rows.where("_loose is not null")
    return whole.unionByName(rest.groupBy("_file").applyInPandas(_stitched, RECORD))


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [member(record)[:-1] for record in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["value"])


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")))


def write(
    pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
    least_bytes: int = 0,
) -> None:
    """One record per row of ``pages``; payload is the text in UTF-8, null counts as empty.

    Of records with equal payloads of at least ``least_bytes`` bytes that with the smallest id is the
    response and the others are revisits of it, without payload; shorter payloads are all responses.
    Rows without an id are responses. Rows that agree in id and payload are one page, written as often
    as it occurs; other columns are ignored; an empty table gives an archive without records. Only ids
    and digests are grouped; digests that most pages share are counted before the shuffle and split by
    adaptive execution in the join.
    """
    own = pages.select(
        F.col(f"`{id_column}`").cast("long").alias("_id"), F.col(f"`{url_column}`").cast("string").alias("target_uri"),
        text_bytes(payload_column).alias("payload"),
    ).withColumn("_sha", F.sha1("payload"))
    digests = stored(own.select("_id", "_sha", F.octet_length("payload").alias("_bytes")), "digests")
    able = digests.where(f"_id is not null and _bytes >= {least_bytes}")
    firsts = able.groupBy("_sha").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last")
    firsts = stored(firsts.select(F.col("_sha").alias("_same"), "_first"), "firsts")
    revisits = able.join(firsts, F.col("_sha") == F.col("_same")).where("_id <> _first").distinct()
    revisits = stored(revisits.select(F.col("_id").alias("_page"), "_same", "_first"), "revisits")
    joined = own.join(revisits, (F.col("_id") == F.col("_page")) & (F.col("_sha") == F.col("_same")), "left")
    again = F.col("_first").isNotNull()
    records = joined.select(
        _name(F.col("_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(again, _name(F.col("_first"))).alias("refers_to_id"), F.col("_id").cast("string").alias("page_id"), "payload",
    )
    lines = records.mapInArrow(_written, "value binary")
    lines.select(F.col("value").cast("string")).write.option("lineSep", "\x00").text(path)


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records that ``write`` wrote.

    A broken record stops the query: a whole archive has none.
    """
    refers = F.regexp_extract("refers_to_id", "^urn:page:(-?[0-9]+)$", 1)
    whole = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("broken record: "), "error")))
    return records.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(whole.cast("long"), "payload_bytes").alias("payload_bytes"),
        "payload_digest", "record_type", F.when(F.col("refers_to_id").isNotNull(), refers.cast("long")).alias("refers_to"),
    )
