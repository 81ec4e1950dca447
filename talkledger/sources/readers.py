"""Sources: rule sheets, hotwords, artifacts, media, inventories."""

from __future__ import annotations

import csv
import io
import os
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkledger import fixed_values as fixed
from talkledger import schemas
from talkledger.functions import responses as r
from talkledger.functions import text as t
from talkledger.operators.batches import PIECE_BYTES, pieces


#: Rows that a task gives out at once.
LISTED_ROWS = 1 << 13


def file_system(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a root and the path in it: a mounted folder, or what a URI such as hdfs:// or s3:// names."""
    if root.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(root) if "://" in root else (pyarrow.fs.LocalFileSystem(), root)


def _inside(fs: pyarrow.fs.FileSystem, base: str, below: str = "") -> Iterator[tuple[str, bool, int]]:
    """(path from ``base``, is a folder, length) of what a folder holds, without what Spark's readers leave out."""
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        with os.scandir(f"{base}/{below}") as found:
            entries = ((x.name, x.is_dir(), x) for x in found)
            for name, folder, x in entries:
                if not _hidden(name, folder):
                    yield below + name, folder, 0 if folder else x.stat().st_size
    else:
        for x in fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/{below}".rstrip("/"))):
            folder = x.type == pyarrow.fs.FileType.Directory
            if not _hidden(x.base_name, folder):
                yield below + x.base_name, folder, x.size or 0


def _hidden(name: str, folder: bool) -> bool:
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _below(fs: pyarrow.fs.FileSystem, base: str, folder: str) -> Iterator[tuple[str, int]]:
    open_ = [folder]
    while open_:
        for path, is_folder, length in _inside(fs, base, open_.pop() + "/"):
            if is_folder:
                open_.append(path)
            else:
                yield path, length


def as_batches(rows: Iterable[tuple], schema: pa.Schema, most: int = LISTED_ROWS) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """(inside, length) of all files under ``root``, by their path from there; no contents are read.

    Tasks list the folders and keep the names, so that the driver sees none of them: one task the names right
    under ``root``, all tasks together what is below. ``root`` is a folder that executors see, by a path or a
    URI that pyarrow knows. Hidden files are left out as Spark's readers leave them out.
    """
    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("inside", pa.string()), ("folder", pa.bool_()), ("length", pa.int64())])
        for batch in batches:
            if batch.num_rows:
                yield from as_batches(_inside(*file_system(root)), schema)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, base), schema = file_system(root), pa.schema([("inside", pa.string()), ("length", pa.int64())])
        folders = (x for batch in batches for x in batch.column(0).to_pylist())
        return as_batches((found for x in folders for found in _below(fs, base, x)), schema)

    first = spark.range(0, 1, 1, 1).mapInArrow(top, "inside string, folder boolean, length long")
    # by a number of its own: the names are few bytes, but each of them is a folder to be listed
    dealt = first.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "inside")

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folder = batch.column(1)
            yield batch.filter(pc.invert(folder)).select(["inside", "length"])
            yield from below([batch.filter(folder)])

    return dealt.mapInArrow(every, "inside string, length long")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of whole files, found recursively."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", "content")
    )


def _decoded(data: bytes, encodings: Sequence[str]) -> str | None:
    for name in encodings:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return None


def sheet_rows(
    files: DataFrame, encodings: Sequence[str] = fixed.SHEET_ENCODINGS
) -> DataFrame:
    """SRC1: (sheet_id, content) CSV files to (sheet_id, row_idx, cells); blank rows skipped,
    ragged rows kept. A file no encoding fits gives one row with null cells."""
    key = dict(files.dtypes)["sheet_id"]

    def lines(content: pa.Array) -> Iterator[tuple[int, int, list[str] | None]]:
        for sheet in range(len(content)):
            text = _decoded(content[sheet].as_py(), encodings)
            if text is None:
                yield sheet, 0, None
            else:
                for i, cells in enumerate(c for c in csv.reader(io.StringIO(text)) if c):
                    yield sheet, i, cells

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 31)
        for sheets in pieces(batches):

            def table(rows: list) -> pa.RecordBatch:
                sheet, place, cells = zip(*rows)
                columns = [sheets.column("sheet_id").take(pa.array(sheet)), pa.array(place, pa.int64()), pa.array(cells, pa.list_(pa.string()))]
                return pa.RecordBatch.from_arrays(columns, ["sheet_id", "row_idx", "cells"])

            rows, size = [], 0
            for row in lines(sheets.column("content")):
                rows.append(row)
                # an empty cell takes memory too
                size += sum(len(c) + 50 for c in row[2] or ())
                if size > PIECE_BYTES:
                    yield table(rows)
                    rows, size = [], 0
            if rows:
                yield table(rows)

    return files.select("sheet_id", "content").mapInArrow(
        split, f"sheet_id {key}, row_idx bigint, cells array<string>"
    )


def hotword_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a hotword file."""
    return spark.read.text(path, wholetext=True).select(
        F.posexplode(F.split("value", "\r\n|\n|\r")).alias("line_no", "line")
    )


def hotwords(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """SRC4: (wrong, right, kind, line_no); the last line of a word counts. Words compare
    without case, as they do when they are replaced."""
    return (
        _hotword_entries(lines, keys)
        .groupBy(*keys, F.lower("wrong").alias("_word"))
        .agg(F.max_by(F.struct("wrong", "right", "kind", "line_no"), F.col("line_no")).alias("_row"))
        .select(*keys, "_row.*")
    )


def _hotword_entries(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    line = t.strip("line")
    mapped = F.contains(F.col("_l"), F.lit("->"))
    wrong = t.strip(F.regexp_extract("_l", r"(?s)^(.*?)->", 1))
    right = t.strip(F.regexp_extract("_l", r"(?s)^.*?->(.*)\z", 1))
    return (
        lines.withColumn("_l", line)
        .where((F.col("_l") != "") & ~F.col("_l").startswith("#"))
        .select(
            *keys,
            "line_no",
            F.when(mapped, wrong).otherwise(F.col("_l")).alias("wrong"),
            F.when(mapped, right).otherwise(F.col("_l")).alias("right"),
            F.when(mapped, "mapping").otherwise("protected").alias("kind"),
        )
        .where((F.col("wrong") != "") & (F.col("right") != ""))
    )


def hotword_list(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """SRC5, file part: words for the recogniser in file order, repeats kept."""
    return _hotword_entries(lines, keys).select(*keys, "line_no", F.col("right").alias("word"))


def request_hotwords(requests: DataFrame, shared: Sequence[str] = ()) -> DataFrame:
    """SRC5, request part: shared words, then the request's own JSON array of strings.

    ``words`` is null when there are none; ``reject_reason`` names invalid input.
    """
    given = F.col("hotwords")
    value = r.parsed(given)
    absent = given.isNull() | (given == "")
    valid = r.kind(value).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.is_variant_null(value)
    valid = valid & ~F.exists(
        F.try_variant_get(value, "$", "array<variant>"), lambda v: F.is_variant_null(v)
    )
    own = F.coalesce(F.try_variant_get(value, "$", "array<string>"), F.array().cast("array<string>"))
    base = F.array(*[F.lit(w) for w in shared]) if shared else F.array().cast("array<string>")
    words = F.when(absent, base).when(valid, F.concat(base, own))
    reason = (
        F.when(absent, None)
        .when(value.isNull(), "not valid JSON")
        .when(~F.coalesce(valid, F.lit(False)), "not an array of strings")
    )
    return requests.withColumn("words", F.when(F.size(words) > 0, words)).withColumn("reject_reason", reason)


def read_artifacts(files: DataFrame, name: str) -> DataFrame:
    """SRC3: (recording_id, content) files of one artifact to (recording_id, value, corrupt).

    ``content`` is text or bytes; a file that cannot be read has value null and corrupt true.
    """
    content = F.col("content")
    if dict(files.dtypes)["content"] == "binary":
        content = F.try_validate_utf8(content.cast("string"))
    ddl = schemas.ARTIFACTS[name]
    readable = r.parsed(content).isNotNull()
    return files.select(
        "recording_id",
        F.when(readable, F.from_json(content, ddl, {"mode": "PERMISSIVE"})).alias("value"),
        F.coalesce(~readable, F.lit(True)).alias("corrupt"),
    )


def artifact_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(recording_id, content) of ``root``/recording/``name``, found and read by tasks."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        held, size = [], 0
        for inside in (x for batch in batches for x in batch.column(0).to_pylist()):
            with fs.open_input_stream(f"{base}/{inside}") as source:
                held.append((inside.split("/", 1)[0], source.read()))
            size += len(held[-1][1])
            if size > PIECE_BYTES or len(held) == LISTED_ROWS:
                yield from as_batches(held, schema)
                held, size = [], 0
        yield from as_batches(held, schema)

    schema = pa.schema([("recording_id", pa.string()), ("content", pa.binary())])
    found = listed_files(spark, root).where((F.col("length") > 0) & (F.substring_index("inside", "/", -1) == name))
    return found.select("inside").mapInArrow(read, "recording_id string, content binary")


def artifact_paths(spark: SparkSession, root: str) -> DataFrame:
    """(recording_id, file) of everything under ``root``; contents are not read."""
    return listed_files(spark, root).where("length > 0").select(recording_part(), file_part())


def recording_part() -> Column:
    return F.split_part("inside", F.lit("/"), F.lit(1)).alias("recording_id")


def file_part() -> Column:
    return F.regexp_replace("inside", "^[^/]*/", "").alias("file")


def entries_of(transcripts: DataFrame) -> DataFrame:
    """Entry rows of read transcripts."""
    return transcripts.select(
        "recording_id", F.posexplode("value.transcript").alias("seq", "_e")
    ).select("recording_id", F.col("seq").cast("long").alias("seq"), "_e.*")


def media_inventory(files: DataFrame) -> DataFrame:
    """SRC6: (path, content) to path, content hash and media type."""
    return files.select(
        "path", F.sha2("content", 256).alias("content_hash"), t.media_type("path").alias("media_type")
    )


def artifact_inventory(paths: DataFrame, metas: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """SRC7: one row per recording with a readable meta.

    ``paths`` is (recording_id, file), or (recording_id, file, n) with frames counted before; ``metas``
    the recordings whose meta could be read, ``legacy`` (recording_id, path) of media kept in the old
    shared folder.
    """
    n = F.col("n") if "n" in paths.columns else F.lit(1).cast("long")

    def has(name: str) -> Column:
        return F.bool_or(F.col("file") == name)

    audio = F.col("file").startswith("audio.")
    found = paths.groupBy("recording_id").agg(
        has("transcript.json").alias("has_transcript"),
        has("evaluation.json").alias("has_evaluation"),
        has("compliance.json").alias("has_compliance"),
        has("ocr_results.json").alias("has_ocr_results"),
        has("visual_events.json").alias("has_visual_events"),
        F.min(F.when(F.col("file").startswith("video."), F.col("file"))).alias("_video"),
        F.sum(F.when(F.col("file").startswith("frames/"), n)).alias("keyframe_count"),
        F.min(F.when(audio, F.col("file"))).alias("_audio"),
    )
    rows = metas.select("recording_id").distinct().join(found, "recording_id", "left")
    old = F.lit(None).cast("string")
    if legacy is not None:
        rows = rows.join(
            legacy.groupBy("recording_id").agg(F.min("path").alias("_legacy")), "recording_id", "left"
        )
        old = F.col("_legacy")
    flags = ("has_transcript", "has_evaluation", "has_compliance", "has_ocr_results", "has_visual_events")
    return rows.select(
        "recording_id",
        *[F.coalesce(f, F.lit(False)).alias(f) for f in flags],
        F.col("_video").isNotNull().alias("has_video"),
        F.coalesce("keyframe_count", F.lit(0)).alias("keyframe_count"),
        F.coalesce("_audio", old).alias("audio_path"),
        F.coalesce("_video", "_audio", old).alias("media_path"),
    )


def restorable(inventory: DataFrame, transcripts: DataFrame) -> DataFrame:
    """SRC7: recordings with a transcript that could be read."""
    good = transcripts.where(~F.col("corrupt")).select("recording_id").distinct()
    return inventory.where("has_transcript").join(good, "recording_id", "left_semi")


def ingest_decisions(uploads: DataFrame, index: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(upload_id, content_hash) against (content_hash, recording_id).

    ``existing`` when the indexed recording has a transcript, ``stale`` when it has none,
    ``new`` otherwise; further uploads of a new or stale content in the batch are ``repeat``.
    """
    first = uploads.groupBy("content_hash").agg(F.min("upload_id").alias("_first"))
    done = transcripts.select("recording_id").distinct().withColumn("_done", F.lit(True))
    known = first.join(index, "content_hash", "left").join(done, "recording_id", "left")
    verdict = known.select(
        "content_hash", "_first",
        F.when(F.col("_done"), F.col("recording_id")).alias("existing_id"),
        F.when(F.col("_done"), "existing").when(F.col("recording_id").isNotNull(), "stale").otherwise("new").alias("_v"),
    )
    decision = F.when((F.col("_v") != "existing") & (F.col("upload_id") != F.col("_first")), "repeat").otherwise(F.col("_v"))
    return uploads.join(verdict, "content_hash").select("upload_id", "content_hash", "existing_id", decision.alias("decision"))


def stale_index(index: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Index entries whose recording has no transcript."""
    return index.join(transcripts.select("recording_id"), "recording_id", "left_anti")


def checked_inputs(rows: DataFrame) -> DataFrame:
    """Why a request (request_kind, transcript, text, hotwords) is refused; null if fine."""
    entries = r.parsed(F.col("transcript"))
    listed = F.try_variant_get(entries, "$", "array<variant>")
    audit = (
        F.when(entries.isNull(), "transcript is not valid JSON")
        .when(listed.isNull(), "transcript is not a JSON array")
        .when(F.size(listed) == 0, "transcript is empty")
    )
    blank = F.when(F.coalesce(t.is_blank("text"), F.lit(True)), "text is blank")
    words = request_hotwords(rows)
    return words.withColumn(
        "reject_reason",
        F.when(F.col("request_kind") == "audit", audit)
        .when(F.col("request_kind") == "evaluation", blank)
        .otherwise(F.col("reject_reason")),
    ).drop("words")
