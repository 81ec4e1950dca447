"""One file per recording: a sink that commits whole files, and an inventory that sees each file once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkledger.operators import ordered as o
from talkledger.sources.readers import as_batches, file_part, file_system, listed_files, recording_part
from talkledger.sources.writers import subtitle_cues

ATTEMPTS = "_attempts"


def _written_aside(fs: pyarrow.fs.FileSystem, folder: str, separator: str, batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    """Writes rows (recording, place, part), sorted by recording and place, part after part into a file for each
    recording; the name of a file when it is whole."""
    fs.create_dir(folder, recursive=True)
    name, out = None, None
    try:
        for batch in batches:
            for recording, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if name is None or name != quote(recording, safe=""):
                    if out:
                        out.close()
                        yield name
                    name = quote(recording, safe="")
                    out = fs.open_output_stream(f"{folder}/{name}")
                elif separator:
                    out.write(separator.encode())
                out.write((part or "").encode())
    finally:
        if out:
            out.close()
    if out:
        yield name


def _move(fs: pyarrow.fs.FileSystem, source: str, target: str) -> None:
    """Moves a file; one that another attempt of the task has moved stays as it is."""
    fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
    try:
        fs.move(source, target)
    except OSError:
        gone = fs.get_file_info(source).type == pyarrow.fs.FileType.NotFound
        if not gone or fs.get_file_info(target).type == pyarrow.fs.FileType.NotFound:
            raise


def write_files(parts: DataFrame, root: str, file: str, separator: str = "") -> None:
    """SNK1 to SNK3 as files: ``parts`` is (recording_id, place, part); root/recording_id/``file`` gets them in
    order. Files of other recordings stay. ``root`` is a folder that driver and executors share. A recording is
    one file, so its parts pass through one task, one at a time; rows without a recording are left out.

    Every task writes into a folder of its own, under a name that no reader looks at. Their names go through a
    shuffle, so that no file is moved to its place before all are written, and tasks move them, each file whole;
    the driver sees no name. What a run that broke off left behind takes no part in the next run.
    """
    spark = parts.sparkSession
    rows = parts.where(F.col("recording_id").isNotNull()).select(
        F.col("recording_id").cast("string").alias("recording"), F.col("place").cast("long").alias("place"), F.col("part").cast("string").alias("part")
    )
    attempt = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        task = uuid.uuid4().hex
        names = _written_aside(fs, f"{base}/{ATTEMPTS}/{attempt}/{task}", separator, batches)
        return as_batches(((task, name) for name in names), pa.schema([("task", pa.string()), ("name", pa.string())]))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        n = 0
        for batch in batches:
            for task, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _move(fs, f"{base}/{ATTEMPTS}/{attempt}/{task}/{name}", f"{base}/{name}/{file}")
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"n": [n]})

    ordered = rows.repartition("recording").sortWithinPartitions("recording", "place")
    written = ordered.mapInArrow(write, "task string, name string")
    try:
        # names are few bytes, but each of them is a file to be moved: dealt by a number of its own
        dealt = written.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
        dealt.mapInArrow(move, "n long").agg(F.sum("n")).collect()
    finally:
        fs, base = file_system(root)
        if fs.get_file_info(f"{base}/{ATTEMPTS}/{attempt}").type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(f"{base}/{ATTEMPTS}/{attempt}")


def write_subtitles(entries: DataFrame, root: str, corrected: bool = True, file: str = "subtitles.srt", rows: int = o.SLICE_ROWS) -> None:
    """SNK2: a subtitle file per recording."""
    cues = subtitle_cues(entries, corrected, rows=rows)
    write_files(cues.select("recording_id", F.col("cue").alias("place"), F.col("block").alias("part")), root, file, "\n")


def json_list_parts(rows: DataFrame, order: str, item: Column, field: str) -> DataFrame:
    """Parts of the JSON text {field: [items in order]} of every recording; no text is ever put together in a row."""
    first = rows.groupBy("recording_id").agg(F.min(order).alias("_first"))
    items = rows.join(first, "recording_id").select(
        "recording_id", F.col(order).alias("place"),
        F.concat(F.when(F.col(order) == F.col("_first"), F.lit(f'{{"{field}": [')).otherwise(F.lit(",\n")), F.to_json(item)).alias("part"),
    )
    ends = rows.groupBy("recording_id").agg((F.max(order) + 1).alias("place")).withColumn("part", F.lit("]}"))
    return items.unionByName(ends)


def write_transcripts(entries: DataFrame, root: str, file: str = "transcript.json") -> None:
    """SNK1: a transcript artifact per recording, as SRC3 reads it."""
    fields = ("timestamp", "timestamp_ms", "end_ms", "speaker", "text", "text_corrected")
    write_files(json_list_parts(entries, "seq", F.struct(*fields), "transcript"), root, file)


def take_in_paths(spark: SparkSession, root: str, table: str, checkpoint: str) -> None:
    """SRC7: add every file under ``root`` that was not yet taken in to the inventory table.

    Each run writes (recording_id, file, n) under its number, so that a run that is repeated counts once: a row
    per file, and one per recording for all its new frames. Contents are not read. The paths that a run found
    new are a table in ``checkpoint``; a file there, written last, tells that the run counts. Folders are listed
    and paths compared by tasks, none of them passes the driver. One run at a time.
    """
    fs, base = file_system(checkpoint)
    if fs.get_file_info(f"{base}/sources").type != pyarrow.fs.FileType.NotFound:
        raise ValueError(f"{checkpoint} was written by a file stream; take in all files again with a new table and a new checkpoint")
    fs.create_dir(f"{base}/runs", recursive=True)
    done = [int(x.base_name) for x in fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/runs"))]
    run = max(done, default=-1) + 1
    listed, schema = listed_files(spark, root), "inside string, length long"
    if run:
        seen = spark.read.schema(f"{schema}, run int").parquet(f"{checkpoint}/paths").where(F.col("run") < run)
        listed = listed.join(seen, "inside", "left_anti")
    listed.write.mode("overwrite").parquet(f"{checkpoint}/paths/run={run}")
    new = spark.read.schema(schema).parquet(f"{checkpoint}/paths/run={run}")
    if new.isEmpty():
        return
    rows = new.where("length > 0").select(recording_part(), file_part())
    frames = F.when(F.col("file").startswith("frames/"), "frames/").otherwise(F.col("file"))
    counted = rows.where(~F.col("recording_id").startswith("_")).groupBy("recording_id", frames.alias("file")).agg(F.count(F.lit(1)).alias("n"))
    counted.write.mode("overwrite").parquet(f"{table}/batch={run}")
    fs.open_output_stream(f"{base}/runs/{run}").close()


def taken_in(spark: SparkSession, table: str) -> DataFrame:
    """(recording_id, file, n) of all files taken in so far, as ``artifact_inventory`` takes it."""
    return spark.read.schema("recording_id string, file string, n long, batch long").parquet(table).drop("batch")
