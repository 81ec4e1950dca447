"""Sources and sinks on real files."""

import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from talkledger.sources import files, readers, writers


def test_rule_sheets_in_several_encodings(spark, tmp_path):
    text = io.StringIO()
    csv.writer(text).writerows([["1规则", "案例,一"], [], ["2规则"], ["说\n明", "x"]])
    body = text.getvalue()
    (tmp_path / "a.csv").write_bytes(body.encode("gbk"))
    (tmp_path / "b.csv").write_bytes(body.encode("utf-8-sig"))
    (tmp_path / "c.csv").write_bytes(b"\xff\xff\xff")
    files = readers.read_files(spark, str(tmp_path), "*.csv").withColumn("sheet_id", F.regexp_extract("path", r"(\w)\.csv", 1))
    got = readers.sheet_rows(files).orderBy("sheet_id", "row_idx").collect()
    rows = {s: [r.cells for r in got if r.sheet_id == s] for s in "abc"}
    assert rows["a"] == rows["b"] == [["1规则", "案例,一"], ["2规则"], ["说\n明", "x"]]
    assert rows["c"] == [None]


def test_hotword_file(spark, tmp_path):
    path = tmp_path / "hotwords.txt"
    path.write_text("# head\n\n利率\n加希->加息\n利率->利息\nx->\n", encoding="utf-8")
    lines = readers.hotword_lines(spark, str(path))
    assert {(r.wrong, r.right, r.kind) for r in readers.hotwords(lines).collect()} == {("利率", "利息", "mapping"), ("加希", "加息", "mapping")}
    assert [r.word for r in readers.hotword_list(lines).orderBy("line_no").collect()] == ["利率", "加息", "利息"]


def test_artifacts_and_inventory(spark, tmp_path):
    def put(recording, name, body):
        path = tmp_path / recording / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)

    entry = {"timestamp": "00:01", "timestamp_ms": 1000, "end_ms": 2000, "speaker": "Speaker 1", "text": "a", "text_corrected": "b"}
    put("r1", "meta.json", b'{"filename": "x.mp4"}')
    put("r1", "transcript.json", json.dumps({"transcript": [entry], "processing_time_ms": 1}).encode())
    put("r1", "video.mp4", b"v")
    put("r1", "frames/0001.jpg", b"f")
    put("r1", "frames/0002.jpg", b"g")
    put("r2", "meta.json", b"{}")
    put("r2", "transcript.json", b'{"transcript": [')
    put("r2", "audio.wav", b"a")
    put("r3", "meta.json", b"{broken")
    put("r3", "audio.wav", b"a")
    root = str(tmp_path)
    read = readers.read_artifacts(readers.artifact_files(spark, root, "transcript.json"), "transcript.json")
    assert {r.recording_id: r.corrupt for r in read.collect()} == {"r1": False, "r2": True}
    assert [r.text_corrected for r in readers.entries_of(read).collect()] == ["b"]
    metas = readers.read_artifacts(readers.artifact_files(spark, root, "meta.json"), "meta.json").where("NOT corrupt")
    inv = readers.artifact_inventory(readers.artifact_paths(spark, root), metas)
    got = {r.recording_id: r for r in inv.collect()}
    assert set(got) == {"r1", "r2"}
    assert (got["r1"].keyframe_count, got["r1"].has_video, got["r1"].media_path, got["r1"].audio_path) == (2, True, "video.mp4", None)
    assert (got["r2"].has_transcript, got["r2"].media_path) == (True, "audio.wav")
    assert [r.recording_id for r in readers.restorable(inv, read).collect()] == ["r1"]


def test_a_repeated_run_replaces_only_itself(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "recording_id long, v string")
    two = df.where("recording_id = 2")
    writers.write_artifacts(df, path, 9)
    writers.write_artifacts(two.withColumn("v", F.lit("new")), path, 10)
    writers.write_artifacts(two.withColumn("v", F.lit("newer")), path, 10)
    assert {(r.recording_id, r.v) for r in writers.read_written(spark, path).collect()} == {(1, "a"), (2, "newer")}
    writers.write_artifacts(df.where("false"), path, 11, two)
    assert {(r.recording_id, r.v) for r in writers.read_written(spark, path).collect()} == {(1, "a")}
    writers.write_artifacts(df.where("false"), path, 9, df)
    assert writers.read_written(spark, path).count() == 0


def test_media_hash(spark, tmp_path):
    (tmp_path / "A.MOV").write_bytes(b"same")
    (tmp_path / "b.wav").write_bytes(b"same")
    got = readers.media_inventory(readers.read_files(spark, str(tmp_path))).collect()
    assert len({r.content_hash for r in got}) == 1
    assert {r.path.rsplit("/", 1)[1]: r.media_type for r in got} == {"A.MOV": "video", "b.wav": "audio"}


def test_an_attempt_that_breaks_off_leaves_the_run_as_it_was(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "recording_id long, v string")
    writers.write_artifacts(df, path, 9)
    # rows of a second attempt at the same run, without a manifest
    df.limit(1).withColumn("v", F.lit("half")).write.parquet(f"{path}/rows/run=9/attempt=a-broken")
    assert {(r.recording_id, r.v) for r in writers.read_written(spark, path).collect()} == {(1, "a"), (2, "b")}
    writers.write_artifacts(df.withColumn("v", F.lit("new")), path, 9)
    assert {(r.recording_id, r.v) for r in writers.read_written(spark, path).collect()} == {(1, "new"), (2, "new")}


def test_files_are_whole_or_untouched(spark, tmp_path):
    root = str(tmp_path / "files")
    parts = spark.createDataFrame(
        [("a/b", 1, "two"), ("a/b", 0, "one"), ("c", 0, "x"), ("c", 1, None), (None, 0, "lost")], "recording_id string, place long, part string"
    )
    files.write_files(parts, root, "x.txt", "\n")

    def shown():
        return {r.recording_id: bytes(r.content).decode() for r in readers.artifact_files(spark, root, "x.txt").collect()}

    assert shown() == {"a%2Fb": "one\ntwo", "c": "x\n"}
    # a task that fails in the middle of a file: nothing of the run is seen, and no attempt stays
    broken = spark.createDataFrame([("c", k, "ab") for k in range(3000)], "recording_id string, place long, part string")
    broken = broken.withColumn("part", F.when(F.col("place") == 2999, F.raise_error(F.lit("broke off"))).otherwise(F.col("part")))
    with pytest.raises(Exception, match="broke off"):
        files.write_files(broken, root, "x.txt")
    assert shown() == {"a%2Fb": "one\ntwo", "c": "x\n"} and not list((tmp_path / "files" / "_attempts").iterdir())
    files.write_files(broken.where("place < 2").withColumn("part", F.lit("ab")), root, "x.txt")
    assert shown() == {"a%2Fb": "one\ntwo", "c": "abab"}
    files.write_files(parts.limit(0), root, "x.txt")
    files.write_files(parts.where("recording_id = 'c'"), f"file://{root}", "x.txt")
    assert shown() == {"a%2Fb": "one\ntwo", "c": "x"}
    assert {r.recording_id for r in readers.artifact_files(spark, f"file://{root}", "x.txt").collect()} == {"a%2Fb", "c"}


def test_second_run_of_the_inventory_takes_in_new_files_alone(spark, tmp_path):
    root, table, checkpoint = (str(tmp_path / x) for x in ("in.+", "table", "cp"))
    parts = spark.createDataFrame([("r1", 0, "{}"), ("r2", 0, "{}")], "recording_id string, place long, part string")
    files.write_files(parts, root, "meta.json")
    (tmp_path / "in.+" / "r1" / "frames").mkdir()
    for k in range(3):
        (tmp_path / "in.+" / "r1" / "frames" / f"{k}.jpg").write_bytes(b"f")
    files.take_in_paths(spark, root, table, checkpoint)
    before = {tuple(r) for r in files.taken_in(spark, table).collect()}
    assert before == {("r1", "meta.json", 1), ("r2", "meta.json", 1), ("r1", "frames/", 3)}
    (tmp_path / "in.+" / "r1" / "frames" / "9.jpg").write_bytes(b"f")
    files.write_files(parts.limit(1), root, "audio.wav")
    files.take_in_paths(spark, root, table, checkpoint)
    new = spark.read.parquet(table).where("batch = 1").drop("batch").collect()
    assert {(r.recording_id, r.file, r.n) for r in new} == {("r1", "audio.wav", 1), ("r1", "frames/", 1)}
    metas = readers.artifact_files(spark, root, "meta.json")
    got = {r.recording_id: (r.keyframe_count, r.audio_path) for r in readers.artifact_inventory(files.taken_in(spark, table), metas).collect()}
    assert got == {"r1": (4, "audio.wav"), "r2": (0, None)}


def test_files_are_listed_and_read_by_tasks(spark, tmp_path):
    for path in ("r1/a.json", "r1/deep/a.json", "r1/b.json", "r1/.a.json", "r1/_x/a.json", "_attempts/a.json", "r2/x=1/a.json", "a.json", "r2/empty/a.json"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"" if "empty" in path else path.encode())
    root = str(tmp_path)
    found = readers.artifact_files(spark, root, "a.json")
    assert not found.inputFiles() and not readers.artifact_paths(spark, root).inputFiles()  # the driver lists none
    assert {(r.recording_id, bytes(r.content).decode()) for r in found.collect()} == {
        ("r1", "r1/a.json"), ("r1", "r1/deep/a.json"), ("r2", "r2/x=1/a.json"), ("a.json", "a.json")
    }
    assert {tuple(r) for r in readers.artifact_paths(spark, root).collect()} == {
        ("r1", "a.json"), ("r1", "deep/a.json"), ("r1", "b.json"), ("r2", "x=1/a.json"), ("a.json", "a.json")
    }


def test_an_inventory_run_that_broke_off_counts_once(spark, tmp_path):
    root, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "cp"))
    (tmp_path / "in" / "r1" / "frames").mkdir(parents=True)
    (tmp_path / "in" / "r1" / "frames" / "0.jpg").write_bytes(b"f")
    files.take_in_paths(spark, root, table, checkpoint)
    files.take_in_paths(spark, root, table, checkpoint)  # nothing new
    (tmp_path / "in" / "r1" / "frames" / "1.jpg").write_bytes(b"f")
    files.take_in_paths(spark, root, table, checkpoint)
    (tmp_path / "cp" / "runs" / "1").unlink()  # as if it had broken off after its rows
    (tmp_path / "in" / "r1" / "frames" / "2.jpg").write_bytes(b"f")
    files.take_in_paths(spark, root, table, checkpoint)
    assert sorted(r.n for r in files.taken_in(spark, table).collect()) == [1, 2]
