import json
import os

import pytest
from pyspark.sql import functions as F

from filewright import schemas
from filewright.sources.extraction import files_from_binary
from filewright.sources.filetypes import extractor_name, mime_type
from filewright.sources import inbox_source
from filewright.sources.inbox import first_files, inbox_stream, scan_inbox
from filewright.sources.labels import load_labels, locate_labels
from filewright.sources.tables import load_table, materialize, shared_folder, work_folder


def test_inbox_scan(spark, tmp_path):
    (tmp_path / "b.txt").write_text("b")
    (tmp_path / "a.txt").write_text("a")
    (tmp_path / ".hidden").write_text("h")
    (tmp_path / "_plan.txt").write_text("under a name the reader skips")
    (tmp_path / "x._COPYING_").write_text("half")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.txt").write_text("c")
    found = scan_inbox(spark, str(tmp_path))
    names = sorted(row.source_path.rsplit("/", 1)[1] for row in found.collect())
    assert names == ["_plan.txt", "a.txt", "b.txt", "x._COPYING_"]
    skipped = found.where(F.col("source_path").endswith("_plan.txt")).first()
    assert (skipped.file_size, bytes(skipped.content)) == (29, b"under a name the reader skips")
    assert sorted(bytes(row.content) for row in found.collect()) == [b"a", b"b", b"half", b"under a name the reader skips"]
    assert scan_inbox(spark, str(tmp_path), only_filename="b.txt").count() == 1
    assert first_files(found, 2).count() == 2
    assert first_files(found, 1).first().source_path.endswith("_plan.txt")
    assert scan_inbox(spark, str(tmp_path / "missing")).count() == 0


def test_inbox_slices_hold_each_file_once(spark, tmp_path):
    for number in range(200):
        (tmp_path / f"{'_' * (number % 3)}f{number}.txt").write_bytes(bytes([number]) * number)
    (tmp_path / "broken").symlink_to(tmp_path / "nowhere")
    (tmp_path / "a b%20c é.txt").write_text("odd name")
    for slices in (1, 7, 64):
        found = scan_inbox(spark, f"file://{tmp_path}", slices=slices)
        assert found.rdd.getNumPartitions() == slices
        rows = {row.source_path.rsplit("/", 1)[1]: bytes(row.content) for row in found.collect()}
        assert len(rows) == 201 and rows["a b%20c é.txt"] == b"odd name"
        assert all(rows[f"{'_' * (n % 3)}f{n}.txt"] == bytes([n]) * n for n in range(200))
    assert [found.name for found in inbox_source.listed(str(tmp_path / "none"))] == []


def test_inbox_file_that_cannot_be_read(spark, tmp_path, monkeypatch):
    (tmp_path / "big.txt").write_text("12345")
    monkeypatch.setattr(inbox_source, "LARGEST", 4)
    part = inbox_source.Slice(0, 1)
    (batch,) = inbox_source._batches(str(tmp_path), part)
    assert batch.to_pylist()[0]["content"] is None and batch.to_pylist()[0]["file_size"] == 5


def test_inbox_stream_goes_on_after_a_restart(spark, tmp_path):
    inbox, out = tmp_path / "inbox", tmp_path / "out"
    inbox.mkdir()

    def run():
        stream = inbox_stream(spark, str(inbox), slices=3, settle=0)
        started = (
            stream.writeStream.format("parquet")
            .option("path", str(out))
            .option("checkpointLocation", str(tmp_path / "checkpoint"))
            .trigger(availableNow=True)
            .start()
        )
        started.awaitTermination()
        return sorted(bytes(row.content) for row in spark.read.parquet(str(out)).collect())

    (inbox / "_one.txt").write_text("1")
    (inbox / ".no.txt").write_text("no")
    assert run() == [b"1"]
    assert run() == [b"1"]
    old = tmp_path / "old.txt"
    old.write_text("2")
    os.utime(old, (1, 1))
    old.rename(inbox / "old.txt")  # an old file that is moved in is new here
    (inbox / "x._COPYING_").write_text("3")
    assert run() == [b"1", b"2", b"3"]
    (inbox / "_one.txt").write_text("again")
    assert run() == [b"1", b"2", b"3", b"again"]


def test_extraction_of_each_kind(spark):
    contents = {
        "plain.txt": "  café ".encode(),
        "old.csv": "café".encode("latin-1"),
        "empty.md": b"  ",
        "one.eml": b"Subject: x",
        "doc.docx": b"no archive",
        "scan.pdf": b"%PDF",
        "thing.abc": b"?",
        "_lost.txt": None,
    }
    frame = spark.createDataFrame(
        [(f"/in/{name}", len(body or b""), body and bytearray(body)) for name, body in contents.items()],
        "source_path STRING, file_size BIGINT, content BINARY",
    )
    read = {row.filename: row for row in files_from_binary(frame, "r").collect()}
    assert len(read) == len(contents)
    texts = {name: row.extracted_text for name, row in read.items() if row.extracted_text is not None}
    assert texts == {"plain.txt": "café", "old.csv": "café"}
    assert read["old.csv"].metadata["encoding"] == "latin-1"
    assert read["doc.docx"].errors == ["DOCX text must be precomputed"]
    assert read["one.eml"].errors == ["EML text must be precomputed"]
    assert read["scan.pdf"].errors == ["PDF text must be precomputed"]
    assert read["thing.abc"].errors == ["Unsupported file type: .abc"]
    assert read["plain.txt"].errors == []
    assert (read["_lost.txt"].file_hash, read["_lost.txt"].errors) == (None, ["File could not be read"])


def test_file_types(spark):
    names = ["a.PDF", "a.tar.gz", "a.tgz", "a.md", "a.unknown", "a", "a.jpeg"]
    frame = spark.createDataFrame([(n,) for n in names], "n STRING")
    got = [row[0] for row in frame.select(mime_type(F.col("n"))).collect()]
    assert got == ["application/pdf", "application/x-tar", "application/x-tar", "text/markdown", None, None, "image/jpeg"]
    extensions = spark.createDataFrame([(".jpg",), (".eml",), ("",)], "e STRING")
    assert [row[0] for row in extensions.select(extractor_name(F.col("e"))).collect()] == ["image", "eml", "unsupported"]


def test_labels(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    rows = [{"source_path": "./s/a.txt", "expected_category_l1": "X"}, {"source_path": "/abs/b.txt"}]
    good.write_text("\n\n".join(json.dumps(row) for row in rows) + "\n   \n")
    labels = load_labels(spark, str(good))
    assert labels.count() == 2
    files = spark.createDataFrame([("/base/s/a.txt",)], "source_path STRING")
    located = {row.source_path: row.missing for row in locate_labels(labels, "/base/", files).collect()}
    assert located == {"/base/s/a.txt": False, "/abs/b.txt": True}
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"source_path": \n')
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILED_READ_FILE"):
        load_labels(spark, str(bad)).collect()


def test_missing_tables_are_empty(spark, tmp_path):
    table = load_table(spark, str(tmp_path / "none"), schemas.EVENTS)
    assert (table.count(), table.columns[0]) == (0, "event_id")


def test_work_folder(spark):
    assert work_folder("hdfs://x/y", "file:/w", "yarn") == "hdfs://x/y"
    assert work_folder(None, "hdfs://x/w", "yarn") == "hdfs://x/w/filewright"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(None, "file:/w", "yarn")
    assert work_folder(None, "file:/w", "local[4]") != "file:/w"
    before = spark.sparkContext.getCheckpointDir()
    stored = materialize(spark.range(3))
    assert spark.sparkContext.getCheckpointDir() == before
    assert all(f"/filewright/{spark.sparkContext.applicationId}/" in file for file in stored.inputFiles())
    assert shared_folder(spark)
