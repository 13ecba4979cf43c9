"""Whole files, all of them or none."""

import os

import pytest
from pyspark.sql import functions as F

from quirework.functions.config import Settings
from quirework.plans import flow
from quirework.sources import file_sink


def files_of(path):
    return {os.path.relpath(os.path.join(d, n), path): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(path) for n in names}


def named(spark, rows):
    return spark.createDataFrame(rows, "name string, content string").repartition(4)


def test_files_are_the_rows(spark, tmp_path):
    rows = [(f"d{k}", f"text {k}\n\né 𝒳") for k in range(40)] + [("a/../b c%", "up"), ("empty", ""), ("null", None)]
    file_sink.write_files(named(spark, rows), f"file://{tmp_path}/new/out", ".txt")
    got = files_of(tmp_path / "new/out")
    assert len(got) == len(rows) and got["d7.txt"] == "text 7\n\né 𝒳".encode() and got["a%2F..%2Fb%20c%25.txt"] == b"up" and got["null.txt"] == b""
    assert os.listdir(tmp_path / "new") == ["out"]


def test_overwrite_append_and_folders(spark, tmp_path):
    path = str(tmp_path / "out")
    file_sink.write_files(named(spark, [("a", "1"), ("b", "2")]), path)
    file_sink.write_files(named(spark, [("c", "3")]), path)
    assert files_of(path) == {"c": b"3"}
    file_sink.write_files(named(spark, [("d", "4")]), path, overwrite=False)
    assert sorted(files_of(path).values()) == [b"3", b"4"] and {os.path.basename(n) for n in files_of(path)} == {"c", "d"}
    file_sink.write_files(named(spark, [(f"n{k}", str(k)) for k in range(50)]), path, folders=3)
    assert len(files_of(path)) == 50 and {os.path.dirname(n) for n in files_of(path)} == {"00000", "00001", "00002"}


def test_binary_content(spark, tmp_path):
    df = spark.createDataFrame([("a", bytearray(b"\xff\x00"))], "name string, content binary")
    file_sink.write_files(df, str(tmp_path / "out"), ".bin")
    assert files_of(tmp_path / "out") == {"a.bin": b"\xff\x00"}


@pytest.mark.parametrize("before", [False, True])
def test_a_failing_task_leaves_no_file(spark, tmp_path, before):
    """One of several tasks fails after others have written: nothing is seen, and what was there stays."""
    path = str(tmp_path / "out")
    if before:
        file_sink.write_files(named(spark, [("old", "x")]), path)
    rows = named(spark, [(f"d{k}", "text") for k in range(200)])
    bad = rows.withColumn("name", F.when(F.col("name") != "d150", F.col("name")))
    with pytest.raises(Exception, match="without a name"):
        file_sink.write_files(bad, path)
    assert os.listdir(tmp_path) == (["out"] if before else []) and (not before or files_of(path) == {"old": b"x"})


def test_columns_are_checked(spark, tmp_path):
    file_sink.register(spark)
    with pytest.raises(Exception, match="name and content"):
        spark.range(2).write.format("document-files").mode("append").option("path", str(tmp_path / "o")).save()


@pytest.mark.parametrize("fmt", ["json", "markdown", "summary", "search-index"])
def test_exported_files_are_the_formatted_documents(spark, tmp_path, fmt):
    pages = spark.createDataFrame([(d, k, f"Chapter {k}\nmail a{k}@b.co on 2024-01-0{k}") for d in (1, 2, 3) for k in range(1, 4)], "doc_id long, page_no int, text string")
    run = flow.run(pages, settings=Settings(), now="2024-01-01T00:00:00.000Z")
    flow.export_files(run, str(tmp_path / "out"), fmt)
    want = {f"{r.doc_id}{file_sink.EXTENSIONS[fmt]}": r.output.encode() for r in run.formatted(fmt).collect()}
    assert files_of(tmp_path / "out") == want and len(want) == 3


@pytest.mark.parametrize("folders", [0, 3])
def test_files_are_read_again(spark, tmp_path, folders):
    """The same rows, in folders or not, with names of all letters, and those that were appended."""
    path = f"file://{tmp_path}/out"
    rows = [(f"d{k}", f"text {k}\n\né 𝒳") for k in range(600)] + [("a/../b c%.txt", "up"), ("+attempts", "x"), ("long", "y" * (file_sink.BATCH_BYTES + 1)), ("empty", "")]
    file_sink.write_files(named(spark, rows), path, ".txt", folders=folders)
    file_sink.write_files(named(spark, [("more", "z")]), path, ".txt", overwrite=False, folders=folders)
    file_sink.write_files(named(spark, [("other", "z")]), path, ".md", overwrite=False)
    got = file_sink.read_files(spark, path, ".txt")
    assert sorted(map(tuple, got.collect())) == sorted([*rows, ("more", "z")])


def test_no_file_is_listed_where_the_plan_is_made(spark, tmp_path):
    """An export of many executions lies in folders; the driver lists these, when it writes and when it reads."""
    from quirework.plans import queries
    from tests.conftest import SF

    wrote = []
    was = file_sink.write_files

    def watched(files, path, extension="", overwrite=True, folders=0):
        wrote.append((path, folders))
        was(files, path, extension, overwrite, folders)

    file_sink.write_files = watched
    try:
        df = queries.QUERIES["export_files"](spark, SF)
    finally:
        file_sink.write_files = was
    ((path, folders),) = wrote
    top = path.removeprefix("file://")
    assert folders == file_sink.FOLDERS and all(os.path.isdir(os.path.join(top, n)) for n in os.listdir(top))
    shares = file_sink.FileReader({"path": path, "extension": ".txt", "tasks": "5"}).partitions()
    assert len(shares) == 5 and all(folder for s in shares for _, folder in s.places) and sum(len(s.places) for s in shares) == len(os.listdir(top))
    assert df.count() == len(files_of(top)) == 150 and not df.inputFiles()
