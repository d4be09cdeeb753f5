"""Files of texts: unchanged ones are left alone, a failed job leaves nothing."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lumora.sources import files

SCHEMA = "name string, content string"


def write(spark, folder, rows, **options):
    files.write_files(spark.createDataFrame(rows, SCHEMA).repartition(3), folder, ".srt", **options)


def left(folder):
    """What stands in the folder once tasks of a failed job have ended."""
    for _ in range(50):
        if not (found := os.listdir(folder)):
            break
        time.sleep(0.1)
    return found


def test_unchanged_files_stay_and_others_change(spark, tmp_path):
    folder = str(tmp_path / "out")
    write(spark, folder, [("1", "một\n"), ("2", "b"), ("3", "")])
    assert sorted(os.listdir(folder)) == ["1.srt", "2.srt", "3.srt"]
    assert (tmp_path / "out" / "1.srt").read_bytes() == "một\n".encode()
    for n in ("1", "2", "3"):
        os.utime(f"{folder}/{n}.srt", ns=(5, 5))
    before = {n: os.stat(f"{folder}/{n}.srt").st_ino for n in ("1", "2", "3")}
    write(spark, folder, [("1", "một\n"), ("2", "B"), ("4", "d")])
    times = {n: os.stat(f"{folder}/{n}.srt").st_mtime_ns for n in ("1", "2", "3")}
    assert times["1"] == times["3"] == 5 and times["2"] > 5
    assert os.stat(f"{folder}/1.srt").st_ino == before["1"]
    assert sorted((r.name, r.content) for r in files.read_files(spark, folder, ".srt").collect()) == [("1", "một\n"), ("2", "B"), ("4", "d")]
    write(spark, folder, [("1", "một\n")], mode="append")
    with pytest.raises(Exception, match="2.srt"):
        write(spark, folder, [("2", "other"), ("5", "e")], mode="append")
    assert sorted(os.listdir(folder)) == ["1.srt", "2.srt", "3.srt", "4.srt"]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    folder = str(tmp_path / "out")
    with pytest.raises(Exception, match="not a file's name"):
        write(spark, folder, [(str(i), "x") for i in range(20)] + [("../a", "x")])
    assert left(folder) == []
    with pytest.raises(Exception, match="two rows"):
        write(spark, folder, [("1", "x"), ("1", "y")])
    assert left(folder) == []
    rows = spark.range(20).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") == 13, F.raise_error(F.lit("broken"))).otherwise("x").alias("content"))
    with pytest.raises(Exception, match="broken"):
        files.write_files(rows, folder)
    assert left(folder) == []
