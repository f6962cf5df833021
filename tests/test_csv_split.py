"""Quoted CSV in splits: the cells of the whole-file reader, exact row numbers."""

import os

import pytest

from feedlake.session import scratch_path
from feedlake.sources.csv import read_feedback_csv
from feedlake.sources.csv_split import read_split_csv


def folder(spark, files):
    path = scratch_path(spark, "t-split").removeprefix("file:")
    os.makedirs(path)
    for name, data in files.items():
        with open(f"{path}/{name}", "wb") as f:
            f.write(data.encode())
    return path


def cell(i):
    return ["plain", "a, b", 'say ""hi""', "two\nlines", "crlf\r\ninside", "\n\nempty lines\n", 'quote ""\n"" across', "é 日本"][i % 8] + f" {i}"


@pytest.mark.parametrize("size", [97, 1000, 1 << 20])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_equals_the_whole_file_reader(spark, size, newline):
    files = {}
    for k, n in enumerate((150, 40)):
        body = [f'{i},"{cell(i)}",{"NA" if i % 3 else i}' for i in range(k * 1000, k * 1000 + n)]
        files[f"{k}.csv"] = newline.join(["Level,Text,Ref", *body]) + newline * (3 * k)
    path = folder(spark, files)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        df = read_split_csv(spark, path)
        got = [tuple(r) for r in df.orderBy("row_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = read_feedback_csv(spark, path, row_id=None)
    assert df.columns == [*want.columns, "row_id"] and df.dtypes[:-1] == want.dtypes
    assert [r[:-1] for r in got] == sorted((tuple(r) for r in want.collect()), key=lambda r: r[0])
    assert [r[-1] for r in got] == list(range(190))


def test_odd_quotes_and_header_only(spark):
    with pytest.raises(ValueError, match="odd number of quotes"):
        read_split_csv(spark, folder(spark, {"a.csv": 'Level,Text\n1,"open\n'}))
    assert read_split_csv(spark, folder(spark, {"a.csv": "Level,Text\n"})).count() == 0
