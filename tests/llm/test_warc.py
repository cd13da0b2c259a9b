import gzip
import io

import duckdb
import pytest
from pyspark.sql import functions as F

from meshloom.llm import queries, warc
from meshloom.llm.common import Scratch


def test_round_trip_equals_sql_with_nulls_repeats_and_long_pages(spark, tmp_path):
    same = "<p>" + "z" * 150
    rows = [(3, "http://a/", same), (1, None, same), (None, "http://n\r\n/", same), (1, "u", same), (4, "u", None), (5, "u", ""), (6, "u", "x" * 99), (7, "u", "x" * 99), (8, "é ü", "é" * 300_000), (9, "u", "\r\n\r\nWARC/1.1" * 99)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").withColumn("first", F.lit("x")).withColumn("original", F.lit("x"))
    con = duckdb.connect()
    con.register("pages", pages.toPandas().astype({"page_id": "Int64"}))
    want = con.execute(queries.oracle_sql()["op7_warc_round_trip"].replace("page_id > first", "(page_id > first OR page_id IS NULL AND first IS NOT NULL)")).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(map(str, warc.round_trip(pages).select(*names).collect())) == sorted(str(spark_row(names, w)) for w in want)
    assert warc.round_trip(pages.limit(0)).count() == 0


def spark_row(names, values):
    from pyspark.sql import Row

    return Row(**dict(zip(names, values)))


def test_archives_roll_and_list_their_records(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    scratch = Scratch(spark, "test-warc")
    archives = warc.write_archives(pages, scratch.path("files"), scratch, roll=4096)
    assert archives.count() > 5 and archives.agg({"records": "sum"}).first()[0] == pages.count()
    assert warc.read_archives(archives).where("ok").count() == pages.count()


def test_revisits_name_the_record_they_refer_to(spark):
    body = "<p>" + "z" * 150
    pages = spark.createDataFrame([(1, "http://a/", body), (2, "http://b/", body), (3, "http://c/", body + "!")], "page_id long, url string, html string")
    scratch = Scratch(spark, "test-warc")
    archives = warc.write_archives(pages, scratch.path("files"), scratch).collect()
    heads = {}
    for archive in archives:
        fs, path = warc.store(archive.archive)
        with fs.open_input_stream(path, compression=None) as stream:
            assert b"WARC-Type: warcinfo" in gzip.decompress(stream.read())
        with fs.open_input_stream(path, compression=None) as stream:
            heads |= {h["Page-Key"]: h for h, _ in warc.read_records(stream)}
    assert heads["2"]["WARC-Refers-To"] == heads["1"]["WARC-Record-ID"] and heads["2"]["WARC-Refers-To-Target-URI"] == "http://a/"
    assert heads["3"]["WARC-Type"] == "response"


def test_many_archives_are_read_by_many_tasks(spark, sf):
    scratch = Scratch(spark, "test-warc")
    archives = warc.write_archives(spark.read.parquet(f"{sf}/pages.parquet"), scratch.path("files"), scratch, roll=4096)
    assert warc.read_archives(archives).select(F.spark_partition_id()).distinct().count() > 4


def test_reader_detects_damage():
    good = warc.page_record(1, "http://a/", b"payload" * 99, None, None, False)
    assert [f["ok"] for _, f in warc.read_records(io.BytesIO(good + good))] == [True, True]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good[:-9])))
    bad = warc.record("response", [("WARC-Payload-Digest", "sha256:00")], b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx")
    assert [f["ok"] for _, f in warc.read_records(io.BytesIO(bad))] == [False]
