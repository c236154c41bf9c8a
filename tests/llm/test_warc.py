import gzip
import hashlib
import os
import random

from pyspark.sql import functions as F

from textloom.llm import warc


def test_round_trip(spark):
    rng = random.Random(2)
    bodies = [None, "", "short", "ñ" * 60, "x" * 200, "WARC/1.1\r\n\r\n" * 20, "unique {}" * 20]
    urls = ["http://a.example.org/x?y=1", "https://B.example.org:80/", None, "weird url\n with lines", "http://u@c.d/e#f"]
    rows = [(i, rng.choice(urls), (b := rng.choice(bodies)) and b.replace("{}", str(i))) for i in range(1000)]
    rows += [(1, "http://z.z/", "x" * 200), (None, "http://n.n/", "x" * 200), (-5, "http://m.m/", "y" * 300), (9, rows[9][1], rows[9][2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_digest int").repartition(5)
    keys = df.select(warc.capture_key(F.col("url"), F.col("page_id")).alias("key"))
    directory = warc.write(df, file_bytes=3000, block_lines=16)
    assert directory.where("captures > 16").count() == 0 and directory.count() > 1000 / 16
    assert len([f for f in os.listdir(os.path.dirname(directory.first().index_file.removeprefix("file://"))) if f.endswith(".warc.gz")]) > 30
    got = warc.fetch(directory, keys).collect()
    firsts = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            firsts[h] = min(i, firsts.get(h, i))
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        first = firsts.get(h, i) if i is not None else i
        again = first != i
        want.append((i, "revisit" if again else "response", first if again else None, len(body), hashlib.sha256(body).hexdigest(), b"" if again else body))
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in got), key=str) == sorted(want, key=str)
    one = warc.fetch(directory, df.where("page_id = -5").select(warc.capture_key(F.col("url"), F.col("page_id")).alias("key"))).collect()
    assert [(r.page_id, r.url) for r in one] == [(-5, "http://m.m/")]
    assert warc.fetch(directory, spark.createDataFrame([(bytearray(b"none"),)], "key binary")).count() == 0


def test_keys_over_several_blocks(spark):
    rows = [(i // 3, f"http://a.org/{i // 3:05d}", f"page {i}") for i in range(3000)]
    rows += [(5000, "http://b.org/", f"again {i}") for i in range(1000)] + [(None, "http://c.org/", f"none {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    directory = warc.write(df)
    key = warc.capture_key(F.col("url"), F.col("page_id")).alias("key")
    got = warc.fetch(directory, df.select(key)).collect()
    assert sorted(bytes(r.payload).decode() for r in got) == sorted(h for _, _, h in rows)
    one = warc.fetch(directory, df.where("page_id = 5000").select(key)).collect()
    assert len(one) == 1000


def test_a_hot_key_over_blocks_and_ranges(spark):
    """A third of all rows has one key; others come two or three times; each is read back."""
    rng = random.Random(3)
    rows = [(7, "http://hot.org/", f"hot {i}") for i in range(2000)] + [(i // 2, f"http://h{i // 2 % 50}.org/{i // 2}", f"page {i}") for i in range(3000)] + [(None, "http://hot.org/", f"none {i}") for i in range(700)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    key = warc.capture_key(F.col("url"), F.col("page_id")).alias("key")
    for lines, each in ((8, 200), (256, 1000)):
        directory = warc.write(df, block_lines=lines, rows_each=each, file_bytes=20_000)
        assert directory.select("range").distinct().count() > 1
        got = [bytes(r.payload).decode() for r in warc.fetch(directory, df.select(key)).collect()]
        assert sorted(got) == sorted(h for _, _, h in rows)
        some = df.where("page_id % 11 = 7")
        assert sorted(bytes(r.payload).decode() for r in warc.fetch(directory, some.select(key)).collect()) == sorted(r.html for r in some.collect())


def test_files_are_gzip_members_of_whole_records(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h{i}.org/", "p" * 150) for i in range(5)], "page_id long, url string, html string")
    file = warc.write(df).first().index_file.removeprefix("file://")
    text = gzip.open(file.replace(".cdx", "-00000.warc.gz")).read()
    assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")


def test_keys(spark):
    df = spark.createDataFrame([("http://www.B.org:80/P?q=1#f",), ("x",), (None,)], "u string")
    assert [r[0] for r in df.select(warc.url_key(F.col("u"))).collect()] == ["org,b,www)/P?q=1", "x)", ")"]


def test_nothing(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    directory = warc.write(df)
    assert directory.count() == 0
    assert warc.fetch(directory, spark.createDataFrame([(bytearray(b"none"),)], "key binary")).count() == 0
