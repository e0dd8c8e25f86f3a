import gzip
import hashlib
import os
import random

from pyspark.sql import functions as F

from nightjar.llm.common import work_folder
import nightjar.llm.warc as W
from nightjar.llm.warc import LoserTree, capture_index, parse_archive, runs, unpacked, url_key, write_archives


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def brute(rows):
    out, first = [], {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            first[data] = max(first.get(data, i), i)
    for i, _, html in rows:
        data = (html or "").encode()
        of = first.get(data)
        visit = of is not None and of != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if visit else "response",
                    of if visit else None))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()],
                  key=str)


def pages():
    big, rnd = "é<p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n" * 40, random.Random(1)
    rows = [(i, f"http://h{i % 3}.example.com/{rnd.randint(0, 9)}", rnd.choice([big, big + "x", "small", "y" * 999, "z" * 1000]))
            for i in range(60)]
    return rows + [(100, None, None), (101, "", ""), (None, "u\r\nX: y\x00://a.b/c", big), (None, "x://a.b/c", "w" * 2000),
                   (59, "http://h/", "z" * 1000), (59, "http://h/", "z" * 1000), (102, "http://h/", "l" * 3_000_000)]


def test_round_trip(spark):
    rows = pages()
    df = frame(spark, rows).repartition(4).selectExpr("*", "1 as id", "2 as digest", "3 as record")
    assert got(capture_index(df)) == brute(rows)
    assert capture_index(df.limit(0)).count() == 0


def test_archives_are_gzip_and_hold_the_payloads(spark):
    path = work_folder(spark, "warc-test")
    rows = pages()
    write_archives(frame(spark, rows).coalesce(1), path)
    files = [f for f in os.listdir(path.removeprefix("file:")) if f.endswith(".gz")]
    assert len(files) == 1
    data = open(os.path.join(path.removeprefix("file:"), files[0]), "rb").read()
    text = gzip.decompress(data)
    captures = list(parse_archive(unpacked(data)))
    assert len(captures) == len(rows)
    for c in captures:
        record = text[c["offset"]:c["offset"] + c["length"]]
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    assert [c for c in runs(spark, path).collect()]


def test_global_order(spark):
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    rows = [(i, f"http://{'abc'[i % 3]}.com/{i % 5}", "p") for i in range(300)]
    df = frame(spark, rows).repartition(7).withColumn("d", F.timestamp_seconds(F.lit(10**9) + F.col("page_id") % 50))
    index = capture_index(df, date_col="d").withColumn("part", F.spark_partition_id())
    out = index.withColumn("row", F.monotonically_increasing_id()).orderBy("row").collect()
    spark.conf.set(coalesce, before)
    keys = [(r.urlkey, r.captured, r.page_id) for r in out]
    assert keys == sorted(keys) and len(keys) == 300
    assert len({r.part for r in out}) > 1


def test_loser_tree():
    rnd = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16):
        lists = [sorted((rnd.randint(0, 20),) for _ in range(rnd.randint(0, 12))) for _ in range(k)]
        assert list(LoserTree([iter(x) for x in lists])) == sorted(y for x in lists for y in x)


def test_url_key():
    assert url_key("http://WWW.Example.com/a?b") == "com,example,www)/a?b"
    assert url_key("") == "" == url_key("none")


def test_payloads_full_of_separators_and_small_batches(spark, monkeypatch):
    """Pieces are cut at separators that belong to payloads; more runs than a
    merge has rows of, and records larger than any batch."""
    monkeypatch.setattr(W, "RECORDS", 3)
    monkeypatch.setattr(W, "MERGE_BATCH", 2)
    rnd = random.Random(3)
    parts = ["\r\n", "\r\n\r\n", "\n", "\r", "WARC/1.1\r\n", "x", "é" * 500, ""]
    rows = [(i, f"http://{'abc'[i % 3]}.com/", "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))))
            for i in range(80)] + [(200 + i, "http://big/", "\r\n\r\n" * 200_000 + str(i)) for i in range(4)]
    df = frame(spark, rows).repartition(4)
    path = work_folder(spark, "warc-small")
    write_archives(df, path)
    files = [f for f in os.listdir(path.removeprefix("file:")) if f.endswith(".gz")]
    assert len(files) >= 84 // 3
    assert got(capture_index(df)) == brute(rows)
    keys = [(r.urlkey, r.captured, r.page_id) for r in W.merged(runs(spark, path).coalesce(1)).collect()]
    assert len(keys) == len(rows)


def test_merge_holds_one_batch_of_each_run():
    import pyarrow as pa
    rows = pa.table({"urlkey": [f"{i % 50:03d}" for i in range(100)], "captured": ["t"] * 100, "page_id": range(100),
                     "run": ["a"] * 50 + ["b"] * 50, "offset": range(100)})
    pieces = W._run_pieces(rows, size=7)
    assert len(pieces) == 2 and [c[-1] for c in LoserTree(pieces)] == [x for i in range(50) for x in (i, i + 50)]
    assert W._run_pieces(rows.slice(0, 0)) == []
