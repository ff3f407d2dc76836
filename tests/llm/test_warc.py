import hashlib
import heapq
import random
import zlib

from leadloom.llm import warc


def test_loser_tree_merges_like_a_heap():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == list(heapq.merge(*runs))


def test_url_keys(spark):
    cases = {
        "http://www.Example.com:80/a/b?z=1&a=2#top": "com,example)/a/b?a=2&z=1",
        "https://m.site.co.uk": "uk,co,site)/",
        "https://user@host.org:8080/x": "org,host:8080)/x",
        "": "/",
        None: "/",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string").select("url", warc.url_key(df_col()).alias("k"))
    assert {r["url"]: r["k"] for r in df.collect()} == cases


def df_col():
    from pyspark.sql import functions as F

    return F.col("url")


def rows_for_test(spark):
    long, other = "x" * 1500, "é" * 700
    rows = [(k, f"http://a.b/{k % 3}", html) for k, html in enumerate([long, long, other, None, "", "short", "short", other, long, "y" * 999, "y" * 999, "z" * 1000, "z" * 1000])]
    rows += [(None, None, "lost\r\n\r\npage"), (5, "http://a.b/2", "short"), (8, "http://a.b/2", long)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_records_and_revisits(spark):
    pages = rows_for_test(spark)
    found = warc.capture_histories(pages).collect()
    wanted = []
    rows = pages.collect()
    for r in rows:
        body = (r["html"] or "").encode()
        same = [x["page_id"] for x in rows if (x["html"] or "").encode() == body and x["page_id"] is not None]
        first = max(same, default=None)
        revisit = len(body) >= 1000 and r["page_id"] != first
        wanted.append((r["page_id"], len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=str) == sorted(wanted, key=str)


def test_histories_are_globally_ordered(spark):
    pages = spark.createDataFrame([(k * 7 % 501, f"http://h{'0' if k % 3 else k % 11}.org/p", f"page {k}") for k in range(501)], "page_id long, url string, html string").repartition(5)
    lines = warc.written(warc.index_lines(warc.written(warc.write_archives(warc.captures(pages)), "a")), "l")
    rows = warc.merged_histories(lines, together=60).orderBy("merge_range", "place").collect()
    keys = [(r["url_key"], r["timestamp"], r["page_id"]) for r in rows]
    assert keys == sorted(keys) and len(keys) == 501 and len({r["merge_range"] for r in rows}) > 3
    seen = {}
    for r in rows:
        seen[r["url_key"]] = seen.get(r["url_key"], 0) + 1
        assert r["capture"] == seen[r["url_key"]]


def test_archives_are_warc_files(spark):
    archives = warc.write_archives(warc.captures(rows_for_test(spark))).collect()
    files = {}
    for r in sorted(archives, key=lambda r: (r["archive"], r["offset"])):
        assert len(files.setdefault(r["archive"], b"")) == r["offset"]
        files[r["archive"]] += bytes(r["record"])
    records = 0
    for data in files.values():
        while data:
            one = zlib.decompressobj(31)
            assert one.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: ")
            data = one.unused_data
            records += 1
    assert records == len(archives)


def test_empty(spark):
    assert warc.capture_histories(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
