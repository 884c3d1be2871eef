"""Line formats, filters and URL helpers on literal rows."""

from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.sources import logs, tables

HTTP = '10.0.0.1 - - [02/Jan/2024:03:04:05 +0100] "GET /dataset/A?x=1 HTTP/1.1" 200 {b} "{r}" "{a}"'


def lines(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "line_id bigint, line string")


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_http_line(spark):
    good = HTTP.format(b="-", r="-", a="Mozilla/5.0")
    marked = HTTP.format(b="7", r="a\u0001b", a="M")
    quoted = HTTP.format(b="7", r='say "x" now', a="M")
    rows = logs.parse_http(lines(spark, [good, "MALFORMED", good + " tail", marked, quoted])).orderBy("line_id").collect()
    assert [r["line_id"] for r in rows] == [0, 3, 4]
    first = rows[0]
    assert (first["ip"], first["bytes"], first["response"], first["month"]) == ("10.0.0.1", 0, "200", "2024-01")
    assert first["ts"].isoformat() == "2024-01-02T02:04:05"
    assert rows[1]["referer"] == "a\u0001b" and rows[2]["referer"] == 'say "x" now'


def test_big_byte_counts_survive(spark):
    row = logs.parse_http(lines(spark, [HTTP.format(b="3000000000", r="-", a="M")])).first()
    assert row["bytes"] == 3_000_000_000


def test_ftp_line(spark):
    ok = "Mon Jan  2 03:04:05 2024 1 10.0.0.9 55 /Data/X.NC b _ o"
    rows = logs.scan_ftp(lines(spark, [ok, "short line", ok.replace("/Data/X", "/misc/x"), ok.replace("X.NC", "README")])).collect()
    assert [(r["ip"], r["bytes"], r["request"]) for r in rows] == [("10.0.0.9", 55, "/data/x.nc")]


def test_crawlers_and_assets(spark):
    agents = ["-", "curl/7", "xJava/1", "java/1", "Googlebot-Image/1.0", "Googlebot-Image/1.0 x"]
    df = spark.createDataFrame([(a,) for a in agents], "a string")
    assert [r[0] for r in df.select(logs.is_known_crawler(F.col("a"))).collect()] == [True, True, True, False, True, False]
    requests = ["GET / HTTP/1.1", "GET /x.JS HTTP/1.1", "GET /xjs HTTP/1.1", "GET /api/a HTTP/1.1"]
    df = spark.createDataFrame([(r,) for r in requests], "r string")
    assert [r[0] for r in df.select(logs.is_asset_request(F.col("r"))).collect()] == [True, True, False, True]


def test_reject_count(spark):
    counted, seen = logs.count_rejects(lines(spark, [HTTP.format(b="1", r="-", a="M"), "x", "y"]))
    assert logs.parse_http(counted).count() == 1
    assert seen.get == {"lines": 3, "rejected": 2}


def test_month_split_and_month_reads(spark, tmp_path):
    path = str(tmp_path / "split")
    logs.split_by_month(lines(spark, [
        HTTP.format(b="1", r="-", a="M"), HTTP.format(b="1", r="-", a="M").replace("Jan/2024", "Feb/2023"),
        "Mon Feb 2 03:04:05 2024 1 10.0.0.9 55 /d b", "junk",
    ]), path)
    got = {(r["year"], r["month"]): r["count"] for r in spark.read.parquet(path).groupBy("year", "month").count().collect()}
    assert got == {(2024, 1): 1, (2023, 2): 1, (2024, 2): 1, (None, None): 1}

    monthly = str(tmp_path / "monthly")
    first = spark.createDataFrame([("2024-01", 1), ("2024-02", 2)], "month string, v int")
    tables.write_months(first, monthly)
    tables.write_months(spark.createDataFrame([("2024-02", 3)], "month string, v int"), monthly)
    assert sorted((r["month"], r["v"]) for r in tables.read_months(spark, monthly).collect()) == [("2024-01", 1), ("2024-02", 3)]
    assert [r["v"] for r in tables.read_months(spark, monthly, ["2024-02"]).collect()] == [3]
    assert tables.read_years(spark, monthly, [2023]).count() == 0
    tables.replace_months(first.where("v = 1"), monthly, ["2024-02"])
    assert [(r["month"], r["v"]) for r in tables.read_months(spark, monthly).collect()] == [("2024-01", 1)]
    tables.replace_months(first.where("v = 0"), monthly)
    assert tables.read_months(spark, monthly, schema=first.schema).count() == 0


def test_line_ids_follow_the_file(spark, tmp_path):
    (tmp_path / "log").write_text("".join(f"line {i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        read = [[r["line"] for r in logs.read_lines(spark, str(tmp_path / "log")).orderBy("line_id").collect()] for _ in range(2)]
        ids = logs.read_lines(spark, str(tmp_path / "log")).select("line_id").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert read[0] == read[1] == [f"line {i}" for i in range(20_000)] and ids == 20_000


def test_prefixed_tables_and_deletes(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("seen_x")
    spark.createDataFrame([(2, 3)], "a int, b int").createOrReplaceTempView("seen_y")
    assert sorted((r["a"], r["b"]) for r in tables.read_prefixed(spark, "seen_").collect()) == [(1, None), (2, 3)]
    src, dst = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([(1,), (2,), (None,)], "a int").write.parquet(src)
    tables.delete_where(spark, src, dst, F.col("a") == 1)
    assert sorted(str(r["a"]) for r in spark.read.parquet(dst).collect()) == ["2", "None"]


def test_term_pairs_replace_only_their_model(spark, tmp_path):
    path = str(tmp_path / "pairs")
    schema = "term_a string, term_b string, weight double, model string"
    tables.write_term_pairs(spark.createDataFrame([("a", "b", 0.5, "x"), ("a", "c", 0.5, "y")], schema), path)
    tables.write_term_pairs(spark.createDataFrame([("d", "e", 0.5, "x")], schema), path)
    assert sorted((r["term_a"], r["model"]) for r in spark.read.parquet(path).collect()) == [("a", "y"), ("d", "x")]
    tables.write_term_pairs(spark.createDataFrame([], schema), path, ["x"])
    assert [(r["term_a"], r["model"]) for r in spark.read.parquet(path).collect()] == [("a", "y")]


def test_query_map(spark):
    u = F.col("u")
    assert one(spark, urls.query_map(u), u="/p?a=1&a=2&b") == {"a": "2", "b": ""}
    assert one(spark, urls.query_map(u), u="/p") == {}
    assert one(spark, urls.url_page(u), u="/P?a=1") == "/p"
    assert one(spark, urls.url_page(u), u="/P") is None
    assert one(spark, urls.query_value(u, "a"), u="/p?a=1&ba=3&a=2=9") == "2"
    assert one(spark, urls.query_value(u, "a"), u="/p?a") == ""
    assert one(spark, urls.query_value(u, "a"), u="/p?ba=1") is None


def test_decoding(spark):
    v = F.col("v")
    assert one(spark, urls.decode_value(v), v="100%") == "100%"
    assert one(spark, urls.decode_value(v), v="a%20b") == "a b"
    assert one(spark, urls.decode_value(v), v="a%252bb") == "a b"
    assert one(spark, urls.strip_punctuation(v), v=' a-b_"c"\\d  e ') == "a b c d e"


def test_search_info(spark):
    u = F.col("u")
    url = "/datasetlist?ids=Measurement:Format:Sensor&values=Ocean%20Winds:RAW:QuikSCAT&search=sea%20ice"
    assert one(spark, urls.search_info(u), u=url) == ["sea ic", "ocean wind", "quikscat"]
    assert one(spark, urls.search_word(u), u=url) == "sea ice"
    same = "/datasetlist?ids=sensor&values=grace&search=grace"
    assert one(spark, urls.search_info(u), u=same) == ["grace"]
    got = one(spark, urls.filter_info(u), u=url + "&temporalsearch=2011to2012")
    assert [(p["key"], p["value"]) for p in got] == [
        ("format", "raw"), ("measurement", "ocean winds"), ("sensor", "quikscat"), ("temporalsearch", "2011to2012")
    ]
    assert one(spark, urls.search_info(u), u="/dataset/x") == []


def test_page_classes(spark):
    t, r = F.col("t"), F.col("r")
    cases = {("http", "GET /datasetlist?x HTTP"): "datasetlist", ("http", "GET /dataset/A HTTP"): "dataset",
             ("ftp", "/dataset/x"): "ftp", ("http", "GET /home HTTP"): "other"}
    for (kind, request), want in cases.items():
        assert one(spark, urls.event_class(t, r), t=kind, r=request) == want
    assert one(spark, urls.dataset_id(r), r="/dataset/a%20b?q=1") == "a b"
    assert one(spark, urls.viewed_dataset(r), r="/dataset/abc") == "abc"
    assert one(spark, urls.download_path(t, r), t="ftp", r="/a/b.PDF") is None
    assert one(spark, urls.download_path(t, r), t="ftp", r="/a/b") == "/a/b"
