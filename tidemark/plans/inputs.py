"""Engine inputs derived by Spark from the driver's tables (raw log lines, session keywords, metadata)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import content_tokens, normalise, stem
from tidemark.functions.urls import dataset_id, event_class, request_path
from tidemark.operators import crawlers, matrix, mining, sessions, tree
from tidemark.session import spread_by, stage
from tidemark.sources import logs
from tidemark.sources.matrices import parse_triples

SITE = "http://portal.example.org"
RATE, GAP = 2, 21600

SEARCHES = (
    "ocean%20winds", "sea%20surface%20temperature", "salinity", "gravity", "sea%20ice", "ocean_wave",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the address, page path and moment the log lines are written from."""
    e = table(spark, sf_dir, "events")
    kw = F.get(F.array(*[F.lit(s) for s in SEARCHES]), (F.col("event_id") % 6).cast("int"))
    ds = (F.col("event_id") % 20).cast("string")
    page = F.concat(F.lit("/dataset/DS_"), ds)
    path = (
        F.when(
            F.col("event_type") == "signup",
            F.concat(F.lit("/datasetlist?ids=Measurement:Sensor&values=Ocean%20Winds:QuikSCAT&search="), kw),
        )
        .when(F.col("event_type") == "click", F.concat(F.lit("/datasetlist?search="), kw, F.lit("&view=list")))
        .when(F.col("event_type") == "view", F.concat(page, F.lit("?search="), kw))
        .when((F.col("event_type") == "error") & (F.col("event_id") % 4 == 1), F.lit("/css/site.css"))
        .otherwise(page)
    )
    ip = F.concat(
        F.lit("10.0."), F.floor(F.col("user_id") / 256).cast("string"), F.lit("."),
        (F.col("user_id") % 256).cast("string"),
    )
    return e.select(
        F.col("event_id").alias("line_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type",
        ip.alias("ip"), ds.alias("ds"), path.alias("path"),
    )


def http_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, line) in the combined access-log format, with malformed lines among them."""
    pages = _visits(spark, sf_dir).where("event_type <> 'purchase'")
    before = F.lag("path").over(Window.partitionBy("ip").orderBy("ts", "line_id"))
    n = F.col("line_id")
    referer = F.when((n % 5 == 0) | before.isNull(), "-").otherwise(F.concat(F.lit(SITE), F.lower(before)))
    error = F.col("event_type") == "error"
    line = F.concat(
        F.col("ip"), F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET '),
        F.col("path"), F.lit(' HTTP/1.1" 200 '), F.when(n % 10 == 0, "-").otherwise(n.cast("string")),
        F.lit(' "'), F.col("referer"), F.lit('" "'),
        F.when(error & (n % 4 == 0), "curl/7.1").otherwise("Mozilla/5.0"), F.lit('"'),
    )
    broken = F.concat(F.lit("MALFORMED "), n.cast("string"))
    return pages.withColumn("referer", referer).select(
        "line_id", F.when(error & (n % 4 == 2), broken).otherwise(line).alias("line")
    )


def ftp_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, line) in the transfer-log format."""
    n = F.col("line_id")
    ext = F.when(n % 3 == 0, ".txt").otherwise(".nc")
    line = F.concat(
        F.lit("Mon "), F.date_format("ts", "MMM d HH:mm:ss yyyy"), F.lit(" 1 "), F.col("ip"), F.lit(" "),
        (n + 1000).cast("string"), F.lit(" /data/ds_"), F.col("ds"), F.lit("/f_"), n.cast("string"), ext,
        F.lit(" b _ o a anon ftp 0 * c"),
    )
    return _visits(spark, sf_dir).where("event_type = 'purchase'").select("line_id", line.alias("line"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return http_lines(spark, sf_dir).unionByName(ftp_lines(spark, sf_dir))


def visitor_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered HTTP and FTP requests of everybody."""
    return logs.scan_http(http_lines(spark, sf_dir)).unionByName(logs.scan_ftp(ftp_lines(spark, sf_dir)))


def clean_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawlers.remove_crawlers(stage(visitor_log(spark, sf_dir), "visitor-log"), SITE, RATE)


def gap_sessions(spark: SparkSession, sf_dir: str, gap: int = GAP) -> DataFrame:
    return sessions.sessions_by_gap(stage(clean_log(spark, sf_dir), "clean-log"), gap)


def referer_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions_by_referer(clean_log(spark, sf_dir), SITE, GAP)


def chained_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree nodes with parents by order alone: a search under the search before it, a page under the
    latest search, a transfer under the latest page. Same columns as the referer tree."""
    rows = sessions.session_requests(gap_sessions(spark, sf_dir))
    path = F.when(F.col("log_type") == "http", request_path(F.col("request")))
    w = Window.partitionBy(*sessions.SESSION).orderBy("seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    nodes = rows.select(
        *sessions.SESSION, "seq", event_class(F.col("log_type"), F.col("request")).alias("key"),
        F.lower(F.coalesce(path, "request")).alias("request"), dataset_id(path).alias("dataset_id"),
    ).where("key <> 'other'")
    for kind, name in (("datasetlist", "_search"), ("dataset", "_view")):
        nodes = nodes.withColumn(name, F.last(F.when(F.col("key") == kind, F.struct("seq", "request")), ignorenulls=True).over(so_far))
    is_ftp, no_search = F.col("key") == "ftp", F.col("_search").isNull()
    placed = nodes.where((F.col("key") == "datasetlist") | F.when(is_ftp, F.col("_view").isNotNull()).otherwise(~no_search))
    below = F.lead("key").over(Window.partitionBy(*sessions.SESSION, F.col("key") == "datasetlist").orderBy("seq"))
    return placed.select(
        *sessions.SESSION, "seq", "key", "request", "dataset_id", F.col("_search.request").alias("search_url"),
        F.when(is_ftp, F.col("_view.seq")).otherwise(F.coalesce("_search.seq", F.lit(0))).alias("parent_seq"),
        F.when(is_ftp, "dataset").when(no_search, "root").otherwise("datasetlist").alias("parent_key"),
        ((F.col("key") == "dataset") & F.coalesce(below == "ftp", F.lit(False))).alias("downloaded"),
    )


def browsed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The referer tree of visitors who come to each page from the search page before it."""
    log = gap_sessions(spark, sf_dir)
    path = F.when(F.col("log_type") == "http", request_path(F.col("request")))
    search = F.when(event_class(F.col("log_type"), F.col("request")) == "datasetlist", F.concat(F.lit(SITE), F.lower(path)))
    before = Window.partitionBy(*sessions.SESSION).orderBy("ts", "line_id").rowsBetween(Window.unboundedPreceding, -1)
    referer = F.coalesce(F.last(search, ignorenulls=True).over(before), F.lit("-"))
    return tree.session_tree(log.withColumn("referer", referer), SITE)


# --- purchases as sessions -------------------------------------------------------------------------


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their part: customer = visitor, order = session, part name = keyword."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", "p_type", normalise(F.col("p_name")).alias("keyword")
    )
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)


def session_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (ip, session_id, keyword)."""
    return purchases(spark, sf_dir).select(
        F.col("o_custkey").alias("ip"), F.col("l_orderkey").alias("session_id"), "keyword"
    ).distinct()


def history_pairs(keywords: DataFrame) -> DataFrame:
    """Keyword pairs by shared visitors from (ip, session_id, keyword)."""
    long = mining.user_term_matrix(keywords)
    return matrix.positive_pairs(matrix.row_cosine(long)).withColumn("model", F.lit("userHistory"))


def click_pairs(bought: DataFrame) -> DataFrame:
    """Keyword pairs by shared order, tf-idf weighted, from (ip, session_id, keyword) with repeats."""
    occurrences = bought.select(F.col("keyword").alias("term"), F.col("session_id").alias("doc"))
    weights = matrix.tfidf(matrix.term_counts(occurrences)).select("term", F.col("doc").alias("feature"), "weight")
    return matrix.positive_pairs(matrix.row_cosine(weights)).withColumn("model", F.lit("userClicking"))


def brand_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tf-idf of part names (terms) over lines of a brand (documents)."""
    parts = table(spark, sf_dir, "part").select(
        normalise(F.col("p_name")).alias("term"), F.concat_ws(" ", "p_brand", "p_type").alias("doc")
    )
    return matrix.tfidf(matrix.term_counts(parts))


def metadata_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword pairs by shared brand, tf-idf weighted."""
    weights = brand_weights(spark, sf_dir).select("term", F.col("doc").alias("feature"), "weight")
    return matrix.positive_pairs(matrix.row_cosine(weights)).withColumn("model", F.lit("GCMDMetadata"))


def term_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three pair models in one written table."""
    bought = stage(
        purchases(spark, sf_dir).select(
            F.col("o_custkey").alias("ip"), F.col("l_orderkey").alias("session_id"), "keyword"
        ),
        "purchases",
    )
    models = (history_pairs(bought.distinct()), click_pairs(bought), metadata_pairs(spark, sf_dir))
    parts = [m.select("term_a", "term_b", "weight", "model") for m in models]
    return stage(parts[0].unionByName(parts[1]).unionByName(parts[2]), "term-pairs")


def ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples between the names of consecutive parts, loaded like an ontology file."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    after = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("object"))
    triples = parts.join(after, "p_partkey").select(
        F.col("p_name").alias("subject"),
        F.when(F.col("p_size") % 2 == 0, "SubClassOf").otherwise("EquivalentClass").alias("predicate"), "object",
    )
    return parse_triples(triples)


def keyword_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("input")).distinct()


def rule_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query-filter pairs of every order line: brand and type against each other and the line's status."""
    p = purchases(spark, sf_dir)
    flag = F.concat(F.lit("flag:"), "l_returnflag")
    status = F.concat(F.lit("status:"), "l_linestatus")
    row = lambda a, b, t: F.struct(a.alias("query_a"), b.alias("filter_b"), F.lit(t).alias("type"))
    brand, kind = F.col("p_brand"), F.col("p_type")
    rows = F.array(
        row(brand, kind, 0), row(kind, brand, 0), row(brand, flag, 0), row(brand, status, 0), row(kind, flag, 0),
        row(brand, F.concat(flag, F.lit(","), status, F.lit(",")), 1),
    )
    return p.select(F.inline(rows)).withColumn("weight", F.lit(1.0))


# --- documents as metadata -------------------------------------------------------------------------


def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_by(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc")
    return matrix.stemmed_counts(docs)


def asked_terms(spark: SparkSession, sf_dir: str, counts: DataFrame) -> DataFrame:
    """The searches of the portal's users: the longest word of each benchmark passage that some document has.

    Words as long as one another are taken in their order; how many documents have a word doesn't matter.
    """
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(content_tokens(F.col("text"))).alias("token"))
    longest = words.groupBy("item_id").agg(F.min(F.struct(-F.length("token"), "token"))["token"].alias("token"))
    return longest.select(stem(F.col("token")).alias("term")).distinct().join(counts.select("term").distinct(), "term", "left_semi")


def asked_pairs(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """Cosine of the asked terms with every term of the documents."""
    weights = matrix.tfidf(counts).select("term", F.col("doc").alias("feature"), "weight")
    return matrix.cosine_with(weights, terms)


def metadata_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as dataset metadata; every fourth one lacks an abstract."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("PART_"), F.col("p_partkey").cast("string")).alias("short_name"),
        F.concat(F.lit('the "'), "p_name", F.lit('"')).alias("long_name"),
        F.concat("p_name", F.lit(", "), "p_brand", F.lit(","), "p_name").alias("keyword"),
        F.col("p_type").alias("term"),
        F.concat(F.lit('"'), "p_type", F.lit(' goods","'), "p_brand", F.lit('"')).alias("topic"),
        F.concat(F.lit("size "), F.col("p_size").cast("string"), F.lit(",")).alias("variable"),
        F.when(
            F.col("p_partkey") % 4 != 0, F.concat(F.lit("100% "), "p_name", F.lit(" & "), "p_type", F.lit("?"))
        ).alias("abstract"),
    )
