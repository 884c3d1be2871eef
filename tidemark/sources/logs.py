"""Access-log scans: raw text lines in, typed request rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import month_of

# Fixed value: the combined access-log format (address, identity, user, time, request, status,
# bytes, referer, agent). A line counts only when the whole of it matches.
HTTP_LINE = (
    r'^([\d.]+) (\S+) (\S+) \[([\w:/]+\s[+-]\d{4})\] "(.+?)" (\d{3}) (\d+|-) "(.+)" "([^"]+)"$'
)

# Agents dropped on equality and agents dropped when they contain a marker.
CRAWLER_AGENTS = (
    "gsa-crawler (Enterprise; T4-JPDGU3TRCQAXZ; earthdata-sa@lists.nasa.gov,srinivasa.s.tummala@nasa.gov)",
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
    "Mozilla/5.0 (compatible; bingbot/2.0; +http://www.bing.com/bingbot.htm)",
    "Mozilla/5.0 (compatible; Yahoo! Slurp; http://help.yahoo.com/help/us/ysearch/slurp)",
    "rogerbot/1.0 (http://www.moz.com/dp/rogerbot, rogerbot-crawler@moz.com)",
    "yacybot (/global; amd64 Windows Server 2008 R2 6.1; java 1.8.0_31; Europe/de) http://yacy.net/bot.html",
    "Mozilla/5.0 (compatible; YandexBot/3.0; +http://yandex.com/bots)",
    "Googlebot-Image/1.0",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 6_0 like Mac OS X) AppleWebKit/536.26 (KHTML, like Gecko) "
    "Version/6.0 Mobile/10A5376e Safari/8536.25 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
    "-",
)
CRAWLER_MARKERS = ("libwww-perl/", "Apache-HttpClient/", "Java/", "curl/")

# Request lines that are page furniture or service calls, not visitor actions.
ASSET_MARKERS = (
    ".js", ".css", ".jpg", ".png", ".ico", "image_captcha", "autocomplete", ".gif", "/alldata/",
    "/api/", ".jpeg", "/ws/",
)
HOME_REQUEST = "get / http/1.1"

LOG_COLUMNS = (
    "line_id", "month", "log_type", "ip", "ts", "request", "response", "bytes", "referer", "agent",
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with an id that grows along a file, so requests of one second keep the order of the log.

    The id is a hash of the file's path (23 bits), then the start of the block plus the line's place in
    the task (40 bits). Blocks hold no more lines than bytes, and tasks begin with the whole blocks, so
    later blocks have larger ids. A re-read with the same split size gives the same ids.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    file = F.shiftrightunsigned(F.xxhash64("_metadata.file_path"), 41)
    return spark.read.text(path).select(
        (F.shiftleft(file, 40) + F.col("_metadata.file_block_start") + place).alias("line_id"),
        F.col("value").alias("line"),
    )


MARK = "\u0001"
HTTP_GROUPS = (1, 4, 5, 6, 7, 8, 9)


def _http_fields(line: Column) -> Column:
    """The wanted groups of a line as an array, null when the line does not match.

    One pass of the expression rewrites the line to its groups; a line that holds the separator itself
    takes the slow path, one pass per group.
    """
    rewritten = F.split(F.regexp_replace(line, HTTP_LINE, MARK.join(f"${i}" for i in HTTP_GROUPS)), MARK)
    slow = F.array(*[F.regexp_extract(line, HTTP_LINE, i) for i in HTTP_GROUPS])
    return F.when(~F.contains(line, F.lit(MARK)), rewritten).when(line.rlike(HTTP_LINE), slow)


def parse_http(lines: DataFrame) -> DataFrame:
    """Combined-format lines (line_id, line) to request rows; other lines are dropped.

    The fields go through a generator on purpose: filters on them stay above it, where they read a
    parsed field, instead of sinking below the parser and running it once per condition.
    """
    matched = F.filter(F.array(_http_fields(F.col("line"))), lambda f: F.size(f) == len(HTTP_GROUPS))
    parts = lines.select("line_id", F.explode(matched).alias("f"))
    f = lambda i: F.get("f", F.lit(i))
    stamped = parts.select(
        "line_id", "f",
        F.explode(F.array(F.try_to_timestamp(f(1), F.lit("dd/MMM/yyyy:HH:mm:ss Z")))).alias("ts"),
    )
    return stamped.where("ts is not null").select(
        "line_id",
        month_of(F.col("ts")).alias("month"),
        F.lit("http").alias("log_type"),
        f(0).alias("ip"),
        "ts",
        f(2).alias("request"),
        f(3).alias("response"),
        F.when(f(4) == "-", F.lit(0).cast("bigint")).otherwise(f(4).try_cast("bigint")).alias("bytes"),
        f(5).alias("referer"),
        f(6).alias("agent"),
    )


def parse_ftp(lines: DataFrame) -> DataFrame:
    """Transfer-log lines to request rows with a lower-cased path; short or undated lines are dropped."""
    words = lines.select("line_id", F.explode(F.array(F.split("line", " +"))).alias("w"))
    w = lambda i: F.get("w", F.lit(i))
    stamp = F.concat_ws(" ", w(1), w(2), w(3), w(4))
    return words.select(
        "line_id",
        F.lit("ftp").alias("log_type"),
        w(6).alias("ip"),
        F.try_to_timestamp(stamp, F.lit("MMM d HH:mm:ss yyyy")).alias("ts"),
        F.lower(w(8)).alias("request"),
        F.lit(None).cast("string").alias("response"),
        w(7).try_cast("bigint").alias("bytes"),
        F.lit(None).cast("string").alias("referer"),
        F.lit(None).cast("string").alias("agent"),
    ).where("ts is not null and bytes is not null and request is not null").withColumn(
        "month", month_of(F.col("ts"))
    ).select(*LOG_COLUMNS)


def is_known_crawler(agent: Column) -> Column:
    hit = agent.isin(*CRAWLER_AGENTS)
    for marker in CRAWLER_MARKERS:
        hit = hit | F.contains(agent, F.lit(marker))
    return hit


def is_asset_request(request: Column) -> Column:
    lowered = F.lower(request)
    pattern = "|".join(m.replace(".", r"\.") for m in ASSET_MARKERS)
    return lowered.rlike(pattern) | (lowered == HOME_REQUEST)


def is_ftp_noise(request: Column) -> Column:
    return F.contains(request, F.lit("/misc/")) | F.contains(request, F.lit("readme"))


def scan_http(lines: DataFrame) -> DataFrame:
    """Visitor page requests: parsed lines without known crawlers and page furniture."""
    rows = parse_http(lines)
    return rows.where(~is_known_crawler(F.col("agent")) & ~is_asset_request(F.col("request")))


def scan_ftp(lines: DataFrame) -> DataFrame:
    return parse_ftp(lines).where(~is_ftp_noise(F.col("request")))


def count_rejects(lines: DataFrame, pattern: str = HTTP_LINE) -> tuple[DataFrame, Observation]:
    """Attach a reject counter that fills while the lines are scanned, without a second pass."""
    seen = Observation("line_rejects")
    counted = lines.observe(
        seen,
        F.count(F.lit(1)).alias("lines"),
        F.count_if(~F.col("line").rlike(pattern)).alias("rejected"),
    )
    return counted, seen


def with_line_month(lines: DataFrame) -> DataFrame:
    """Year and month of a raw line of either format, without parsing the rest of it."""
    http = r"\[\d{2}/([A-Z][a-z]{2})/(\d{4}):"
    ftp = r"^\S+ +([A-Z][a-z]{2}) +\d+ +[\d:]+ +(\d{4}) "
    line = F.col("line")
    name = F.when(line.rlike(http), F.regexp_extract(line, http, 1)).when(
        line.rlike(ftp), F.regexp_extract(line, ftp, 1)
    )
    year = F.when(line.rlike(http), F.regexp_extract(line, http, 2)).when(
        line.rlike(ftp), F.regexp_extract(line, ftp, 2)
    )
    stamp = F.try_to_timestamp(F.concat_ws(" ", F.lit("1"), name, year), F.lit("d MMM yyyy"))
    return lines.withColumn("year", F.year(stamp)).withColumn("month", F.month(stamp))


def split_by_month(lines: DataFrame, path: str) -> None:
    """Write raw lines under year=/month= folders in one pass; undated lines land in the null folder."""
    with_line_month(lines).select("line", "year", "month").write.mode("overwrite").partitionBy(
        "year", "month"
    ).parquet(path)
