"""Request lines, URLs and query strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import bind, normalise_list

# Fixed value: how a page path is found inside a lower-cased request line.
REQUEST_PATH = "get (.*?) http/*"
LIST_PAGE = "/datasetlist?"
DATASET_PAGE = "/dataset/"

# The filter dimensions whose values count as search keywords.
KEYWORD_DIMENSIONS = ("collections", "measurement", "sensor", "platform", "variable")


def request_path(request: Column) -> Column:
    """Path of the last ``get … http/`` in a request line, lower-cased; null when there is none."""
    hits = F.regexp_extract_all(F.lower(F.trim(request)), F.lit(REQUEST_PATH), F.lit(1))
    return F.try_element_at(hits, F.lit(-1))


def request_url(log_type: Column, request: Column, site: str) -> Column:
    """Absolute URL of an HTTP page request; the raw request for anything else."""
    path = F.when(log_type == "http", request_path(request))
    return F.coalesce(F.concat(F.lit(site), path), request)


def site_referer(referer: Column, site: str) -> Column:
    """Referer in lower case without the site host; '' when missing."""
    return F.coalesce(F.replace(F.lower(referer), F.lit(site), F.lit("")), F.lit(""))


def event_class(log_type: Column, request: Column) -> Column:
    return (
        F.when(log_type == "ftp", "ftp")
        .when(F.contains(request, F.lit(LIST_PAGE)), "datasetlist")
        .when(F.contains(request, F.lit(DATASET_PAGE)), "dataset")
        .otherwise("other")
    )


def dataset_id(path: Column) -> Column:
    """Second path segment of a decoded ``/dataset/<id>`` path."""
    page = F.get(F.split(F.try_url_decode(path), "[?]"), F.lit(0))
    return F.when(F.contains(path, F.lit(DATASET_PAGE)), F.get(F.split(page, "/"), F.lit(2)))


def viewed_dataset(path: Column) -> Column:
    """Text between ``/dataset/`` and the query string of a page under ``/dataset/``."""
    return F.when(
        F.startswith(path, F.lit(DATASET_PAGE)), F.regexp_extract(path, "/dataset/([^? ]*)", 1)
    )


def download_path(log_type: Column, request: Column) -> Column:
    """FTP path of a data file; null for images, documents and HTTP rows."""
    suffix = F.substring_index(F.lower(request), ".", -1)
    documents = F.contains(request, F.lit(".")) & suffix.isin("jpg", "pdf", "txt", "gif")
    return F.when((log_type == "ftp") & ~documents, request)


def url_page(url: Column) -> Column:
    """Lower-cased part before '?'; null when the URL has no query string."""
    clean = F.lower(F.trim(url))
    return F.when(clean.rlike("[?][^?]"), F.substring_index(clean, "?", 1))


def query_part(url: Column) -> Column:
    """Lower-cased text between the first and the second '?'; null when there is none."""
    part = F.get(F.split(F.lower(F.trim(url)), "[?]"), F.lit(1))
    return F.when(part != "", part)


def query_pairs(url: Column) -> Column:
    """Query string as array<struct<key,value>>, one entry per key, the last duplicate kept."""
    pieces = F.filter(F.split(query_part(url), "&"), lambda p: F.get(F.split(p, "="), F.lit(0)) != "")
    pairs = F.transform(
        pieces,
        lambda p: F.struct(
            F.get(F.split(p, "="), F.lit(0)).alias("key"),
            F.coalesce(F.get(F.split(p, "="), F.lit(1)), F.lit("")).alias("value"),
        ),
    )
    return last_per_key(pairs)


def last_per_key(pairs: Column) -> Column:
    """Keep the last struct of every ``key`` in a short array of (key, value) structs."""
    marked = F.aggregate(
        F.reverse(pairs),
        F.filter(pairs, lambda p: F.lit(False)),
        lambda kept, p: F.when(F.exists(kept, lambda k: k["key"] == p["key"]), kept).otherwise(
            F.array_append(kept, p)
        ),
    )
    return F.reverse(marked)


def query_map(url: Column) -> Column:
    """Query string as map<string,string>; empty when the URL has none."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.map_from_entries(query_pairs(url)), empty)


def _value_in(part: Column, name: str) -> Column:
    pattern = f"^(?:.*&)?{name}(?:=([^&=]*)[^&]*)?(?:&.*)?$"
    return F.when(
        F.contains(part, F.lit(name)) & part.rlike(pattern), F.regexp_extract(part, pattern, 1)
    )


def query_value(url: Column, name: str) -> Column:
    """Value of the last occurrence of one parameter: '' without '=', null when absent."""
    return bind(query_part(url), lambda part: _value_in(part, name))


# The escapes and the punctuation that the next three functions name.


def repair_escapes(value: Column) -> Column:
    """Decode percent escapes after escaping every stray '%'; null when still malformed."""
    return F.try_url_decode(F.regexp_replace(value, "%(?![0-9a-fA-F]{2})", "%25"))


def leftover_escapes(value: Column) -> Column:
    """Escapes of plus, space and percent that survive decoding become spaces."""
    return F.regexp_replace(value, "%(?:2b|20|25)", " ")


def decode_value(value: Column) -> Column:
    """Decode twice-escaped text."""
    return leftover_escapes(repair_escapes(value))


def strip_punctuation(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(value, r'[-+^:,*_"\\]', " "), r"\s+", " "))


def _word_in(part: Column) -> Column:
    return F.coalesce(strip_punctuation(decode_value(_value_in(part, "search"))), F.lit(""))


def search_word(url: Column) -> Column:
    """Text typed into the search box; '' when absent."""
    return bind(query_part(url), _word_in)


NO_PAIRS = "array<struct<key:string,value:string>>"


def _filter_pairs(part: Column) -> Column:
    """array<struct<key,value>> of the ``ids``/``values`` lists, aligned by position, raw values."""
    values = F.split(repair_escapes(_value_in(part, "values")), ":")
    zipped = bind(values, lambda v: F.transform(
        F.split(repair_escapes(_value_in(part, "ids")), ":"),
        lambda k, i: F.struct(k.alias("key"), F.get(v, i).alias("value")),
    ))
    return F.coalesce(F.filter(zipped, lambda p: p["value"].isNotNull()), F.array().cast(NO_PAIRS))


def _clean_pairs(part: Column, word: Column) -> Column:
    """Filter pairs whose decoded value is neither empty nor the search text, values cleaned."""
    decoded = F.transform(
        _filter_pairs(part), lambda p: F.struct(p["key"].alias("key"), repair_escapes(p["value"]).alias("value"))
    )
    return F.transform(
        F.filter(decoded, lambda p: (p["value"] != "") & (p["value"] != word)),
        lambda p: F.struct(
            p["key"].alias("key"), strip_punctuation(leftover_escapes(p["value"])).alias("value")
        ),
    )


def search_info(url: Column) -> Column:
    """Normalised search keywords of a URL: the search text, then the keyword filters' values."""

    def words(part: Column, word: Column) -> Column:
        dims = F.filter(_clean_pairs(part, word), lambda p: p["key"].isin(*KEYWORD_DIMENSIONS))
        return F.concat(F.array(word), F.transform(dims, lambda p: p["value"]))

    found = bind(query_part(url), lambda part: bind(_word_in(part), lambda word: words(part, word)))
    return normalise_list(F.filter(found, lambda w: w != ""))


def filter_info(url: Column) -> Column:
    """Filters of a URL as array<struct<key,value>> sorted by key, the last duplicate kept."""

    def pairs(part: Column, word: Column) -> Column:
        period = repair_escapes(_value_in(part, "temporalsearch"))
        temporal = F.when(
            period.isNotNull(),
            F.array(F.struct(F.lit("temporalsearch").alias("key"), period.alias("value"))),
        ).otherwise(F.array().cast(NO_PAIRS))
        return F.concat(_clean_pairs(part, word), temporal)

    found = bind(query_part(url), lambda part: bind(_word_in(part), lambda word: pairs(part, word)))
    return F.array_sort(bind(found, last_per_key))


def legacy_filter_text(url: Column) -> Column:
    """Older ``k=v`` rendering of the raw filters plus the search text, sorted by key."""

    def all_pairs(part: Column) -> Column:
        word = repair_escapes(_value_in(part, "search"))
        search = F.when(
            word != "", F.array(F.struct(F.lit("search").alias("key"), word.alias("value")))
        ).otherwise(F.array().cast(NO_PAIRS))
        return F.concat(_filter_pairs(part), search)

    pairs = F.array_sort(bind(bind(query_part(url), all_pairs), last_per_key))
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",")
