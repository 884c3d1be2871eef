"""Session and tree rules on literal logs, and against small step-by-step models."""

import random
import time
from datetime import datetime, timedelta

import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import crawlers, mining, sessions, tree
from tidemark.plans import queries

SITE = "http://s"
START = datetime(2024, 1, 1)
SCHEMA = (
    "line_id bigint, month string, log_type string, ip string, ts timestamp, request string, response string, "
    "bytes bigint, referer string, agent string"
)


def log(spark, rows, ip="1.1.1.1"):
    """rows: (seconds, path or ftp path, referer); referer None makes a transfer."""
    data = [
        (i, "2024-01", "ftp" if ref is None else "http", ip, START + timedelta(seconds=s),
         path if ref is None else f"GET {path} HTTP/1.1", "200", 1, ref, "M")
        for i, (s, path, ref) in enumerate(rows)
    ]
    frame = spark.createDataFrame(data, SCHEMA)
    return crawlers.remove_crawlers(frame, SITE, rate=1000, http_only=False)


def ids(frame):
    return [r["session_id"].split("@")[1] for r in frame.orderBy("line_id").collect()]


def by_referer(spark, rows):
    return ids(sessions.sessions_by_referer(log(spark, rows), SITE))


def test_referer_rule(spark):
    assert by_referer(spark, [(0, "/a", "-"), (1, "/b", "http://other/"), (2, "/c", SITE + "/")]) == ["1", "2", "3"]
    assert by_referer(spark, [(0, "/a", "-"), (599, "/b", SITE + "/a")]) == ["1", "1"]
    assert by_referer(spark, [(0, "/a", "-"), (600, "/b", SITE + "/a")]) == ["1", "2"]
    assert by_referer(spark, [(0, "/a", SITE + "/x"), (1, "/b", SITE + "/y")]) == ["0", "1"]
    assert by_referer(spark, [(0, "/a", "-"), (600, "/f", None)]) == ["1", "1"]
    assert by_referer(spark, [(0, "/a", "-"), (601, "/f", None)]) == ["1", "2"]
    assert by_referer(spark, [(0, "/f", None), (5, "/a", SITE + "/x")]) == ["0", "1"]
    # two pages walked back: the limit is twice as long
    assert by_referer(spark, [(0, "/a", "-"), (300, "/b", SITE + "/a"), (1199, "/c", SITE + "/a")]) == ["1", "1", "1"]
    assert by_referer(spark, [(0, "/a", "-"), (300, "/b", SITE + "/a"), (1200, "/c", SITE + "/a")]) == ["1", "1", "2"]


def plain_referer_sessions(rows, gap=600):
    """The rule walked literally: sessions newest first, pages of a session most recent first."""
    made, last, count, out = {}, {}, 0, []
    for s, path, ref in rows:
        url = path if ref is None else SITE + path.lower()
        if ref is None:
            if count not in made:
                made[count] = []
            elif s - last[count] > gap:
                count += 1
                made[count] = []
            target = count
        elif ref == "-" or SITE + "/" not in ref or ref == SITE + "/":
            count += 1
            made[count], target = [], count
        else:
            walked, target = 0, None
            for number in range(count, -1, -1):
                if number not in made:
                    made[number], target = [], number
                    break
                for page, when in reversed(made[number]):
                    walked += 1
                    if page == ref.lower():
                        target = number if s - when < gap * walked else -1
                        break
                if target is not None:
                    break
            if target is None or target == -1:
                count += 1
                made[count], target = [], count
        made[target] = [(p, w) for p, w in made[target] if p != url] + [(url, s)]
        last[target] = s
        out.append(str(target))
    return out


def test_referer_rule_against_literal_walk(spark):
    rng = random.Random(7)
    for _ in range(3):
        now, rows = 0, []
        for _ in range(400):
            now += rng.choice([1, 50, 400, 700, 2000])
            path = f"/p{rng.randrange(12)}"
            ref = rng.choice(["-", None, SITE + f"/p{rng.randrange(14)}", SITE + f"/p{rng.randrange(14)}"])
            rows.append((now, path, ref))
        assert by_referer(spark, rows) == plain_referer_sessions(rows)


def test_gap_sessions_cross_midnight(spark):
    day = 86400
    rows = [(day - 10, "/a", "-"), (day + 10, "/b", "-"), (day + 700, "/c", "-"), (3 * day, "/d", "-"), (3 * day + 600, "/e", "-")]
    assert ids(sessions.sessions_by_gap(log(spark, rows), 600)) == ["1", "1", "2", "3", "3"]


def test_merging(spark):
    one = log(spark, [(0, "/a", SITE + "/q"), (599, "/b", SITE + "/q"), (1199, "/c", "-")])
    given = one.withColumn("session_id", F.concat(F.lit("1.1.1.1@"), (F.col("line_id") + 1).cast("string")))
    assert ids(sessions.combine_short_sessions(given)) == ["1", "1", "3"]
    two = given.where("line_id < 2")
    assert [r["session_id"] for r in sessions.combine_short_sessions(two).collect()] == ["invalid"] * 2
    bare = log(spark, [(i, f"/{i}", "-") for i in range(4)]).withColumn("session_id", F.lit("1.1.1.1@1"))
    assert {r["session_id"] for r in sessions.combine_short_sessions(bare).collect()} == {"invalid"}
    most = log(spark, [(i, f"/{i}", "-" if i else SITE + "/q") for i in range(5)]).withColumn("session_id", F.lit("x"))
    assert {r["session_id"] for r in sessions.combine_short_sessions(most).collect()} == {"invalid"}
    assert {r["session_id"] for r in sessions.combine_short_sessions(most, compat=True).collect()} == {"x"}


def test_rate_and_http_only(spark):
    fast = [(i % 60, "/a", "-") for i in range(30)]
    frame = log(spark, fast).drop("request_url", "to_last")
    assert crawlers.without_crawlers(frame, 30).count() == 0
    assert crawlers.without_crawlers(frame, 31).count() == 30
    only_ftp = log(spark, [(0, "/f", None)]).drop("request_url", "to_last")
    assert crawlers.without_crawlers(only_ftp).count() == 0
    assert crawlers.without_crawlers(only_ftp, http_only=False).count() == 1


LIST, VIEW = "/datasetlist?search=sea%20ice", "/dataset/A?search=sea%20ice"


def grown(spark, rows, mode="referer"):
    one = log(spark, rows).withColumn("session_id", F.lit("1.1.1.1@1"))
    return tree.session_tree(one, SITE, mode)


def shape(nodes):
    return [(r["seq"], r["key"], r["parent_seq"]) for r in nodes.orderBy("seq").collect()]


def test_tree_chain(spark):
    nodes = grown(spark, [(0, LIST, "-"), (1, VIEW, SITE + LIST), (2, "/d/f.nc", None)]).cache()
    assert shape(nodes) == [(1, "datasetlist", 0), (2, "dataset", 1), (3, "ftp", 2)]
    click = mining.click_through(nodes).first()
    assert (click["keyword"], click["dataset"], click["downloaded"]) == ("sea ic", "a", True)
    assert [r["seq"] for r in tree.download_leaves(nodes).collect()] == [3]
    text = tree.tree_json(nodes).first()["tree"]
    assert text == (
        '{"seq":0,"name":"","icon":"users.png","children":[{"seq":1,"icon":"searching.png","name":"'
        + LIST + '","children":[{"seq":2,"icon":"viewing.png","name":"a","children":'
        '[{"seq":3,"icon":"downloading.png","name":"/d/f.nc"}]}]}]}'
    )


def test_tree_drops(spark):
    assert shape(grown(spark, [(0, VIEW, "-"), (1, LIST, "-"), (2, LIST, "-"), (3, VIEW, "-"), (4, "/f", None)])) == [(2, "datasetlist", 0)]
    deep = [(0, LIST, "-"), (1, LIST + "&x=1", SITE + LIST), (2, LIST, SITE + LIST + "&x=1"), (3, VIEW, SITE + LIST), (4, LIST + "&y", SITE + "/none")]
    assert shape(grown(spark, deep)) == [
        (1, "datasetlist", 0), (2, "datasetlist", 1), (3, "datasetlist", 2), (4, "dataset", 3), (5, "datasetlist", 0)
    ]


def test_trees_of_sessions_that_lie_across_batches():
    """Batches of a few rows, as Spark sends them, grow the trees of the plain rule; columns that only pass stay whole."""
    draw, rows = random.Random(4), []
    for number in range(60):
        for seq in range(draw.randint(1, 25)):
            key = draw.choice(tree.KEYS) if seq else "datasetlist"
            rows.append({"month": "m", "ip": "i", "session_id": f"i@{number}", "seq": seq + 1, "epoch": seq, "key": key, "request": f"/{key}{draw.randint(0, 3)}",
                         "dataset_id": f"d{seq}", "referer": draw.choice(["-", "/datasetlist1", "/dataset2", ""]), "_starts": seq == 0})
    sent = pa.Table.from_pylist(rows, pa.schema([
        ("month", "string"), ("ip", "string"), ("session_id", "string"), ("seq", "int32"), ("epoch", "int64"), ("key", "string"),
        ("request", "string"), ("dataset_id", "string"), ("referer", "string"), ("_starts", "bool"),
    ]))
    got = [node for batch in tree._grow(sent.to_batches(max_chunksize=7)) for node in batch.to_pylist()]
    sessions_of = {}
    for row in rows:
        sessions_of.setdefault(row["session_id"], []).append({k: v for k, v in row.items() if k != "_starts"})
    assert got == [node for session in sessions_of.values() for node in tree.referer_tree(session)] and len(got) > 200
    assert list(tree._grow([])) == []


def test_rows_before_the_first_search_are_not_sent(spark):
    one = log(spark, [(0, VIEW, "-"), (1, "/f", None), (2, LIST, "-"), (3, VIEW, SITE + LIST)]).withColumn("session_id", F.lit("s"))
    nodes = tree.session_tree(one, SITE)
    assert shape(nodes) == [(3, "datasetlist", 0), (4, "dataset", 3)]
    assert "_searches" in nodes._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1]


def test_sessions_of_documents_are_worked_out_once(spark, sf_dir, monkeypatch):
    """The documents read the sessions three times: for the tree, the requests and the keywords."""
    staged, written = [], queries.stage
    monkeypatch.setattr(queries, "stage", lambda table, label: staged.append(label) or written(table, label))
    assert queries.session_documents(spark, sf_dir).count() == queries.gap_sessions(spark, sf_dir).select("ip", "month", "session_id").distinct().count()
    assert staged == ["sessions", "session-documents"]


def test_first_fit(spark):
    rows = [(0, LIST, "-"), (1, LIST + "&x", "-"), (2, VIEW, "-"), (3, "/f", None), (4, "/g", None)]
    assert shape(grown(spark, rows, "first_fit")) == [
        (1, "datasetlist", 0), (2, "datasetlist", 1), (3, "dataset", 2), (4, "ftp", 3), (5, "ftp", 3)
    ]


def test_keyword_pairs_weights(spark):
    other = "/datasetlist?search=gravity"
    third = "/datasetlist?search=ocean%20winds"
    rows = [(0, other, "-"), (1, third, SITE + other), (2, LIST, SITE + third), (3, VIEW, SITE + LIST), (4, "/f", None)]
    got = {(r["keyword_a"], r["keyword_b"]): round(r["weight"], 3) for r in mining.keyword_pairs(grown(spark, rows)).collect()}
    assert got == {("ocean wind", "sea ic"): 1.0, ("graviti", "sea ic"): 1.0, ("graviti", "ocean wind"): 0.5}


def test_query_filter_pairs(spark):
    search = "/datasetlist?ids=sensor:timespan&values=grace:daily&search=ice"
    rows = [(0, search, "-"), (1, VIEW, SITE + search)]
    got = {(r["query_a"], r["filter_b"], r["type"]) for r in mining.query_filter_pairs(grown(spark, rows)).collect()}
    assert got == {
        ("ice", "sensor:grace", 0), ("ice", "timespan:daily", 0), ("ice", "sensor:grace,timespan:daily,", 1),
        ("grace", "timespan:daily", 0), ("grace", "timespan:daily,", 1),
    }


def test_request_limit_is_a_parameter(spark):
    one = log(spark, [(i, f"/p{i}", "-") for i in range(120)]).withColumn("session_id", F.lit("s"))
    assert sessions.session_requests(one, 100).count() == 100
    assert sessions.session_requests(one).count() == 120


def test_long_visitors_and_sessions_stay_linear():
    state = sessions.VisitorSessions(600)
    start = time.time()
    state.page("/old", None, False, 0)
    for i in range(100_000):
        state.page(f"/p{i}", None, False, i)
        state.page(f"/q{i}", "/old", True, i)
    rows = [
        {"month": "m", "ip": "i", "session_id": "s", "seq": i + 1, "epoch": i, "key": "datasetlist", "request": f"/l{i}",
         "dataset_id": None, "referer": f"/l{i - 1}"} for i in range(50_000)
    ]
    nodes = tree.referer_tree(rows)
    assert len(nodes) == 50_000 and nodes[-1]["parent_seq"] == 49_999 and nodes[-1]["search_url"] == "/l49998"
    assert time.time() - start < 20


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(-3, 3)), max_size=60))
def test_tail_sums(steps):
    sums, plain = sessions.TailSums(), []
    for place, value in steps:
        if place < len(plain):
            sums.add(place, value)
            plain[place] += value
        else:
            sums.append(value)
            plain.append(value)
        assert all(sums.tail(i) == sum(plain[i:]) for i in range(len(plain) + 1))


def test_session_gate(spark):
    rows = [(0, LIST, "-"), (1, VIEW, SITE + LIST)] + [(2 + i, f"/d/{i}.nc", None) for i in range(101)]
    one = log(spark, rows).withColumn("session_id", F.lit("s"))
    assert sessions.session_statistics(one).count() == 0
    stats = sessions.session_statistics(one.where("line_id < 102")).first()
    assert (stats["download_count"], stats["list_count"], stats["view_count"], stats["keywords"]) == (100, 1, 1, ["sea ic"])
