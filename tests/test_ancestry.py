"""Path doubling against a plain walk from parent to parent."""

import random

from tidemark.operators import ancestry, mining

SCHEMA = "month string, ip string, session_id string, seq int, parent_seq int, key string, request string, downloaded boolean"


def random_nodes(seed=3):
    """Sessions with random parents, one long path of searches, one of pages under pages, and one whose parent is missing."""
    draw, rows = random.Random(seed), []
    for session in range(12):
        for seq in range(1, 40):
            parent = draw.randrange(max(0, seq - 4), seq)
            key = draw.choice(["datasetlist", "datasetlist", "dataset"])
            rows.append(("2024-01", "1.1.1.1", f"s{session}", seq, parent, key, f"/{key}?search=w{draw.randrange(9)}&n={seq}", draw.random() < 0.4))
    for seq in range(1, 301):
        rows.append(("2024-01", "2.2.2.2", "long", seq, seq - 1, "dataset" if seq == 300 else "datasetlist", f"/datasetlist?search=w{seq}", seq == 300))
        rows.append(("2024-01", "2.2.2.2", "pages", seq, seq - 1, "datasetlist" if seq == 1 else "dataset", f"/datasetlist?search=w{seq}", False))
    rows.append(("2024-02", "3.3.3.3", "lost", 5, 4, "dataset", "/dataset/x", True))
    return rows


def plain_paths(rows):
    """{(session, seq): [(k, seq of the search)]} by walking up."""
    at = {(r[2], r[3]): r for r in rows}
    out = {}
    for r in rows:
        path, up = [], at.get((r[2], r[4]))
        while up is not None:
            if up[5] == "datasetlist":
                path.append(up[3])
            up = at.get((up[2], up[4]))
        out[(r[2], r[3])] = list(enumerate(path))
    return out


def test_all_ancestors(spark):
    rows = random_nodes()
    nodes = spark.createDataFrame(rows, SCHEMA)
    want = sorted((s, n, k, up) for (s, n), path in plain_paths(rows).items() if s != "pages" for k, up in path)
    asked = nodes.where("session_id <> 'pages'")
    got = sorted((r["session_id"], r["seq"], r["k"], r["search_seq"]) for r in ancestry.searches_above(nodes, asked).collect())
    assert got == want
    near = {(r["session_id"], r["seq"]): r["up"] for r in ancestry.nearest_searches(nodes).collect()}
    assert near == {place: (path[0][1] if path else 0) for place, path in plain_paths(rows).items()}


def test_keyword_pairs_and_empty(spark):
    rows = [r for r in random_nodes() if r[2] != "pages"]
    nodes, paths = spark.createDataFrame(rows, SCHEMA), plain_paths(rows)
    words = {(r[2], r[3]): r[6].split("search=")[1].split("&")[0] for r in rows if "search=" in r[6]}
    want = sorted(
        (r[2], r[6], words[r[2], far], words[r[2], near], round(1 / (k + 1), 6))
        for r in rows if r[5] == "dataset" and r[7]
        for k, near in paths[r[2], r[3]] for j, far in paths[r[2], r[3]] if k < j and words[r[2], near] != words[r[2], far]
    )
    got = mining.keyword_pairs(nodes).collect()
    assert sorted((r["session_id"], r["view_url"], r["keyword_a"], r["keyword_b"], round(r["weight"], 6)) for r in got) == want
    none = spark.createDataFrame([], SCHEMA)
    assert mining.keyword_pairs(none).count() == 0 and ancestry.search_paths(none, none).count() == 0
