"""A Merkle manifest of a dataset, its upper levels built by a butterfly exchange.

Rows are leaves; each group's leaves are ordered and cut into aligned blocks of fanout^k. A block hashes its
own subtree. Then blocks swap subtree roots round by round: in round r the `FANOUT` blocks that differ only in
digit r of their number (base `FANOUT`) meet, and each of them hashes the run's parent for itself. After as
many rounds as the largest group has digits every block holds the group's root and all siblings on its way
there, so that no pass goes down the tree. The groups' roots go through the same exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage

FANOUT = 8
LEVELS = 4  # of a block: blocks hold FANOUT^4 leaves
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaf_digest(columns: list[Column]) -> Column:
    """Binary sha256 of the columns: `-` for null, else the UTF-8 length, a colon and the value."""
    parts = [c.cast("string") for c in columns]
    fields = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def row_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered): the digest of each row, and that of its tampered form where it is tampered with.

    Tampered are the rows where 3 divides the crc32 of the decimal doc_id: the text's A-Z are lower-cased.
    A row without a doc_id isn't tampered with.
    """
    text = F.col("text").cast("string")
    columns = {name: F.col(name) for name in COLUMNS}
    touched = columns | {"text": F.translate(text, *LOWER)}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        leaf_digest(list(columns.values())).alias("leaf"),
        F.when(chosen, leaf_digest(list(touched.values()))).alias("tampered"),
    )


def placed(leaves: DataFrame) -> DataFrame:
    """`leaves` with `unit` (the group's number: lang, null first) and `pos` (the leaf's place in its group), both from 0.

    Leaves are range-sorted by (lang, doc_id, leaf). Equal rows are interchangeable, so a salt lets many of
    them lie in several tasks. What is summed in one place is one count for each file and group in it: files
    are sorted, so there are no more of these than files and groups.
    """
    salted = stage(leaves.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "merkle-leaves")
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf", "salt"]
    ordered = stage(
        salted.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
        .withColumn("number", F.monotonically_increasing_id()),
        "merkle-order",
    ).withColumn("part", F.shiftright("number", 33)).withColumn("known", F.col("lang").isNotNull())
    # A group is (known, lang or ''), which has no nulls.
    ordered = ordered.withColumn("lang", F.coalesce("lang", F.lit("")))
    runs = ordered.groupBy("part", "known", "lang").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("known", "lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "part", "known", "lang", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        (F.dense_rank().over(Window.orderBy("known", "lang")) - 1).cast("bigint").alias("unit"),
    )
    return ordered.join(stage(runs, "merkle-runs"), ["part", "known", "lang"]).select(
        "unit", (F.col("offset") + F.col("number") - F.col("first")).alias("pos"), "doc_id", "leaf", "tampered"
    )


def _parents(nodes: list[str]) -> list[str]:
    return [_hash("".join(nodes[i:i + FANOUT])) for i in range(0, len(nodes), FANOUT)]


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def block_roots(leaves: DataFrame, size: int) -> DataFrame:
    """(unit, block, digest): the root of each block of `size` leaves. A group of one leaf has that leaf as its root.

    A block that is not the only one of its group is hashed to its full height, as nodes above it need.
    """
    def root(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["pos"].to_pylist(), table["leaf"].to_pylist(), strict=True))
        nodes, width = [leaf.hex() for _, leaf in rows], size
        alone = table["n"][0].as_py() <= size
        while (len(nodes) > 1) if alone else (width > 1):
            nodes, width = _parents(nodes), width // FANOUT
        return pa.table({"unit": table["unit"][:1], "block": table["block"][:1], "digest": nodes})

    return leaves.groupBy("unit", "block").applyInArrow(root, "unit bigint, block bigint, digest string")


def exchanged(blocks: DataFrame, rounds: int) -> DataFrame:
    """(unit, block, digest, siblings, digits) from (unit, block, blocks, digest) after that many rounds.

    digest is the root of the block's group; siblings holds, level by level, the digests of the others in the
    run, digits the block's own place in it. `blocks` is the number of blocks of the unit. A group that is
    ready keeps its root. In the last aligned group, where blocks may be missing, those present speak for the
    missing ones too, in turns; what they post for them is addressed to others only.
    """
    state = blocks.select(
        "unit", "block", "blocks", "digest", F.array().cast("array<array<string>>").alias("siblings"),
        F.array().cast("array<int>").alias("digits"),
    )
    for r in range(rounds):
        width = FANOUT**r
        ready = F.col("blocks") <= width
        start = F.col("block") - F.col("block") % width
        present = F.least(F.lit(width), F.col("blocks") - start)
        # Meeting points are the low digits; a group with all its blocks posts each of them once.
        low = F.col("block") % width
        last = F.when(ready, low).otherwise(F.lit(width - 1))
        posts = state.select("*", F.explode(F.sequence(low, last, F.when(ready, F.lit(width)).otherwise(present))).alias("low"))
        posts = posts.withColumn("own", F.col("low") == low)
        run = F.floor(F.col("block") / (width * FANOUT)).cast("bigint")
        digit = (F.floor(F.col("block") / width) % FANOUT).cast("int")
        post = F.struct(
            digit.alias("digit"), "digest", "own", F.when(F.col("own"), F.col("block")).alias("block"),
            F.when(F.col("own"), F.col("siblings")).alias("siblings"), F.when(F.col("own"), F.col("digits")).alias("digits"),
        )
        met = posts.groupBy("unit", "blocks", run.alias("run"), "low").agg(
            F.array_sort(F.collect_list(post)).alias("run_members")  # FANOUT of them at most
        )
        parent = F.sha2(F.array_join(F.transform("run_members", lambda m: m["digest"]), ""), 256)
        others = F.transform(F.filter("run_members", lambda m: m["digit"] != F.col("me.digit")), lambda m: m["digest"])
        met = met.select(
            "unit", "blocks", "run_members", F.explode(F.filter("run_members", lambda m: m["own"])).alias("me"), parent.alias("parent")
        )
        done = F.col("blocks") <= width
        state = met.select(
            "unit", F.col("me.block").alias("block"), "blocks", F.when(done, F.col("me.digest")).otherwise(F.col("parent")).alias("digest"),
            F.when(done, F.col("me.siblings")).otherwise(F.concat("me.siblings", F.array(others))).alias("siblings"),
            F.when(done, F.col("me.digits")).otherwise(F.concat("me.digits", F.array("me.digit"))).alias("digits"),
        )
    return state


def _rounds(most: int) -> int:
    rounds = 0
    while FANOUT**rounds < most:
        rounds += 1
    return rounds


RESULT = (
    "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def _proofs(size: int):
    """The function from a block's leaves and its upper path to the rows of the manifest."""
    def fold(node: str, path: list[tuple[int, list[str]]]) -> str:
        for digit, others in path:
            node = _hash("".join(others[:digit]) + node + "".join(others[digit:]))
        return node

    def proofs(leaves: pa.Table, paths: pa.Table) -> pa.Table:
        upper = paths.to_pylist()[0]
        rows = sorted(leaves.to_pylist(), key=lambda x: (x["pos"], x["leaf"]))
        levels, width = [[x["leaf"].hex() for x in rows]], size
        alone = rows[0]["n"] <= size
        while (len(levels[-1]) > 1) if alone else (width > 1):
            levels.append(_parents(levels[-1]))
            width //= FANOUT
        above = list(zip(upper["digits"], upper["siblings"], strict=True))
        tail = "".join("".join(others) for _, others in above)
        out = {name: [] for name in ("leaf", "proof_sha256", "folded_root", "verified")}
        for i, row in enumerate(rows):
            path, at = [], i
            for nodes in levels[:-1]:
                run = at - at % FANOUT
                path.append((at - run, nodes[run:at] + nodes[at + 1:run + FANOUT]))
                at //= FANOUT
            found = row["tampered"].hex() if row["tampered"] is not None else levels[0][i]
            folded = fold(found, path + above)
            out["leaf"].append(levels[0][i])
            out["proof_sha256"].append(_hash("".join("".join(others) for _, others in path) + tail))
            out["folded_root"].append(folded)
            out["verified"].append(folded == upper["root"])
        n = len(rows)
        return pa.table({
            "doc_id": pa.array([x["doc_id"] for x in rows], pa.int64()), "leaf": out["leaf"],
            "subroot": [upper["subroot"]] * n, "root": [upper["root"]] * n, "proof_sha256": out["proof_sha256"],
            "folded_root": out["folded_root"], "verified": out["verified"],
        })

    return proofs


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs (columns `COLUMNS`).

    Leaves of a lang ascend by doc_id (null first; rows of one doc_id by their digest); runs of `FANOUT`
    become their parents until one node, the lang's subroot, is left; subroots in the order of lang (null
    first) likewise give the root. folded_root is worked out from the tampered leaf, else the original, and the
    original siblings; verified says whether it is the root.

    Nulls are values of their own, an empty text differs from a null one. A lang with one row has its leaf as
    subroot, without siblings. Repeated rows are leaves each. Other columns are not read. No rows in, no rows out.
    """
    size = FANOUT**levels
    places = placed(row_leaves(docs))
    leaves = stage(places.withColumn("block", F.floor(F.col("pos") / size).cast("bigint")), "merkle-places")
    counts = stage(leaves.groupBy("unit").agg(F.count(F.lit(1)).alias("n")), "merkle-counts")
    counts = counts.withColumn("blocks", F.ceil(F.col("n") / size).cast("bigint"))
    most, units = counts.agg(F.max("blocks"), F.count(F.lit(1))).first()
    if not units:
        return docs.sparkSession.createDataFrame([], RESULT)
    sized = leaves.join(counts.select("unit", "n"), "unit")
    roots = stage(block_roots(sized, size), "merkle-roots").join(counts.select("unit", "blocks"), "unit")
    below = stage(exchanged(roots, _rounds(most)), "merkle-groups")
    tops = below.where("block = 0").select(
        F.lit(0).cast("bigint").alias("unit"), F.col("unit").alias("block"), F.lit(units).cast("bigint").alias("blocks"), "digest"
    )
    tops = stage(exchanged(tops, _rounds(units)), "merkle-tops").select(
        F.col("block").alias("unit"), F.col("digest").alias("root"), F.col("siblings").alias("more"), F.col("digits").alias("then")
    )
    paths = below.join(tops, "unit").select(
        "unit", "block", F.col("digest").alias("subroot"), "root", F.concat("siblings", "more").alias("siblings"),
        F.concat("digits", "then").alias("digits"),
    )
    return sized.groupBy("unit", "block").cogroup(paths.groupBy("unit", "block")).applyInArrow(_proofs(size), RESULT)
