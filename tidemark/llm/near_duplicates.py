"""Near-duplicates of a stated similarity: texts meet by SimHash and under their smallest shingles, and are verified on whole sets.

First texts meet in the groups of `simhash`: fingerprints of three-word shingles linked within two bits. What SimHash
leaves apart, for its ball is narrower than the stated similarity, meets under smallest shingles.

A text has eight smallest shingle hashes, one in each of eight orders. Two texts share the smallest of an order with
the chance of their Jaccard similarity, so at 0.8 they meet in one of the eight with a chance of 0.999997. Texts with no
shingle in common never meet.

All pairs of what meets are tested, except those already linked through others: by size, by a fingerprint of 256
bits, and where these allow the similarity, on the whole sets. A crowd under one shingle is dealt in blocks, and each
pair of blocks is one cell of bounded size; the pairs are walked inside a task, so no table holds them. Whole sets are
sent only to cells where a partner of another group is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.batches import bounded_batches
from tidemark.llm.graph import components
from tidemark.llm.joins import ids_side
from tidemark.llm.simhash import BITS, _mixed, _ones, ball_links, prints_of, shingle_hashes
from tidemark.session import stage, stage_result

RUN, RADIUS = 3, 2  # of SimHash: words of a shingle, and bits that linked fingerprints may differ in
PARTS = 8
PASSES = ((0,), (1,), tuple(range(2, PARTS + 1)))  # parts that are verified at once; what is linked by then is left out later
WORDS = 4  # of 64 bits each in a fingerprint
TIES = 0.04  # more bits that small sets may differ in, whose votes tie
BLOCK_NODES = 1024
BLOCK_SHINGLES = 1 << 20
SLICE = 1 << 14  # shingles of one row on their way to Spark


def far_bits(similarity: float) -> int:
    """Five standard deviations above the bits that the fingerprints of two equally large sets of that similarity differ in."""
    share, bits = math.acos(2 * similarity / (1 + similarity)) / math.pi + TIES, WORDS * BITS
    return math.ceil(bits * share + 5 * math.sqrt(bits * share * (1 - share)))


def distinct_shingles(raw: bytes | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text; they take about the room of the text."""
    parts = [np.unique(part) for part in shingle_hashes(raw or b"", size)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def sketches_of(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, n, print, lows) of each text: a hash of its set of shingles, how many these are, the fingerprint of the set, and the smallest hash in each part's order."""
    sums, totals = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64)
    counts, lows = np.zeros((len(texts), WORDS, BITS), np.int32), np.zeros((len(texts), PARTS), np.uint64)
    held: list[tuple[int, np.ndarray]] = []

    def add() -> None:
        owners, lengths = [i for i, _ in held], [len(hashes) for _, hashes in held]
        hashes, starts = np.concatenate([hashes for _, hashes in held]), np.cumsum([0] + lengths[:-1])
        sums[owners] = np.add.reduceat(_mixed(hashes, PARTS + 1), starts)
        totals[owners] = lengths
        for word in range(WORDS):
            counts[owners, word] = _ones(_mixed(hashes, PARTS + 1 + word if word else 0), starts)
        for part in range(PARTS):
            lows[owners, part] = np.minimum.reduceat(_mixed(hashes, part + 1), starts)
        held.clear()

    for i, raw in enumerate(texts):
        if len(hashes := distinct_shingles(raw, size)):
            held.append((i, hashes))
        if sum(len(hashes) for _, hashes in held) >= 1 << 16:
            add()
    if held:
        add()
    prints = np.packbits((2 * counts > totals[:, None, None]).astype(np.uint8), axis=2, bitorder="little").view("<i8")[:, :, 0]
    return _mixed(sums + totals.astype(np.uint64), 1).view(np.int64), totals, prints, lows.view(np.int64)


def _narrow(docs: DataFrame, *more: Column) -> DataFrame:
    return bounded_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("raw"), *more)


def row_mark(docs: DataFrame) -> Column:
    """A hash of the whole row; which columns are null counts."""
    return F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns))


def sketches(docs: DataFrame, size: int, mark: Column | None = None) -> DataFrame:
    """(doc_id, mark, node, n, simhash, print, lows) of every row; equal nodes mean equal sets of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            node, n, prints, lows = sketches_of(texts, size)
            simhash = prints_of(texts, RUN, 1)[:, 0]
            lists = [
                pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * each.shape[1]), pa.array(each.ravel()))
                for each in (prints, lows)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(node), pa.array(n), pa.array(simhash), *lists],
                ["doc_id", "mark", "node", "n", "simhash", "print", "lows"],
            )

    marked = _narrow(docs, (F.lit(0).cast("bigint") if mark is None else mark).alias("mark"))
    return marked.mapInArrow(run, "doc_id bigint, mark bigint, node bigint, n bigint, simhash bigint, print array<bigint>, lows array<bigint>")


def shingles(docs: DataFrame, size: int) -> DataFrame:
    """(node, shingle), distinct, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(1):
                raw = raw.as_py()
                node = int(sketches_of([raw], size)[0][0])
                hashes = distinct_shingles(raw, size).view(np.int64)
                for at in range(0, len(hashes), SLICE):
                    piece = hashes[at:at + SLICE]
                    lists = pa.ListArray.from_arrays(pa.array([0, len(piece)], pa.int32()), pa.array(piece))
                    yield pa.RecordBatch.from_arrays([pa.array([node]), lists], ["node", "shingles"])

    found = _narrow(docs).mapInArrow(run, "node bigint, shingles array<bigint>")
    return found.select("node", F.explode("shingles").alias("shingle")).distinct()


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """(node, hashes): the sorted distinct shingles of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(1):
                raw = raw.as_py()
                hashes = distinct_shingles(raw, size).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array([0, len(hashes)], pa.int32()), pa.array(hashes))
                yield pa.RecordBatch.from_arrays([pa.array(sketches_of([raw], size)[0]), lists], ["node", "hashes"])

    return _narrow(docs).mapInArrow(run, "node bigint, hashes array<bigint>")


CELL = ["part", "low", "x", "y"]
MEMBER = "part int, low bigint, x bigint, y bigint, block bigint, node bigint, n bigint, print array<bigint>, lows array<bigint>"


def cells(kinds: DataFrame, block_nodes: int, block_shingles: int) -> DataFrame:
    """The nodes under each shared smallest shingle, dealt in blocks; a row for each pair x <= y of blocks that its block is in."""
    lows = kinds.where("n > 0").select("node", "n", "print", "lows", F.posexplode("lows").alias("part", "low"))
    shared = lows.groupBy("part", "low").agg(F.count(F.lit(1)).alias("holders"), F.sum("n").alias("held")).where("holders > 1")
    blocks = F.greatest(F.ceil(F.col("holders") / block_nodes), F.ceil(F.col("held") / block_shingles))
    met = lows.join(shared.select("part", "low", blocks.cast("bigint").alias("blocks")), ["part", "low"])
    met = met.withColumn("block", F.expr("pmod(xxhash64(part, node), blocks)"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    met = met.select("part", "low", "block", "node", "n", "print", "lows", other)
    return met.select("part", "low", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "n", "print", "lows")


def _dealt(members: DataFrame) -> DataFrame:
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bounded_batches(members).repartition(parts, *CELL).sortWithinPartitions(*CELL)


def _cells_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one cell at a time, from rows that come sorted by cell."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in CELL])
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        if held and tuple(keys[:, 0]) != last:
            yield pa.Table.from_batches(held)
            held = []
        for at, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            if at:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
        last = tuple(keys[:, -1])
    if held:
        yield pa.Table.from_batches(held)


class _Members:
    """The nodes of a cell, and which of them may be near a given one."""

    def __init__(self, cell: pa.Table, similarity: float, far: int):
        self.part, self.same = cell["part"][0].as_py(), cell["x"][0].as_py() == cell["y"][0].as_py()
        self.nodes, self.n, self.block = (cell[c].to_numpy() for c in ("node", "n", "block"))
        self.prints = cell["print"].combine_chunks().flatten().to_numpy().reshape(-1, WORDS).view(np.uint64)
        self.lows = cell["lows"].combine_chunks().flatten().to_numpy().reshape(len(self.nodes), -1)[:, :self.part]
        self.similarity, self.far = similarity, far

    def may_be_near(self, i: int, of: np.ndarray) -> np.ndarray:
        """Those of `of` that the sizes and prints allow and that no earlier part has brought together with `i`."""
        if not self.same:
            of = of[self.block[of] != self.block[i]]
        n = self.n[of]
        of = of[np.minimum(n, self.n[i]) >= self.similarity * np.maximum(n, self.n[i]) - 1e-9]
        of = of[np.bitwise_count(self.prints[of] ^ self.prints[i]).sum(1, dtype=np.int64) <= self.far]
        return of[~(self.lows[of] == self.lows[i]).any(1)] if self.part else of


def contenders(members: DataFrame, similarity: float, more: str = "") -> DataFrame:
    """The members of cells that have one in their cell they may be near to; with a root, one of another root.

    A member without such a partner gives no link of its cell, whatever the others give, so links of what stays
    join the same groups. `more` is the schema of columns beside those of a member.
    """
    far = far_bits(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells_in(batches):
            found = _Members(cell, similarity, far)
            marked = np.zeros(len(found.nodes), bool)
            roots = cell["root"].to_numpy() if "root" in cell.column_names else found.nodes
            for i in range(len(marked) - 1):
                later = np.arange(i + 1, len(marked))
                partners = found.may_be_near(i, later[roots[later] != roots[i]])
                if len(partners):
                    marked[partners] = marked[i] = True
            if marked.any():
                yield from cell.filter(pa.array(marked)).combine_chunks().to_batches()

    return _dealt(members).mapInArrow(run, MEMBER + more)


def star(own: np.ndarray, group: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join `own` groups of nodes into the larger `group`: from the smallest node of each to the smallest of all."""
    order = np.argsort(nodes, kind="stable")
    ends = order[np.unique(own[order], return_index=True)[1]]
    ends = ends[np.argsort(nodes[ends], kind="stable")]
    first, which = np.unique(group[ends], return_index=True, return_inverse=True)[1:]
    a, b = nodes[ends[first]][which], nodes[ends]
    return a[a != b], b[a != b]


def linked(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b) links that join the members (with their root and hashes) of every cell as all near pairs of it would.

    What a cell joins is a star, so that `components` needs few rounds.
    """
    far = far_bits(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells_in(batches):
            found = _Members(cell, similarity, far)
            group = np.unique(cell["root"].to_numpy(), return_inverse=True)[1]
            own = group.copy()
            lists = cell["hashes"].combine_chunks()
            held, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            bounds = np.concatenate([[0], np.cumsum(found.n)])
            mark = np.zeros(len(held), bool)
            for i in range(len(group) - 1):
                later = np.arange(i + 1, len(group))
                partners = found.may_be_near(i, later[group[later] != group[i]])
                if not len(partners):
                    continue
                mark[codes[bounds[i]:bounds[i + 1]]] = True
                both = np.array([np.count_nonzero(mark[codes[bounds[j]:bounds[j + 1]]]) for j in partners])
                mark[codes[bounds[i]:bounds[i + 1]]] = False
                near = partners[both >= similarity * (found.n[i] + found.n[partners] - both) - 1e-9]
                if len(near):
                    group[np.isin(group, group[near])] = group[i]
            a, b = star(own, group, found.nodes)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return _dealt(members).mapInArrow(run, "a bigint, b bigint")


def large_pairs(kinds: DataFrame, similarity: float, block_shingles: int) -> DataFrame:
    """(a, b) pairs that meet and may be near, one of which has more shingles than a block."""
    rows = kinds.where("n > 0").select("node", "n", "print", F.posexplode("lows").alias("part", "low"))
    large = rows.where(F.col("n") > block_shingles).select("part", "low", *(F.col(c).alias(f"_{c}") for c in ("node", "n", "print")))
    pairs = rows.join(large, ["part", "low"]).where(
        (F.col("node") != F.col("_node"))
        & (F.least("n", "_n") >= similarity * F.greatest("n", "_n") - 1e-9)
        & (F.aggregate(F.zip_with("print", "_print", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b) <= far_bits(similarity))
    )
    return pairs.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets (node, shingle) have that Jaccard similarity or more."""
    sizes = sets.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    sized = pairs.join(sizes.select(F.col("node").alias("a"), F.col("size").alias("m")), "a").join(
        sizes.select(F.col("node").alias("b"), F.col("size").alias("n")), "b"
    )
    common = sized.join(sets.withColumnRenamed("node", "a"), "a").join(sets.withColumnRenamed("node", "b"), ["b", "shingle"])
    common = common.groupBy("a", "b", "m", "n").agg(F.count(F.lit(1)).alias("both"))
    return common.where(F.col("both") >= similarity * (F.col("m") + F.col("n") - F.col("both")) - 1e-9).select("a", "b")


def _texts_of(docs: DataFrame, kinds: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows with a text of each of the nodes, and others with the same doc_id."""
    ids = stage(kinds.select("node", "low").join(nodes, "node").select(F.col("low").alias("_end")).distinct(), "ends")
    return docs.select("doc_id", "text").join(ids_side(ids), F.col("doc_id").eqNullSafe(F.col("_end"))).select("doc_id", "text")


def met_by_simhash(rows: DataFrame, kinds: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The kinds with one more part, the first: the SimHash group of the node. Groups are joined within `radius` bits."""
    held = stage(rows.select("node", F.lit(0).alias("table"), F.col("simhash").alias("fp")).distinct(), "simhash")
    heads = stage(held.groupBy("table", "fp").agg(F.min("node").alias("head")), "simhash-heads")
    same = held.join(heads, ["table", "fp"]).where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    near = ball_links(heads.select("table", "fp"), radius)
    near = near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    groups = components(same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b"))), "a", "b")
    met = kinds.join(groups.withColumnRenamed("root", "_group"), "node", "left")
    return stage(met.withColumn("lows", F.concat(F.array(F.coalesce("_group", "node")), "lows")).drop("_group"), "met-kinds")


def near_links(
    docs: DataFrame, kinds: DataFrame, size: int, similarity: float, block_nodes: int = BLOCK_NODES, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """(a, b) links between nodes that join them as all pairs that meet and have the similarity would."""
    usual = kinds.where(F.col("n") <= block_shingles)
    tried = stage(contenders(cells(usual, block_nodes, block_shingles), similarity), "contenders")
    nodes = tried.select("node").distinct()
    sets = stage(sets_of(_texts_of(docs, kinds, nodes), size).join(nodes, "node", "left_semi").dropDuplicates(["node"]), "sets")
    found = []
    if not kinds.where(F.col("n") > block_shingles).isEmpty():
        pairs = stage(large_pairs(kinds, similarity, block_shingles), "large-pairs")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        whole = shingles(_texts_of(docs, kinds, ends), size).join(ends, "node", "left_semi")
        found.append(stage(verified(pairs, stage(whole, "shingles"), similarity), "near"))
    for parts in PASSES:
        members = tried.where(F.col("part").isin(*parts)).withColumn("root", F.col("node"))
        if found:
            roots = components(reduce(DataFrame.unionByName, found), "a", "b")
            found = [roots.select(F.col("node").alias("a"), F.col("root").alias("b"))]  # stands for all links so far
            members = members.join(roots.withColumnRenamed("root", "_root"), "node", "left").withColumn("root", F.coalesce("_root", "node")).drop("_root")
            members = contenders(members.select(*tried.columns, "root"), similarity, ", root bigint")
        found.append(stage(linked(members.join(sets, "node"), similarity), "near"))
    return reduce(DataFrame.unionByName, found)


def near_roots(docs: DataFrame, size: int, similarity: float, mark: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The sketches of every row, and (node, low, root): the smallest doc_id of the node, and the root of its group.

    Texts are lower-cased (A-Z) and split at white space; texts with equal sets of shingles are one node, also
    those without words. Nodes are linked when their sets of shingles (fewer words: the whole sequence) are found
    and have `similarity`; groups are the connected components. No rows in, no rows out.
    """
    rows = stage(sketches(docs, size, mark), "sketches")
    kinds = stage(
        rows.groupBy("node").agg(F.min("doc_id").alias("low"), *(F.first(c).alias(c) for c in ("n", "print", "lows"))), "kinds"
    )
    roots = components(near_links(docs, met_by_simhash(rows, kinds), size, similarity), "a", "b")
    return rows, stage(
        kinds.select("node", "low").join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")), "placed"
    )


def near_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every row: the smallest doc_id of its group, by `near_roots`.

    A group all of whose rows have a null doc_id has a null component_id. Other columns of `docs` are not read.
    """
    rows, placed = near_roots(docs, size, similarity)
    classes = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(placed.select("node", "root").join(classes, "root"), "node").select("doc_id", "component_id")


def _free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of `docs` has one of them."""
    taken = {c.lower() for c in docs.columns}
    while taken & set(names):
        names = tuple(f"_{n}" for n in names)
    return list(names)


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents with one row of each near-duplicate group: a row of the smallest doc_id.

    Among the group's rows of that id the one with the smallest hash of its columns stays. Rows with a null
    doc_id are kept only when nothing else is in their group. Ids may repeat: what counts is the row.
    """
    kept_id, kept_mark, mark, turn = _free_names(docs, "_kept", "_kept_mark", "_mark", "_row")

    def chosen() -> DataFrame:
        rows, placed = near_roots(docs, size, similarity, row_mark(docs))
        first = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("first"))
        best = first.join(placed, "node").groupBy("root").agg(F.min("first").alias("first"))
        return best.select(F.col("first.doc_id").alias(kept_id), F.col("first.mark").alias(kept_mark))

    best = stage_result(docs.sparkSession, chosen, "best")
    marked = docs.withColumn(mark, row_mark(docs))
    kept = marked.join(ids_side(best), F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(mark) == F.col(kept_mark)))
    same = Window.partitionBy("doc_id", mark).orderBy(mark)
    return kept.withColumn(turn, F.row_number().over(same)).where(F.col(turn) == 1).select(*docs.columns)
