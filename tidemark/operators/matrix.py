"""Term-document weights, SVD embedding and row cosine similarity, in long form."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import round2
from tidemark.functions.text import content_tokens, stem
from tidemark.operators import lowrank
from tidemark.session import shuffles_deleted, stage


def term_counts(occurrences: DataFrame) -> DataFrame:
    """(term, doc) rows to (term, doc, tf); counts combine before the shuffle."""
    return occurrences.groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"))


def stemmed_counts(texts: DataFrame) -> DataFrame:
    """Stem counts of (doc, text).

    Tokens are counted per text first and stemmed once per distinct token of it, all before the shuffle
    of the final count. Texts dealt by ``doc`` (`session.spread_by`) are counted without a shuffle of their words.
    """
    rows = texts.select("doc", F.explode(content_tokens(F.col("text"))).alias("token"))
    counted = rows.groupBy("doc", "token").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(stem(F.col("token")).alias("term"), "doc").agg(F.sum("n").alias("tf"))


def tfidf(counts: DataFrame) -> DataFrame:
    """Add ``weight`` = tf * ln((m + 1) / (df + 1)).

    Terms are the rows the idf is fitted on, so df is the number of distinct terms of the document and m
    the number of all terms: the factor weighs documents, not terms.
    """
    counts = stage(counts.select("term", "doc", "tf"), "term-counts")
    per_doc = stage(counts.groupBy("doc").agg(F.count(F.lit(1)).alias("df")), "document-sizes")  # small beside the counts
    with shuffles_deleted(counts.sparkSession):
        m = counts.agg(F.count_distinct("term")).first()[0]
    return counts.join(per_doc, "doc").select(
        "term", "doc", "tf", (F.col("tf") * F.log(F.lit(m + 1) / (F.col("df") + 1))).alias("weight")
    )


def click_tfidf(keywords: DataFrame) -> DataFrame:
    """Weights of (doc, keywords array): 1/size of the list times ln(int(N / df)) of the keyword.

    N is the number of documents and df the number of documents with the keyword.
    """
    keywords = stage(keywords.select("doc", "keywords"), "keyword-lists")
    sized = keywords.withColumn("_size", F.size("keywords"))
    rows = sized.select("doc", "_size", F.explode(F.array_distinct("keywords")).alias("term"))
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = keywords.agg(F.count(F.lit(1))).scalar()
    return rows.join(df, "term").select(
        "term", "doc", (F.log(F.floor(n / F.col("df"))) / F.col("_size")).alias("weight")
    )


def transpose(long: DataFrame, row: str = "term", column: str = "doc") -> DataFrame:
    """Swap rows and columns of a long matrix."""
    return long.select(
        *[F.col(c).alias(column if c == row else row if c == column else c) for c in long.columns]
    )


def frequent_terms(counts: DataFrame, min_docs: int | None = None, min_share: float | None = None) -> DataFrame:
    """Rows of terms found in more than ``min_docs`` documents, or in more than a share of them."""
    spread = counts.groupBy("term").agg(F.count(F.lit(1)).alias("_docs"))
    if min_share is not None:
        n_docs = counts.agg(F.count_distinct("doc")).scalar()
        spread = spread.where(F.col("_docs") > min_share * n_docs)
    if min_docs is not None:
        spread = spread.where(F.col("_docs") > min_docs)
    return counts.join(spread.select("term"), "term", "left_semi")


# --- cosine similarity of rows ---------------------------------------------------------------------

BLOCK_ROWS = 2048
BLOCK_ENTRIES = 500_000  # of one block over one slice
TILE = 1 << 20  # products, and cells of the result, that a task holds at once
DENSE = 0.2  # share of filled cells from which on a product is made of whole blocks
CELL = ["x", "y", "_slice"]


class _Block:
    """Rows of one block (over one slice): their names, and entries in the order of rows as places in a list of features."""

    def __init__(self, names: pa.Array, lengths: np.ndarray, features: pa.Array, codes: np.ndarray, weights: np.ndarray):
        self.names, self.n = names, len(lengths)
        self.starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.features, self.codes, self.weights = features, codes, weights

    @classmethod
    def of_lists(cls, rows: pa.Table) -> _Block:
        features, weights = (rows[c].combine_chunks() for c in ("features", "weights"))
        flat = features.flatten().dictionary_encode()
        return cls(rows["term"].combine_chunks(), features.value_lengths().to_numpy(), flat.dictionary, flat.indices.to_numpy(), weights.flatten().to_numpy())

    def some(self, rows: np.ndarray) -> _Block:
        """The block with some of its rows, given in rising order."""
        lengths = np.diff(self.starts)
        chosen = np.zeros(self.n, bool)
        chosen[rows] = True
        entries = np.repeat(chosen, lengths)
        return _Block(self.names.take(pa.array(rows)), lengths[rows], self.features, self.codes[entries], self.weights[entries])

    @cached_property
    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each feature's list starts (with an empty one at the end), and the rows and weights of all lists."""
        order = np.argsort(self.codes, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.codes, minlength=len(self.features) + 1))])
        return starts, np.repeat(np.arange(self.n), np.diff(self.starts))[order], self.weights[order]


def _places(left: _Block, right: _Block) -> np.ndarray:
    """For each entry of one block the place of its feature in the other's list, or the end of the list."""
    if left.features is right.features:
        return left.codes
    return pc.index_in(left.features, value_set=right.features).fill_null(len(right.features)).to_numpy()[left.codes]


def _tiles(left: _Block, right: _Block) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, dot products of some rows of one block with every row of the other), a bounded number at a time."""
    if not len(left.codes) or not len(right.codes):
        return
    a, n = _places(left, right), len(right.features)
    some = max(1, TILE // right.n)
    if len(left.codes) + len(right.codes) >= DENSE * n * (left.n + right.n):
        row_a, row_b = (np.repeat(np.arange(side.n), np.diff(side.starts)) for side in (left, right))
        wide = max(1, TILE // max(some, right.n))
        order_a, order_b = np.argsort(a, kind="stable"), np.argsort(right.codes, kind="stable")
        for low in range(0, left.n, some):
            tile = np.zeros((min(some, left.n - low), right.n))
            for c in range(0, n, wide):
                sides = []
                for code, row, order, w, at, size in ((a, row_a, order_a, left.weights, low, len(tile)), (right.codes, row_b, order_b, right.weights, 0, right.n)):
                    inside = order[slice(*np.searchsorted(code, [c, min(c + wide, n)], sorter=order))]
                    inside = inside[(row[inside] >= at) & (row[inside] < at + size)]
                    block = np.zeros((size, min(wide, n - c)))
                    block[row[inside] - at, code[inside] - c] = w[inside]
                    sides.append(block)
                tile += sides[0] @ sides[1].T
            yield low, tile
        return
    lists, row_b, w_b = right.lists
    lengths = np.diff(lists)[a]
    low = 0
    while low < left.n:
        high = min(low + some, left.n)
        tile = np.zeros((high - low) * right.n)
        at, end = left.starts[low], left.starts[high]
        row = np.repeat(np.arange(high - low), np.diff(left.starts[low:high + 1]))
        made = np.concatenate([[0], np.cumsum(lengths[at:end])])
        begin = 0
        while begin < end - at:
            stop = max(begin + 1, int(np.searchsorted(made, made[begin] + TILE, "right")) - 1)
            each = lengths[at + begin:at + stop]
            total = int(made[stop] - made[begin])
            if total:
                place = np.repeat(lists[a[at + begin:at + stop]] - made[begin:stop] + made[begin], each) + np.arange(total)
                cells = np.repeat(row[begin:stop] * right.n, each) + row_b[place]
                products = np.repeat(left.weights[at + begin:at + stop], each) * w_b[place]
                if total * 8 > len(tile):
                    tile += np.bincount(cells, products, minlength=len(tile))
                else:
                    np.add.at(tile, cells, products)
            begin = stop
        yield low, tile.reshape(-1, right.n)
        low = high


def _cell_of(batches: Iterator[pa.RecordBatch]) -> tuple[_Block, _Block, bool]:
    """The two blocks of a cell, and whether they are the same."""
    cell = pa.Table.from_batches(batches)
    x, y, block = cell["x"][0].as_py(), cell["y"][0].as_py(), cell["_block"].to_numpy()
    left = _Block.of_lists(cell.filter(pa.array(block == x)))
    return (left, left, True) if x == y else (left, _Block.of_lists(cell.filter(pa.array(block == y))), False)


def _cell_pairs(batches: Iterator[pa.RecordBatch], above: float | None) -> Iterator[pa.RecordBatch]:
    """Every pair a < b of a cell whose product is not zero, or is above a number."""
    yield from _block_pairs(*_cell_of(batches), above)


def _block_pairs(left: _Block, right: _Block, same: bool, above: float | None) -> Iterator[pa.RecordBatch]:
    names = left.names if same else pa.concat_arrays([left.names, right.names])
    rank = np.empty(len(names), np.int64)
    rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
    shift = 0 if same else left.n
    for low, tile in _tiles(left, right):
        i, j = np.nonzero(tile if above is None else tile > above)
        dots = tile[i, j]
        i, j = i + low, j + shift
        before = rank[i] < rank[j]
        if same:
            i, j, dots = i[before], j[before], dots[before]
        else:
            i, j = np.where(before, i, j), np.where(before, j, i)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), names.take(pa.array(j)), pa.array(dots)], ["term_a", "term_b", "dot"])


def normalised_rows(long: DataFrame) -> DataFrame:
    """Scale every row (term) of a long matrix to unit length; zero rows have no entries left."""
    norms = long.groupBy("term").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    return long.join(norms.where(F.col("_norm") > 0), "term").select(
        F.col("term").cast("string").alias("term"), "feature", (F.col("weight") / F.col("_norm")).alias("weight")
    )


def packed_rows(unit: DataFrame, slices: int, *more: str) -> DataFrame:
    """(term, _slice, features, weights): the entries of a row in one slice of the features as one row."""
    entry = F.collect_list(F.struct("feature", "weight"))
    packed = unit.groupBy("term", F.pmod(F.hash("feature"), F.lit(slices)).alias("_slice"), *more).agg(entry.alias("entries"))
    return packed.select("term", "_slice", *more, F.col("entries.feature").alias("features"), F.col("entries.weight").alias("weights"))


def met_blocks(packed: DataFrame, blocks: int) -> GroupedData:
    """Packed rows dealt in blocks by their term, grouped by pairs x <= y of blocks and slices: a cell gets each block once."""
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block, other = F.pmod(F.hash("term"), F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = packed.withColumn("_block", block).withColumn("_other", other)
    cells = dealt.withColumn("x", F.least("_block", "_other")).withColumn("y", F.greatest("_block", "_other")).drop("_other")
    return cells.repartition(parts, *CELL).groupBy(*CELL)


def row_cosine(
    long: DataFrame, blocks: int | None = None, slices: int | None = None, min_blocks: int = 1, above: float | None = None
) -> DataFrame:
    """Cosine of every pair of rows a < b of a long matrix (term, feature, weight) that is not zero, or is above a number.

    A blocked product of the matrix with its transpose. Rows are hashed into blocks; one task gets two blocks and
    multiplies them, so no group of rows that share a feature is ever paired up row by row. Blocks are written once and
    meet as rows of a table (`row_blocks`, `met_rows`), so a row is shuffled once, however many blocks there are. Few rows
    of many entries are dealt in slices of the features too: neither a hot feature nor a hot row can fill a task. Then
    a row travels once for each block, and products of a slice are one number per pair. Products leave a task a bounded
    number at a time. Both counts follow from the measured size unless given; (term, feature) must be unique.
    """
    known = stage(long.where("weight IS NOT NULL").select("term", "feature", "weight"), "matrix-rows")
    if blocks is None or slices is None:
        sizes = known.agg(F.approx_count_distinct("term").alias("rows"), F.count(F.lit(1)).alias("cells")).first()
        many = math.ceil(sizes["rows"] / BLOCK_ROWS)
        blocks = blocks or max(min_blocks, min(many, LEAST_BLOCKS), math.ceil(many / 4), min(many, math.ceil(sizes["cells"] / BLOCK_ENTRIES)))
        slices = slices or max(1, math.ceil(sizes["cells"] / (blocks * BLOCK_ENTRIES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cell_pairs(batches, above if slices == 1 else None)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, held, y, passing in _met(batches, _together(blocks)):
            yield from _block_pairs(passing, held, x == y, above)

    pairs = "term_a string, term_b string, dot double"
    if blocks > 1 and slices == 1:
        partial = met_rows(row_blocks(known, blocks), blocks).mapInArrow(multiply, pairs)
    else:
        unit = normalised_rows(known).where("feature IS NOT NULL")
        partial = met_blocks(packed_rows(unit, slices), blocks).applyInArrow(run, pairs)
    if slices > 1:
        partial = partial.groupBy("term_a", "term_b").agg(F.sum("dot").alias("dot"))
        partial = partial if above is None else partial.where(F.col("dot") > above)
    return partial.select("term_a", "term_b", F.col("dot").alias("weight"))


# --- blocks that meet without a shuffle --------------------------------------------------------------

ROUNDS = 6  # that a large matrix is dealt in, so that what is shuffled at once is a part of it
ROUND_CELLS = 2_000_000  # up to which fewer do
LEAST_BLOCKS = 16  # of a matrix of many rows, so that all cores have pairs of blocks
STREAMS = 96  # tasks at least, if there are that many pairs of blocks
HELD = 8  # blocks that a task holds at most


def _to_bytes(**columns: pa.Array) -> bytes:
    """Arrays of any lengths as one compressed value."""
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()]
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(lists, list(columns))
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _from_bytes(value: pa.Scalar) -> dict[str, pa.Array]:
    batch = pa.ipc.open_stream(value.as_buffer()).read_next_batch()
    return {name: batch.column(name).values for name in batch.schema.names}


def _packed_block(rows: pa.Table) -> pa.Table:
    """The entries of a block as one row: names in their order, unit weights, features as places in a list of them."""
    names = rows["term"].combine_chunks().dictionary_encode()
    places = pc.sort_indices(names.dictionary).to_numpy()
    rank = np.empty(len(places), np.int64)
    rank[places] = np.arange(len(places))
    row, weights = rank[names.indices.to_numpy()], rows["weight"].to_numpy().astype(float)
    norms = np.sqrt(np.bincount(row, weights * weights, minlength=len(places)))
    kept = ~(norms <= 0)  # of what is no number too
    features = rows["feature"].combine_chunks().dictionary_encode()
    entries = np.flatnonzero(kept[row] & features.is_valid().to_numpy(zero_copy_only=False))
    codes = features.indices.fill_null(0).to_numpy()[entries]
    entries = entries[np.lexsort((codes, row[entries]))]
    lengths = np.bincount(row[entries], minlength=len(places))[kept]
    data = _to_bytes(
        term=names.dictionary.take(pa.array(places[kept])), n=pa.array(lengths.astype(np.int32)), feature=features.dictionary,
        code=features.indices.take(pa.array(entries)).cast(pa.uint32()), weight=pa.array(weights[entries] / norms[row[entries]]),
    )
    return pa.table({"block": pa.array([rows["block"][0].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})


def _unpacked(data: pa.Scalar) -> _Block:
    columns = _from_bytes(data)
    return _Block(columns["term"], columns["n"].to_numpy(), columns["feature"], columns["code"].to_numpy().astype(np.int64), columns["weight"].to_numpy())


def row_blocks(long: DataFrame, blocks: int, cells: int | None = None) -> DataFrame:
    """(block, data), written: the unit rows of a long matrix (term, feature, weight), dealt in blocks by their term.

    A block is one row, packed. Blocks are made in up to `ROUNDS` rounds, each of which shuffles its own only, and a
    round's shuffle is deleted when it is written. Rows without a term and rows of zeros are left out; entries
    without a feature count for the length of their row only.
    """
    cells = long.count() if cells is None else cells
    rounds = max(1, min(ROUNDS, blocks, math.ceil(cells / ROUND_CELLS)))
    dealt = long.where("term IS NOT NULL").select(
        F.pmod(F.hash(F.col("term").cast("string")), F.lit(blocks)).alias("block"), F.col("term").cast("string").alias("term"), "feature",
        F.col("weight").cast("double").alias("weight"),
    )
    made = [
        stage(
            dealt.where(F.col("block") % rounds == k).repartition(math.ceil(blocks / rounds), "block").groupBy("block")
            .applyInArrow(_packed_block, "block int, data binary"),
            "row-blocks",
        )
        for k in range(rounds)
    ]
    return reduce(DataFrame.unionByName, made)


def _together(blocks: int) -> int:
    """Blocks that a task holds."""
    return max(1, min(HELD, blocks // STREAMS))


def met_rows(packed: DataFrame, blocks: int) -> DataFrame:
    """(x, held, y, passing): every pair of blocks once, x = y among them.

    Blocks meet by a join of their rows on numbers that stand in a ring, which Spark does without a shuffle: a task holds
    a few and reads the others from their files one by one.
    """
    packed.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")  # a batch has a few blocks at most
    tasks = math.ceil(blocks / _together(blocks))
    rest = [F.struct(*[c for c in packed.columns if c != "block"])]
    held = packed.select(F.col("block").alias("x"), *[c.alias("held") for c in rest]).coalesce(tasks)
    passing = packed.select(F.col("block").alias("y"), *[c.alias("passing") for c in rest]).coalesce(max(1, min(blocks, math.ceil(STREAMS / tasks))))
    apart = F.pmod(F.col("y") - F.col("x"), F.lit(blocks)) * 2
    once = (apart < blocks) | ((apart == blocks) & (F.col("x") < F.col("y")))
    return passing.hint("shuffle_replicate_nl").join(held, once).select("x", "held", "y", "passing")


def _met(batches: Iterator[pa.RecordBatch], together: int, unpack=lambda row: _unpacked(row["data"])) -> Iterator[tuple[int, _Block, int, _Block]]:
    """The pairs of blocks of `met_rows`. So many blocks as a task holds are kept, as they come again, and the one passing by."""
    known: dict[int, _Block] = {}
    for batch in batches:
        x, y, held, passing = (batch.column(c) for c in ("x", "y", "held", "passing"))
        for i in range(batch.num_rows):
            pair = x[i].as_py(), y[i].as_py()
            for block, row in zip(pair, (held[i], passing[i]), strict=True):
                known[block] = known.pop(block, None) or unpack(row)
                while len(known) > together + 1:
                    del known[next(iter(known))]
            yield pair[0], known[pair[0]], pair[1], known[pair[1]]


def _hundredths(weights: np.ndarray) -> np.ndarray:
    """Two decimals as whole numbers, half to even; noise past ten decimals cannot tip a tie."""
    whole, rest = np.divmod(np.rint(weights * 1e10).astype(np.int64), 10**8)
    return whole + ((rest > 5 * 10**7) | ((rest == 5 * 10**7) & (whole % 2 == 1)))


FEW_PRODUCTS = 1 / 16  # of a row with the rows of a block, for each of these: up to there they are sorted, not added up in a tile


def _hits(left: _Block, right: _Block, zero: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, other rows, dot products above a number) of two blocks, a bounded number at a time.

    Rows that few products fall to are told apart: theirs are sorted by pair, so a pair without a product costs nothing.
    """
    if not len(left.codes) or not len(right.codes):
        return
    a, (lists, row_b, w_b) = _places(left, right), right.lists
    lengths = np.diff(lists)[a]
    made = np.concatenate([[0], np.cumsum(lengths)])
    each = np.diff(made[left.starts])
    many = np.flatnonzero(each > right.n * FEW_PRODUCTS)
    if len(many):
        for low, tile in _tiles(left.some(many), right):
            i, j = np.nonzero(tile > zero)
            yield many[i + low], j, tile[i, j]
    few = np.zeros(left.n, bool)
    few[each > 0] = True
    few[many] = False
    row_a = np.repeat(np.arange(left.n), np.diff(left.starts))
    some = np.flatnonzero(few[row_a] & (lengths > 0))
    row_a, lengths, first, w_a = row_a[some], lengths[some], lists[a[some]], left.weights[some]
    made = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.append(np.flatnonzero(np.diff(row_a)) + 1, len(row_a))  # of rows among the entries; a row has TILE products at most, being few
    begin = 0
    while begin < len(row_a):
        stop = ends[max(0, np.searchsorted(made[ends], made[begin] + TILE, "right") - 1)]
        stop = int(stop if stop > begin else ends[np.searchsorted(ends, begin, "right")])
        counts = lengths[begin:stop]
        place = np.repeat(first[begin:stop] - made[begin:stop] + made[begin], counts) + np.arange(made[stop] - made[begin])
        cells = np.repeat(row_a[begin:stop] * right.n, counts) + row_b[place]
        products = np.repeat(w_a[begin:stop], counts) * w_b[place]
        by_cell = np.argsort(cells)
        cells = cells[by_cell]
        heads = np.flatnonzero(np.diff(cells, prepend=-1))
        dots = np.add.reduceat(products[by_cell], heads)
        found = dots > zero
        i, j = np.divmod(cells[heads[found]], right.n)
        yield i, j, dots[found]
        begin = stop


def _mixed(x: np.ndarray) -> np.ndarray:
    """Whole numbers scattered over 64 bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _marks(batches: Iterator[pa.RecordBatch], digits: int) -> Iterator[pa.RecordBatch]:
    """(term, n, sum, xor, block, at) of packed rows: what rows of one direction, to so many decimals, have in common.

    Directions are told apart by their number of entries and 128 bits of hashes.
    """
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
            columns = _from_bytes(data)
            lengths = columns["n"].to_numpy()
            names = [hashlib.blake2b(str(x).encode("utf-8", "surrogatepass"), digest_size=8).digest() for x in columns["feature"].to_pylist()]
            code = np.frombuffer(b"".join(names), np.uint64)[columns["code"].to_numpy()] if names else np.zeros(0, np.uint64)
            entry = np.rint(columns["weight"].to_numpy() * 10**digits).astype(np.int64).astype(np.uint64)
            one, other = (_mixed(code ^ _mixed(entry + np.uint64(seed))) for seed in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03))
            starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)[:-1]
            rows = np.flatnonzero(lengths > 0)
            if not len(rows):
                continue
            yield pa.RecordBatch.from_arrays([
                columns["term"].take(pa.array(rows)), pa.array(lengths[rows], pa.int32()),
                pa.array(np.add.reduceat(one, starts[rows]).view(np.int64)), pa.array(np.bitwise_xor.reduceat(other, starts[rows]).view(np.int64)),
                pa.array(np.full(len(rows), block, np.int32)), pa.array(rows.astype(np.int32)),
            ], ["term", "_n", "_sum", "_xor", "block", "at"])


def _packed_sizes(rows: pa.Table) -> pa.Table:
    """The first rows of classes in a block, and the sizes of these classes, as one row."""
    order = np.argsort(rows["at"].to_numpy())
    data = _to_bytes(at=rows["at"].combine_chunks().take(pa.array(order)), size=rows["size"].combine_chunks().take(pa.array(order)))
    return pa.table({"block": rows["block"].slice(0, 1).cast(pa.int32()), "sizes": pa.array([data], pa.binary())})


def _first_rows(row: pa.Scalar) -> _Block:
    """The rows of a packed block that are the first of a class."""
    sizes = _from_bytes(row["sizes"])
    block = _unpacked(row["data"]).some(sizes["at"].to_numpy())
    block.at, block.sizes = sizes["at"].to_numpy(), sizes["size"].to_numpy()
    return block


def _links(batches: Iterator[pa.RecordBatch], together: int, zero: float) -> Iterator[pa.RecordBatch]:
    """(block, found): what the rows of a block have in links to those of the blocks it met in this task.

    The sums of a block that others passed by are left when the next one comes, those of the blocks held at the end.
    """
    sums: dict[int, tuple[_Block, np.ndarray]] = {}

    def left(block: int) -> pa.RecordBatch:
        of, found = sums.pop(block)
        data = _to_bytes(at=pa.array(of.at), links=pa.array(found[:, 0]), hundredths=pa.array(found[:, 1]))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data], pa.binary())], ["block", "found"])

    held_here: set[int] = set()
    for x, held, y, passing in _met(batches, together, _first_rows):
        held_here.add(x)
        for block in [k for k in sums if k != y and k not in held_here]:
            yield left(block)
        for block, of in ((x, held), (y, passing)):
            if block not in sums:
                sums[block] = of, np.zeros((of.n, 2), np.int64)
        for i, j, dots in _hits(passing, held, zero):
            weights = _hundredths(dots)
            if x == y:
                other = i != j
                i, j, weights = i[other], j[other], weights[other]
            for at, of, block, other in ((i, j, y, held), (j, i, x, passing))[:1 if x == y else 2]:
                for k, each in enumerate((other.sizes[of], other.sizes[of] * weights)):
                    # Sums of a tile are whole numbers far below 2^53, so they are exact as doubles.
                    sums[block][1][:, k] += np.bincount(at, each, minlength=len(sums[block][1])).astype(np.int64)
    for block in list(sums):
        yield left(block)


def _added_links(rows: pa.Table) -> pa.Table:
    found = [_from_bytes(data) for data in rows["found"]]
    links, hundredths = (sum(f[c].to_numpy() for f in found) for c in ("links", "hundredths"))
    block = pa.array(np.full(len(links), rows["block"][0].as_py(), np.int32))
    return pa.table({"block": block, "at": found[0]["at"], "links": pa.array(links), "hundredths": pa.array(hundredths)})


def row_links(long: DataFrame, block_rows: int = 1 << 15, block_entries: int = BLOCK_ENTRIES, zero: float = 0.0, digits: int = 9) -> DataFrame:
    """(term, first, size, links, hundredths) of the rows of a long matrix (term, feature, weight): their positive cosines.

    Rows of one direction, to `digits` decimals, are a class: first is the smallest of them and size their number. links
    counts the rows of other classes, copies among them, that a row has a positive cosine with, hundredths adds up these
    cosines, each at two decimals. Classes are multiplied out once, all pairs of them, as in `row_cosine`, over whole
    rows; a task leaves two numbers a row, no pairs. A cosine up to `zero` is none: after a decomposition pass ZERO.
    """
    with shuffles_deleted(long.sparkSession):
        counted = long.agg(F.approx_count_distinct("term").alias("rows"), F.count(F.lit(1)).alias("cells")).first()
    blocks = max(1, math.ceil(counted["rows"] / block_rows), math.ceil(counted["cells"] / block_entries))
    packed = row_blocks(long, blocks, counted["cells"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _marks(batches, digits)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _links(batches, _together(blocks), zero)

    alike = ["_n", "_sum", "_xor"]
    marks = packed.mapInArrow(mark, "term string, _n int, _sum bigint, _xor bigint, block int, at int")
    firsts = stage(marks.groupBy(*alike).agg(F.min(F.struct("term", "block", "at")).alias("first"), F.count(F.lit(1)).alias("size")), "first-rows")
    sizes = stage(
        firsts.select("first.block", "first.at", "size").groupBy("block").applyInArrow(_packed_sizes, "block int, sizes binary"), "class-sizes"
    )
    some = packed.join(F.broadcast(sizes), "block")  # a few bits a row
    partial = met_rows(some, blocks).mapInArrow(multiply, "block int, found binary")
    found = stage(partial.groupBy("block").applyInArrow(_added_links, "block int, at int, links bigint, hundredths bigint"), "row-links")
    classes = firsts.select(*alike, F.col("first.term").alias("first"), F.col("first.block").alias("block"), F.col("first.at").alias("at"), "size")
    linked = classes.join(found, ["block", "at"]).drop("block", "at")
    return marks.select("term", *alike).join(linked, alike).select("term", "first", "size", "links", "hundredths")


ASKED_ENTRIES = 2_000_000  # of asked rows that are sent to all tasks at once


def cosine_with(long: DataFrame, asked: DataFrame) -> DataFrame:
    """Cosine of each asked row with every other row of a long matrix, a < b, where it is not zero.

    ``asked`` is a column of terms, a stated query set. Only its rows meet the others, on the features both
    have, so a feature costs its entries times the asked rows that hold it. The asked rows' entries are written and sent
    to the tasks, in as many rounds as their number asks for: the matrix itself is read where it is, not shuffled or
    written again. Only one number a row and one a pair are.
    """
    rows = long.where("term IS NOT NULL").select(F.col("term").cast("string").alias("term"), "feature", F.col("weight").cast("double").alias("weight"))
    norms = stage(rows.groupBy("term").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm")).where(F.col("_norm") > 0), "row-norms")
    marks = stage(asked.select(F.col("term").cast("string").alias("term")).distinct(), "asked-rows")
    left = stage(rows.join(marks, "term", "left_semi").select("feature", F.col("term").alias("_l"), F.col("weight").alias("_x")), "asked-entries")
    right = rows.select("feature", F.col("term").alias("_r"), F.col("weight").alias("_y"))
    rounds = max(1, math.ceil(left.count() / ASKED_ENTRIES))
    products = []
    for k in range(rounds):
        here = F.pmod(F.hash("feature"), F.lit(rounds)) == k
        met = F.broadcast(left.where(here)).join(right.where(here), "feature").where("_l <> _r")
        sums = met.groupBy("_l", "_r").agg(F.sum(F.col("_x") * F.col("_y")).alias("_dot"))
        products.append(stage(sums, "asked-products") if rounds > 1 else sums)
    dots = reduce(DataFrame.unionByName, products)
    if rounds > 1:
        dots = dots.groupBy("_l", "_r").agg(F.sum("_dot").alias("_dot"))
    twice = marks.select(F.col("term").alias("_r"), F.lit(True).alias("_asked"))
    dots = dots.where("_dot <> 0").join(F.broadcast(twice), "_r", "left").where("_l < _r or _asked is null")
    asked_norms = stage(norms.join(marks, "term", "left_semi"), "asked-norms")
    unit = dots.join(norms.select(F.col("term").alias("_r"), F.col("_norm").alias("_m")), "_r").join(
        asked_norms.select(F.col("term").alias("_l"), F.col("_norm").alias("_n")), "_l"
    )
    return unit.select(F.least("_l", "_r").alias("term_a"), F.greatest("_l", "_r").alias("term_b"), (F.col("_dot") / (F.col("_n") * F.col("_m"))).alias("weight"))


def vectors_to_long(vectors: DataFrame, term: str, values: str) -> DataFrame:
    """Dense rows (id, array of numbers) to long form, zeros left out."""
    return vectors.select(
        F.col(term).alias("term"), F.posexplode(F.col(values).cast("array<double>")).alias("feature", "weight")
    ).where(F.col("weight") != 0)


ZERO = 1e-9  # what is left of an exact zero after a decomposition


def positive_pairs(pairs: DataFrame, zero: float = 0.0) -> DataFrame:
    """Pairs with positive weight at two decimals. After a decomposition pass ZERO, what it leaves of a zero."""
    return pairs.where(F.col("weight") > zero).withColumn("weight", round2(F.col("weight")))


def symmetric(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """Upper triangle to the full matrix: both directions and 1 on the diagonal."""
    flipped = pairs.select(F.col("term_b").alias("term_a"), F.col("term_a").alias("term_b"), "weight")
    diagonal = terms.select(
        F.col("term").alias("term_a"), F.col("term").alias("term_b"), F.lit(1.0).alias("weight")
    )
    return pairs.select("term_a", "term_b", "weight").unionByName(flipped).unionByName(diagonal)


# --- singular value decomposition ------------------------------------------------------------------


def dense_ids(values: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column with ids 0..n-1 in value order.

    The values are range-sorted and written; each file is one range, ranked on its own. Only one count
    per file meets in a single place, where the offsets are summed, so a common prefix costs nothing.
    """
    ordered = stage(values.select(column).distinct().orderBy(column), "ordered-values")
    rows = ordered.select(column, F.col("_metadata.file_path").alias("_file"))
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_size"), F.min(column).alias("_first"))
    before = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_file", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_file").orderBy(column))
    return rows.join(offsets, "_file").select(column, (F.col("_offset") + rank - 1).cast("bigint").alias("id"))


def svd_embedding(long: DataFrame, k: int) -> DataFrame:
    """Rows U * diag(s) of a long matrix (term, doc, weight) as (term, feature, weight).

    Directions with a singular value at or below 1e-9 of the first are dropped. Both the rows' and the columns'
    vectors are tables (see `lowrank`). The term id travels with its row. What rounding leaves of a zero is
    dropped, so a term outside the first ``k`` directions has no entries.
    """
    entries = stage(
        long.select(F.col("term").cast("string").alias("term"), F.col("doc").cast("string").alias("doc"), F.col("weight").cast("double").alias("weight")),
        "svd-entries",
    )
    columns = stage(dense_ids(entries, "doc").withColumnRenamed("id", "j"), "svd-columns")
    terms = stage(dense_ids(entries, "term").withColumnRenamed("id", "i"), "svd-terms")
    cells = stage(
        entries.join(columns, "doc").join(terms, "term").groupBy("i", "j").agg(F.sum("weight").alias("w")), "svd-cells"
    )
    embedded, s = lowrank.scaled_left_vectors(cells, columns.select(F.col("j").alias("id")), k)
    first = float(s[0]) if len(s) else 0.0
    return embedded.join(terms, embedded["id"] == terms["i"]).select(
        "term", F.posexplode("v").alias("feature", "weight")
    ).where(F.abs("weight") > ZERO * first)
