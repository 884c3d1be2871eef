"""Packing token sequences: best fit by length, then local search that swaps documents between underfull bins."""

from __future__ import annotations

import re
import sys
import types
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import bounded_batches
from tidemark.session import stage

CAPACITY = 2048
GROUP = 20_000  # items that one task packs; what it leaves underfull meets other groups' in the next round
MEMO = 150_000  # words whose token ids a worker remembers
SHORT = 200  # characters; merging by ranks takes the square of a piece's length
UNSAFE = re.compile(r" \s| $")


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself where printable, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokens:
    """Token ids of texts, as bytes of little-endian 32-bit numbers, with a memory of words.

    The vocabulary's pattern never lets a token reach over a single space that another character follows:
    the space opens the next piece. So a text without runs of white space is cut there, and each piece is
    encoded once. Short pieces are encoded from the file's vocabulary as ranks, which gives the tokenizer's
    ids in a fraction of its time; long ones, and texts with runs of white space, by the tokenizer.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        to_byte = byte_of_symbol()
        ranks = {bytes(map(to_byte.__getitem__, t)): i for t, i in self.tokenizer.get_vocab().items() if t not in special}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.marks = {mark: self._ids(mark) for mark in ".,"}
        self.known: dict[str, bytes] = {}  # by piece without its space
        self.first: dict[str, bytes] = {}  # pieces at the start of a text, which have none

    @classmethod
    def of_process(cls, path: str) -> WordTokens:
        """One for all tasks of a worker process."""
        kept = sys.modules.setdefault("tidemark_worker_state", types.ModuleType("tidemark_worker_state")).__dict__
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _ids(self, piece: str) -> bytes:
        if len(piece) <= SHORT:
            return array("I", self.ranks.encode_ordinary(piece)).tobytes()
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if UNSAFE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head, *words = text.split(" ")
        known = self.known
        if len(known) > MEMO:
            known.clear()
            self.first.clear()
        for w in set(words).difference(known):
            stem, mark = w[:-1], self.marks.get(w[-1:])
            if mark and stem.isalpha():  # the mark is a piece of its own
                ids = known.get(stem)
                if ids is None:
                    ids = known[stem] = self._ids(" " + stem)
                known[w] = ids + mark
            else:
                known[w] = self._ids(" " + w)
        begin = self.first.get(head)
        if begin is None:
            begin = self.first[head] = self._ids(head)
        return begin + b"".join(map(known.__getitem__, words))


def piece_spans(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    ends = [*starts[1:], n]
    return [(a, b - a) for a, b in zip(starts, ends, strict=True)]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32): each text's ids and `end_id`, cut at the capacity.

    `row` tells repeated rows apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens.of_process(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            columns: list[list] = [[], [], [], [], [], []]
            for k, text in enumerate(texts):
                raw = memoryview(tokens.encode(text.as_py() or "") + end)
                for p, (start, length) in enumerate(piece_spans(len(raw) // 4, capacity)):
                    crc = zlib.crc32(raw[4 * start:4 * (start + length)])
                    for column, value in zip(columns, (rows[k], ids[k], p, start, length, crc), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["row", "doc_id", "piece", "start", "length", "ids_crc32"],
            )

    narrow = bounded_batches(docs).select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return narrow.mapInArrow(run, "row bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class Bins:
    """Bins as lists of items, found by how much they hold."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.items: dict[int, list[int]] = {}
        self.fill: dict[int, int] = {}

    def best_fit(self) -> None:
        """Largest first, each into the fullest bin it fits in."""
        by_room: dict[int, list[int]] = defaultdict(list)
        rooms: list[int] = []  # the rooms for which by_room has bins, ascending
        for i in sorted(range(len(self.sizes)), key=lambda i: -self.sizes[i]):
            size = self.sizes[i]
            at = bisect_left(rooms, size)
            if at == len(rooms):
                b, room = len(self.items), self.capacity
                self.items[b], self.fill[b] = [], 0
            else:
                room = rooms[at]
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(at)
            self.items[b].append(i)
            self.fill[b] += size
            if room := room - size:
                if not by_room[room]:
                    insort(rooms, room)
                by_room[room].append(b)

    def local_search(self, most_steps: int) -> None:
        """Empty the least filled bins by moves and swaps that raise the sum of squared fills.

        The least filled bin gives: an item moves to the fullest other underfull bin with room for it, or
        changes places with one smaller item, or with two that are together smaller, of a bin that the
        difference still fits in. Each step takes from the emptier of two bins and fills the fuller, so the
        sum of squares rises and the search ends. A bin that can give nothing more is left as it is.
        """
        order = sorted((f, b) for b, f in self.fill.items() if f < self.capacity)
        steps = 0
        while len(order) > 1 and steps < most_steps:
            _, giver = order.pop(0)
            while self.items[giver] and (step := self._step(giver, order)):
                steps += 1
                if steps >= most_steps:
                    break
                item, taker, back = step
                old = (self.fill[taker], taker)
                order.pop(bisect_left(order, old))
                self._give(giver, taker, [item])
                self._give(taker, giver, back)
                if self.fill[taker] < self.capacity:
                    insort(order, (self.fill[taker], taker))
            if not self.items[giver]:
                del self.items[giver], self.fill[giver]

    def _give(self, a: int, b: int, items: list[int]) -> None:
        for i in items:
            self.items[a].remove(i)
            self.items[b].append(i)
            self.fill[a] -= self.sizes[i]
            self.fill[b] += self.sizes[i]

    def _step(self, giver: int, order: list[tuple[int, int]]) -> tuple[int, int, list[int]] | None:
        own = sorted(self.items[giver], key=lambda i: -self.sizes[i])
        for i in own:
            at = bisect_left(order, (self.capacity - self.sizes[i] + 1, -1)) - 1
            if at >= 0:
                return i, order[at][1], []
        for fill, taker in reversed(order[-64:]):
            room = self.capacity - fill
            theirs = sorted((self.sizes[j], j) for j in self.items[taker])
            values = [s for s, _ in theirs]
            for i in own:
                size = self.sizes[i]
                k = bisect_left(values, size - room)  # smallest that leaves enough room
                if k < len(values) and values[k] < size:
                    return i, taker, [theirs[k][1]]
                lo, hi = 0, len(values) - 1
                while lo < hi:
                    two = values[lo] + values[hi]
                    if two >= size:
                        hi -= 1
                    elif two < size - room:
                        lo += 1
                    else:
                        return i, taker, [theirs[lo][1], theirs[hi][1]]
        return None


def pack_group(sizes: list[int], capacity: int) -> list[list[int]]:
    bins = Bins(sizes, capacity)
    bins.best_fit()
    bins.local_search(4 * len(sizes) + 100)
    return list(bins.items.values())


def group_packer(capacity: int, turn: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The function that packs one group of (g, row, piece, length)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "row", "piece"], ascending=False).reset_index(drop=True)
        sizes = frame["length"].tolist()
        at, number, offset, filled = [], [], [], []
        for b, items in enumerate(pack_group(sizes, capacity)):
            begin = 0
            for i in items:
                at.append(i)
                number.append(b)
                offset.append(begin)
                begin += sizes[i]
            filled += [begin] * len(items)
        out = frame.iloc[at].reset_index(drop=True)
        out["bin"] = [f"{turn}:{g}:{b}" for g, b in zip(out["g"], number, strict=True)]
        out["offset"] = np.array(offset, np.int64)
        out["filled"] = np.array(filled, np.int64)
        return out[["row", "piece", "length", "bin", "offset", "filled"]]

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = 2) -> DataFrame:
    """Adds sequence_id and offset to pieces (row, piece, length ≤ capacity and > 0).

    Full pieces are sequences of their own. The others are dealt by a hash into groups of about `group`
    items; a task packs a group, then the items of the bins it left underfull are dealt anew among fewer
    groups, `rounds` times. Grouping is by (row, piece), so no source or repeated text gathers in one group.
    """
    full = pieces.where(F.col("length") >= capacity).select(
        "row", "piece", F.concat_ws(":", F.lit("f"), "row", "piece").alias("bin"), F.lit(0).cast("bigint").alias("offset")
    )
    rest = pieces.where(F.col("length") < capacity).select("row", "piece", "length")
    done = full
    for k in range(rounds):
        n = rest.count()
        groups = max(1, -(-n // group))
        last = k == rounds - 1 or groups == 1

        dealt = rest.withColumn("g", F.pmod(F.xxhash64("row", "piece", F.lit(k)), F.lit(groups)).cast("int"))
        packed = dealt.groupBy("g").applyInPandas(group_packer(capacity, k), "row bigint, piece int, length bigint, bin string, offset bigint, filled bigint")
        packed = stage(packed, "packed")
        if last:
            done = done.unionByName(packed.select("row", "piece", "bin", "offset"))
            break
        done = done.unionByName(packed.where(F.col("filled") == capacity).select("row", "piece", "bin", "offset"))
        rest = packed.where(F.col("filled") < capacity).select("row", "piece", "length")
    return done.withColumn("sequence_id", F.xxhash64("bin")).drop("bin")


def packed_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every row, packed.

    A null or empty text is its closing id alone. Repeated rows are packed each; a null doc_id stays null.
    Other columns of `docs` are not read. No rows in, no rows out.
    """
    pieces = stage(token_pieces(docs, tokenizer_path, capacity), "pieces")
    placed = pack(pieces.select("row", "piece", "length"), capacity, group)
    return pieces.join(placed, ["row", "piece"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
