"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The field scores whole candidate segments (up to `TOKENS` tokens and `CHARS` characters, with a digit or an
at sign in them) by features of the whole span: counts of digits and digit runs, checksums, shape, what
stands to the left and right. A dynamic program over boundaries chooses the best set of segments and their
types at once. Text without a digit or an at sign nearby can hold no segment, so the program runs on the
windows around those; this is exact, and linear in the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import bounded_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "key")
TOKENS, CHARS = 16, 64
SAMPLE_DOCS = 4000  # documents (by smallest hash of their id) among which windows for training are looked for
SAMPLE_WINDOWS = 400  # windows the field is trained on
EPOCHS, RATE, SHRINK = 12, 0.3, 1e-4

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Seeds from which the field learns access keys.
KEYS = re.compile(r"\bAKIA[0-9A-Z]{16}\b|(?<=\")[0-9a-f]{32,64}(?=\")")
TRIGGER = re.compile(r"[0-9@]+")
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
RUN = re.compile(r"[0-9]+")
LETTERS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their at signs so that long runs of letters are passed over once."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            floor = found.end()
        at = text.find("@", max(at + 1, floor))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Four numbers joined by dots; of a longer chain, each four in turn."""
    out = []
    for chain in CHAIN.finditer(text):
        if chain.group().count(".") < 3:
            continue
        runs = [m.span() for m in RUN.finditer(text, chain.start(), chain.end())]
        for k in range(0, len(runs) - 3, 4):
            if all(_small(text[a:b]) for a, b in runs[k:k + 4]):
                out.append((runs[k][0], runs[k + 3][1]))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then place."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not RUN.search(text):
        return out
    out += [("ip", a, b) for a, b in addresses(text)]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    return out


def windows(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) around all digits and at signs, joined where they meet, cut at line ends."""
    begin = end = -1
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - CHARS), min(len(text), m.end() + CHARS)
        a = max(a, text.rfind("\n", a, m.start()) + 1)
        stop = text.find("\n", m.end(), b)
        b = stop if stop >= 0 else b
        if a <= end:
            end = max(end, b)
        else:
            if end >= 0:
                yield begin, end
            begin, end = a, b
    if end >= 0:
        yield begin, end


def _kind_of(c: str) -> str:
    return "^" if not c else "9" if c in "0123456789" else "a" if c.isalpha() else "_" if c.isspace() else c


def candidates(text: str) -> list[tuple[int, int]]:
    """Segments of a window that the field may choose, in tokens that start and end at word borders."""
    tokens = [m.span() for m in TOKEN.finditer(text)]
    kinds = [_kind_of(text[a]) for a, _ in tokens]
    out = []
    for i, kind in enumerate(kinds):
        if kind not in "9a+(" or (i and kind in "9a" and kinds[i - 1] in "9a"):
            continue
        begin, trigger, space, letter = tokens[i][0], False, False, False
        for j in range(i, min(len(tokens), i + TOKENS)):
            a, b = tokens[j]
            k = kinds[j]
            if b - begin > CHARS or (k == "_" and text[a:b] != " "):
                break
            trigger |= k in "9@"
            space |= k == "_"
            letter |= k in "a@"
            if space and letter:
                break
            if trigger and k in "9a" and not (j + 1 < len(kinds) and kinds[j + 1] in "9a"):
                out.append((begin, b))
    return out


def features(text: str, a: int, b: int) -> list[str]:
    """Features of the whole span text[a:b] and of its two neighbours."""
    s = text[a:b]
    runs = RUN.findall(s)
    digits = "".join(runs)
    n, dots, dashes = len(digits), s.count("."), s.count("-")
    letters = "".join(LETTERS.findall(s))
    case = "none" if not letters else "upper" if letters.isupper() else "lower" if letters.islower() else "mixed"
    shape = LETTERS.sub("a", RUN.sub("9", s)) if len(s) <= 24 or not letters else "long"
    out = [
        "bias", f"digits={min(n, 20)}", f"runs={min(len(runs), 8)}", f"dots={min(dots, 4)}", f"dashes={min(dashes, 4)}",
        f"spaces={min(s.count(' '), 5)}", f"letters={case}", f"length={min(len(s) // 4, 12)}", f"shape={shape}",
        f"left={_kind_of(text[a - 1:a])}", f"right={_kind_of(text[b:b + 1])}", f"first={_kind_of(s[:1])}", f"last={_kind_of(s[-1:])}",
        f"at={s.count('@')}", f"lengths={'-'.join(str(min(len(r), 9)) for r in runs[:6])}" if not letters else "words",
    ]
    if 13 <= n <= 19 and not letters:
        out.append(f"luhn={luhn(digits)}")
    if len(runs) == 4 and dots == 3:
        out.append(f"octets={all(map(_small, runs))}")
    if "@" in s:
        head, _, tail = s.rpartition("@")
        out += [f"name={bool(head) and all(c in LOCAL for c in head)}", f"domain={bool(DOMAIN.fullmatch(tail))}"]
    if letters and n and len(s) >= 16 and s.isalnum():
        out.append(f"hex={all(c in '0123456789abcdef' for c in s)}")
    return out


class Lattice:
    """The candidate segments of a window and their features."""

    def __init__(self, text: str) -> None:
        self.segments = candidates(text)
        self.features = [features(text, a, b) for a, b in self.segments]
        borders = sorted({x for s in self.segments for x in s} | {0, len(text)})
        self.at = {x: i for i, x in enumerate(borders)}
        self.ends = [(self.at[a], self.at[b]) for a, b in self.segments]


class SemiMarkov:
    """Weights of features for each kind; a segment's score is the sum of its features' weights."""

    def __init__(self, weights: dict[str, list[float]] | None = None) -> None:
        self.weights = weights or {}

    def scores(self, lattice: Lattice) -> list[list[float]]:
        zero, get, n = [0.0] * len(KINDS), self.weights.get, range(len(KINDS))
        out = []
        for names in lattice.features:
            rows = [get(name, zero) for name in names]
            out.append([sum(row[k] for row in rows) for k in n])
        return out

    def best(self, lattice: Lattice) -> list[tuple[str, int, int]]:
        """The segments and kinds of the highest total, none being 0."""
        n = len(lattice.at)
        ending: list[list[int]] = [[] for _ in range(n)]
        for s, (_, j) in enumerate(lattice.ends):
            ending[j].append(s)
        scores = self.scores(lattice)
        value, back = [0.0] * n, [(-1, -1)] * n
        for j in range(1, n):
            value[j] = value[j - 1]
            for s in ending[j]:
                k = max(range(len(KINDS)), key=scores[s].__getitem__)
                total = value[lattice.ends[s][0]] + scores[s][k]
                if total > value[j]:
                    value[j], back[j] = total, (s, k)
        out, j = [], n - 1
        while j > 0:
            s, k = back[j]
            if s < 0:
                j -= 1
            else:
                out.append((KINDS[k], *lattice.segments[s]))
                j = lattice.ends[s][0]
        return out[::-1]

    def _step(self, lattice: Lattice, gold: dict[tuple[int, int], int], rate: float) -> None:
        """One step up the log-likelihood of the right segmentation: right less expected features."""
        n, scores = len(lattice.at), self.scores(lattice)
        ending: list[list[int]] = [[] for _ in range(n)]
        for s, (_, j) in enumerate(lattice.ends):
            ending[j].append(s)
        # All kinds of a segment, summed.
        mass = []
        for row in scores:
            top = max(row)
            mass.append(top + math.log(sum(math.exp(x - top) for x in row)))

        def add(x: float, y: float) -> float:
            hi, lo = (x, y) if x > y else (y, x)
            return hi + math.log1p(math.exp(lo - hi)) if lo > -1e300 else hi

        fore, aft = [0.0] * n, [-math.inf] * n
        for j in range(1, n):
            fore[j] = fore[j - 1]
            for s in ending[j]:
                fore[j] = add(fore[j], fore[lattice.ends[s][0]] + mass[s])
        aft[n - 1] = 0.0
        for j in range(n - 1, 0, -1):
            aft[j - 1] = add(aft[j - 1], aft[j]) if aft[j - 1] > -math.inf else aft[j]
            for s in ending[j]:
                i = lattice.ends[s][0]
                aft[i] = add(aft[i], aft[j] + mass[s]) if aft[i] > -math.inf else aft[j] + mass[s]
        for s, (i, j) in enumerate(lattice.ends):
            right = gold.get(lattice.segments[s], -1)
            off = [(k == right) - math.exp(min(0.0, fore[i] + scores[s][k] + aft[j] - fore[n - 1])) for k in range(len(KINDS))]
            if max(map(abs, off)) < 1e-3:
                continue
            for name in lattice.features[s]:
                row = self.weights.setdefault(name, [0.0] * len(KINDS))
                for k, x in enumerate(off):
                    row[k] += rate * (x - SHRINK * row[k])

    def train(self, examples: list[tuple[str, list[tuple[str, int, int]]]]) -> SemiMarkov:
        """examples: (window, its right spans); spans that are no candidate segment are left out."""
        ready = []
        for text, spans in examples:
            lattice = Lattice(text)
            there = set(lattice.segments)
            ready.append((lattice, {(a, b): KINDS.index(kind) for kind, a, b in spans if (a, b) in there}))
        for epoch in range(EPOCHS):
            for lattice, gold in ready:
                self._step(lattice, gold, RATE / (1 + epoch))
        return self


def weak_spans(text: str) -> list[tuple[str, int, int]]:
    """What a window is trained to: the fixed patterns and the key seeds, where they don't overlap."""
    found, out = base_spans(text) + [("key", *m.span()) for m in KEYS.finditer(text)], []
    for kind, a, b in sorted(found, key=lambda x: x[1] - x[2]):
        if all(b <= c or d <= a for _, c, d in out):
            out.append((kind, a, b))
    return out


def variants(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The window, and what it teaches besides.

    A phone number is one without its plus sign and country code, too. A card number with its last digit
    changed, or an address with a part of 999, isn't one.
    """
    out = [(text, spans)]
    for kind, a, b in spans:
        others = [s for s in spans if s[1] != a]
        cut = text.find("(", a, b) if kind == "phone" else -1
        if cut > a:
            by = cut - a
            moved = [(k, c, d) if d <= a else (k, c - by * (c > a), d - by) for k, c, d in spans]
            out.append((text[:a] + text[cut:], moved))
        elif kind == "card":
            out.append((text[:b - 1] + str((int(text[b - 1]) + 1) % 10) + text[b:], others))
        elif kind == "ip":
            part = RUN.search(text, a, b)
            by = 3 - (part.end() - part.start())
            moved = [(k, c, d) if d <= a else (k, c + by, d + by) for k, c, d in others]
            out.append((text[:a] + "999" + text[part.end():], moved))
    return out


def _examples(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, found = [], []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, (a, b) in enumerate(windows(text or "")):
                    if n == 4 or b - a > 40 * CHARS:
                        break
                    order.append(h)
                    found.append(text[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(found, pa.string())], ["h", "window"])

    return bounded_batches(docs).mapInArrow(run, "h bigint, window string")


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> SemiMarkov:
    """The field, trained on a bounded sample: windows of the `sample_docs` documents with the smallest hash of their id.

    Its labels are the fixed patterns' spans and the key seeds. The sample is the same at every run.
    """
    h = F.xxhash64(F.lit("pii"), "doc_id")
    ids = docs.select(h.alias("h")).distinct().orderBy("h").limit(sample_docs)
    limit = ids.agg(F.max("h")).collect()[0][0]
    if limit is None:
        return SemiMarkov()
    chosen = docs.select(h.alias("h"), F.col("text").cast("string").alias("text")).where(F.col("h") <= limit)
    rows = _examples(chosen).orderBy("h", "window").limit(sample_windows).collect()
    examples = [e for r in rows for e in variants(r["window"], weak_spans(r["window"]))]
    return SemiMarkov().train(examples)


def spans_of(text: str, field: SemiMarkov, memo: dict[str, list] | None = None) -> tuple[list, list]:
    """(base spans, all spans): all are the base ones and those of the field that overlap none of them."""
    base = base_spans(text)
    extra = []
    for a, b in windows(text):
        part = text[a:b]
        got = memo.get(part) if memo is not None else None
        if got is None:
            got = field.best(Lattice(part))
            if memo is not None:
                if len(memo) > 20_000:
                    memo.clear()
                memo[part] = got
        extra += [(kind, a + x, a + y) for kind, x, y in got]
    if extra and base:
        taken = sorted((x, y) for _, x, y in base)
        kept, i = [], 0
        reach = 0
        for kind, x, y in extra:  # in order of place
            while i < len(taken) and taken[i][0] < y:
                reach = max(reach, taken[i][1])
                i += 1
            if reach <= x:
                kept.append((kind, x, y))
        extra = kept
    order = {kind: i for i, kind in enumerate(KINDS)}
    return base, sorted(base + extra, key=lambda s: (order[s[0]], s[1]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def find_personal_data(docs: DataFrame, field: SemiMarkov | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of docs (doc_id, text).

    Counts and base_sha256 are those of the fixed patterns; spans has them and what the field adds.
    Places are code points from 0. Null and empty texts have no spans. Repeated rows are searched each; a
    null doc_id stays null. Other columns of docs are not read. No rows in, no rows out.
    """
    field = field or train(docs)
    weights = docs.sparkSession.sparkContext.broadcast(field.weights)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = SemiMarkov(weights.value), {}
        for batch in batches:
            counts: list[list[int]] = [[] for _ in BASE]
            digests, spans = [], []
            for text in batch.column(1):
                base, every = spans_of(text.as_py() or "", model, memo)
                for column, kind in zip(counts, BASE, strict=True):
                    column.append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", *[f"n_{kind}" for kind in BASE], "base_sha256", "spans"],
            )

    narrow = bounded_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(
        run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    )


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def masked(docs: DataFrame, field: SemiMarkov | None = None, length_column: str | None = None) -> DataFrame:
    """docs with personal data of `text` masked, and `length_column` set to its new number of characters.

    A null text stays null; all other columns and rows are as they were.
    """
    field = field or train(docs)
    weights = docs.sparkSession.sparkContext.broadcast(field.weights)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = SemiMarkov(weights.value), {}
        for batch in batches:
            texts = [None if t is None else mask(t, spans_of(t, model, memo)[1]) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    out = bounded_batches(docs).mapInArrow(run, docs.schema)
    return out.withColumn(length_column, F.length("text").cast(docs.schema[length_column].dataType)) if length_column else out
