"""Merkle manifest, decontamination and collocations against plain models, on odd rows and in small blocks."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import collocations, decontamination, merkle

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHES = "row string, window int, words string, unit int, pos string, block int, n string, w1 string, id int, hash string, level int"
DOC = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHES}"
EXTRA = ("a", 1, "b", 2, "c", 3, "d", "e", 4, "f", 5)
LONG = "the quick brown Fox. " * 50_000
GLUED = "x" * 3_000_000
RNG = random.Random(7)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rows_with_oddities():
    rows = [
        (1, "", "en", "a", 0), (2, None, "en", "a", None), (None, "A tail of one", None, None, 3), (None, "A tail of one", None, None, 3),
        (None, "Another", None, "s", 4), (3, " \t\n ", "fr", "b", 4), (4, "Same text HERE", "en", "b", 14), (4, "Same text HERE", "en", "b", 14),
        (4, "Other text", "en", "b", 10), (6, LONG, "en", "a", len(LONG)), (7, GLUED, "en", "a", 1), (9, "été \U0001F600 ÜNDER", "xx", None, 9),
        (11, "Fox-trot, THE quick; the quick", "", "q", 5),
    ]
    rows += [(100 + i, f"Text {i % 7} of MANY words", "de" if i % 3 else "und", f"s{i % 4}", i) for i in range(150)]
    rows += [(1000 + i, "one only", f"l{i:03}", "s", i) for i in range(70)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows_with_oddities()], DOC)


def plain(table):
    return [tuple(r) for r in table.select("doc_id", "text", "lang", "source", "n_chars").collect()]


# --- Merkle manifest -------------------------------------------------------------------------------


def brute_leaf(row, text):
    fields = (row[0], row[3], row[2], row[4], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i:i + 8])) for i in range(0, len(last), 8)])
    return levels


def brute_path(levels, at):
    path = []
    for nodes in levels[:-1]:
        run = at - at % 8
        path.append((nodes[run:at], nodes[at + 1:run + 8]))
        at //= 8
    return path


def brute_manifest(rows):
    groups = defaultdict(list)
    for row in rows:
        tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
        text = row[1].translate(ASCII) if tampered and row[1] is not None else row[1]
        groups[row[2]].append(((row[0] is not None, row[0] or 0, brute_leaf(row, row[1])), row[0], brute_leaf(row, text)))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort()
        trees[lang] = brute_tree([key[2] for key, _, _ in groups[lang]])
    top = brute_tree([trees[lang][-1][0] for lang in langs])
    out = Counter()
    for unit, lang in enumerate(langs):
        for at, (key, doc_id, touched) in enumerate(groups[lang]):
            path = brute_path(trees[lang], at) + brute_path(top, unit)
            node = touched
            for before, after in path:
                node = sha("".join(before) + node + "".join(after))
            proof = sha("".join("".join(b) + "".join(a) for b, a in path))
            out[(doc_id, key[2], trees[lang][-1][0], top[-1][0], proof, node, node == top[-1][0])] += 1
    return out


@pytest.mark.parametrize("levels", [1, 4])
def test_manifest(odd, levels):
    """With blocks of 8 leaves the largest lang takes two rounds with a short last group; 75 langs take three."""
    got = Counter(tuple(r) for r in merkle.manifest(odd, levels).collect())
    assert got == brute_manifest(plain(odd))
    assert {key[-1] for key in got} == {True, False}


def test_manifest_of_many_blocks(spark):
    """700 leaves of one lang are 88 blocks of 8: three rounds, whose last groups lack members."""
    rows = [(i, f"Text {i}", "en", None, i, *EXTRA) for i in range(700)]
    table = spark.createDataFrame(rows, DOC).repartition(5)
    assert Counter(tuple(r) for r in merkle.manifest(table, 1).collect()) == brute_manifest([r[:5] for r in rows])


def test_manifest_of_nothing_and_of_one(spark, odd):
    assert merkle.manifest(odd.where("false")).collect() == []
    alone = odd.where("doc_id = 9")
    row = merkle.manifest(alone).collect()[0]
    assert row["root"] == row["subroot"] == row["leaf"] and row["proof_sha256"] == sha("")


def test_manifest_does_not_depend_on_partitions(odd):
    few, many = merkle.manifest(odd.coalesce(1), 2), merkle.manifest(odd.repartition(13), 2)
    assert Counter(tuple(r) for r in few.collect()) == Counter(tuple(r) for r in many.collect())


# --- decontamination -------------------------------------------------------------------------------

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_list(text):
    return WORDS.findall((text or "").translate(ASCII))


def brute_leaks(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        words = word_list(text)
        for i in range(max(len(words) - size, 0) + 1 if words else 0):
            windows[tuple(words[i:i + size])].add(item)
    lengths = {len(w) for w in windows}
    out = Counter()
    for doc_id, text in docs:
        words, hit, found = word_list(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                owners = windows.get(tuple(words[i:i + n]))
                if owners:
                    hit.update(range(i, i + n))
                    found |= owners
        names = sorted(str(f) for f in found if f is not None)
        out[(doc_id, len(words), len(hit), len(names), sha(",".join(names)), bool(hit))] += 1
    return out


def leak_tables(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25)))) for i in range(40)]
    items += [(100, " ".join(passage)), (101, " ".join(passage[5:30])), (101, "one only"), (102, None), (103, ""), (None, " ".join(passage[20:36]))]
    items += [(104, "a a a a a a a a a a a a"), (105, "Été"), (9, "solo"), (10, "w1 w2")]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    docs += [(1000 + i, " ".join([f"x{i}", *passage[i % 25:i % 25 + rng.randint(8, 15)], "End."])) for i in range(60)]
    docs += [(2000, None), (2001, ""), (None, " ".join(passage)), (None, " ".join(passage)), (2002, "a " * 40), (2003, "ÉTÉ été, Été! SOLO"),
             (2004, "-".join(passage).upper()), (2005, LONG), (2006, GLUED), (2007, " ".join(passage[:9]))]
    return (
        spark.createDataFrame([(d, t, "en", "s", 1, *EXTRA) for d, t in docs], DOC).repartition(6), docs,
        spark.createDataFrame([(i, t, *EXTRA) for i, t in items], f"item_id bigint, text string, {CLASHES}"), items,
    )


@pytest.mark.parametrize("most_sent", [0, decontamination.SENT])
def test_contaminated(spark, most_sent):
    """The way that sends the prefixes and the one that shuffles them both agree with the plain model."""
    table, docs, benchmark, items = leak_tables(spark)
    got = Counter(tuple(r) for r in decontamination.contaminated(table, benchmark, most_sent=most_sent).collect())
    assert got == brute_leaks(docs, items)


def test_contaminated_without_rows_or_items(spark):
    table, docs, benchmark, _ = leak_tables(spark)
    assert decontamination.contaminated(table.where("false"), benchmark).collect() == []
    clean = decontamination.contaminated(table, benchmark.where("false"))
    assert Counter(tuple(r) for r in clean.collect()) == brute_leaks(docs, [])


def test_prefix_is_the_rarest_shingle(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c"), (3, "a b c d")], "row int, text string")
    documents = docs.select(decontamination.words_of(docs["text"]).alias("words"))
    windows = spark.createDataFrame([(0, "a b c d e f".split()), (1, "a b c x".split())], "window bigint, words array<string>")
    prefixes = decontamination._rarest(documents, windows, 3, True).collect()
    assert [(r["window"], r["at"]) for r in prefixes] == [(0, 2)]  # window 1 holds a shingle that no document has


# --- collocations ----------------------------------------------------------------------------------


def brute_phrases(rows, least, best, scale=2_000_000, cover=(80, 100)):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i:i + n])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        dropped = set()
        for g, a in candidates.items():
            for size in range(2, len(g)):
                for i in range(len(g) - size + 1):
                    inner = g[i:i + size]
                    if cover[1] * a >= cover[0] * candidates[inner]:
                        dropped.add(inner)
        scored = []
        for g, a in candidates.items():
            if g in dropped:
                continue
            score, k = min((scale * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def phrase_rows():
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(12)] + ["é", "zß", "\U0001F600"]
    rows = []
    for i in range(300):
        words = [rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",\n", "!"]) for _ in range(rng.randint(0, 40))]
        if i % 2:
            words += ["Four", "words", "stand", "together", "always;"]
        rows.append((rng.choice(["en", "fr", None, "und"]), rng.choice([" ", "\t", "  "]).join(words)))
    return rows + [("en", None), (None, ""), ("en", "the quick brown Fox. " * 3000), ("en", GLUED), ("en", "a.b.c,a.b.c " * 50), ("", "x y " * 20)]


@pytest.mark.parametrize(("least", "best"), [(30, 2000), (3, 25)])
def test_collocations(spark, least, best):
    rows = phrase_rows()
    table = spark.createDataFrame([(i, t, lang, "s", 1, *EXTRA) for i, (lang, t) in enumerate(rows)], DOC).repartition(7)
    got = sorted(tuple(r) for r in collocations.collocations(table, least, best).collect())
    assert got == brute_phrases(rows, least, best) and got


def test_collocations_with_small_chunks_and_full_bitmaps(spark, monkeypatch):
    """Chunks of a few words and bitmaps too small to tell words apart change nothing."""
    rows = phrase_rows()
    table = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    monkeypatch.setattr(collocations, "MOST_BITS", 1 << collocations.PART)
    monkeypatch.setattr(collocations, "CHUNK", 50)
    got = sorted(tuple(r) for r in collocations.collocations(table, 10, 100).collect())
    assert got == brute_phrases(rows, 10, 100)


@pytest.mark.parametrize(("grams", "sizes"), [(collocations.pair_grams, (2,)), (collocations.long_grams, (3, 4))])
def test_a_chunk_is_counted_in_little_memory(grams, sizes, monkeypatch):
    """Columns of grams are made for a batch at a time: an executor's workers share its memory."""
    monkeypatch.setattr(collocations, "SENT", 1000)
    ids = np.random.default_rng(5).integers(0, 90, 200_000)
    tracemalloc.start()
    counted, rows = Counter(), []
    for batch in collocations.counted_grams(ids, grams, np.full(1 << 12, 255, np.uint8)):
        rows.append(batch.num_rows)
        most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80 * len(ids) and max(rows) == 1000  # a row of the batch alone has 40 bytes
    for batch in collocations.counted_grams(ids, grams, np.full(1 << 12, 255, np.uint8)):
        for *words, n in zip(*[column.to_pylist() for column in batch.columns], strict=True):
            counted[tuple(words)] += n
    want = Counter()
    for size in sizes:
        runs = np.lib.stride_tricks.sliding_window_view(ids, size)
        want.update((*run, *[0] * (4 - size)) for run in runs[(runs != 0).all(axis=1)].tolist())
    assert counted == want


def test_collocations_of_nothing(spark, odd):
    assert collocations.collocations(odd.where("false")).collect() == []
    assert collocations.collocations(odd.where("lang = 'xx'")).collect() == []


def test_collocations_exact_beyond_64_bits(spark):
    grams = spark.createDataFrame(
        [(1, 2, 0, 0, 9 * 10**17, 2, [9 * 10**17 + 1], [9 * 10**17], 0), (1, 3, 0, 0, 10**18, 2, [10**18], [10**18], 8 * 10**17)],
        "w1 bigint, w2 bigint, w3 bigint, w4 bigint, n bigint, size int, lefts array<bigint>, rights array<bigint>, longer bigint",
    )
    got = collocations._scored(grams, 2_000_000, (80, 100)).collect()
    assert [(r["a"], r["score"]) for r in got] == [(9 * 10**17, 2_000_000 * 9 * 10**17 // (18 * 10**17 + 1))]
