"""Plain one-machine models of the operators, to compare with."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash


class Union:
    def __init__(self):
        self.parent = {}

    def root(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def near_vectors(rows, cosine=0.98):
    """{vec_id: (links, component)} of (vec_id, embedding, label) with distinct ids."""
    usable = {}
    for i, v, label in rows:
        if v is None or label is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        usable[i] = (label, np.array(v, float) / np.sqrt(np.dot(np.array(v, float), np.array(v, float))))
    union, links = Union(), defaultdict(int)
    groups = defaultdict(list)
    for i, (label, v) in usable.items():
        groups[label, len(v)].append((i, v))
    for members in groups.values():
        m = np.array([v for _, v in members])
        near = m @ m.T >= cosine
        for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            x, y = members[a][0], members[b][0]
            links[x] += 1
            links[y] += 1
            union.join(x, y)
    return {i: (links[i], union.root(i)) for i, _, _ in rows}


def fingerprint(text, size=3):
    raw = (text or "").encode("utf-8")
    words = re.sub(rb"[A-Z]", lambda m: m.group().lower(), raw)
    words = re.findall(rb"[^\x20\x09-\x0D]+", words)
    grams = [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(docs, radius=2):
    """[(fingerprint, component)] for (doc_id, text) rows."""
    prints = [fingerprint(t) for _, t in docs]
    union = Union()
    kinds = sorted(set(prints))
    for i, a in enumerate(kinds):
        union.root(a)
        for b in kinds[:i]:
            if (a ^ b).bit_count() <= radius:
                union.join(a, b)
    low = {}
    for (doc_id, _), p in zip(docs, prints, strict=True):
        r = union.root(p)
        if doc_id is not None:
            low[r] = min(low.get(r, doc_id), doc_id)
    return [(f"{p:016x}", low.get(union.root(p))) for p in prints]


def top_products(rows, every=100, k=10):
    usable = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in usable:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in usable if j != i and len(v) == len(q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def targets(sizes, weights=(1, 2, 3), cap=3):
    """{source: target} from {source: size}, by resharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        found = {s: cap * sizes[s] if s in capped else left * weight[s] / share for s in order}
        over = {s for s in order if s not in capped and found[s] > cap * sizes[s]}
        if not over:
            return found
        capped |= over


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def license_base(text):
    """(n_words, n_base, first, last, base_labels)."""
    low = re.sub(r"[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def personal_data(text):
    text = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m.group() if c.isdigit()]
        double = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))]
        if 16 <= len(d) <= 19 and sum(double) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def token_pieces(tokenizer, text, capacity=2048):
    """[(start, length, crc)] of a text's ids and the closing 0."""
    ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
    first = len(ids) % capacity or capacity
    cuts = [0, *range(first, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
    return [(a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def kneser_ney(texts, order, symbols, begin, end, base):
    """p(symbol, context) of an interpolated modified Kneser-Ney model, from plain dictionaries."""
    counts = [None] * (order + 1)
    counts[order] = defaultdict(int)
    for t in texts:
        s = [begin] * (order - 1) + [symbols[ord(c)] for c in t] + [end]
        for i in range(order - 1, len(s)):
            counts[order][tuple(s[i - order + 1:i + 1])] += 1
    for m in range(order - 1, 0, -1):
        counts[m] = defaultdict(int)
        for g in counts[m + 1]:
            counts[m][g[1:]] += 1
    discounts, contexts = [None] * (order + 1), [None] * (order + 1)
    for m in range(1, order + 1):
        n = [0] + [sum(1 for c in counts[m].values() if c == k) for k in (1, 2, 3, 4)]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        d = []
        for k in (1, 2, 3):
            value = k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0
            d.append(value if 0 < value < k else (0.5, 1.0, 1.5)[k - 1])
        discounts[m] = d
        contexts[m] = defaultdict(lambda: [0, 0.0])
        for g, c in counts[m].items():
            contexts[m][g[:-1]][0] += c
            contexts[m][g[:-1]][1] += d[min(c, 3) - 1]

    def p(g):
        m = len(g)
        if m == 0:
            return base
        lower = p(g[1:])
        if g[:-1] not in contexts[m]:
            return lower
        total, mass = contexts[m][g[:-1]]
        c = counts[m].get(g, 0)
        return (c - discounts[m][min(c, 3) - 1] if c else 0.0) / total + mass / total * lower

    return p


def near_components(docs, size=5, similarity=0.8):
    """The smallest id reachable over texts whose sets of shingles have the similarity, for unique ids."""
    sets = {}
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()
    first, holders, union = {}, {}, Union()
    for doc_id, shingles in sets.items():
        union.join(doc_id, first.setdefault(shingles, doc_id))
    for shingles, doc_id in first.items():
        for other in {o for s in shingles for o in holders.get(s, ())}:
            both = len(shingles & sets[other])
            if both >= similarity * (len(shingles) + len(sets[other]) - both) - 1e-9:
                union.join(doc_id, other)
        for s in shingles:
            holders.setdefault(s, []).append(doc_id)
    lowest = {}
    for doc_id in sorted(sets):
        lowest.setdefault(union.root(doc_id), doc_id)
    return {doc_id: lowest[union.root(doc_id)] for doc_id in sets}
