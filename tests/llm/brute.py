"""Plain-Python versions of operators that SQL does not express, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def block_anchors(docs: list[tuple], window: int = 13) -> dict:
    """doc_id -> (n_words, n_removed, digest of the kept words); ids must be distinct."""
    first: dict = {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        w = words(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), d)
    out = {}
    for d, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def without_repeats(docs: list[tuple], window: int = 13) -> dict:
    """doc_id -> the text without the words of windows that a smaller doc_id has too; None if no word is left."""
    first: dict = {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        w = words(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), d)
    out = {}
    for d, t in docs:
        w, gone = words(t), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = t if not gone else None if len(gone) == len(w) else " ".join(x for i, x in enumerate(w) if i not in gone)
    return out


def suffix_buckets(docs: list[tuple], length: int = 100) -> dict:
    """doc_id -> (n_bytes, n_removed, n_spans, digest of the kept bytes); ids must be distinct."""
    seen: set = set()
    out = {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i:i + length]
            if s in seen:
                gone[i:i + length] = b"\x01" * length
            else:
                seen.add(s)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(data), sum(gone), spans, sha(kept))
    return out


def near_pairs(docs: list[tuple], size: int = 5, threshold: float = 0.8):
    """(a, b, similarity) of all pairs at the threshold, by exact multiset similarity of all that share a shingle."""
    bags, having = {}, defaultdict(list)
    for d, t in docs:
        w = words(t)
        bags[d] = Counter(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()
        for s in bags[d]:
            having[s].append(d)
    for a, b in {(x, y) for ids in having.values() for x in ids for y in ids if x < y}:
        total = sum((bags[a] | bags[b]).values())
        if total and sum((bags[a] & bags[b]).values()) >= threshold * total:
            yield a, b, sum((bags[a] & bags[b]).values()) / total


def near_classes(docs: list[tuple], size: int = 5, threshold: float = 0.8) -> dict:
    """doc_id -> smallest doc_id of its class."""
    label = {d: d for d, _ in docs}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b, _ in near_pairs(docs, size, threshold):
        x, y = sorted((root(a), root(b)))
        label[y] = x
    return {d: root(d) for d, _ in docs}


def _discounts(counts) -> list[float]:
    n = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
    if min(n) == 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3)]


def kneser_ney(docs: list[tuple]) -> dict:
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = {d: [*words((t or "").translate(lower)), None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in toks}
    uni, pair = Counter(), Counter()
    for d, t in toks.items():
        if not held[d]:
            uni.update(t)
            pair.update(zip([0, *t[:-1]], t))
    total, followers, before = Counter(), defaultdict(list), Counter()
    for (u, w), c in pair.items():
        total[u] += c
        followers[u].append(min(c, 3))
        before[w] += 1
    dp, dw = [0.0, *_discounts(pair.values())], [0.0, *_discounts(before.values())]
    n, v, a = sum(uni.values()), len(uni), sum(before.values())
    left = sum(dw[min(c, 3)] for c in before.values()) / a if a else 1.0
    rest = {u: sum(dp[k] for k in f) for u, f in followers.items()}
    out = {}
    for d, t in toks.items():
        score = 0.0
        for u, w in zip([0, *t[:-1]], t):
            p = left / (v + 1) + ((before[w] - dw[min(before[w], 3)]) / a if before[w] else 0.0)
            if total[u]:
                c = pair[u, w]
                p = ((c - dp[min(c, 3)] if c else 0.0) + rest[u] * p) / total[u]
            score += math.log10(p)
        out[d] = (held[d], len(t), sum(1 for w in t if uni[w]), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t), score)
    return out
