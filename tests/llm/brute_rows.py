"""Plain versions of the operators on conversations, embeddings and pages."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    """(conv_id, turn, role, text) rows after the damage of the contract."""
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, lines): dynamic programming from the back over (cost, audit); rows are (role, text, fault)."""
    best = {(len(rows), q): c for q, c in enumerate([(0, "", ()), (6, "II", ("user:", "assistant:")), (3, "I", ("assistant:",)), (0, "", ())])}

    def after(q, first):
        return {"s": 1 if q == 0 else None, "u": None if q == 2 else 2, "a": 3 if q == 2 else None}.get(first)

    for i in range(len(rows) - 1, -1, -1):
        role, text, fault = rows[i]
        here = {}
        for q in range(4):
            new, name = (3, "assistant") if q == 2 else (2, "user")
            c, a, lines = best[i + 1, q]
            ways = [(c + 4, "D" + a, lines)]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if (to := after(q, role[:1])) is not None:
                    c, a, lines = best[i + 1, to]
                    ways.append((c + more, "K" + a, (f"{role}:{text}", *lines)))
                c, a, lines = best[i + 1, new]
                ways.append((c + 3 + more, "R" + a, (f"{name}:{text}", *lines)))
            here[q] = min(ways)
        for _ in range(4):  # inserts, until nothing gets cheaper
            for q in range(4):
                new, name = (3, "assistant") if q == 2 else (2, "user")
                c, a, lines = here[new]
                here[q] = min(here[q], (c + 3, "I" + a, (name + ":", *lines)), key=lambda x: x[:2])
        best |= {(i, q): v for q, v in here.items()}
    return best[0, 0]


def repaired(rows):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)} of rows that are already damaged."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in by.items():
        own.sort()
        seen, marked, n = set(), [], defaultdict(int)
        for _, _, role, text in own:
            words = WORD.findall(text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            marked.append((role, text, fault))
        turns = [t for known, t, *_ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = cheapest(marked)
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def op11(rows):
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    return {conv: none for conv, *_ in rows} | repaired(damaged(rows))


def whitened(rows, k=16):
    """({(vec_id, component): (n, deviation, whitened, explained)}, identity error) by numpy's own eigenvectors."""
    fine = [(i, [math.floor(64 * float(c)) + 1000000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in fine}))
    n, total = len(fit), fit.sum(axis=0)
    mean = total / n
    y = fit - mean
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in fine:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(x, total))
        w = (np.array(x) - mean) @ vectors[:, :k] / np.sqrt(values[:k])
        for c in range(min(k, len(values))):
            out[i, c + 1] = (n, deviation, w[c], values[c] / values.sum())
    return out


def warc(rows):
    """Sorted (page_id, bytes, digest, type, refers_to) of (page_id, html) rows."""
    last = {}
    for i, html in rows:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", i))
    out = []
    for i, html in rows:
        data, keep = (html or "").encode(), last.get(html or "")
        refers = keep if keep is not None and (i is None or i < keep) else None
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)
