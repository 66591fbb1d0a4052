"""Plain definitions of what the operators must return, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np


class Groups:
    """Union of items; the root of a group is its smallest."""

    def __init__(self, items):
        self.parent = {x: x for x in items}

    def root(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def shingles(text: str | None, n: int = 5) -> frozenset:
    raw = re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def near_groups(docs: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """doc -> (set size, component)."""
    sets = {d: shingles(t) for d, t in docs.items()}
    groups = Groups(docs)
    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                groups.join(a, b)
    return {d: (len(sets[d]), groups.root(d)) for d in docs}


def kept_lines(docs: dict[int, str | None], edits: int = 2, per_edit: int = 20) -> dict[int, tuple[str, int, int]]:
    """doc -> (text that stays, lines removed, of them without an equal line before)."""
    lines = [
        (d, k, line.strip(" \t\r\f\v"))
        for d in sorted(docs)
        for k, line in enumerate((docs[d] or "").split("\n"))
    ]
    long = [x for x in lines if len(x[2]) >= per_edit]
    groups = Groups(range(len(long)))
    for i, (_, _, a) in enumerate(long):
        for j, (_, _, b) in enumerate(long[:i]):
            most = min(edits, min(len(a), len(b)) // per_edit)
            if a == b or (abs(len(a) - len(b)) <= most and edit_distance(a, b) <= most):
                groups.join(i, j)
    gone, near, seen = defaultdict(set), defaultdict(int), set()
    for i, (d, k, line) in enumerate(long):
        if groups.root(i) != i:
            gone[d].add(k)
            near[d] += line not in seen
        seen.add(line)
    return {
        d: ("\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[d]), len(gone[d]), near[d])
        for d, t in docs.items()
    }


def cut_repeats(docs: dict[int, str | None], length: int) -> dict[int, tuple[int, list, str]]:
    """doc -> (bytes, removed spans, sha256 of the rest)."""
    seen, out = set(), {}
    for d in sorted(docs):
        raw = (docs[d] or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for at in range(len(raw) - length + 1):
            if raw[at : at + length] in seen:
                gone[at : at + length] = True
            seen.add(raw[at : at + length])
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(int)))
        spans = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        rest = bytes(c for c, g in zip(raw, gone, strict=False) if not g)
        out[d] = (len(raw), spans, hashlib.sha256(rest).hexdigest())
    return out


def near_vectors(rows: dict[int, list | None], least: float = 0.95) -> dict[int, tuple[int, int]]:
    """vec -> (links, component)."""

    def usable(v):
        return v and None not in v and np.isfinite(v).all() and any(v)

    groups, links = Groups(rows), defaultdict(int)
    ids = sorted(rows)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = rows[a], rows[b]
            if usable(x) and usable(y) and len(x) == len(y):
                u, v = np.array(x) / np.abs(x).max(), np.array(y) / np.abs(y).max()
                if u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= least:
                    groups.join(a, b)
                    links[a] += 1
                    links[b] += 1
    return {d: (links[d], groups.root(d)) for d in rows}
