"""Plain versions of the operators, for small tables: whole windows, all pairs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

WORDS = [f"{a}{b}" for a in ("al", "be", "cor", "du", "el", "fi", "go", "ha") for b in ("na", "ti", "ro", "mes", "k", "st")]
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return [w for w in SPACE.split(text or "") if w]


def covered(tokens: dict, length: int) -> dict:
    """Which tokens of each (key, doc_id) row lie in a window that starts in a smaller doc_id."""
    first: dict = {}
    for (_, doc), w in tokens.items():
        for k in range(len(w) - length + 1):
            x = tuple(w[k : k + length])
            first[x] = min(first.get(x, doc), doc)
    out = {}
    for (key, doc), w in tokens.items():
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < doc:
                gone[k : k + length] = [True] * length
        out[key, doc] = gone
    return out


def byte_dedup(docs: list[tuple[int, str | None]], length: int = 50) -> list[tuple]:
    tokens = {(i, d): (t or "").encode() for i, (d, t) in enumerate(docs) if d is not None}
    out = []
    for (i, d), gone in covered(tokens, length).items():
        text = tokens[i, d]
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def word_dedup(docs: list[tuple[int, str | None]], length: int = 13) -> list[tuple]:
    tokens = {(i, d): words(t) for i, (d, t) in enumerate(docs) if d is not None}
    out = []
    for (i, d), gone in covered(tokens, length).items():
        kept = " ".join(w for w, g in zip(tokens[i, d], gone, strict=True) if not g)
        out.append((d, len(gone), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def shingles(text: str | None, size: int = 5) -> set:
    w = words(lower(text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(docs: list[tuple[int, str | None]]) -> list[tuple]:
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least: dict = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(docs)), key=str)


def leaks(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> dict:
    """(doc_id, item_id) -> best similarity of an item-sized window, at 0.75 or more."""
    out = {}
    for d, text in docs:
        w = words(lower(text or ""))
        for item, t in items:
            x = words(lower(t or ""))
            n, size = len(x), min(5, len(x))
            if not x or (n < 5 and len(w) < n):
                continue
            a = Counter(tuple(x[i : i + size]) for i in range(n - size + 1))
            m = min(n, len(w))
            for k in range(len(w) - m + 1):
                b = Counter(tuple(w[k + i : k + i + size]) for i in range(m - size + 1))
                both = sum((a & b).values())
                s = both / (sum(a.values()) + sum(b.values()) - both) if both else 0
                if s >= 0.75 and (n >= 5 or s == 1):
                    out[d, item] = max(s, out.get((d, item), 0))
    return out


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
