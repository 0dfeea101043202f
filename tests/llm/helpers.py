"""Small fixtures with every awkward case, and plain-Python versions."""

from __future__ import annotations

import collections
import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def awkward_docs(seed: int = 0, n: int = 60) -> list[tuple]:
    """Near and exact copies, shared passages, nulls, empty and white texts, a
    very long text and a very long word, repeated rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]

    def text(k):
        return " ".join(rng.choice(vocab) for _ in range(k))
    passage = text(50)
    rows: list[tuple] = []
    for k in range(n):
        t = text(rng.choice([3, 12, 40, 90]))
        if k % 5 == 1:
            t = text(8) + "\n" + passage + "\t" + text(8)
        if k % 5 == 2 and rows:
            w = (rows[rng.randrange(len(rows))][1] or "x").split()
            w[rng.randrange(len(w))] = "edited"
            t = "  ".join(w).upper()
        if k % 11 == 3 and rows:
            t = rows[rng.randrange(len(rows))][1]
        rows.append((k, t, rng.choice(["en", "de", None]), "s", len(t or "")))
    rows += [(100, None, "en", None, None), (101, "", None, "s", 0), (102, " \n\t ", "en", "s", 4),
             (103, text(9000), "de", "s", None), (104, "w" * 5000 + " tail", "en", "s", 5005),
             (105, "one", "en", "s", 3), (106, "One", "en", "s", 3), (107, "a a a a a a a", "en", "s", 13)]
    rows += [rows[1], rows[1], (None, rows[4][1], "en", "s", 1)]
    return rows


def components(sets: dict, share: int = 80) -> dict:
    """Smallest key reachable, by comparing every pair."""
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def repeats_removed(texts: list, width: int) -> list[tuple[int, int, bytes]]:
    """(words, removed, kept) of every text, by counting every window."""
    split = [words(t) for t in texts]
    seen = collections.Counter(tuple(w[i:i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        keep = [True] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                keep[i:i + width] = [False] * width
        kept = b" ".join(x for x, k in zip(w, keep) if k)
        out.append((len(w), len(w) - sum(keep), kept))
    return out
