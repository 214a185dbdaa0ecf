"""Brute-force versions and awkward inputs for the corpus operators."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, _k1 string, kept string, slot int"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioubdgklmnprst") for _ in range(rng.randint(2, 9))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty, blank, short and very long texts, ties, repeated rows, clashing names."""
    base = prose(1, 120)
    texts = [
        base, base, base.replace(" ", "  ", 1), None, "", " \n\t ", "one", "Ünï cödé — ✓ \U0001f600", prose(2, 30_000), base + " more",
        ("ab " * 400).strip(), "x" * 3000, prose(3, 60) + "\n" + prose(3, 60), base,
    ]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), "clash", "k", "no", 7) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], rows[4], (None, base, None, None, None, None, None, None, None), (None,) * 9]
    return rows


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = words(text and re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_components(rows: list[tuple], percent: int = 85) -> list:
    """Smallest reachable id of each (id, text) row, all pairs compared."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[root(i)].append(doc)
    return [
        min((d for d in ids[root(i)] if d is not None), default=None) if sets[i] else rows[i][0] for i in range(len(rows))
    ]


def covered(texts: list[bytes], length: int) -> list[bytearray]:
    """Mask of the bytes in strings of `length` bytes that start more than once."""
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mask[i : i + length] = b"\x01" * length
        out.append(mask)
    return out


def benchmark_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
