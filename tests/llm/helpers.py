"""Small tables with every odd case, and brute-force versions."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, words string, n long, version long"


def odd_rows(seed: int = 1) -> list[tuple]:
    """Nulls in any column, empty and long texts, copies, repeated rows, rows with equal ids, columns whose names operators use inside."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma,", "delta.", "épsilon", "zeta!", "eta", "theta;", "iota", "kappa?"]

    def text(n: int) -> str:
        return " ".join(rng.choice(words) + str(rng.randrange(40)) * rng.randrange(2) for _ in range(n))

    base = text(90)
    rows = [(k, text(rng.randrange(1, 120)).replace(" eta ", "\n"), "en", f"s{k % 3}", 5, "k", "w", 1, 2) for k in range(12)]
    rows += [(20, base, "en", "s1", None, None, None, None, None), (21, base, "en", "s1", 9, "a", "b", 1, 1), (22, base + " more", None, None, 9, "a", "b", 1, 1), (22, base + " more", None, None, 9, "a", "b", 1, 1)]
    rows += [(30, None, "de", "s2", 0, "", "", 0, 0), (31, "", "de", "s2", 0, "", "", 0, 0), (32, " \n\t ", "fr", "s2", 3, "", "", 0, 0), (None, base, "en", "s9", 1, "x", "y", 1, 1), (None, None, None, None, None, None, None, None, None)]
    rows += [(40, text(6000), "en", "s4", 1, "x", "y", 1, 1), (41, "x" * 5000, "en", "s4", 5000, "x", "y", 1, 1), (42, "one", "en", "s0", 3, "x", "y", 1, 1), (21, "another text with the same id", "en", "s1", 9, "a", "b", 1, 1)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(n: int, linked) -> list[int]:
    """Least node of each node's component, over all pairs."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
