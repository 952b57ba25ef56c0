"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from barkeep.llm import spelling
from tests.llm.conftest import DOCS


def one_apart(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows) -> Counter:
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return Counter({w: n for w, n in counts.items() if n >= 5})


def brute(rows) -> list[tuple]:
    counts = brute_counts(rows)
    forms, out = {}, []
    for w, n in counts.items():
        around = [x for x in counts if one_apart(w, x)]
        best = min(around, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= 5 * n else None
        out.append((w, n, len(around)))
    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w

    return sorted((w, forms[w], root(w), n, k, counts[forms[w]] if forms[w] else None) for w, n, k in out)


def tuples(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def some_words(seed: int) -> list[str]:
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("aabcdeéÿ÷") for _ in range(rnd.choice([6, 7, 8, 13]))) for _ in range(25)] + ["aaaaaa", "abababab"]
    out = set(stems)
    for s in stems * 12:
        i = rnd.randrange(len(s))
        out.add(rnd.choice([s[:i] + s[i + 1 :], s[:i] + rnd.choice("abÿ") + s[i:], s[:i] + rnd.choice("cdé") + s[i + 1 :], s[:i] + s[i:][::-1]]))
    return sorted(w for w in out if len(w) >= 2)


@pytest.mark.parametrize("seed", range(3))
def test_all_near_words_are_found_once(spark, seed):
    words = some_words(seed)
    found = [(r.word, r.other) for r in spelling.near_words(spark.createDataFrame([(w, 5) for w in words], "word string, n long").repartition(3)).collect()]
    assert sorted(found) == sorted((a, b) for a in words for b in words if one_apart(a, b))


def test_pairs_of_a_group(monkeypatch):
    """In pieces of one pair and of many, words of one large group give the pairs that brute force gives."""
    names = some_words(9) + ["b" * 3000, "b" * 2999 + "c", "b" * 2999]
    for together in (1, 1 << 21):
        monkeypatch.setattr(spelling, "TOGETHER", together)
        found = {frozenset((names[i], names[j])) for a, b in spelling._pairs(spelling.Words(names), np.zeros(len(names), np.int64)) for i, j in zip(a, b)}
        assert found == {frozenset((a, b)) for a in names for b in names if one_apart(a, b)}


def test_variants(spark):
    """Chains of forms, ties of counts, letters that slip, letters beyond ASCII, runs that only letters beyond U+00FF end."""
    rnd = random.Random(8)
    chain = {"harbours": 700, "harbour": 140, "harbor": 25, "harbxr": 5, "arbour": 28, "garbour": 28, "étrange": 40, "Étrange": 6, "étranget": 8, "đétrang": 8, "ABCDEF": 30, "abcdeg": 6, "abcdez": 6}
    pool = [w for w, n in chain.items() for _ in range(n)]
    rnd.shuffle(pool)
    rows = [(i, rnd.choice([" ", ", ", "\n", "9", "đ"]).join(pool[k : k + 7]), None, None, None) for i, k in enumerate(range(0, len(pool), 7))]
    rows += [(None, "harbour harbour letters", "en", None, None), (3, None, None, None, None), (4, "", None, None, None), (5, "x" * 50_000 + " " + "lengthy " * 30_000, None, None, None), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    found = tuples(spelling.variants(docs))
    assert found == brute(rows)
    assert {r[0]: r[2] for r in found}["harbor"] == "harbours"
    assert tuples(spelling.variants(docs.selectExpr("doc_id AS word", "text AS n", "1 AS form"), "word", "n")) == found


def test_odd_documents(spark, odd_docs, odd_rows, no_docs):
    assert tuples(spelling.variants(odd_docs)) == brute(odd_rows)
    assert tuples(spelling.variants(no_docs)) == []


def test_whole_table(spark):
    """All documents of the smallest table."""
    from barkeep.llm import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert tuples(queries.op13_spelling_variants(spark, "/root/testdata/sf0.001")) == brute(rows)
