"""Embeddings, the Jaccard join and components, held against brute force."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from barkeep.llm import embed_dedup, jaccard_join, queries
from barkeep.llm.components import components


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("links", [[], [(1, 1)], [(1, 2), (2, 3), (9, 8)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 60)], [(random.Random(7).randrange(40), i) for i in range(40)]])
def test_components(spark, links):
    want = Union()
    for a, b in links:
        want.join(a, b)
    found = components(spark.createDataFrame([*links, (None, 1)], "a long, b long")).collect()
    assert sorted(map(tuple, found)) == sorted((x, want.root(x)) for x in {y for a, b in links if a != b for y in (a, b)})


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_vectors(rows):
    links, union = {}, Union()
    good = [(i, r) for i, r in enumerate(rows) if r[0] is not None and r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    for n, (i, (a, x, label, *_)) in enumerate(good):
        for j, (b, y, other, *_) in good[n + 1 :]:
            if label == other and len(x) == len(y):
                p, q = (np.array(v, np.float32).astype(float) for v in (x, y))
                if p @ q / (np.linalg.norm(p) * np.linalg.norm(q)) >= 0.98:
                    links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                    union.join(a, b)
    return sorted(((r[0], links.get(i, 0), None if r[0] is None else union.root(r[0]), r[0] is None or union.root(r[0]) == r[0]) for i, r in enumerate(rows)), key=str)


def some_vectors(n=300, width=24):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(12, width))
    rows = []
    for i in range(n):
        v = centres[i % 12] + rnd.normal(size=width) * rnd.choice([0.02, 0.1, 0.13, 0.2, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2)))
    rows += [(n + i, rows[3][1], 1) for i in range(40)]
    rows += [(n + 50, [2 * x for x in rows[3][1]], 1), (n + 51, None, 1), (n + 52, [0.0] * width, 1), (n + 53, [float("nan")] * width, 1), (n + 54, [*rows[3][1][:-1], None], 1), (n + 55, rows[3][1], None), (n + 56, rows[3][1][:5], 1), (n + 57, [float("inf")] * width, 1), (n + 58, [], 1), (None, rows[3][1], 1)]
    return rows


def test_vectors(spark):
    rows = some_vectors()
    found = embed_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(map(tuple, found), key=str) == brute_vectors(rows)


def test_vectors_in_double_precision(spark):
    rows = some_vectors(120)
    doubles = spark.createDataFrame([(*r[:2], str(r[2]) if r[2] is not None else None) for r in rows], "vec_id int, embedding array<double>, label string")
    assert sorted(map(tuple, embed_dedup.near_duplicates(doubles).collect()), key=str) == brute_vectors(rows)


def test_small_tiles_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", 16)
    rows = some_vectors()
    found = embed_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(map(tuple, found), key=str) == brute_vectors(rows)


def test_no_vectors(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    assert embed_dedup.near_duplicates(spark.createDataFrame([(1, None, None)], VECTORS)).first()["kept"]


def test_vector_columns_may_clash(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, 5, "x"), (2, [1.0, 0.01], 1, 6, "y")], "vec_id long, embedding array<float>, label int, weight int, tile string")
    assert {r["n_links"] for r in embed_dedup.near_duplicates(df).collect()} == {1}


def test_pruned_pairs_equal_all_pairs():
    rnd = np.random.default_rng(6)
    base = rnd.normal(size=(50, 32))
    x = np.concatenate([base, base + rnd.normal(size=base.shape) * 0.15])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = embed_dedup.close_pairs(x.astype(np.float32), x.astype(np.float32), x, x)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(x @ x.T >= 0.98)), strict=True))


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_documents(rows):
    sets, union = [(r[0], shingles(r[1])) for r in rows], Union()
    full = [(i, s) for i, s in sets if i is not None and s]
    for n, (a, s) in enumerate(full):
        for b, t in full[n + 1 :]:
            if 100 * len(s & t) >= 80 * len(s | t):
                union.join(a, b)
    return sorted(((i, len(s), None if i is None else union.root(i)) for i, s in sets), key=str)


def similar_documents():
    """Copies, edited copies at all distances, and texts that share a long passage."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    passage, rows = [word() for _ in range(60)], []
    for n in (1, 2, 4, 5, 6, 8, 9, 12, 20, 33, 60, 120, 300, 700):
        base = [word() for _ in range(n)]
        rows += [base, base]
        for edits in (1, 2, 3, 5, 8, 12, 20, 40):
            changed = list(base)
            for _ in range(max(1, min(edits, n // 4))):
                changed[rnd.randrange(n)] = word()
            rows.append(changed)
        rows += [[*base, *passage], [word(), *base], base[: max(1, n * 9 // 10)], base[n // 5 :]]
    rows += [[*passage, *[word() for _ in range(rnd.randrange(40))]] for _ in range(60)]
    return [(i, " ".join(words)) for i, words in enumerate(rows)]


def test_documents(spark):
    rows = similar_documents()
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(map(tuple, found), key=str) == brute_documents(rows)


@pytest.mark.parametrize("small, sets_, common, bits", [(2, 7, 3, 40), (1, 1024, 10**9, 6), (3, 10, 5, 7)])
def test_blocks_and_pieces_give_the_same(spark, monkeypatch, small, sets_, common, bits):
    """Large groups, blocks of few sets, common signatures dealt in pieces and short ids that many sets share find the same links."""
    for name, value in (("SMALL", small), ("BLOCK_SETS", sets_), ("COMMON", common), ("COLUMNS", 16), ("GATHERED", 5000), ("SHORT_BITS", bits)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = similar_documents()
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(map(tuple, found), key=str) == brute_documents(rows)


def test_blocks_alone_join_what_pairs_leave(spark, monkeypatch):
    """Where no pair is verified one by one, comparing blocks joins the sets of large groups."""
    rows = [(i, " ".join(f"w{k}" for k in range(100) if k != i)) for i in range(40)]
    monkeypatch.setattr(jaccard_join, "first_pairs", lambda groups: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 7)
    monkeypatch.setattr(jaccard_join, "SMALL", 1)
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found} == {0}


def test_unlinked_texts_with_a_common_passage_make_few_rows(spark, monkeypatch):
    """What leaves the comparison of blocks grows with sets, not with pairs."""
    rnd, passage = random.Random(3), [f"p{k}" for k in range(160)]
    rows = [(i, " ".join([*passage, *[f"d{rnd.random()}" for _ in range(45)]])) for i in range(120)]
    real, made = jaccard_join.compared, []

    def counted(*given):
        made.append(real(*given).cache())
        return made[-1]

    monkeypatch.setattr(jaccard_join, "compared", counted)
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=str) == brute_documents(rows)
    assert sum(df.count() for df in made) <= len(rows)


def test_screening_keeps_every_linked_set():
    """Sketches never exclude a set that has a partner, and exclude most that have none."""
    rnd = np.random.default_rng(5)
    base = [np.unique(rnd.integers(0, 2**63, int(n), dtype=np.uint64)) for n in rnd.integers(4, 900, 80)]
    base.append(np.unique(np.concatenate([np.arange(2000, dtype=np.uint64) << np.uint64(20), base[0]])))  # all in few cells
    other = [np.unique(np.concatenate([b[: max(4, int(len(b) * share))], rnd.integers(0, 2**63, 3, dtype=np.uint64)])) for b, share in zip(base, rnd.choice([0.5, 0.8, 0.9, 1.0], len(base)), strict=True)]
    end = lambda sets, first: (np.arange(first, first + len(sets)), np.array([len(s) for s in sets]), [jaccard_join.sketch(s) for s in sets])
    kept = jaccard_join.may_link(end(base, 0), end(other, 1000))
    link = np.array([[jaccard_join.similar(a, b) for b in other] for a in base])
    assert kept[0][link.any(axis=1)].all() and kept[1][link.any(axis=0)].all() and link.any() and not kept[0].all()
    itself = jaccard_join.may_link(end(base, 0), end(base, 0))
    assert (itself[0] == itself[1]).all() and itself[0].sum() < len(base) / 4


def test_shared_counts(monkeypatch):
    rnd = np.random.default_rng(2)
    sets = [np.unique(rnd.choice([rnd.integers(0, 50, 30), rnd.integers(0, 10**6, 30)]).astype(np.uint64)) for _ in range(60)]
    want = [[len(np.intersect1d(a, b)) for b in sets[:25]] for a in sets]
    for dense in (0, 3, 100, 10**9):
        monkeypatch.setattr(jaccard_join, "DENSE", dense)
        assert jaccard_join.shared_counts(sets, sets[:25]).tolist() == want


def chains(seeds):
    """For each seed documents A < B < C with C within 0.8 of both others, which are under 0.8 of each other. Sets fill their band, so often all parts differ."""
    rows = []
    for seed in seeds:
        rnd = random.Random(seed)
        size = rnd.choice([7, 15, 31, 63])
        words, n = [f"s{seed}w{rnd.randrange(10**9)}" for _ in range(size + 4)], size // 5
        rows += [(3 * seed, words[n:]), (3 * seed + 1, words[:-n]), (3 * seed + 2, words)]
    return [(i, " ".join(words)) for i, words in rows]


def test_links_that_meet_in_groups_of_two(spark):
    rows = chains(range(400))
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=str) == brute_documents(rows)


def test_first_pairs(spark, monkeypatch):
    """All pairs of small groups; of a large one each set with the smallest id that it meets most often."""
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    groups = spark.createDataFrame([(1, True, [1, 3]), (2, True, [2, 3, 5]), (3, True, [1, 7, 8, 9]), (4, True, [1, 7, 8, 10]), (5, False, [6, 7])], "of long, whole boolean, members array<long>")
    assert {tuple(r) for r in jaccard_join.first_pairs(groups).collect()} == {(1, 3), (2, 3), (2, 5), (3, 5), (1, 7), (1, 8), (1, 9), (1, 10)}


def test_repeated_ids_are_one_node(spark):
    """Rows of one id join what each of their texts is like."""
    text = lambda name: " ".join(f"{name}{k}" for k in range(60))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (5, text("b")), (6, text("c")), (6, text("c")), (7, text("d"))]
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted(map(tuple, found)) == brute_documents(rows)


def test_odd_documents(spark, odd_docs, odd_rows, no_docs):
    found = jaccard_join.near_duplicates(odd_docs.withColumnRenamed("source", "component_id")).collect()
    assert sorted(map(tuple, found), key=str) == brute_documents(odd_rows)
    assert jaccard_join.near_duplicates(no_docs).count() == 0


def test_similar_sets_share_a_signature():
    """The bound of the method: any two sets with Jaccard similarity of at least 0.8 meet."""
    rnd = np.random.default_rng(8)
    for size in [*range(4, 40), 63, 64, 65, 100, 127, 128, 129, 400, 1000]:
        for _ in range(20):
            a = np.unique(rnd.integers(0, 2**63, size, dtype=np.uint64))
            worst = rnd.integers(0, len(a) // 5 + 1)
            b = np.unique(np.concatenate([a[worst:], rnd.integers(0, 2**63, int(rnd.integers(0, len(a) // 4 + 1)), dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 80 * (len(a) + len(b) - shared) and min(len(a), len(b)) >= jaccard_join.SMALLEST:
                found, owner = jaccard_join.signatures([a, b])
                assert set(found[owner == 0].tolist()) & set(found[owner == 1].tolist()), (len(a), len(b), shared)


def test_sketches_bound_the_difference():
    rnd = np.random.default_rng(9)
    for _ in range(300):
        a = np.unique(rnd.integers(0, 2**63, int(rnd.integers(1, 300)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[int(rnd.integers(0, len(a))) :], rnd.integers(0, 2**63, int(rnd.integers(1, 100)), dtype=np.uint64)]))
        true = len(a) + len(b) - 2 * len(np.intersect1d(a, b))
        assert jaccard_join.difference_bound(jaccard_join.sketch(a), jaccard_join.sketch(b)) <= true


def test_shingles_of_a_column():
    found = dict(jaccard_join.shingle_sets(pa.array(["A b c d e f", None, "", "a B\tC d\x0be f", "one two", "ONE two", "two one"])))
    assert sorted(found) == [0, 3, 4, 5, 6] and len(found[0]) == 2
    assert (found[0] == found[3]).all() and (found[4] == found[5]).all() and (found[4] != found[6]).all()


def test_queries(spark, odd_docs, odd_rows, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.op5_jaccard_join(spark, str(tmp_path)).collect()), key=str) == brute_documents(odd_rows)


@pytest.mark.parametrize("shingles", [10**6, 3 * 10**8, 2 * 10**9, 2 * 10**10])
def test_no_bucket_holds_many_signatures(shingles):
    """A task sorts the signatures of a bucket in memory: 2 * 10**9 shingles, some 6 GB of texts, gave 1.4 million of them to each."""
    assert shingles * 7 // 10 / jaccard_join.buckets(shingles) <= 1_000_000


def test_whole_sets_of_blocks_are_no_one_row(spark):
    """Sets that are compared come in batches: their plan gathers no list of them in one row of the JVM."""
    near = spark.createDataFrame([(1, 1, 0, 5, 5), (1, 1, 0, 6, 6), (1, 1, 0, 7, 7)], "x long, y long, side int, component long, id long")
    rows = [(i, np.arange(k, k + 100, dtype=np.uint64).tobytes()) for i, k in ((5, 0), (6, 3), (7, 900))]
    found = jaccard_join.compared(near, spark.createDataFrame(rows, "id long, hashes binary"))
    assert "collect_list(" not in found._jdf.queryExecution().toString()
    assert [sorted(r) for r in found.collect()] == [[5, 6]]
