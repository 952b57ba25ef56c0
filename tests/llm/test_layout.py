"""Sharding, fingerprints and packing, held against brute force."""

import random
import zlib
from array import array
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barkeep.llm import fingerprint, packing, queries, sharding

MODEL = public_tokenizers.path("word_bpe_49k.json")


def smallest(sizes, n):
    def needs(capacity):
        shards, room = 1, capacity
        for s in sizes:
            if s > room:
                shards, room = shards + 1, capacity
            room -= s
        return shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needs(middle) <= n else (middle + 1, high)
    return low


def group_sizes(rows):
    groups = Counter()
    for _, text, *_ in rows:
        groups[sha256((text or "").encode()).hexdigest()] += len((text or "").encode()) + 16
    return [groups[k] for k in sorted(groups)]


def some_texts():
    rnd = random.Random(2)
    rows = [(i, "x" * int(rnd.paretovariate(0.9) * 20)) for i in range(2000)]
    return rows + [(5000 + i, "hot text") for i in range(900)]


@pytest.mark.parametrize("window", [20_000, 0])
def test_shards(spark, monkeypatch, window):
    monkeypatch.setattr(sharding, "WINDOW_GROUPS", window)
    monkeypatch.setattr(sharding, "CELL_ROWS", 100)
    monkeypatch.setattr(sharding, "PROBES", 16)
    rows = some_texts()
    found = sharding.minimax_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    sizes, slots, homes = Counter(), {}, {}
    texts = dict(rows)
    for r in found:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        homes.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]]) + 16
    assert len(found) == len(rows) and set(sizes) <= set(range(8))
    assert max(sizes.values()) == smallest(group_sizes(rows), 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())


def test_shards_of_odd_documents(spark, odd_docs, odd_rows, no_docs, tmp_path):
    clash = odd_docs.withColumnRenamed("source", "shard").withColumnRenamed("lang", "salt")
    found = sharding.minimax_shards(clash, 4).collect()
    assert len(found) == len(odd_rows)
    sizes = Counter()
    for r in found:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) == smallest(group_sizes(odd_rows), 4)
    assert sharding.minimax_shards(no_docs, 4).count() == 0
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op3_sharding(spark, str(tmp_path)).select("law").distinct().collect() == [("bytes",)]


def test_shards_are_near_equal(spark):
    """The smallest shard has nearly as much as the largest, which is as small as it can be."""
    sizes = Counter()
    for r in queries.op3_sharding(spark, "/root/testdata/sf0.01").select("shard", "size").collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 40 and min(sizes.values()) >= 0.85 * max(sizes.values())
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert max(sizes.values()) == smallest(group_sizes(rows), 40)


@pytest.mark.parametrize("seed", range(30))
def test_cuts_keep_the_capacity(seed):
    rnd = random.Random(seed)
    sizes = [int(rnd.paretovariate(0.8)) for _ in range(rnd.randrange(1, 60))]
    n, edges = rnd.randrange(1, 9), [0]
    for s in sizes:
        edges.append(edges[-1] + s)
    holding = lambda targets: [max((a, b) for a, b in zip(edges, edges[1:], strict=False) if a <= t < b) for t in targets]
    capacity = smallest(sizes, n)
    cuts = sharding.near_equal_cuts(holding, capacity, edges[-1], n)
    ends = [0, *cuts, edges[-1]]
    assert len(cuts) == n - 1 and {*cuts} <= {*edges} and all(0 <= b - a <= capacity for a, b in zip(ends, ends[1:], strict=False))


def prints(df):
    return df.select("text", fingerprint.as_hex(F.col("fingerprint")).alias("print")).collect()


def test_fingerprints_ignore_order_and_follow_edits(spark):
    texts = ["a\nb\nc", "c\na\nb", "a\nb", "a\nb\nc\nc", "c"]
    rows = fingerprint.fingerprints(spark.createDataFrame([(t,) for t in texts], "text string"))
    own = {r["text"]: r["print"] for r in prints(rows)}
    assert own["a\nb\nc"] == own["c\na\nb"] and len(set(own.values())) == 4
    pair = rows.where("text = 'a\nb'").select(F.col("fingerprint").alias("x")).crossJoin(rows.where("text = 'c'").select(F.col("fingerprint").alias("y")))
    grown = fingerprint.combined(F.col("x"), F.col("y"))
    back = fingerprint.combined(grown, F.col("y"), -1)
    assert tuple(pair.select(fingerprint.as_hex(grown), fingerprint.as_hex(back)).first()) == (own["a\nb\nc"], own["a\nb"])


def brute_lanes(text, hashes):
    """The fingerprint by plain loops; hashes has the four hashes of each paragraph."""
    out = [0] * fingerprint.LANES
    for p in text.split("\n"):
        for i in range(fingerprint.LANES):
            out[i] += 2 * ((hashes[p][i // 16] >> (4 * (i % 16))) & 15) - 15
    return out


def test_fingerprints_by_plain_loops(spark, monkeypatch):
    """Lanes, edited lanes and likenesses of texts of one to many paragraphs."""
    monkeypatch.setattr(fingerprint, "BLOCK", 7)
    rnd = random.Random(6)
    texts = ["", "\n", "one", "a\n\nb"] + ["\n".join(rnd.choice(["", "α line", "x", "y 1", "z" * 30, f"l{rnd.random()}"]) for _ in range(rnd.randrange(1, 60))) for _ in range(40)]
    rows = fingerprint.with_next(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = rows.withColumn("edited", fingerprint.edited_text(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_lanes", fingerprint.edited_lanes(F.col("text"), F.col("fingerprint"), F.col("edited")))
    found = rows.select("*", fingerprint.likeness(F.col("fingerprint"), F.col("edited_lanes")).alias("near")).collect()
    parts = sorted({p for r in found for t in (r["text"], r["edited"]) for p in t.split("\n")})
    hashed = spark.createDataFrame([(p,) for p in parts], "p string").select("p", *[F.xxhash64("p", F.lit(seed)) for seed in range(4)]).collect()
    hashes = {r[0]: [h % 2**64 for h in r[1:]] for r in hashed}
    assert len(found) == len(texts)
    for r in found:
        own, edited, after = (brute_lanes(r[c], hashes) for c in ("text", "edited", "next_text"))
        assert [r["fingerprint"], r["edited_lanes"], r["next_fingerprint"]] == [[x % 2**36 for x in v] for v in (own, edited, after)]
        dot, norm = sum(x * y for x, y in zip(own, edited, strict=True)), (sum(x * x for x in own) * sum(x * x for x in edited)) ** 0.5
        assert r["near"] == (1 if own == edited else pytest.approx(max(0, dot / norm)))


def test_likeness(spark):
    lines = [f"line {i}" for i in range(200)]
    pairs = [("\n".join(lines), "\n".join(lines[:k] + [f"new {i}" for i in range(200 - k)])) for k in (200, 150, 100, 0)]
    df = spark.createDataFrame(pairs, "a string, b string").select(fingerprint.likeness(fingerprint.lanes(F.col("a")), fingerprint.lanes(F.col("b"))))
    same, most, half, none = [r[0] for r in df.collect()]
    assert same == 1 and 0.5 < most < 1 and 0.2 < half < most and none < 0.45


def test_likeness_of_very_long_texts(spark):
    """Lanes of thousands of equal lines don't wrap: the cosine of multisets of equal lines is 1, whatever their numbers."""
    pairs = [("x\n" * 9_999 + "x", "x\n" * 6_665 + "x"), ("x\n" * 300_000 + "x", "x"), ("x\n" * 9_999 + "x", "y\n" * 9_999 + "y"), ("x", "y")]
    df = spark.createDataFrame(pairs, "a string, b string").select(fingerprint.likeness(fingerprint.lanes(F.col("a")), fingerprint.lanes(F.col("b"))))
    edited, one, long_other, other = [r[0] for r in df.collect()]
    assert edited == pytest.approx(1) and one == pytest.approx(1) and long_other == pytest.approx(other)


@pytest.mark.parametrize(("range_rows", "quantiles"), [(2000, 256), (1, 4)])
def test_neighbours(spark, monkeypatch, range_rows, quantiles):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(fingerprint, "QUANTILES", quantiles)
    rnd = random.Random(1)
    ids = rnd.sample(range(-500, 10**6), 300)
    rows = [(i, "".join(rnd.choice("aß\n😀") for _ in range(rnd.randrange(40)))) for i in ids]
    found = fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = sorted(rows, reverse=True)
    want = {a[0]: b[1] for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    assert {r["doc_id"]: r["next_text"] for r in found} == want


def test_fingerprints_of_odd_documents(spark, odd_docs, odd_rows, no_docs, tmp_path):
    odd_docs.withColumnRenamed("source", "bucket").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op7_fingerprint(spark, str(tmp_path)).collect()
    order = sorted(((d, t or "") for d, t, *_ in odd_rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for (doc_id, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        cut = len(text) // 3
        want.append((doc_id, len(text), sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    assert sorted(map(str, ((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found))) == sorted(map(str, want))
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert all(r["near_edited"] == 1 for r in found if r["fingerprint"] == r["edited_fingerprint"])
    assert fingerprint.with_next(no_docs).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(MODEL)
    made.encode_special_tokens = True
    return made


def test_chunks_give_the_tokenizers_ids(tokenizer):
    rnd = random.Random(4)
    kinds = [lambda: rnd.randrange(32, 127), lambda: rnd.randrange(97, 123), lambda: rnd.randrange(0xC0, 0x100), lambda: rnd.randrange(0x3000), lambda: rnd.choice([32, 9, 0x1C, 0x85, 0x2028, 0x301, 0x3A3, 39]), lambda: rnd.randrange(0xE000, 0x110000)]
    texts = ["".join(chr(rnd.choice(kinds[: rnd.randrange(1, 7)])()) for _ in range(rnd.randrange(80))) for _ in range(4000)] + ["<|endoftext|> it's we'll 12 ß Éa"]
    encoder = packing.ChunkEncoder(open(MODEL).read())
    assert [list(array("I", encoder.ids(t))) for t in texts] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("counts", [{}, {1: 1}, {4096: 3, 1: 5}, {3000: 10, 1000: 12, 96: 9, 7: 1000}, {i: 1 + i % 5 for i in range(1, 4097)}, {2049: 4, 2048: 3, 5: 9000}])
def test_best_fit_places_every_piece_once(counts):
    filled, ranks = Counter(), Counter()
    spans = {}
    for length, first, last, sequence, place in packing.best_fit(counts):
        assert first == ranks[length] and last > first
        ranks[length] = last
        for i in range(last - first):
            spans.setdefault(sequence + i, []).append((place, length))
            filled[sequence + i] += length
    assert ranks == Counter(counts)
    for own in spans.values():
        at = 0
        for place, length in sorted(own):
            assert place == at
            at += length
        assert at <= packing.CAPACITY
    if counts:
        assert len(spans) <= 11 / 9 * max(1, -(-sum(k * n for k, n in counts.items()) // packing.CAPACITY)) + 1 or max(counts) > packing.CAPACITY // 2


def test_best_fit_passes_no_more_at_any_size():
    few, many = (len(packing.best_fit({i: n for i in range(1, 4097)})) for n in (1000, 10**9))
    assert many < 2 * few


def test_another_tokenizer_encodes_whole_texts(odd_rows):
    """One that keeps white space; chunks between white space would be wrong."""
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.ChunkEncoder(other.to_str())
    assert not encoder.chunked and packing.ChunkEncoder(open(MODEL).read()).chunked
    for text in [r[1] or "" for r in odd_rows]:
        assert encoder.ids(text) == array("I", other.encode(text, add_special_tokens=False).ids).tobytes()


def test_packing_of_odd_documents(spark, odd_docs, odd_rows, no_docs, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 3)
    monkeypatch.setattr(packing, "PLANNED", 2)
    found = packing.pack(odd_docs.withColumnRenamed("source", "length"), MODEL).collect()
    want = []
    for doc_id, text, *_ in odd_rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want += [(doc_id, i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(array("I", ids[i : i + 4096]).tobytes())) for i in range(0, len(ids), 4096)]
    assert sorted(map(str, (tuple(r)[:5] for r in found))) == sorted(map(str, want))
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(no_docs, MODEL).count() == 0
