"""Spelling variants: words that differ by one letter, found by PartEnum signatures of their letters.

A word's letters are a multiset, and as such a binary vector: feature (c, k) is set if the word has c at least k
times. One inserted, deleted or replaced letter changes at most two features. The features fall into
PARTITIONS partitions; two words at a distance of two agree in all but two of them at the most, so each choice of
all but two partitions signs the word, and near words share a signature. Rows meet by signature; there only words
are compared that have the same letters before or after their middle, as one of the two must stay, and each pair
is then compared letter by letter. A pair is reported by the one signature that leaves out the first two
partitions possible, so no distinct is needed, and the pairs of a signature never become rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barkeep.llm._text import mixed, run_hashes
from barkeep.llm._util import small_batches, written

#: Partitions of the features; 28 signatures for each word, of three quarters of its letters.
PARTITIONS = 8
LEFT_OUT = list(combinations(range(PARTITIONS), 2))
#: A run loses a letter if SLIP divides its hash.
SLIP = 199
MIN_LETTERS, MIN_COUNT, FACTOR = 6, 5, 5
#: Words that a task counts before it sends them on, rows that are compared at once, pairs and letters that are.
COUNTED, ROWS, TOGETHER = 1 << 17, 1 << 16, 1 << 21

_RUNS = bytes(b if chr(b).isascii() and chr(b).isalpha() or b >= 0xC0 else 0x20 for b in range(256))


def runs(text: str) -> Counter[bytes]:
    """The runs of A-Z, a-z and U+00C0 to U+00FF of a text and how often it has them, with A-Z in lower case; in Latin-1."""
    return Counter(text.encode("latin-1", "replace").lower().translate(_RUNS).split())


def slipped(run: bytes, hashed: int) -> bytes:
    """The run, or without the letter that its hash (of ``<doc_id>:<run>`` in UTF-8) names if SLIP divides that."""
    at = hashed % len(run)
    return run if hashed % SLIP else run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the words of a task's texts, some of them in several rows."""
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        rows = pa.record_batch({"word": pa.array([w.decode("latin-1") for w in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
        counts.clear()
        return rows

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1)):
            prefix = zlib.crc32(f"{doc.as_py() or ''}:".encode())
            for run, n in runs(text.as_py() or "").items():
                if len(run) >= MIN_LETTERS:
                    word = slipped(run, zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix))
                    if len(word) >= MIN_LETTERS:
                        counts[word] += n
            if len(counts) >= COUNTED:
                yield flush()
    if counts:
        yield flush()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least MIN_LETTERS letters that occur MIN_COUNT times; repeated rows count each, a null id has no digits."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))
    counts = rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= MIN_COUNT)


class Words:
    """Some words as one run of letters; ``starts`` and ``ends`` of each."""

    def __init__(self, words: list[str]):
        raw = [w.encode("latin-1") for w in words]
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.letters = np.frombuffer(b"".join(raw), np.uint8)

    def take(self, rows: np.ndarray) -> Words:
        """Words of their own for some of these."""
        out = object.__new__(Words)
        out.sizes = self.sizes[rows]
        out.ends = np.cumsum(out.sizes)
        out.starts = out.ends - out.sizes
        out.letters = self.letters[np.repeat(self.starts[rows] - out.starts, out.sizes) + np.arange(out.sizes.sum())]
        return out

    def parts(self) -> np.ndarray:
        """For each word and partition, the sum of the hashes of its features there."""
        word = np.repeat(np.arange(len(self.sizes)), self.sizes)
        key = np.sort((word << 8) | self.letters)  # equal letters of a word stand together
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        feature = mixed(((key & 0xFF) << 32 | (np.arange(len(key)) - first)).astype(np.uint64) + np.uint64(1))
        place = (mixed(feature) % np.uint64(PARTITIONS)).astype(np.int64)
        sums = np.zeros((len(self.sizes), PARTITIONS), np.uint64)
        for p in range(PARTITIONS):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(place == p, feature, np.uint64(0)))])
            sums[:, p] = total[self.ends] - total[self.starts]
        return sums


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(signature, word, n) for each signature of each word; the last six bits tell which partitions it leaves out."""
    for batch in batches:
        parts = Words(batch.column("word").to_pylist()).parts()
        whole = parts.sum(axis=1, dtype=np.uint64)
        for k, (i, j) in enumerate(LEFT_OUT):
            signature = (mixed(whole - parts[:, i] - parts[:, j]) & ~np.uint64(63)) | np.uint64(k)
            yield pa.record_batch({"signature": pa.array(signature.view(np.int64)), "word": batch.column("word"), "n": batch.column("n")})


def _equal(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (i, j) with left[i] == right[j], in pieces."""
    order = np.argsort(right, kind="stable")
    keys = right[order]
    low, high = np.searchsorted(keys, left, "left"), np.searchsorted(keys, left, "right")
    rows = np.flatnonzero(high > low)
    count, low = (high - low)[rows], low[rows]
    done = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(done, done[at] + TOGETHER // 8, "right")) - 1)
        own = np.repeat(rows[at:to], count[at:to])
        yield own, order[np.arange(done[at], done[to]) - np.repeat(done[at:to] - low[at:to], count[at:to])]
        at = to


def _halves(words: Words, group: np.ndarray, cut: np.ndarray, skip: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the letters before ``cut`` and of those ``skip`` after it, within a group and for words of a size."""
    own = mixed(group.astype(np.uint64) * np.uint64(1 << 32) + size.astype(np.uint64))
    before = run_hashes(words.letters, words.starts, words.starts + cut)
    after = run_hashes(words.letters, words.starts + cut + skip, words.ends)
    return mixed(own + before), mixed(own + after)


def near(words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs differ by exactly one letter; words b are as long as a or one letter longer."""
    out = np.zeros(len(a), bool)
    at = 0
    total = np.concatenate([[0], np.cumsum(words.sizes[a])])
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(total, total[at] + TOGETHER, "right")) - 1)
        size, longer = words.sizes[a[at:to]], words.sizes[b[at:to]] - words.sizes[a[at:to]]
        first = total[at:to] - total[at]
        step = np.arange(total[to] - total[at]) - np.repeat(first, size)
        x, y = np.repeat(words.starts[a[at:to]], size) + step, np.repeat(words.starts[b[at:to]], size) + step
        agree = words.letters[x] == words.letters[y]
        agree_back = words.letters[x] == words.letters[y + np.repeat(longer, size)]
        head = np.minimum.reduceat(np.where(agree, np.iinfo(np.int64).max, step), first).clip(max=size)
        tail = size - 1 - np.maximum.reduceat(np.where(agree_back, -1, step), first)
        out[at:to] = np.where(longer == 1, head + tail >= size, head + tail == size - 1)
        at = to
    return out


def _pairs(words: Words, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The near pairs of each group; some more than once. Words have two letters at least."""
    middle = words.sizes // 2
    for half in _halves(words, group, middle, 0, words.sizes):
        for a, b in _equal(half, half):
            ahead = a < b
            a, b = a[ahead], b[ahead]
            good = near(words, a, b)
            yield a[good], b[good]
    for short, long in zip(_halves(words, group, middle, 0, words.sizes + 1), _halves(words, group, (words.sizes - 1) // 2, 1, words.sizes), strict=True):
        for a, b in _equal(short, long):
            fits = words.sizes[b] == words.sizes[a] + 1
            a, b = a[fits], b[fits]
            good = near(words, a, b)
            yield a[good], b[good]


def _first_signature(words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of the first choice of two partitions outside of which the words agree."""
    rows, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parts = words.take(rows).parts()
    apart = parts[ends[: len(a)]] != parts[ends[len(a) :]]
    outside = np.stack([apart.sum(axis=1) - apart[:, i] - apart[:, j] for i, j in LEFT_OUT], axis=1)
    return (outside == 0).argmax(axis=1)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, other, n) of near words, both ways, from rows in order of their signatures."""

    def compared(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        signature = rows.column("signature").to_numpy()
        group = np.concatenate([[0], np.cumsum(signature[1:] != signature[:-1])])
        words = Words(rows.column("word").to_pylist())
        found = list(_pairs(words, group))
        a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1)) if found else (np.zeros(0, np.int64),) * 2
        both = np.unique(a * len(words.sizes) + b)
        a, b = both // len(words.sizes), both % len(words.sizes)
        own = _first_signature(words, a, b) == (signature[a] & 63)
        a, b = np.concatenate([a[own], b[own]]), np.concatenate([b[own], a[own]])
        return pa.record_batch({"word": rows.column("word").combine_chunks().take(pa.array(a)), "other": rows.column("word").combine_chunks().take(pa.array(b)), "n": rows.column("n").combine_chunks().take(pa.array(b))})

    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        last = batch.column("signature")[-1].as_py()
        if n >= ROWS and held[0].column("signature")[0].as_py() != last:
            rows = pa.Table.from_batches(held)
            cut = int(np.searchsorted(rows.column("signature").to_numpy(), last, "left"))
            yield compared(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
            n -= cut
    if held:
        yield compared(pa.Table.from_batches(held))


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, n) of ``words`` (word, n): every two that differ by exactly one inserted, deleted or replaced letter, both ways; n is the other's.

    Words are distinct, have two letters at least and none beyond U+00FF.
    """
    signed = words.select("word", "n").mapInArrow(_signed, "signature long, word string, n long")
    met = signed.repartition("signature").sortWithinPartitions("signature")
    return met.mapInArrow(_met, "word string, other string, n long")


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """``words`` (word, n) with n_near, and form and form_n: the near word of the largest n, ties by code points, if that is FACTOR times the word's at least."""
    best = F.min(F.struct((-F.col("n")).alias("less"), "other"))
    of = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(of, "word", "left")
    has = -F.col("best.less") >= FACTOR * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"))


def with_roots(found: DataFrame, most: int) -> DataFrame:
    """``found`` with root: where its forms lead in the end. Counts grow FACTOR times with each step, so ``most``, the largest, tells how many there can be; paths double in each join."""
    steps = max(0.0, log(max(most / MIN_COUNT, 1), FACTOR))
    links = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(ceil(log2(steps)) if steps > 1 else 0):
        after = links.select(F.col("word").alias("root"), F.col("root").alias("after"))
        links = written(links.join(after, "root", "left").select("word", F.coalesce("after", "root").alias("root")), "roots")
    return found.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts, as ``word_counts`` gives them.

    Null and empty texts have no words; of a null id the hash has no digits; repeated rows count each; other columns don't matter. Without
    words there are no rows.
    """
    words = written(word_counts(docs, id_col, text_col), "words")
    found = written(forms(words, near_words(words)), "forms")
    most = words.agg(F.max("n")).first()[0] or 0
    return with_roots(found, most).select("word", "form", "root", "n", "n_near", "form_n")
