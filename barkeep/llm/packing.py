"""Best-fit packing of tokenised documents into sequences of at most CAPACITY tokens.

Bulk-synchronous best-fit, longest pieces first. Pieces and gaps are both sorted by size, and
as a size is a whole number up to the capacity, both sides fall into at most CAPACITY classes of
equal size. A superstep takes all pieces of one length: a sweep finds the successor class (the
smallest gaps that hold them), pieces and gaps of the two classes are matched one to one by
rank, the gaps shrink, and it repeats until the length is used up; where no gap is left, new
sequences are opened. The sweeps need the counts of the classes only (they are summed over all
executors) and yield ranges of ranks: pieces ``first`` to ``last`` of a length go to sequences
from ``sequence`` on, at ``offset``. Spark ranks the pieces within their length, in cells so
that no length lands in one task, and joins the ranks with the ranges.

Sweeps, matching and updates of gaps run in one Python loop on the driver (``best_fit``), over
counts of classes, not as distributed sweeps. A length splits at most one entry of gaps and opens
at most two, so there are 2 * CAPACITY entries at the most, and a range fills a place in the
sequences of one of them: no more than 2 * CAPACITY**2 ranges (33.5 million), whatever the number
of documents. They are written as they come, PLANNED at a time. Mixes that were tried gave up to 69,841. Sweeps over rows were tried instead: with all
sequences open and one piece for each gap in a superstep, nine supersteps place 99.4 % of the pieces of
a mix of 55,398, but the gaps that remain are everywhere and three tokens wide, so twelve sequences more
are needed than the 15,498 that the tokens allow and that this packing takes.

Defined results: a null text is the empty text and, as any other, ends with END, so it is one
piece of one token; a document longer than the capacity is cut into full pieces and a rest;
repeated rows are packed each on its own; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barkeep.llm._util import long_table, shared_dir, small_batches, written

CAPACITY, END = 4096, 1
#: Chunks between white space in each of two generations that a worker remembers, and the longest of them.
CACHED, CACHED_LENGTH = 120_000, 40
#: Pieces of a length that one task ranks, about, in no more than CELLS cells; ranks are joined in blocks of BLOCK.
CELL_ROWS, CELLS, BLOCK = 1_000, 1 << 16, 64
#: Ranges that the driver holds at once.
PLANNED = 500_000
#: White space to Python's split() alone; a text that holds one of these is encoded whole.
SPLIT_ONLY = "\x1c\x1d\x1e\x1f"


#: Chunks of these characters, of ASCII without the apostrophe and of Latin-1's letters, are only lower-cased by the
#: tokenizer and cut into the parts below, whose bytes its model then merges. All others take its whole course.
SIMPLE = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+").fullmatch
PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall


# How a model normalises and cuts texts for which the chunks between white space may be encoded apart, and the parts above hold.
CHUNKED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def byte_characters() -> dict[int, int]:
    """The character by which the model's vocabulary spells each byte: visible Latin-1 is itself, the rest follows from 256 on."""
    visible = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 256 + i for i, b in enumerate(hidden)}


class ChunkEncoder:
    """Ids of texts, as bytes of little-endian 32-bit numbers. A tokenizer as in CHUNKED drops white space, so chunks between are encoded apart and remembered; any other one encodes texts whole."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = True
        said = json.loads(model)
        self.chunked = all(said[k] == v for k, v in CHUNKED.items()) and said["model"]["type"] == "BPE" and not said.get("post_processor")
        self.merged, self.spelt = self.tokenizer.model.tokenize, byte_characters()
        self.cache: dict[str, bytes] = {}  # the younger generation
        self.older: dict[str, bytes] = {}

    def _chunks(self, chunks: list[str]) -> dict[str, bytes]:
        out, others = {}, []
        for chunk in chunks:
            if chunk.isascii() and chunk.isalpha():  # one part
                words = [chunk.lower()]
            elif SIMPLE(chunk):
                words = [w if w.isascii() else w.encode().decode("latin-1").translate(self.spelt) for w in PARTS(chunk.lower())]
            else:
                others.append(chunk)
                continue
            out[chunk] = array("I", [t.id for w in words for t in self.merged(w)]).tobytes()
        if others:
            out.update(zip(others, self._encode(others), strict=True))
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def ids(self, text: str) -> bytes:
        if not self.chunked or any(c in text for c in SPLIT_ONLY):
            return self._encode([text])[0]
        chunks, cache = text.split(), self.cache
        new = set(chunks).difference(cache)
        if not new:
            return b"".join(map(cache.__getitem__, chunks))
        older = self.older
        fresh = {c: older[c] for c in new if c in older}
        fresh.update(self._chunks([c for c in new if c not in older]))
        cache.update(fresh)
        out = b"".join(map(cache.__getitem__, chunks))
        for c in fresh:
            if len(c) > CACHED_LENGTH:
                del cache[c]
        if len(cache) > CACHED:
            self.older, self.cache = cache, {}
        return out


_made: dict[int, ChunkEncoder] = {}


def of_worker(model: str) -> ChunkEncoder:
    """The encoder of this worker process, kept between tasks with what it remembers."""
    key = hash(model)
    if key not in _made:
        _made[key] = ChunkEncoder(model)
    return _made[key]


def pieces(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of each document."""
    small_batches(docs.sparkSession)
    with open(model_path) as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # as large as the vocabulary
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    end = array("I", [END]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = of_worker(model.value)
        for batch in batches:
            out = []
            for at in range(batch.num_rows):
                ids = encoder.ids(batch.column(1)[at].as_py() or "") + end
                out += [(at, i // (4 * capacity), i // 4, len(ids[i : i + 4 * capacity]) // 4, zlib.crc32(ids[i : i + 4 * capacity])) for i in range(0, len(ids), 4 * capacity)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            numbers = [pa.array(c, t) for c, t in zip(columns[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *numbers], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sweeps(counts: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int, int]]:
    """(length, first, last, sequence, offset): where the pieces of each length go, by rank; last is exclusive. What is kept between two of them is the gaps, 2 * capacity entries at the most."""
    gaps: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # by room: [first sequence, number of sequences]
    open_ = 0  # bit c: there are gaps with room c
    n_sequences = 0

    def shrunk(room: int, sequence: int, n: int) -> None:
        nonlocal open_
        if room and n:
            gaps[room].append([sequence, n])
            open_ |= 1 << room

    for length in sorted(counts, reverse=True):
        at, n = 0, counts[length]
        while at < n:
            above = open_ >> length
            if not above:
                per = capacity // length
                full, rest = divmod(n - at, per)
                for k in range(per if full else 0):
                    yield (length, at + k * full, at + (k + 1) * full, n_sequences, k * length)
                for k in range(rest):
                    yield (length, at + per * full + k, at + per * full + k + 1, n_sequences + full, k * length)
                shrunk(capacity - per * length, n_sequences, full)
                shrunk(capacity - rest * length, n_sequences + full, 1 if rest else 0)
                n_sequences += full + (1 if rest else 0)
                break
            room = length + (above & -above).bit_length() - 1  # the successor
            swept, gaps[room] = gaps[room], []
            open_ &= ~(1 << room)
            for i, (sequence, m) in enumerate(swept):
                take = min(m, n - at)
                yield (length, at, at + take, sequence, capacity - room)
                at += take
                shrunk(room - length, sequence, take)
                shrunk(room, sequence + take, m - take)
                if at == n:
                    for rest_of in swept[i + 1 :]:
                        shrunk(room, *rest_of)
                    break


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """All of ``sweeps``."""
    return list(sweeps(counts, capacity))


def ranked(cut: DataFrame) -> DataFrame:
    """``cut`` with the rank of each piece among those of its length, from 0."""
    counts = cut.groupBy("length").count()
    cells = {r["length"]: 1 + min(r["count"] // CELL_ROWS, CELLS) for r in counts.where(F.col("count") >= CELL_ROWS).collect()}  # no more than CAPACITY lengths
    salts = F.broadcast(long_table(cut.sparkSession, length=list(cells), salts=list(cells.values())))
    rows = cut.join(salts, "length", "left").withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece"), F.coalesce("salts", F.lit(1)))).drop("salts")
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("length", "cell").count().select("length", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inner = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return rows.withColumn("inner", inner).join(firsts, ["length", "cell"]).withColumn("rank", F.col("inner") + F.col("first")).drop("inner", "first", "cell")


def _ranges(spark: SparkSession, plan: Iterator[tuple[int, int, int, int, int]]) -> DataFrame:
    """The ranges as a table, with the blocks of ranks that they reach. The driver holds PLANNED at a time and writes them to the shared folder."""
    names = ["length", "first", "last", "sequence", "place"]
    schema, path = ", ".join(f"{n} long" for n in names), f"{shared_dir(spark)}/ranges-{uuid.uuid4().hex}"
    while True:
        some = pd.DataFrame(list(islice(plan, PLANNED)), columns=names).astype("int64")
        spark.createDataFrame(some, schema).write.mode("append").parquet(path)
        if len(some) < PLANNED:
            break
    return spark.read.schema(schema).parquet(path).withColumn("block", F.explode(F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"(last - 1) div {BLOCK}"))))


def pack(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document."""
    cut = written(pieces(docs, model_path, doc_id, text, capacity), "pieces")
    counts = dict(cut.groupBy("length").count().collect())
    ranges = _ranges(docs.sparkSession, sweeps(counts, capacity))
    rows = ranked(cut).withColumn("block", F.expr(f"rank div {BLOCK}"))
    placed = rows.join(ranges, ["length", "block"]).where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    sequence = F.col("sequence") + F.col("rank") - F.col("first")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), F.col("place").alias("offset"))
