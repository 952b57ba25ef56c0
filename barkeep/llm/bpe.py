"""Byte-level BPE with sentencepiece as the engine.

A sentencepiece BPE model is serialised directly from a file of ranks: each byte becomes one
character, each token the piece of its bytes' characters with the negative rank as score, and
the normaliser is the identity. Sentencepiece merges the pair of the highest score first, from
the left, so it merges by rank. Every match of the pre-token pattern is encoded on its own;
ids are decoded by the inverse mapping.

Defined results: a null text is encoded as the empty text, to no ids; repeated rows are encoded
each on its own; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from barkeep.llm._util import small_batches

#: The character of byte b is chr(FIRST_CHAR + b); sentencepiece has no rule for these letters.
FIRST_CHAR = 0x100
#: A character that is no letter, number or space to any version of the tables.
UNASSIGNED = "\u0378"
#: Pre-tokens whose ids a worker remembers, and the longest of them.
CACHED, CACHED_LENGTH = 400_000, 40
#: Rows that are encoded together.
TOGETHER = 200
#: The pattern whose matches ``ByteBpe.measured`` finds by kinds of characters; for any other it takes the matches themselves.
BY_KINDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Kinds of characters, the groups of ``_KIND``; END stands behind each text, as the number after the last character's.
SIGN, LETTER, NUMBER, SPACE, END, UNSEEN = range(6)
END_CODE = sys.maxunicode + 1
_KIND = regex.compile(r"(\p{L})|(\p{N})|(\s)").match
#: Characters that are split at a time, or one text.
SPLIT_CHARS = 1 << 20


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece model of these tokens; its id of a token is the rank plus 1, as 0 is the unknown piece."""
    from sentencepiece import sentencepiece_model_pb2 as spm

    model = spm.ModelProto()
    model.pieces.add(piece="<unk>", score=0.0, type=spm.ModelProto.SentencePiece.UNKNOWN)
    for rank, token in enumerate(tokens):
        model.pieces.add(piece=_characters(token), score=-float(rank), type=spm.ModelProto.SentencePiece.NORMAL)
    model.trainer_spec.model_type = spm.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


def newer_letters(pattern: str) -> str:
    """Characters that the pattern's letters and numbers hold here, but not in tiktoken, whose Unicode tables are of an older version.

    Only characters that Python's own tables don't know are tried, each before a contraction that
    stays whole after a letter and not after a sign.
    """
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"'r": 256, b"'re": 257}
    theirs = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    findall = regex.compile(pattern).findall
    unknown = [chr(i) for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Cn"]
    return "".join(c for c in unknown if findall(f"{c}'re")[-1] == "'re" and theirs(f"{c}'re")[-1] != 257)


_TABLE = {b: FIRST_CHAR + b for b in range(256)}


def _begins(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Whether a match of BY_KINDS begins at each character, or an END."""
    begins = np.empty(len(codes), bool)
    begins[0], begins[1:] = True, kinds[1:] != kinds[:-1]
    space = kinds == SPACE
    full = ~space & (kinds != END)
    begins[1:] &= ~((codes[:-1] == ord(" ")) & full[1:])  # a blank is taken by what follows
    begins[1:-1] |= space[:-2] & space[1:-1] & full[2:]  # the last of some spaces is left to what follows
    begins |= kinds == END
    at = np.flatnonzero(begins & (codes == ord("'")))
    one, two = codes[at + 1], codes[np.minimum(at + 2, len(codes) - 1)]
    short = np.isin(one, list(map(ord, "stmd")))
    long = np.isin(one, list(map(ord, "rv"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    begins[at[short | long] + 1] = False
    begins[at[short] + 2] = begins[at[long] + 3] = True
    return begins


def _characters(data: bytes) -> str:
    return data.decode("latin-1").translate(_TABLE)


def _all_characters(texts: list[str]) -> list[str]:
    """``_characters`` of the bytes of each text, in one pass: the byte 255, which is in no text, stands between them."""
    data = np.frombuffer(b"\xff".join(map(str.encode, texts)), np.uint8).astype("<u2") + np.uint16(FIRST_CHAR)
    return data.astype("<u2").tobytes().decode("utf-16-le").split(chr(FIRST_CHAR + 255))


class ByteBpe:
    """Encoder and decoder of one worker, made from a serialised model, the pre-token pattern and its newer letters, to be taken as signs."""

    def __init__(self, model: bytes, pattern: str, newer: str = ""):
        import sentencepiece

        self.newer = dict.fromkeys(map(ord, newer), UNASSIGNED)
        self.may_hold_newer = re.compile(f"[{min(newer, default='')}-\U0010ffff]").search if newer else lambda text: None

        self.by_kinds, self.kinds = pattern == BY_KINDS, np.full(END_CODE + 1, UNSEEN, np.uint8)
        self.kinds[END_CODE] = END

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.findall = regex.compile(pattern).findall
        pieces = map(self.processor.id_to_piece, range(1, self.processor.vocab_size()))
        self.token_bytes = [bytes(ord(c) - FIRST_CHAR for c in piece) for piece in pieces]
        self.cache: dict[str, tuple[int, ...]] = {}
        self.numbers: dict[str, int] = {}

    def encode_pretokens(self, lists: list[list[str]]) -> list[list[int]]:
        """The ids of each list of pre-tokens."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        cache = self.cache
        new = list({p for pretokens in lists for p in pretokens if p not in cache})
        encoded = self.processor.encode([_characters(p.encode()) for p in new], num_threads=1) if new else []
        fresh = {p: tuple(i - 1 for i in ids) for p, ids in zip(new, encoded, strict=True)}
        cache.update(fresh)
        out = [list(chain.from_iterable(map(cache.__getitem__, pretokens))) for pretokens in lists]
        for p in new:
            if len(p) > CACHED_LENGTH:
                del cache[p]
        return out

    def counts(self, pretokens: list[str]) -> list[int]:
        """The number of ids of each pre-token; numbers are remembered, never the ids."""
        known = self.numbers
        if len(known) > CACHED:
            known.clear()
        found = list(map(known.get, pretokens))
        missing = [i for i, n in enumerate(found) if n is None]
        if missing:
            new = list({pretokens[i] for i in missing})
            known.update(zip(new, map(len, self.processor.encode(_all_characters(new), num_threads=1)), strict=True))
            for i in missing:
                found[i] = known[pretokens[i]]
            for p in new:
                if len(p) > CACHED_LENGTH:
                    del known[p]
        return found

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if text.isascii() or not self.may_hold_newer(text) or self.newer.keys().isdisjoint(map(ord, set(text))):
            return self.findall(text)
        out, at = [], 0
        for word in self.findall(text.translate(self.newer)):
            out.append(text[at : at + len(word)])
            at += len(word)
        return out

    def measured(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The lengths of each text's pre-tokens and their numbers of ids; words become strings once for each group of texts."""
        if not self.by_kinds:
            for words in map(self.split, texts):
                yield np.array(list(map(len, words)), np.int64), np.array(self.counts(words), np.int64)
            return
        group, size = [], 0
        for text in texts:
            if group and size + len(text) > SPLIT_CHARS:
                yield from self._measured(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        if group:
            yield from self._measured(group)

    def _measured(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        whole = "\0".join([*texts, ""])
        data, codes = whole.encode(), np.frombuffer(whole.encode("utf-32-le"), "<u4").copy()
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        bytes_before = None if len(data) == len(codes) else np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), dtype=np.int64)
        codes[ends] = END_CODE
        kinds = self.kinds[codes]
        unseen = np.unique(codes[kinds == UNSEEN]).tolist()
        if unseen:
            for code in unseen:
                found = None if code in self.newer else _KIND(chr(code))
                self.kinds[code] = found.lastindex if found else SIGN
            kinds = self.kinds[codes]
        begins = np.flatnonzero(_begins(codes, kinds))
        offsets = np.append(begins, len(data))
        if bytes_before is not None:
            offsets[1:-1] = bytes_before[begins[1:] - 1]
        words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        counts = np.array(self.counts(words.dictionary.to_pylist()), np.int64)[words.indices.to_numpy()]
        lengths, at = np.diff(begins, append=len(codes)), 0
        for end in np.searchsorted(begins, ends).tolist():
            yield lengths[at:end], counts[at:end]
            at = end + 1

    def encode(self, texts: Iterable[str]) -> list[list[int]]:
        return self.encode_pretokens([self.split(t) for t in texts])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


_made: dict[tuple[int, str, str], ByteBpe] = {}


def of_worker(model: bytes, pattern: str, newer: str) -> ByteBpe:
    """The coder of this worker process, kept between tasks with what it remembers."""
    key = (hash(model), pattern, newer)
    if key not in _made:
        _made[key] = ByteBpe(model, pattern, newer)
    return _made[key]


def for_workers(spark: SparkSession, ranks_path: str, pattern: str) -> Broadcast:
    """What of_worker needs, broadcast; as large as the vocabulary. The rank file is read by the driver only."""
    small_batches(spark)
    return spark.sparkContext.broadcast((serialise(read_ranks(ranks_path)), pattern, newer_letters(pattern)))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with the columns ids (array of int) and decoded (binary)."""
    given = for_workers(docs.sparkSession, ranks_path, pattern)
    text_at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = of_worker(*given.value)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                ids = coder.encode([t or "" for t in batch.column(text_at).to_pylist()])
                more = [pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(coder.decode, ids)), pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "ids", "decoded"])

    added = [StructField("ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))


def digests(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded in one pass, with the digests taken on the spot."""
    given = for_workers(docs.sparkSession, ranks_path, pattern)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = of_worker(*given.value)
        names = list(map(str, range(len(coder.token_bytes))))
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                ids = coder.encode([t or "" for t in batch.column(1).to_pylist()])
                written = [sha256(" ".join(map(names.__getitem__, i)).encode()).hexdigest() for i in ids]
                decoded = [sha256(coder.decode(i)).hexdigest() for i in ids]
                n = pa.array(list(map(len, ids)), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(written), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
