"""Byte-level BPE and edit-aware counts, held against the libraries that define the ids."""

import random
from hashlib import sha256

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from barkeep.llm import bpe, queries, token_count

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def coder():
    return bpe.of_worker(bpe.serialise(bpe.read_ranks(PATH)), PATTERN, bpe.newer_letters(PATTERN))


@pytest.fixture(scope="module")
def theirs():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def odd_text(rnd: random.Random) -> str:
    pick = lambda: rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x3000), rnd.randrange(0x3000, 0xD7FF), rnd.randrange(0xE000, 0x110000), 32, 10, 0x1C, 0x85, 39])
    return "".join(chr(pick()) for _ in range(rnd.randrange(80)))


def test_ids_of_odd_texts(coder, theirs):
    rnd = random.Random(1)
    texts = [odd_text(rnd) for _ in range(3000)]
    ids = coder.encode(texts)
    assert ids == [theirs(t) for t in texts]
    assert [coder.decode(i) for i in ids] == [t.encode() for t in texts]


def test_every_token_is_itself(coder):
    for token in random.Random(2).sample(coder.token_bytes, 2000):
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        assert coder.decode(coder.encode([text])[0]) == token


def test_newer_letters_are_signs(coder, theirs):
    assert coder.encode(["\U0003263b're"])[0] == theirs("\U0003263b're")


def test_long_runs_do_not_take_square_time(coder):
    text = "a" * 200_000 + " " + "é1" * 50_000
    assert coder.decode(coder.encode([text])[0]) == text.encode()


def test_query(spark, odd_docs, odd_rows, theirs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op1_byte_bpe(spark, str(tmp_path)).collect()
    want = []
    for doc_id, text, *_ in odd_rows:
        ids = theirs(text or "")
        want.append((doc_id, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def test_operator_keeps_clashing_columns(odd_docs, no_docs):
    out = bpe.encode(odd_docs.withColumnRenamed("source", "total"), PATH, PATTERN)
    assert out.columns == ["doc_id", "text", "lang", "total", "n_chars", "ids", "decoded"]
    assert out.where("text is null").first()["ids"] == []
    assert bpe.encode(no_docs, PATH, PATTERN).count() == 0


def grown(coder, text):
    words = coder.split(text)
    return token_count.TokenTree.grown(text, words, coder.counts(words))


def test_trees_follow_edits(coder, theirs):
    """Trees that are stored and read again between edits count as the reference encoder does."""
    rnd = random.Random(3)
    for _ in range(300):
        text = odd_text(rnd) + "the river and the stone. " * rnd.randrange(40) + odd_text(rnd)
        tree = grown(coder, text)
        for _ in range(6):
            start = rnd.randrange(len(text) + 1)
            end = min(len(text), start + rnd.choice([0, 0, 1, 5, 100, 900]))
            new = rnd.choice(["", " ", "a", "  ", "'", "re", "\n\n", " word", odd_text(rnd), "x y " * 400])
            token_count.edit(coder, tree, start, end, new)
            text = text[:start] + new + text[end:]
            if rnd.random() < 0.5:
                tree = token_count.TokenTree.kept(tree.text, tree.parts())
            fresh = grown(coder, text)
            assert tree.text == text and tree.n_tokens == len(theirs(text)) and tree.n_pretokens == fresh.n_pretokens
            tree._settle()
            assert tree.lengths.tolist() == fresh.lengths.tolist() and tree.counts.tolist() == fresh.counts.tolist()


class Watched:
    """A coder that counts the characters that it is given."""

    def __init__(self, coder):
        self.coder, self.seen = coder, 0

    def split(self, text):
        self.seen += len(text)
        return self.coder.split(text)

    def counts(self, words):
        return self.coder.counts(words)


@pytest.mark.parametrize("times", [400, 40_000])
def test_no_edit_takes_a_whole_text(coder, times):
    """What a kept tree gives to the coder follows the edit, however long the text is."""
    text = "the river and the stone. " * times
    parts = grown(coder, text).parts()
    watched = Watched(coder)
    tree = token_count.TokenTree.kept(text, parts)
    token_count.edit(watched, tree, len(text) // 2, len(text) // 2 + 3, "new words")
    token_count.edit(watched, tree, 10, 10, "more ")
    assert watched.seen < 3000 and tree.encoded < 6 * token_count.LEAF


def test_counts_of_odd_documents(spark, odd_docs, odd_rows, no_docs, theirs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op10_token_count(spark, str(tmp_path)).collect()

    def changed(text):
        at = lambda share: int(len(text) * share)
        edits = [(at(0.3), at(0.3), text[:20]), (at(0.5), at(0.5) + 25, ""), (at(0.7), at(0.7) + 40, text[at(0.1) : at(0.1) + 30]), (max(0, len(text) - 15), len(text), "the end")]
        for start, end, new in edits:
            start, end = min(start, len(text)), min(end, len(text))
            text = text[:start] + new + text[end:]
        return text

    want = [(d, len(theirs(t or "")), len(theirs(changed(t or ""))), sha256(changed(t or "").encode()).hexdigest()) for d, t, *_ in odd_rows]
    assert sorted(map(str, ((r["doc_id"], r["n_tokens"], r["edited_n_tokens"], r["edited_sha256"]) for r in found))) == sorted(map(str, want))

    trees = token_count.grown(odd_docs.withColumnRenamed("source", "chars"), PATH, PATTERN)
    edits = F.array(F.struct(F.lit(-5).alias("start"), F.lit(2).alias("end"), F.lit("He").alias("text")), F.struct(F.lit(4).alias("start"), F.lit(10**6).alias("end"), F.lit(None).cast("string").alias("text")))
    rows = token_count.edited(trees.withColumn("edits", edits), PATH, PATTERN).collect()
    assert {r["text"] for r in rows} == {("He" + (t or "")[2:])[:4] for _, t, *_ in odd_rows}
    assert all(r["n_tokens"] == len(theirs(r["text"])) for r in rows)
    assert token_count.grown(no_docs, PATH, PATTERN).count() == 0
    none = token_count.edited(trees.withColumn("edits", F.lit(None).cast("array<struct<start:int,end:int,text:string>>")), PATH, PATTERN).collect()
    assert len(none) == len(odd_rows) and all(r["n_encoded_again"] == 0 and r["n_tokens"] == r["n_tokens_before"] for r in none)


def test_only_edited_documents_are_read(spark, odd_docs, theirs):
    """A table of edits joined with the kept trees: the second pass has a row for each edited document."""
    trees = token_count.grown(odd_docs.where("doc_id is not null"), PATH, PATTERN)
    edits = spark.createDataFrame([(4, [(0, 0, "New ")]), (7, [(3, 9, "x")])], "doc_id long, edits array<struct<start:int,end:int,text:string>>")
    rows = token_count.edited(trees.join(edits, "doc_id"), PATH, PATTERN).collect()
    assert {r["doc_id"] for r in rows} == {4, 7} and all(r["n_tokens"] == len(theirs(r["text"])) for r in rows)


def test_measured_as_the_pattern_splits(coder, theirs, monkeypatch):
    """Lengths and counts of whole groups are those of the pattern's own matches, for odd texts and in groups of any size."""
    rnd = random.Random(4)
    marks = [" ", "  ", "\n", "\t", " ", "　", "\x1c", "'", "'s", "'t", "'ll", "'re", "'LL", "s", "ve", "a", "é", "9", "²", "!", "-", "́", "\0", "中", "\U0001f600", "\U0003263b"]
    for turn in range(300):
        monkeypatch.setattr(bpe, "SPLIT_CHARS", rnd.choice([1, 60, 1 << 20]))
        texts = [odd_text(rnd) if turn % 3 == 0 else "".join(rnd.choices(marks, k=rnd.randrange(25))) for _ in range(rnd.randrange(10))]
        found = list(coder.measured(texts))
        assert [lengths.tolist() for lengths, _ in found] == [list(map(len, coder.split(t))) for t in texts]
        assert [int(counts.sum()) for _, counts in found] == [len(theirs(t)) for t in texts]


def test_other_patterns_are_left_to_their_engine(coder):
    plain = bpe.ByteBpe(bpe.serialise(bpe.read_ranks(PATH)), r"\s*\S+|\s+")
    (lengths, counts), none = plain.measured(["it's  a test", ""])
    assert lengths.tolist() == [4, 3, 5] and counts.tolist() == plain.counts(["it's", "  a", " test"]) and len(none[0]) == 0


def test_words_of_many_texts_are_looked_up_once(coder, monkeypatch):
    """A group of texts asks for each of its words once, and no text is handed to the pattern's engine."""
    asked, counts = [], coder.counts
    monkeypatch.setattr(coder, "counts", lambda words: asked.extend(words) or counts(words))
    monkeypatch.setattr(coder, "split", None)
    found = list(coder.measured(["the river and the stone. " * 400] * 50))
    assert len(found) == 50 and len(found[0][0]) == 2401 and len(asked) == len(set(asked)) < 12
