"""Token counts that follow edits, from segment trees of pre-tokens that are kept in a table.

``grown`` encodes each document once and returns a table of trees, to be written and kept: the
length and the token count of every pre-token, in leaves of some LEAF pre-tokens, and for every node of
the tree the sums of characters and of tokens below it. ``edited`` takes such a table, joined with
edits, and returns the trees after them: an edit descends by characters to the leaves that it
touches, cuts the region that they cover into pre-tokens anew, encodes only that, and updates
the sums on the paths to the root. What it encodes follows the edits, not the texts; documents
without edits need not be read at all.

Boundary context: a match of the pre-token pattern looks at most CONTEXT characters past its
end, so the region begins with the leaf that holds the character CONTEXT + 1 before the edit.
Behind the edit it grows leaf by leaf until a pre-token ends where an untouched leaf begins; as
the pattern never looks back, all that follows stays as it was.

Defined results: a null text is the empty text, with no tokens; an edit's range is clipped to
the text; edits apply in their order, each to the text that the one before left; null edits are none;
repeated rows are counted each on its own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barkeep.llm.bpe import TOGETHER, ByteBpe, for_workers, of_worker

#: Pre-tokens in a leaf at the start, and the number beyond which the tree is laid out anew.
LEAF, FULL = 24, 192
#: Characters past its end that a match of the pattern may look at.
CONTEXT = 2
#: The columns of a tree: pre-tokens' lengths and counts, pre-tokens of each leaf, sums of each node from the root on.
PARTS = ("lengths", "counts", "leaves", "chars", "tokens")


def _packed(numbers: np.ndarray | list[int]) -> bytes:
    """Numbers as bytes, after one that tells how wide they are: most are below 256."""
    numbers = np.asarray(numbers, np.int64)
    most = int(numbers.max()) if len(numbers) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


class TokenTree:
    """The token count of one text, kept under edits. ``encoded`` counts the pre-tokens that were encoded.

    An edit has two steps, ``cut`` and ``put``, so that what many texts need encoded can be encoded together.
    """

    def __init__(self, text: str, lengths: np.ndarray, counts: np.ndarray, leaves: list[int], chars: list[int], tokens: list[int]):
        self.text, self.encoded = text, 0
        self.lengths, self.counts, self.chars, self.tokens = lengths, counts, chars, tokens
        self._set_leaves(leaves)

    def _set_leaves(self, leaves: list[int]) -> None:
        self.leaves, self.width = leaves, len(self.chars) // 2
        self.changed: dict[int, tuple[list[int], list[int]]] = {}  # lengths and counts of leaves that aren't as in the arrays

    @classmethod
    def grown(cls, text: str, pretokens: list[str], counts: list[int]) -> TokenTree:
        return cls.laid_out(text, np.array(list(map(len, pretokens)), np.int64), np.array(counts, np.int64))

    @classmethod
    def laid_out(cls, text: str, lengths: np.ndarray, counts: np.ndarray) -> TokenTree:
        tree = cls(text, lengths, counts, [0], [0, 0], [0, 0])
        tree._lay_out()
        return tree

    @classmethod
    def kept(cls, text: str, parts: list[bytes]) -> TokenTree:
        lengths, counts, *sums = map(_unpacked, parts)
        return cls(text, lengths, counts, *(x.tolist() for x in sums))

    def parts(self) -> list[bytes]:
        """The tree as the columns PARTS."""
        self._settle()
        return list(map(_packed, (self.lengths, self.counts, self.leaves, self.chars, self.tokens)))

    def _settle(self) -> None:
        """Puts the changed leaves into the arrays."""
        if self.changed:
            leaves, ends, at, runs = list(self.leaves), [0, *accumulate(self.leaves)], 0, ([], [])
            for i in sorted(self.changed):
                for k, (old, new) in enumerate(zip((self.lengths, self.counts), self.changed[i], strict=True)):
                    runs[k].extend((old[at : ends[i]], new))
                at, leaves[i] = ends[i + 1], len(self.changed[i][0])
            self.lengths, self.counts = (np.concatenate([*run, old[at:]]).astype(np.int64) for run, old in zip(runs, (self.lengths, self.counts), strict=True))
            self._set_leaves(leaves)

    def _lay_out(self) -> None:
        """Deals the pre-tokens to leaves of LEAF each and sums all nodes."""
        n = max(1, -(-len(self.lengths) // LEAF))
        width = 1 << (n - 1).bit_length()
        for name, values in (("chars", self.lengths), ("tokens", self.counts)):
            node = np.zeros(2 * width, np.int64)
            if len(values):
                node[width : width + n] = np.add.reduceat(values, np.arange(n) * LEAF)
            level = width
            while level > 1:
                node[level // 2 : level] = node[level : 2 * level : 2] + node[level + 1 : 2 * level : 2]
                level //= 2
            setattr(self, name, node.tolist())
        self._set_leaves([LEAF] * (n - 1) + [len(self.lengths) - LEAF * (n - 1)])

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pretokens(self) -> int:
        return sum(self.leaves) + sum(len(x[0]) - self.leaves[i] for i, x in self.changed.items())

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, or the last one, and the characters before it."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if char - before >= self.chars[node]:
                before += self.chars[node]
                node += 1
        leaf = node - self.width
        if leaf >= len(self.leaves):
            leaf = len(self.leaves) - 1
            before = self.chars[1] - self.chars[self.width + leaf]
        return leaf, before

    def cut(self, split: Callable[[str], list[str]], start: int, end: int, text: str) -> tuple[int, int, list[str]]:
        """Replaces the characters from ``start`` to ``end`` (exclusive) by ``text``: the leaves touched, first and last, and their new pre-tokens, to be put."""
        n = self.chars[1]
        start, end = min(max(0, start), n), min(max(start, end, 0), n)
        first, before = self._leaf_at(max(0, start - CONTEXT - 1))
        last, until = self._leaf_at(end)
        until += self.chars[self.width + last]
        new = self.text[before:start] + text + self.text[end:until]
        while True:
            words, at = [], 0
            for word in split(new + self.text[until : until + 2 * CONTEXT + 2]):
                if at >= len(new):
                    break
                words.append(word)
                at += len(word)
            if at == len(new):
                break
            last += 1
            wider = until + self.chars[self.width + last]
            new += self.text[until:wider]
            until = wider
        self.text = self.text[:start] + text + self.text[end:]
        return first, last, words

    def put(self, first: int, last: int, words: list[str], counts: list[int]) -> None:
        """Deals the new pre-tokens to the leaves from ``first`` to ``last`` and updates the sums above them."""
        self.encoded += len(words)
        lengths, share = list(map(len, words)), -(-len(words) // (last - first + 1))
        above = set()
        for i in range(first, last + 1):
            own = slice((i - first) * share, (i - first + 1) * share)
            self.changed[i] = lengths[own], counts[own]
            node = self.width + i
            self.chars[node], self.tokens[node] = sum(lengths[own]), sum(counts[own])
            above.add(node // 2)
        if share > FULL:
            self._settle()
            self._lay_out()
            return
        while above and above != {0}:
            for node in above:
                self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
                self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            above = {node // 2 for node in above if node > 1}


def counted(coder: ByteBpe, lists: list[list[str]]) -> list[list[int]]:
    """The token counts of each list of pre-tokens, encoded together."""
    found = iter(coder.counts([w for words in lists for w in words]))
    return [list(islice(found, len(words))) for words in lists]


def edit(coder: ByteBpe, tree: TokenTree, start: int, end: int, text: str) -> None:
    """One edit of one tree."""
    first, last, words = tree.cut(coder.split, start, end, text)
    tree.put(first, last, words, coder.counts(words))


def _over(rows: DataFrame, ranks_path: str, pattern: str, made: Callable[[ByteBpe, list[dict]], list[tuple]], more: str) -> DataFrame:
    """(doc_id, text, n_tokens, n_pretokens, PARTS, more) with the trees and the further numbers that ``made`` gives for some rows."""
    given = for_workers(rows.sparkSession, ranks_path, pattern)
    extra = [name.split()[0] for name in more.split(", ") if name]
    names = ["text", "n_tokens", "n_pretokens", *PARTS, *extra]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * len(PARTS), *[pa.int64()] * len(extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = of_worker(*given.value)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                out = [(t.text, t.n_tokens, t.n_pretokens, *t.parts(), *numbers) for t, *numbers in made(coder, batch.select(batch.schema.names[1:]).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]], ["doc_id", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, n_tokens long, n_pretokens long, {', '.join(f'{p} binary' for p in PARTS)}"
    return rows.mapInArrow(run, schema + (f", {more}" if more else ""))


def grown(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_tokens, n_pretokens, PARTS): the tree of every row, to be written and kept."""

    def made(coder: ByteBpe, rows: list[dict]) -> list[tuple]:
        texts = [row["text"] or "" for row in rows]
        return [(TokenTree.laid_out(text, *numbers),) for text, numbers in zip(texts, coder.measured(texts), strict=True)]

    return _over(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ranks_path, pattern, made, "")


def edited(trees: DataFrame, ranks_path: str, pattern: str, edits: str = "edits") -> DataFrame:
    """The columns of ``grown`` after the edits, and n_tokens_before, n_encoded_again, for every row of kept trees with a column of edits.

    ``edits`` is an array of struct<start: int, end: int, text: string>. Join a table of edits with the
    trees first, so that only documents with edits are read.
    """

    def made(coder: ByteBpe, rows: list[dict]) -> list[tuple]:
        trees_of = [TokenTree.kept(row["text"], [row[p] for p in PARTS]) for row in rows]
        before = [tree.n_tokens for tree in trees_of]
        for turn in range(max((len(row["edits"] or []) for row in rows), default=0)):
            own = [(tree, row["edits"][turn]) for tree, row in zip(trees_of, rows, strict=True) if len(row["edits"] or []) > turn]
            cuts = [tree.cut(coder.split, e["start"], e["end"], e["text"] or "") for tree, e in own]
            for (tree, _), (first, last, words), counts in zip(own, cuts, counted(coder, [c[2] for c in cuts]), strict=True):
                tree.put(first, last, words, counts)
        return [(tree, n, tree.encoded) for tree, n in zip(trees_of, before, strict=True)]

    rows = trees.select("doc_id", "text", *PARTS, F.col(edits).alias("edits"))
    return _over(rows, ranks_path, pattern, made, "n_tokens_before long, n_encoded_again long")
