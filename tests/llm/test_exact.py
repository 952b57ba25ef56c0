"""Exact duplicates against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from barkeep.llm import exact_dedup
from tests.llm.conftest import DOCS, prose


def brute(rows) -> dict:
    """{(id, n_chars, sha): set of (keep_id, group_size)} and the number of kept rows of each text."""
    groups = defaultdict(list)
    for i, text, *_ in rows:
        plain = re.sub(r"[\x20\x09-\x0D]+", "", text or "")
        groups[hashlib.sha256(plain.encode()).hexdigest()].append((-len(text or ""), i is None, i or 0, i))
    return {sha: (min(g)[3], len(g)) for sha, g in groups.items()}


def check(found, rows):
    wanted = brute(rows)
    assert len(found) == len(rows)
    kept = defaultdict(int)
    for r in found:
        assert (r.keep_id, r.group_size) == wanted[r.text_sha256]
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) <= {1} and kept.keys() == wanted.keys()


def test_odd_documents(spark, odd_docs, odd_rows, no_docs):
    check(exact_dedup.exact_duplicates(odd_docs).collect(), odd_rows)
    empty = exact_dedup.exact_duplicates(no_docs)
    assert empty.collect() == [] and empty.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_names_that_clash(spark, odd_docs, odd_rows):
    docs = odd_docs.selectExpr("doc_id AS row", "text AS sha", "1 AS digest", "2 AS keep_id", "3 AS node")
    check(exact_dedup.exact_duplicates(docs, "row", "sha").collect(), odd_rows)


@pytest.mark.parametrize("run_rows", [1, 7, 16_384])
def test_rounds(spark, monkeypatch, run_rows):
    """Many rounds give what one gives; a third of the rows share a text, in several spellings."""
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", run_rows)
    rnd = random.Random(3)
    some = [prose(rnd, n) for n in range(1, 60)]
    rows = [(i, some[0] + " " * (i % 4) if i % 3 == 0 else rnd.choice(some).replace(" ", rnd.choice([" ", "\t", "\r\n"])), None, None, None) for i in range(300)]
    rnd.shuffle(rows)
    check(exact_dedup.exact_duplicates(spark.createDataFrame(rows, DOCS).repartition(5)).collect(), rows)


def test_short_digests_that_collide():
    """Records of one short digest are only merged if the long one is equal."""
    run = np.zeros(4, exact_dedup.RECORD)
    run["digest"], run["count"], run["row"] = 7, 1, [0, 1, 2, 3]
    run["sha"][1] = run["sha"][3] = [0, 0, 0, 1]
    run["n_chars"] = [5, 5, 6, 5]
    out = exact_dedup.merged([run[:2], run[2:]])
    assert out["row"].tolist() == [2, 1] and out["count"].tolist() == [2, 2]
