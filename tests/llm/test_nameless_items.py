"""Benchmark items without an id count as the query's SQL has it."""

import hashlib

import pytest

from octolith.llm import decontaminate


@pytest.mark.parametrize("block", [500_000, 2])
def test_items_without_an_id(spark, block):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "short one"), (3, "clean"), (4, "none " + " ".join(words[12:28]))], "doc_id long, text string")
    bench = spark.createDataFrame([(None, " ".join(words[:12])), (7, " ".join(words[15:26])), (None, "short one"), (None, None)], "item_id long, text string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted(tuple(r) for r in decontaminate.contamination(docs, bench, block=block).collect())
    assert got == [(1, 30, 23, 2, sha("7"), True), (2, 2, 2, 1, sha(""), True), (3, 1, 0, 0, sha(""), False), (4, 17, 11, 1, sha("7"), True)]
