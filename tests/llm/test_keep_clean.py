"""Decontamination judges each row by its own text, whatever its doc_id."""

from unittest import mock

import corpus_pipeline
from voxelake.llm import decontam

WORDS = [f"w{i}" for i in range(30)]
LEAK, CLEAN = "x " + " ".join(WORDS[2:12]) + " y", " ".join(reversed(WORDS))
ROWS = [(None, LEAK, "a"), (None, CLEAN, "b"), (1, LEAK, "c"), (1, CLEAN, "d"), (2, LEAK, "e"), (3, None, "f"), (4, CLEAN, "g"), (4, CLEAN, "g")]


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    bench = spark.createDataFrame([(1, " ".join(WORDS[:12]))], "item_id long, text string")
    want = sorted((r for r in ROWS if r[1] != LEAK), key=str)
    with mock.patch.object(corpus_pipeline, "table", lambda *_: bench):
        got = corpus_pipeline.keep_uncontaminated(spark, docs, "")
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == want
    dealt = decontam.keep_clean(docs, bench, broadcast_bytes=0)
    assert dealt.columns == docs.columns and sorted(map(tuple, dealt.collect()), key=str) == want
    assert decontam.keep_clean(docs, bench.limit(0)).count() == len(ROWS)
