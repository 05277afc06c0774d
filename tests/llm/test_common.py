import os

import numpy as np
import pyarrow as pa

from kgspark.llm import common


def test_scratch_tables_go_and_others_stay(spark):
    at = lambda df: df.inputFiles()[0].removeprefix("file:").removeprefix("//")
    with common.scratch(spark):
        with common.scratch(spark):
            gone = common.written(spark.range(3), "gone")
            outer, kept = common.written(gone, "outer", up=1), common.written(gone, "kept", up=2)
            first, second = at(gone), at(outer)
            assert os.path.exists(first)
        assert not os.path.exists(first) and os.path.exists(second)
    assert not os.path.exists(second) and kept.count() == 3
    assert common.written(spark.range(2), "outside").count() == 2


def test_free_names(spark):
    assert common.free_name(spark.range(1).selectExpr("id AS x", "id AS X_"), "x") == "x__"


def test_slices_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([None if i % 7 == 0 else "x" * i * 10 for i in range(50)])], ["k", "text"])
    parts = list(common.slices(iter([batch, batch.slice(0, 0)]), 1, 500))
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(50)) and len(parts) > 10


def test_word_hashes_tell_words_apart():
    texts = [b"The  the\tTHE\x0bx", b"", b" ", "é É x".encode(), b"x"]
    words, at = common.word_hashes(texts)
    assert np.diff(at).tolist() == [4, 0, 0, 3, 1]
    assert words[0] == words[1] == words[2] != words[3] and words[3] == words[6] == words[7] and words[4] != words[5]
    many, _ = common.word_hashes([" ".join(f"w{i}" for i in range(20_000)).encode()])
    assert len(set(many.tolist())) == 20_000
