"""Python workers live on for other tasks: what a task freed has to go back to the system."""

import ctypes
import re

import numpy as np
import pyarrow as pa
import pytest

from rollframe.llm import common, jaccard, packing, queries, toxicity


def held_mb():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read()).group(1)) / 1024


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="the C library can't return its heap")
def test_freed_memory_goes_back():
    freed = [b"x" * 100_000 for _ in range(1000)]
    last = b"y" * 100_000  # stands above the others, so that the heap doesn't shrink by itself
    del freed
    before = held_mb()
    common.give_back()
    assert before - held_mb() > 60 and len(last) == 100_000


@pytest.mark.parametrize("run", [
    lambda: packing._tokenize(queries.tokenizer_file("word_bpe_49k.json"), 1, 2), lambda: jaccard._count_cells(5), lambda: toxicity._count_units,
])
def test_tasks_give_back_when_they_end(run, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2]), pa.array(["a b c d e f", None]), pa.array(np.array([3, 4])), pa.array([1, 0])], names=["doc_id", "text", "_key", "toxic"]
    )
    out = run()(iter([batch]))
    assert sum(b.num_rows for b in out) > 0 and calls == [1]


def test_words_are_read_a_quarter_megabyte_at_once():
    """The links of near copies don't depend on how much of a batch is read at once, a long text included."""
    texts = ["w%d x y z " % (i % 7) * (90_000 if i == 3 else 400) for i in range(300)]
    whole = [w.hashes for w in common.read_words(pa.array(texts), common.Powers(), True, 1 << 30)]
    parts = [w for w in common.read_words(pa.array(texts), common.Powers(), True, jaccard.READ_BYTES)]
    assert len(whole) == 1 and len(parts) > 1
    assert np.array_equal(whole[0], np.concatenate([w.hashes for w in parts]))
