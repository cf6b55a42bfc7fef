"""The steps of the removal of repeated strings, against plain versions and within bounds of work."""

import numpy as np
import pytest

from textward.llm import suffix_dedup


def plainly_covered(size, spans, doubtful, first):
    starts = ({s + i for s, n in spans for i in range(n)} | (set(doubtful) - set(first))) & set(range(size - suffix_dedup.SPAN + 1))
    return {b for s in starts for b in range(s, s + suffix_dedup.SPAN)}


@pytest.mark.parametrize("size", [0, 99, 100, 101, 450, 2000])
def test_covered_bytes(size):
    r = np.random.default_rng(size)
    for k in range(40):
        spans = [(int(r.integers(0, size + 1)), int(r.integers(1, 60))) for _ in range(k % 7)]
        doubtful = r.integers(0, size + 1, k % 11)
        first = np.concatenate((doubtful[::2], [a for a, _ in spans[:1]])).astype(np.int64)
        begins, counts = (np.array([s[i] for s in spans], np.int64) for i in (0, 1))
        edges = suffix_dedup._covered(size, begins, counts, doubtful, first)
        assert (np.diff(edges) > 0).all()
        # A string that a phrase repeats goes, even if it is the first of a doubtful one.
        assert {b for x, y in edges.reshape(-1, 2).tolist() for b in range(x, y)} == plainly_covered(size, spans, doubtful.tolist(), first.tolist())


def test_triggers_are_leftmost_minima():
    r = np.random.default_rng(1)
    hashes = suffix_dedup._spread(r.integers(0, 12, 900).astype(np.uint64))
    high = (hashes >> np.uint64(21)).tolist()
    want = [min(range(i, i + 61), key=lambda j: (high[j], j)) for i in range(len(high) - 60)]
    assert suffix_dedup.least_at(hashes, 61).tolist() == want


def test_triggers_are_found_without_contents(spark, monkeypatch):
    """The first pass needs no contents of phrases, which cost as much as the triggers."""

    def never(data):
        raise AssertionError("contents are worked out")

    monkeypatch.setattr(suffix_dedup, "phrases", never)
    docs = spark.createDataFrame([(1, "abc def " * 40), (2, "xyz")], "doc_id long, text string")
    work = {}
    monkeypatch.setattr(suffix_dedup, "map_texts", lambda df, run, schema: work.update(run=run))
    suffix_dedup._trigger_rows(docs)
    batch = suffix_dedup.pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["abc def " * 40, "xyz"]})
    found = work["run"](batch).to_pydict()
    assert set(found["doc_id"]) == {1} and set(found["times"]) == {2}
