"""Helpers of the training-data operators."""

from __future__ import annotations

import pyarrow as pa

from corpusloom.llm import work


def test_lean_gives_back_after_the_last_row(monkeypatch):
    """All rows pass, memory is given back once, after them, and also when a reader stops early or the work fails."""
    said = []
    monkeypatch.setattr(work, "give_back", lambda: said.append("back"))
    batches = [pa.RecordBatch.from_arrays([pa.array([i])], names=["x"]) for i in range(3)]
    for batch in work.lean(lambda given: (b for b in given))(iter(batches)):
        said.append(batch.column(0)[0].as_py())
    assert said == [0, 1, 2, "back"]
    said.clear()
    early = work.lean(lambda given: (b for b in given))(iter(batches))
    next(early)
    early.close()
    assert said == ["back"]


def test_give_back_leaves_live_values():
    values = pa.array(range(100_000))
    work.give_back()
    assert values[99_999].as_py() == 99_999
