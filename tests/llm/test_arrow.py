"""Portions of Arrow batches keep every row and every letter."""

import pyarrow as pa

from pairsieve.llm.arrow import portions
from pairsieve.llm.langid import bytes_of
from pairsieve.llm.lm import lowered, token_index


def test_portions():
    texts = ["Às É " * (i % 5) + str(i) if i % 7 else None for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], ["id", "text"])
    parts = list(portions(iter([batch]), 1, 64))
    assert len(parts) > 20 and [i for p in parts for i in p.column(0).to_pylist()] == list(range(200))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    for part in parts:
        own = [t or "" for t in part.column(1).to_pylist()]
        assert lowered(part.column(1)).to_pylist() == ["".join(c.lower() if c.isascii() else c for c in t) for t in own]
        names, index, per_text = token_index(part.column(1))
        assert per_text.tolist() == [len(t.split()) for t in own]
        assert bytes_of(part.column(1))[0].tobytes() == "".join(own).encode()
