from __future__ import annotations

import pyarrow as pa

from featloom.llm import words as W


def test_chunks_copy_few_texts_at_a_time():
    """Every text is in one chunk, at its row, and a batch is never copied as a whole."""
    texts = [None if i % 10 == 0 else f"{i} " * 200 for i in range(2 * W.ROWS + 5)]
    for column in (pa.array(texts), pa.array(["before", *texts]).slice(1), pa.chunked_array([texts[:9], texts[9:]])):
        held, seen = pa.total_allocated_bytes(), []
        for chunk in W.chunks(column):
            assert chunk.first == len(seen)
            assert pa.total_allocated_bytes() - held < 0.8 * column.nbytes
            seen += [bytes(chunk.data[a:b]).decode() for a, b in zip(chunk.offsets, chunk.offsets[1:])]
        assert seen == [t or "" for t in texts]
