"""What a task holds and what it leaves in its Python worker doesn't follow the batches that it gets."""

from __future__ import annotations

import pyarrow as pa

from sievelake.llm import _text, packing


def test_windows_go_while_a_batch_is_read():
    texts = [" ".join(f"{i}x{j}" for j in range(300)) for i in range(6_000)]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    out = list(packing.windows(packing.Packer(2048, 64), packing.segments(iter([b]), 2048), "w", "open"))
    assert b.nbytes > 10 << 20 and max(x.nbytes for x in out) < 2 << 20
    rows = [w for x in out for w in x.to_pylist()]
    assert sum(w["n_tokens"] for w in rows) == 300 * len(texts) and len({w["window"] for w in rows}) == len(rows)
    assert sorted(zip((i for w in rows for i in w["doc_ids"]), (t for w in rows for t in w["texts"]))) == list(enumerate(texts))
    again = list(packing.windows(packing.Packer(2048, 64), packing.opened(iter([pa.Table.from_batches(out).combine_chunks().to_batches()[0]])), "m"))
    assert sum(sum(x["n_tokens"].to_pylist()) for x in again) == 300 * len(texts) and max(x.nbytes for x in again) < 2 << 20


def test_a_task_gives_its_memory_back(spark):
    @_text.lean
    def part(batches):
        for b in batches:
            _text.Words(b.column(0))
            assert _text._powers.cache_info().currsize
            yield b

    b = pa.RecordBatch.from_arrays([pa.array(["some words"])], names=["text"])
    run = part(iter([b]))
    assert next(run) is b and list(run) == [] and not _text._powers.cache_info().currsize
    run = part(iter([b, b]))
    next(run)
    run.close()  # a limit ends a task early
    assert not _text._powers.cache_info().currsize
    assert spark.createDataFrame(pa.Table.from_batches([b])).mapInArrow(part, "text string").collect()[0]["text"] == "some words"
