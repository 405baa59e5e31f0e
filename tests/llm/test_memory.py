"""What a task holds is bounded by its portions, not by the texts of a batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
import sentencepiece
from pagewright.llm import common, pieces


def test_slices_of_bounded_text():
    b = pa.record_batch({"text": ["a" * 40, None, "b" * 70, "c" * 200, "", "d" * 30, "e" * 30, "f" * 41]})
    got = [s.column("text").to_pylist() for s in common.sliced(iter([b, b.slice(0, 0), b.slice(3, 2)]), 3, 100)]
    assert got == [["a" * 40, None], ["b" * 70], ["c" * 200], ["", "d" * 30, "e" * 30], ["f" * 41], ["c" * 200], [""]]


def test_a_batch_of_long_texts_is_encoded_portion_by_portion():
    with open(pieces.MODEL, "rb") as f:
        model = f.read()
    own, run = pieces.Pieces(model), pieces._codec(model, True)
    long = " ".join(f"w{k:x}\n  é{k % 977}" for k in range(200_000))
    texts = [long, "", None, "short", long[: 3 << 19], long[5:1000]]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    coded = own.encode(texts)
    assert [np.frombuffer(x, np.int32).tolist() for x in coded] == [library.encode(t) if t else [] for t in texts]
    assert [own.decode(x) for x in coded] == [t or "" for t in texts]
    batch = pa.record_batch({"text": [long] * 4})
    tracemalloc.start()
    try:
        got = [r for b in run(iter([batch])) for r in b.column("round_trip").to_pylist()]
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert got == [True] * 4
    assert peak < 150, peak
