"""Python's memory of a task is bounded by a text or a block, not by a batch of them."""

import tracemalloc

import numpy as np
import pyarrow as pa

from earshot.operators import asr, retrieval


def _peak(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


class _Captured:
    """Takes the task that an operator hands to Spark."""

    def select(self, *columns):
        return self

    def mapInArrow(self, task, schema):
        return task


def test_tokens_of_one_text_at_a_time():
    batch = pa.RecordBatch.from_pydict({"key": list(range(400)), "text": ["one two, three. " * 300] * 400})
    made, peak = _peak(lambda: list(asr.token_rows(_Captured())([batch])))
    assert made[0].to_pydict() == {"key": list(range(400)), "n_tokens": [900] * 400, "n_marks": [600] * 400}
    assert peak < 5 << 20


def test_distances_by_turns():
    rng = np.random.default_rng(5)
    asked, own = rng.normal(size=(1500, 8)), rng.normal(size=(6000, 8))
    chunks = pa.table({"chunk_id": np.arange(6000), "parent_id": np.arange(6000) % 7, "embedding": pa.array(list(own), pa.list_(pa.float64()))})
    got, peak = _peak(lambda: retrieval.best_of((np.arange(1500), asked, []), chunks, [], 5))
    distance = np.round(1 - asked @ own.T / np.linalg.norm(asked, axis=1)[:, None] / np.linalg.norm(own, axis=1), 9)
    assert np.array_equal(got.column("chunk_id").to_numpy().reshape(-1, 5), np.argsort(distance, axis=1, kind="stable")[:, :5])
    assert peak < 64 << 20


def test_episodes_of_a_batch_by_turns():
    from earshot.operators import chunking

    words = [{"word": f"w{i}.", "start": i * 0.4, "end": i * 0.4 + 0.4} for i in range(600)]
    line = {"text": " ".join(w["word"] for w in words), "start": 0.0, "end": 240.0, "words": words}
    kind = pa.list_(pa.struct([("text", pa.string()), ("start", pa.float64()), ("end", pa.float64()), ("words", pa.list_(pa.struct([("word", pa.string()), ("start", pa.float64()), ("end", pa.float64())])))]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(["en"] * 600), pa.array([240.0] * 600), pa.array([[line]] * 600, kind)], names=["episode_id", "language", "duration_seconds", "segments"])

    class Told(_Captured):
        sparkSession = type("Session", (), {"conf": type("Conf", (), {"set": lambda *a: None})()})()

    made, peak = _peak(lambda: sum(b.num_rows for b in chunking.index_transcripts(Told())([batch])))
    assert made == 600 * 10 and peak < 5 << 20
