"""Walks over windows: three steps at a time give what single steps give, and the meetings of a start share a sketch."""

import numpy as np
import pyarrow as pa

from barloom.llm import decontaminate


def reader_of(text):
    pattern = decontaminate.normalise(pa.array([text], pa.large_string()))[0].tobytes().strip(b" ")
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([pattern], pa.binary())], names=["item", "pattern"])
    entries = pa.Table.from_batches(list(decontaminate._entries(iter([batch])))).to_pandas()
    entries["before"], entries["after"] = entries["offset"], entries["size"] - entries["offset"]
    return decontaminate._Reader(decontaminate._Index(entries), 0.2)


def test_meetings_of_a_start_share_a_sketch(monkeypatch):
    asked = []
    whole = decontaminate._Walks.sketches
    reader = reader_of(text := " ".join(f"word{i} of passage {i * i}" for i in range(20)))
    monkeypatch.setattr(decontaminate._Walks, "sketches", lambda self, data, starts, walk: asked.append((walk, starts.tolist())) or whole(self, data, starts, walk))
    assert len(list(reader.regions(pa.array(["before it " + text + " and after", "", text], pa.large_string())))) == 2
    every = [(walk, start) for walk, starts in asked for start in starts]
    assert every and len(every) == len(set(every))


def test_steps_of_a_walk_add_up():
    rng = np.random.default_rng(5)
    lanes, moves = rng.integers(0, 1 << 62, (5, 32, 2)).astype(np.uint64), rng.integers(0, 2, (5, 32))
    for steps in (range(1, 4), range(3, 5)):
        adds, moved = decontaminate._steps(lanes, moves, steps)
        for code in rng.integers(0, 1 << 15, 50).tolist():
            at, add = 0, np.zeros(2, np.uint64)
            for j in steps:
                symbol = code >> (5 * at) & 31
                add ^= lanes[j, symbol]
                at += int(moves[j, symbol])
            assert (moved[code], adds[code].tolist()) == (at, add.tolist())
