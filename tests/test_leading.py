"""What a worker hands back for many questions."""

import numpy as np
import pyarrow as pa

from websift.operators import search


def test_contest_gives_few_batches():
    class Shared:
        value = (list(range(3000)), [np.array([0])] * 3000, np.zeros(3000), np.zeros(3000, bool), ["a"])

    block = pa.RecordBatch.from_arrays([pa.array([0, 0]), pa.array([7, 8]), pa.array(["a", "a"]), pa.array([1.0, 2.0]), pa.array([False, False])], names=["block", "doc", "stem", "part", "demoted"])
    made = list(search._contest(Shared, 1, 0.5, 1e-8)([block]))
    assert len(made) == 3
    assert [tuple(r.values()) for b in made for r in b.to_pylist()] == [(q, 8, 2.0, 1) for q in range(3000)]
