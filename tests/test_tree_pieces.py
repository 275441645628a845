"""Trees are fitted on pieces of equal codes."""

import numpy as np
import pyarrow as pa

from hearthspark.operators import trees


def test_trees_run_on_one_piece_a_code():
    codes = np.repeat(np.array([[0, 1], [0, 2], [3, 1]], np.int32), [5, 1, 4], axis=0)
    batch = pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes]), pa.array(np.arange(10.0)), pa.array(np.arange(1, 11))], ["code", "y", "n"])
    for b, first in ((batch, 0), (batch.slice(2), 2)):
        (piece,) = trees._pieces(iter([b]), np.array([0.5, 1.5]))
        assert piece.column(0).to_pylist() == [[0, 1], [0, 2], [3, 1]] and piece.column(3).to_pylist() == [[0.5, 1.5]] * 3
        assert piece.column(1).to_pylist() == [list(map(float, range(first, 5))), [5.0], [6.0, 7.0, 8.0, 9.0]] and piece.column(2).to_pylist()[1:] == [[6], [7, 8, 9, 10]]
