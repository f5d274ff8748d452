"""Small helpers between Arrow batches and numpy, used inside tasks."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column, width):
    """A list<float> column as a float64 matrix; every row must have the width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    if len(flat) != len(column) * width or flat.null_count:
        raise ValueError(f"a vector is not {width} wide")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def key_order(table, keys):
    """Row numbers that put the table in ascending key order."""
    return pc.sort_indices(table, sort_keys=[(k, "ascending") for k in keys]).to_numpy()


def as_table(batch):
    return batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch])
