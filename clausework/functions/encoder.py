"""Pluggable encoders as Arrow-batched functions with a fixed dimension."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from clausework.functions.arrow import text_slices

#: Bytes of text that an encoder is given at once; a longer text is given by itself.
SLICE_BYTES = 4_000_000


def checked_encoder(encode: Callable[[list], Sequence[Sequence[float]]], size: int):
    """A column function that encodes batches; a vector of another size is an error. An Arrow batch is encoded in slices, so no more than one slice stands as Python values."""
    most = SLICE_BYTES

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.list_(pa.float64()))]
        for part in text_slices(column, most):
            vectors = encode(part.to_pylist())
            for v in vectors:
                if len(v) != size:
                    raise ValueError(f"the encoder gave {len(v)} dimensions; {size} are expected")
            parts.append(pa.array([np.asarray(v, float) for v in vectors], pa.list_(pa.float64())))
        return pa.concat_arrays(parts)

    return run
