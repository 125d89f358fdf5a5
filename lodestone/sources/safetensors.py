"""Reader of small weight files: a length, a JSON header, and slices of 32-bit floats."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import SparkSession


def parse(content: bytes) -> dict[str, np.ndarray]:
    """Tensors by name, flat; any other type of number than F32 is an error."""
    (size,) = struct.unpack_from("<Q", content)
    header = json.loads(content[8 : 8 + size])
    out = {}
    for name, spec in header.items():
        if name == "__metadata__":
            continue
        if spec["dtype"] != "F32":
            raise ValueError("unsupported weight type")
        begin, end = spec["data_offsets"]
        out[name] = np.frombuffer(content[8 + size + begin : 8 + size + end], "<f4")
    return out


def read(spark: SparkSession, path: str, most: int = 64 << 20) -> dict[str, np.ndarray]:
    """The tensors of one file of bounded size, read by Spark so that any store will do."""
    rows = spark.read.format("binaryFile").load(path).select("content", "length").limit(2).collect()
    if len(rows) != 1 or rows[0]["length"] > most:
        raise ValueError(f"one file of at most {most} bytes is expected")
    return parse(bytes(rows[0]["content"]))
