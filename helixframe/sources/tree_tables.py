"""Tables of ``.trees`` files: a container of named arrays, read into rows.

A container has a header of 64 bytes, a descriptor of 64 bytes for each array, then names and arrays (little-endian).
A table is the arrays whose names start with its own; a ragged column is a byte array with one of offsets. Each file is a
row for Spark's binary source and read by one task, since its arrays lie column after column; many files are many tasks. A damaged file
gives one row that tells what is wrong with it; Spark lists no empty one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format: first bytes, kinds of numbers by their code, and the columns of tables that are read.
MAGIC = b"\x89KAS\r\n\x1a\n"
KINDS = ("<i1", "<u1", "<i2", "<u2", "<i4", "<u4", "<i8", "<u8", "<f4", "<f8")
TABLES = {
    "nodes": "time double, flags long, population int, individual int",
    "edges": "left double, right double, parent int, child int",
    "sites": "position double, ancestral_state string",
    "mutations": "site int, node int, parent int, time double, derived_state string",
    "individuals": "flags long",
    "migrations": "left double, right double, node int, source int, dest int, time double",
}


def arrays(data: bytes) -> dict[str, np.ndarray]:
    """The arrays of a container by name."""
    if len(data) < 64 or data[:8] != MAGIC:
        raise ValueError("no container of tables")
    major, _, n, size = struct.unpack_from("<HHIQ", data, 8)
    if major != 1 or size != len(data):
        raise ValueError(f"{len(data)} bytes where {size} are told" if major == 1 else f"version {major}")
    if 64 + 64 * n > size:
        raise ValueError("descriptors beyond the end")
    out = {}
    for k in range(n):
        kind, key, key_n, at, count = struct.unpack_from("<B7xQQQQ", data, 64 + 64 * k)
        if kind >= len(KINDS):
            raise ValueError(f"array of kind {kind}")
        dtype = np.dtype(KINDS[kind])
        if key + key_n > size or at + count * dtype.itemsize > size:
            raise ValueError("an array beyond the end")
        out[data[key : key + key_n].decode()] = np.frombuffer(data, dtype, count, at)
    return out


def columns(found: dict[str, np.ndarray], table: str) -> tuple[int, dict[str, pa.Array]]:
    """(rows, columns) of a table; a column that the file lacks is null."""
    types = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    spec, out, n = [c.split() for c in TABLES[table].split(", ")], {}, None
    for name, kind in spec:
        values = found.get(f"{table}/{name}")
        if values is None:
            continue
        if kind == "string":
            at = found.get(f"{table}/{name}_offset")
            if at is None or not len(at) or np.any(np.diff(at.astype(np.int64)) < 0) or at[-1] != len(values):
                raise ValueError(f"offsets of {table}/{name}")
            raw = values.tobytes()
            col = pa.array([raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())
        else:
            col = pa.array(values.astype({"double": "f8", "long": "i8", "int": "i4"}[kind]), types[kind])
        if n not in (None, len(col)):
            raise ValueError(f"{table}/{name} has {len(col)} rows, others {n}")
        n, out[name] = len(col), col
    n = n or 0
    return n, {name: out.get(name, pa.nulls(n, types[kind])) for name, kind in spec}


def read_table(spark: SparkSession, paths: str | list[str], table: str) -> DataFrame:
    """(path, id, columns, error) of a table of each file; ``id`` is a row's number, which other tables refer to.

    A damaged file is one row of nulls with ``error``.
    """
    names = [c.split()[0] for c in TABLES[table].split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    n, cols = columns(arrays(data), table)
                    error = None
                except (ValueError, UnicodeDecodeError) as e:
                    n, error = 1, str(e)
                    cols = {k: pa.nulls(1, v.type) for k, v in columns({}, table)[1].items()}
                for at in range(0, n, 65_536):
                    m = min(65_536, n - at)
                    ids = pa.array(range(at, at + m), pa.int64()) if error is None else pa.nulls(m, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([path] * m), ids, *(cols[k].slice(at, m) for k in names), pa.array([error] * m, pa.string())], ["path", "id", *names, "error"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, f"path string, id long, {TABLES[table]}, error string")
