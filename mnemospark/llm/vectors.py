"""Usable vectors, and binary blocks of them in the shared folder."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS = 64


def usable_rows(column: pa.Array, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the usable vectors of an Arrow list column, and those vectors as float32.

    Usable means: `dims` values, all finite, not all zero.
    """
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(length == dims)
    if not len(at):
        return at, np.empty((0, dims), np.float32)
    # a null element is no finite value
    flat = pc.list_flatten(column.take(pa.array(at)))
    x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[ok], np.ascontiguousarray(x[ok], dtype=np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision."""
    y = x.astype(np.float64)
    y /= np.abs(y).max(axis=1, keepdims=True)
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def sample_vectors(df: DataFrame, key: str, vector: str, most: int, dims: int = DIMS) -> tuple[np.ndarray, int]:
    """About `most` usable vectors at length one, chosen by a hash of the key, and the number of rows of df."""
    n = df.count()
    step = max(1, n // max(1, most))
    rows = df.filter((F.size(vector) == dims) & (F.pmod(F.xxhash64(key), F.lit(step)) == 0)).select(key, vector)
    got = rows.limit(2 * most).toArrow().combine_chunks()
    col = got.column(vector)
    chunks = [usable_rows(c, dims)[1] for c in col.chunks]
    x = np.concatenate(chunks) if chunks else np.empty((0, dims), np.float32)
    return (unit(x) if len(x) else x.astype(np.float64)), n


#: Schemes by which Hadoop names stores that Arrow names otherwise.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path that Hadoop would understand, and the path in it. Credentials come from where the store's own clients look for them."""
    scheme, sep, rest = path.partition("://")
    if not sep:  # file:/x and plain paths
        return pafs.LocalFileSystem(), path.removeprefix("file:")
    if _SCHEMES.get(scheme, scheme) == "s3":
        region = os.environ.get("AWS_REGION") or os.environ.get("AWS_DEFAULT_REGION")
        return pafs.S3FileSystem(region=region, endpoint_override=os.environ.get("AWS_ENDPOINT_URL")), rest
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")


def read_block(path: str, block: int, columns: list[str]) -> pa.Table:
    """One block of a table that is partitioned by `block`."""
    fs, root = file_system(path)
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/block={block}")) if f.path.endswith(".parquet")]
    return pa.concat_tables([pq.ParquetFile(fs.open_input_file(f)).read(columns=columns) for f in sorted(files)])
