"""Shared plumbing of the training-data operators: shared folders, shipped code, vectorised word hashing."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one is made only where none is set."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    current = sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local["):
            raise ValueError("a cluster needs spark.checkpoint.dir: a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="rulelens-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def open_folder(folder: str):
    """(file system, path) of a folder's URI."""
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs a reread and not the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_rulelens_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    tmp = tempfile.mkdtemp(prefix="rulelens-code-")
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    target = os.path.join(tmp, "rulelens_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "rulelens")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    sc._rulelens_shipped = True


def ascii_lower(col):
    """Lower-case A-Z only, leaving every other character alone."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- word hashing over bytes -------------------------------------------------------------------

_MULT = _U(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_SEGMENT = 1 << 20
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2**64, and of its inverse."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, _SEGMENT + 1)
        up = np.ones(size, np.uint64)
        up[1:] = _MULT
        down = np.ones(size, np.uint64)
        down[1:] = _U(pow(int(_MULT), -1, 1 << 64))
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        _powers[:] = [up, down]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _segment_hashes(data: bytes, is_space: np.ndarray) -> np.ndarray:
    arr = np.frombuffer(data, np.uint8)
    space = np.empty(len(arr) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = is_space[arr]
    turn = np.flatnonzero(space[1:] != space[:-1])
    start, end = turn[0::2], turn[1::2]
    up, down = _power_tables(len(arr))
    run = np.zeros(len(arr) + 1, np.uint64)
    np.cumsum(_BYTE[arr] * up[: len(arr)], out=run[1:])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


def space_table(separators: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(separators)] = True
    return table


#: Separators of plain words: the space and the ASCII controls from tab to carriage return.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: Everything ASCII that is neither a letter nor a digit.
NON_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def word_hashes(data: bytes, is_space: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of one text, in order; long texts go through in pieces cut between words."""
    if len(data) <= _SEGMENT:
        return _segment_hashes(data, is_space) if data else np.empty(0, np.uint64)
    marks = np.flatnonzero(is_space[np.frombuffer(data, np.uint8)])
    parts, at = [], 0
    while at < len(data):
        stop = at + _SEGMENT
        if stop >= len(data):
            stop = len(data)
        else:
            k = int(np.searchsorted(marks, stop))
            if k < len(marks):
                stop = int(marks[k])
            else:
                stop = len(data)
        parts.append(_segment_hashes(data[at:stop], is_space))
        at = stop
    return np.concatenate(parts)


def batch_word_hashes(texts: list[bytes], is_space: np.ndarray):
    """Yield (first, hashes, bounds) for runs of texts of about a megabyte; text first+i has hashes[bounds[i]:bounds[i+1]]."""
    at = 0
    while at < len(texts):
        size, stop = 0, at
        while stop < len(texts) and (stop == at or size + len(texts[stop]) + 1 <= _SEGMENT):
            size += len(texts[stop]) + 1
            stop += 1
        if stop == at + 1:
            h = word_hashes(texts[at], is_space)
            yield at, h, np.array([0, len(h)])
        else:
            data = b"\n".join(texts[at:stop])
            arr = np.frombuffer(data, np.uint8)
            space = np.empty(len(arr) + 1, bool)
            space[0] = True
            space[1:] = is_space[arr]
            starts = np.cumsum(space[:-1] & ~space[1:])
            lengths = np.fromiter((len(t) for t in texts[at:stop]), np.int64, stop - at)
            ends = np.cumsum(lengths + 1) - 1
            bounds = np.zeros(stop - at + 1, np.int64)
            bounds[1:] = [starts[e - 1] if e else 0 for e in ends]
            yield at, _segment_hashes(data, is_space), bounds
        at = stop


def encoded(text) -> bytes:
    """UTF-8 of a text, null as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
