"""Shared plumbing of the training-data operators.

Words are maximal runs of bytes other than space and ``\\x09``-``\\x0D``.  All
vectorised code works on the UTF-8 buffer that Arrow hands over, in blocks of
about ``BLOCK_BYTES`` so that the working set of a task stays bounded whatever
the batch size is.  Only a text longer than a block makes a larger one; what is
kept for each of its bytes is then the byte itself, the rest is kept by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weir.ship import ship

BLOCK_BYTES = 1 << 18
ARROW_ROWS = 2000
#: Bytes over which running sums are taken at once; a long text takes several.
STEP = 1 << 18
WORD = r"[^\x20\x09-\x0D]+"

_rng = np.random.default_rng(20240501)
#: One random 64-bit value per byte; the second table folds A-Z to a-z.
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BYTE_VALUES_LOWER = BYTE_VALUES.copy()
BYTE_VALUES_LOWER[65:91] = BYTE_VALUES[97:123]
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_ODD = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    """Powers of an odd base modulo 2^64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        have = len(self.values)
        if have < n:
            size = max(n, 2 * have, 1 << 16)
            steps = np.full(size, self.base, np.uint64)
            steps[0] = 1
            self.values = np.cumprod(steps, dtype=np.uint64)
        return self.values[:n]


POWERS, POWERS_INV = _Powers(_BASE), _Powers(_BASE_INV)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (a bijection of 64-bit values)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums_at(data: np.ndarray, table_: np.ndarray | None, *positions: np.ndarray, base: int | None = None) -> list[np.ndarray]:
    """Sums of ``table_[data[:p]]`` (of ``data[:p]`` without a table) for the p of some sorted arrays, step by step.

    With a ``base`` the i-th value counts ``base**i`` times, modulo 2^64.
    """
    kind = np.int64 if base is None else np.uint64
    out = [np.zeros(len(p), kind) for p in positions]
    local = np.zeros(min(STEP, len(data)) + 1, kind)
    carry, scale, step = kind(0), 1, 0 if base is None else pow(base, STEP, 1 << 64)
    for a in range(0, len(data), STEP):
        part = data[a : a + STEP]
        n = len(part)
        part = part if table_ is None else table_[part]
        if base is not None:
            part = part * POWERS.upto(n)
        np.cumsum(part, dtype=kind, out=local[1 : n + 1])
        if base is not None and scale != 1:
            local[1 : n + 1] *= np.uint64(scale)
        for own, p in zip(out, positions, strict=True):
            lo, hi = np.searchsorted(p, (a, a + n), "right") if len(data) > STEP else (0, len(p))
            own[lo:hi] = local[p[lo:hi] - a] + carry
        carry = kind((int(carry) + int(local[n])) % (1 << 64)) if base is not None else carry + local[n]
        scale = scale * step % (1 << 64)
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table_: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of every ``data[start:end]`` (by its values in ``table_``); starts and ends are sorted."""
    to_end, to_start = sums_at(data, table_, ends, starts, base=_BASE)
    inverse = POWERS_INV.upto(min(STEP, len(data) + 1))
    if len(data) < STEP:
        inverse = inverse[starts]
    else:
        far = starts // STEP
        steps = np.full(int(far.max()) + 1 if len(far) else 1, pow(_BASE_INV, STEP, 1 << 64), np.uint64)
        steps[0] = 1
        inverse = inverse[starts - far * STEP] * np.cumprod(steps, dtype=np.uint64)[far]
    return mix64((to_end - to_start) * inverse + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


class Block:
    """Some consecutive texts of a batch as one byte array.

    ``offsets`` has one more entry than there are texts; ``first`` is the index
    of the first text in the batch.  Null texts are empty here.
    """

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray) -> None:
        self.first, self.data, self.offsets = first, data, offsets
        self.n = len(offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and per text the index of its first word (n + 1 entries)."""
        starts, ends, last = [], [], False
        for a in range(0, len(self.data), STEP):
            solid = ~_SPACES[self.data[a : a + STEP + 1]]
            after = np.append(solid[1:], False)[:STEP]
            solid = solid[:STEP]
            lo, hi = np.searchsorted(self.offsets, a), np.searchsorted(self.offsets, a + len(solid), "right")
            edge = np.zeros(len(solid) + 1, bool)
            edge[self.offsets[lo:hi] - a] = True
            before = np.concatenate(([last], solid[:-1]))
            starts.append(np.flatnonzero(solid & (~before | edge[:-1])) + a)
            ends.append(np.flatnonzero(solid & (~after | edge[1:])) + a + 1)
            last = bool(solid[-1])
        joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        first = joined(starts)
        return first, joined(ends), np.searchsorted(first, self.offsets)

    def per_text(self, table_: np.ndarray) -> np.ndarray:
        """The sum of ``table_`` over the bytes of each text."""
        return np.diff(sums_at(self.data, table_, self.offsets)[0])


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of an Arrow string column, block by block, without copying the bytes."""
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield Block(first, raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first])
        first = last


def shingle_sets(block: Block, width: int) -> list[np.ndarray]:
    """Per text its sorted distinct hashes of ``width``-word shingles, A-Z lower-cased.

    A text with fewer words has the whole sequence as its one shingle; a text
    without words has none.
    """
    starts, ends, firsts = block.words()
    hashes = span_hashes(block.data, starts, ends, BYTE_VALUES_LOWER)
    count = np.diff(firsts)
    wins = np.zeros(0, np.uint64)
    if len(hashes) >= width:
        m = len(hashes) - width + 1
        wins = hashes[:m] * _ODD[0]
        for j in range(1, width):
            wins = wins + hashes[j : m + j] * _ODD[j]
        wins = mix64(wins)
    out = []
    for a, c in zip(firsts[:-1].tolist(), count.tolist(), strict=True):
        if c >= width:
            out.append(np.unique(wins[a : a + c - width + 1]))
        elif c:
            one = span_hashes(hashes[a : a + c], np.array([0]), np.array([c]))
            out.append(mix64(one + np.uint64(width)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def lists(type_: pa.DataType, parts: list[np.ndarray]) -> pa.Array:
    """A list column from one array per row."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=ends[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, type_))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(wanted: tuple[str, ...], taken: list[str]) -> list[str]:
    """``wanted`` with underscores in front where a name (of any case) is taken."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def kept_as(keep: tuple[str, ...], own: tuple[str, ...]) -> list[str]:
    """Result names of kept columns: those that clash with an operator's own columns get underscores in front."""
    out: list[str] = []
    for name in keep:
        out += free_names((name,), [*own, *out, *[k for k in keep if k != name]]) if name.lower() in {c.lower() for c in own} else [name]
    return out


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``ARROW_ROWS`` rows and the package at its workers.

    A batch of texts exists several times on its way to Python and back; at the
    default of 10,000 rows that is most of a small executor's memory.
    """
    ship(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))
    return df


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there.

    The folder is ``spark.checkpoint.dir``; only where that is unset, as in
    tests on one machine, a folder below the warehouse is used.
    """
    context = ship(df.sparkSession).sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or df.sparkSession.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df.checkpoint(eager=True)

