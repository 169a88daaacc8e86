"""Words, shingles and byte batches of Arrow text columns, without a Python loop over words.

Text is handled as UTF-8 bytes; null text is empty text. Words are maximal runs of bytes other
than space and \\x09-\\x0D.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_RNG = np.random.Generator(np.random.PCG64(20240229))
# Random odd multipliers: one per byte value, one per word place in a shingle, one base for short runs of bytes.
BYTE_VALUE = _RNG.integers(0, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
PLACE = _RNG.integers(0, 1 << 63, 64, dtype=U64) * U64(2) + U64(1)
BASE = int(_RNG.integers(0, 1 << 63, dtype=U64)) * 2 + 1
INVERSE = pow(BASE, -1, 1 << 64)

# Hashes of long runs are polynomials modulo a prime, in two lanes with a base each. A modulus
# of 2^64 would not do: there some different strings collide whatever the base.
PRIME = (1 << 31) - 1
LANE_VALUES = _RNG.integers(1, PRIME, (2, 256), dtype=U64)
LANE_BASES = [int(x) for x in _RNG.integers(1 << 20, PRIME, 2)]
# Bytes are summed in stretches of this size, so tables of powers and sums stay small beside any text.
STRETCH = 1 << 19
# Shorter runs are hashed eight bytes at a time, all runs together.
CHAINED = 1 << 11
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


# Arrow batches between Spark and Python hold about so many bytes, whatever the rows.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=None)
def powers(base: int, modulus: int = 1 << 64) -> np.ndarray:
    """base**0 … base**STRETCH modulo 2**64 or the prime."""
    known, done = np.ones(STRETCH + 1, U64), 1
    while done < known.size:
        take = min(done, known.size - done)
        step = known[:take] * U64(pow(base, done, modulus))
        known[done : done + take] = step if modulus == 1 << 64 else step % U64(modulus)
        done += take
    return known if modulus == 1 << 64 else known.astype(np.uint32)


def _folded(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**63 modulo the prime, in 0 … PRIME - 1."""
    x = (x & U64(PRIME)) + (x >> U64(31))
    x = (x & U64(PRIME)) + (x >> U64(31))
    return np.where(x >= U64(PRIME), x - U64(PRIME), x)


def _lane(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
    """Polynomials of runs [start, end) of at most STRETCH bytes of data, from the start on."""
    base = LANE_BASES[lane]
    terms = LANE_VALUES[lane][data] * powers(base, PRIME)[: data.size]
    sums = np.zeros(data.size + 1, U64)
    np.cumsum((terms & U64(PRIME)) + (terms >> U64(31)), out=sums[1:])
    return _folded(_folded(sums[ends] - sums[starts]) * powers(pow(base, -1, PRIME), PRIME)[starts])


def _stretched_lane(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
    """The same for data of any size: what each stretch holds of a run is moved to its place and added."""
    base = LANE_BASES[lane]
    total = np.zeros(starts.size, U64)
    for at in range(0, data.size, STRETCH):
        inside = np.flatnonzero((starts < at + STRETCH) & (ends > at))
        if not inside.size:
            continue
        own, begun = starts[inside], np.maximum(starts[inside] - at, 0)
        part = _lane(data[at : at + STRETCH], begun, np.minimum(ends[inside] - at, min(STRETCH, data.size - at)), lane)
        ahead = np.maximum(at - own, 0)
        whole, rest = np.divmod(ahead, STRETCH)
        leaps = np.array([pow(base, STRETCH * k, PRIME) for k in range(int(whole.max()) + 1)], U64)
        moved = _folded(_folded(part * powers(base, PRIME)[rest]) * leaps[whole])
        total[inside] = _folded(total[inside] + moved)
    return total


def _chained(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Eight bytes after the other are mixed into a run's state; runs of up to eight bytes of one length never collide."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((data.size + 1,), "<u8", buffer=padded, strides=(1,))
    state = mix(lengths.astype(U64) * PLACE[0])
    some, at, left = np.arange(starts.size), starts, lengths
    while some.size:
        state[some] = mix(state[some] ^ (words[at] & MASKS[np.minimum(left, 8)])) + PLACE[1]
        more = left > 8
        some, at, left = some[more], at[more] + 8, left[more] - 8
    return state


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end); equal runs have equal hashes wherever they lie."""
    lengths = ends - starts
    long = np.flatnonzero(lengths > CHAINED)
    if not long.size:
        return _chained(data, starts, lengths)
    short = np.flatnonzero(lengths <= CHAINED)
    found = np.empty(starts.size, U64)
    found[short] = _chained(data, starts[short], lengths[short])
    # Two lanes of 31 bits: different runs of n bytes collide with a chance below (n / 2^31)^2 over the choice of bases.
    lane = _lane if data.size <= STRETCH else _stretched_lane
    high, low = (lane(data, starts[long], ends[long], k) for k in (0, 1))
    found[long] = mix(((high << U64(32)) | low) + lengths[long].astype(U64) * PLACE[0])
    return found


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, and where each begins (one more than there are texts)."""
    texts = column.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices_by_bytes(batches, column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Pieces of batches holding about `limit` bytes of text each; one longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = text_bytes(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def word_runs(data: np.ndarray, bounds: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (one more than texts)."""
    if not data.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(bounds.size, np.int64)
    inside = ~breaks[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < data.size)]
    starts[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(at, bounds)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of `size` successive words from each place on; the last places have none."""
    count = max(0, words.size - size + 1)
    total = np.zeros(count, U64)
    for k in range(size):
        total += words[k : k + count] * PLACE[k]
    return mix(total)


def words_and_hashes(column: pa.Array, lower: bool):
    """Bytes, text bounds, word starts, word ends, first word per text, and the hash of every word."""
    data, bounds = text_bytes(column)
    data = LOWER[data] if lower else data
    starts, ends, firsts = word_runs(data, bounds)
    hashes = run_hashes(data, starts, ends) if starts.size else np.zeros(0, U64)
    return data, bounds, starts, ends, firsts, hashes


def lists(values: np.ndarray, counts, kind: pa.DataType) -> pa.Array:
    """A list column from its flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def text_crc(column: str):
    """CRC32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def word_count(text: Column) -> Column:
    """The number of words of a text column, null has none. Every word becomes one letter; blanks in front are left over."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+", "w")
    return F.length(F.translate(letters, " \t\n\x0b\x0c\r", "")).cast("long")
