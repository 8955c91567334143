"""Detection of periodic runs of words by recursive frequency splitting.

A run of period q has three periods at least, so each of its words occurs three times
in it. Words that occur fewer than FEWEST times within their segment therefore belong
to no run: they split it, segments too short for a run go, and the counts are taken
again within the smaller segments until nothing splits. No run is ever cut in this way,
and none reaches over a segment's end.

The segments that are left are scanned by lag. Lags up to DIRECT compare every word
with the one a lag behind. A longer lag q compares aligned blocks of q words with the
next block, by prefix sums of hashes: 2 q equal pairs hold a whole block, so no run is
missed, and all lags of n words take n log n comparisons. What is found is extended and
compared word by word. A stretch that a smaller period has found already is not one of
smallest period, and is left out.

Documents do not depend on each other: a task sees a batch of texts, in parts of PART
bytes (or one text, where that is longer), and nothing is shuffled.

Defined cases: a null or empty text has no words, no run (0 and four nulls) and the
digests of the empty text; a null id is in no digest's rule and leaves its text as it
is; of runs with equal exponents the smallest start, then the smallest period, counts;
repeated rows give repeated result rows; an empty table gives an empty result; other
columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, map_batches, text_of

#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
FEWEST = LEAST_PERIODS
DIRECT = 8
PART, TESTS = 4 << 20, 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)

#: (start, period, length) of one run.
Run = tuple[int, int, int]


def survivors(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that can be in a run, and the segment of each: ``words``
    are numbers, ``owner`` (ascending) keeps documents apart."""
    place, segment = np.arange(len(words)), owner.astype(np.int64)
    several = int(words.max()) + 1 if len(words) else 1
    while len(place):
        _, of, counts = np.unique(segment * several + words[place], return_inverse=True, return_counts=True)
        often = counts[of] >= FEWEST
        whole = often.all()
        place, segment = place[often], segment[often]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1] + 1) | (segment[1:] != segment[:-1])
        segment = np.cumsum(new) - 1
        long = np.bincount(segment, minlength=1)[segment] >= LEAST_WORDS if len(place) else often[:0]
        place, segment = place[long], segment[long]
        if whole:
            break
    return place, segment


def _stretches(equal: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Maximal stretches of true values of ``least`` and more."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return zip(starts[long].tolist(), ends[long].tolist(), strict=True)


def _reach(words: np.ndarray, at: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The maximal stretch around ``at`` of words equal to the word ``lag`` later."""
    left, right, step = at, at, 64
    while right < high:
        to = min(high, right + step)
        same = words[right:to] == words[right + lag : to + lag]
        if not same.all():
            right += int(np.argmin(same))
            break
        right, step = to, 2 * step
    step = 64
    while left > low:
        to = max(low, left - step)
        same = (words[to:left] == words[to + lag : left + lag])[::-1]
        if not same.all():
            left -= int(np.argmin(same))
            break
        left, step = to, 2 * step
    return left, right


def _blocks(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(segment, lag, place) of the first of each chain of equal neighbouring blocks,
    by ascending lag within a segment."""
    value = words.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words), _BASE)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum((value ^ (value >> np.uint64(29))) * power[:-1])])
    lags = np.maximum(sizes // LEAST_PERIODS - DIRECT, 0)
    of = np.repeat(np.arange(len(sizes)), lags)
    lag = np.arange(len(of)) - np.repeat(np.cumsum(lags) - lags, lags) + DIRECT + 1
    tests = sizes[of] // lag - 1
    upto = np.cumsum(tests)
    at = 0
    while at < len(of):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TESTS, "right")))
        n = tests[at:to]
        item = np.repeat(np.arange(at, to), n)
        q = lag[item]
        nth = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        x = starts[of[item]] + nth * q
        hit = (total[x + q] - total[x]) * power[q] == total[x + 2 * q] - total[x + q]
        first = hit & ~(np.concatenate([[False], hit[:-1]]) & (nth > 0))
        yield from zip(of[item[first]].tolist(), q[first].tolist(), x[first].tolist(), strict=True)
        at = to


def runs_of(words: np.ndarray, owner: np.ndarray) -> dict[int, list[Run]]:
    """Every run of every owner, with places counted over all ``words``."""
    place, segment = survivors(words, owner)
    if not len(place):
        return {}
    kinds, starts, sizes = np.unique(segment, return_index=True, return_counts=True)
    back = place[starts]
    # segments side by side, with a number of its own between two of them
    starts = starts + np.arange(len(kinds))
    line = np.full(len(place) + len(kinds), -1, np.int64)
    spot = np.arange(len(place)) + np.repeat(np.arange(len(kinds)), sizes)
    line[spot] = words[place]
    ends = starts + sizes
    line[ends] = -1 - np.arange(len(kinds))
    found: list[dict[tuple[int, int], int]] = [{} for _ in kinds]

    def add(k: int, s: int, matched: int, q: int) -> None:
        size = matched - s + q
        if size >= max(LEAST_WORDS, LEAST_PERIODS * q):
            found[k].setdefault((s, s + size), q)

    for q in range(1, DIRECT + 1):
        for s, e in _stretches(line[:-q] == line[q:], max(LEAST_WORDS - q, 2 * q)):
            add(int(np.searchsorted(ends, s, "right")), s, e, q)
    for k, q, x in _blocks(line, starts, sizes):
        if any(s <= x and x + 2 * q <= e and q % p == 0 for (s, e), p in found[k].items()):
            continue
        s, e = _reach(line, x, q, int(starts[k]), int(ends[k]) - q)
        if e - x >= q:  # else equal hashes of different words
            add(k, s, e, q)
    out: dict[int, list[Run]] = {}
    for k, own in enumerate(found):
        shift = int(back[k] - starts[k])
        for (s, e), q in own.items():
            out.setdefault(int(owner[s + shift]), []).append((s + shift, q, e - s))
    return {o: sorted(r) for o, r in out.items()}


def repeated_by_id(doc_id: int | None, n: int) -> np.ndarray | None:
    """The places from which the words of a document come, where its id asks for an
    ending that repeats (one in ten), else None."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return place


def parts(batch: pa.RecordBatch, column: int, most: int = PART) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of ``most`` bytes of text, or of one row."""
    upto = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _scanned(ids: list, texts: pa.Array, source: Callable | None):
    """(doc, runs, collapsed text) of each row."""
    cut = pc.split_pattern_regex(texts, f"[{WS}]+")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(cut).to_numpy(zero_copy_only=False))
    words = cut.flatten()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    words, row = words.filter(pa.array(full)), row[full]
    counts = np.bincount(row, minlength=len(texts))
    first = np.cumsum(counts) - counts
    place = np.arange(len(row))
    if source is not None:
        for k, (i, n) in enumerate(zip(ids, counts.tolist(), strict=True)):
            if (own := source(i, n)) is not None:
                place[first[k] : first[k] + n] = first[k] + own
    code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[place]
    found = runs_of(code, row)
    late = np.zeros(len(row) + 1, np.int64)
    for own in found.values():
        for s, q, n in own:
            late[s + q] += 1
            late[s + n] -= 1
    kept = np.cumsum(late)[:-1] == 0
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(texts)))]).astype(np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words.take(pa.array(place[kept]))), " ")
    for k, text in enumerate(joined.cast(pa.binary()).to_pylist()):
        yield [(s - int(first[k]), q, n) for s, q, n in found.get(k, [])], text


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", source: Callable | None = None) -> DataFrame:
    """``key, runs, collapsed``: every run (start, period, length, by start, then
    period), and the text without the words that repeat earlier ones, joined by a
    space. ``source(key, n)`` may give the places that the words come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["start", "period", "length"]
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in names]))
        for batch in batches:
            for part in parts(batch, 1):
                rows = [([dict(zip(names, r, strict=True)) for r in runs], t.decode()) for runs, t in _scanned(part.column(0).to_pylist(), part.column(1), source)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r for r, _ in rows], kind), pa.array([t for _, t in rows], pa.string())], names=["k", "runs", "collapsed"])

    only = docs.select(F.col(key).alias("k"), text_of(docs, text).alias("t"))
    schema = f"k {dict(only.dtypes)['k']}, runs array<struct<start: bigint, period: bigint, length: bigint>>, collapsed string"
    return map_batches(only, run, schema).withColumnRenamed("k", key)


def _digests(found: DataFrame) -> DataFrame:
    """The strongest run and the digests of ``periodic_runs``, as rows are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for runs, text in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                rows = [(r["start"], r["period"], r["length"]) for r in runs]
                s, q, n = min(rows, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1])) if rows else (None, None, None)
                said = "".join(f"{s},{n},{q}\n" for s, q, n in rows)
                out.append((len(rows), s, n, q, None if n is None else 1000 * n // q, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
            kinds = [*[pa.int64()] * 5, pa.string(), pa.string()]
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["k", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    key = found.columns[0]
    schema = f"k {dict(found.dtypes)[key]}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return map_batches(found, run, schema).withColumnRenamed("k", key)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document, the strongest of each and the texts without repeats."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    return _digests(periodic_runs(docs, source=repeated_by_id))
