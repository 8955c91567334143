"""Removal of passages that repeat across documents, byte by byte.

Texts are UTF-8 bytes. A byte goes where a string of K bytes around it also starts in
a document with a smaller id. Equal strings of K bytes are found by breadth-first
backward extension on a Burrows-Wheeler transform: from the interval of the empty
string, every interval of a string of n bytes is extended to the left by each byte
that precedes it, and the borders that appear so are common prefixes of n bytes. They
appear by increasing value, each once, and the search stops at K: suffixes that no
border parts share K bytes.

No transform of the whole corpus is built. Each string of K bytes belongs to the
smallest hash among its substrings of M bytes, so equal strings meet wherever that
hash is dealt to, and those that follow each other and share it travel as one stretch.
Four steps do this:

1. Texts are written once, in blocks, as a table bucketed by block: later steps read
   it without moving a text. Whole copies of a text with a smaller id are found by
   digest; all of their bytes go, and they take no further part.
2. Each block sends its different hashes, packed by range of hashes; a range answers
   each block with those that other documents have too.
3. Each block sends its different stretches with those hashes. A hash that has more
   than COMMON places, such as that of a common phrase, is split: its strings of K
   bytes go by a hash of their own, so that no range holds a frequent hash's contexts.
4. A range leaves out the strings that no other document of it can have: the smallest
   hash's substring and SIDE bytes on one side of it, which every string holds on its
   left or on its right, are in one document alone. These are most of those that share
   no more than a hash, whose part grows with the corpus. It builds the transform of
   what is left of its stretches, finds the smallest id that has each string, and
   answers each block with the bytes to remove.

Ranges and blocks have a bounded size whatever the corpus, for their number follows
its size. Equal stretches of a block are sent once.

Defined cases: a null text is empty, and has no bytes to lose; null ids count as
larger than all, and as equal to each other; rows that share an id do not remove each
other's bytes; repeated rows give repeated result rows; an empty table gives an empty
result; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, new_path, ship, table, text_of

K, M = 50, 16
#: Bytes of text in a block, in a range of hashes, in a range of stretches, in a piece.
BLOCK, HASHES, STRETCHES, PIECE = 4 << 20, 32 << 20, 5 << 19, 1 << 20
COMMON = 4096
#: Of the K - M bytes of a string around its substring of M, one side holds so many.
SIDE = (K - M) // 2
#: In place of the substring's place, for a string that goes by a hash of its own.
ALONE = 255
#: No UTF-8 text holds this byte: it stands between stretches.
END = 0xFF
LAST = 2**63 - 1
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_BITS = 48


# --- common prefixes on one range ---


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of 42-bit keys (or of any, where there are over 2**21), and dense ranks."""
    n = len(key)
    if n <= 1 << 21:
        both = np.sort((key << np.uint64(21)) | np.arange(n, dtype=np.uint64))
        order, key = (both & np.uint64((1 << 21) - 1)).astype(np.int64), both >> np.uint64(21)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    rank = np.empty(n, np.uint64)
    rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])).astype(np.uint64)
    return order, rank


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the ``depth`` bytes from each on, around the end."""
    n = len(data)
    key = np.zeros(n, np.uint64)
    for i in range(5):
        key = (key << np.uint64(8)) | np.roll(data, -i)
    order, rank = _ranked(key)
    known, shift = 5, np.uint64(21 if n <= 1 << 21 else 32)
    while known < depth:
        step = min(known, depth - known)
        order, rank = _ranked((rank << shift) | np.roll(rank, -step))
        known += step
    return order


def borders(bwt: np.ndarray, depth: int) -> np.ndarray:
    """Where, in suffix order, two neighbours share fewer than ``depth`` bytes, of
    suffixes that hold no END within them: intervals are extended by increasing length,
    and one goes on while its last extension has shown a border."""
    n = len(bwt)
    by_byte = np.argsort(bwt, kind="stable").astype(np.int32)
    forward = np.empty(n, np.int32)
    forward[by_byte] = np.arange(n, dtype=np.int32)
    same = bwt[by_byte[1:]] == bwt[by_byte[:-1]]
    before, after = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    before[by_byte[1:]] = np.where(same, by_byte[:-1], -1)
    after[by_byte[:-1]] = np.where(same, by_byte[1:], n)
    text = bwt != END
    shown = np.full(n + 1, 255, np.uint8)
    shown[0] = shown[n] = 254
    low, high = np.array([0], np.int32), np.array([n], np.int32)
    for common in range(depth):
        sizes = high - low
        upto = np.cumsum(sizes, dtype=np.int64)
        if not len(upto):
            break
        j = np.arange(upto[-1], dtype=np.int32) + np.repeat((low - (upto - sizes)).astype(np.int32), sizes)
        use = text[j]
        first, last = use & (before[j] < np.repeat(low, sizes)), use & (after[j] >= np.repeat(high, sizes))
        low, high = np.sort(forward[j[first]]), np.sort(forward[j[last]]) + np.int32(1)
        shown[low[shown[low] == 255]] = common
        shown[high[shown[high] == 255]] = common
        on = (shown[low] == common) | (shown[high] == common)
        low, high = low[on], high[on]
    return shown[:n] != 255


def smallest_ids(data: np.ndarray, owner: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each of the strings of K bytes in stretches of ``sizes`` bytes (``data``, with
    END after each), the smallest ``owner`` of a stretch that has it."""
    n = len(data)
    starts = np.cumsum(sizes + 1) - sizes - 1
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    ids = np.full(n, LAST, np.int64)
    ids[at] = np.repeat(owner, counts)
    order = suffix_order(data, K)
    edge = borders(data[order - 1], K)
    least = np.minimum.reduceat(ids[order], np.flatnonzero(edge))
    found = np.empty(n, np.int64)
    found[order] = least[np.cumsum(edge) - 1]
    return found[at]


# --- stretches of texts ---


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(len(data) + 8, np.uint64)
    for r in range(8):
        own = padded[r : r + (len(padded) - r) // 8 * 8].view("<u8")
        out[r::8] = own[: len(out[r::8])]
    return out[: len(data)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MUL[2]
    return (x ^ (x >> np.uint64(29))) >> np.uint64(64 - _BITS)


def _lowest(hashes: np.ndarray, start: int) -> np.ndarray:
    """For each string of K bytes its smallest hash and, in the last 16 bits, where the
    first of those is, with places counted from ``start``."""
    x = (hashes << np.uint64(16)) | (np.arange(start, start + len(hashes), dtype=np.uint64) & np.uint64(0xFFFF))
    width, wide = 1, K - M + 1
    n = len(hashes) - wide + 1
    while 2 * width <= wide:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:n], x[wide - width :][:n]) if width < wide else x


def minima(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of the strings of K bytes that start at ``valid`` places: first place,
    number of strings, smallest hash, and where in the stretch the substring with it is
    (in equal strings at the same place); last, the eight bytes from each place."""
    eights = _eights(data)
    n = len(data) - K + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), eights[:0], np.zeros(0, np.uint8), eights
    hashes = _mixed(eights[: n + K - M] * _MUL[0] ^ eights[M // 2 :][: n + K - M] * _MUL[1])
    x = _lowest(hashes, 0)
    # around each place where 16 bits start anew, the first is found by other numbers
    half = 1 << 15
    for turn in range(1 << 16, n + K - M, 1 << 16):
        a, b = turn - (K - M), min(turn, n)
        if a < b:
            y = _lowest(hashes[a : b + K - M], a + half)
            x[a:b] = (y >> np.uint64(16) << np.uint64(16)) | ((y + np.uint64(half)) & np.uint64(0xFFFF))
    ok = valid[:n]
    new = ok.copy()
    new[1:] &= (x[1:] != x[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new)
    ends = np.flatnonzero(ok & ~np.concatenate([ok[1:] & ~new[1:], [False]]))
    # smallest hashes are small ones: mixed again, they spread over the ranges
    spot = ((x[first].astype(np.int64) - first) & 0xFFFF).astype(np.uint8)
    return first, ends - first + 1, _mixed((x[first] >> np.uint64(16)) * _MUL[1]), spot, eights


def pieces_of(texts: pa.Array, skip: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of the texts of rows not in ``skip``, of about PIECE bytes: bytes, which
    places start a string of K bytes here, and row and place in the text of each byte.
    Parts of a long text overlap by K - 1 bytes; each string starts in one."""
    data, offsets = _buffer(texts)
    rows = np.flatnonzero((np.diff(offsets) >= K) & ~skip)
    todo: list[tuple[int, int, int]] = []
    size = 0
    for r in rows.tolist():
        n = int(offsets[r + 1] - offsets[r])
        for a in range(0, n - K + 1, PIECE):
            b = min(a + PIECE, n - K + 1)
            todo.append((r, a, b))
            size += b - a
            if size >= PIECE:
                yield _piece(data, offsets, todo)
                todo, size = [], 0
    if todo:
        yield _piece(data, offsets, todo)


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _piece(data: np.ndarray, offsets: np.ndarray, todo: list[tuple[int, int, int]]):
    r, a, b = (np.array(x, np.int64) for x in zip(*todo, strict=True))
    sizes = b - a + K - 1
    bytes_ = np.concatenate([data[offsets[i] + s : offsets[i] + e + K - 1] for i, s, e in todo])
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return bytes_, within < np.repeat(b - a, sizes), np.repeat(r, sizes).astype(np.int32), (within + np.repeat(a, sizes)).astype(np.int32)


def _gathered(data: np.ndarray, first: np.ndarray, sizes: np.ndarray, end: bool) -> np.ndarray:
    """The bytes of stretches, one after the other, with END behind each if asked."""
    room = sizes + end
    out = np.full(room.sum(), END, np.uint8)
    shift = np.repeat(np.cumsum(room) - room, sizes) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    within = np.arange(sizes.sum())
    out[within + shift] = data[within + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)]
    return out


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Values that follow each other as one binary value for so many each: blocks and ranges
    meet in pairs, whose number grows with the square of the corpus, so no pair is looped over."""
    return _binary(np.ascontiguousarray(values).view(np.uint8), counts * values.itemsize).cast(pa.binary())


def _joined(group: pa.Table, name: str, kind) -> np.ndarray:
    """The values of a binary column, one after the other."""
    column = group.column(name)
    parts = [data[offsets[0] : offsets[-1]] for data, offsets in map(_buffer, column.chunks) if len(offsets) > 1]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint8)).view(kind)


def _short(h: np.ndarray) -> np.ndarray:
    """Hashes as six bytes each."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").ravel()


def _long(six: np.ndarray) -> np.ndarray:
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six.view(np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(_BITS - 32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _cuts(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of equal neighbours."""
    start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    return start, np.concatenate([start[1:], [len(of)]]).astype(np.int64)


# --- the steps ---


COPIES, SHARED, SPANS = 0, 1, 2


def written(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts in blocks, as a table in the shared folder that is bucketed by block."""
    spark = docs.sparkSession

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, size, rows = TaskContext.get().partitionId() << 24, 0, 0
        for batch in batches:
            lengths = np.diff(_buffer(batch.column(1))[1])
            at = np.concatenate([[0], np.cumsum(lengths)[:-1]]) + size
            nth = at // BLOCK
            size += int(lengths.sum())
            place = np.arange(batch.num_rows) + rows
            rows += batch.num_rows
            columns = [pa.array(block + nth), pa.array(place), pa.array(lengths)]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns], names=["block", "place", "n", "id", "t"])

    only = docs.select(F.col(key).cast("long").alias("id"), text_of(docs, text).alias("t"))
    dealt = map_batches(only, deal, "block long, place long, n long, id long, t string").withColumn("digest", F.unhex(F.sha2("t", 256)))
    name = f"passages_{uuid.uuid4().hex}"
    buckets = min(max(1, only.rdd.getNumPartitions()), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    dealt.write.bucketBy(buckets, "block").format("parquet").option("compression", "zstd").option("path", new_path(spark, "passages")).saveAsTable(name)
    return spark.table(name)


def copies_of(texts: DataFrame) -> DataFrame:
    """``block, kind, a, b``: the rows of each block that are copies of a text with a
    smaller id."""
    ids = texts.where(F.col("n") >= K).select("block", "digest", F.struct(F.coalesce("id", F.lit(LAST)).alias("id"), "place").alias("x"))
    # a row for each block that has the text, which costs no exchange: then a text in many rows is one in many blocks
    per = ids.groupBy("block", "digest").agg(F.collect_list("x").alias("rows"), F.min("x.id").alias("low"), F.count(F.lit(1)).alias("m"))
    least = per.groupBy("digest").agg(F.min("low").alias("least"), F.sum("m").alias("m")).where("m > 1").select("digest", "least")
    later = F.filter("rows", lambda x: x["id"] > F.col("least"))
    found = per.join(least, "digest").select("block", F.explode(later).alias("x")).groupBy("block").agg(F.sort_array(F.collect_list("x.place")).alias("places"))
    to_bytes = lambda c: F.unhex(F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x), 16, "0")), ""))
    return found.select("block", F.lit(COPIES).alias("kind"), to_bytes("places").alias("a"), F.lit(None).cast("binary").alias("b"))


def _notes(right: pa.Table, kind: int) -> pa.Table:
    return right.filter(pa.array(right.column("kind").to_numpy() == kind))


def _block(left: pa.Table, right: pa.Table):
    """Rows of a block by place, and which of them are whole copies."""
    left = left.sort_by("place")
    places = left.column("place").to_numpy()
    skip = np.isin(places, _joined(_notes(right, COPIES), "a", ">i8"))
    texts = left.column("t").combine_chunks() if left.num_rows else pa.array([], pa.string())
    ids = left.column("id").fill_null(LAST).to_numpy()
    return left, texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts, ids, places, skip


HASHED = "range long, block long, a binary, b binary"


def _hashes(left: pa.Table, right: pa.Table, ranges: int) -> pa.Table:
    """The different hashes of a block: six bytes each, and two with how often it occurs
    (twice that, and one more if in several documents)."""
    found = []
    _, texts, ids, _, skip = _block(left, right)
    for data, valid, row, _ in pieces_of(texts, skip):
        first, _, h, *_ = minima(data, valid)
        found.append((h, ids[row[first]]))
    if not found:
        return pa.table({"range": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
    h, owner = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(h)
    h, owner = h[order], owner[order]
    start, end = _cuts(h)
    several = np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start)
    times = (2 * np.minimum(end - start, 32767) + several).astype("<u2")
    h = h[start]
    of = _range(h, ranges)
    s, e = _cuts(of)
    block = left.column("block")[0].as_py()
    return pa.table({"range": pa.array(of[s]), "block": pa.array(np.full(len(s), block)), "a": _packed(_short(h), e - s), "b": _packed(times, e - s)})


def _shared(group: pa.Table) -> pa.Table:
    """Of a range's hashes, those that several documents have, for each block that has
    them, and whether they are common."""
    h, times = _long(_joined(group, "a", "V6")), _joined(group, "b", "<u2").astype(np.int64)
    order = np.argsort(h, kind="stable")
    start, end = _cuts(h[order])
    several = (end - start > 1) | np.bitwise_or.reduceat(times[order] & 1, start).astype(bool)
    common = np.add.reduceat(times[order] >> 1, start) > COMMON
    keep, often = np.empty(len(h), bool), np.empty(len(h), bool)
    keep[order], often[order] = np.repeat(several, end - start), np.repeat(common, end - start)
    each = pc.binary_length(group.column("b")).to_numpy().astype(np.int64) // 2
    kept = np.add.reduceat(keep, np.cumsum(each) - each, dtype=np.int64)
    blocks, kept = group.column("block").to_numpy()[kept > 0], kept[kept > 0]
    return pa.table({"block": pa.array(blocks), "kind": pa.array(np.full(len(blocks), SHARED, np.int32)), "a": _packed(_short(h[keep]), kept), "b": _packed(often[keep].astype(np.uint8), kept)})


SENT = "range long, block long, strings binary, sizes binary, spots binary, times binary, rows binary, starts binary, ids binary"


def _stretches(left: pa.Table, right: pa.Table, ranges: int) -> pa.Table:
    """The different stretches of a block whose hash is shared, with their places."""
    _, texts, ids, places, skip = _block(left, right)
    notes = _notes(right, SHARED)
    shared, often = _long(_joined(notes, "a", "V6")), _joined(notes, "b", np.uint8).astype(bool)
    order = np.argsort(shared)
    shared, often = shared[order], often[order]
    out = []
    for data, valid, row, at in pieces_of(texts, skip) if len(shared) else ():
        first, counts, h, inner, eights = minima(data, valid)
        spot = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
        held = shared[spot] == h
        first, counts, h, inner, many = first[held], counts[held], h[held], inner[held], often[spot[held]]
        # strings of a common hash go one by one
        single = np.repeat(first[many] - (np.cumsum(counts[many]) - counts[many]), counts[many]) + np.arange(counts[many].sum())
        own = np.zeros(len(single), np.uint64)
        for i in (*range(0, K - 8, 8), K - 8):
            own = (own ^ eights[single + i]) * _MUL[0]
            own ^= own >> np.uint64(31)
        first = np.concatenate([first[~many], single])
        sizes = np.concatenate([counts[~many] + K - 1, np.full(len(single), K)])
        h = np.concatenate([h[~many], _mixed(own)])
        inner = np.concatenate([inner[~many], np.full(len(single), ALONE, np.uint8)])
        out.append((_gathered(data, first, sizes, False), sizes, inner, h, row[first], at[first]))
    names = [x.split()[0] for x in SENT.split(", ")]
    if not out or not sum(len(x[1]) for x in out):
        return pa.table({n: pa.array([], pa.int64() if i < 2 else pa.binary()) for i, n in enumerate(names)})
    data, sizes, inner, h, row, at = (np.concatenate(x) for x in zip(*out, strict=True))
    kind = _binary(data, sizes).dictionary_encode()
    code = kind.indices.to_numpy()
    order = np.lexsort((code, _range(h, ranges)))
    s, e = _cuts(code[order])
    lead = order[s]  # the first of each different stretch, by range
    strings = np.cumsum(sizes) - sizes
    of = _range(h[lead], ranges)
    a, b = _cuts(of)
    block = left.column("block")[0].as_py()
    places_of, of_range = e - s, [pa.array(of[a]), pa.array(np.full(len(a), block))]
    entries = np.add.reduceat(places_of, a)
    own = [
        _packed(_gathered(data, strings[lead], sizes[lead], False), np.add.reduceat(sizes[lead], a)),
        _packed(sizes[lead].astype(np.uint8), b - a), _packed(inner[lead], b - a), _packed(places_of.astype("<i4"), b - a),
        _packed(places[row[order]].astype("<i8"), entries), _packed(at[order].astype("<i4"), entries), _packed(ids[row[order]].astype("<i8"), entries),
    ]
    return pa.table([*of_range, *own], names=names)


def candidates(strings: np.ndarray, start: np.ndarray, spots: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which strings of K bytes of different stretches, from one to before another, may be
    in several documents: ``counts`` strings at ``start``, the substring with the smallest
    hash at ``spots``, smallest and largest id ``low`` and ``high``. Equal strings have
    that substring at the same place, so they share it with SIDE bytes on its left, if
    there are so many, or else on its right."""
    alone = spots == ALONE
    left = np.where(alone, 0, np.clip(spots.astype(np.int64) - SIDE + 1, 0, counts))
    eights = _eights(strings)

    def several(which: np.ndarray, back: int) -> np.ndarray:
        """Whether the M + SIDE bytes that begin so far before the substring are."""
        out = np.zeros(len(counts), bool)
        own = np.flatnonzero(which & ~alone)
        if len(own):
            at = start[own] + spots[own] - back
            key = np.zeros(len(own), np.uint64)
            for i in (*range(0, M + SIDE - 8, 8), M + SIDE - 8):
                key = (key ^ eights[at + i]) * _MUL[0]
                key ^= key >> np.uint64(31)
            order = np.argsort(key)
            s, e = _cuts(key[order])
            least, most = np.minimum.reduceat(low[own[order]], s), np.maximum.reduceat(high[own[order]], s)
            out[own[order]] = np.repeat(least != most, e - s)
        return out

    lower, upper = several(left > 0, SIDE), several(left < counts, 0)
    upper |= alone & (low != high)  # equal strings that go alone are one stretch
    return np.where(lower, 0, left), np.where(upper, counts, left)


def _repeated(group: pa.Table) -> pa.Table:
    """The bytes to remove that a range's stretches show, for each block."""
    sizes = _joined(group, "sizes", np.uint8).astype(np.int64)
    times = _joined(group, "times", "<i4").astype(np.int64)
    starts, ids = _joined(group, "starts", "<i4").astype(np.int64), _joined(group, "ids", "<i8")
    rows = _joined(group, "rows", "<i8")
    strings = _joined(group, "strings", np.uint8)
    each = pc.binary_length(group.column("sizes")).to_numpy().astype(np.int64)
    code = _binary(strings, sizes).dictionary_encode().indices.to_numpy()
    least, most = (f.reduceat(ids, np.cumsum(times) - times) for f in (np.minimum, np.maximum))
    by_code = np.argsort(code, kind="stable")
    s, _ = _cuts(code[by_code])
    lead = by_code[s]  # code 0, 1, ... of the different stretches
    counts = sizes[lead] - K + 1
    begin = np.cumsum(counts) - counts
    low, start = np.minimum.reduceat(least[by_code], s), (np.cumsum(sizes) - sizes)[lead]
    a, b = candidates(strings, start, _joined(group, "spots", np.uint8)[lead], counts, low, np.maximum.reduceat(most[by_code], s))
    own = np.flatnonzero(a < b)
    first = np.full(counts.sum(), LAST, np.int64)
    if len(own):
        few = (b - a)[own]
        data = _gathered(strings, (start + a)[own], few + K - 1, True)
        at = np.repeat((begin + a)[own] - (np.cumsum(few) - few), few) + np.arange(few.sum())
        first[at] = smallest_ids(data, low[own], few, few + K - 1)
    entry = np.repeat(np.arange(len(sizes)), times)
    # a flag for each place's strings, with a false one after the last
    n = counts[code[entry]]
    room = n + 1
    at = np.repeat(begin[code[entry]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    spot = np.arange(n.sum()) + np.repeat(np.arange(len(n)), n)
    flags = np.zeros(room.sum(), bool)
    flags[spot] = first[at] < np.repeat(ids, n)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags]).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    base = np.cumsum(room) - room
    place = np.searchsorted(base, a, "right") - 1
    spans = np.stack([rows[place], starts[place] + a - base[place], starts[place] + b - base[place] + K - 1], 1).astype("<i8")
    row = np.repeat(np.arange(len(each)), each)[entry[place]]
    i, j = _cuts(row)
    blocks = group.column("block").to_numpy()[row[i]]
    return pa.table({"block": pa.array(blocks), "kind": pa.array(np.full(len(i), SPANS, np.int32)), "a": _packed(spans.ravel(), 3 * (j - i)), "b": pa.nulls(len(i), pa.binary())})


def _kept(left: pa.Table, right: pa.Table) -> pa.Table:
    """``id, n, spans, kept`` of a block's rows."""
    left, texts, _, places, skip = _block(left, right)
    data, offsets = _buffer(texts)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    cover = np.zeros(len(data) + 1, np.int32)
    spans = _joined(_notes(right, SPANS), "a", "<i8").reshape(-1, 3)
    row = np.searchsorted(places, spans[:, 0])
    np.add.at(cover, offsets[row] + spans[:, 1], 1)
    np.add.at(cover, offsets[row] + spans[:, 2], -1)
    gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
    gone |= np.repeat(skip, np.diff(offsets))
    edge = gone.copy()
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    edge[1:] &= ~gone[:-1] | first[1:-1]
    last = gone.copy()
    last[:-1] &= ~gone[1:] | first[1:-1]
    a, b = np.flatnonzero(edge), np.flatnonzero(last) + 1
    own = np.searchsorted(offsets, a, "right") - 1
    pairs = pa.StructArray.from_arrays([pa.array(a - offsets[own]), pa.array(b - offsets[own])], names=["start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(offsets))).astype(np.int32)), pairs)
    left_over = np.concatenate([[0], np.cumsum(~gone)])[offsets]
    return pa.table({"id": left.column("id"), "n": left.column("n"), "spans": lists, "kept": _binary(data[~gone], np.diff(left_over)).cast(pa.binary())})


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, spans, kept``: the maximal spans of bytes to remove from each
    document (start, end), and the bytes that stay (which need not be whole characters)."""
    spark = docs.sparkSession
    ship(spark)
    texts = written(docs, key, text)
    size = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = lambda each: max(tasks, -(-size // each))
    copies = table(copies_of(texts), "copies")
    rows = texts.select("block", "place", "id", "t").groupBy("block")

    def with_notes(notes: DataFrame, run, schema: str) -> DataFrame:
        return rows.cogroup(notes.groupBy("block")).applyInArrow(run, schema)

    by_hash, by_stretch = ranges(HASHES), ranges(STRETCHES)
    hashes = with_notes(copies, lambda left, right: _hashes(left, right, by_hash), HASHED)
    shared = table(hashes.groupBy("range").applyInArrow(_shared, "block long, kind int, a binary, b binary"), "shared")
    sent = with_notes(copies.unionByName(shared), lambda left, right: _stretches(left, right, by_stretch), SENT)
    spans = table(sent.groupBy("range").applyInArrow(_repeated, "block long, kind int, a binary, b binary"), "spans")
    whole = texts.select("block", "place", "id", "n", "t").groupBy("block")
    found = whole.cogroup(copies.unionByName(spans).groupBy("block")).applyInArrow(_kept, "id long, n long, spans array<struct<start: bigint, end: bigint>>, kept binary")
    return found.select(F.col("id").alias(key), F.col("n").alias("n_bytes"), "spans", "kept")


def op12_repeated_passages(spark, sf_dir: str) -> DataFrame:
    """What goes from every document, and the digest of what stays."""
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
