"""Near-duplicates by ProbMinHash, banding and verification.

A document is the distribution of its five-word shingles, weighted by how often
each occurs; two documents are near-duplicates from a probability Jaccard of 0.8.
ProbMinHash lets every shingle arrive as a Poisson process at the rate of its
weight; an arrival goes to a random place of the signature, each place keeps its
first arrival, and a shingle stops once its next arrival is later than all kept
ones. Two signatures agree at a place with the probability of that Jaccard.

Exact copies are one node from the start. Signatures are cut into bands; in every
bucket of equal bands one central node is compared with each other one (a star,
never all pairs), by the exact similarity of their texts, if bitmaps of their shingles
leave it possible. Links join nodes into classes. What is not in its centre's class
gets a new centre, until a round of stars finds few links. Documents that still share a
bucket but no class are then compared as well, if they share one of their rarest
shingles, as all pairs at the threshold do, and their bitmaps leave it possible. So no
pair of a bucket goes unexamined that could still join two classes.

Defined cases: texts without a word are in no class but their own, a document of
fewer than five words is one shingle of them all; repeated rows and equal texts
share a class; a null id is an id like others and sorts last as a class id; an
empty table gives an empty result; other columns of the input are not read,
whatever their names. Nodes are 64-bit hashes of texts. Ids may be null or repeated,
so that two classes can have one ``class_id``; ``class_node`` tells them apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, map_batches, new_path, text_of

WORDS, THRESHOLD = 5, 0.8
#: A similarity of exactly the threshold counts, though sums of doubles fall short of it.
SLACK = 1e-9
#: 26 bands of 4: a pair at 0.8 is missed once in a million, one at 0.5 meets in four of five.
BANDS, ROWS_PER_BAND = 26, 4
PLACES = BANDS * ROWS_PER_BAND
ROWS = 64
#: Bits of a bitmap for each distinct shingle, at least.
BITS_EACH = 4
#: Words of the short bitmap that goes with every shingle of a document.
FEW = 8
TEXTS = "node long, total long, bits array<long>, few array<long>, t string"
#: Partners of one document that are compared in one place.
LOT = 256
#: Rounds of stars go on while one finds a link for every so many of the first round.
WORTH = 20
#: One in so many texts tells common shingles from rare ones, and so many shingles at
#: most (over two of them) are sent to all tasks as common: 16 bytes each.
SAMPLED, COMMON = 8, 100_000
#: Links of a task, at least, where classes are found: of two numbers each, so that few
#: links are one task without a shuffle, whatever the number of shuffle partitions.
LINKS = 100_000
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts together: each distinct shingle's text, hash and count."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[joined]
    before = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(~space & before)
    stops = np.flatnonzero(space & ~before)
    limits = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    owner = np.searchsorted(limits, starts, "right")
    if not len(starts):
        return np.zeros(0, int), np.zeros(0, U), np.zeros(0, int)
    # a word's hash: its bytes, each scrambled with its place in the word
    size = stops - starts
    inside = ~space
    place = np.arange(len(joined), dtype=np.int64)[inside] - np.repeat(starts, size)
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    word = _mix(np.add.reduceat(_mix(joined[inside].astype(U) + U(256) * place.astype(U)), at) + size.astype(U))
    n_words = np.bincount(owner, minlength=len(texts))
    span = np.minimum(n_words, WORDS)[owner]
    last = np.cumsum(n_words)[owner]
    first = np.arange(len(word))
    whole = first + span <= last
    run = np.zeros(len(word), U)
    for j in range(WORDS):
        used = j < span
        ahead = word[np.minimum(first + j, len(word) - 1)]
        run = np.where(used, _mix(run + ahead + U(j + 1)), run)
    owner, run = owner[whole], run[whole]
    order = np.lexsort((run, owner))
    owner, run = owner[order], run[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (run[1:] != run[:-1])])
    at = np.flatnonzero(new)
    return owner[at], run[at], np.diff(np.concatenate([at, [len(run)]]))


def signatures(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """n x PLACES: at each place the shingle that arrived first. ``owner`` has the
    document of each shingle; a document without shingles keeps zeros."""
    first = np.full(n * PLACES, np.inf)
    who = np.zeros(n * PLACES, U)
    live, clock, turn = np.arange(len(owner)), np.zeros(len(owner)), 0
    while len(live):
        turn += 1
        draw = _mix(shingle[live] + U(turn * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        uniform = ((draw >> U(11)).astype(np.float64) + 0.5) / (1 << 53)
        clock = clock - np.log(uniform) / count[live]
        slot = owner[live] * PLACES + (_mix(draw) % U(PLACES)).astype(np.int64)
        better = clock < first[slot]
        order = np.lexsort((clock[better], slot[better]))
        s, c, w = slot[better][order], clock[better][order], shingle[live][better][order]
        lead = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        first[s[lead]], who[s[lead]] = c[lead], w[lead]
        latest = first.reshape(n, PLACES).max(axis=1)
        stay = clock < latest[owner[live]]
        live, clock = live[stay], clock[stay]
    return who.reshape(n, PLACES)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """n x BANDS hashes of bands."""
    parts = signature.reshape(len(signature), BANDS, ROWS_PER_BAND)
    out = np.zeros(parts.shape[:2], U) + np.arange(1, BANDS + 1, dtype=U)
    for j in range(ROWS_PER_BAND):
        out = _mix(out + parts[:, :, j])
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact probability Jaccard of two (sorted shingles, counts): the sum over
    shared i of 1 / sum over j of max(a_j / a_i, b_j / b_i)."""
    (ha, ca), (hb, cb) = a, b
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = ca[ia] / ca.sum(), cb[ib] / cb.sum()
    only_a, only_b = 1 - x.sum(), 1 - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    # j up to i in that order count by b_j / b_i, the others by a_j / a_i
    low = np.cumsum(y)
    high = x.sum() - np.cumsum(x)
    return float((1 / ((only_a + high) / x + (only_b + low) / y)).sum())


def signed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, node, bands``: a row per document; no bands without words."""
    t = text_of(docs, text)
    only = docs.select(F.col(key).alias("id"), F.xxhash64(t).alias("node"), t.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                owner, shingle, count = shingles([x.encode() for x in part.column(2).to_pylist()])
                keys = band_keys(signatures(owner, shingle, count, part.num_rows)).view(np.int64)
                have = np.bincount(owner, minlength=part.num_rows) > 0
                offsets = np.concatenate([[0], np.cumsum(have * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, keys[have].ravel())], names=["id", "node", "bands"])

    return map_batches(only, run, f"id {dict(only.dtypes)['id']}, node long, bands array<long>")


def bitmap(shingle: np.ndarray, words: int | None = None) -> np.ndarray:
    """A bit for every distinct shingle, in ``words`` times 64 bits, by default the power
    of two that has BITS_EACH at least for each."""
    words = words or 1 << max(0, int(np.ceil(np.log2(max(len(shingle), 1) * BITS_EACH / 64))))
    place = _mix(shingle) & U(words * 64 - 1)
    out = np.zeros(words, U)
    np.bitwise_or.at(out, (place >> U(6)).astype(np.int64), U(1) << (place & U(63)))
    return out


def with_bits(texts: DataFrame) -> DataFrame:
    """``node, total, bits, few, t`` of ``node, t``: the number of shingles, repeats
    counted, the bitmap of the distinct ones, and that in FEW words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                owner, shingle, count = shingles([x.encode() for x in part.column(1).to_pylist()])
                edges = np.searchsorted(owner, np.arange(part.num_rows + 1))
                maps = [bitmap(shingle[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in maps])]).astype(np.int32)
                total = np.bincount(owner, count, part.num_rows).astype(np.int64)
                packed = pa.ListArray.from_arrays(offsets, np.concatenate(maps).view(np.int64))
                few = np.concatenate([bitmap(shingle[i:j], FEW) for i, j in zip(edges[:-1], edges[1:], strict=True)]).view(np.int64)
                small = pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * FEW, few)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total), packed, small, part.column(1)], names=["node", "total", "bits", "few", "t"])

    return map_batches(texts.select("node", "t"), run, TEXTS)


def may_reach(a: str, n_a: str, b: str, n_b: str, threshold: float) -> Column:
    """Whether two documents' bitmaps (columns ``a``, ``b``) and totals leave room for
    the threshold. A bit that only one has stands for a shingle that only it has, so
    this never says no to a pair that reaches the threshold. Of bitmaps of which one is
    twice as long, the longer is folded; a pair of other lengths passes."""
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, F.size(x)), lambda u, v: u.bitwiseOR(v))
    x, y = F.col(a), F.col(b)
    x, y = F.when(F.size(x) == 2 * F.size(y), half(x)).otherwise(x), F.when(F.size(y) == 2 * F.size(x), half(y)).otherwise(y)
    alone = lambda u, v: F.aggregate(F.zip_with(u, v, lambda i, j: F.bit_count(i.bitwiseAND(F.bitwise_not(j)))), F.lit(0), lambda s, z: s + z)
    # one over the most that is shared, null if nothing is
    share = lambda u, v, n: F.try_divide(F.col(n), F.col(n) - alone(u, v))
    fits = share(x, y, n_a) + share(y, x, n_b) <= 1 + 1 / threshold + SLACK
    return F.when(F.size(x) != F.size(y), True).otherwise(F.coalesce(fits, F.lit(False)))


def possible(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a, b`` that their bitmaps leave possible."""
    left = texts.select(F.col("node").alias("a"), F.col("total").alias("na"), F.col("bits").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("total").alias("nb"), F.col("bits").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(may_reach("x", "na", "y", "nb", threshold)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, similarity`` of every pair, from ``texts`` (node, t; a row per node).

    The partners of one ``a`` are dealt into lots of some LOT; its text goes once to
    each lot and stands before its partners there, which pass in a stream."""
    lots = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LOT).cast("int").alias("lots"))
    placed = pairs.join(lots, "a").select("a", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int").alias("lot"), "b")
    heads = placed.select("a", "lot").distinct().select("a", "lot", F.lit(None).cast("long").alias("b"), F.col("a").alias("node"))
    rows = heads.unionByName(placed.select("a", "lot", "b", F.col("b").alias("node"))).join(texts.select("node", "t"), "node")
    rows = rows.select("a", "lot", "b", "t").repartition("a", "lot").sortWithinPartitions("a", "lot", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                owner, shingle, count = shingles([x.encode() for x in part.column(3).to_pylist()])
                edges = np.searchsorted(owner, np.arange(part.num_rows + 1))
                found: list[tuple[int, int, float]] = []
                for a, b, i, j in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), edges[:-1], edges[1:], strict=True):
                    own = shingle[i:j], count[i:j]
                    if b is None:
                        head = own
                    else:
                        found.append((a, b, similarity(head, own)))
                columns = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "similarity"])

    return map_batches(rows, run, "a long, b long, similarity double")


def _often(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles and their counts of the COMMON most frequent ones in every
    SAMPLED-th of ``rows`` (node, t): counted by tasks, then by shingle."""
    sample = rows.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0).select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                keys, n = np.unique(shingles([x.encode() for x in batch.slice(at, ROWS).column(0).to_pylist()])[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    counts = cut(map_batches(sample, run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1"))
    least, room = 2, COMMON
    # how many shingles have each count: a row for each bit length of counts, 64 at most
    for bits, n in sorted(((r["bits"], r["n"]) for r in counts.groupBy(F.floor(F.log2("n")).alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        if n > room:
            least = 2 << bits
            break
        room -= n
    kept = counts.where(F.col("n") >= least).toArrow().sort_by("shingle")  # COMMON rows at most
    keys = np.asarray(kept["shingle"]).astype(np.int64).view(U)
    order = np.argsort(keys)
    return keys[order], np.asarray(kept["n"])[order]


def _sharing_rare(rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` with different labels among ``node, label, t`` that can still reach
    the threshold; every such pair is among them.

    With shared shingles of weight x in one document and y in the other, of 1 each, a
    similarity is at most 1 / (1/x + 1/y - 1). Put the shingles in one order for all;
    before the first that two documents share lie weights p and q, so x <= 1 - p and
    y <= 1 - q, and a pair may be left out unless a shared shingle has small enough p
    and q. Rare shingles come first, so that documents with nothing but a common
    passage between them do not meet. How common a shingle is comes from a sample; it
    decides the order alone, not the result. Bitmaps bound x and y once more, short ones
    in the join and the whole ones after it.
    """
    common = rows.sparkSession.sparkContext.broadcast(_often(rows))
    over = 1 - threshold + SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, often = common.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                owner, shingle, count = shingles([x.encode() for x in part.column(2).to_pylist()])
                rank = np.zeros(len(shingle), np.int64)
                if len(keys):
                    place = np.minimum(np.searchsorted(keys, shingle), len(keys) - 1)
                    rank = np.where(keys[place] == shingle, often[place], 0)
                order = np.lexsort((shingle, rank, owner))
                owner, shingle, count = owner[order], shingle[order], count[order]
                total = np.bincount(owner, count, part.num_rows)
                before = np.cumsum(count) - count  # weight ahead of each shingle in its text
                before = before - (np.cumsum(total) - total)[owner]
                lead = before <= over * total[owner]
                which = pa.array(owner[lead])
                ahead = pa.array(before[lead] / total[owner[lead]])
                yield pa.RecordBatch.from_arrays([pa.array(shingle[lead].view(np.int64)), part.column(0).take(which), part.column(1).take(which), ahead], names=["shingle", "node", "label", "ahead"])

    leads = cut(map_batches(rows.select("node", "label", "t"), run, "shingle long, node long, label long, ahead double"))
    met = leads.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("shingle")
    leads = cut(leads.join(met, "shingle").join(texts.select("node", "total", "few"), "node"))
    side = lambda node, label, ahead, total, few: leads.select("shingle", F.col("node").alias(node), F.col("label").alias(label), F.col("ahead").alias(ahead), F.col("total").alias(total), F.col("few").alias(few))
    both = side("a", "la", "p", "na", "x").join(side("b", "lb", "q", "nb", "y"), "shingle")
    both = both.where(f"la < lb and 1 / (1 - p) + 1 / (1 - q) <= {1 + 1 / threshold + SLACK!r}").where(may_reach("x", "na", "y", "nb", threshold))
    return possible(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), texts, threshold)


def components(links: DataFrame, n: int | None = None) -> DataFrame:
    """``node, label``: the smallest node that links (a, b; ``n`` of them) lead to, for
    every node in one. Labels pass along links and then jump to their own label's label,
    so the rounds grow with the logarithm of a class's reach, and their tasks with n."""
    parts = (links.count() if n is None else n) // LINKS + 1
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(parts))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")).coalesce(parts))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = cut(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")).coalesce(parts))
        moved = step.where("label <> old").limit(1).count()
        labels = step.select("node", "label")
        if not moved:
            return labels


#: Slots of a bitmap of hashes: 2 MB at most, however many hashes there are.
SLOTS = 1 << 24


def among(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows whose ``node`` may be one of those asked for: all that are, and of the others
    those whose slot is taken. The bitmap has a fixed size, so that every task can have it,
    and spares the texts that nothing asks for their way to a join."""
    slot = F.pmod("node", F.lit(SLOTS)) + 1
    # slots move, not bitmaps of one bit each
    slots = asked.select(slot.alias("s")).withColumn("part", F.bitmap_bucket_number("s")).repartition("part")
    bits = slots.groupBy("part").agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    place = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_slot", slot).withColumn("part", F.bitmap_bucket_number("_slot")).join(F.broadcast(bits), "part")
    return found.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*rows.columns)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id, node, class_id, class_node, copies, members``: a row per document;
    ``class_id`` is the smallest id of its class and ``class_node`` the smallest node
    with that id, which is in no other class; ``copies`` counts equal texts."""
    rows = cut(signed(docs, key, text))
    nodes = rows.groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands"))
    nodes = cut(nodes)
    banded = nodes.select("node", F.explode("bands").alias("band"))
    company = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(banded.join(company, "band"))
    company = met.groupBy("node").agg(F.sum("n").alias("company"))
    buckets = cut(met.select("band", "node").join(company, "node"))

    # one text for every node in a bucket with another
    asked_at = new_path(docs.sparkSession, "asked")
    company.select("node").join(nodes.select("node", "first"), "node").write.parquet(asked_at)
    # its size is known from here on: where it is small, Spark sends it to the texts, not them to it
    asked = docs.sparkSession.read.schema(nodes.select("node", "first").schema).parquet(asked_at)
    t = text_of(docs, text)
    all_texts = docs.select(F.xxhash64(t).alias("node"), F.col(key).alias("id"), t.alias("t"))
    texts = asked.join(among(all_texts, asked), "node").where(F.col("id").eqNullSafe(F.col("first"))).select("node", "t").dropDuplicates(["node"])
    spark, at = docs.sparkSession, new_path(docs.sparkSession, "texts")
    with_bits(texts).write.parquet(at)
    drop(spark, asked_at)
    texts = spark.read.schema(TEXTS).parquet(at)

    # stars: each bucket's centre against the others; then, of those that are in no class
    # of their centre, a new centre against the others, as long as that finds many links
    tried = links = labels = None
    left, first, linked = buckets, 0, 0
    while True:
        # the node with the most company over all its bands: an original has more than its copies
        centres = left.groupBy("band").agg(F.max_by("node", F.struct("company", "node")).alias("centre"))
        starred = cut(left.join(centres, "band"))
        star = starred.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
        if tried is not None:
            star = star.join(tried, ["a", "b"], "left_anti")
        star = cut(possible(star, texts, threshold))
        found = cut(verified(star, texts).where(F.col("similarity") >= threshold - SLACK).select("a", "b"))
        tried = star if tried is None else tried.union(star)
        n = found.count()
        linked += n
        found = cut(found.coalesce(n // LINKS + 1))
        links = found if links is None else links.union(found)
        if labels is not None and (not n or n * WORTH < first):
            break
        first = n if labels is None else first
        labels = components(links, linked)
        own = labels.select("node", "label")
        theirs = labels.select(F.col("node").alias("centre"), F.col("label").alias("of"))
        left = starred.where("node <> centre").join(own, "node", "left").join(theirs, "centre", "left")
        left = cut(left.where(F.coalesce("label", "node") != F.coalesce("of", "centre")).select("band", "node", "company"))

    if n:
        labels = components(links, linked)

    # what shares a bucket but no class
    seen = buckets.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    several = seen.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band")
    rest = seen.join(several, "band").select("node", "label").distinct()
    both_ways = tried.union(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = cut(_sharing_rare(rest.join(texts.select("node", "t"), "node"), texts, threshold).join(both_ways, ["a", "b"], "left_anti"))
    second = cut(verified(more, texts).where(F.col("similarity") >= threshold - SLACK).select("a", "b"))
    n = second.count()
    if n:
        labels = components(links.union(second.coalesce(n // LINKS + 1)), linked + n)
    drop(spark, at)

    own = nodes.join(labels, "node", "left").select("node", "first", "copies", F.coalesce("label", "node").alias("label"), F.size("bands").alias("n"))
    lead = F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("class_id"), F.col("node").alias("class_node")))
    classes = own.groupBy("label").agg(lead.alias("lead"), F.sum("copies").alias("members")).select("label", "lead.class_id", "lead.class_node", "members")
    named = own.join(classes, "label").select("node", "class_id", "class_node", "copies", "members", "n")
    out = rows.select("id", "node").join(named, "node")
    alone = F.col("n") == 0
    return out.select(
        "id",
        "node",
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("node")).otherwise(F.col("class_node")).alias("class_node"),
        F.when(alone, 1).otherwise(F.col("copies")).cast("long").alias("copies"),
        F.when(alone, 1).otherwise(F.col("members")).cast("long").alias("members"),
    )


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the one with the
    smallest id (of repeated rows, and of texts of a class with that id, one)."""
    # each class has its own node, though classes may share an id or have none
    leads = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node"))
    kept = near_duplicates(docs, key, text, **how).where(leads).select(F.col("id").alias("_id"), F.col("node").alias("_node"))
    # the join and the count after it have the same keys, none of them null, so that the texts move once
    by = ["_said", "_none", "_node"]
    named = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")).alias("_said"), F.col(c).isNull().alias("_none"))
    kept = kept.select(*named("_id"), "_node").distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *named(key), F.xxhash64(text_of(docs, text)).alias("_node"))
    one = row.join(kept, by).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(1)))).where("_n = 1")
    return one.select("row.*")


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_node", "copies", "members")
