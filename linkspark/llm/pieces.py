"""SentencePiece encoding and decoding that keeps byte offsets.

A text is normalised by longest prefixes through the model's compiled character
map (a double-array trie); every normalised byte keeps the place in the original
where its rule began. The pieces tile the normalised text, so their running
lengths, taken through that alignment, give each piece its span of original bytes.

Pieces are cut by the sentencepiece library. Where no piece of the model spans the
start of a new word and the model normalises nothing, words are independent; each
word is then encoded once in a task and remembered (a bounded memory), which gives
the same ids as encoding the whole text.

Defined cases: a null or empty text has no ids and decodes to the empty text;
repeated rows give repeated result rows; an empty table gives an empty result;
other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of

SPACE = "▁"
#: Words remembered by a Python worker, of so many characters at most (some 100 MB):
#: longer ones, as in texts without spaces, are encoded each time.
REMEMBERED, LONGEST = 400_000, 64
ROWS = 128


class CharacterMap:
    """Longest-prefix replacement through a compiled character map: four bytes of
    trie size, the trie's units, then the replacements, each ended by a zero."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Bytes matched at ``at`` (0: no rule) and their replacement."""
        units, place, found, value = self.units, 0, 0, 0
        if not units:
            return 0, b""
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        place = offset(units[0])
        for i in range(at, len(data)):
            place ^= data[i]
            if place >= len(units) or units[place] & 0x800000FF != data[i]:
                break
            unit = units[place]
            place ^= offset(unit)
            if unit >> 8 & 1:
                found, value = i + 1 - at, units[place] & 0x7FFFFFFF
        return found, self.texts[value : self.texts.index(b"\0", value)] if found else b""


class Normalizer:
    """Normalises as the model says and aligns the result with the original."""

    def __init__(self, spec, user_defined: list[bytes] = ()):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.own = sorted(user_defined, key=len, reverse=True)
        self.identity = not self.map.units and not self.squeeze and not self.own

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        for piece in self.own:
            if data.startswith(piece, at):
                return len(piece), piece
        n, new = self.map.longest(data, at)
        if n:
            return n, new
        b = data[at]
        n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        return n, data[at : at + n]

    def aligned(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and, for each and for their end, the original place."""
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.identity:
            return self._aligned_plain(data)
        space = SPACE.encode() if self.escape else b" "
        out, places, at, after_space = bytearray(), [], 0, self.squeeze
        if self.squeeze:
            while at < len(data):
                n, new = self._prefix(data, at)
                if new != b" ":
                    break
                at += n
            if at == len(data):
                return b"", np.full(1, at)
        if self.dummy:
            out += space
            places += [at] * len(space)
        while at < len(data):
            n, new = self._prefix(data, at)
            if after_space:
                new = new.lstrip(b" ")
            for b in new:
                add = space if b == 0x20 else bytes([b])
                out += add
                places += [at] * len(add)
            if new:
                after_space = self.squeeze and new.endswith(b" ")
            at += n
        end = at
        if self.squeeze:
            while out.endswith(space):
                end = places[-len(space)]
                del out[-len(space) :], places[-len(space) :]
        return bytes(out), np.array([*places, end], np.int64)

    def _aligned_plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Without rules: only the spaces' signs and the dummy prefix are longer."""
        raw = np.frombuffer(data, np.uint8)
        start = np.arange(len(raw))
        np.maximum.accumulate(np.where((raw & 0xC0) != 0x80, start, 0), out=start)
        wide = np.where(raw == 0x20, 3, 1) if self.escape else np.ones(len(raw), int)
        head = [0] * (0 if not self.dummy else 3 if self.escape else 1)
        space = SPACE.encode() if self.escape else b" "
        out = (space if self.dummy else b"") + (data.replace(b" ", space) if self.escape else data)
        return out, np.concatenate([head, np.repeat(start, wide), [len(raw)]]).astype(np.int64)


class Codec:
    """A model in a task."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        kinds = proto.SentencePiece
        texts = [p.piece for p in proto.pieces]
        self.unknown = {i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN}
        self.lengths = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.normalizer = Normalizer(proto.normalizer_spec, [p.piece.encode() for p in proto.pieces if p.type == kinds.USER_DEFINED])
        spec = proto.normalizer_spec
        #: words are independent: every piece has its space signs in front only
        self.by_word = (
            self.normalizer.identity and spec.add_dummy_prefix and spec.escape_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
            and proto.trainer_spec.byte_fallback and SPACE in texts and not any(SPACE in t.lstrip(SPACE) or "\n" in t for t in texts)
        )
        self.sign = texts.index(SPACE) if SPACE in texts else -1
        self.known: dict[str, bytes] = {}
        self.decimal = [b"%d," % i for i in range(len(texts))]

    def _learn(self, words: list[str]) -> None:
        # a word that begins with a line end has no space sign of its own in front
        asked = [w[1:] if w[:1] == " " and w.lstrip(" ")[:1] == "\n" else w for w in words]
        for word, ids in zip(words, self.library.encode(asked, num_threads=1), strict=True):
            if word[:1] == "\n":
                ids = ids[1:]
            # none: a space sign alone, at the end of the text or before another
            self.known[word] = array("i", ids or [self.sign]).tobytes()

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if not self.by_word:
            yield from (np.array(ids, np.int32) for ids in self.library.encode(texts, num_threads=1))
            return
        split = []
        for text in texts:
            plain = text.replace(SPACE, " ").replace("\n", " \n")  # no piece spans a line end
            words = plain.split(" ") if text else []
            if "" in words:  # each word with the spaces before it but the first
                words = [w[1:] for w in re.findall(" +[^ ]*", " " + plain)]
            split.append(words)
        known = self.known
        new = [w for w in set().union(*split) if w not in known]
        self._learn(new)
        for words in split:
            yield np.frombuffer(b"".join([known[w] for w in words]), np.int32)
        full = len(known) > REMEMBERED  # what came last is forgotten, the common words came first
        for w in new:
            if full or len(w) > LONGEST:
                del known[w]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each piece's bytes in the original."""
        normal, places = self.normalizer.aligned(text.encode())
        sizes = self.lengths[ids]
        if self.unknown and len(ids) and np.isin(ids, list(self.unknown)).any():  # as long as what they stand for
            sizes = np.array([len(p.encode()) if i in self.unknown else n for p, i, n in zip(self.library.encode(text, out_type=str), ids.tolist(), sizes.tolist(), strict=True)], np.int64)
        ends = np.cumsum(sizes)
        if (ends[-1] if len(ends) else 0) != len(normal):
            raise ValueError("the pieces do not tile the normalised text")
        return places[ends - sizes], places[ends]


@lru_cache(maxsize=1)
def codec_of(model: bytes) -> Codec:
    """The task's codec; later tasks of the same Python worker go on with it."""
    return Codec(model)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """A list of 32-bit numbers for each row, without a Python object for each number."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32))


def _mapped(docs: DataFrame, model_path: str, key: str, text: str, schema: str, rows_of) -> DataFrame:
    """Rows of ``rows_of(codec, keys, texts)`` for blocks of documents, in Arrow. The
    model is sent to the executors once, as a broadcast of its (fixed) size."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), *rows_of(codec, part.column(1).to_pylist())], names=names)

    only = docs.select(F.col(key).alias("k"), text_of(docs, text).alias("t"))
    kind = dict(only.dtypes)["k"]
    names = ["k", *[x.split()[0] for x in schema.split(", ")]]
    return map_batches(only, run, f"k {kind}, {schema}").withColumnRenamed("k", key)


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids, starts, ends``: the ids and each piece's bytes of the original."""

    def rows(codec: Codec, texts: list[str]):
        ids = list(codec.ids(texts))
        spans = [codec.spans(t, x) for t, x in zip(texts, ids, strict=True)]
        return [_lists(ids), _lists([s for s, _ in spans]), _lists([e for _, e in spans])]

    return _mapped(docs, model_path, key, text, "ids array<int>, starts array<int>, ends array<int>", rows)


def encode_checked(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text, ids, starts, ends, decodes``: as ``encode``, with the text and
    whether its ids decode to it."""

    def rows(codec: Codec, texts: list[str]):
        ids = list(codec.ids(texts))
        spans = [codec.spans(t, x) for t, x in zip(texts, ids, strict=True)]
        same = [(codec.library.decode(x.tolist()) if len(x) else "") == t for t, x in zip(texts, ids, strict=True)]
        return [pa.array(texts, pa.string()), _lists(ids), _lists([s for s, _ in spans]), _lists([e for _, e in spans]), pa.array(same, pa.bool_())]

    return _mapped(docs, model_path, key, text, "text string, ids array<int>, starts array<int>, ends array<int>, decodes boolean", rows)


def decode(encoded: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text`` from arrays of ids; a null array gives the empty text."""
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [codec.library.decode(x) if x else "" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    only = encoded.select(F.col(key).alias("k"), F.col(ids).alias("ids"))
    return map_batches(only, run, f"k {dict(only.dtypes)['k']}, text string").withColumnRenamed("k", key)


def round_trip(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes, projects and decodes in one pass, keeping digests only: ``n_tokens,
    ids_sha256, decoded_sha256, spans_sha256`` (of start:end joined by commas, as
    32-bit pairs) and ``aligned`` (the spans leave no byte of the text out)."""

    def rows(codec: Codec, texts: list[str]):
        out = []
        for t, ids in zip(texts, codec.ids(texts), strict=True):
            starts, ends = codec.spans(t, ids)
            numbers, decimal = ids.tolist(), codec.decimal
            said = b"".join([decimal[i] for i in numbers])
            decoded = codec.library.decode(numbers) if numbers else ""
            whole = not len(ids) and not t or bool(len(ids) and (starts[1:] == ends[:-1]).all() and starts[0] == 0 and ends[-1] == len(t.encode()))
            pairs = np.stack([starts, ends], 1).astype("<i4").tobytes()
            out.append((len(ids), hashlib.sha256(said[:-1]).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), hashlib.sha256(pairs).hexdigest(), whole))
        return [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()), strict=True)]

    return _mapped(docs, model_path, key, text, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, aligned boolean", rows)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids and the decoded text of every document, as digests."""
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
