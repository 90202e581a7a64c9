"""Token ids in directly addressable codes.

An id is cut into chunks, low bits first. Level k holds the k-th chunks of the ids that have one; a bitmap beside each
level but the last says which ids go on, and a rank directory (ones before every 512th bit) finds an id's place in the
next level. So any token is read with one chunk and at most one rank a level, and no block is decoded for it.

A corpus is a Parquet table of segments, each the image of one file: whole documents in ascending id order, closed after
``segment_tokens`` ids. Spark's committer writes it, so a task that runs twice leaves its segments once. The table is not
compressed, and its row groups are small and hold the least and largest document of theirs: ``get`` reads the bytes of
the segments that may hold a document, as they lie in the file, and of these the chunks of the tokens asked for.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import stored

MAGIC, BLOCK = b"QLDAC01\n", 512
#: Words and parts of words that a Python worker keeps (about 200 bytes each), and the longest of them in bytes.
CACHE_WORDS, CACHE_PARTS, CACHE_BYTES = 700_000, 400_000, 64
#: Up to so many segments (three numbers each), their starts are broadcast.
BROADCAST_SEGMENTS = 200_000
SEGMENT = "part int, segment int, first_doc long, last_doc long, tokens long, doc_ids array<long>, doc_lengths array<int>, image binary"
#: How segments lie in their files: as they are, in row groups of a few.
AS_THEY_ARE = {"compression": "none", "parquet.block.size": str(4 << 20), "parquet.enable.dictionary": "false"}


# --- the code -------------------------------------------------------------------------------------------------------
def pack(ids: np.ndarray, widths: tuple[int, ...] = (8, 8, 16)) -> bytes:
    """The image of ``ids`` (below 2 ** sum(widths)); widths are 8, 16 or 32 bits, and levels that no id needs are left out."""
    rest, levels = np.ascontiguousarray(ids, np.uint64), []
    if len(rest) and int(rest.max()) >> sum(widths):
        raise ValueError("an id needs more bits than the levels have")
    for k, width in enumerate(widths):
        chunks = (rest & np.uint64((1 << width) - 1)).astype(f"<u{width // 8}")
        rest = rest >> np.uint64(width)
        more = rest > 0
        last = k == len(widths) - 1 or not more.any()
        bits = b"" if last else np.packbits(more, bitorder="little").tobytes()
        levels.append((width, chunks.tobytes(), bits, _directory(bits)))
        if last:
            break
        rest = rest[more]
    out = [MAGIC, struct.pack("<QI", len(ids), len(levels))]
    out += [struct.pack("<IQQQ", w, len(c), len(b), len(d)) for w, c, b, d in levels]
    return b"".join(out + [part for _, *parts in levels for part in parts])


def _directory(bits: bytes) -> bytes:
    """Ones before each block of the bitmap."""
    padded = np.frombuffer(bits + b"\0" * (-len(bits) % (BLOCK // 8)), np.uint8).reshape(-1, BLOCK // 8)
    ones = np.bitwise_count(padded).sum(axis=1, dtype=np.uint64)
    return (np.cumsum(ones) - ones).astype("<u8").tobytes()


class Image:
    """A packed image: ``len(x)``, ``x[i]`` and ``x.all()``."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if view[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        self.n, n_levels = struct.unpack_from("<QI", view, len(MAGIC))
        at, sizes = len(MAGIC) + 12, []
        for _ in range(n_levels):
            sizes.append(struct.unpack_from("<IQQQ", view, at))
            at += 28
        self.levels = []
        for width, *lengths in sizes:
            parts = []
            for n in lengths:
                parts.append(view[at : at + n])
                at += n
            chunks, bits, ranks = parts
            self.levels.append((width, np.frombuffer(chunks, f"<u{width // 8}"), np.frombuffer(bits, np.uint8), np.frombuffer(ranks, "<u8")))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for width, chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            shift += width
            if not len(bits) or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            whole = bits[block * (BLOCK // 8) : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(whole).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        value, where, shift = np.zeros(self.n, np.uint64), None, 0
        for width, chunks, bits, _ in self.levels:
            part = chunks.astype(np.uint64) << np.uint64(shift)
            if where is None:
                value |= part
            else:
                value[where] |= part
            shift += width
            if len(bits):
                on = np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))
                where = on if where is None else where[on]
        return value


# --- texts to ids ---------------------------------------------------------------------------------------------------
_LETTERS, _MARKS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+", "[!-&(-/:-@\\[-`{-~]*"
#: A word of Latin letters that NFC keeps and that lose nothing in lower case, and ASCII marks without an apostrophe.
_PLAIN = re.compile(f"({_LETTERS})({_MARKS})").fullmatch


_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


def _byte_characters() -> dict[int, str]:
    """The characters that byte-level models have for bytes: printable ones stand for themselves, others follow U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


class Words(dict):
    """The ids of words, as little-endian 32-bit integers, by the words' bytes: looked up, or made when first met.

    For a tokenizer that never joins words across ASCII white space. Plain words, letters with ASCII marks after them, go to
    the library's BPE model as the two parts that the tokenizer cuts them into, lower-cased, and parts are kept too. This
    holds for tokenizers that normalise with NFC and lower case and cut by runs of letters, single numbers and runs of
    other marks; ``__init__`` tries it out, and if it doesn't hold, as for all other words, the whole tokenizer encodes the
    word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.parts, self.letters = Tokenizer.from_file(path), {}, _byte_characters()
        self.model = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        probe = ["Straße,", "THE!!", "naïve...", "Éß", "a|b", "word", "Ǆx.", "end)."]
        self.by_parts = True
        same = [self[w.encode()] for w in probe] == [self._whole(w) for w in probe]
        self.clear()
        self.by_parts = same and not any(_PLAIN(t) or _PLAIN("a" + t) for t in added)  # a plain word can't hold one

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        spelt = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        tokens = self.model.tokenize(spelt)
        pack_ids = _PACK[len(tokens)] if len(tokens) < len(_PACK) else struct.Struct(f"<{len(tokens)}I").pack
        ids = pack_ids(*[t.id for t in tokens])
        if len(part) <= CACHE_BYTES:
            self.parts[part] = ids
        return ids

    def __missing__(self, raw: bytes) -> bytes:
        word = raw.decode()
        if self.by_parts and (plain := _PLAIN(word)):
            letters, marks = plain.groups()
            letters, get = letters.lower(), self.parts.get
            ids = get(letters) or self._part(letters)
            if marks:
                ids += get(marks) or self._part(marks)
        else:
            ids = self._whole(word)
        if len(raw) <= CACHE_BYTES:
            self[raw] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        split = [t.encode().split() for t in texts]
        out = [b"".join(map(self.__getitem__, words)) for words in split]
        if len(self) > CACHE_WORDS:  # the words of these texts stay, common ones among them
            kept = {w: self[w] for w in set().union(*split) if w in self}
            self.clear()
            self.update(kept)
        if len(self.parts) > CACHE_PARTS:
            self.parts = {}
        return out


@lru_cache(maxsize=2)
def load(model: str) -> Words:
    import public_tokenizers

    return Words(model if os.sep in model else public_tokenizers.path(model))


# --- tables ---------------------------------------------------------------------------------------------------------
def write(
    df: DataFrame, model: str, end_id: int, partitions: int | None = None, segment_tokens: int = 1_000_000,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Encodes ``text`` in ascending ``doc_id`` order, ends each document with ``end_id``, and stores the segments.

    ``model`` is a tokenizers file whose tokens never hold white space. A null text is empty: its document holds the end
    id alone. Documents with a null id come first; rows with the same id stay, ordered by their texts' hashes. An empty
    table gives no segment. Other columns are not read, whatever their names. Texts are encoded where they are read; their
    ids, two bytes each where those hold them, are dealt out by ranges of document ids, whose bounds a pass over the
    ids of documents estimates first, and packed. Documents with one id may be spread over several ranges, by hash.
    """
    spark = df.sparkSession
    if partitions is None:
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("tie"), F.col(f"`{text}`").alias("text"))
    parts = 4 * partitions  # several for a task, so that their sizes even out
    least = np.iinfo(np.int64).min  # where null ids are
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    bounds = rows.agg(F.percentile_approx(F.coalesce("doc", F.lit(least)), shares, max(10_000, 10 * parts)).alias("b")).first().b
    bounds, end = np.array(bounds or [], np.int64), np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 32):  # few texts at a time stay in the processor's cache
                piece = batch.slice(at, 32)
                doc, tie = piece.column(0).fill_null(least).to_numpy(), piece.column(1).to_numpy()
                low, high = np.searchsorted(bounds, doc, "left"), np.searchsorted(bounds, doc, "right")
                part = low + ((tie.astype(float) / 2.0**64 + 0.5) * (high - low + 1)).astype(np.int64)  # grows with (doc, tie)
                ids = [np.frombuffer(raw + end, "<u4") for raw in words.encode([t or "" for t in piece.column(2).to_pylist()])]
                wide = [int(x.max()) >= 1 << 16 for x in ids]
                raws = [(x if w else x.astype("<u2")).tobytes() for x, w in zip(ids, wide, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(part, high).astype(np.int32)), piece.column(0), piece.column(1), pa.array(wide), pa.array(raws, pa.binary())], ["part", "doc", "tie", "wide", "ids"])

    encoded = rows.mapInArrow(encode, "part int, doc long, tie long, wide boolean, ids binary")
    dealt = encoded.repartition(partitions, "part").sortWithinPartitions("part", F.col("doc").asc_nulls_first(), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, docs, ids, tokens = None, 0, [], [], 0

        def segment() -> pa.RecordBatch:
            known = [d for d in docs if d is not None]
            return pa.RecordBatch.from_pylist([{
                "part": part, "segment": k, "first_doc": docs[0], "last_doc": known[-1] if known else None, "tokens": tokens,
                "doc_ids": docs, "doc_lengths": [len(x) for x in ids], "image": pack(np.concatenate(ids)),
            }], schema)

        for batch in batches:
            for own, doc, wide, raw in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True):
                if own != part:
                    if docs:
                        yield segment()
                    part, k, docs, ids, tokens = own, 0, [], [], 0
                docs.append(doc)
                ids.append(np.frombuffer(raw, "<u4" if wide else "<u2"))
                tokens += len(ids[-1])
                if tokens >= segment_tokens:
                    yield segment()
                    docs, ids, tokens, k = [], [], 0, k + 1
        if docs:
            yield segment()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SEGMENT))
    return stored(dealt.mapInArrow(run, SEGMENT), "tokens", **AS_THEY_ARE)


def get(segments: DataFrame, doc_id: int, positions: list[int]) -> DataFrame:
    """doc_id, position and token: the tokens at ``positions`` (from 0; the end id is the last) of a document.

    Only segments whose range of ids holds the document are read, by the statistics of their row groups; in a segment each
    token is read by itself, with no other decoded. A position that the document doesn't have gives no row, nor does a
    document that isn't there; rows that share the id give a row each, in no order; null ids can't be asked for.
    """
    asked = sorted(set(positions))
    near = segments.filter((F.col("last_doc") >= doc_id) & (F.col("first_doc").isNull() | (F.col("first_doc") <= doc_id))).select("doc_ids", "doc_lengths", "image")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, lengths, image in zip(*(batch.column(i) for i in range(3)), strict=True):
                lengths, image = np.array(lengths.as_py(), np.int64), Image(image.as_buffer())
                starts = np.cumsum(lengths) - lengths
                found = [(p, image[int(starts[at]) + p]) for at, doc in enumerate(docs.as_py()) if doc == doc_id for p in asked if 0 <= p < lengths[at]]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found), pa.int64()), pa.array([p for p, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())], ["doc_id", "position", "token"])

    return near.mapInArrow(run, "doc_id long, position long, token long")


def read(segments: DataFrame) -> DataFrame:
    """Of each document: doc_id, start (ids before it), n_tokens and its ids as little-endian 32-bit integers.

    Starts come from sums over each part's segments, and over the parts, of which there are four for each of write()'s
    partitions. The segments are counted first; the starts of up to ``BROADCAST_SEGMENTS`` are broadcast, so images are
    not shuffled for them.
    """
    sizes = segments.select("part", "segment", "tokens")
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before(Window.orderBy("part")).alias("part_start"))
    own = sizes.select("part", "segment", before(Window.partitionBy("part").orderBy("segment")).alias("own_start"))
    starts = own.join(parts, "part").select("part", "segment", (F.col("part_start") + F.col("own_start")).alias("start"))
    if sizes.count() <= BROADCAST_SEGMENTS:
        starts = F.broadcast(starts)
    rows = segments.join(starts, ["part", "segment"]).select("start", "doc_ids", "doc_lengths", "image")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, docs, lengths, image in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw, lengths = Image(image.as_buffer()).all().astype("<u4").tobytes(), np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(lengths)
                cut = (ends * 4).tolist()
                yield pa.RecordBatch.from_arrays([
                    docs.values, pa.array(start.as_py() + ends - lengths), pa.array(lengths),
                    pa.array([raw[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)], pa.binary()),
                ], ["doc_id", "start", "n_tokens", "ids"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def crc32(ids: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what read() returns."""
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


