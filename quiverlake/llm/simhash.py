"""SimHash near-duplicates by covering anchors.

Fingerprints have 64 bits; a link is two differing bits or fewer. The anchors are words of four perfect codes, each of which
covers its bits: two binary Golay codes (23 bits, 4,096 words, covering radius 3) over bits 0-22 and 23-45, and two Hamming
codes (7 bits, 16 words, radius 1) over bits 46-52 and 53-59. Every fingerprint is within the radius of one word in each
block, and of no other. Take two linked fingerprints and a fingerprint half way: each differs from it in one bit at most, so
both lie within the radius of its anchor in each block, but for one block where one bit more may be needed. Each
fingerprint therefore goes to its own anchor and to those that need one bit more in one block (14.9 of 2**32 on average),
linked fingerprints meet at an anchor, and only there are they compared, in all 64 bits.

An anchor compares all its rows, and returns what it finds as a spanning forest, at most one edge for each row. What has more
than ``HOT`` distinct fingerprints, more than one task should compare, is exact in another way: each fingerprint is tied to
the 64 words one bit from it, which become nodes of the graph, and the components are found as for any other edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import join_once, stored, with_columns

#: Fixed values, which the proof above needs: the differing bits of a link; of each block its first bit, the bits of its
#: words, its radius and its code's generator (x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 and x^3 + x + 1).
THRESHOLD = 2
GOLAY, HAMMING = (23, 3, 0b101011100011), (7, 1, 0b1011)
BLOCKS = ((0, *GOLAY), (23, *GOLAY), (46, *HAMMING), (53, *HAMMING))
#: Distinct fingerprints of an anchor that one task compares, and how many of them at a time.
HOT, TILE = 20_000, 1_024
SEED = 42
#: Each single bit.
FLIPS = np.uint64(1) << np.arange(64, dtype=np.uint64)


# --- fingerprints ---------------------------------------------------------------------------------------------------
def fingerprint(text: str, width: int = 3) -> int:
    """The SimHash of the text's ``width``-word shingles; 0 for a text without words."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only U+0020 and U+0009 to U+000D part words
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    first = (ends - np.array([len(w) + 1 for w in words])).tolist()
    last = (ends - 1).tolist()[width - 1 :] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=False)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", width: int = 3, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``fingerprint``, the 64 bits as a signed long. A null text counts as empty."""

    def make(texts: pa.Array) -> dict:
        return {"fingerprint": pa.array(np.array([fingerprint(t or "", width) for t in texts.to_pylist()], np.uint64).view(np.int64))}

    return with_columns(df, [text], "fingerprint long", make, drop)


# --- anchors --------------------------------------------------------------------------------------------------------
@lru_cache(maxsize=2)
def _code(bits: int, radius: int, generator: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a perfect cyclic code: the syndrome of each word; the pattern of weight up to the radius with each syndrome; the
    patterns with one bit more, sorted by syndrome; and where each syndrome's begin."""
    check = generator.bit_length() - 1

    def remainder(x: int) -> int:
        for k in range(bits - 1, check - 1, -1):
            if x >> k & 1:
                x ^= generator << (k - check)
        return x

    unit, syndrome = [remainder(1 << k) for k in range(bits)], np.zeros(1 << bits, np.int16)
    for k in range(bits):
        syndrome[1 << k : 2 << k] = syndrome[: 1 << k] ^ unit[k]
    patterns = lambda weight: np.array([sum(1 << b for b in chosen) for chosen in combinations(range(bits), weight)], np.int64)
    leader, far = np.zeros(1 << check, np.int64), patterns(radius + 1)
    for weight in range(radius + 1):
        leader[syndrome[patterns(weight)]] = patterns(weight)
    far = far[np.argsort(syndrome[far], kind="stable")]
    return syndrome, leader, far, np.searchsorted(syndrome[far], np.arange((1 << check) + 1))


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For unsigned fingerprints: the anchor of each replica, its blocks' words where those blocks are, and the place of its
    fingerprint in ``fp``."""
    blocks = [(start, (fp >> np.uint64(start)).astype(np.int64) & ((1 << bits) - 1), _code(bits, radius, generator)) for start, bits, radius, generator in BLOCKS]
    homes = [(word ^ code[1][code[0][word]]) << start for start, word, code in blocks]
    home = np.bitwise_or.reduce(homes) if len(fp) else np.zeros(0, np.int64)
    out, own = [home], [np.arange(len(fp))]
    for k, (start, word, (syndrome, _, far, begin)) in enumerate(blocks):
        s = syndrome[word].astype(np.int64)
        n = begin[s + 1] - begin[s]
        row = np.repeat(np.arange(len(fp)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        out.append(home[row] ^ homes[k][row] ^ (word[row] ^ far[begin[s][row] + nth]) << start)
        own.append(row)
    return np.concatenate(out), np.concatenate(own)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (jump := label[label]).tobytes() != label.tobytes():
            label = jump
        if (before == label).all():
            break
    return label


def _forest(anchor: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links in each anchor's run of distinct fingerprints: all pairs of a run are
    compared, short runs side by side, long ones in tiles."""
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(anchor)])
    left, right = [], []
    short = np.repeat(sizes <= TILE // 4, sizes)
    for shift in range(1, int(min(TILE // 4, sizes.max()))):
        i = np.flatnonzero(short[:-shift] & (anchor[shift:] == anchor[:-shift]))
        i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= THRESHOLD]
        left.append(i)
        right.append(i + shift)
    for s, n in zip(starts[sizes > TILE // 4].tolist(), sizes[sizes > TILE // 4].tolist(), strict=True):
        for a in range(s, s + n, TILE):
            for b in range(a, s + n, TILE):
                i, j = np.nonzero(np.bitwise_count(fp[a : min(a + TILE, s + n), None] ^ fp[None, b : min(b + TILE, s + n)]) <= THRESHOLD)
                # of the links of a tile a spanning forest is enough
                root = _roots(2 * TILE, i, j + TILE)
                tied = np.flatnonzero(root != np.arange(2 * TILE))
                place = lambda x, a=a, b=b: np.where(x < TILE, a + x, b + x - TILE)
                left.append(place(tied))
                right.append(place(root[tied]))
    if not left:
        return fp[:0], fp[:0]
    root = _roots(len(fp), np.concatenate(left), np.concatenate(right))
    tied = np.flatnonzero(root != np.arange(len(fp)))
    return fp[tied], fp[root[tied]]


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the distinct ``fingerprint`` values just as all links within the threshold do. Words one bit
    from a crowded anchor's fingerprints may be among the nodes; they tie nothing else."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            anchor, own = anchors(fp.view(np.uint64))
            for k in range(0, len(anchor), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(anchor[k : k + (1 << 16)]), pa.array(fp[own[k : k + (1 << 16)]])], ["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, fp, hot = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        rows = lambda u, v: pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        def spread(fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(fp), 1_000):
                part = fp[k : k + 1_000]
                yield rows(np.repeat(part, 64), (part[:, None] ^ FLIPS).ravel())

        for batch in batches:
            anchor = np.r_[anchor, batch.column(0).to_numpy()]
            fp = np.r_[fp, batch.column(1).to_numpy().view(np.uint64)]
            if hot is not None:  # the rest of an anchor that is too large for one task
                n = int(np.searchsorted(anchor, hot, "right"))
                yield from spread(fp[:n])
                anchor, fp = anchor[n:], fp[n:]
                hot = hot if not len(anchor) else None
            if not len(anchor):
                continue
            n = int(np.searchsorted(anchor, anchor[-1]))
            if n:
                yield rows(*_forest(anchor[:n], fp[:n]))
            anchor, fp = anchor[n:], fp[n:]
            if len(anchor) > HOT:
                yield from spread(fp)
                hot, anchor, fp = anchor[-1], anchor[:0], fp[:0]
        if len(anchor):
            yield rows(*_forest(anchor, fp))

    replicas = distinct.select("fingerprint").mapInArrow(replicate, "anchor long, fp long")
    n = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return replicas.repartition(n, "anchor").sortWithinPartitions("anchor", "fp").mapInArrow(compare, "u long, v long")


# --- classes --------------------------------------------------------------------------------------------------------
def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id, text_key (a hash of the text), fingerprint (signed long), class (one of its fingerprints) and component_id
    of each row: the smallest doc_id that it reaches by links, its own included.

    Null and empty texts have fingerprint 0 and are linked by it like any other. Rows may repeat; rows with a null
    doc_id belong to their class, whose component_id is null if no member has an id. An empty table gives no row.
    Classes are made of distinct fingerprints, so copies cost one row each, whatever their number.
    """
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = stored(fingerprints(rows.withColumn("text_key", F.xxhash64("text")), width=width, drop=("text",)), "fingerprints")
    distinct = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least_doc"))
    parts = connected_components(links(distinct))
    known = distinct.join(parts, distinct.fingerprint == parts.node, "left").select("fingerprint", "least_doc", F.coalesce("root", "fingerprint").alias("class"))
    known = stored(known, "classes")
    known = join_once(known, known.groupBy("class").agg(F.min("least_doc").alias("component_id")), "class")
    return join_once(rows, stored(known.select("fingerprint", "class", "component_id"), "classes"), "fingerprint")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each class the row with the smallest doc_id stays (of rows that
    repeat it, one), as it is, with all its columns, whatever their names. A class of rows without an id keeps the one whose text has
    the smallest hash; an empty table stays empty.

    Who stays is decided on ids and hashes. Whole rows are shuffled once: repeated ones are combined before it, and the
    semi join with those who stay finds them already dealt by its keys.
    """
    classes = near_duplicates(df, doc_id, text, width)
    first = classes.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("best"))
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("none"))
    stays = first.select(named(F.col("best.doc_id")).alias("__doc"), F.col("best.text_key").alias("__key"))
    keyed = df.withColumns({"__doc": named(F.col(f"`{doc_id}`")), "__key": F.xxhash64(F.col(f"`{text}`"))})
    return keyed.dropDuplicates(["__doc", "__key"]).join(stays, ["__doc", "__key"], "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
