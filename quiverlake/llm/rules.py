"""Quality rules with compression bands.

The zstandard ratio (compressed bytes over bytes) of the whole text and of its fixed chunks must lie in a band that
depends on the length: text that compresses far better than prose repeats itself, text that hardly compresses is noise.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .runtime import with_columns

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """For texts or chunks of at least ``size`` bytes: the ratio must be ``low`` to ``high``."""

    size: int
    low: float
    high: float


#: For texts of any kind. The limits widen as texts get shorter, where a ratio says little; below the first size there are none.
WHOLE = (Band(200, 0.18, 1.00), Band(500, 0.22, 0.90), Band(2_000, 0.22, 0.78), Band(10_000, 0.20, 0.72), Band(100_000, 0.18, 0.72))
CHUNK_BYTES, CHUNK, BAD_CHUNKS = 4_096, Band(4_096, 0.15, 0.75), 0.5
#: For texts like the labelled ones: what ``learn`` gives for the good documents of sf0.1 that pass the base rules and are not
#: held out. No labelled text has 50,000 bytes, so from there on the lower limit is that of any text, and chunks decide.
SIZES, MARGIN, LEAST_MARGIN = (200, 300, 500, 800, 1_200, 2_000, 3_500, 5_000, 10_000, 20_000, 50_000), 0.25, 0.02
LEARNT_WHOLE = (
    Band(200, 0.591, 0.871), Band(300, 0.556, 0.759), Band(500, 0.488, 0.721),
    Band(800, 0.474, 0.652), Band(1_200, 0.441, 0.587), Band(2_000, 0.437, 0.541),
    Band(3_500, 0.422, 0.503), Band(5_000, 0.404, 0.486), Band(10_000, 0.39, 0.464),
    Band(20_000, 0.383, 0.444), Band(50_000, 0.18, 0.444),
)
LEARNT_CHUNK, LEARNT_BAD_CHUNKS = Band(4_096, 0.427, 0.502), 0.1
_COMPRESS = zstandard.ZstdCompressor(level=3)


def ratio(raw: bytes) -> float:
    return len(_COMPRESS.compress(raw)) / len(raw) if raw else 1.0


def chunks(raw: bytes) -> list[bytes]:
    """The whole chunks of a text that has one, and a last window of the same size where bytes are left over."""
    parts = [raw[k : k + CHUNK_BYTES] for k in range(0, len(raw) - CHUNK_BYTES + 1, CHUNK_BYTES)]
    return parts + [raw[-CHUNK_BYTES:]] if parts and len(raw) % CHUNK_BYTES else parts


def learn(good: list[bytes], sizes: tuple[int, ...] = SIZES) -> tuple[tuple[Band, ...], Band]:
    """Limits of whole texts by size and of chunks: the range of the good texts, and on either side a quarter of its width
    more, 0.02 at least. A size without a good text has the upper limit of the size before, as ratios fall with length."""

    def band(size: int, found: list[float]) -> Band:
        margin = max(MARGIN * (max(found) - min(found)), LEAST_MARGIN)
        return Band(size, round(min(found) - margin, 3), round(max(found) + margin, 3))

    whole: list[Band] = []
    for size, after in zip(sizes, (*sizes[1:], np.inf), strict=True):
        found = [ratio(x) for x in good if size <= len(x) < after]
        high = whole[-1].high if whole else 1.0
        whole.append(band(size, found) if found else Band(size, min(b.low for b in WHOLE), high))
    return tuple(whole), band(CHUNK_BYTES, [ratio(p) for x in good for p in chunks(x)])


def band_verdict(raw: bytes, whole: tuple[Band, ...] = WHOLE, chunk: Band = CHUNK, bad_chunks: float = BAD_CHUNKS) -> tuple[float, int, int, bool]:
    """The whole ratio, the number of chunks, how many are outside ``chunk``, and whether the text is kept."""
    own = ratio(raw)
    band = next((b for b in reversed(whole) if len(raw) >= b.size), None)
    ok = band is None or band.low <= own <= band.high
    parts = chunks(raw)
    outside = sum(not chunk.low <= ratio(p) <= chunk.high for p in parts)
    return own, len(parts), outside, ok and outside <= bad_chunks * len(parts)


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    words = text.encode().split()  # bytes: parted by U+0020 and U+0009 to U+000D only
    spaces = sum(map(text.count, " \t\n\r\v\f"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.encode().split()] if "\n" in text else ()
    grams = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    repeats = 0
    if len(set(grams)) < len(grams):
        often = Counter(grams)
        at = np.flatnonzero(np.fromiter((often[g] > 1 for g in grams), bool, len(grams)))
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + 5, -1)
        repeats = int((np.cumsum(edge) > 0).sum())
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeats


def with_rules(df: DataFrame, text: str = "text", drop: tuple[str, ...] = (), whole: tuple[Band, ...] = WHOLE, chunk: Band = CHUNK, bad_chunks: float = BAD_CHUNKS) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, zstd_ratio, n_chunks, n_bad_chunks, base_failed
    and kept.

    A null text counts as empty: no words, ratio 1, base_failed. Rows may repeat; columns with these names are replaced.
    """

    def make(texts: pa.Array) -> dict:
        texts = [t or "" for t in texts.to_pylist()]
        base, bands = [counts(t) for t in texts], [band_verdict(t.encode(), whole, chunk, bad_chunks) for t in texts]
        failed = [c[0] < 10 or 100 * c[4] > 20 * c[0] for c in base]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return (
            {k: [c[i] for c in base] for i, k in enumerate(names)}
            | {k: [b[i] for b in bands] for i, k in enumerate(("zstd_ratio", "n_chunks", "n_bad_chunks"))}
            | {"base_failed": failed, "kept": [b[3] and not f for b, f in zip(bands, failed, strict=True)]}
        )

    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, zstd_ratio double, n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean"
    return with_columns(df, [text], fields, make, drop)
