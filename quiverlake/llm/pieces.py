"""SentencePiece BPE in vectorised merge rounds.

Words of many texts lie in one flat array of symbols. A round finds the lowest pair rank in each word by a segmented
minimum, merges all leftmost pairs of that rank at once, and closes the gaps; words without a pair leave the array. The
library merges one pair at a time, best score first, then leftmost. A round gives the same pieces unless a merge makes
a new pair that is as good as the merged one or better (only runs of spaces, whose pieces share one score, do this in
practice); such words are finished by the library's own order, with a heap.

Words are cut before a space that follows another character, and around line feeds, where the model has no piece that
crosses such a cut (checked when the model is loaded), so merges in one word never touch another. Encoded words are kept
in a bounded cache of the Python worker, so common words are merged once.
"""

from __future__ import annotations

import heapq
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import with_columns

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Words that a Python worker keeps, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 200_000, 48


def model_path(model: str) -> str:
    """A path as it is; a bare name is looked up among the installed public tokenizers."""
    if os.sep in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


class PieceModel:
    """A SentencePiece BPE model with byte fallback, an identity normaliser and the dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        ids = {pieces[i]: i for i in normal}
        if any(sp.is_unused(i) for i in range(n)) or not sp.is_byte(sp.piece_to_id("<0x00>")):
            raise ValueError("the model needs byte fallback and no unused pieces")
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("the model has a piece with a space after another character")
        # Symbols: ids of pieces, then numbers for characters that only occur inside pieces.
        symbols = dict(ids)
        for p in ids:
            for c in p:
                symbols.setdefault(c, n + len(symbols) - len(ids))
        self.n_symbols = n + len(symbols) - len(ids) + 1
        self.unknown = self.n_symbols - 1
        self.of_char = np.full(0x110000, self.unknown, np.int32)
        for s, k in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = k
        order = {score: r for r, score in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        pairs = [
            (symbols[p[:k]] * self.n_symbols + symbols[p[k:]], order[sp.get_score(i)], i)
            for p, i in ids.items()
            for k in range(1, len(p))
            if p[:k] in symbols and p[k:] in symbols
        ]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        # Pairs by key; the place after the last stands for no pair.
        self.no_pair = len(table)
        self.pair_key = np.r_[table[:, 0], np.iinfo(np.int64).max]
        self.pair_rank, self.pair_piece = np.r_[table[:, 1], NONE].astype(np.int32), np.r_[table[:, 2], -1].astype(np.int32)
        # Places of the pairs of common characters, without a search.
        common = [chr(c) for c in range(0x250)] + [SPACE]
        self.slot = np.full(0x110000, -1, np.int16)
        self.slot[[ord(c) for c in common]] = np.arange(len(common))
        own = self.of_char[[ord(c) for c in common]].astype(np.int64)
        self.direct = self._places((own[:, None] * self.n_symbols + own[None, :]).ravel()).astype(np.int32)
        self.n_slots = len(common)
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.cut_lines = not any("\n" in p for p in ids)
        line = "\n" if self.cut_lines else ""
        self.segments = re.compile((f"\n[^{SPACE}\n]*|" if line else "") + f"{SPACE}+[^{SPACE}{line}]*").findall
        self.cache: dict[str, bytes] = {}
        # For decoding: what a piece says, for pieces that need no neighbour.
        self.said: list[str | None] = [pieces[i].replace(SPACE, " ") for i in range(n)]
        self.alone = np.zeros(n, bool)
        self.alone[normal] = True
        for b in range(128):
            self.said[self.byte_ids[b]] = chr(b)
            self.alone[self.byte_ids[b]] = True

    def _places(self, key: np.ndarray) -> np.ndarray:
        """The place of each key in the pair table, or that of no pair."""
        at = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[at] == key, at, self.no_pair)

    def _by_heap(self, sym: list[int]) -> list[int]:
        """The library's order: best rank first, then leftmost, one pair at a time."""
        table = self._pair_map()
        nxt, prv, alive = [*range(1, len(sym)), -1], [*range(-1, len(sym) - 1)], [True] * len(sym)
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and nxt[i] >= 0 and (hit := table.get((sym[i], sym[nxt[i]]))):
                heapq.heappush(heap, (hit[0], i, sym[i], sym[nxt[i]]))

        for i in range(len(sym) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], alive[j], nxt[i] = table[a, b][1], False, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            offer(prv[i])
            offer(i)
        return [s for s, x in zip(sym, alive, strict=True) if x]

    @lru_cache(maxsize=1)  # noqa: B019  one model a worker
    def _pair_map(self) -> dict[tuple[int, int], tuple[int, int]]:
        left, right = np.divmod(self.pair_key[:-1], self.n_symbols)
        return {(a, b): (r, p) for a, b, r, p in zip(left.tolist(), right.tolist(), self.pair_rank.tolist(), self.pair_piece.tolist(), strict=False)}

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word (not empty), as little-endian 32-bit integers."""
        char = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out, word = [b""] * len(words), np.arange(len(words))
        starts = np.cumsum(lengths) - lengths
        last = np.zeros(len(char), bool)
        last[starts + lengths - 1] = True
        # A symbol without a number keeps its character, as a negative number, for the bytes at the end.
        sym = self.of_char[char].astype(np.int64)
        held = np.where(sym == self.unknown, -1 - char.astype(np.int64), sym)
        # at: the place in the pair table of each symbol with the next one in its word.
        slot = self.slot[char].astype(np.int32)
        at = np.full(len(char), self.no_pair, np.int32)
        both = (slot[:-1] >= 0) & (slot[1:] >= 0)
        at[:-1] = np.where(both, self.direct[np.where(both, slot[:-1] * self.n_slots + slot[1:], 0)], self.no_pair)
        rare = np.flatnonzero(~both)
        at[rare] = self._places(sym[rare] * self.n_symbols + sym[rare + 1])
        at[last] = self.no_pair
        rank = self.pair_rank[at]
        while len(word):
            least = np.minimum.reduceat(rank, starts)
            if (done := least == NONE).any():
                in_done = np.repeat(done, lengths)
                self._emit(word[done], lengths[done], held[in_done], out)
                go = ~in_done
                held, rank, at, last = held[go], rank[go], at[go], last[go]
                word, lengths, least = word[~done], lengths[~done], least[~done]
                starts = np.cumsum(lengths) - lengths
                if not len(word):
                    break
            best = rank == np.repeat(least, lengths)
            # Of touching pairs the first, third, ... of the run: a pair whose left neighbour merges is gone.
            pick = np.flatnonzero(best)
            if (np.diff(pick) == 1).any():
                begins = np.r_[True, np.diff(pick) != 1]
                nth = np.arange(len(pick))
                pick = pick[(nth - np.maximum.accumulate(np.where(begins, nth, 0))) % 2 == 0]
            keep = np.ones(len(held), bool)
            keep[pick + 1] = False
            new_held, new_at, new_last = held.copy(), at.copy(), last.copy()
            new_held[pick], new_last[pick] = self.pair_piece[at[pick]], last[pick + 1]
            new_held, new_at, new_last = new_held[keep], new_at[keep], new_last[keep]
            picked = np.bincount(np.searchsorted(starts, pick, "right") - 1, minlength=len(word))
            new_lengths = lengths - picked
            new_starts = np.cumsum(new_lengths) - new_lengths
            # Only pairs with a merged symbol have changed.
            merged = pick - np.arange(len(pick))
            changed = np.concatenate([merged, merged[merged > 0] - 1])
            inner = changed[~new_last[changed]]
            new_at[changed] = self.no_pair
            a, b = new_held[inner], new_held[inner + 1]
            known = (a >= 0) & (b >= 0)
            new_at[inner[known]] = self._places(a[known] * self.n_symbols + b[known])
            new_rank = self.pair_rank[new_at]
            odd = picked > 1
            if odd.any():
                odd &= np.minimum.reduceat(new_rank, new_starts) <= least
            for k in np.flatnonzero(odd):
                own = held[starts[k] : starts[k] + lengths[k]].tolist()
                final = np.array(self._by_heap(own), np.int64)
                self._emit(word[k : k + 1], np.array([len(final)]), final, out)
            if odd.any():
                go = ~np.repeat(odd, new_lengths)
                new_held, new_at, new_rank, new_last = new_held[go], new_at[go], new_rank[go], new_last[go]
                word, new_lengths = word[~odd], new_lengths[~odd]
                new_starts = np.cumsum(new_lengths) - new_lengths
            held, rank, at, last, lengths, starts = new_held, new_rank, new_at, new_last, new_lengths, new_starts
        return out

    def _emit(self, word: np.ndarray, lengths: np.ndarray, held: np.ndarray, out: list[bytes]) -> None:
        """Characters without a piece become the pieces of their UTF-8 bytes."""
        ends = np.cumsum(lengths)
        if (odd := (held < 0) | (held >= len(self.said))).any():
            chars = {int(h): self._bytes_of(int(h)) for h in np.unique(held[odd])}
            width = np.ones(len(held), np.int64)
            width[odd] = [len(chars[h]) for h in held[odd].tolist()]
            flat = np.repeat(held, width)
            flat[np.repeat(odd, width)] = np.concatenate([chars[h] for h in held[odd].tolist()])
            ends, held = np.cumsum(width)[ends - 1], flat
        raw, begin = held.astype("<i4").tobytes(), 0
        for w, end in zip(word.tolist(), (ends * 4).tolist(), strict=True):
            out[w] = raw[begin:end]
            begin = end

    def _bytes_of(self, held: int) -> np.ndarray:
        char = chr(-1 - held) if held < 0 else chr(int(np.flatnonzero(self.of_char == held)[0]))
        return self.byte_ids[list(char.encode())]

    def words_of(self, text: str) -> list[str]:
        """The text's words. One that begins with a space sign or a line feed is as it is; before others there is one space."""
        if not text:
            return []
        if not self.cut_lines or text[0] == " " or "  " in text or SPACE in text:
            return self.segments(SPACE + text.replace(" ", SPACE))
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        cache, split, used = self.cache, [self.words_of(t) for t in texts], set()
        for words in split:
            used.update(words)
        fresh = list(used.difference(cache))
        for k in range(0, len(fresh), 20_000):
            part = fresh[k : k + 20_000]
            cache.update(zip(part, self.merge([w if w[:1] in (SPACE, "\n") else SPACE + w for w in part]), strict=True))
        out = [b"".join(map(cache.__getitem__, words)) for words in split]
        for w in fresh:
            if len(w) > CACHE_CHARS:
                del cache[w]
        if len(cache) > CACHE_WORDS:  # the words of these texts stay, common ones among them
            self.cache = {w: cache[w] for w in used if w in cache}
        return out

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids), which it calls for pieces that need their neighbours (bytes over 127,
        control and unknown ids)."""
        if not self.alone[ids].all():
            return self.library.decode(ids.tolist())
        text = "".join(map(self.said.__getitem__, ids.tolist()))
        return text[1:] if len(ids) and self.said[ids[0]][:1] == " " else text


@lru_cache(maxsize=2)
def load(model: str) -> PieceModel:
    return PieceModel(model_path(model))


def encode(
    df: DataFrame, model: str, text: str = "text", ids: str = "piece_ids", drop: tuple[str, ...] = (), decoded: str | None = None, round_trip: str | None = None,
) -> DataFrame:
    """Adds ``ids``, an array of the piece ids of each whole text, without begin or end ids.

    On demand the same Python worker decodes the ids again: ``decoded`` names a column for the text that they give, and
    ``round_trip`` one that says whether it is the text (a U+2581 comes back a space). A null or empty text has no ids
    and decodes to an empty one. Repeated rows stay. Columns with the new names are replaced; others stay, but for ``drop``.
    """

    def make(texts: pa.Array) -> dict:
        texts = [t or "" for t in texts.to_pylist()]
        raw = load(model).encode(texts)
        ends = np.cumsum([0, *(len(r) // 4 for r in raw)], dtype=np.int32)
        out = {ids: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))}
        if decoded or round_trip:
            again = [load(model).decode(np.frombuffer(r, "<i4")) for r in raw]
            out |= {decoded: pa.array(again, pa.string())} if decoded else {}
            out |= {round_trip: [a == t.replace(SPACE, " ") for a, t in zip(again, texts, strict=True)]} if round_trip else {}
        return out

    fields = [f"`{ids}` array<int>", *([f"`{decoded}` string"] if decoded else []), *([f"`{round_trip}` boolean"] if round_trip else [])]
    return with_columns(df, [text], ", ".join(fields), make, drop, slice_rows=128)


def decode(df: DataFrame, model: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """Adds ``text``, the text of the ids of each row; that of a null or empty array is empty."""

    def make(arrays: pa.Array) -> dict:
        m, arrays = load(model), arrays.fill_null([]) if arrays.null_count else arrays
        flat, ends = arrays.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(arrays.value_lengths().to_numpy(zero_copy_only=False))]
        return {text: pa.array([m.decode(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())}

    return with_columns(df, [ids], f"`{text}` string", make)
