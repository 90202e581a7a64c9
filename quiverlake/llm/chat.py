r"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns that fit a token budget. Prefix sums of the turns' tokens say how far a
window reaches and how much of the turns before it is repeated as history; the leading system turn opens every window.
Repeated turns are context: only new assistant turns carry loss.

A turn is ``<turn ROLE>\nTEXT\n</turn>\n``. In texts a backslash goes before each backslash, ``<turn`` and ``</turn``, in
roles before each backslash, angle bracket and line feed; removing it restores them. Conversations are read and written
as streams of sorted rows, so only the turns of a window and its history are held.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WINDOWS = "conv_id long, window long, text string, loss_spans array<struct<start: long, end: long>>, repeated int, tokens long, over_budget boolean"
TURNS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
#: Tokens of a window; tokens and turns of the history that it repeats.
BUDGET, HISTORY_TOKENS, HISTORY_TURNS = 1_024, 256, 4
TOKENS = "byte_bpe_50k.tiktoken"
_END = "\n</turn>\n"
_HEAD = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"\\|</?turn", r"\\\g<0>", text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\<>\n]", r"\\\g<0>", role)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@lru_cache(maxsize=2)
def counter(model: str):
    import public_tokenizers
    import tiktoken

    with open(model if os.sep in model else public_tokenizers.path(model), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


class Windows:
    """The windows of one conversation, as its turns come."""

    def __init__(self, count, budget: int, history_tokens: int, history_turns: int):
        self.count, self.budget, self.history_tokens, self.history_turns = count, budget, history_tokens, history_turns
        self.turns: list[tuple[str, int, int]] = []  # formatted, where its loss begins (-1: none), where it ends
        self.sums = [0]  # prefix sums of the tokens of ``turns``
        self.new = 0  # the first turn of ``turns`` that no window has had as new
        self.first = 0  # the first turn of the window
        self.system: tuple[str, int] | None = None
        self.pending: tuple[str, int] | None = None  # a leading system turn, until the first window has it
        self.started = False

    def add(self, role: str, text: str) -> dict | None:
        """Takes a turn; returns the window that it closes, if any."""
        head, body = f"<turn {escape_role(role)}>\n", escape(text)
        turn = (head + body + _END, len(head) if role == "assistant" else -1, len(head) + len(body))
        tokens, closed = self.count(turn[0]), None
        if self.new < len(self.turns) and self._fixed() + self.sums[-1] - self.sums[self.first] + tokens > self.budget:
            closed = self.close()
        if self.new == len(self.turns):
            # The history: as far back as its limits and the budget allow, by the prefix sums.
            end = self.sums[-1]
            room = min(self.history_tokens, self.budget - self._fixed() - tokens)
            h = max(bisect_left(self.sums, end - room), len(self.turns) - self.history_turns) if room > 0 else len(self.turns)
            del self.turns[:h], self.sums[:h]
            self.new, self.first = len(self.turns), 0
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + tokens)
        if not self.started and role == "system":
            self.pending = (turn[0], tokens)
        self.started = True
        return closed

    def _fixed(self) -> int:
        return self.system[1] if self.system else 0

    def close(self) -> dict | None:
        if self.new == len(self.turns):
            return None
        parts, spans, at = [], [], 0
        if self.system:
            parts.append(self.system[0])
            at = len(parts[0])
        for i, (text, begin, end) in enumerate(self.turns):
            if i >= self.new and begin >= 0:
                spans.append({"start": at + begin, "end": at + end})
            parts.append(text)
            at += len(text)
        tokens = self._fixed() + self.sums[-1] - self.sums[0]
        out = {"text": "".join(parts), "loss_spans": spans, "repeated": self.new + bool(self.system), "tokens": tokens, "over_budget": tokens > self.budget}
        self.new = len(self.turns)
        if self.pending and not self.system:
            # From now on the system turn opens every window, so the history must not repeat it.
            self.system = self.pending
            del self.turns[0], self.sums[0]
            self.new -= 1
        return out


def format_windows(
    turns: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS, model: str = TOKENS,
) -> DataFrame:
    """The windows of each conversation in ``turns`` (conv_id, turn, role, text).

    Turns are in order of turn, then role and text where turns tie; repeated rows are turns of their own. Null roles and
    texts count as empty, rows with a null conv_id are one conversation, null turns come first. A turn that exceeds the
    budget by itself makes a window of its own (after the system turn), marked over_budget. Other columns are not read;
    an empty table gives no window.
    """
    rows = turns.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    schema = to_arrow_schema(StructType.fromDDL(WINDOWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, state, own, n = counter(model), None, None, 0
        for batch in batches:
            out = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != own:
                    if state is not None and (w := state.close()):
                        out.append({"conv_id": own, "window": n, **w})
                    state, own, n = Windows(count, budget, history_tokens, history_turns), conv, 0
                if w := state.add(role, text):
                    out.append({"conv_id": own, "window": n, **w})
                    n += 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if state is not None and (w := state.close()):
            yield pa.RecordBatch.from_pylist([{"conv_id": own, "window": n, **w}], schema)

    return dealt.mapInArrow(run, WINDOWS)


def parse(text: str) -> Iterator[tuple[str, str]]:
    """role and text of each turn of a window."""
    at = 0
    while at < len(text):
        head = _HEAD.match(text, at)
        end = text.index(_END, head.end())
        yield unescape(head[1]), unescape(text[head.end() : end])
        at = end + len(_END)


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation say: its turns once each, and the text under the loss mask."""
    dealt = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").select("conv_id", "text", "loss_spans", "repeated")
    schema = to_arrow_schema(StructType.fromDDL(TURNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def said() -> dict:
            turns, loss, *n = state
            return dict(zip(("turns_sha256", "loss_sha256", "conv_id", "n_turns", "loss_chars", "formatted_chars", "n_windows"), (turns.hexdigest(), loss.hexdigest(), *n), strict=True))

        for batch in batches:
            out = []
            for conv, text, spans, repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != state[2]:
                    if state is not None:
                        out.append(said())
                    state = [hashlib.sha256(), hashlib.sha256(), conv, 0, 0, 0, 0]
                for i, (role, said_text) in enumerate(parse(text)):
                    if i >= repeated:
                        state[0].update(f"{role}\n{said_text}\n".encode())
                        state[3] += 1
                for span in spans:
                    under = unescape(text[span["start"] : span["end"]])
                    state[1].update(under.encode())
                    state[4] += len(under)
                state[5] += len(text)
                state[6] += 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([said()], schema)

    return dealt.mapInArrow(run, TURNS)
