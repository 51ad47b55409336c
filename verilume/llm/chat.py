"""Chat formatting in budgeted windows.

A turn is written as START role newline text END newline; backslashes and "<|" inside roles and texts (and line breaks inside
roles) are escaped, which `unescape` reverses, so a text can't forge a mark. Running sums of the turns' tokens choose spans of whole
turns: a window ends before the turn with which its tokens would exceed BUDGET. Every window begins with the conversation's
system turn (its first turn, if a system turn) and with as many of the turns before the span as fit in HISTORY tokens. The loss mask
covers the texts of the assistant turns of the span; repeated turns are outside it, so each target counts once. A turn that
exceeds the budget by itself has a window of its own and isn't cut; a system turn that does is still repeated in full in every
window of its conversation.

A conversation is one ordered stream: rows are dealt out by conversation, sorted, and read in order with only the current
window in memory, however long the conversation is.

Defined results: a null text or role is empty; null conversation ids are one conversation; null turns come first; equal turn numbers
are ordered by role and text; repeated rows are turns of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilume.llm import textnum

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 1024, 256
#: Bytes of text that are tokenized, and of windows that are passed on, at a time.
BATCH = 1 << 20
WINDOWS = "conv_id long, window long, text string, loss array<struct<start:long,end:long>>, n_tokens long, repeated long"
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)

_counters: dict = {}


def escape(text: str, role: bool = False) -> str:
    out = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return out.replace("\n", "\\n") if role else out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def written(role: str, text: str) -> str:
    return f"{START}{escape(role, True)}\n{escape(text)}{END}\n"


def counter(path: str | None):
    """A function from texts to their numbers of tokens: by the tokenizer file at `path`, else a quarter of the bytes."""
    if path is None:
        return lambda texts: [(len(t.encode()) + 3) // 4 for t in texts]
    if path not in _counters:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _counters[path] = lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return _counters[path]


class Windows:
    """The windows of one conversation, turn by turn."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple | None = None
        self.before: list[tuple] = []
        self.span: list[tuple] = []
        self.turns = self.windows = self.total = 0

    def add(self, role: str, text: str, tokens: int) -> tuple | None:
        """The window that the new turn ends, if any."""
        done = None
        if self.span and self.total + tokens > self.budget:
            done = self.close()
            self._restart(tokens)
        turn = (role, written(role, text), tokens)
        if not self.turns and role == "system":
            self.system = turn
        self.turns += 1
        self.span.append(turn)
        self.total += tokens
        return done

    def _restart(self, tokens: int) -> None:
        """Repeat the system turn, and the latest turns that fit in the history and, with the next turn, in the budget."""
        recent = [t for t in self.before + self.span if t is not self.system]
        fixed = self.system[2] if self.system else 0
        room, keep = min(self.history, self.budget - fixed - tokens), 0
        while keep < len(recent) and (used := recent[-keep - 1][2]) <= room:
            room, keep = room - used, keep + 1
        self.before = recent[len(recent) - keep :]
        self.span, self.total = [], fixed + sum(t[2] for t in self.before)

    def close(self) -> tuple | None:
        """(window, text, loss, tokens, repeated turns) of what is open."""
        if not self.span:
            return None
        first = [self.system] if self.system and self.windows else []
        at, parts, loss = 0, [], []
        repeated = first + (self.before if self.windows else [])
        for i, (role, text, _) in enumerate(repeated + self.span):
            if i >= len(repeated) and role == "assistant":
                head = len(START) + len(escape(role, True)) + 1
                loss.append({"start": at + head, "end": at + len(text) - len(END) - 1})
            parts.append(text)
            at += len(text)
        out = self.windows, "".join(parts), loss, self.total, len(repeated)
        self.windows += 1
        return out


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_chats(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None) -> DataFrame:
    """The windows of every conversation (columns WINDOWS); loss: spans of code points of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        names = ["conv_id", "window", "text", "loss", "n_tokens", "repeated"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64(), pa.int64()]
        rows: list[tuple] = []
        size = 0
        key, state = None, None

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        def add(window):
            nonlocal size
            rows.append((key, *window))
            size += len(window[1]) + 100

        for batch in batches:
            _, offs = textnum.text_bytes(batch.column("text"))
            for first, last in textnum.slices(offs, BATCH):
                part = batch.slice(first, last - first)
                ids, roles, texts = (part.column(c).to_pylist() for c in ("conv_id", "role", "text"))
                roles, texts = [r or "" for r in roles], [t or "" for t in texts]
                for i, role, text, tokens in zip(ids, roles, texts, count([written(r, t) for r, t in zip(roles, texts, strict=True)]), strict=True):
                    if state is None or i != key:
                        if state is not None:
                            add(state.close())
                        key, state = i, Windows(budget, history)
                    if done := state.add(role, text, tokens):
                        add(done)
                    if size > BATCH:
                        yield batch_of(rows)
                        rows, size = [], 0
        if state is not None:
            rows.append((key, *state.close()))
        if rows:
            yield batch_of(rows)

    picked = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return _in_order(picked, "turn", "role", "text").mapInArrow(run, WINDOWS)


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows say of each conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        key, state = None, None
        rows = []

        def end():
            rows.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for row in (r for one in range(batch.num_rows) for r in batch.slice(one, 1).to_pylist()):
                if state is None or row["conv_id"] != key:
                    if state is not None:
                        end()
                    key, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["text"]
                state[4] += len(text)
                for i, m in enumerate(_TURN.finditer(text)):
                    if i >= row["repeated"]:
                        state[0] += 1
                        state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                for span in row["loss"]:
                    target = unescape(text[span["start"] : span["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names)
                rows = []
        if state is not None:
            end()
            yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _in_order(windows, "window").mapInArrow(run, schema)
