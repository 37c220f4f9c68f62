"""Chat formatting by prefix-target expansion: an example for each assistant turn, only that reply trainable."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's marks. Every mark starts with BOUND, and texts and roles never hold BOUND after escaping.
BOUND, ESCAPE = "<|", "\\"
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Strings of other templates that are kept from standing whole inside a text.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
EXAMPLES = "conv_id bigint, example int, text string, n_context int, loss_start bigint, loss_end bigint"
PACKED = "conv_id bigint, example int, text string, n_context int, length bigint, loss_start bigint, loss_end bigint"
READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
#: Code points of text to a batch of examples, about.
BATCH_CHARS = 4 << 20


def escape(text: str) -> str:
    """Reversible: a backslash is doubled, and each control string gets one after its first character."""
    text = text.replace(ESCAPE, ESCAPE * 2)
    for mark in CONTROL:
        text = text.replace(mark, mark[0] + ESCAPE + mark[1:])
    return text


def unescape(text: str) -> str:
    out, i = [], 0
    while (j := text.find(ESCAPE, i)) >= 0:
        doubled = text.startswith(ESCAPE, j + 1)
        out.append(text[i:j] + ESCAPE * doubled)
        i = j + 1 + doubled
    return "".join(out) + text[i:]


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and where each turn's content stands in it, the end mark excluded."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
        out += [head, body, END]
        spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def spans_of(formatted: str) -> Iterator[tuple[str, int, int, int]]:
    """(role, start, end, after) of each turn of a formatted text, found by its marks alone: where its content stands, and where
    what follows its end mark does."""
    at = 0
    while formatted.startswith(TURN, at):
        says = formatted.index(SAYS, at)
        end = formatted.index(END, says)
        yield unescape(formatted[at + len(TURN) : says]), says + len(SAYS), end, end + len(END)
        at = end + len(END)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from a formatted text."""
    return [(role, unescape(formatted[a:b])) for role, a, b, _ in spans_of(formatted)]


def prefixes(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The formatted conversation, and (n_context, length, loss_start, loss_end) of each example, which is its beginning of that
    length: one for each assistant turn, all turns before it as context. Turns after the last assistant turn go into
    one more example with an empty loss span (-1, -1), so that the output holds every turn."""
    text, spans = render(turns)
    out = [(k, end + len(END), start, end) for k, ((role, _), (start, end)) in enumerate(zip(turns, spans, strict=True)) if role == "assistant"]
    if turns and turns[-1][0] != "assistant":
        out.append((len(turns), len(text), -1, -1))
    return text, out


def expand(turns: list[tuple[str, str]]) -> Iterator[tuple[int, str, int, int, int]]:
    """(example, text, n_context, loss_start, loss_end) of each example, written out."""
    text, examples = prefixes(turns)
    for n, (n_context, length, *loss) in enumerate(examples):
        yield n, text[:length], n_context, *loss


def _turns(rows: pd.DataFrame) -> list[tuple[str, str]]:
    rows = rows.assign(r=rows.role.fillna(""), t=rows.text.fillna("")).sort_values(["turn", "r", "t"], kind="stable", na_position="last")
    return list(zip(rows.r, rows.t, strict=True))


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Whole conversations out of a partition sorted by conv_id; only the one at hand is held. A row without an id is one."""
    held: list[pd.DataFrame] = []
    last = object()
    for rows in batches:
        alone = rows.conv_id.isna()
        for k in alone.to_numpy().nonzero()[0]:
            yield None, _turns(rows.iloc[k : k + 1])
        for conv, part in rows[~alone].groupby("conv_id", sort=False):
            if held and conv != last:
                yield int(last), _turns(pd.concat(held))
                held = []
            held.append(part)
            last = conv
    if held:
        yield int(last), _turns(pd.concat(held))


def _together(conversations: DataFrame) -> DataFrame:
    """A conversation's turns, next to each other in one partition; distinct conversations, and rows without an id, spread over
    all."""
    picked = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    spread = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    return picked.repartition("conv_id", spread).sortWithinPartitions("conv_id", "turn")


def packed_examples(conversations: DataFrame) -> DataFrame:
    """PACKED rows: every assistant turn with all preceding turns as context. An example is the first `length` code points of its
    conversation's longest one, which alone has its text written out and comes last; so contexts, whose sum grows with the
    square of a conversation's length, are stored once. loss_start and loss_end bound what is trainable (-1: nothing).

    Null roles and texts are empty; a row without a conv_id is a conversation of its own; turns of equal number go by role,
    then text, null turns last; repeated rows stay; an empty table gives none. Other columns are left out.
    """

    def examples(batches):
        out, size = [], 0
        for conv, turns in _conversations(batches):
            text, found = prefixes(turns)
            out += [(conv, n, text if n + 1 == len(found) else None, *e) for n, e in enumerate(found)]
            size += len(text)
            if size > BATCH_CHARS:
                yield _frame(out, PACKED)
                out, size = [], 0
        yield _frame(out, PACKED)

    return _together(conversations).mapInPandas(examples, PACKED)


def training_examples(conversations: DataFrame) -> DataFrame:
    """EXAMPLES rows: the same examples with every text written out."""

    def examples(batches):
        for conv, turns in _conversations(batches):
            yield _frame([(conv, *e) for e in expand(turns)], EXAMPLES)

    return _together(conversations).mapInPandas(examples, EXAMPLES)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"conv_id": "Int64"})


def read_examples(examples: DataFrame) -> DataFrame:
    """READ rows, one for each conversation of PACKED rows as packed_examples leaves them: its turns by parsing the longest
    example, and the trained text by cutting every example at its loss span. An example whose loss span is not the content
    of its last turn, as the marks say, raises an error. formatted_chars counts the code points of all examples."""

    def digests(batches):
        held: list[tuple[int, int, int, int]] = []
        for rows in batches:
            out = []
            for conv, text, *example in zip(rows.conv_id, rows.text, rows.n_context, rows.length, rows.loss_start, rows.loss_end, strict=True):
                held.append(tuple(example))
                if text is not None:
                    out.append((None if pd.isna(conv) else int(conv), *_read(text, held)))
                    held = []
            yield _frame(out, READ)

    return examples.mapInPandas(digests, READ)


def _read(text: str, examples: list[tuple[int, int, int, int]]) -> tuple[int, str, int, str, int]:
    said, trained, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
    left = iter(examples)
    n_context, length, *loss = next(left)
    for role, start, end, after in spans_of(text):
        said.update(f"{role}\n{unescape(text[start:end])}\n".encode("utf-8", "replace"))
        n += 1
        if after == length:  # the last turn of the example at hand
            if loss != [-1, -1]:
                if loss != [start, end] or n_context != n - 1:
                    raise ValueError(f"the loss span {loss} is not the content of turn {n}")
                part = unescape(text[loss[0] : loss[1]])
                loss_chars += len(part)
                trained.update(part.encode("utf-8", "replace"))
            chars += length
            n_context, length, *loss = next(left, (-1, -1, -1, -1))
    if length >= 0:
        raise ValueError("an example ends inside a turn")
    return n, said.hexdigest(), loss_chars, trained.hexdigest(), chars


def read_back(conversations: DataFrame) -> DataFrame:
    """What the formatted examples of all conversations say; see packed_examples and read_examples. The digests are made in the
    partitions of the examples, so no example is shuffled."""
    return read_examples(packed_examples(conversations))
