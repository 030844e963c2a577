"""Chat formatting by token-level assembly.

The template of a turn is `<turn>` role `<say>` text `</turn>`; turns follow each other without
anything between. The three control strings are reserved ids beyond the vocabulary; role and text
are encoded separately and the ids spliced, so no merge reaches across a border and no content can
yield a reserved id. The rendered string is unambiguous too: wherever a control string occurs in a role or
text, the k backslashes before it (perhaps none) become 2k + 1, which `unescape` takes back.

The loss mask covers the text of assistant turns: it is the running sum of +1 after an assistant's
`<say>` and -1 at `</turn>`. A conversation's token offsets are running sums of turn lengths.

* Turns are encoded where they lie; a conversation is never gathered. Offsets and digests need its
  turns in order: one shuffle by conversation, sorted, from which a task streams with one running
  state, so a conversation of any length takes bounded memory. (SHA-256 of a conversation is
  sequential by nature; its turns must pass through one task.)

Rows. Null text or role: empty. Null turn sorts first; ties by role, then text; repeated rows are
turns of their own. A null conversation id is a conversation like any other. Empty input gives
empty output. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoledger.llm import common

TURN, SAY, END = "<turn>", "<say>", "</turn>"
CONTROLS = (TURN, SAY, END)
ASSISTANT = "assistant"
_CONTENT = re.compile(r"(\\*)(<turn>|<say>|</turn>)")


def escape(text: str) -> str:
    """Put 2k + 1 backslashes for the k before each control string."""
    return _CONTENT.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _CONTENT.sub(lambda m: m[1][: (len(m[1]) - 1) // 2] + m[2], text)


@lru_cache(maxsize=2)
def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


def reserved(path: str) -> dict[str, int]:
    """Ids of the control strings: the first ones beyond the vocabulary."""
    n = load(path).get_vocab_size()
    return {c: n + k for k, c in enumerate(CONTROLS)}


def assemble(role: list[int], text: list[int], ids: dict[str, int], learn: bool):
    """Ids of a turn and their loss mask."""
    out = np.array([ids[TURN], *role, ids[SAY], *text, ids[END]], np.int32)
    step = np.zeros(len(out) + 1, np.int8)
    if learn:
        step[len(role) + 2] = 1
        step[len(out) - 1] -= 1
    return out, np.cumsum(step[:-1]).astype(bool)


def _encode_task(path: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, ids = load(path), reserved(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                roles = [x or "" for x in batch["role"].to_pylist()]
                texts = [x or "" for x in batch["text"].to_pylist()]
                encoded = [
                    [e.ids for e in tokenizer.encode_batch([escape(x) for x in part], add_special_tokens=False)]
                    for part in (roles, texts)
                ]
                turns = [
                    assemble(r, t, ids, role == ASSISTANT)
                    for r, t, role in zip(*encoded, roles, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["conv_id"],
                        batch["turn"],
                        pa.array(roles, pa.string()),
                        pa.array(texts, pa.string()),
                        pa.array([t for t, _ in turns], pa.list_(pa.int32())),
                        pa.array([m for _, m in turns], pa.list_(pa.bool_())),
                    ],
                    ["conv_id", "turn", "role", "text", "ids", "mask"],
                )

    return task


def _position_task():
    """Adds each turn's place and first token in its conversation; rows come in order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, start = object(), 0, 0
        for batch in batches:
            lengths = np.diff(np.asarray(batch["ids"].offsets)).tolist()
            places, starts = [], []
            for conv, n in zip(batch["conv_id"].to_pylist(), lengths, strict=True):
                if conv != now:
                    now, place, start = conv, 0, 0
                places.append(place)
                starts.append(start)
                place, start = place + 1, start + n
            yield pa.RecordBatch.from_arrays(
                [
                    batch["conv_id"],
                    pa.array(places, pa.int64()),
                    pa.array(starts, pa.int64()),
                    batch["ids"],
                    batch["mask"],
                ],
                ["conv_id", "place", "start", "ids", "mask"],
            )

    return task


def format_turns(turns: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, place, start, ids and mask per turn; ids of a conversation by place are its tokens.

    `turns` has conv_id, turn, role, text.
    """
    own = turns.select("conv_id", "turn", "role", "text")
    kinds = {f.name: f.dataType for f in own.schema}
    lists = (
        T.StructType()
        .add("ids", T.ArrayType(T.IntegerType()))
        .add("mask", T.ArrayType(T.BooleanType()))
    )
    encoded = T.StructType(
        [T.StructField(k, kinds[k] if k in ("conv_id", "turn") else T.StringType()) for k in own.columns]
        + lists.fields
    )
    order = ["conv_id", "turn", "role", "text"]
    sorted_turns = (
        own.mapInArrow(_encode_task(tokenizer), encoded)
        .repartition("conv_id")
        .sortWithinPartitions(*order)
    )
    placed = (
        T.StructType()
        .add("conv_id", kinds["conv_id"])
        .add("place", T.LongType())
        .add("start", T.LongType())
    )
    return sorted_turns.mapInArrow(_position_task(), T.StructType(placed.fields + lists.fields))


def split_turn(ids: np.ndarray, mask: np.ndarray, tokenizer, control: dict[str, int]):
    """Role, text, text under the mask and rendered length of one formatted turn."""
    say = int(np.flatnonzero(ids == control[SAY])[0])
    role, text = (tokenizer.decode(part.tolist(), skip_special_tokens=False) for part in (ids[1:say], ids[say + 1 : -1]))
    learned = tokenizer.decode(ids[mask].tolist(), skip_special_tokens=False) if mask.any() else ""
    rendered = len(TURN) + len(role) + len(SAY) + len(text) + len(END)
    return unescape(role), unescape(text), unescape(learned), rendered


def _digest_task(path: str):
    """One row per conversation from its formatted turns in order."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, control = load(path), reserved(path)
        now, state, out = None, None, []

        def close() -> None:
            if state is not None:
                conv, n, turns, chars, loss, length = state
                out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), length))

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            ids, masks = batch["ids"], batch["mask"]
            for r, conv in enumerate(batch["conv_id"].to_pylist()):
                if state is None or conv != now:
                    close()
                    now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, learned, length = split_turn(
                    ids[r].values.to_numpy(),
                    masks[r].values.to_numpy(zero_copy_only=False),
                    tokenizer,
                    control,
                )
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += length
            if out:
                yield rows()
        close()
        if out:
            yield rows()

    return task


def digest(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """What the formatted tokens hold, read back: one row per conversation."""
    schema = (
        T.StructType()
        .add("conv_id", formatted.schema["conv_id"].dataType)
        .add("n_turns", T.LongType())
        .add("turns_sha256", T.StringType())
        .add("loss_chars", T.LongType())
        .add("loss_sha256", T.StringType())
        .add("formatted_chars", T.LongType())
    )
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.select("conv_id", "ids", "mask").mapInArrow(_digest_task(tokenizer), schema)


def store_formatted(turns: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """The formatted turns as a written table."""
    return common.stored(format_turns(turns, tokenizer), "formatted", path)
