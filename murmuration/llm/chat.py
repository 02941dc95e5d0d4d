"""Chat formatting by columnar byte assembly.

For all turns of a batch of conversations: segment lengths, cumulative offsets and scatter indices in numpy; headers and
contents are copied into one preallocated buffer that becomes the Arrow column, with the loss spans beside it.

A turn is ``<|im_start|>role\\ncontent<|im_end|>\\n``. Inside roles and contents ``<``, n backslashes, ``|`` becomes
``<``, n + 1 backslashes, ``|``, so no control string is left and one backslash less restores the text; a newline in a
role becomes ``\\n`` after doubling its backslashes. The loss mask covers the contents of assistant turns.

Defined results: null role or text is empty. Turns go by turn (null first), role, text; repeated rows are repeated turns.
Rows without conv_id form one conversation without id. An empty table gives an empty result. A formatted conversation is one
Spark string, so it has less than 2 GiB, and the task that writes it holds it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import bytes_of

START, END, BREAK = b"<|im_start|>", b"<|im_end|>\n", b"\n"
TRAINED = "assistant"
CHUNK = 16 << 20  # bytes of roles and texts assembled together; one longer conversation is a chunk of its own
SCHEMA = "conv_id long, formatted string, loss array<struct<start:long,end:long>>"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern=r"<(\\*)\|", replacement=r"<\\\1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def escape_role(roles: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _copy(out: np.ndarray, to: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    lengths = np.diff(offsets)
    out[np.repeat(to - offsets[:-1], lengths) + np.arange(len(data))] = data


def _begins(conv: pa.Array) -> np.ndarray:
    """Which rows begin a conversation; null is an id of its own."""
    ids, none = pc.fill_null(conv, 0).to_numpy(), pc.is_null(conv).to_numpy(zero_copy_only=False)
    out = np.ones(len(ids), bool)
    out[1:] = (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])
    return out


def assemble(conv: pa.Array, roles: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Whole conversations, rows in order, to one row each."""
    role, role_at = bytes_of(escape_role(roles))
    text, text_at = bytes_of(escape(texts))
    n = len(conv)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 1], lengths[:, 2], lengths[:, 3], lengths[:, 4] = len(START), np.diff(role_at), 1, np.diff(text_at), len(END)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    begins = ends - lengths
    out = np.empty(int(ends[-1, -1]), np.uint8)
    for k, const in ((0, START), (2, BREAK), (4, END)):
        out[begins[:, k, None] + np.arange(len(const))] = np.frombuffer(const, np.uint8)
    _copy(out, begins[:, 1], role, role_at)
    _copy(out, begins[:, 3], text, text_at)

    first = np.flatnonzero(_begins(conv))
    offsets = np.concatenate([begins[first, 0], [len(out)]])
    formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
    base = np.repeat(offsets[:-1], np.diff(np.concatenate([first, [n]])))
    trained = pc.equal(roles, TRAINED).to_numpy(zero_copy_only=False)
    spans = pa.StructArray.from_arrays([pa.array((x - base)[trained]) for x in (begins[:, 3], ends[:, 3])], ["start", "end"])
    upto = np.concatenate([[0], np.cumsum(trained)])[np.concatenate([first, [n]])]
    loss = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays([conv.take(pa.array(first)), formatted.cast(pa.string()), loss], ["conv_id", "formatted", "loss"])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_: list[pa.RecordBatch] = []  # the rows of the conversation that the batches so far end in

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        conv, role, text = (pa.concat_arrays(t[c].chunks) for c in ("conv_id", "role", "text"))
        role, text = pc.fill_null(role, ""), pc.fill_null(text, "")
        first = np.concatenate([np.flatnonzero(_begins(conv)), [len(conv)]])
        size = np.concatenate([[0], np.cumsum(pc.binary_length(role).to_numpy() + pc.binary_length(text).to_numpy().astype(np.int64))])[first]
        at = 0
        while at < len(first) - 1:
            to = max(at + 1, int(np.searchsorted(size, size[at] + CHUNK, "right")) - 1)
            n = int(first[to] - first[at])
            yield assemble(*(x.slice(int(first[at]), n) for x in (conv, role, text)))
            at = to

    for batch in batches:
        if not len(batch):
            continue
        cut = int(np.flatnonzero(_begins(batch.column("conv_id")))[-1])
        if open_ and (cut or open_[-1].column("conv_id")[-1].as_py() != batch.column("conv_id")[-1].as_py()):
            yield from done([*open_, batch.slice(0, cut)] if cut else open_)
            open_ = []
        elif cut:
            yield from done([batch.slice(0, cut)])
        open_.append(batch.slice(cut))
    if open_:
        yield from done(open_)


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (byte ranges of ``formatted`` that the loss covers)."""
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format, SCHEMA)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns = []
    for part in formatted.split(START.decode())[1:]:
        role, text = part[: -len(END)].split("\n", 1)
        turns.append((unescape_role(role), unescape(text)))
    return turns


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, formatted, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
            turns, raw = parse(formatted), formatted.encode()
            told = "".join(unescape(raw[s["start"] : s["end"]].decode()) for s in loss)
            every = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append((conv, len(turns), hashlib.sha256(every.encode()).hexdigest(), len(told), hashlib.sha256(told.encode()).hexdigest(), len(formatted)))
        names = [c.split()[0] for c in DIGEST.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests taken from the formatted text and its loss spans alone."""
    return formatted.mapInArrow(_digest, DIGEST)
