"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered, encoded once, and the byte offsets of its
tokens are intersected with the sorted spans of its assistant turns by binary
search.

Template, for each turn: `### role:`, a line feed, the text, a line feed,
`</turn>`, a line feed. In roles and texts a backslash precedes every backslash,
every `#` before `##`, and every `<` before `/turn>` (in roles every colon, too),
so no text can pass for a marker and unescaping gives back each role and text
exactly. White space at an edge of a text is kept off the line feed there by `\\-`,
which stands for nothing: byte-level BPE splits between a line feed and what isn't
white space, so no token reaches over the edge of a text, and a token is under the
loss mask if it lies inside a trained text. With a tokenizer that splits elsewhere,
tokens over an edge aren't under the mask.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .packing import encoder

_ESCAPE = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ESCAPE_ROLE = re.compile(r"\\|#(?=##)|<(?=/turn>)|:")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+):\n((?:[^\\<\n]|\\.|<(?!/turn>)|\n(?!</turn>\n))*+)\n</turn>\n", re.S)
#: White space, as any tokenizer may see it.
_SPACE = "[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_EDGE = re.compile(f"\\A(?={_SPACE})|(?<={_SPACE})\\Z")


def escape(text: str, role: bool = False) -> str:
    if role:
        return _ESCAPE_ROLE.sub(lambda m: "\\" + m[0], text)
    return _EDGE.sub(r"\\-", _ESCAPE.sub(lambda m: "\\" + m[0], text))


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "" if m[1] == "-" else m[1], text)


def render(turns, trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the UTF-8 byte spans of the trained role's escaped texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role, True)}:\n", escape(text)
        start = at + len(head.encode())
        end = start + len(body.encode())
        if role == trained:
            spans.append((start, end))
        out += [head, body, "\n</turn>\n"]
        at = end + len("\n</turn>\n")
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]):
    """Which tokens lie inside a span, and the part of each span that they cover, from sorted token and span offsets."""
    mask, covered = np.zeros(len(starts), bool), []
    for lo, hi in spans:
        first = int(np.searchsorted(starts, lo, "left"))
        last = int(np.searchsorted(ends, hi, "right"))
        if first < last:
            mask[first:last] = True
            covered.append((int(starts[first]), int(ends[last - 1])))
        else:
            covered.append((lo, lo))
    return mask, covered


def _pieces(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    to = {c: i for i, c in enumerate(byte_alphabet())}
    vocab = encoder(path).whole.get_vocab()
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        # A special token's own string needn't be of the byte alphabet.
        out[i] = bytes(to[c] for c in token) if all(c in to for c in token) else token.encode()
    return out


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([np.zeros(0, parts[0].dtype if parts else np.int32), *parts]), kind))


SCHEMA = "conv_id long, formatted string, ids array<int>, loss_mask array<boolean>, loss_spans array<struct<start: long, end: long>>"


def format_chat(conversations: DataFrame, path: str, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, ids, loss_mask (by token) and loss_spans (UTF-8 bytes, one per trained turn).

    conversations: conv_id, turn, role, text; other columns are ignored. Turns
    are in order of turn (null first), then role, then text; repeated rows are
    repeated turns. A null role or text is empty. Rows without a conv_id are
    left out. A conversation is rendered whole, so it has to fit in memory.
    """

    def run(batches):
        e = encoder(path)
        size = np.array([len(x) for x in _pieces(path)], np.int64)
        for batch in batches:
            out: list = [[], [], [], []]
            for turns in batch.column("turns").to_pylist():
                text, spans = render([(t["role"], t["text"]) for t in turns], trained)
                ids = np.frombuffer(e.encode_plain(text), "<u4")
                ends = np.cumsum(size[ids])
                mask, covered = loss_mask(ends - size[ids], ends, spans)
                for c, v in zip(out, (text, ids.astype(np.int32), mask, [{"start": a, "end": b} for a, b in covered]), strict=True):
                    c.append(v)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(out[0], pa.string()), _lists(out[1], pa.int32()), _lists(out[2], pa.bool_()), pa.array(out[3], span)], names=["conv_id", "formatted", "ids", "loss_mask", "loss_spans"])

    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).where("conv_id is not null")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return whole.mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame, path: str) -> DataFrame:
    """Digests of what formatted conversations hold: turns parsed from the text, and the text of the ids under the loss mask."""

    def run(batches):
        pieces = _pieces(path)
        for batch in batches:
            out: list = [[] for _ in range(5)]
            for k, text in enumerate(batch.column("formatted").to_pylist()):
                ids, mask = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("ids", "loss_mask"))
                turns = parse(text)
                loss = unescape(b"".join(map(pieces.__getitem__, ids[mask].tolist())).decode())
                every = "".join(f"{role}\n{body}\n" for role, body in turns)
                for c, v in zip(out, (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, pa.string() if k in (1, 3) else pa.int64()) for k, c in enumerate(out))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "ids", "loss_mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
