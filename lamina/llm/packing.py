"""Best-fit packing of token sequences by bulk-synchronous rounds.

Pieces and gaps (the room left in open sequences) are kept sorted by size. A
round sweeps the sizes downwards and matches each piece to its successor, the
smallest gap that holds it and isn't taken in this round; the r-th piece of a
size takes the r-th gap, so ranks resolve every conflict. Then gaps shrink and
the next round begins, until no piece is left; pieces that no gap holds open
sequences of their own.

There are at most `capacity` sizes, so a sweep is planned on the histogram of
sizes, which has the same size for any corpus, and each plan row moves a whole
range of ranks. The pieces themselves are ranked and matched to the plan's
ranges on the executors.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import Scratch, salted_rank

CAPACITY = 2048
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: Texts on which every library splits words alike, without a run that takes a merge loop long.
_PLAIN = re.compile(f"[\\t\\n\\r\\x20-\\x7e{_LETTER}–—‘-”…]*\\Z")
_RUN = re.compile(r"\S{1000}|\s{1000}")


class Encoder:
    """The ids of the tokenizers library; plain texts take the same merges by rank, which is faster."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is all it has
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        with open(path, encoding="utf-8") as f:
            self.fast = self._ranked(json.load(f))

    @staticmethod
    def _ranked(spec: dict):
        """The vocabulary as ranks, if the file is byte-level BPE with its ids in order of its merges."""
        import tiktoken

        from .bpe import byte_alphabet

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        vocab, merges = model.get("vocab", {}), model.get("merges", [])
        made = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in merges]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if model.get("type") != "BPE" or spec.get("normalizer") or not plain or model.get("end_of_word_suffix") or None in made or made != sorted(set(made)) or len(made) + 256 != len(vocab):
            return None
        to = {c: i for i, c in enumerate(byte_alphabet())}
        # Fixed value: the word pattern of byte-level BPE.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks={bytes(to[c] for c in t): i for t, i in vocab.items()}, special_tokens={})

    def encode_plain(self, text: str) -> bytes:
        """As encode(), but strings of special tokens are ordinary text."""
        if not any(s in text for s in self.special):
            return self.encode(text)
        self.whole.encode_special_tokens = True
        try:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        finally:
            self.whole.encode_special_tokens = False

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a whole text; none for null."""
        if not text:
            return b""
        if self.fast is None or not _PLAIN.match(text) or _RUN.search(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def pieces(docs: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and the id end, cut from the back into pieces of capacity.

    A null text has the end alone; so has an empty one.
    """

    def run(batches):
        e = encoder(path)
        last = end.to_bytes(4, "little")
        for batch in batches:
            out: list = [[] for _ in range(5)]
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = memoryview(e.encode(text.as_py()) + last)
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for c, v in zip(out, (i, k, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi])), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(sizes: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Where the ranks of each size go: (size, first rank, last rank + 1, first sequence, offset).

    Rank r of a size goes to sequence first sequence + r - first rank. sizes:
    how many pieces there are of each size.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, n in sizes.items():
        left[size] = n
    done = np.zeros(capacity + 1, np.int64)
    gaps: dict[int, list[tuple[int, int]]] = {}  # room: ranges (first sequence, count)
    opened, out = 0, []

    def place(size: int, first: int, n: int, room: int) -> None:
        out.append((size, int(done[size]), int(done[size]) + n, first, capacity - room))
        done[size] += n
        left[size] -= n

    while left.any():
        # One sweep: the largest size first; a gap that was taken rests until the next round.
        resting: dict[int, list[tuple[int, int]]] = {}
        moved = False
        for size in np.flatnonzero(left)[::-1].tolist():
            for room in sorted(r for r in gaps if r >= size):
                while left[size] and gaps.get(room):
                    first, n = gaps[room].pop()
                    took = int(min(n, left[size]))
                    if took < n:
                        gaps[room].append((first + took, n - took))
                    place(size, first, took, room)
                    moved = True
                    if room > size:
                        resting.setdefault(room - size, []).append((first, took))
                if not gaps.get(room):
                    gaps.pop(room, None)
                if not left[size]:
                    break
            if left[size] and not any(r >= size for r in resting):
                # Nothing open can hold these, in this round or the next: they open as many
                # sequences as they need among themselves; the others follow in the next rounds.
                n = int(-(-left[size] // (capacity // size)))
                place(size, opened, n, capacity)
                if size < capacity:
                    resting.setdefault(capacity - size, []).append((opened, n))
                opened += n
                moved = True
        for room, ranges in resting.items():
            gaps.setdefault(room, []).extend(ranges)
        assert moved or resting
    return out


def best_fit(docs: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Packs all documents into sequences of at most capacity tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, one
    row per piece, so at least one per input row. Null and empty texts are one
    token, the end. Equal rows are packed each for itself. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.write(pieces(docs, path, end, capacity), "pieces")
    sizes = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return cut.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    ranges = spark.createDataFrame(plan(sizes, capacity), "length long, lo long, hi long, first long, offset long")
    keyed = cut.withColumn("_tie", F.struct("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted_rank(keyed, ["length"], "_tie", "_rank", sum(sizes.values())).drop("_tie")
    r = F.broadcast(ranges.withColumnRenamed("length", "_length"))
    placed = ranked.join(r, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("_rank") - F.col("lo")).alias("sequence_id"), "offset")
