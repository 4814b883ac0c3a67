"""Alignment of two tokenizers' tokens over the bytes of the same text.

The ends of a text's B tokens are a static index of disjoint intervals in order.
Two bisections for each A token find the B tokens that it overlaps; where
neighbouring A tokens overlap no common B token, both tokenizers end, and a
group of tokens that cover the same bytes is complete.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counted
from . import textkernel as K
from .packing import encoder
from .shared import Scratch

#: A chunk of documents is complete with so many links.
CHUNK = 400_000
#: Words that are kept with their pieces, for each Python worker, and the longest of them.
CACHE, LONG = 300_000, 64


class Pieces:
    """Encodes texts with a sentencepiece model, word by word where its vocabulary makes that exact."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: No piece has a space after another character, so no merge reaches over the start of a word.
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        self.words: dict[str, tuple[bytes, bool]] = {}

    def _whole(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """(ids, whether they are the bytes of a space and the text) of each text."""
        out = []
        for text, ids in zip(texts, self.model.encode(texts, num_threads=1), strict=True):
            out.append((np.array(ids, "<u4").tobytes(), b"".join([self.bytes[i] for i in ids]) == b" " + text.encode()))
        return out

    def encode(self, text: str) -> tuple[bytes, bool]:
        """The ids of a text, little-endian, and whether they stand for the bytes of a space and the text."""
        if not self.by_word or not text or text.endswith(" ") or "▁" in text:
            return self._whole([text])[0]
        words = re.findall(" +[^ ]+", " " + text)
        new = list(set(words).difference(self.words))
        if not new:
            found = list(map(self.words.__getitem__, words))
        else:
            made = dict(zip(new, self._whole([w[1:] for w in new]), strict=True))
            found = [made.get(w) or self.words[w] for w in words]
            if len(self.words) + len(new) > CACHE:
                self.words.clear()
            self.words.update((w, x) for w, x in made.items() if len(w) <= LONG)
        return b"".join([x for x, _ in found]), all([ok for _, ok in found])


@dataclass
class Aligned:
    """Links of texts, and the groups that tile them. Token numbers run over all texts."""

    a: np.ndarray  # A token of each link
    b: np.ndarray  # B token of each link
    group_a: np.ndarray  # group of each A token, over all texts
    group_b: np.ndarray
    groups: np.ndarray  # groups of each text


def align(a_ends: np.ndarray, a_off: np.ndarray, b_ends: np.ndarray, b_off: np.ndarray) -> Aligned:
    """a_ends, b_ends: where each token ends, in bytes over all texts; a_off, b_off: each text's first token, then the end.

    Tokens are not empty, and the tokens of both sides cover the same bytes.
    """
    a_start, b_start = np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])
    lo = np.searchsorted(b_ends, a_start, "right")
    hi = np.searchsorted(b_start, a_ends, "left")
    n = hi - lo
    first = np.cumsum(n) - n
    a = np.repeat(np.arange(len(a_ends)), n)
    b = np.arange(int(n.sum())) - np.repeat(first, n) + np.repeat(lo, n)
    # The gap between two A tokens is spanned if a B token lies on both sides of it.
    new = np.ones(len(a_ends), bool)
    new[1:] = hi[:-1] <= lo[1:]
    group_a = np.cumsum(new) - 1
    group_b = np.zeros(len(b_ends), np.int64)
    group_b[b] = group_a[a]
    total = np.concatenate([[0], np.cumsum(new)])
    return Aligned(a, b, group_a, group_b, total[a_off[1:]] - total[a_off[:-1]])


def _digits(n: int) -> np.ndarray:
    """The decimal digits of 0 to n - 1 in six bytes each, on the right; leading ones are 0."""
    out = np.zeros((n, 6), np.uint8)
    k = np.arange(n)
    for place in range(5, -1, -1):
        out[:, place] = np.where((k > 0) | (place == 5), k % 10 + 48, 0)
        k = k // 10
    return out


_DIGITS = _digits(1 << 17)


def written(ids_a: np.ndarray, ids_b: np.ndarray, x: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """The groups as `a1,a2|b1;` bytes, and where each group ends in them. ids are below 131,072."""
    na, nb, groups = len(ids_a), len(ids_b), int(x.group_a[-1]) + 1 if len(x.group_a) else 0
    count_a, count_b = np.bincount(x.group_a, minlength=groups), np.bincount(x.group_b, minlength=groups)
    before_b, upto_a = np.cumsum(count_b) - count_b, np.cumsum(count_a)
    at_a, at_b = np.arange(na) + before_b[x.group_a], np.arange(nb) + upto_a[x.group_b]
    out = np.full((na + nb, 7), 44, np.uint8)
    out[at_a, :6], out[at_b, :6] = _DIGITS[ids_a], _DIGITS[ids_b]
    last_b = np.cumsum(count_a + count_b) - 1
    out[last_b - count_b, 6], out[last_b, 6] = 124, 59
    shown = out != 0
    ends = np.cumsum(shown.sum(1))[last_b] if groups else np.zeros(0, np.int64)
    return out[shown], ends


_LOADED: dict[str, Pieces] = {}


def piece_encoder(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


class _Chunk:
    """Collects documents; what it hands out is one row of `_CHUNK`."""

    def __init__(self):
        self.docs: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.links = 0

    def row(self, number: int) -> list:
        pairs = np.concatenate([*self.pairs, np.zeros(0, np.int64)])
        keys, local, n = np.unique(pairs, return_inverse=True, return_counts=True)
        # Frequent pairs get small numbers, which take less room.
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(keys), np.int32)
        rank[order] = np.arange(len(keys), dtype=np.int32)
        docs = pa.Table.from_pylist([dict(zip(_DOC, d, strict=True)) for d in self.docs], schema=_DOCS)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema) as w:
            w.write_table(docs)
        return [number, keys[order].tobytes(), n[order].astype(np.int32).tobytes(), sink.getvalue().to_pybytes(), np.concatenate([*self.sizes, np.zeros(0, np.int32)]).astype(np.int32).tobytes(), rank[local].tobytes(), np.concatenate([*self.times, np.zeros(0, np.int32)]).astype(np.int32).tobytes()]


_DOC = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_DOCS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
_CHUNK = "chunk long, keys binary, counts binary, docs binary, sizes binary, pairs binary, times binary"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _ids(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int64)
    return np.frombuffer(b"".join(parts), "<u4").astype(np.int64), off


def aligned_chunks(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK) -> DataFrame:
    """Chunks of aligned documents: their figures, and for each its distinct pairs of ids with their number of links.

    keys are the pairs, a * 2^32 + b, and counts how many of the chunk's documents hold them linked.
    """

    @K.lean
    def run(batches):
        a, b = encoder(path_a), piece_encoder(path_b)
        entries = _entries(a)
        size_a = np.array([len(x) for x in entries], np.int64)
        size_b = np.array([len(x) for x in b.bytes], np.int64)
        part, number = TaskContext.get().partitionId(), 0
        held = _Chunk()
        for batch in batches:
            texts = batch.column("text")
            for lo, hi, data, off in K.pieces(texts):
                both_a, both_b = [], []
                for k in range(hi - lo):
                    raw = bytes(data[off[k] : off[k + 1]])
                    x, (y, same) = b"", (b"", False) if not raw else b.encode(raw.decode())
                    if same:
                        x = a.encode_plain(" " + raw.decode())
                        # Ranked files have no normalizer and give back any bytes.
                        same = a.fast is not None or b"".join([entries[i] for i in np.frombuffer(x, "<u4").tolist()]) == b" " + raw
                    both_a.append(x if same else b"")
                    both_b.append(y if same else b"")
                ids_a, off_a = _ids(both_a)
                ids_b, off_b = _ids(both_b)
                x = align(np.cumsum(size_a[ids_a]), off_a, np.cumsum(size_b[ids_b]), off_b)
                text, ends = written(ids_a, ids_b, x)
                upto = np.cumsum(x.groups)
                cut = np.concatenate([[0], ends])[np.concatenate([[0], upto])]
                row = np.searchsorted(off_a, x.a, "right") - 1
                pair = ids_a[x.a] << 32 | ids_b[x.b]
                order = np.lexsort((pair, row))
                row, pair = row[order], pair[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])
                at = np.flatnonzero(new)
                times, links = np.diff(np.concatenate([at, [len(row)]])), np.bincount(row, minlength=hi - lo)
                n, pair, row = np.bincount(row[at], minlength=hi - lo), pair[at], None
                first = np.concatenate([[0], np.cumsum(n)])
                ids = batch.column("doc_id").slice(lo, hi - lo).to_pylist()
                for k in range(hi - lo):
                    sha = hashlib.sha256(text[cut[k] : cut[k + 1] - 1].tobytes()).hexdigest() if x.groups[k] else ""
                    held.docs.append((ids[k], int(off_a[k + 1] - off_a[k]), int(off_b[k + 1] - off_b[k]), int(x.groups[k]), int(links[k]), sha))
                    held.links += int(links[k])
                held.pairs.append(pair)
                held.sizes.append(n)
                held.times.append(times)
                if held.links >= chunk:
                    yield _batch(held.row(part << 32 | number))
                    held, number = _Chunk(), number + 1
        if held.docs:
            yield _batch(held.row(part << 32 | number))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _CHUNK)


def _entries(a) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary."""
    from .bpe import byte_alphabet

    to = {c: i for i, c in enumerate(byte_alphabet())}
    vocab = a.whole.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        out[i] = bytes(to[c] for c in t) if all(c in to for c in t) else t.encode()
    return out


def _batch(row: list) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _CHUNK.split(", ")])


def tokenizer_alignment(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK) -> DataFrame:
    """Aligns whole texts' tokens by byte-level file A with those by sentencepiece model B; one row per input row.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256. An id pair's count is the number of rows of docs that hold it
    linked. Null and empty texts, and texts that either tokenizer doesn't give
    back, have no tokens: zeros and an empty digest. Equal rows count each for
    itself; a null doc_id stays null. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "align")
    chunks = scratch.write(aligned_chunks(docs, path_a, path_b, chunk), "chunks")
    total = scratch.write(counted.totals(chunks), "totals")
    best = total.groupBy(F.shiftright("key", 32).alias("a")).agg(F.max("total").alias("best"))
    known = total.withColumn("a", F.shiftright("key", 32)).join(best, "a").select("key", "total", (F.col("total") == F.col("best")).cast("long").alias("is_best"))

    def run(row, total, is_best):
        with pa.ipc.open_stream(row["docs"]) as r:
            docs = r.read_all()
        sizes, pairs, times = (np.frombuffer(row[c], np.int32) for c in ("sizes", "pairs", "times"))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        sums = []
        for v in (is_best, total):
            s = np.zeros(len(sizes), np.int64)
            np.add.at(s, doc, v[pairs] * times)
            sums.append(pa.array(s))
        return pa.table([*(docs.column(c) for c in _DOC[:5]), *sums, docs.column("groups_sha256")], names=[*_DOC[:5], "n_best", "count_sum", "groups_sha256"])

    return counted.with_totals(chunks, known, ["total", "is_best"], run, _RESULT)
