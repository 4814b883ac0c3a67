"""Language ID: script ranges narrow the candidates, then Viterbi over per-word scores with a switching penalty.

A word's score for a language is the sum of log probabilities of its byte
trigrams, as counted over all documents to learn from. Languages that a word's
script rules out are no candidates for it. The best path through a text's words
labels spans of one language each; the language with most of the text is its
prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from . import textkernel as K

#: Buckets of hashed byte trigrams.
BUCKETS = 1 << 16
#: Nats that a change of language costs.
SWITCH = 18.0
#: What a word costs in a language that its script rules out.
RULED_OUT = -60.0
#: Least share of a language's letters for a script to count as one of its scripts.
SCRIPT_SHARE = 0.02
# Scripts by ranges of Unicode; 0 is Latin. Where a word mixes scripts the later one counts, so kana over Han.
_RANGES = (
    (1, 0x0370, 0x03FF), (1, 0x1F00, 0x1FFF),  # Greek
    (2, 0x0400, 0x052F), (2, 0x1C80, 0x1C8F), (2, 0xA640, 0xA69F),  # Cyrillic
    (3, 0x0530, 0x058F),  # Armenian
    (4, 0x0590, 0x05FF),  # Hebrew
    (5, 0x0600, 0x06FF), (5, 0x0750, 0x077F), (5, 0x08A0, 0x08FF), (5, 0xFB50, 0xFDFF), (5, 0xFE70, 0xFEFF),  # Arabic
    (6, 0x0700, 0x074F),  # Syriac
    (7, 0x0900, 0x097F),  # Devanagari
    (8, 0x0980, 0x09FF),  # Bengali
    (9, 0x0A00, 0x0A7F),  # Gurmukhi
    (10, 0x0A80, 0x0AFF),  # Gujarati
    (11, 0x0B00, 0x0B7F),  # Odia
    (12, 0x0B80, 0x0BFF),  # Tamil
    (13, 0x0C00, 0x0C7F),  # Telugu
    (14, 0x0C80, 0x0CFF),  # Kannada
    (15, 0x0D00, 0x0D7F),  # Malayalam
    (16, 0x0D80, 0x0DFF),  # Sinhala
    (17, 0x0E00, 0x0E7F),  # Thai
    (18, 0x0E80, 0x0EFF),  # Lao
    (19, 0x0F00, 0x0FFF),  # Tibetan
    (20, 0x1000, 0x109F),  # Burmese
    (21, 0x10A0, 0x10FF), (21, 0x1C90, 0x1CBF),  # Georgian
    (22, 0x1200, 0x139F),  # Ethiopic
    (23, 0x1780, 0x17FF),  # Khmer
    (24, 0x1800, 0x18AF),  # Mongolian
    (25, 0x1100, 0x11FF), (25, 0x3130, 0x318F), (25, 0xAC00, 0xD7FF),  # Hangul
    (26, 0x2E80, 0x2FFF), (26, 0x3400, 0x9FFF), (26, 0xF900, 0xFAFF),  # Han
    (27, 0x3040, 0x30FF), (27, 0x31F0, 0x31FF),  # kana
)
#: Number of scripts; the last stands for letters beyond the first 65,536.
SCRIPTS = 29
_SCRIPT = np.zeros(1 << 16, np.int8)
for _k, _lo, _hi in _RANGES:
    _SCRIPT[_lo : _hi + 1] = _k


def _scripts(data: np.ndarray) -> np.ndarray | None:
    """The script of the character that starts at each byte, 0 elsewhere; None if all are Latin."""
    at = np.flatnonzero(data >= 0xCD)
    if not len(at):
        return None
    lead = data[at].astype(np.int32)
    one, two = (np.where(at + k < len(data), data[np.minimum(at + k, len(data) - 1)], 0).astype(np.int32) & 0x3F for k in (1, 2))
    code = np.where(lead < 0xE0, (lead & 0x1F) << 6 | one, (lead & 0xF) << 12 | one << 6 | two)
    out = np.zeros(len(data), np.int8)
    out[at] = np.where(lead >= 0xF0, SCRIPTS - 1, _SCRIPT[code])
    return out


def _words(data: np.ndarray, off: np.ndarray):
    """(start, end, row, script) of words, and of their bytes the trigram bucket and first place of each word."""
    a, b, row = K.spans(data, off, K.letters(data))
    if not len(a):
        z = np.zeros(0, np.int64)
        return a, b, row, z, z, z
    size = b - a
    starts = np.cumsum(size) - size
    pos = np.arange(int(size.sum())) + np.repeat(a - starts, size)
    low = K.folded(data).astype(np.uint32)
    mid = low[pos]
    left = np.concatenate([[np.uint32(0)], mid[:-1]])
    left[starts] = 0
    right = np.concatenate([mid[1:], [np.uint32(0)]])
    right[starts + size - 1] = 0
    with np.errstate(over="ignore"):
        key = (left * np.uint32(0x9E3779B1) + mid * np.uint32(0x85EBCA6B) + right * np.uint32(0xC2B2AE35)) >> np.uint32(16)
    by = _scripts(data)
    script = np.zeros(len(a), np.int64) if by is None else np.maximum.reduceat(by[pos], starts).astype(np.int64)
    return a, b, row, script, key, starts


@dataclass
class LanguageModel:
    langs: list[str]
    logp: np.ndarray  # languages x BUCKETS
    allowed: np.ndarray  # languages x SCRIPTS

    def scores(self, words) -> np.ndarray:
        _, _, _, script, key, starts = words
        w = np.stack([np.add.reduceat(p[key], starts) for p in self.logp], 1).astype(np.float64) if len(starts) else np.zeros((0, len(self.langs)))
        return np.where(self.allowed.T[script], w, w.max(1, keepdims=True) + RULED_OUT) if len(w) else w


def learn(docs: DataFrame) -> LanguageModel:
    """Trigram counts by language over all rows of (text, lang); rows with a null in either don't count."""

    def count(batches):
        by: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lo, hi, data, off in K.pieces(batch.column("text")):
                _, _, row, script, key, starts = words = _words(data, off)
                if not len(starts):
                    continue
                own = langs[lo:hi]
                size = words[1] - words[0]
                for lang in set(own.tolist()):
                    mask = (own == lang)[row]
                    total = by.setdefault(lang, np.zeros(BUCKETS + SCRIPTS, np.int64))
                    total[:BUCKETS] += np.bincount(key[np.repeat(mask, size)], minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(script[mask], weights=size[mask], minlength=SCRIPTS).astype(np.int64)
        if by:
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), pa.array([x.tobytes() for x in by.values()], pa.binary())], names=["lang", "counts"])

    def add(batches):
        by: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, c in zip(batch.column("lang").to_pylist(), batch.column("counts"), strict=True):
                by[lang] = by.get(lang, 0) + np.frombuffer(c.as_buffer(), np.int64)
        if by:
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), pa.array([x.tobytes() for x in by.values()], pa.binary())], names=["lang", "counts"])

    kind = "lang string, counts binary"
    rows = docs.select("text", "lang").where("text is not null and lang is not null").mapInArrow(count, kind)
    rows = rows.repartition(max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4), F.rand(7)).mapInArrow(add, kind)
    total: dict[str, np.ndarray] = {}
    for r in rows.toLocalIterator():
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(r.counts, np.int64)
    langs = sorted(total)
    logp = np.zeros((len(langs), BUCKETS), np.float32)
    allowed = np.zeros((len(langs), SCRIPTS), bool)
    for i, lang in enumerate(langs):
        c = total[lang][:BUCKETS] + 0.5
        logp[i] = np.log(c / c.sum())
        s = total[lang][BUCKETS:]
        allowed[i] = s >= SCRIPT_SHARE * max(1, s.sum())
    if langs:
        allowed[:, ~allowed.any(0)] = True  # a script that no language has narrows nothing
    return LanguageModel(langs, logp, allowed)


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best label of each word, for several texts at once.

    Maximises the scores' sum less switch for each change; of equal paths the
    one that stays, then the language that comes first.
    """
    if not scores:
        return []
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    n, langs = len(scores), scores[0].shape[1]
    size = np.array([len(scores[i]) for i in order])
    live = np.searchsorted(-size, -np.arange(size[0]) - 1, "right")  # texts with a word at each place
    flat = np.concatenate([scores[i] for i in order])
    first = np.cumsum(size) - size
    came = np.zeros((len(flat), langs), np.int16)
    v = np.zeros((n, langs))
    for t in range(size[0]):
        k = live[t]
        own = v[:k]
        if t:
            best = own.argmax(1)
            moved = own[np.arange(k), best][:, None] - switch
            came[first[:k] + t] = np.where(own >= moved, np.arange(langs), best[:, None])
            own = np.maximum(own, moved)
        v[:k] = own + flat[first[:k] + t]
    label = np.zeros(len(flat), np.int16)
    now = v.argmax(1)
    for t in range(size[0] - 1, -1, -1):
        k = live[t]
        label[first[:k] + t] = now[:k]
        now[:k] = came[first[:k] + t, now[:k]]
    out: list = [None] * n
    for at, i in enumerate(order):
        out[i] = label[first[at] : first[at] + size[at]]
    return out


def _settled(w: np.ndarray, top: int, switch: float) -> bool:
    """Whether the path that stays in top throughout is best: no stretch gains more than half a switch elsewhere."""
    for b in range(w.shape[1]):
        if b != top:
            c = np.cumsum(w[:, b] - w[:, top])
            low = np.minimum.accumulate(np.concatenate([[0.0], c[:-1]]))
            if (c - low).max() > switch / 2:
                return False
    return True


SCHEMA = "doc_id long, lang_pred string, score double, spans array<struct<lang: string, start: long, end: long>>"


def identify(docs: DataFrame, model: LanguageModel, switch: float = SWITCH, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score and spans (UTF-8 byte ranges), one row per input row, and the columns named in keep.

    score is the share of the letters in spans of lang_pred times the
    probability of lang_pred for those spans. A text that is null, empty or
    without a letter is `und` with score 0, as is every text if nothing was
    learned. Ties go to the language that comes first by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = StructType([*_parse_datatype_string(SCHEMA).fields, *(docs.schema[c] for c in keep)])

    def run(batches):
        model = shared.value
        langs = model.langs
        for batch in batches:
            rows = batch.column("text")
            pred, score, found = [], [], []
            for lo, hi, data, off in K.pieces(rows):
                words = _words(data, off)
                a, b, row = words[:3]
                w = model.scores(words) if langs else None
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                paths, hard = {}, []
                for i in range(hi - lo):
                    own = slice(cut[i], cut[i + 1])
                    if langs and own.stop > own.start:
                        top = int(w[own].sum(0).argmax())
                        if _settled(w[own], top, switch):
                            paths[i] = top
                        else:
                            hard.append(i)
                for i, path in zip(hard, viterbi([w[cut[i] : cut[i + 1]] for i in hard], switch), strict=True):
                    paths[i] = path
                for i in range(hi - lo):
                    own = slice(cut[i], cut[i + 1])
                    if i not in paths or not _has_letter(data[off[i] : off[i + 1]]):
                        pred.append("und")
                        score.append(0.0)
                        found.append([])
                        continue
                    total = w[own].sum(0)
                    path = paths[i]
                    if isinstance(path, int):
                        best, share = path, 1.0
                        spans = [{"lang": langs[path], "start": int(a[own][0] - off[i]), "end": int(b[own][-1] - off[i])}]
                    else:
                        size = np.bincount(path, weights=(b - a)[own], minlength=len(langs))
                        best = int(np.lexsort((-total, -size))[0])
                        share = float(size[best] / size.sum())
                        edge = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
                        stop = np.concatenate([edge[1:], [len(path)]]) - 1
                        spans = [{"lang": langs[path[x]], "start": int(a[own][x] - off[i]), "end": int(b[own][y] - off[i])} for x, y in zip(edge, stop, strict=True)]
                    # Over the words of its own spans, how likely the language is against the others.
                    mine = total if isinstance(path, int) else w[own][path == best].sum(0)
                    pred.append(langs[best])
                    score.append(float(share / np.exp(mine - mine[best]).sum()))
                    found.append(spans)
            out = [batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*out, *(batch.column(c) for c in keep)], names=["doc_id", "lang_pred", "score", "spans", *keep])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *dict.fromkeys(("text", *keep))).mapInArrow(run, kind)


def _has_letter(data: np.ndarray) -> bool:
    if ((data >= 97) & (data < 123) | (data >= 65) & (data < 91)).any():
        return True
    return any(map(str.isalpha, data.tobytes().decode("utf-8", "replace")))


def held_out(modulus: int, rest: int):
    """Whether crc32 of doc_id as text leaves rest; false without a doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == rest, F.lit(False))
