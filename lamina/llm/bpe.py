"""BPE encoding and decoding as bounded-lookahead streaming transducers.

The merge list alone fixes how far to the right of a token anything can change
it (its sufficient lookahead). The encoder reads symbols, merges a buffer and
emits each token as soon as the lookahead lies behind it, so its memory doesn't
grow with the text. The decoder turns ids into bytes and bytes into text with an
incremental UTF-8 state machine.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

#: Letters and the other characters of texts for which the plain patterns below agree with Unicode's classes.
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_PLAIN = re.compile(f"[\\t\\n\\r\\x20-\\x7e{_LETTER}–—‘-”…]*\\Z")
#: Words that are kept with their ids, for each Python worker, and the longest of them; longer ones stream.
CACHE, LONG = 300_000, 64
#: Characters of a text that are looked at together.
WINDOW = 1 << 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


# The word pattern and normalizers for which the plain pattern below is exact.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = ["NFC", "Replace", "Lowercase"]


def _refuse(spec: dict) -> None:
    """Files with rules that the transducers don't follow are errors, never wrong ids."""
    model, decoder = spec["model"], spec.get("decoder") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [f"added token {t['content']!r}" for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if model.get("type") != "BPE":
        odd.append(f"model {model.get('type')}")
    if decoder.get("type", "ByteLevel") != "ByteLevel":
        odd.append(f"decoder {decoder['type']}")
    if "ByteLevel" not in json.dumps(spec.get("pre_tokenizer")) or '"add_prefix_space": true' in json.dumps(spec.get("pre_tokenizer")):
        odd.append("pre-tokenizer")
    if odd:
        raise ValueError(f"tokenizer file with {', '.join(odd)}")


class Transducer:
    """The merge list of a tokenizer file, its sufficient lookahead, and streaming encoding of one word.

    Takes byte-level BPE files, with or without an end-of-word suffix, normalizer
    and decoder; files with other rules are refused.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _refuse(spec)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.tail = model.get("end_of_word_suffix") or ""
        letters = byte_alphabet()
        self.inner = [vocab.get(c) for c in letters]
        self.final = [vocab.get(c + self.tail) for c in letters]
        self.merges: dict[int, tuple[int, int]] = {}
        parts = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ", 1)
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.merges.setdefault(left << 20 | right, (rank, made))
            parts.append((left, right, made))
        self.lookahead = sufficient_lookahead(parts)
        self.chunk = max(4096, 4 * self.lookahead)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.to_byte = {c: i for i, c in enumerate(letters)}
        # With a decoder tokens are their bytes, which follow each other; without one they stand as they are, a space between.
        self.joint = b"" if spec.get("decoder") else b" "
        own = (lambda t: bytes(self.to_byte[c] for c in t)) if spec.get("decoder") else str.encode
        self.texts = {i: own(t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.size = {i: len(t.removesuffix(self.tail)) for t, i in vocab.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec["pre_tokenizer"].get("pretokenizers") or [{}])[0].get("pattern") or {}).get("Regex")
        self.plain = kinds == _NORMAL and split == _WORDS
        whole = Tokenizer.from_file(path)
        whole.no_truncation()
        whole.no_padding()
        self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer
        self.words: dict[str, bytes] = {}

    # One word

    def _merge(self, word: list[int]) -> list[int]:
        """All merges of a buffer, by rank and then from the left."""
        get = self.merges.get
        if len(word) > 48:
            return self._merge_long(word)
        while len(word) > 1:
            best, made = 1 << 30, 0
            left = word[0]
            for right in word[1:]:
                m = get(left << 20 | right)
                if m is not None and m[0] < best:
                    best, made, pair = m[0], m[1], (left, right)
                left = right
            if best == 1 << 30:
                break
            out, i, n, (a, b) = [], 0, len(word), pair
            while i < n:
                if i + 1 < n and word[i] == a and word[i + 1] == b:
                    out.append(made)
                    i += 2
                else:
                    out.append(word[i])
                    i += 1
            word = out
        return word

    def _merge_long(self, word: list[int]) -> list[int]:
        get, n = self.merges.get, len(word)
        word, after, before = word[:], [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(m[0], i, word[i], word[i + 1], m[1]) for i in range(n - 1) if (m := get(word[i] << 20 | word[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if word[i] == a else n
            if j >= n or word[j] != b:
                continue
            word[i], word[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := get(made << 20 | word[k]):
                    heapq.heappush(heap, (m[0], i, made, word[k], m[1]))
            h = before[i]
            if h >= 0 and (m := get(word[h] << 20 | made)):
                heapq.heappush(heap, (m[0], h, word[h], made, m[1]))
        return [t for t in word if t >= 0]

    def encode_bytes(self, symbols: Iterable[int]) -> Iterator[int]:
        """Ids of one word from its bytes, emitted once stable; holds chunk + lookahead symbols at most."""
        buffer: list[int] = []
        last = None
        for b in symbols:
            if last is not None and (s := self.inner[last]) is not None:
                buffer.append(s)
            last = b
            if len(buffer) >= self.chunk + self.lookahead:
                done, used = self._stable(buffer)
                yield from done
                buffer = buffer[used:]
        if last is not None and (s := self.final[last]) is not None:
            buffer.append(s)
        yield from self._merge(buffer)

    def _stable(self, buffer: list[int]) -> tuple[list[int], int]:
        """The tokens of a buffer that lie the lookahead before its end, and how many symbols they cover."""
        done, used, most = [], 0, len(buffer) - self.lookahead
        for t in self._merge(buffer):
            size = self.size[t]
            if used + size > most:
                break
            used += size
            done.append(t)
        return done, used

    # Texts

    def pack(self, word: str) -> bytes:
        return b"".join(t.to_bytes(4, "little") for t in self.encode_bytes(word.encode()))

    def _cached(self, words: list[str]) -> bytes:
        known = self.words
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = self.pack(w)
        return b"".join(map(known.__getitem__, words))

    def _in_parts(self, words: list[str]) -> Iterator[bytes]:
        """The ids of words; those of long words as they become stable."""
        at = 0
        for k, w in enumerate(words):
            if len(w) > LONG:
                if at < k:
                    yield self._cached(words[at:k])
                at, ids = k + 1, self.encode_bytes(w.encode())
                while part := b"".join(t.to_bytes(4, "little") for t in itertools.islice(ids, 8192)):
                    yield part
        if at < len(words):
            yield self._cached(words[at:])

    def _windows(self, text: str) -> Iterator[str]:
        """Parts of a text that end before white space, so that no word is cut."""
        at = 0
        while len(text) - at > WINDOW:
            m = re.compile(r"(?<=\S)\s").search(text, at + WINDOW)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def encode(self, text: str | None) -> Iterator[bytes]:
        """The ids as little-endian 32-bit integers, in parts."""
        if not text:
            return
        spans = [text] if not any(t in text for t in self.special) else self.split_special.split(text)
        for span in spans:
            if span in self.special and len(spans) > 1:
                yield self.special[span].to_bytes(4, "little")
            else:
                for part in self._windows(span):
                    if part:
                        yield from self._in_parts(self.split(part))

    _plain_split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\\s0-9{_LETTER}]+")

    def split(self, text: str) -> list[str]:
        """The words of a text: by a plain pattern where that is exact, else by the library's own rules."""
        if self.plain and _PLAIN.match(text):
            return self._plain_split.findall(text.lower())
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        to = self.to_byte
        return [bytes(to[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in self.pre_tokenizer.pre_tokenize_str(text)]

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of ids, special tokens included, in parts.

        Bytes that end inside a character wait for the next part; bytes that are
        none become replacement characters.
        """
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        ids, lead = iter(ids), b""
        while part := [self.texts[i] for i in itertools.islice(ids, 8192)]:
            yield machine.decode(lead + self.joint.join(part))
            lead = self.joint
        if rest := machine.decode(b"", True):
            yield rest


def sufficient_lookahead(parts: list[tuple[int, int, int]]) -> int:
    """Symbols to the right of a token that can still change it.

    parts: (left, right, made) of the merges by rank. A merge is undone from the
    right only by a merge of lower rank that takes a token of the right spine of
    one of its parts, and so on down the ranks. By rank, inside[t] is how far
    from its start the making of t depends on what follows, and reach[z] how far
    the merges so far with left part z depend on it.
    """
    length: dict[int, int] = {}
    inside: dict[int, int] = {}
    reach: dict[int, int] = {}
    spine: dict[int, set[int]] = {}
    for a, b, made in parts:
        for t in (a, b):
            length.setdefault(t, 1)
            inside.setdefault(t, 1)
            spine.setdefault(t, {t})

        def far(t: int) -> int:
            return max(inside[t], length[t] + max(reach.get(z, 0) for z in spine[t]))

        own = far(b)
        length[made] = length[a] + length[b]
        inside[made] = max(inside.get(made, 0), far(a), length[a] + own)
        spine[made] = spine.get(made, {made}) | spine[b]
        reach[a] = max(reach.get(a, 0), own)
    return max(reach.values(), default=0)


_LOADED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each path and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    return _LOADED[path]


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes whole texts; returns doc_id, n_tokens, ids_sha256, decoded_sha256, one row per input row.

    Ids and text go through the hashes in parts and are never held whole. Null
    counts as the empty text: no tokens, and the digests of no bytes. A null
    doc_id stays null. Other columns are ignored.
    """

    def run(batches):
        t = transducer(path)
        for batch in batches:
            n, enc, dec = [], [], []
            for text in batch.column("text").to_pylist():
                a, b, count = hashlib.sha256(), hashlib.sha256(), 0

                def ids(text=text, a=a):
                    nonlocal count
                    for part in t.encode(text):
                        a.update(part)
                        count += len(part) // 4
                        yield from memoryview(part).cast("I")

                for s in t.decode(ids()):
                    b.update(s.encode())
                n.append(count)
                enc.append(a.hexdigest())
                dec.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of each whole text; null and empty texts have none."""

    def run(batches):
        t = transducer(path)
        for batch in batches:
            ids = [memoryview(b"".join(t.encode(x))).cast("I").tolist() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<long>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of ids; null ids have the empty text."""

    def run(batches):
        t = transducer(path)
        for batch in batches:
            texts = ["".join(t.decode(x or ())) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
