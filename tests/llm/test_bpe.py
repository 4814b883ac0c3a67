"""Own transducers against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lamina.llm import bpe
from lamina.llm.bpe import Transducer, bpe_decode, bpe_encode, bpe_round_trip, sufficient_lookahead, transducer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pair():
    return Transducer(PATH), Tokenizer.from_file(PATH)


def ids(t, text):
    return list(memoryview(b"".join(t.encode(text))).cast("I"))


ODD = ["", " ", "Hello, world's END", "ΣΑΣ Σ İstanbul ñ \x1c a\x85b", "½ ² ٣ 中文 😀😀", "x<|endoftext|>The <|EndOfText|>", "<|startoftext|><|endoftext|>", "''s don't'LL", "\x00\x01\U0010ffff", "ª º µ ﬁ ǅ"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(pair, text):
    t, lib = pair
    want = lib.encode(text, add_special_tokens=False).ids
    assert ids(t, text) == want
    assert "".join(t.decode(want)) == lib.decode(want, skip_special_tokens=False)


def test_long_words_stream(pair):
    t, lib = pair
    r, chunk = random.Random(1), t.chunk
    t.chunk = 64
    try:
        for alphabet in ("ab", "a", "thea", "aeiounrst"):
            w = "".join(r.choice(alphabet) for _ in range(6000))
            t.words.clear()
            assert ids(t, w) == lib.encode(w, add_special_tokens=False).ids
    finally:
        t.chunk = chunk


BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("text", [*ODD, "Hello World", "  two  spaces\n\n x", "naïve café 日本語", " " * 300 + "x", "tail   "])
def test_byte_level_file(text):
    """Another kind of file: words keep their spaces, and ids decode to the very text."""
    t, lib = transducer(BYTES), Tokenizer.from_file(BYTES)
    want = lib.encode(text, add_special_tokens=False).ids
    assert ids(t, text) == want
    assert "".join(t.decode(want)) == lib.decode(want, skip_special_tokens=False) == text


def test_bytes_inside_characters_wait():
    """Tokens that are parts of characters come out as text once it is whole, in whatever parts they come."""
    t, lib = transducer(BYTES), Tokenizer.from_file(BYTES)
    r = random.Random(7)
    for n in (1, 5, 200, 9000):
        some = [r.randrange(300) if r.random() < 0.5 else r.randrange(50_257) for _ in range(n)]
        assert "".join(t.decode(some)) == lib.decode(some, skip_special_tokens=False)
    text = "日本語😀" * 5000
    some = lib.encode(text).ids
    assert "".join(t.decode(some)) == text


def test_windows_and_long_words_agree(monkeypatch, pair):
    monkeypatch.setattr(bpe, "WINDOW", 50)
    for path in (PATH, BYTES):
        t, lib = transducer(path), Tokenizer.from_file(path)
        text = ("word  and " + "x" * 300 + "\n\n  é ") * 20
        assert ids(t, text) == lib.encode(text, add_special_tokens=False).ids
        assert max(map(len, t.words), default=0) <= bpe.LONG


def test_other_files_are_refused(tmp_path):
    spec = json.load(open(BYTES, encoding="utf-8"))
    for part, value in (("decoder", {"type": "WordPiece", "prefix": "##", "cleanup": True}), ("pre_tokenizer", {"type": "Whitespace"})):
        path = tmp_path / f"{part}.json"
        path.write_text(json.dumps(spec | {part: value}))
        with pytest.raises(ValueError, match="tokenizer file with"):
            Transducer(str(path))


def test_lookahead_of_small_merge_lists():
    """No token changes that lies the lookahead before the end, whatever follows."""
    r = random.Random(5)
    for _ in range(60):
        names, parts, seen = {0: "a", 1: "b"}, [], set()
        for _ in range(r.randint(1, 8)):
            a, b = r.choice(list(names)), r.choice(list(names))
            if names[a] + names[b] not in seen | {"a", "b"}:
                seen.add(names[a] + names[b])
                names[len(names)] = names[a] + names[b]
                parts.append((a, b, len(names) - 1))
        t = Transducer.__new__(Transducer)
        t.merges = {a << 20 | b: (k, m) for k, (a, b, m) in enumerate(parts)}
        far = sufficient_lookahead(parts)
        word = [r.randint(0, 1) for _ in range(40)]
        short = t._merge(word[:30])
        for tail in range(6):
            full = t._merge(word[:30] + [r.randint(0, 1) for _ in range(tail * 3)])
            at = 0
            for x, y in zip(short, full, strict=False):
                if at + len(names[x]) > 30 - far:
                    break
                assert x == y
                at += len(names[x])


def test_queries_of_whole_texts(spark, pair):
    _, lib = pair
    rows = [(1, None), (2, ""), (3, "A word " * 5000), (None, "x"), (3, "A word"), (4, "longword" * 20_000)]
    got = bpe_round_trip(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens"), PATH).collect()
    want = []
    for i, x in rows:
        e = lib.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    e = bpe_encode(spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string"), PATH)
    assert {r.doc_id: r.text for r in bpe_decode(e, PATH).collect()} == {1: "some</w> text</w>", 2: ""}
    assert bpe_round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
