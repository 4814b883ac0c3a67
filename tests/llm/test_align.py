"""Alignment of two tokenizers against plain loops over bytes."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lamina.llm import align as A
from lamina.llm.bpe import byte_alphabet

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = [
    (1, "The naïve café, the  two   spaces"), (2, "日本語 😀😀 x"), (3, None), (4, ""), (5, " "), (6, " lead"), (7, "tail "), (8, "tail  "), (9, "a\tb\nc\r\n d"),
    (10, "the cat"), (11, "the cat"), (11, "the cat"), (12, "<|endoftext|> <s> </s> <unk> ▁ x▁y"), (None, "no id"), (13, "word " * 3000), (14, "x" * 5000), (15, "\x00\x01   　 ﬁ"), (16, "\n"), (17, "ab   \n  c"),
]


def naive(docs):
    """One row per document, by comparing byte ranges of all pairs of tokens."""
    lib = Tokenizer.from_file(PATH_A)
    lib.no_truncation()
    lib.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    to = {c: i for i, c in enumerate(byte_alphabet())}
    rows, df = [], Counter()
    for doc_id, text in docs:
        a = b = []
        if text:
            want = b" " + text.encode()
            a = [(i, bytes(to[c] for c in lib.id_to_token(i))) for i in lib.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i in sp.encode(text) for p in [sp.id_to_piece(i)]]
            if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
                a = b = []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, lo = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, s, _ in side if lo <= s < e) for side in spans))
            lo = e
        links, j = [], 0
        for i, s, e in spans[0]:
            while spans[1][j][2] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        df.update(set(links))
        rows.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (a, _), n in df.items():
        best[a] = max(best[a], n)
    return [(i, na, nb, g, len(x), sum(df[p] == best[p[0]] for p in x), sum(df[p] for p in x), sha) for i, na, nb, g, x, sha in rows]


@pytest.mark.parametrize("chunk", [1, 50, A.CHUNK])
def test_as_plain_loops(spark, chunk):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 AS n_a", "'x' AS chunk", "2 AS total").repartition(3)
    got = [tuple(r) for r in A.tokenizer_alignment(df, PATH_A, PATH_B, chunk).collect()]
    assert sorted(got, key=repr) == sorted(naive(DOCS), key=repr)


def test_whole_table(spark):
    """Every document of the smallest table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = naive([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = [tuple(r) for r in A.tokenizer_alignment(docs, PATH_A, PATH_B).collect()]
    assert sorted(got) == sorted(want)


def test_empty_table(spark):
    assert A.tokenizer_alignment(spark.createDataFrame([], "doc_id long, text string"), PATH_A, PATH_B).collect() == []


def test_interval_index():
    """Random tilings: links, groups and boundaries as by comparing all pairs."""
    r = random.Random(3)
    for _ in range(200):
        total = r.randint(1, 40)
        ends = [np.array(sorted({*(r.randint(1, total) for _ in range(r.randint(0, 12))), total})) for _ in range(2)]
        a, b = ends
        x = A.align(a, np.array([0, len(a)]), b, np.array([0, len(b)]))
        start = [np.concatenate([[0], e[:-1]]) for e in ends]
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if start[0][i] < b[j] and start[1][j] < a[i]]
        assert list(zip(x.a.tolist(), x.b.tolist(), strict=True)) == want
        assert x.groups.tolist() == [len(set(a.tolist()) & set(b.tolist()))]
        for ids, group in ((a, x.group_a), (b, x.group_b)):
            assert group.tolist() == [sum(e < v for e in set(a.tolist()) & set(b.tolist())) for v in ids.tolist()]


def test_word_by_word_is_exact(monkeypatch):
    p = A.Pieces(PATH_B)
    assert p.by_word
    r = random.Random(5)
    monkeypatch.setattr(A, "CACHE", 20)
    for _ in range(400):
        text = "".join(r.choice(["a", "the", " ", "  ", "é", "\n", "▁", "1", "x" * 70, "ing"]) for _ in range(r.randint(0, 30)))
        assert p.encode(text) == p._whole([text])[0]
        assert len(p.words) <= 40 and all(len(w) <= A.LONG for w in p.words)
