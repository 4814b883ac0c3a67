import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lamina.llm.packing import Encoder, best_fit, plan

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fill(sizes, capacity):
    used, total = {}, {}
    for size, lo, hi, first, offset in plan(sizes, capacity):
        total[size] = total.get(size, 0) + hi - lo
        for k in range(hi - lo):
            used.setdefault(first + k, []).append((offset, size))
    assert total == sizes
    for parts in used.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    return len(used)


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for size in sorted((s for s, n in sizes.items() for _ in range(n)), reverse=True):
        fits = [g for g in gaps if g >= size]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - size)
        else:
            gaps.append(capacity - size)
    return len(gaps)


def test_plan_is_as_good_as_one_by_one():
    r = random.Random(7)
    for _ in range(25):
        capacity = r.choice([10, 64, 100])
        sizes = {s: r.randint(1, 12) for s in r.sample(range(1, capacity + 1), r.randint(1, 9))}
        assert fill(sizes, capacity) <= best_fit_decreasing(sizes, capacity) + 1
    assert fill({700: 1000}, 2048) == 500


def test_pieces_against_the_library(spark, docs_kind):
    lib = Tokenizer.from_file(PATH)
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "<|endoftext|> é 中"), (5, "x" * 3000), (6, "same"), (6, "same"), (None, "z")]
    got = best_fit(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS sequence_id", "3 AS lo"), PATH).toPandas()
    for i, text in rows[:5]:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        own = got[got.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and list(own.start) == list(np.cumsum(own.length) - own.length)
        assert all(own.length[1:] == 2048) if len(own) > 1 else len(ids) <= 2048
        assert [zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for s, n in zip(own.start, own.length, strict=True)] == list(own.ids_crc32)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == list(np.cumsum(g.length) - g.length) and g.length.sum() <= 2048
    assert len(got[got.doc_id == 6]) == 2 and got.doc_id.isna().sum() == 1
    assert best_fit(spark.createDataFrame([], docs_kind), PATH).collect() == []


def test_fast_path_is_the_library():
    e = Encoder(PATH)
    assert e.fast is not None
    for text in ["  a  b \n\n c\t ", "a ’s it's", " 12a_3", "Größe, naïve — façade…", "\r\n\r\n", "don't'LL 've"]:
        assert e.encode(text) == np.array(e.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
