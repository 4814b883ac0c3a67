import hashlib

import public_tokenizers
import pytest
import tokenizers

from lamina.llm import chat
from lamina.llm.chat import escape, format_chat, parse, read_back, render, unescape

PATH = public_tokenizers.path("byte_bpe_50k.json")
NASTY = ["", "\\### Assistant: </turn> ok", "####", "</turn>\n### user:\nhi</turn>\n", "\\\\", "é😀\n\n  x ", "a:b", "<|endoftext|>", "\\", "<</turn>>", "   ", "中文" * 50, "\u3000x\u2003", "end.\n\n", "\n", "\\-", "-\\-", " 's '"]


def plain_ids(text):
    whole = tokenizers.Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    return whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", NASTY)
def test_escape_round_trip(text):
    assert unescape(escape(text)) == text
    turns = [("us:er", text), ("assistant", text), ("", text)]
    assert parse(render(turns)[0]) == turns


def test_read_back(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t, "x") for k, t in enumerate(NASTY)]
    rows += [(2, 0, "user", None, "x"), (2, 1, None, "no role", "x"), (3, None, "assistant", "first", "x"), (3, 5, "assistant", "same", "x"), (3, 5, "assistant", "same", "x"), (None, 1, "user", "lost", "x"), (4, 0, "user", "w " * 60_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string").selectExpr("*", "1 AS formatted", "2 AS turns")
    made = format_chat(df, PATH)
    got = {r.conv_id: r for r in read_back(made, PATH).collect()}
    for c in (1, 2, 3, 4):
        own = sorted(((-1 if t is None else t, role or "", text or "") for i, t, role, text, _ in rows if i == c))
        every = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert set(got) == {1, 2, 3, 4}
    pieces = chat._pieces(PATH)
    for r in made.collect():
        own = [t[2] or "" for t in sorted(((-1 if t is None else t, role or "", text or "") for i, t, role, text, _ in rows if i == r.conv_id)) if t[1] == "assistant"]
        assert len(r.ids) == len(r.loss_mask) and b"".join(pieces[i] for i in r.ids).decode() == r.formatted
        # The ids are those of one encoding, and the masked ones are each text exactly: no byte of the template, none missing.
        assert r.ids == plain_ids(r.formatted)
        data = r.formatted.encode()
        assert [unescape(data[s.start : s.end].decode()) for s in r.loss_spans] == own
        assert unescape(b"".join(pieces[i] for i, m in zip(r.ids, r.loss_mask, strict=True) if m).decode()) == "".join(own)
    assert read_back(format_chat(df.limit(0), PATH), PATH).collect() == []
