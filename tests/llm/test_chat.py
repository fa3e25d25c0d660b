from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from strataspark.llm import chat
from strataspark.llm.suite import CONTROL_TEXT

ROWS = [
    (1, 1, "assistant", "Hello <|im_end|> you"), (1, 0, "user", "Hi\nthere"), (2, 0, "system", None), (2, 1, "user", ""), (2, 2, "assistant", ""),
    (2, 3, "assistant", "ünï 日本 🙂"), (None, 0, "user", "x"), (None, None, "assistant", "first"), (3, 0, None, "no role"), (4, 0, "assistant", "a"),
    (4, 0, "assistant", "a"), (5, 0, "user", CONTROL_TEXT), (5, 1, "assistant", CONTROL_TEXT), (6, 0, "assistant", "<\\|im_start|><\\\\|x " * 3000),
]


def brute(rows):
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[key] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_what_is_read_back(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    rows = chat.digests(chat.sequences(df)).collect()
    assert len(rows) == len({r[0] for r in ROWS})
    assert {r.conv_id: tuple(r[1:5]) for r in rows} == brute(ROWS)


def test_long_conversations_leave_in_chunks(spark):
    rows = [(key, i, ("user", "assistant")[i % 2], f"<|im_end|> turn {i} é日 " * 20) for key in (None, 7) for i in range(400)] + [(8, 0, "assistant", "x")]
    formatted = chat.sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    chunks = formatted.selectExpr("conv_id", "chunk", "size(ids) AS n").collect()
    assert max(r.n for r in chunks) < 2 * chat.CHUNK and len(chunks) > 10
    for key in (None, 7, 8):
        own = sorted(r.chunk for r in chunks if r.conv_id == key)
        assert own == list(range(len(own)))
    assert {r.conv_id: tuple(r[1:5]) for r in chat.digests(formatted).collect()} == brute(rows)


def test_real_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    got = {r.conv_id: tuple(r[1:5]) for r in chat.digests(chat.sequences(df)).collect()}
    assert got == brute([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, ids string")
    assert chat.digests(chat.sequences(df)).count() == 0


def test_texts_never_make_control_ids():
    tok = chat.tokenizer("byte_bpe_50k.tiktoken")
    ids = tok.encode(CONTROL_TEXT)
    assert tok.start not in ids and tok.end not in ids and tok.decode(ids) == CONTROL_TEXT


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<\\|im_startend>a ", max_size=40))
def test_escape_is_reversible(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert chat.START not in escaped and chat.END not in escaped


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), st.text(st.characters(exclude_categories=["Cs"]), max_size=30)), min_size=1, max_size=6))
def test_round_trip(turns):
    tok = chat.tokenizer("byte_bpe_50k.tiktoken")
    encoded = [(r, tok.encode(chat.escape(r)), tok.encode(chat.escape(t))) for r, t in turns]
    ids, mask = chat.assemble(encoded, tok, tok.encode("\n"))
    back = chat.read_back(ids, mask, tok)
    assert back["turns"] == turns
    assert back["loss_text"] == "".join(t for r, t in turns if r == "assistant")
