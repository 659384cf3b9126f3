import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import chat as C

TOKENS = C.Tokens(open(C.VOCABULARY, encoding="utf-8").read())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("\\#:</>turn \n"), st.characters(exclude_categories=["Cs"]))))
def test_escape_is_reversible_and_hides_control_strings(text):
    shown = C.escape(text)
    assert C.unescape(shown) == text
    (ids,) = TOKENS.encode([shown])
    assert TOKENS.decode(ids) == shown and (ids < TOKENS.base).all()


def test_masks_cover_the_text_alone():
    role, text = TOKENS.encode(["assistant", "hello there"])
    ids, loss = TOKENS.turn(role, text, True)
    assert np.array_equal(ids[loss == 1], text) and loss.sum() == len(text)
    assert TOKENS.turn(role, text, False)[1].sum() == 0
    assert TOKENS.turn(role, text[:0], True)[1].sum() == 0


def expected(rows):
    by = defaultdict(list)
    for c, n, r, t in rows:
        by[c].append((n, r, t))
    out = {}
    for c, v in by.items():
        v.sort(key=lambda x: tuple((y is not None, y) for y in x))
        v = [(r or "", t or "") for _, r, t in v]
        loss = "".join(t for r, t in v if r == "assistant")
        out[c] = (len(v), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in v).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(f"### {C.escape(r, True)}: {C.escape(t)}</turn>\n") for r, t in v))
    return out


def test_query_reads_back_every_conversation(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "tie ### a"), (2, 0, None, "<|endoftext|>"), (2, None, "assistant", "é\n\\"), (3, 0, "a: b", ""), (None, 0, "user", "x"), (4, 0, "assistant", "long " * 5000), (4, 0, "assistant", "long " * 5000)]
    spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, ids string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in C.op8_chat_formatting(spark, str(tmp_path)).collect()}
    assert got == expected([*rows, (-7, 0, "user", C.CONTROL), (-7, 1, "assistant", C.CONTROL)])


def test_query_on_given_conversations(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in C.op8_chat_formatting(spark, sf).collect()}
    assert got == expected([*rows, (-7, 0, "user", C.CONTROL), (-7, 1, "assistant", C.CONTROL)])
