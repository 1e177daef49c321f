import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from pipetally.llm import chat

TEXT = st.one_of(st.text(max_size=40), st.text(alphabet="\\#</turn>: Aé🙂\n", max_size=40), st.sampled_from([r"\### Assistant: </turn> ok", "####", "\\", "<|endoftext|>", ""]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", "", "User"]), TEXT), TEXT), max_size=6))
def test_rendering_is_reversible_and_masks_are_exact(turns):
    turns = [tuple(s.encode("utf-8", "ignore").decode() for s in t) for t in turns]
    whole, spans = chat.render(turns)
    assert chat.parse(whole) == turns
    e = chat.tokenizer(public_tokenizers.path(chat.TOKENIZER)).encode(whole, add_special_tokens=False)
    at = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
    token, a, b = chat.overlaps(spans, at[:, 0], at[:, 1])
    assert chat.unescape("".join(whole[x:y] for x, y in zip(a, b))) == "".join(t for r, t in turns if r == "assistant")
    inside = [any(at[i, 0] < y and at[i, 1] > x for x, y in spans) for i in range(len(at))]
    assert sorted(set(token.tolist())) == [i for i, m in enumerate(inside) if m]


def test_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, None, "x"), (None, 0, "assistant", "no id"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, None, "user", "first"),
            (3, 1, "assistant", "a"), (4, 0, "assistant", "long text " * 20_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.formatted(df)
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(out).collect()}
    assert got == {1: (2, 0), 2: (1, 0), None: (1, 5), 3: (4, 3), 4: (1, 200_000)}
    three = out.filter("conv_id = 3").first()
    assert [t for _, t in chat.parse(three.formatted)] == ["first", "a", "a", "b"]
    assert len(three.loss_tokens) == len(three.loss_starts) == len(three.loss_ends) and max(three.loss_tokens) < len(three.token_ids)
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0
