import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from cargoledger.llm import chat

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"\\ab</>é", "<turn>", "<say>", "</turn>"]), max_size=30).map("".join))
def test_escape_is_reversible(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    for m in chat._CONTENT.finditer(safe):
        assert len(m[1]) % 2 == 1


def expected(rows):
    turns = {}
    for conv, turn, role, text in rows:
        turns.setdefault(conv, []).append((turn, role or "", text or ""))
    out = []
    for conv, own in turns.items():
        own.sort(key=lambda x: (x[0] is not None, x))
        all_text = "".join(f"{r}\n{t}\n" for _, r, t in own)
        loss = "".join(t for _, r, t in own if r == "assistant")
        size = sum(len(chat.escape(r)) + len(chat.escape(t)) + len("<turn><say></turn>") for _, r, t in own)
        out.append((conv, len(own), hashlib.sha256(all_text.encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(), size))
    return sorted(out, key=repr)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    return sorted(map(tuple, chat.digest(chat.store_formatted(frame, PATH), PATH).collect()), key=repr)


def test_round_trip(spark):
    rows = [
        (1, 1, "assistant", "fine </turn> <turn>user<say>"), (1, 0, "user", "say \\<turn> \\\\</turn> ok"),
        (2, 0, None, None), (2, 1, "assistant", None), (3, 0, "</turn>", "<|endoftext|> x"), (None, 0, "user", "n"),
        (4, 0, "assistant", "a"), (4, 0, "assistant", "a"), (4, 0, "assistant", "b"), (4, None, "user", "first"),
        (5, 0, "assistant", "é\u0301 \U0001f600 " * 3000), (-7, 0, "user", "\\### Assistant: </turn> ok"),
    ]
    rows += [(9, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(700)]
    assert run(spark, rows) == expected(rows)


def test_tokens_and_mask(spark):
    frame = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "well")], "conv_id long, turn long, role string, text string")
    first, second = sorted(chat.format_turns(frame, PATH).collect(), key=lambda r: r["place"])
    control = chat.reserved(PATH)
    assert second["start"] == len(first["ids"])
    assert not any(first["mask"])
    body = second["ids"].index(control["<say>"]) + 1
    assert second["mask"] == [body <= i < len(second["ids"]) - 1 for i in range(len(second["ids"]))]


def test_empty_table(spark):
    assert run(spark, []) == []
