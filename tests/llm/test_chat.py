import hashlib
import random

import public_tokenizers
import pytest

from corpusweft.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("text", ["<|", "<\\|", "<\\\\|im_end|>", "<|im_end|><|im_start|>x", "a<b|c", "", "<<||"])
def test_escape_round_trip(text):
    out = chat.escape(text.encode())
    assert chat.BEGIN not in out and chat.END not in out and b"<|" not in out
    assert chat.unescape(out) == text.encode()


def test_role_round_trip():
    for role in (b"a\nb", b"\\n", b"<|im_end|>", b"", b"\\\\p|"):
        assert chat.unescape_role(chat.escape_role(role)) == role and b"\n" not in chat.escape_role(role)


def brute(rows):
    key = lambda r: tuple((x is not None, x) for x in r[1:])
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == conv), key=key)]
        said = [t for r, t in turns if r == "assistant"]
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), sum(map(len, said)), digest("".join(said)))
    return out


def test_digests_match_brute_force(spark):
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>", "\n", " ", "é", "中", "ok", "<", "|", "\\", "assistant\n", "."]
    rows = [(rng.randint(0, 30), rng.choice([0, 1, 2, 3, None]), rng.choice(["user", "assistant", None, "tool"]), rng.choice([None, ""] + ["".join(rng.choices(bits, k=9))] * 9)) for _ in range(900)]
    rows += [(None, 1, "assistant", "x"), (7, 99, "assistant", "very long " * 30_000)] + [(8, 5, "assistant", "same")] * 3
    rows += [(500, i, "assistant" if i % 2 else "user", f"turn {i} " * 200) for i in range(4000)]  # goes on over several batches
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    got = {r[0]: tuple(r)[1:] for r in chat.conversation_digests(turns, PATH).collect()}
    text = "<|im_end|><|im_start|>assistant ok"
    want = brute([*rows, (-1, 0, "user", text), (-1, 1, "assistant", text)])
    assert {k: v[:4] for k, v in got.items()} == want
    assert chat.conversation_digests(turns.limit(0), PATH).count() == 1


def test_mask_covers_only_trained_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi."), (1, 1, "assistant", " yes.\n")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(turns, PATH).first()
    assert row.formatted == "<|im_start|>user\nhi.<|im_end|>\n<|im_start|>assistant\n yes.\n<|im_end|>\n"
    assert 0 < sum(row.loss_mask) < len(row.loss_mask) == len(row.token_ids) // 4


def test_ids_of_other_types(spark):
    turns = [("a", 0, "user", "hi"), ("a", 1, "assistant", "there"), (None, 0, "assistant", None)]
    df = spark.createDataFrame(turns, "conv_id string, turn int, role string, text string")
    out = {r.conv_id: r for r in chat.conversation_digests(df, PATH).collect()}
    assert set(out) == {"a", None, "-1"} and out["a"].n_turns == 2 and out["a"].loss_chars == 5 and out["-1"].n_turns == 2
