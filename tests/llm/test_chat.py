"""Examples against a plain expansion, and control strings that come back whole."""

import hashlib
import random

from faultline.llm import chat

PARTS = ["<|", "|>", "<|end|>", "\n", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "\\\\", "<", "|", ">", "a", "é😀", "<\\|", "<|>"]


def rows():
    rng = random.Random(2)
    made = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "assistant", None, "<|x|>"])
            text = None if rng.random() < 0.1 else "".join(rng.choices(PARTS, k=rng.randint(0, 12)))
            made.append((conv, turn, role, text, turn))
    made += [(None, 0, "user", "no id", 1), (None, 1, "assistant", "none", 1)]
    made += [(900, 1, "user", "same", 1), (900, 1, "user", "same", 1), (900, None, "assistant", "x" * 300000, 1)]
    rng.shuffle(made)
    return made


def plain():
    convs = {}
    for conv, turn, role, text, _ in rows():
        convs.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    return {c: sorted(t) for c, t in convs.items()}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escapes_leave_no_control_string():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 15)))
        packed = chat.escape(text)
        assert chat.unescape(packed) == text
        assert not any(c in packed for c in ["<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"])


def test_examples_and_digests(spark):
    table = spark.createDataFrame(rows(), "conv_id long, turn int, role string, text string, example int")
    examples = chat.expand(table)
    by = {}
    for r in examples.orderBy("conv_id", "example").collect():
        by.setdefault(r.conv_id, []).append(r)
    want = plain()
    assert set(by) == set(want)
    for conv, turns in want.items():
        ends = [k for k, t in enumerate(turns) if t[1] == "assistant"]
        targets = ends + ([len(turns) - 1] if turns[-1][1] != "assistant" else [])
        assert [chat.parse(e.text) for e in by[conv]] == [[t[1:] for t in turns[: k + 1]] for k in targets]
        for e, k in zip(by[conv], targets, strict=True):
            if e.loss_start is None:
                assert k not in ends
            else:
                assert chat.unescape(e.text[e.loss_start : e.loss_end]) == turns[k][2]
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    for conv, turns in want.items():
        loss = "".join(t[2] for t in turns if t[1] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), digest("".join(f"{t[1]}\n{t[2]}\n" for t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), digest(loss))
        assert r.formatted_chars == sum(len(e.text) for e in by[conv])


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.read_back(chat.expand(none)).count() == 0
