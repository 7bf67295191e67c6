import hashlib
import random

import pytest
from pyspark.sql import functions as F

from triagelake.llm import chat

NASTY = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<", "|im_end|>", "<\\", "<\\\\|", "a<b|c", "", "é\n\n", "<|image|>", "\\n<", None]


def want(rows):
    convs = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    learned = {c: "".join(x for r, x in turns if r == "assistant") for c, turns in convs.items()}
    return {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), len(learned[c]), sha(learned[c])) for c, t in convs.items()}


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_texts_come_back(spark, size):
    rng = random.Random(2)
    rows = [((c or None) and 2**60 + c, t, rng.choice(["user", "assistant", None, "a\nb", "x\\n<|im_end|>"]), "".join(filter(None, rng.choices(NASTY, k=3)))) for c in range(30) for t in rng.sample([None, *range(40)], rng.randint(1, 8))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    if size < 100:  # as with very long conversations: many chunks and ranges
        df = df.withColumn("parts", chat.text_part(F.concat("text", F.repeat(F.lit("y"), 1 << 19))))
        rows = [(c, t, r, x + "y" * (1 << 19)) for c, t, r, x in rows[:40]]
        df = df.join(spark.createDataFrame([(r[0], r[1]) for r in rows], "c long, t long"), F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")))
    chunks = chat.format_conversations(df)
    found = chat.read_back(chunks).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == want(rows)
    if size < 100:
        assert chunks.count() > len(found)


def test_parts_become_placeholders(spark):
    part = lambda **k: {n: k.get(n) for n in ("type", "text", "ref", "width", "height", "seconds", "pages")}
    parts = [
        part(type="text", text="see <"), part(type="text", text="|image|> "), part(type="image", ref="a.png", width=57, height=28), None, part(type="audio", ref="b.wav", seconds=2.0),
        part(type="text", text="and"), part(type="document", ref="c.pdf", pages=3), part(type="video", ref="d"), part(type="image", ref="e", width=-5),
    ]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [part(type="text", text="ok"), part(type="image", ref="f", width=28, height=28), part(type="text", text="<|x")]), (1, 2, None, None)]
    (r,) = chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).collect()
    assert r.formatted == "<|im_start|>user\nsee <\\|image|> <|image|><|audio|>and<|document|><|attachment|><|image|><|im_end|>\n<|im_start|>assistant\nok<|image|><\\|x<|im_end|>\n<|im_start|>\n<|im_end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 25), ("document", "c.pdf", 768), ("attachment", "d", 1), ("image", "e", 1), ("image", "f", 1)]
    assert all(r.formatted[a.at :].startswith(f"<|{a.kind}|>") for a in r.attachments) and r.n_tokens == 799
    assert [r.formatted[s.at : s.at + s.n] for s in r.loss] == ["ok", "<\\|x"]


def test_no_rows(spark):
    empty = spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART}>, formatted int")
    assert chat.read_back(chat.format_conversations(empty)).collect() == []
