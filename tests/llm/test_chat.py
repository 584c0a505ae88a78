import random
from hashlib import sha256

import pytest
import public_tokenizers as P
from panelloom.llm import chat
import panelloom.llm.queries  # noqa: F401  (registers the queries)
from panelloom.llm.registry import QUERIES
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

FILE = P.path("byte_bpe_50k.tiktoken")
SCHEMA = "conv_id long, turn long, role string, text string"


def talks(seed=0, count=12):
    rng = random.Random(seed)
    words = ["<|im_end|>", "<|im_start|>assistant", "hello", "<\\|", "world\n", "|", "<", "é", "\U0001f600", "a b c d e"]
    rows = []
    for conv in range(count):
        lead = rng.random() < 0.5
        for turn in range(rng.choice([1, 2, 5, 30, 120])):
            role = "system" if lead and turn == 0 else rng.choice(["user", "assistant", "tool<|\nx", "system"])
            rows.append((conv, turn, role, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40, 200])))))
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", None), (100, 1, None, "none"), (100, 1, "assistant", "a"),
             (100, 1, "assistant", "a"), (100, 1, "assistant", "b"), (101, 0, "assistant", "x" * 30_000), (102, 0, "assistant", "")]
    return rows


def ordered(rows):
    convs = {}
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        key = (turn is not None, turn or 0, role.encode(), __import__("hashlib").md5(text.encode()).hexdigest())
        convs.setdefault(conv, []).append((key, role, text))
    return {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit("x") for c in ("block", "size", "part", "fresh", "of")})


@given(st.text(alphabet="<|\\\nab", max_size=30))
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible_and_leave_no_mark(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat._role(chat._head(text)) == text and "\n" not in chat._head(text) and "<|" not in chat._head(text)


@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.integers(0, 1), st.integers(0, 60), st.integers(0, 30))
@settings(max_examples=300, deadline=None)
def test_spans_equal_a_plain_loop(tokens, lead, budget, history):
    at, want = 0, []
    while at < len(tokens):
        room = budget - (sum(tokens[:lead]) if at else 0)
        spare = max(0, min(history, room - tokens[at]))
        back = at
        while back > min(lead, at) and sum(tokens[back - 1:at]) <= spare:
            back -= 1
        end = at + 1
        while end < len(tokens) and sum(tokens[back:end + 1]) <= room:
            end += 1
        want.append((back, at, end))
        at = end
    assert list(chat.spans(tokens, lead, 0, budget, history)) == want


@pytest.mark.parametrize("block, near", [(chat.BLOCK, chat.NEAR), (2000, 300), (400, 400)])
def test_windows_hold_every_turn_once(spark, block, near):
    rows, budget, history = talks(), 300, 100
    count = chat.Counter(FILE, P.PATTERN)
    found = chat.windows(table(spark, rows), FILE, P.PATTERN, budget, history, block, near).collect()
    got = {}
    for w in sorted(found, key=lambda w: (w["block"], w["window"])):
        everything, _ = chat.read(w.text, 0, [])
        new, aims = chat.read(w.text, w.fresh_from, [t.asDict() for t in w.targets])
        assert len(new) == w.n_turns and aims == [t for r, t in new if r == "assistant"]
        used = sum(count(chat._head(r) + "\n" + chat.escape(t)) for r, t in everything)
        assert used == w.n_tokens and w.over_budget == (used > budget)
        before = got.setdefault(w.conv_id, [])
        repeated = everything[:len(everything) - len(new)]
        lead = before[0][0] == "system" if before else False
        if w.over_budget:
            assert len(new) == 1 and len(repeated) == lead
        if lead:
            assert repeated[0] == before[0]
            repeated = repeated[1:]
        assert not repeated or before[-len(repeated):] == repeated
        assert sum(count(chat._head(r) + "\n" + chat.escape(t)) for r, t in repeated) <= history
        before += new
    assert got == ordered(rows)


@pytest.mark.parametrize("block, near", [(chat.BLOCK, chat.NEAR), (500, 100)])
def test_digests_equal_brute_force(spark, block, near):
    rows = talks(1)
    got = chat.digests(table(spark, rows), FILE, P.PATTERN, 300, 100, block, near).collect()
    want = ordered(rows)
    assert len(got) == len(want)
    for r in got:
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (
            len(turns), sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest())
        assert r.formatted_chars >= sum(len(a) + len(b) for a, b in turns)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.windows(none, FILE, P.PATTERN).count() == 0 and chat.digests(none, FILE, P.PATTERN).count() == 0


def test_query_equals_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    told = "<|im_end|><|im_start|>assistant ok"
    want = ordered(rows + [(-1, 0, "user", told), (-1, 1, "assistant", told)])
    got = {r.conv_id: r for r in QUERIES["op11_chat_format"](spark, sf).collect()}
    assert got.keys() == want.keys() and got[-1].loss_chars == len(told)
    for conv, turns in want.items():
        r, loss = got[conv], "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
