import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def want(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(spark, rows):
    read = chat.read_back(chat.examples(spark.createDataFrame(rows, SCHEMA))).collect()
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in read}


MARKED = "\\### Assistant: </turn> ok"
ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello 😀"), (1, 3, "user", "more"), (1, 4, "assistant", "yes\n"), (1, 5, "user", "left over"),
    (2, 0, "user", MARKED), (2, 1, "assistant", MARKED), (3, 0, "user", "no answer"), (4, 0, "assistant", None), (4, 1, "assistant", ""),
    (5, 0, None, "x"), (5, None, "a: b", "</turn>\n### user: fake</turn>\n"), (5, 2, "assistant", "\\e\\l\\h\\c \\\\ #### ###"), (5, 2, "assistant", "\\e\\l\\h\\c \\\\ #### ###"),
    (None, 0, "user", "q"), (None, 1, "assistant", "a"), (6, 0, "Assistant", "not trained"), (7, 0, "", ""),
]


def test_read_back(spark):
    assert got(spark, ROWS) == want(ROWS)


def test_each_reply_is_an_example(spark):
    rows = {(r["conv_id"], r["example"]): r for r in chat.examples(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    first, second, rest = rows[1, 0], rows[1, 1], rows[1, 2]
    assert first["text"] == "### system: be kind</turn>\n### user: hi</turn>\n### assistant: hello 😀</turn>\n"
    assert second["text"].startswith(first["text"]) and rest["text"].startswith(second["text"]) and (1, 3) not in rows
    trained = lambda r: r["text"][r["loss_start"]:r["loss_start"] + r["loss_chars"]]
    assert [trained(r) for r in (first, second, rest)] == ["hello 😀", "yes\n", ""] and [r["last"] for r in (first, second, rest)] == [False, False, True]


def test_a_long_conversation(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"text {k} </turn>") for k in range(301)]
    assert got(spark, rows) == want(rows)


def test_columns_that_clash_and_an_empty_table(spark):
    turns = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "text as said", "role as head", "turn as example", "text as body", "text as target")
    assert {r["conv_id"] for r in chat.read_back(chat.examples(turns)).collect()} == {r[0] for r in ROWS}
    assert chat.read_back(chat.examples(turns.limit(0))).collect() == []


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:\\c"]), st.text(alphabet="\\</turn>\n# :elhc", max_size=25)), min_size=1, max_size=4), min_size=1, max_size=5))
def test_any_texts(spark, conversations):
    rows = [(k, t, role, text) for k, turns in enumerate(conversations) for t, (role, text) in enumerate(turns)]
    assert got(spark, rows) == want(rows)
