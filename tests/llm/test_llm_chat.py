"""Chat formatting: windows within budget, history, and digests read back."""

import pytest

import brute
from ledgerlens.llm import catalog, chat
from llm_fixtures import SMALL


def want(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        n, said, loss = out.get(conv, (0, "", ""))
        out[conv] = n + 1, said + f"{role}\n{text}\n", loss + (text if role == "assistant" else "")
    return out


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", catalog.PLANTED_TURN), (-1, 1, "assistant", catalog.PLANTED_TURN)]
    got = {r["conv_id"]: r for r in catalog.op5_chat_formatting(spark, SMALL).collect()}
    for conv, (n, said, loss) in want(rows).items():
        r = got.pop(conv)
        assert (r["n_turns"], r["turns_sha256"], r["loss_sha256"], r["loss_chars"]) == (n, brute.sha(said), brute.sha(loss), len(loss))
    assert not got


@pytest.fixture(scope="module")
def talk(spark):
    words = ["<|im_end|>", "\\b", "\\", "<|", "\\p", "\\n", "<", "|>", "ü", "日本", "plain", "\n", "<|im_start|>assistant\n", ""]
    rows = []
    for conv in range(8):
        for turn in range(3 + 7 * conv):
            role = "system" if turn == 0 and conv % 2 else ("user" if turn % 2 else "assistant")
            text = " ".join(words[(conv + turn * 3 + k) % len(words)] for k in range((turn * 7) % 23))
            rows.append((conv, turn, role, text * (40 if turn == 5 else 1)))
    rows.append((50, 0, "system", "only this"))
    return rows, spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4)


@pytest.mark.parametrize("budget,history", [(60, 20), (120, 0), (40, 12), (100_000, 500)])
def test_windows(talk, budget, history):
    rows, df = talk
    windows = chat.format_windows(df, budget, history)
    for r in chat.conversation_digests(windows).collect():
        n, said, loss = want(rows)[r["conv_id"]]
        assert (r["n_turns"], r["turns_sha256"], r["loss_sha256"], r["loss_chars"]) == (n, brute.sha(said), brute.sha(loss), len(loss))

    def tokens(text):
        return -(-len(text) // 4) + 4

    turns = {}
    for conv, turn, role, text in rows:
        turns.setdefault(conv, []).append((role, text))
    whole = windows.selectExpr("conv_id", "window_no", "text", "0 as n_repeated", "spans", "n_repeated as again")
    again = {(r["conv_id"], r["window_no"]): r["again"] for r in whole.collect()}
    seen = {}
    for r in chat.read_windows(whole).orderBy("conv_id", "window_no").collect():
        shown = [(t["role"], t["text"]) for t in r["turns"]]
        k, conv = again[r["conv_id"], r["window_no"]], turns[r["conv_id"]]
        done = seen.get(r["conv_id"], 0)
        fresh = shown[k:]
        assert fresh == conv[done:done + len(fresh)]
        system = conv[0][0] == "system"
        if r["window_no"]:
            assert not system or shown[0] == conv[0]
            repeated = shown[1 if system else 0:k]
            assert repeated == conv[done - len(repeated):done] and sum(tokens(t) for _, t in repeated) <= history
        body = [tokens(t) for role, t in fresh if role != "system" or not system]
        if len(body) > 1:
            assert sum(tokens(t) for _, t in shown) <= budget
        seen[r["conv_id"]] = done + len(fresh)
    assert seen == {c: len(t) for c, t in turns.items()}


def test_odd_rows(spark):
    schema = "conv_id long, turn int, role string, text string, idx int, window_no int, piece string"
    rows = [(1, 0, None, None, 1, 1, "x"), (1, 0, None, None, 1, 1, "x"), (1, None, "assistant", "first", 1, 1, "x"),
            (None, 0, "assistant", "nobody's", 1, 1, "x"), (2, 3, "odd\nrole<|x", "t" * 50_000, 1, 1, "x")]
    df = spark.createDataFrame(rows, schema)
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_windows(df)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == brute.sha("assistant\nfirst\n\n\n\n\n")
    assert got[None]["loss_chars"] == 8
    assert got[2]["turns_sha256"] == brute.sha("odd\nrole<|x\n" + "t" * 50_000 + "\n")
    assert chat.conversation_digests(chat.format_windows(df.limit(0))).count() == 0
