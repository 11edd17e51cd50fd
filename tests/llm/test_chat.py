import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlab.llm import chat as C

pieces = st.sampled_from([*C.CONTROLS, "\\", "<", "[", "INST]", "|", " ", "a", "é", "\n", "\\\\"])


@given(st.lists(pieces, max_size=12).map("".join))
@settings(max_examples=500, deadline=None)
def test_escape_is_reversible_and_hides_controls(text):
    escaped = C.escape(text)
    assert C.unescape(escaped) == text
    assert not any(c in escaped for c in C.CONTROLS)


SCHEMA = "conv_id long, turn long, role string, text string, ids string, mask int"


def test_round_trip_and_edges(spark):
    long_text = "</s>[INST] " * 20_000
    rows = [(1, 0, "user", "hi <|end|> there", "x", 1), (1, 1, "assistant", "</s>[INST] ok [/INST]", "x", 1), (1, 1, "assistant", "</s>[INST] ok [/INST]", "x", 1),
            (1, None, None, None, "x", 1), (2, 5, "assistant", long_text, "x", 1), (2, 4, "tool|>", "", "x", 1), (None, 0, "assistant", "é\ud7ff😀", "x", 1), (None, 1, "user", None, "x", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    made = C.format_turns(frame)
    for r in made.collect():
        assert len(r["ids"]) == len(r["mask"]) and (sum(r["mask"]) > 0) == (r["role"] == "assistant" and bool(r["text"]))
    got = {r["conv_id"]: r for r in C.read_back(made).collect()}
    assert set(got) == {1, 2, None}
    for conv, r in got.items():
        turns = sorted([x for x in rows if x[0] == conv], key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(C.escape(x[2] or "")) + len(C.escape(x[3] or "")) + sum(map(len, C.MARKS)) for x in turns)
    assert C.read_back(C.format_turns(frame.limit(0))).count() == 0
