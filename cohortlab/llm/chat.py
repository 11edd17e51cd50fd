"""Chat formatting at token level.

Every segment (role, text) is encoded on its own, and reserved ids, which no text can give, are
spliced in around it. The loss mask is the prefix sum of +1 at the start and -1 after the end of each
trained segment. Control strings inside a text are escaped, so they stay text even for a reader that
looks for them in the decoded string.
"""

from __future__ import annotations

import base64
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Split pattern of the byte-level vocabulary (fixed value of that public tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The template's own marks, in the order of their reserved ids, which follow the vocabulary's.
MARKS = ("<|turn|>", "<|text|>", "<|end|>")
#: Control strings of this and of other templates. Each begins with < or [ and holds neither again.
CONTROLS = (*MARKS, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>",
            "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "[SYS]", "[/SYS]")
#: A backslash goes behind the first character; where some stand there already, one more.
_ESCAPE = re.compile("(" + "|".join(re.escape(c[0]) + r"\\*" + f"(?={re.escape(c[1:])})" for c in CONTROLS) + ")")
_UNESCAPE = re.compile("(" + "|".join(re.escape(c[0]) + r"\\*" + rf"(?=\\{re.escape(c[1:])})" for c in CONTROLS) + r")\\")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def load_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoding(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _ranks(docs: DataFrame, path: str):
    """The vocabulary, read once on the driver (about 1 MB) and broadcast: executors need no file."""
    return docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))


def _turn_order(rows: DataFrame) -> DataFrame:
    return rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())


def format_turns(rows: DataFrame, trained: tuple[str, ...] = ("assistant",), vocabulary: str = VOCABULARY) -> DataFrame:
    """The training pieces, one row per turn: conv_id, turn, role, text as given and ``ids``, ``mask``.

    A piece reads <turn> role <text> text <end>; the mask covers the text of ``trained`` roles. The pieces
    of a conversation in order are its example. A null role or text is empty, a null turn comes first,
    turns that tie are ordered by role and text, repeated rows are repeated turns, and null conv_ids form
    one conversation. Further columns are ignored.
    """
    ranks = _ranks(rows, vocabulary)

    def pieces(batches):
        coder = _encoding(ranks.value)
        reserved = np.arange(len(MARKS)) + max(ranks.value.values()) + 1
        for batch in batches:
            role, text = batch["role"].fillna(""), batch["text"].fillna("")
            encoded = [[coder.encode_ordinary(escape(x)) for x in column] for column in (role, text)]
            ids, masks = [], []
            for r, a, b in zip(role, *encoded):
                seq = np.concatenate([reserved[:1], np.asarray(a, np.int64), reserved[1:2], np.asarray(b, np.int64), reserved[2:]]).astype(np.int32)
                step = np.zeros(len(seq) + 1, np.int8)
                if r in trained:
                    step[len(a) + 2] += 1
                    step[len(seq) - 1] -= 1
                ids.append(seq)
                masks.append(np.cumsum(step)[:-1].astype(np.int8))
            yield batch.assign(ids=ids, mask=masks)

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    return rows.select("conv_id", "turn", "role", "text").mapInPandas(
        pieces, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, ids array<int>, mask array<tinyint>")


def read_back(pieces: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """What the formatted ids and masks say, one row per conversation: number and digest of the turns,
    characters and digest of the text under the loss mask, and characters of the formatted string.

    Conversations are dealt out by id, sorted by turn and read turn by turn with running digests, so a
    conversation of any length needs no more memory than its longest turn.
    """
    ranks = _ranks(pieces, vocabulary)
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def digests(batches):
        import hashlib

        import pandas as pd

        coder = _encoding(ranks.value)
        first = max(ranks.value.values()) + 1
        now, out = None, []

        def done():
            out.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        for batch in batches:
            for conv, ids, mask in zip(batch["conv_id"], batch["ids"], batch["mask"]):
                conv = None if pd.isna(conv) else conv
                if now is None or now[0] != conv:
                    if now is not None:
                        done()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                a, b, c = np.flatnonzero(ids >= first)
                role, text = (coder.decode(ids[x:y].tolist()) for x, y in ((a + 1, b), (b + 1, c)))
                loss = unescape(coder.decode(ids[mask == 1].tolist()))
                now[1] += 1
                now[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += len(role) + len(text) + sum(len(MARKS[i - first]) for i in ids[[a, b, c]])
            if out:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        if now is not None:
            done()
            yield pd.DataFrame(out, columns=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    ordered = _turn_order(pieces.repartition("conv_id")).select("conv_id", "ids", "mask")
    return ordered.mapInPandas(digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
