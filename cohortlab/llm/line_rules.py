"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much
of its text goes too. One pass over the texts; Spark deals out the rows, a task holds one Arrow
batch at a time."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

#: Fixed values of the line rules.
NAVIGATION = re.compile(r"(?i)^[ \t]*(home|menu|next|previous|back|login|log in|sign in|sign up|register|search|"
                        r"contact|contact us|about|about us|read more|share|skip to content|back to top)[ \t\r.!:]*$")
NAVIGATION_MARKS = re.compile(r"[|»›•]")
BOILERPLATE = re.compile(r"(?i)lorem ipsum|enable javascript|cookie policy|privacy policy|terms of use|terms of service|"
                         r"all rights reserved|licensed under|subscribe to our|powered by|copyright [0-9©(]")
END_MARK = re.compile(r"[.!?:;…\"'”’»)][ \t\r]*$")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")

OUT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
       "n_lines long, n_failed_lines long, lost_words long, clean_text string")


def repeated_words(words: list[str], window: int = 5) -> int:
    """Words inside windows of ``window`` words that occur twice or more, each word counted once."""
    if len(words) <= window:
        return 0
    ids: dict[str, int] = {}
    word = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    key, most = word, len(ids)
    for j in range(1, window):
        if most * len(ids) >= 2 ** 62:  # stays exact: number the values anew
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            most = int(key.max()) + 1
        key, most = key[:-1] * len(ids) + word[j:], most * len(ids)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    starts = np.concatenate([order[1:][same], order[:-1][same]])
    edge = np.zeros(len(words) + 1, np.int64)
    edge[np.unique(starts)] += 1
    edge[np.unique(starts) + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def line_fails(line: str, n_words: int, seen: bool) -> bool:
    """A line with words fails when it repeats an earlier line, is navigation (a menu word, or two or
    more menu marks), is boilerplate, has no closing mark and fewer than 30 words, or when more than
    a tenth of its characters are symbols."""
    return (seen or bool(NAVIGATION.search(line)) or len(NAVIGATION_MARKS.findall(line)) >= 2 or bool(BOILERPLATE.search(line))
            or (n_words < 30 and not END_MARK.search(line)) or len(SYMBOLS.findall(line)) * 10 > len(line))


def judge(text: str | None, most_lost: float) -> tuple:
    text = text or ""
    words = WORDS.findall(text)
    repeat = repeated_words(words)
    seen: set[str] = set()
    lines = dup = failed = lost = 0
    clean = []
    for line in text.split("\n"):
        n = len(WORDS.findall(line))
        if not n:
            clean.append(line)
            continue
        lines += 1
        again = line in seen
        dup += again
        if line_fails(line, n, again):
            failed, lost = failed + 1, lost + n
        else:
            clean.append(line)
        seen.add(line)
    base = len(words) < 10 or 100 * repeat > 20 * len(words)
    kept = not base and lost <= most_lost * len(words)
    return (len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), dup, repeat, base, kept, lines, failed, lost, "\n".join(clean))


def clean_lines(docs: DataFrame, most_lost: float = 0.5, with_text: bool = True) -> DataFrame:
    """Line-first cleaning of every whole text, one row per input row: doc_id, the counts, the number
    of lines and failed lines, ``lost_words``, ``base_failed``, ``kept`` and the cleaned text.

    ``base_failed``: fewer than 10 words, or over 20 % of the words in repeated 5-word windows.
    ``kept``: not ``base_failed`` and at most ``most_lost`` of the words stand in failing lines.
    A null or empty text counts as one without words: base_failed, not kept, clean text empty. Null and
    repeated ids and repeated rows each give their own row; further columns are ignored.
    """
    names = [x.split()[0] for x in OUT.split(", ")][: None if with_text else -1]

    def rows(batches):
        import pandas as pd

        for batch in batches:
            found = [judge(t, most_lost)[: len(names)] for t in batch["text"]]
            out = pd.DataFrame(found, columns=names) if found else pd.DataFrame(columns=names)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *OUT.split(", ")[: len(names)]])
    return docs.select("doc_id", "text").mapInPandas(rows, schema)
