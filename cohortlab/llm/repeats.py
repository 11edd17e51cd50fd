"""Runs of repeated words by grammar compression.

A *run* is a stretch of consecutive words of smallest period q that no neighbouring word extends
with period q, and of max(6, 4 * q) words or more. The words of each text are numbered and compressed by
Re-Pair: the most frequent adjacent pair becomes a nonterminal, until no pair occurs twice; what is left is
derived by a balanced tree. The lowest node of the derivation that holds a run has it across its boundary,
so the periodic stretches across the boundary are found once per nonterminal, carried to all
positions at which it is derived, and stretches of one period that overlap by a period are merged: stretches
that end with their node become whole ones by the merge.

Spark deals out the texts; a task compresses some hundred thousand words of several texts at a time, with
numpy over all of their pairs at once. A single longer text is compressed as a whole: memory grows with the
longest text, as it does for the row that holds it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Words compressed together, if no single text holds more.
CHUNK_WORDS = 400_000
#: Pairs of positions looked at together.
CHUNK_PAIRS = 4_000_000
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: A base of the rolling hash of words; odd, so that it has an inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15

OUT = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
SPAN = "array<struct<start:long,length:long,period:long>>"


def _mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(BASE)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Grammar:
    """The Re-Pair derivations of several sequences at once.

    ``word`` holds the numbers of all sequences one after the other, no number in two of them, and
    ``bound`` their starts and the end of all. Every occurrence of a symbol is known by its first place.
    ``left``, ``mid`` and ``right`` give the places where each nonterminal (and each node of the trees
    over what is left) starts, has its boundary and ends, at its first occurrence; ``rule`` and ``place`` list every
    place at which nonterminal ``rule`` is derived.
    """

    def __init__(self, word: np.ndarray, bound: np.ndarray):
        n = len(word)
        self.sym = word.astype(np.int64)
        self.next_symbol = int(word.max()) + 1 if n else 0
        self.after = np.arange(1, n + 1)  # place of the symbol that follows
        self.before = np.arange(-1, n - 1)
        self.whole = np.ones(n, bool)  # a symbol starts here
        nodes: list[tuple] = []
        places: list[tuple] = []
        self.n_rules = 0
        live = np.zeros(n + 1, bool)  # the pair that starts here may occur twice
        live[:n] = True
        ends = bound[1:][bound[1:] > bound[:-1]] - 1
        live[ends] = False
        at = np.flatnonzero(live)
        while len(at):
            at = self._round(at, live, nodes, places)
        self._tree(bound, nodes)
        self.left, self.mid, self.right = (np.concatenate([x[k] for x in nodes] or [np.zeros(0, np.int64)]) for k in range(3))
        self.rule, self.place = (np.concatenate([x[k] for x in places] or [np.zeros(0, np.int64)]) for k in range(2))

    def _round(self, at: np.ndarray, live: np.ndarray, nodes: list, places: list) -> np.ndarray:
        """Replaces every pair that is more frequent than all pairs it overlaps; ``at`` are the places of the live pairs in order."""
        a, b = self.sym[at], self.sym[self.after[at]]
        order = np.lexsort((b, a))
        fresh = np.ones(len(at), bool)
        fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        kind = np.empty(len(at), np.int64)
        kind[order] = np.cumsum(fresh) - 1
        # in a stretch of one symbol, every second pair overlaps the one before
        counted = np.ones(len(at), bool)
        same = np.flatnonzero(a == b)
        if len(same):
            joined = np.zeros(len(same), bool)
            joined[1:] = (same[1:] == same[:-1] + 1) & (self.after[at[same[:-1]]] == at[same[1:]])
            first = np.maximum.accumulate(np.where(joined, 0, np.arange(len(same))))
            counted[same] = (np.arange(len(same)) - first) % 2 == 0
        count = np.bincount(kind[counted], minlength=int(kind.max()) + 1)
        keep = count[kind] >= 2
        live[at[~keep]] = False
        at, kind, counted = at[keep], kind[keep], counted[keep]
        if not len(at):
            return at
        # rank of each kind: its count, ties scattered
        scattered = _mix(np.arange(len(count)))
        rank = np.empty(len(count), np.int64)
        rank[np.lexsort((scattered, count))] = np.arange(len(count))
        touching = self.after[at[:-1]] == at[1:]
        x, y = kind[:-1][touching], kind[1:][touching]
        beaten = np.zeros(len(count), bool)
        other = x != y
        beaten[np.where(rank[x] < rank[y], x, y)[other]] = True
        done = ~beaten[kind] & counted
        i = at[done]
        j = self.after[i]
        far = self.after[j]
        kinds, number = np.unique(kind[done], return_inverse=True)
        _, first = np.unique(number, return_index=True)
        n = len(self.sym)
        nodes.append((i[first], j[first], far[first]))
        places.append((self.n_rules + number, i))
        self.sym[i] = self.next_symbol + number
        self.n_rules += len(kinds)
        self.next_symbol += len(kinds)
        self.whole[j] = False
        self.after[i] = far
        inner = far < n
        self.before[far[inner]] = i[inner]
        live[i] = live[j]
        live[j] = False
        return at[live[at]]

    def _tree(self, bound: np.ndarray, nodes: list) -> None:
        """Balanced binary trees over the symbols left in each sequence."""
        start = np.flatnonzero(self.whole)
        seq = np.searchsorted(bound, start, side="right") - 1
        while len(start):
            stop = np.append(start[1:], bound[-1])
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            size = np.diff(np.append(first, len(seq)))
            odd = (np.arange(len(seq)) - np.repeat(first, size)) % 2 == 1
            if not odd.any():
                break
            k = np.flatnonzero(odd)
            nodes.append((start[k - 1], start[k], stop[k]))
            start, seq = start[~odd], seq[~odd]


class Repeats:
    """Longest common extensions by rolling hashes of all words."""

    def __init__(self, word: np.ndarray, base: int = BASE):
        with np.errstate(over="ignore"):
            n = len(word)
            self.word = word
            self.power = np.ones(n + 1, np.uint64)
            np.cumprod(np.full(n, base, np.uint64), out=self.power[1:])
            inverse = np.uint64(pow(base, -1, 2 ** 64))
            weight = np.ones(n, np.uint64)
            if n > 1:
                weight[1:] = np.cumprod(np.full(n - 1, inverse, np.uint64))
            # sums of mix(word) * base ** -i: a difference times base ** i is the hash of a stretch
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_mix(word) * weight, out=self.sums[1:])

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[i + size] - self.sums[i]) * self.power[i] == (self.sums[j + size] - self.sums[j]) * self.power[j]

    def _longest(self, fits, most: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while len(low) and (low < high).any():
            mid = (low + high + 1) // 2
            ok = fits(mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    def onward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, ``most`` at most."""
        return self._longest(lambda k: self.equal(i, j, k), most)

    def backward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words before i and j, ``most`` at most."""
        return self._longest(lambda k: self.equal(i - k, j - k, k), most)


def _steps(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, q) for q = 1 .. size[node] of every node, in bounded portions."""
    live = np.flatnonzero(size > 0)
    upto = np.cumsum(size[live])
    at = 0
    while at < len(live):
        done = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + CHUNK_PAIRS, side="right")))
        part = live[at:to]
        node = np.repeat(part, size[part])
        yield node, np.arange(len(node)) - np.repeat(np.cumsum(size[part]) - size[part], size[part]) + 1
        at = to


def boundary_runs(g: Grammar, rep: Repeats) -> tuple[np.ndarray, ...]:
    """(node, start, stop, period) of the long periodic stretches across the boundaries of the nodes, each within its
    node's expansion. A stretch of four periods has two on one side of the boundary."""
    w, found = rep.word, []
    for node, q in _steps((g.right - g.mid) // 2):
        mid = g.mid[node]
        hit = w[mid] == w[mid + q]
        node, q, mid = node[hit], q[hit], mid[hit]
        hit = rep.equal(mid, mid + q, q)
        node, q, mid = node[hit], q[hit], mid[hit]
        found.append((node, mid - rep.backward(mid, mid + q, mid - g.left[node]),
                      mid + q + rep.onward(mid, mid + q, g.right[node] - mid - q), q))
    for node, q in _steps((g.mid - g.left) // 2):
        mid = g.mid[node]
        hit = w[mid - 1] == w[mid - 1 - q]
        node, q, mid = node[hit], q[hit], mid[hit]
        hit = rep.equal(mid - 2 * q, mid - q, q)
        node, q, mid = node[hit], q[hit], mid[hit]
        found.append((node, mid - q - rep.backward(mid - q, mid, mid - q - g.left[node]),
                      mid + rep.onward(mid - q, mid, g.right[node] - mid), q))
    node, start, stop, q = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]).astype(np.int64) for k in range(4))
    long = stop - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    node, start, stop, q = node[long], start[long], stop[long], q[long]
    # of the periods of one stretch the least
    order = np.lexsort((q, stop, start, node))
    node, start, stop, q = node[order], start[order], stop[order], q[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    return node[new], start[new], stop[new], q[new]


def derived_runs(g: Grammar, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The stretches (start, stop, period) at all places of their nonterminals, merged into maximal ones and in order of start and period."""
    node, start, stop, q = found
    rule = node < g.n_rules
    order = np.argsort(g.rule, kind="stable")
    by_rule, place = g.rule[order], g.place[order]
    lo, hi = np.searchsorted(by_rule, node[rule]), np.searchsorted(by_rule, node[rule], side="right")
    n = hi - lo
    which = np.repeat(np.flatnonzero(rule), n)
    at = place[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    shift = at - g.left[node[which]]
    start = np.concatenate([start[~rule], start[which] + shift])
    stop = np.concatenate([stop[~rule], stop[which] + shift])
    q = np.concatenate([q[~rule], q[which]])
    if not len(q):
        return start, stop, q
    order = np.lexsort((stop, start, q))
    start, stop, q = start[order], stop[order], q[order]
    # the farthest stop so far within the stretches of one period
    lift = (np.cumsum(np.append(False, q[1:] != q[:-1]))) * (int(stop.max()) + 1)
    far = np.maximum.accumulate(stop + lift) - lift
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (start[1:] > far[:-1] - q[1:])
    first = np.flatnonzero(new)
    start, q, stop = start[first], q[first], far[np.append(first[1:], len(q)) - 1]
    order = np.lexsort((q, start))
    return start[order], stop[order], q[order]


def _holds(word: np.ndarray, bound: np.ndarray, start: np.ndarray, stop: np.ndarray, q: np.ndarray) -> bool:
    """Whether the stretches have their periods, compared word by word: hashes can collide."""
    return all(bool((word[s:e - p] == word[s + p:e]).all()) for s, e, p in zip(start, stop, q))


def find_runs(word: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, stop, period) of all runs of the sequences ``word[bound[k]:bound[k + 1]]``, no number in two of them."""
    g, base = Grammar(word, bound), BASE
    while True:
        found = derived_runs(g, boundary_runs(g, Repeats(word, base)))
        if _holds(word, bound, *found):
            return found
        base = (base * 0xD1342543DE82EF95 + 2) % 2 ** 64 | 1


def looped(words: list[str], doc_id) -> list[str]:
    """The words, of every tenth id (by crc32) with the words from a place on in a loop."""
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def runs_of(texts: Iterable[list[str]]) -> Iterator[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words."""
    def portion(lists: list[list[str]]) -> Iterator[list]:
        word, bound, total = [], [0], 0
        for words in lists:
            own: dict[str, int] = {}
            word.append(np.fromiter((own.setdefault(x, len(own)) for x in words), np.int64, len(words)) + total)
            total += len(own)
            bound.append(bound[-1] + len(words))
        ends = np.array(bound)
        start, stop, q = find_runs(np.concatenate(word), ends)
        cut = np.searchsorted(start, ends)
        for k in range(len(lists)):
            part = slice(cut[k], cut[k + 1])
            yield list(zip((start[part] - bound[k]).tolist(), (stop[part] - start[part]).tolist(), q[part].tolist()))

    held, size = [], 0
    for words in texts:
        if held and size + len(words) > CHUNK_WORDS:
            yield from portion(held)
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield from portion(held)


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run holds after its first period."""
    gone = bytearray(len(words))
    for s, length, q in runs:
        gone[s + q:s + length] = b"\1" * (length - q)
    return [w for w, x in zip(words, gone) if not x]


def summary(words: list[str], runs: list[tuple[int, int, int]]) -> tuple:
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    head = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(collapsed(words, runs) if runs else words)
    return (len(runs), *head, *(hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (listed, kept)))


def periodic_runs(docs: DataFrame, loop_ids: bool = False, with_runs: bool = False) -> DataFrame:
    """One row per input row: doc_id, the number of runs of its text, the longest run (of equally long ones the one
    of least start, then period; nulls if there is none), digests of all runs and of the text without repetitions,
    and with ``with_runs`` also ``runs`` and ``collapsed``, the runs and that text themselves.

    A null or empty text has no words and no run. ``loop_ids`` repeats words of every tenth id as the
    registered query wants it (a null id counts as an empty string). Null and repeated ids and repeated rows give
    their own rows; further columns are ignored; an empty table gives no row.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {OUT}" + (f", runs {SPAN}, collapsed string" if with_runs else "")

    def rows(batches):
        import pyarrow as pa

        arrow = None
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = (WORDS.findall(t.as_py() or "") for t in batch.column("text"))
            held: list[list[str]] = []

            def words():
                for i, w in zip(ids, texts):
                    held.append(looped(w, i) if loop_ids else w)
                    yield held[-1]

            out = []
            for k, runs in enumerate(runs_of(words())):
                row = (ids[k], *summary(held[k], runs))
                if with_runs:
                    row += ([{"start": s, "length": n, "period": q} for s, n, q in runs], " ".join(collapsed(held[k], runs)))
                out.append(row)
                held[k] = []
            if arrow is None:
                types = [pa.int64()] * 5 + [pa.string()] * 2
                if with_runs:
                    types += [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]
                names = ["doc_id", *[x.split()[0] for x in OUT.split(", ")], *(["runs", "collapsed"] if with_runs else [])]
                arrow = pa.schema([pa.field(n, t) for n, t in zip(names, [batch.schema.field("doc_id").type, *types])])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)] if out
                                             else [pa.array([], f.type) for f in arrow], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(rows, schema)
