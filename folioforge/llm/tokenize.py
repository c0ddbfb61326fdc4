"""Problem 8: encoding the corpus with a public byte-level BPE vocabulary, by an automaton.

The merges are compiled into a deterministic automaton over tokens, one gadget
a merge in order of rank: the gadget of ``u v -> uv`` takes the arc ``v`` out of
every state that ends in ``u``, adds the arc ``uv`` wherever an arc ``u`` leaves,
and gives ``uv`` a state with the arcs that the state of ``v`` has at that time.
So a state is the last token read, and its arcs are those of its right spine
(the chain of right parts down to a byte), each link with the arcs that the
gadgets of ranks between its own and its successor's left to it.  The compiled form keeps the
parts and the ranks of every token; the arc table is filled on first use.  A
token sequence is the encoding of its bytes exactly if the automaton accepts
it, so each position of a word has one last token, and a word of n bytes is
encoded in n steps, however long it is.

Defined results: a null and an empty text have no ids (an empty list); special
tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Words kept with their ids by each worker.
CACHED_WORDS = 60_000
#: Arcs of the automaton kept by each worker.
CACHED_ARCS = 2_000_000
NEVER = 1 << 30


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of their ids, which must be 0, 1, 2 ..."""
    pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line]
    ranks = {int(r): base64.b64decode(t) for t, r in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ids must be 0, 1, 2 ...")
    return [ranks[i] for i in range(len(ranks))]


def merge_parts(tokens: list[bytes]) -> tuple[list[int], list[int]]:
    """Left and right part of each token's last merge; -1 for single bytes."""
    rank = {t: i for i, t in enumerate(tokens)}
    left, right = [-1] * len(tokens), [-1] * len(tokens)
    for i, t in enumerate(tokens):
        if len(t) < 2:
            continue
        parts = [t[k : k + 1] for k in range(len(t))]
        while len(parts) > 2:
            best, at = NEVER, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1], NEVER)
                if r < best and r < i:
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            left[i], right[i] = rank[parts[0]], rank[parts[1]]
    return left, right


class MergeAutomaton:
    """States and arc labels are token ids; ``arc(x, y)`` tells whether y may follow x."""

    def __init__(self, tokens: list[bytes], left: list[int], right: list[int], pattern: str):
        import regex

        self.tokens, self.left, self.right = tokens, left, right
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.starts = {t[:k] for t in tokens for k in range(1, len(t) + 1)}
        self.find = regex.compile(pattern).findall
        self.words: dict[str, tuple[int, ...]] = {}
        self.arcs: dict[int, bool] = {}

    def arc(self, x: int, y: int) -> bool:
        key = x << 20 | y
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= CACHED_ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._gadgets_leave(x, y)
        return known

    def _gadgets_leave(self, x: int, y: int) -> bool:
        """Whether no merge joins the end of x with the start of y before either is complete.

        Walks down the right spine of x and the left spine of y: a pair (a, b) of them stands
        at the boundary until the earlier of the two is merged further, within x or y.
        """
        rank, tokens = self.rank, self.tokens
        until_x = until_y = NEVER  # rank of the merge that takes a into x, b into y
        a, b = x, y
        while True:
            r = rank.get(tokens[a] + tokens[b], NEVER)
            # of two merges of one rank the one further left comes first
            if r < until_x and r <= until_y and r != NEVER:
                return False
            # before the later one of a and b was made, its part stood here
            made_a = a if self.left[a] >= 0 else -1
            made_b = b if self.left[b] >= 0 else -1
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                until_x, a = made_a, self.right[a]
            elif made_b > made_a:
                until_y, b = made_b, self.left[b]
            else:
                until_y, b = made_b, self.left[b]

    def encode_word(self, word: bytes) -> list[int]:
        whole = self.rank.get(word)
        if whole is not None:
            return [whole]
        n, rank, starts, arc = len(word), self.rank, self.starts, self.arc
        last = [-1] * (n + 1)  # the one token that ends the encoding of the first i bytes
        for i in range(n):
            before = last[i]
            if i and before < 0:
                continue
            for j in range(i + 1, n + 1):
                piece = word[i:j]
                if piece not in starts:
                    break
                t = rank.get(piece)
                if t is not None and last[j] < 0 and (not i or arc(before, t)):
                    last[j] = t
        ids, i = [], n
        while i:
            ids.append(last[i])
            i -= len(self.tokens[last[i]])
        ids.reverse()
        return ids

    def encode(self, text: str) -> list[int]:
        words, out = self.words, []
        for w in self.find(text):
            ids = words.get(w)
            if ids is None:
                ids = tuple(self.encode_word(w.encode("utf-8", "surrogatepass")))
                if len(words) >= CACHED_WORDS:
                    words.clear()
                if len(w) < 64:
                    words[w] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs taken, as text."""
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


def automaton(path: str | None = None) -> MergeAutomaton:
    tokens = read_ranks(path or vocabulary_path())
    return MergeAutomaton(tokens, *merge_parts(tokens), split_pattern())


def _shared(spark: SparkSession, path: str | None):
    tokens = read_ranks(path or vocabulary_path())
    return spark.sparkContext.broadcast((tokens, *merge_parts(tokens), split_pattern()))


def encoded(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids of documents (doc_id, text)."""
    sent = _shared(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = MergeAutomaton(*sent.value)
        for b in batches:
            ids: list[int] = []
            ends = [0]
            for text in b.column(1):
                s = text.as_py()
                if s:
                    ids.extend(machine.encode(s))
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(ids, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def counted(documents: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of documents but text, and n_tokens."""
    sent = _shared(documents.sparkSession, path)
    kept = [c for c in documents.columns if c != "text"]
    schema = ", ".join(f"`{c}` {dict(documents.dtypes)[c]}" for c in kept) + ", n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = MergeAutomaton(*sent.value)
        for b in batches:
            n = [len(machine.encode(s)) if s else 0 for s in (t.as_py() for t in b.column(len(kept)))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(n, pa.int64())], names=[*kept, "n_tokens"])

    return documents.select(*kept, "text").mapInArrow(run, schema)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
