"""Operator 2: token counts by a linear longest-match automaton.

The vocabulary's trie gets a failure link at each node: what a greedy longest match leaves unmatched when no edge goes on,
and how many pieces it has popped by then. A word's pieces are counted while its bytes are walked once; no piece is built.
The automaton walks all distinct words of a batch side by side, one byte a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bpe import read_ranks
from lodestone.llm.common import Words, buffers, slices


class Automaton:
    """The trie's nodes in order of depth, node 0 the root.

    fail[v] is the node of what is left of v's string after its greedy pieces, pops[v] their number, -1 where even one byte
    is no piece. A word that cannot be matched counts as one unknown piece.
    """

    def __init__(self, vocabulary: list[bytes]):
        children: list[dict[int, int]] = [{}]
        whole = [False]
        for token in vocabulary:
            v = 0
            for b in token:
                nxt = children[v].get(b)
                if nxt is None:
                    nxt = children[v][b] = len(children)
                    children.append({})
                    whole.append(False)
                v = nxt
            whole[v] = bool(token)
        n = len(children)
        fail, pops = np.zeros(n, np.int32), np.zeros(n, np.int32)
        pops[0] = -1
        layer = [(0, b, v) for b, v in children[0].items()]
        while layer:
            below = []
            for u, b, v in layer:
                if whole[v]:
                    fail[v], pops[v] = 0, 1
                else:
                    # pieces of u's string go first; then b must go on from what they leave
                    z, count = u, 0
                    while True:
                        if pops[z] < 0:
                            fail[v], pops[v] = 0, -1
                            break
                        count += pops[z]
                        z = int(fail[z])
                        if b in children[z]:
                            fail[v], pops[v] = children[z][b], count
                            break
                below += [(v, c, w) for c, w in children[v].items()]
            layer = below
        self.fail, self.pops = fail, pops
        edges = sorted((v << 8 | b, w) for v, row in enumerate(children) for b, w in row.items())
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.to = np.array([w for _, w in edges], np.int32)

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node, or -1."""
        want = node.astype(np.int64) << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.to[at], -1)

    def count(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of data[start:end] for each pair; 1 where a word cannot be matched, 0 for empty ones."""
        n = len(start)
        pieces, lost = np.zeros(n, np.int64), np.zeros(n, bool)
        if not len(self.keys):
            return (end > start).astype(np.int64)
        node = np.zeros(n, np.int32)
        order = np.argsort(start - end, kind="stable")  # longest first: those still running are a prefix
        length = (end - start)[order]
        for step in range(int(length[0]) if n else 0):
            live = order[: np.searchsorted(-length, -step, "left")]
            live = live[~lost[live]]
            byte = data[start[live] + step]
            while len(live):
                to = self._step(node[live], byte)
                on = to >= 0
                node[live[on]] = to[on]
                live, byte = live[~on], byte[~on]
                popped = self.pops[node[live]]
                dead = popped < 0
                lost[live[dead]] = True
                live, byte, popped = live[~dead], byte[~dead], popped[~dead]
                pieces[live] += popped
                node[live] = self.fail[node[live]]
        rest = np.flatnonzero(~lost & (node > 0))
        while len(rest):  # pops what is left at the end
            popped = self.pops[node[rest]]
            lost[rest[popped < 0]] = True
            rest, popped = rest[popped >= 0], popped[popped >= 0]
            pieces[rest] += popped
            node[rest] = self.fail[node[rest]]
            rest = rest[node[rest] > 0]
        return np.where(lost, 1, pieces)


_built: dict[str, Automaton] = {}


def token_counts(docs: DataFrame, vocabulary: str, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: id_, n_words, n_tokens (pieces of all words), n_bytes.

    Words are maximal runs without blanks and control characters from tab to carriage return; each but a text's first is
    matched with a blank before it, as the vocabulary writes words within a text. A null or empty text has no words and no
    tokens. Every row counts by itself, repeated ones too; an empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    tokens = spark.sparkContext.broadcast(list(read_ranks(vocabulary)))  # bounded by the vocabulary
    out = T.StructType([T.StructField(id_, docs.schema[id_].dataType), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens", "n_bytes"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _built:
            _built[vocabulary] = Automaton(tokens.value)
        tool = _built[vocabulary]
        for batch in batches:
            data, at = buffers(batch.column("_text"))
            words, pieces = np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1, np.int64)
            for i, j in slices(at):
                words[i:j], pieces[i:j] = count_words(tool, data[at[i] : at[j]], at[i : j + 1] - at[i])
            yield pa.RecordBatch.from_arrays([batch.column(id_), pa.array(words), pa.array(pieces), pa.array(np.diff(at))], names=out.names)

    return docs.select(id_, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, out)


def count_words(tool: Automaton, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and pieces of each text."""
    words = Words(data, at)
    first = np.zeros(len(words.start), bool)
    first[words.first[:-1][words.counts() > 0]] = True
    # distinct words, those that open a text apart: they go without the blank
    _, where, back = np.unique(words.hash ^ first.astype(np.uint64), return_index=True, return_inverse=True)
    size = (words.end - words.start)[where] + ~first[where]
    end = np.cumsum(size)
    start = end - size
    spread = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
    for k, (w, e) in enumerate(zip(where.tolist(), end.tolist(), strict=True)):
        a, b = words.start[w], words.end[w]
        spread[e - (b - a) : e] = data[a:b]
    pieces = tool.count(spread, start, end)[back]
    total = np.concatenate(([0], np.cumsum(pieces)))
    return words.counts(), total[words.first[1:]] - total[words.first[:-1]]
