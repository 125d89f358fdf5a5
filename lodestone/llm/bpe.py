"""Byte-level BPE of texts by a monoid tree, for the token-producing operators.

A text's ids are those of its left half joined with those of its right half. Cuts at which the splitting pattern always
ends a match need no work: the ids of the two sides stand side by side. Elsewhere the join takes a window round the cut and
lets it grow on either side until both its ends are such places; the window is encoded anew, and the ids outside it are
then proven to stay. Decoding goes up the same tree: the bytes of both sides, one after the other.
"""

from __future__ import annotations

import base64
import json

import numpy as np
import regex
import tiktoken

#: Characters of a text that one call of the library encodes; longer texts are halved.
LEAF = 1024
#: Where a match of the pattern ends whatever stands elsewhere: no match goes on from a sign into white space, from an ASCII
#: letter into a digit or another sign, or from a digit into anything else.
_STABLE = regex.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=[A-Za-z])(?=[!-@\[-`{-~])|(?<=[0-9])(?=[!-/:-~])")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, from a tiktoken file or from the JSON file of a byte-level BPE."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    # the format shows printable bytes as themselves and the others as characters from 256 on, in order
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    added = {x["content"] for x in model["added_tokens"]}
    return {bytes(back[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}


def read_special(path: str) -> dict[str, int]:
    """The added tokens of a JSON file, which stand for themselves in a text; a tiktoken file has none."""
    if path.endswith(".tiktoken"):
        return {}
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


class Bpe:
    """ranks, special tokens and pattern are plain values, so that a driver can send them to its executors."""

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int], pattern: str, leaf: int = LEAF):
        self.leaf = leaf
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.token = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for token, i in ranks.items():
            self.token[i] = token
        for token, i in special.items():
            self.token[i] = token.encode()
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; special tokens, if any, stand for themselves."""
        if self.special is None or not self.special.search(text):
            return self._tree(text, 0, len(text))
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._tree(text, at, m.start()), self.library.encode_to_numpy(m.group(), allowed_special="all")]
            at = m.end()
        return np.concatenate([*out, self._tree(text, at, len(text))])

    def _leaf(self, text: str) -> np.ndarray:
        return self.library.encode_to_numpy(text, disallowed_special=())

    def _tree(self, text: str, a: int, b: int) -> np.ndarray:
        if b - a <= self.leaf:
            return self._leaf(text[a:b])
        cut = (a + b) // 2
        return self._join(text, a, cut, b, self._tree(text, a, cut), self._tree(text, cut, b))

    def _join(self, text: str, a: int, cut: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        lo, hi = self._stable_before(text, a, cut, b), self._stable_after(text, cut, b)
        if lo == cut == hi:
            return np.concatenate([left, right])
        keep = self._at_byte(left, len(text[lo:cut].encode()), from_end=True)
        skip = self._at_byte(right, len(text[cut:hi].encode()))
        return np.concatenate([left[: len(left) - keep], self._leaf(text[lo:hi]), right[skip:]])

    def _stable_before(self, text: str, a: int, cut: int, b: int) -> int:
        """The last place up to the cut where a match ends for certain; the window grows until it holds one."""
        size = 32
        while True:
            lo = max(a, cut - size)
            places = [m.start() for m in _STABLE.finditer(text, lo, min(b, cut + 1)) if lo < m.start() <= cut and m.start() < b]
            if places or lo == a:
                return places[-1] if places else a
            size *= 4

    def _stable_after(self, text: str, cut: int, b: int) -> int:
        size = 32
        while True:
            hi = min(b, cut + size)
            # a place counts only if the character after it is in view; the one before the cut is in view by lookbehind
            for m in _STABLE.finditer(text, cut, hi):
                if m.start() < hi:
                    return m.start()
            if hi == b:
                return b
            size *= 4

    def _at_byte(self, ids: np.ndarray, n: int, from_end: bool = False) -> int:
        """How many ids make up the first or the last n bytes."""
        done, k = 0, 0
        for i in (ids[: -n - 1 : -1] if from_end else ids[:n]).tolist() if n else ():
            done += len(self.token[i])
            k += 1
            if done >= n:
                break
        if done != n:
            raise AssertionError("a token crosses a place where the pattern ends a match")
        return k

    def decode(self, ids: np.ndarray, leaf: int = 1 << 14) -> bytes:
        if len(ids) <= leaf:
            return b"".join([self.token[i] for i in ids.tolist()])
        half = len(ids) // 2
        return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)


class SharedBpe:
    """A Bpe that is sent to executors as bytes of its files and built once in each worker."""

    _built: dict[str, Bpe] = {}

    def __init__(self, spark, path: str, pattern: str, leaf: int = LEAF):
        self.key = f"{path} {leaf} {pattern}"
        self.pattern, self.leaf = pattern, leaf
        #: Bounded by the vocabulary, whatever the input.
        self.sent = spark.sparkContext.broadcast((read_ranks(path), read_special(path)))

    def get(self) -> Bpe:
        if self.key not in SharedBpe._built:
            ranks, special = self.sent.value
            SharedBpe._built[self.key] = Bpe(ranks, special, self.pattern, self.leaf)
        return SharedBpe._built[self.key]
