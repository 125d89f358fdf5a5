import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import byte_bpe, packing, token_counts
from lodestone.llm.bpe import Bpe, read_ranks, read_special
from lodestone.llm.token_counts import Automaton

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
TINY = Bpe(read_ranks(RANKS), {}, P.PATTERN, leaf=5)
FROM_JSON = Bpe(read_ranks(JSON), read_special(JSON), P.PATTERN, leaf=7)
with open(RANKS, "rb") as f:
    LIBRARY = tiktoken.Encoding("whole", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
TOKENIZER = Tokenizer.from_file(JSON)
TEXTS = st.one_of(st.text(max_size=80), st.text(alphabet=" \n\t'sreLl1.,!é日 -x", max_size=80), st.lists(st.sampled_from(["it's", " don't", "  ", "\n\n", "we're", "12", "a", " ", "'", "’s", "é", "<|endoftext|>"]), max_size=20).map("".join))


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_tree_of_tiny_leaves_is_the_library(text):
    ids = TINY.encode(text)
    assert ids.tolist() == LIBRARY.encode_ordinary(text)
    assert TINY.decode(ids, leaf=3) == text.encode()


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_json_vocabulary_is_the_tokenizer(text):
    assert FROM_JSON.encode(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_real_texts(small):
    for row in small.collect():
        assert TINY.encode(row["text"]).tolist() == LIBRARY.encode_ordinary(row["text"])


def test_round_trip(spark, awkward, empty):
    found = byte_bpe.round_trip(awkward, RANKS, P.PATTERN).collect()
    expected = sorted(((r["doc_id"], r["text"] or "") for r in awkward.collect()), key=str)
    assert len(found) == len(expected) and all(r["same"] for r in found)
    for r, (i, text) in zip(sorted(found, key=lambda r: str((r["doc_id"], next(t for j, t in expected if j == r["doc_id"] and hashlib.sha256(t.encode()).hexdigest() == r["decoded_sha256"])))), expected, strict=True):
        ids = LIBRARY.encode_ordinary(text)
        assert (r["doc_id"], r["n_tokens"], r["ids_sha256"]) == (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert byte_bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0


def test_encode_then_decode_keeps_other_columns(awkward):
    coded = byte_bpe.encode(awkward, RANKS, P.PATTERN)
    back = byte_bpe.decode(coded, RANKS, P.PATTERN)
    assert set(awkward.columns) <= set(back.columns)
    assert all(bytes(r["bytes"]).decode() == (r["text"] or "") for r in back.collect())


def greedy(word, vocabulary, most):
    n, at = 0, 0
    while at < len(word):
        size = next((k for k in range(min(most, len(word) - at), 0, -1) if word[at : at + k] in vocabulary), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=12), st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 4 + 97 for x in b)), max_size=8))
def test_automaton_is_greedy_longest_match(vocabulary, words):
    tool = Automaton(sorted(vocabulary))
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words]).astype(np.int64)
    start = end - np.array([len(w) for w in words], np.int64)
    assert tool.count(data, start, end).tolist() == [greedy(w, vocabulary, 5) for w in words]


def test_token_counts(spark, small, awkward, empty):
    vocabulary = set(read_ranks(JSON))
    most = max(map(len, vocabulary))
    for docs in (small, awkward):
        found = token_counts.token_counts(docs, JSON).collect()
        rows = docs.collect()
        assert len(found) == len(rows)
        expected = defaultdict(list)
        for r in rows:
            words = (r["text"] or "").encode().split()
            expected[r["doc_id"]].append((len(words), sum(greedy(w if k == 0 else b" " + w, vocabulary, most) for k, w in enumerate(words)), len((r["text"] or "").encode())))
        got = defaultdict(list)
        for r in found:
            got[r["doc_id"]].append((r["n_words"], r["n_tokens"], r["n_bytes"]))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    assert token_counts.token_counts(empty, JSON).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=40), st.sampled_from([16, 64]))
def test_pack(lengths, capacity):
    found = packing.pack(lengths, capacity)
    covered = [np.zeros(n, int) for n in lengths]
    sizes = []
    for pieces in found:
        sizes.append(sum(n for _, _, n in pieces))
        assert pieces and 0 < sizes[-1] <= capacity
        for d, s, n in pieces:
            covered[d][s : s + n] += 1
    assert all((c == 1).all() for c in covered)
    assert all(s == capacity or s & (s - 1) == 0 for s in sizes)


def test_tournament_is_first_fit():
    rng = np.random.default_rng(3)
    sizes = sorted(rng.integers(1, 100, 300).tolist(), reverse=True)
    tree, free = packing.Tournament(len(sizes), 100), [100] * len(sizes)
    for s in sizes:
        k = next(i for i, f in enumerate(free) if f >= s)
        free[k] -= s
        assert tree.place(s) == k


@pytest.mark.parametrize("which", ["small", "awkward"])
def test_sequences(which, request):
    docs = request.getfixturevalue(which)
    rows = packing.sequences(docs, JSON, P.PATTERN, group_bytes=100_000).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(np.array([*TOKENIZER.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4"))
    by_seq, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for places in by_seq.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at == 1024 or at & (at - 1) == 0 and at < 1024
    assert pieces.keys() == texts.keys()
    for i, options in texts.items():
        assert sum(r["length"] for r in pieces[i]) == sum(map(len, options))
        for r in pieces[i]:
            crcs = [zlib.crc32(t[r["start"] : r["start"] + r["length"]].tobytes()) for t in options if len(t) == r["doc_tokens"]]
            assert r["ids_crc32"] in crcs


def test_sequences_of_nothing(empty):
    assert packing.sequences(empty, JSON, P.PATTERN).count() == 0
