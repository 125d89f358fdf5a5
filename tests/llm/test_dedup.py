import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, jaccard_join, line_dedup, substring_dedup
from lodestone.llm.common import Words, in_chunks, shingle_sets
from lodestone.llm.components import components
from lodestone.llm.sketch import pack_sorted, unpack_sorted
from tests_llm_helpers import Union, jaccard_expected, words

# ---------------------------------------------------------------- shared parts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAé \n\u0001\t日", max_size=12), max_size=5))
def test_words_are_those_of_the_pattern(texts):
    data = [t.encode() for t in texts]
    at = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
    found = Words(np.frombuffer(b"".join(data), np.uint8), at)
    got = [bytes(found.data[a:b]) for a, b in zip(found.start, found.end, strict=True)]
    assert got == [w for t in texts for w in words(t)] and found.counts().tolist() == [len(words(t)) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=20), max_size=6))
def test_shingles_are_equal_exactly_if_their_words_are(texts):
    data = [t.encode() for t in texts]
    at = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
    every, begin = shingle_sets(Words(np.frombuffer(b"".join(data), np.uint8), at), 3)
    sets = [every[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
    names = {}
    for t, s in zip(texts, sets, strict=True):
        w = words(t)
        exact = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
        assert len(exact) == len(s)
        for other, hashes in names.items():
            assert len(exact & other) == len(np.intersect1d(s, hashes))
        names[frozenset(exact)] = s


def thue_morse(letters, n):
    return "".join(letters[bin(k).count("1") & 1] for k in range(n))


@settings(max_examples=100, deadline=None)
@given(st.sampled_from([8, 32, 64, 1024, 4096]), st.integers(1, 40), st.integers(0, 1))
def test_unlike_words_and_runs_hash_unlike(n, size, form):
    """Words of the Thue-Morse sequence and its complement are equal to any polynomial modulo a power of two."""
    one, two = thue_morse("ab", n), thue_morse("ba", n)
    texts = [one, two, one + " x", "x " + one, *(f"{one[:k]} {one[k:]}" for k in (1, n // 2)), thue_morse(["p ", "q "], n), thue_morse(["q ", "p "], n)]
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    found = Words(np.frombuffer("".join(texts).encode(), np.uint8), at)
    plain = [words(t) for t in texts]
    assert len({*found.hashes(form).tolist()}) == len({w for t in plain for w in t})
    assert len({*found.runs(size, form)[1].tolist()}) == len({tuple(t[i : i + size]) for t in plain for i in range(len(t) - size + 1)})


@given(st.lists(st.integers(0, 1 << 40), max_size=50, unique=True))
def test_sorted_numbers_survive(values):
    array = np.array(sorted(values), np.int64)
    assert unpack_sorted(pack_sorted(array)).tolist() == array.tolist()


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(-500, 500, (600, 2))] + [(i, i + 1) for i in range(2000, 2060)] + [(5000, i) for i in range(5001, 5300)] + [(7, 7)]
    union = Union({x for e in edges for x in e})
    for a, b in edges:
        union.join(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: union.find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- operator 7


def exact_expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    out = []
    for r in rows:
        ids = groups[r["text"] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((r["doc_id"], keep, len(ids), r["doc_id"] == keep, hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"key": lambda t: F.length(t).cast("long"), "bucket_bytes": 2000, "max_depth": 6}, {"bucket_bytes": 1000, "max_depth": 8}])
def test_exact_duplicates(awkward, small, families, options):
    for docs in (awkward, small, families):
        found = [tuple(r) for r in exact_dedup.exact_duplicates(docs, **options).collect()]
        assert sorted(found, key=str) == exact_expected(docs.collect())


def test_exact_duplicates_of_nothing(empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.keep_one(empty).columns == empty.columns


def test_keep_one_keeps_all_columns(awkward):
    kept = exact_dedup.keep_one(awkward)
    assert kept.columns == awkward.columns
    want = {(r[0], r[4]) for r in exact_expected(awkward.collect()) if r[3]}
    assert sorted((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in kept.collect() if r["doc_id"] is not None) == sorted(want - {x for x in want if x[0] is None})


def test_each_bucket_has_one_owner_and_its_key_range(families, spark):
    found, owners, depth = exact_dedup.index(families, bucket_bytes=1500)
    of = {r["prefix"]: (r["bucket"], r["local_depth"]) for r in owners.collect()}
    assert len(of) == 1 << depth and len({b for b, _ in of.values()}) > 8
    files = defaultdict(list)
    for r in found.withColumn("file", F.input_file_name()).collect():
        prefix = (r["key"] & (1 << 64) - 1) >> 64 - depth
        assert r["bucket"] == of[prefix][0] and r["bucket"] >> depth - of[prefix][1] == prefix >> depth - of[prefix][1]
        files[r["file"]].append(r["bucket"])
    assert len(files) > 2 and all(x == sorted(x) for x in files.values())
    assert sum(len(set(x)) for x in files.values()) == len({b for x in files.values() for b in x})


def test_keys_that_different_texts_share(awkward, families):
    for docs in (awkward, families):
        want = sorted(str((r["doc_id"], r["text"])) for r in exact_dedup.keep_one(docs).collect())
        assert sorted(str((r["doc_id"], r["text"])) for r in exact_dedup.keep_one(docs, key=lambda t: F.length(t).cast("long")).collect()) == want


def test_directory_doubles_until_no_bucket_is_overfull(spark):
    rng = np.random.default_rng(1)
    keys = [int(k) for k in rng.integers(-(1 << 63), (1 << 63) - 1, 2000)] + [5] * 500
    df = spark.createDataFrame([(k, 1) for k in keys], "_key long, _bytes int")
    found = exact_dedup.directory(df, bucket_bytes=100, max_depth=8).collect()
    assert len(found) == 256
    load = Counter()
    owner = {r["prefix"]: (r["bucket"], r["local_depth"]) for r in found}
    for k in keys:
        load[owner[(k & (1 << 64) - 1) >> 56]] += 1
    assert all(n <= 100 or depth == 8 for (_, depth), n in load.items())
    for prefix, (bucket, depth) in owner.items():
        assert bucket == prefix >> (8 - depth) << (8 - depth)


# ---------------------------------------------------------------- operator 1


@pytest.mark.parametrize("few", [2, 3, 12])
def test_jaccard_components(families, few, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    found = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(families, chunk_bytes=20_000).collect()]
    assert sorted(found, key=str) == jaccard_expected(families.collect())


def test_unlike_sets_with_one_name_stay_apart(families, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_name", lambda shingles: len(shingles) % 5)
    found = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(families, chunk_bytes=20_000).collect()]
    assert sorted(found, key=str) == jaccard_expected(families.collect())


def test_words_of_a_polynomials_collision_are_unlike(spark):
    tail = " ".join(f"w{k}" for k in range(34))
    one, two = thue_morse("ab", 4096), thue_morse("ba", 4096)
    docs = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, one), (4, two), (5, two)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()} == dict.fromkeys(range(1, 6), 0)


def test_links_across_components_that_overtake_the_largest(spark, monkeypatch):
    """One meeting: y is in its largest component until four groups of four join into a larger one, whose x links with y only
    and has y at a late rank."""
    n = 0

    def swapped(base, out):
        nonlocal n
        n += len(out)
        return (base - set(out)) | {f"{seed}w{n - k}" for k in range(len(out))}

    def name(s):
        data = " ".join(sorted(s)).encode()
        found, _ = shingle_sets(Words(np.frombuffer(data, np.uint8), np.array([0, len(data)])), 1)
        return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)

    for seed in range(1000):
        a = [f"{seed}a{k:03}" for k in range(100)]
        center = set(a)
        y = swapped(center, a[:12])
        first = swapped(y, a[12:26])
        x = (first - {min(first - y)}) | {a[12]}
        groups = [[x] + [swapped(first, [a[k]]) for k in (30, 31, 32)]]
        hub = swapped(first, a[40:45])
        for g in range(3):
            base = swapped(hub, a[50 + 5 * g : 55 + 5 * g])
            groups.append([swapped(base, [a[k]]) for k in (70, 71, 72, 73)])
        sets = [center, y, *(swapped(center, a[50 + 5 * k : 55 + 5 * k]) for k in range(6)), *(s for g in groups for s in g)]
        if min(sets, key=name) == center:
            break
    docs = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in enumerate(sets)], "doc_id long, text string")

    def one_meeting(classes, *_):
        every = sorted(r["class"] for r in classes.select("class").collect())
        pairs = np.array([(every[0], b) for b in every[1:]], np.int64)
        return spark.createDataFrame([(0, pairs.tobytes()), (1, pairs.tobytes())], "kind int, body binary")

    monkeypatch.setattr(jaccard_join, "_meetings", one_meeting)
    found = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, ngram=1).collect()]
    assert sorted(found, key=str) == jaccard_expected(docs.collect(), 1)
    assert {c for *_, c in found} == {0}


def test_jaccard_of_awkward_and_real_texts(awkward, small, empty):
    for docs in (awkward, small):
        found = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, chunk_bytes=50_000).collect()]
        assert sorted(found, key=str) == jaccard_expected(docs.collect())
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert jaccard_join.keep_one(awkward).columns == awkward.columns


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 120), st.integers(0, 40), st.integers(0, 1 << 30))
def test_linked_sets_meet_in_a_key(n, edits, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    b = np.unique(np.concatenate([rng.permutation(a)[edits // 2 :], rng.integers(0, 1 << 63, edits - edits // 2, dtype=np.uint64)]))
    plan = jaccard_join.bands(75, 300)
    if len(b) and jaccard_join.links(a, b, 75) and not np.array_equal(a, b):
        assert len(np.intersect1d(jaccard_join.set_keys(a, 75, plan), jaccard_join.set_keys(b, 75, plan)))
        bits = [np.frombuffer(jaccard_join.parities(x), np.uint8) for x in (a, b)]
        assert jaccard_join.may_link(len(a), bits[0], len(b), bits[1], 75)


def test_bands_cover_all_sizes_and_tell_enough():
    plan = jaccard_join.bands(75, 30_000)
    assert plan[0].lo == 1 and all(a.hi + 1 == b.lo for a, b in zip(plan, plan[1:], strict=False)) and plan[-1].hi >= 30_000
    assert all(b.units >= b.needs > 2 * b.hi // 7 for b in plan)


# ---------------------------------------------------------------- operator 9


def windows_expected(rows, size):
    texts = [words(r["text"]) for r in rows]
    times = Counter(tuple(w[i : i + size]) for w in texts for i in range(len(w) - size + 1))
    out = []
    for r, w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if times[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r["doc_id"], len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [3, 35])
def test_repeats(awkward, small, families, size):
    for docs in (awkward, small, families):
        found = [tuple(r) for r in substring_dedup.remove_repeats(docs, size, chunk_bytes=60_000, texts=True).collect()]
        assert sorted(found, key=str) == windows_expected(docs.collect(), size)


def test_repeats_in_nothing_and_within_one_text(spark, empty):
    assert substring_dedup.remove_repeats(empty).count() == 0
    docs = spark.createDataFrame([(1, "a b c x a b c y")], "doc_id long, text string")
    assert substring_dedup.remove_repeats(docs, 3, texts=True).first()["kept_text"] == "x y"


# ---------------------------------------------------------------- operator 8


def lines_expected(rows, percent=80):
    """The (id, number) of lines to go, by comparing all pairs."""
    places = defaultdict(list)
    for r in rows:
        for n, line in enumerate((r["text"] or "").split("\n")):
            if line_dedup.normal(line):
                places[line_dedup.normal(line)].append((r["doc_id"] is not None, r["doc_id"], n))
    distinct = list(places)
    sets, union, owners = [line_dedup.shingles(x) for x in distinct], Union(range(len(distinct))), defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            owners[g].append(i)
    for i, s in enumerate(sets):
        for j, c in Counter(j for g in s for j in owners[g] if j < i).items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                union.join(i, j)
    groups = defaultdict(list)
    for i, line in enumerate(distinct):
        groups[union.find(i)] += places[line]
    return {x[1:] for g in groups.values() for x in g if x[1:] != min(g, key=lambda y: (y[0], y[1] or 0, y[2]))[1:]}


def test_lines(spark, small, awkward, empty):
    base = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(1, f"{base}\nother text of its own here"), (2, f"{base.replace('lazy', 'hazy')}\nfine words that no one else has"), (3, base.upper() + "  \n\n" + base), (4, "short"), (5, "short")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for docs in (made, small, awkward):
        want = lines_expected(docs.collect())
        found = {r["doc_id"]: r for r in line_dedup.remove_lines(docs, chunk_bytes=50_000).collect()}
        for r in docs.collect():
            lines = (r["text"] or "").split("\n")
            kept = [x for n, x in enumerate(lines) if (r["doc_id"], n) not in want]
            if r["doc_id"] is not None:
                assert (found[r["doc_id"]]["n_lines"], found[r["doc_id"]]["n_removed"], found[r["doc_id"]]["kept_text"]) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.remove_lines(empty).count() == 0


def test_lines_unlike_the_smallest_of_their_keys(spark, monkeypatch):
    """All lines share their keys, and the smallest line is unlike most others, which are in families."""
    rng = np.random.default_rng(8)
    lines = []
    for _ in range(8):
        base = "".join(rng.choice(list("abcdefgh"), 120))
        lines += [base, base[:60] + "y" + base[61:], base[:119] + "z"]

    def one_key(docs, _):
        rows = [(i, 0, line_dedup._name(x.encode()), x, [1, 2]) for i, x in enumerate(lines)]
        return spark.createDataFrame(rows, "row_id long, number int, node long, line string, keys array<long>")

    monkeypatch.setattr(line_dedup, "_candidates", one_key)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = line_dedup.repeated_lines(docs).collect()
    assert {(r["doc_id"], r["number"]) for r in found if not r["stays"]} == lines_expected(docs.collect())
    assert len(found) == len(lines) and sum(not r["stays"] for r in found) == 16


LINES = st.lists(st.text(alphabet="abcA \t\u0000é日\u9fa5🦊", max_size=14), min_size=1, max_size=8)


@settings(max_examples=100, deadline=None)
@given(LINES)
def test_portions_of_lines_are_as_each_line_by_itself(found):
    text = "\n".join(found).encode()
    assert line_dedup._normal_lines(text) == [line_dedup._normal(x) for x in text.split(b"\n")]
    lines = [x for x in line_dedup._normal_lines(text) if x]
    if not lines:
        return
    counts, bits = line_dedup.shapes(lines)
    each = [line_dedup.line_shingles(x.decode()) for x in lines]
    assert counts.tolist() == [len(x) for x in each] and bits == [jaccard_join.parities(x) for x in each]
    pairs = [(a, b) for a in lines for b in lines]
    for percent in (30, 80, 100):
        got = line_dedup.similar_pairs([a for a, _ in pairs], [b for _, b in pairs], percent)
        assert got.tolist() == [line_dedup.similar(a.decode(), b.decode(), percent) for a, b in pairs]


def test_pairs_with_more_characters_than_can_be_numbered():
    rng = np.random.default_rng(6)
    lines = ["".join(map(chr, rng.integers(0x4E00, 0x9F00, 400))) for _ in range(40)]
    others = [x[:k] + "z" + x[k + 1 :] if k % 2 else x[:200] for k, x in enumerate(lines)]
    assert line_dedup.run_numbers([x.encode() for x in lines]) is None
    got = line_dedup.similar_pairs([x.encode() for x in lines], [x.encode() for x in others], 80)
    assert got.tolist() == [k % 2 == 1 for k in range(40)]


def test_parts_without_a_value_ask_in_their_order():
    rng = np.random.default_rng(7)
    table = rng.integers(0, 1 << 20, (line_dedup.BINS, 60), dtype=np.uint32)
    for k in range(60):  # lines of one value to all
        table[rng.permutation(line_dedup.BINS)[1 + 2 * k :], k] = line_dedup._NONE
    got = line_dedup._lent(table)
    for part in range(line_dedup.BINS):
        for k in range(60):
            asked = [table[q, k] for q in [part, *line_dedup._ASKED[:, part]]]
            assert got[part, k] == next(x for x in asked if x != line_dedup._NONE)


def test_no_row_for_each_key_of_a_line(spark, small, monkeypatch):
    """Keys meet in packed rows; a row for each took a seventh of the operator's time."""
    plans, put = {}, line_dedup.written

    def watched(df, name, *rest):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return put(df, name, *rest)

    monkeypatch.setattr(line_dedup, "written", watched)
    assert line_dedup.repeated_lines(small, chunk_bytes=50_000).count() > 0
    assert "pairs" in plans and not [name for name, found in plans.items() if any("Generate" in x for x in found)]


def test_small_bundles_are_handed_over_together(spark):
    rng = np.random.default_rng(9)
    sets = [rng.integers(0, 1 << 62, 40, dtype=np.uint64) for _ in range(12)]
    sets = [np.sort(np.concatenate([base[:39], rng.integers(0, 1 << 62, 1, dtype=np.uint64)])) for base in sets for _ in range(4)]
    classes = spark.createDataFrame([(i, len(s), bytearray(jaccard_join.parities(s))) for i, s in enumerate(sets)], "class long, n_shingles long, parities binary")
    met = spark.createDataFrame([(i - i % k, i) for k in (4, 12) for i in range(48)], "meeting long, node long").distinct()
    groups = spark.createDataFrame([(0, 0), (1, 0)], "node long, component long")
    nodes = jaccard_join.members(met, classes, groups)
    for first, last in ((0, 1), (1, 8)):
        alone = jaccard_join.cross_pairs(met, nodes, groups, 75, first, last).collect()
        assert len(alone) > 12
        for parts in (1, 3):
            together = jaccard_join.cross_pairs(met, nodes, groups, 75, first, last, parts)
            assert sorted(together.collect(), key=str) == sorted(alone, key=str)


def test_bands_find_similar_lines():
    rng = np.random.default_rng(4)
    found = total = 0
    for _ in range(400):
        line = "".join(rng.choice(list("abcdefgh "), 80))
        other = list(line)
        for p in rng.integers(0, 80, 2):
            other[p] = "z"
        a, b = line_dedup.normal(line), line_dedup.normal("".join(other))
        if line_dedup.similar(a, b, 80):
            total += 1
            x, y = line_dedup.band_keys([a.encode(), b.encode()])
            found += bool((x == y).any())
    assert total > 20 and found >= 0.95 * total


@pytest.mark.parametrize("n", [27, 45, 90, 180])
def test_bands_keep_their_promise_at_the_least_similarity(n):
    """Lines of n shingles, of which eight ninths are in both."""
    rng = np.random.default_rng(n)
    k = n // 9
    lines = []
    for _ in range(2000):
        text = "".join(map(chr, rng.integers(0x4E00, 0x9000, n + k + 4)))
        lines += [text[:-k].encode(), text[k:].encode()]
    assert line_dedup.similar(lines[0].decode(), lines[1].decode(), 80)
    keys = line_dedup._keys(lines)
    assert (keys[::2] == keys[1::2]).any(axis=1).mean() >= 0.98


def test_copies_are_dealt_to_several_chunks(spark):
    for id_ in ("doc_id", "row_id"):
        docs = spark.createDataFrame([(i, "the same text") for i in range(40)], f"{id_} long, _text string")
        assert in_chunks(docs, 100, "_text").select("chunk").distinct().count() > 2
