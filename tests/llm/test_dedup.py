"""Operators 1, 6, 8 and 9 against plain Python."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import exact_dedup, jaccard_join, substring_dedup, suffix_dedup
from lodestone.llm.kernels import leftmost_min, window_min
from tests.llm.helpers import corpus, empty, frame, sha

SPACES = " \t\n\x0b\f\r"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return frame(spark, corpus(), tmp_path_factory.mktemp("dedup"))


def test_window_minimum():
    rnd = np.random.default_rng(1)
    v = rnd.integers(0, 50, 300).astype(np.uint64)
    for width in (1, 2, 7, 137):
        assert window_min(v, width).tolist() == [int(v[i : i + width].min()) for i in range(300 - width + 1)]
    h = rnd.integers(0, 2**63, 500).astype(np.uint64)
    assert leftmost_min(h, 9).tolist() == [i + int(np.argmin(h[i : i + 9])) for i in range(492)]


def test_multikey_quicksort_sorts_and_measures_prefixes():
    rnd = np.random.default_rng(2)
    rows = rnd.integers(0, 2, (6000, 16)).astype(np.uint8)
    rows[:2000] = rows[0]
    order = suffix_dedup.multikey_quicksort(rows, small=16)
    assert sorted(order.tolist()) == list(range(len(rows)))
    texts = [rows[i].tobytes() for i in order]
    assert texts == sorted(texts)
    prefix = suffix_dedup.common_prefix(rows[order])
    for k in range(1, 200):
        a, b = texts[k - 1], texts[k]
        assert prefix[k] == next((i for i in range(16) if a[i] != b[i]), 16)


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_exact_dedup(docs, block):
    table, rows = docs
    plain = lambda t: "".join(c for c in (t or "") if c not in SPACES)
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[plain(t)].append((-len(t or ""), i is None, i))
    found = exact_dedup.find_copies(table, block=block).collect()
    assert len(found) == len(rows)
    for r in found:
        text = next(plain(t) for i, t, *_ in rows if i == r.doc_id)
        group = groups[text]
        assert (r.keep_id, r.group_size, r.text_sha256) == (min(group)[2], len(group), sha(text))
    assert sum(r.kept for r in found) == len(groups)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found if r.group_size == 1)


def test_exact_dedup_drops_rows_and_keeps_columns(docs, spark, tmp_path):
    table, rows = docs
    kept = exact_dedup.drop_copies(table)
    assert kept.columns == table.columns
    assert kept.count() == len({"".join((t or "").split()) for _, t, *_ in rows})
    assert exact_dedup.find_copies(empty(spark, tmp_path)).count() == 0


def brute_components(rows, percent=80):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """A large group of near copies, some of them further from the rest, and chains."""
    rnd = np.random.default_rng(12)
    base = [f"w{x}" for x in rnd.integers(0, 400, 120)]
    rows = []
    for i in range(160):
        words = list(base)
        for k in rnd.choice(120, int(rnd.integers(0, 6)), replace=False):
            words[k] = f"x{i}y{k}"
        rows.append((i * 2 + 1, " ".join(words)))
    chain = [f"c{x}" for x in range(400)]
    rows += [(1000 - k, " ".join(chain[k * 6 : k * 6 + 90])) for k in range(40)]
    return frame(spark, rows, tmp_path_factory.mktemp("crowd"), repeat=False)


@pytest.mark.parametrize("block", [5, 1 << 12])
@pytest.mark.parametrize("which", ["docs", "crowd"])
def test_near_duplicates(which, block, request, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    table, rows = request.getfixturevalue(which)
    wanted = brute_components(rows)
    found = [r for r in jaccard_join.near_duplicates(table).collect() if r.doc_id is not None]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == wanted
    assert len({c for _, c in wanted.values()}) < len(wanted)


def by_row(rows):
    """Class of each row by plain comparison: the least id that it reaches, and the row that stays of it."""
    wanted = brute_components([(k, t) for k, (_, t, *_) in enumerate(rows)])
    classes = {}
    for k, (_, c) in wanted.items():
        classes.setdefault(c, []).append(k)
    out = {}
    for members in classes.values():
        best = min(members, key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
        for k in members:
            out[k] = (wanted[k][0], rows[best][0] if wanted[k][0] else rows[k][0], best)
    return out


def test_near_duplicates_tell_texts_under_one_id_apart(twins):
    table, rows = twins
    wanted = by_row(rows)
    found = jaccard_join.near_duplicates(table).collect()
    assert sorted(map(repr, found)) == sorted(f"Row(doc_id={rows[k][0]}, n_shingles={n}, component_id={c})" for k, (n, c, _) in wanted.items())


@pytest.mark.parametrize("size", [1 << 24, 2000])
def test_rows_without_ids_and_twins_take_one_path(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(jaccard_join, "BYTES", size)
    text = " ".join(f"w{i}" for i in range(80))
    near, other = text.replace("w40 ", "x40 "), " ".join(f"v{i}" for i in range(60))
    plain = [(5, text), (None, text), (None, near), (7, near), (7, other), (9, "a b c d e f"), (None, "a b c d e f g h i j"), (None, None), (None, ""), (3, ""), (11, other), (12, " ".join(f"z{i}" for i in range(3000)))]
    for more in ([], [(9, "an unrelated twin of nine")]):
        table, rows = frame(spark, plain + more, tmp_path / str(len(more)), parts=1, repeat=False)
        found = sorted(map(repr, jaccard_join.near_duplicates(table).collect()))
        assert found == sorted(f"Row(doc_id={rows[k][0]}, n_shingles={n}, component_id={c})" for k, (n, c, _) in by_row(rows).items())
        kept = [(r.doc_id, r.text) for r in jaccard_join.keep_one(table).collect()]
        assert sorted(kept, key=repr) == sorted([(5, text), (7, other), (9, "a b c d e f"), (None, "a b c d e f g h i j"), (None, None), (None, ""), (3, ""), (12, " ".join(f"z{i}" for i in range(3000))), *more], key=repr)


def test_near_duplicates_keep_one(docs, spark, tmp_path):
    table, rows = docs
    kept = jaccard_join.keep_one(table)
    wanted = by_row(rows)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(((rows[k][0], rows[k][1]) for k, (n, _, best) in wanted.items() if not n or best == k), key=repr)
    assert kept.columns == table.columns
    assert jaccard_join.near_duplicates(empty(spark, tmp_path)).count() == 0


def test_rtree_loses_no_similar_pair():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[rnd.random(400) < 0.95], rnd.integers(0, 2**63, k % 30).astype(np.uint64)))) for k in range(60)]
    sets += [np.unique(rnd.integers(0, 2**63, 300 + 5 * k).astype(np.uint64)) for k in range(40)]
    seen = set()

    def similar(i, j):
        seen.add((min(i, j), max(i, j)))
        both = len(np.intersect1d(sets[i], sets[j]))
        return 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)

    root, _ = jaccard_join.forest([jaccard_join.point(s) for s in sets], np.array([len(s) for s in sets]), 80, similar)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert root[i] == root[j]
    assert len(seen) < len(sets) * (len(sets) - 1) // 2


def test_long_routes_are_named_by_their_shingle(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard_join, "ROUTE", 3)
    token = [1, 1, 2, 2, 2, 2, 2, 2, 2, 3, 4, 4]
    text = [5, 6, 1, 2, 3, 4, 4, 5, 6, 9, 7, 7]
    doc = [10, 11, 1, 2, 3, 4, 5, 6, 7, 9, 8, 9]
    batches = [pa.record_batch([pa.array(x[k : k + 2], pa.int64()) for x in (token, text, doc)], ["token", "text", "row"]) for k in range(0, 12, 2)]
    found = [(r["route"], r["row"]) for b in jaccard_join.routes(iter(batches)) for r in b.to_pylist()]
    assert sorted(d for _, d in found) == [1, 2, 3, 4, 6, 7, 10, 11]
    assert {r for r, d in found if d < 8} == {2}


def same_ids(rows):
    """Some rows under an id that another row has, with another text."""
    return [*rows, (rows[12][0], rows[15][1]), (rows[13][0], rows[-3][1]), (rows[14][0], "another text"), (rows[15][0], rows[30][1])]


@pytest.fixture(scope="module")
def twins(spark, tmp_path_factory):
    table, full = frame(spark, same_ids(corpus(6)), tmp_path_factory.mktemp("twins"))
    return table, full


@pytest.mark.parametrize("hot", [3, 1 << 14])
@pytest.mark.parametrize("which", ["docs", "twins"])
def test_substring_dedup(which, hot, request, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    table, rows = request.getfixturevalue(which)
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    wanted = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        wanted.append((str(i), len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    found = substring_dedup.remove_passages(table).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found) == sorted(wanted)
    assert sum(x[2] for x in wanted) > 100
    assert substring_dedup.remove_passages(empty(spark, tmp_path)).count() == 0


def test_substring_factors_cross_boundaries():
    index = {}
    assert substring_dedup.factors(b"a b c d e f", 1, index, 3) == ([], [(0, b"a b c"), (1, b"b c d"), (2, b"c d e"), (3, b"d e f")])
    assert substring_dedup.factors(b"x c d e y", 2, index, 3) == ([(1, 4)], [(0, b"x c d"), (2, b"d e y")])
    assert substring_dedup.factors(b"b c d e y z", 3, index, 3) == ([(0, 4), (2, 5)], [(3, b"e y z")])
    assert substring_dedup.factors(b"b c d", 1, index, 3) == ([], [(0, b"b c d")])


def test_rows_of_frequent_keys_are_combined():
    from lodestone.llm.common import ALONE, FIRST, SURE, kinds_in_batch

    assert kinds_in_batch(np.array([5, 7, 5, 5, 9, 7])).tolist() == [FIRST, FIRST, SURE, SURE, ALONE, SURE]
    assert kinds_in_batch(np.zeros(0, np.int64)).tolist() == []


def test_lengths_out_of_range_are_errors(docs):
    for call in (lambda: suffix_dedup.remove_repeats(docs[0], length=40), lambda: suffix_dedup.remove_repeats(docs[0], length=1 << 15), lambda: substring_dedup.remove_passages(docs[0], window=4)):
        with pytest.raises(ValueError):
            call()


def test_long_windows(docs):
    """Places of anchors far into their window fit."""
    table, rows = docs
    found = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(table, length=700).collect()}
    texts = [(i, (t or "").encode()) for i, t, *_ in rows if i is not None]
    count = Counter(b[k : k + 700] for _, b in texts for k in range(len(b) - 699))
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 699):
            if count[b[k : k + 700]] > 1:
                gone[k : k + 700] = b"\1" * 700
        assert found[i] == sum(gone)


@pytest.mark.parametrize("bucket", [40, 1 << 15])
@pytest.mark.parametrize("which", ["docs", "twins"])
def test_suffix_dedup(which, bucket, request, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    table, rows = request.getfixturevalue(which)
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    count = Counter(b[k : k + 200] for i, b in texts if i is not None for k in range(len(b) - 199))
    wanted = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if i is not None and count[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        wanted.append((str(i), len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    found = suffix_dedup.remove_repeats(table).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == sorted(wanted)
    assert suffix_dedup.remove_repeats(empty(spark, tmp_path)).count() == 0
