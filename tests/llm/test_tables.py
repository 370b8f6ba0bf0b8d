"""Operators 11 to 13: vector codes, time partitions and the mix of sources."""

import calendar
import datetime
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestone.io import kept_dir
from lodestone.llm import mixing, queries, time_partitions, vector_codes
from tests.llm.helpers import empty, sha
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_source_mix"])
def test_query_equals_sql(spark, name):
    assert same(__spark_entry__.queries()[name](spark, SF), connect(SF).sql(__spark_entry__.oracle_sql()[name]))


# Operator 11


def plain_codes(rows, parts, entries, rounds, scale):
    """Product codes in plain Python, one vector after another."""
    size = len(rows[0][2]) // parts
    cut = [[[int(np.floor(scale * x)) for x in v[p * size : (p + 1) * size]] for p in range(parts)] for _, _, v in rows]
    books = [[cut[i][p] for i in range(min(entries, len(rows)))] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        groups = defaultdict(list)
        for v in cut:
            for p in range(parts):
                groups[p, near(p, v[p])[1]].append(v[p])
        for (p, e), found in groups.items():
            books[p][e] = [sum(x) // len(found) for x in zip(*found, strict=True)]
    best = [[near(p, v[p]) for p in range(parts)] for v in cut]
    return [("".join(f"{e:02x}" for _, e in b), sum(d for d, _ in b)) for b in best], books


def test_vector_codes_odd_rows(spark):
    rnd = np.random.default_rng(3)
    make = lambda: [float(x) for x in rnd.normal(0, 0.3, 8).astype(np.float32)]
    good = [(i, i % 3 if i % 4 else None, make()) for i in range(60)]
    good += [good[5], (7, 1, good[9][2]), (None, None, make())]
    bad = [(1, 1, None), (2, 1, [None] + make()[1:]), (3, 1, [float("nan")] + make()[1:]), (4, None, [float("-inf")] + make()[1:])]
    short = [(-1, 0, [0.5] * 3), (-2, 0, []), (100, 0, [0.5] * 4)]
    df = spark.createDataFrame([(*r, 1, "x") for r in good + bad + short], "vec_id long, label int, embedding array<float>, code int, block string").repartition(5)
    found = [tuple(r) for r in vector_codes.compress(df, parts=4, entries=8).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect()]
    rows = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    codes, books = plain_codes(rows, 4, 8, 2, 256)
    totals = Counter()
    for (_, label, _), (_, error) in zip(rows, codes, strict=True):
        totals[label] += error
    digest = sha(",".join(str(x) for part in books for c in part for x in c))
    expected = [(i, label, c, e, totals[label], digest) for (i, label, _), (c, e) in zip(rows, codes, strict=True)]
    expected += [(i, label, None, None, totals[label], digest) for i, label, _ in short]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert vector_codes.compress(df.limit(0)).count() == 0
    none = vector_codes.compress(df.filter("vec_id < 0"), parts=4).collect()
    assert len(none) == 2 and all(r.code is None for r in none)
    with pytest.raises(Exception, match="in size"):
        vector_codes.compress(spark.createDataFrame([(1, 1, [2e6] * 16)], "vec_id long, label int, embedding array<float>")).collect()


def test_vector_codes_do_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    one, many = (vector_codes.train(vector_codes.usable(df.repartition(n), "embedding", "vec_id", "label")) for n in (1, 13))
    assert (one == many).all() and one.shape == (16, 64, 4)


# Operator 12

EPOCH = datetime.datetime(1970, 1, 1)


def plain_moment(click_id, ts):
    k = zlib.crc32(str(click_id).encode()) % 128
    if ts is None:
        return None
    if k < 16:
        return ts - datetime.timedelta(days=(k + 6) ** 3)
    return datetime.datetime(ts.year, ts.month, ts.day) - datetime.timedelta(days=ts.weekday()) if k > 111 else ts


def plain_layout(rows, limit):
    """{(leaf, part): rows in order} in plain Python; rows are (moment, arrived_at, click_id, whole row)."""
    key = lambda r: (r[0] or EPOCH, r[1], r[2], repr(r[3]))
    leaves = {"null": [r for r in rows if r[0] is None]}

    def split(prefix, depth, span, mine):
        part = lambda r: (r[0].year, r[0].month, r[0].day, r[0].hour)[depth]
        by, run = defaultdict(list), None
        for r in mine:
            by[part(r)].append(r)
        text = (lambda v: f"{v:04d}") if depth == 0 else (lambda v: f"{v:02d}")
        for child in span:
            if len(by[child]) > limit:
                run = None
                if depth == 3:
                    leaves[f"{prefix}{text(child)}-{text(child)}"] = by[child]
                else:
                    at = by[child][0][0]
                    below = [range(1, 13), range(1, calendar.monthrange(at.year, at.month)[1] + 1), range(24)][depth]
                    split(f"{prefix}{text(child)}/", depth + 1, below, by[child])
            else:
                if run is None or len(run[2]) + len(by[child]) > limit:
                    run = [child, child, []]
                    found.append((prefix, text, run))
                run[1], run[2] = child, run[2] + by[child]

    found = []
    real = [r for r in rows if r[0] is not None]
    if real:
        split("", 0, range(min(r[0].year for r in real), max(r[0].year for r in real) + 1), real)
    for prefix, text, (a, b, mine) in found:
        leaves[f"{prefix}{text(a)}-{text(b)}"] = mine
    out = {}
    for name, mine in leaves.items():
        mine = sorted(mine, key=key)
        for at in range(0, len(mine), limit):
            out[name, at // limit + 1] = mine[at : at + limit]
    return out


def test_time_partitions_against_plain_python(spark, tmp_path):
    rnd = random.Random(4)
    day = datetime.timedelta(days=1)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        ts = start + rnd.random() ** 3 * 150 * day
        ts = None if i % 97 == 0 else ts.replace(microsecond=0) if i % 3 else datetime.datetime(2024, 3, 5, 7, rnd.randint(0, 2))
        arrived = (ts or start) + rnd.random() * 3 * day
        rows.append((rnd.randint(0, 2500), ts, arrived.replace(microsecond=5), 1, None if i % 5 == 0 else "k", rnd.random(), '{"a": 1}'))
    rows += rows[:40] + [rows[3]] * 60
    columns = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
    (tmp_path / "d").mkdir()
    spark.createDataFrame(rows, columns).repartition(4).write.parquet(str(tmp_path / "d/clicks.parquet"))
    found = {(r.leaf, r.part): r for r in queries.op12_time_partitions(spark, str(tmp_path / "d")).collect()}
    limit, may = 1 + len(rows) // 500, datetime.datetime(2024, 5, 1)
    keyed = [(plain_moment(r[0], r[1]), r[2], r[0], r) for r in rows]
    old, new = plain_layout([r for r in keyed if r[1] < may], limit), plain_layout(keyed, limit)
    assert set(found) == set(new) and any(p > 1 for _, p in new) and any(n[0] == "null" for n in new)
    stayed = 0
    for name, mine in new.items():
        r = found[name]
        assert (r.n_rows, r.n_new) == (len(mine), sum(x[1] >= may for x in mine))
        assert r.ids_sha256 == hashlib.sha256(",".join(str(x[2]) for x in mine).encode()).hexdigest()
        recurs = sorted(old.get(name, []), key=repr) == sorted(mine, key=repr)
        assert r.rewritten == (not recurs)
        stayed += recurs
        file = pq.read_table(r.path.removeprefix("file:"))
        assert file.column_names == r.columns.split(",") == [c.split()[0] for c in columns.split(", ")]
        assert file.column("click_id").to_pylist() == [x[2] for x in mine]
        assert Counter(map(repr, zip(*file.to_pydict().values(), strict=True))) == Counter(repr(x[3]) for x in mine)
    assert 0 < stayed < len(new)
    folder = next(iter(found.values())).path.rpartition("/")[0]
    import pathlib

    assert {p.name for p in pathlib.Path(folder.removeprefix("file:")).iterdir()} == {r.path.rpartition("/")[2] for r in found.values()}


def test_time_partitions_odd_rows(spark):
    columns = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, _n int, leaf string"
    args = (queries.F.col("ts"), queries.F.lit(True), ("arrived_at", "click_id"), "click_id")
    folder = kept_dir(spark, "t")
    assert time_partitions.write(spark.createDataFrame([], columns), folder, 3, *args) == []
    at = datetime.datetime(1999, 12, 31, 23, 59, 59, 999999)
    same_rows = [(None, at, None, 1, "a")] * 8 + [(2, None, at, 1, "b"), (None, None, None, None, None)]
    df = spark.createDataFrame(same_rows, columns)
    first = time_partitions.write(df, folder, 3, *args)
    assert [(x["leaf"], x["part"], x["n_rows"]) for x in first] == [("1999/12/31/23-23", 1, 3), ("1999/12/31/23-23", 2, 3), ("1999/12/31/23-23", 3, 2), ("null", 1, 2)]
    assert spark.read.parquet(folder).count() == 10
    again = time_partitions.write(df, folder, 3, args[0], queries.F.lit(False), *args[2:])
    assert [x["rewritten"] for x in again] == [False] * 4
    more = df.union(spark.createDataFrame([(9, at, at, 1, "new")], columns))
    last = time_partitions.write(more, folder, 3, args[0], queries.F.coalesce(queries.F.col("leaf") == "new", queries.F.lit(False)), *args[2:])
    assert [(x["part"], x["n_rows"], x["n_new"], x["rewritten"]) for x in last] == [(1, 3, 0, False), (2, 3, 0, False), (3, 3, 1, True), (1, 2, 0, False)]
    other = time_partitions.write(more, folder, 4, args[0], queries.F.lit(False), *args[2:])
    assert [x["n_rows"] for x in other] == [4, 4, 1, 2] and other[-1]["rewritten"] is False


# Operator 13


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    """Targets of sources in order, by repeated sharing."""
    total, capped = share * sum(sizes), {}
    while True:
        rest = [k for k in range(len(sizes)) if k not in capped]
        left = total - sum(capped.values())
        unit = left / sum(weights[k % len(weights)] for k in rest) if rest else 0
        above = [k for k in rest if unit * weights[k % len(weights)] > repeats * sizes[k]]
        if not above:
            return [capped.get(k, unit * weights[k % len(weights)]) for k in range(len(sizes))]
        capped |= {k: repeats * sizes[k] for k in above}


def documents(spark, texts):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, at int, shard string, rank int"
    return spark.createDataFrame([(i, t, None, s, 1, "x", 2, "y", 3) for i, t, s in texts], schema)


def test_mix_reaches_its_targets(spark):
    rnd = random.Random(2)
    texts = [(i, " ".join("w" * rnd.randint(1, 3) for _ in range(int(rnd.paretovariate(0.9)) % 3000)), f"s{min(int(rnd.paretovariate(0.7)), 9)}") for i in range(600)]
    texts += [(None, "null id " * 9, "s1"), (5, None, "s2"), (6, "", None), (7, "x " * 700, None), (8, " \t ", "z"), texts[3], texts[3]]
    df = documents(spark, texts)
    kinds = {}
    for shard_rows in (1000, None):  # with one shard for each source, and with many
        rows = mixing.mix(df, shard_rows=shard_rows).collect()
        assert len(rows) == len(texts)
        by = defaultdict(list)
        for r in rows:
            by[r.source].append(r)
        names = sorted((x for x in by if x is not None)) + [None]
        sizes = [sum(r.size for r in by[n]) for n in names]
        for name, size, target in zip(names, sizes, plain_targets(sizes), strict=True):
            taken = sum(r.taken for r in by[name])
            assert all(r.source_size == size and r.target == pytest.approx(target) and 0 <= r.taken <= 2 * r.size for r in by[name])
            assert abs(taken - target) <= 4 * (1 if shard_rows else len(by[name]) ** 0.5) * 2
        kinds[shard_rows] = sorted((r.doc_id or -1, r.size, r.taken) for r in rows)
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.mix(df.repartition(7)).collect()) == kinds[None]
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len((t or "").split())) for i, t, _ in texts)


def plain_sainte_lague(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda k: (votes[k] / (2 * won[k] + 1), -k))
        won[best] += 1
    return won


@pytest.mark.parametrize("seed", range(6))
def test_quotas_are_those_of_sainte_lague(spark, seed):
    rnd = random.Random(seed)
    votes = [float(rnd.choice([0, 1, 5, 5, 5, 40, 900, rnd.randint(1, 3000)])) for _ in range(rnd.randint(1, 14))]
    total = sum(votes)
    rows = spark.createDataFrame([(k + 1, f"s{k:02d}", v) for k, v in enumerate(votes)], "sid long, source string, target double")
    block = rnd.choice([1, 7, 300])
    found = {r.sid: r.quota for r in mixing.source_quotas(rows, total, block).collect()}
    assert [found[k + 1] for k in range(len(votes))] == plain_sainte_lague(votes, int(total / block + 0.5) if total else 0)


def test_mix_of_nothing(spark, tmp_path):
    assert mixing.mix(empty(spark, tmp_path)).count() == 0
    rows = mixing.mix(documents(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2
    one = mixing.mix(documents(spark, [(1, "a b c d e f g h i j", "a")])).first()
    assert (one.size, one.target) == (10, 15.0) and 10 <= one.taken <= 20


def test_ranks_are_row_numbers(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("a"), "id").repartition(6)
    found = mixing.ranked(rows, F.desc("a"), "id").orderBy("rank").collect()
    assert [(r.a, r.id) for r in found] == sorted(((i % 7, i) for i in range(500)), key=lambda x: (-x[0], x[1]))
    assert [r["rank"] for r in found] == list(range(1, 501))
