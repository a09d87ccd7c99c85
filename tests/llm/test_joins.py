"""Whitening, the shingle join, hard negatives and links of families, against brute force."""

import os
import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pmspark.llm import families, negatives, parity, whitening

INNER = ("id", "_id", "key", "group", "n", "values", "anchor", "label", "score", "windows", "x", "i", "_doc", "first", "root", "node", "deviation", "side", "block")


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(x) for x in range(n)]


def alike(sets, num, den):
    return [(i, j) for i, j in combinations(range(len(sets)), 2) if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]


def family(rng, n, size, edits, halves=0):
    """Sets with changes of their own to one base; with halves, some changes are shared by half of them."""
    base = rng.sample(range(10**6), size)
    out = []
    for i in range(n):
        s = set(base) if not halves or i % 2 else set(base[halves:]) | set(range(-halves, 0))
        for x in rng.sample(sorted(s), rng.randint(0, edits)):
            s.discard(x)
            s.add(rng.randrange(10**7, 10**9))
        out.append(s)
    return out


CASES = [(40, 30, 0, 0), (60, 60, 5, 0), (60, 60, 9, 0), (80, 40, 8, 3), (50, 12, 3, 2), (30, 3, 2, 1)]


@pytest.mark.parametrize("case", CASES)
def test_links_of_a_group_join_what_brute_force_joins(case):
    rng = random.Random(str(case))
    sets = family(rng, *case) + family(rng, 9, 20, 6) + [set(rng.sample(range(10**9), 25)) for _ in range(9)] + [set()]
    rng.shuffle(sets)
    arrays = [np.array(sorted(s), dtype=np.int64) for s in sets]
    for num, den in ((85, 100), (8, 10), (1, 2)):
        found = families.linked(list(range(len(sets))), arrays, num, den)
        want = alike(sets, num, den)
        assert set(map(frozenset, found)) <= set(map(frozenset, want))
        # Empty sets are nobody's copies for the operators, which leave them out; here two of them would be equal.
        assert roots(len(sets), found) == roots(len(sets), want)
        assert len(found) < len(sets)


def as_frames(spark, groups, sets):
    rows = [(g, i) for g, ids in groups.items() for i in ids]
    values = [(i, len(s), sorted(s)) for i, s in enumerate(sets)]
    sets = spark.createDataFrame(values, "id bigint, n bigint, holder array<bigint>").repartition(3)
    return spark.createDataFrame(rows, "group bigint, id bigint").repartition(3), sets.select("id", "n"), sets.select("id", "holder")


@pytest.mark.parametrize("case", CASES[1:4])
def test_large_groups_fall_apart_without_losing_a_link(spark, monkeypatch, case):
    rng = random.Random(str(case))
    sets = family(rng, *case) + [set(rng.sample(range(10**9), 25)) for _ in range(20)] + family(rng, 30, 50, 4)
    groups, *frames = as_frames(spark, {0: range(len(sets)), 7: range(10)}, sets)
    monkeypatch.setattr(families, "MEMBERS", 12)
    monkeypatch.setattr(families, "SAMPLED", 400)
    monkeypatch.setattr(families, "TOKENS", 600)
    found = [(r["a"], r["b"]) for r in families.links(groups, *frames, 85, 100).collect()]
    want = alike(sets, 85, 100)
    assert set(map(frozenset, found)) <= set(map(frozenset, want)) and roots(len(sets), found) == roots(len(sets), want)


def test_two_sets_too_large_for_a_task_still_meet(spark, monkeypatch):
    sets = [set(range(5000)), set(range(100, 5100)), set(range(2000, 7000))]
    groups, *frames = as_frames(spark, {0: [0, 1, 2]}, sets)
    monkeypatch.setattr(families, "TOKENS", 1000)
    monkeypatch.setattr(families, "SAMPLED", 1000)
    assert {frozenset((r["a"], r["b"])) for r in families.links(groups, *frames, 85, 100).collect()} == {frozenset((0, 1))}


def test_homes_bring_every_two_of_a_key_together(spark, monkeypatch):
    rng = random.Random(4)
    rows = sorted({(rng.randrange(200), rng.choice([1, 1, 1, rng.randrange(90)])) for _ in range(900)})
    df = spark.createDataFrame(rows, "id bigint, key bigint").repartition(5)
    for hot in (10**9, 20):
        monkeypatch.setattr(families, "HOT", hot)
        monkeypatch.setattr(families, "SAMPLE", 1)
        members = {}
        for r in families.homes(df, df).collect():
            members.setdefault(r["group"], set()).add(r["id"])
        for key in range(90):
            ids = {i for i, k in rows if k == key}
            assert len(ids) < 2 or ids <= members[min(ids)]


def sketches(sets, least=512):
    h = [np.array(sorted(x * 0x9E3779B97F4A7C15 % (1 << 64) for x in s), dtype=np.uint64) for s in sets]
    return families.parities(np.concatenate(h), np.cumsum([0, *map(len, h)]), least)


def test_groups_are_parted_by_sketches_and_united_where_they_overlap(spark, monkeypatch):
    rng = random.Random(2)
    sets = family(rng, 20, 60, 3) + family(rng, 20, 60, 3) + [set(rng.sample(range(10**9), 25)) for _ in range(9)]
    nodes = spark.createDataFrame([(i, len(s), o.tolist()) for i, (s, o) in enumerate(zip(sets, sketches(sets), strict=True))], "id bigint, n bigint, odd array<bigint>")
    every = range(len(sets))
    groups = spark.createDataFrame([(g, i) for g, ids in ((0, every), (1, every[:30]), (2, [0, 45]), (3, [3, 4])) for i in ids], "group bigint, id bigint").repartition(3)
    for members in (2048, 25):
        monkeypatch.setattr(families, "MEMBERS", members)
        got = {}
        for r in families.sharpened(groups, nodes, 85, 100).collect():
            got.setdefault(r["group"], set()).add(r["id"])
        want = {frozenset(every[:20]), frozenset(every[20:40])} if members > 25 else {frozenset(every), frozenset((3, 4))}
        assert set(map(frozenset, got.values())) == want and len(got) == len(want)


def test_large_groups_of_strangers_and_families_are_parted_by_sketches(spark, monkeypatch):
    """What overlapping large groups have: each family once, and no stranger; a group beyond the limits goes through whole."""
    rng = random.Random(3)
    sets = family(rng, 40, 60, 3) + family(rng, 40, 60, 3) + [set(rng.sample(range(10**9), 25)) for _ in range(30)]
    nodes = spark.createDataFrame([(i, len(s), o.tolist()) for i, (s, o) in enumerate(zip(sets, sketches(sets), strict=True))], "id bigint, n bigint, odd array<bigint>")
    every, pair = range(len(sets)), alike(sets, 85, 100)[0]
    groups = spark.createDataFrame([(g, i) for g, ids in ((0, every), (1, every[1:]), (2, every[:70]), (3, pair)) for i in ids], "group bigint, id bigint").repartition(3)
    monkeypatch.setattr(families, "MEMBERS", 12)
    for longs, want in ((1 << 22, {frozenset(every[:40]), frozenset(every[40:80])}), (8 * 50, {frozenset(every), frozenset(pair)})):
        monkeypatch.setattr(families, "LONGS", longs)
        got = {}
        for r in families.sharpened(groups, nodes, 85, 100, 1000).collect():
            got.setdefault(r["group"], []).append(r["id"])
        assert set(map(frozenset, got.values())) == want and sum(map(len, got.values())) == sum(map(len, want))


def test_sketches_of_any_lengths_never_part_what_is_similar():
    rng = random.Random(12)
    sets = [s for size in (40, 500, 520, 1100, 2100) for s in family(rng, 8, size, size // 14)]
    odd = sketches(sets, 64)
    assert {len(o) for o in odd} >= {1, 8, 16, 32}
    up = families.possible(np.array([len(s) for s in sets]), odd, 85, 100)
    assert all(up[i] == up[j] for i, j in alike(sets, 85, 100))
    assert len(set(up.tolist())) > 3


# The shingle join.


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def texts_of_all_kinds(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [None, "", " \n ", "One", "one", "ONE two", "a b c d", "A b\tc d", "x y z x y z x y z x y z"]
    for length in (5, 6, 8, 9, 12, 25, 60, 140, 400, 3000):
        base = [word() for _ in range(length)]
        for n_edits in (0, 0, 1, 1, 1, 2, 2, 3, 5, length // 40, length // 30, length // 25, length // 20):
            w = list(base)
            for _ in range(n_edits):
                kind, at = rng.randrange(3), rng.randrange(len(w))
                w[at : at + (kind > 0)] = [word()] if kind < 2 else []
            texts.append(" ".join(w))
    return texts


def test_shingle_join_equals_brute_force(spark):
    texts = texts_of_all_kinds(1) + texts_of_all_kinds(2)
    rows = [(i, t, *range(len(INNER))) for i, t in enumerate(texts)]
    rows += [(0, "another text of the id that is null above"), (3, "one"), (None, texts[30]), (None, None), (10_000, "k " * 90_000 + "end of this")]
    rows = [(*r, *range(len(INNER)))[: 2 + len(INNER)] for r in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{c}` int" for c in INNER)).repartition(4)
    sets = [shingles(r[1]) for r in rows]
    known = [i for i, r in enumerate(rows) if r[0] is not None and sets[i]]
    at = roots(len(known), alike([sets[i] for i in known], 85, 100))
    least = {}
    for i, root in zip(known, at, strict=True):
        least[root] = min(least.get(root, rows[i][0]), rows[i][0])
    component = dict(zip(known, (least[r] for r in at), strict=True))
    want = sorted((str(r[0]), len(sets[i]), str(component.get(i, r[0]))) for i, r in enumerate(rows))
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in parity.similar_documents(df).collect())
    assert got == want and len(set(at)) < len(known) - 50


def test_shingle_join_reads_no_strangers_of_large_groups(spark, monkeypatch):
    """A family beyond MEMBERS is one group of exact links, and strangers are in none."""
    rng, groups = random.Random(5), []
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(f"x{k}" if i in at else w for i, w in enumerate(base)) for k in range(60) for at in [{rng.randrange(150)}]]
    texts += [" ".join(f"y{rng.randrange(10**9)}" for _ in range(150)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    sets = [shingles(t) for t in texts]
    monkeypatch.setattr(families, "MEMBERS", 20)
    monkeypatch.setattr(parity, "links", lambda g, *more: groups.append(g.collect()) or families.links(g, *more))
    got = {r["doc_id"]: r["component_id"] for r in parity.similar_documents(df).collect()}
    assert got == dict(enumerate(roots(len(sets), alike(sets, 85, 100))))
    assert len(groups[0]) == 60 and len({r["group"] for r in groups[0]}) == 1


def test_shingle_join_of_empty_tables_and_text_ids(spark, none):
    assert parity.similar_documents(none).count() == 0
    df = spark.createDataFrame([("b", "a b c d e f g h"), ("a", "A B c d e f g h"), ("c", "q")], "doc_id string, text string")
    assert sorted(map(tuple, parity.similar_documents(df).collect())) == [("a", 5, "a"), ("b", 5, "a"), ("c", 1, "c")]


def test_similar_sets_share_a_key():
    """The pigeonhole, with few bits so that many shingles cancel, and with sets of many poor blocks."""
    rng = random.Random(6)
    bands = parity.Bands()
    for size in (7, 9, 13, 30, 70, 200, 900):
        base = rng.sample(range(1 << 60), size)
        most = 15 * 2 * size // 185
        for _ in range(25):
            out = set(base) - set(rng.sample(base, rng.randint(0, most)))
            other = out | {rng.randrange(1 << 60) for _ in range(rng.randint(0, most))}
            if not 100 * len(out) >= 85 * len(other) or len(out) == len(other):
                continue
            h = [np.array(sorted(s), dtype=np.uint64) for s in (out, other)]
            keys, at = bands.keys(np.concatenate(h), np.cumsum([0, len(h[0]), len(h[1])]))
            assert set(keys[: at[1]].tolist()) & set(keys[at[1] :].tolist())


@pytest.mark.parametrize("size", [20, 45, 400])
def test_strangers_do_not_gather_at_poor_blocks(size):
    """Sets that have nothing in common: no key is of more than a few of them, however many there are. A copy of each still shares a key with it."""
    n, edits = 4000, 15 * 2 * size // 185 // 2
    h = np.random.default_rng(size).integers(1 << 62, size=(n, size), dtype=np.uint64) << np.uint64(2)
    other = h.copy()
    other[:, :edits] += np.uint64(1)
    rows = np.sort(np.concatenate([h, other]), axis=1)
    bands = parity.Bands()
    keys, at = bands.keys(rows.ravel(), np.arange(2 * n + 1) * size)
    assert np.unique(keys[: at[n]], return_counts=True)[1].max() <= 3
    first, last = bands.of(np.array([size, size * 100 // 85]))
    assert len(keys) <= 1.1 * 2 * n * bands.blocks[first : last + 1].sum()
    for i in range(n):
        assert np.isin(keys[at[i] : at[i + 1]], keys[at[n + i] : at[n + i + 1]]).any()


def test_sketches_differ_in_no_more_blocks_than_sets_in_shingles():
    rng = random.Random(9)
    bands = parity.Bands()
    a = rng.sample(range(1 << 60), 300)
    b = a[3:] + [rng.randrange(1 << 60) for _ in range(3)]
    h = [np.array(sorted(s), dtype=np.uint64) for s in (a, b)]
    band = bands.of(np.array([300, 300]))
    keys, row = bands._sketched(np.concatenate(h), np.array([0, 300, 600]), np.array([0, 1]), band)
    assert len(set(keys[row == 0].tolist()) - set(keys[row == 1].tolist())) <= 6


# Whitening.


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)) @ rng.normal(size=(d, d))


def frame(spark, rows, more=()):
    rows = [(i, v, *range(len(more))) for i, v in rows]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>" + "".join(f", `{c}` int" for c in more)).repartition(3)


def test_factor_and_rotations():
    rng = np.random.default_rng(3)
    for d, r in ((1, 1), (6, 6), (9, 4), (30, 30)):
        x = rng.normal(size=(50, r)) @ rng.normal(size=(r, d)) * 10.0 ** rng.integers(-3, 4, d)
        c = x.T @ x
        f = whitening.pivoted_cholesky(c)
        assert f.shape == (d, min(r, d)) and np.allclose(f @ f.T, c, rtol=1e-9, atol=1e-9 * c.max())
        g = whitening.rotated(f)
        want = np.sort(np.linalg.eigvalsh(c))[::-1][: f.shape[1]]
        assert np.allclose((g * g).sum(0), want, rtol=1e-8, atol=1e-14 * want.max())  # the other way is exact to that only
        unit = g / np.sqrt((g * g).sum(0))
        assert np.abs(unit.T @ unit - np.eye(f.shape[1])).max() < 1e-12
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0) == whitening.rotated(np.zeros((3, 0))).shape


def test_whitening_equals_an_eigendecomposition(spark):
    x = vectors(1, 300, 12)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (None, x[7].tolist())]
    bad = [(900, None), (901, [None] * 12), (902, [float("nan")] + [0.0] * 11), (903, [float("inf")] + [0.0] * 11), (904, [1.0]), (905, [])]
    good, d = whitening.usable(frame(spark, rows + bad, INNER), "embedding")
    fit = whitening.fit_whitening(good)
    assert (d, fit.n) == (12, 302)
    y = np.array([v for _, v in rows])
    y = y - y.mean(0)
    e, u = np.linalg.eigh(y.T @ y / len(y))
    assert np.allclose(fit.eigenvalues, e[::-1]) and np.isclose(fit.trace, e.sum())
    assert np.allclose(np.abs((fit.components * u[:, ::-1]).sum(0)), 1)
    white = whitening.whitened(good, fit, components=5)
    assert white.columns == [*good.columns, "whitened"]
    got = np.array([r["whitened"] for r in white.collect()])
    assert got.shape == (302, 5) and np.allclose(got.T @ got / 302, np.eye(5), atol=1e-9)
    assert whitening.identity_error(white, 5) < 1e-9


def test_whitening_without_variance_or_rows(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        good, _ = whitening.usable(frame(spark, rows), "embedding")
        fit = whitening.fit_whitening(good)
        assert len(fit.eigenvalues) == 0 and fit.n == sum(bool(v) for _, v in rows)
    good, _ = whitening.usable(frame(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)]), "embedding")
    fit = whitening.fit_whitening(good)
    assert len(fit.eigenvalues) == 1 and np.isclose(fit.eigenvalues[0], fit.trace)
    assert {len(r["whitened"]) for r in whitening.whitened(good, fit).collect()} == {1}


def write(spark, folder, df):
    df.coalesce(1).write.parquet(str(folder / "embeddings.parquet"))
    return str(folder)


HARD = [(1, [0.5, None], 1), (2, None, 1), (3, [float("nan"), 1.0], 2), (None, [0.25, 0.5], 1), (50, [1e30, -1e30], 3), (100, [0.1], 1), (150, [0.1, 0.2], None)]


def test_op11_over_hard_rows(spark, tmp_path):
    rows = HARD + [(i, [0.1 * i, -0.3 + 0.01 * i * i], i % 3) for i in range(200, 230)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    out = whitening.op11_whitening(spark, write(spark, tmp_path, df)).collect()
    assert {r["vec_id"] for r in out} == {None, 50, 150, *range(200, 230)} and {r["n"] for r in out} == {33}
    assert whitening.op11_whitening(spark, write(spark, tmp_path / "none", df.limit(0))).columns == [c.split()[0] for c in whitening.SCHEMA.split(", ")]


# Hard negatives.


def brute_negatives(rows, anchors):
    """rows: id -> (label, vector)."""
    out = []
    for a in sorted(anchors):
        score = {i: sum(x * y for x, y in zip(rows[a][1], v)) for i, (_, v) in rows.items() if i != a}  # noqa: B905
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if rows[i][0] == rows[a][0]][:5]:
            fits = [i for i in order if rows[i][0] != rows[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:3]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(4096, 1024, 2048), (20, 3, 5)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, sizes):
    """Many ties and a hot label, in one cell and in many."""
    for name, n in zip(("SLICE", "BLOCK", "GO"), sizes, strict=True):
        monkeypatch.setattr(negatives, name, n)
    rng = random.Random(11)
    rows = {i: (rng.choice([0, 0, 0, 1, 2, 3]), [rng.randint(-3, 6) for _ in range(rng.choice([3, 4]))]) for i in range(-40, 160)}
    rows |= {500: (9, [1, 1, 1, 1]), 505: (0, [0, 0, 0, 0]), 510: (1, [-9, -9, -9, -9])}
    data = [(i, r[0], r[1], *range(len(INNER))) for i, r in rows.items()] + [(7, 99, [1, 2, 3], *range(len(INNER))), (None, 1, [1], *range(len(INNER))), (600, None, [1], *range(len(INNER))), (605, 1, None, *range(len(INNER)))]
    names = [f"c_{c}" if c == "label" else c for c in INNER]
    df = spark.createDataFrame(data, "vec_id bigint, label int, embedding array<bigint>, " + ", ".join(f"`{c}` int" for c in names)).repartition(3)
    got = sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 5 == 0).collect()))
    want = brute_negatives(rows, [i for i in rows if i % 5 == 0])
    assert got == want and len({r[0] for r in want}) > 10
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_keys_sort_as_their_parts():
    rng = random.Random(5)
    rows = [(rng.randint(-(1 << 63), (1 << 63) - 1), rng.choice([0, 5, -5, rng.randint(-(1 << 63), (1 << 63) - 1)]), rng.random() < 0.5, rng.randint(-9, 9)) for _ in range(500)]
    assert [negatives.unpacked(k) for k in sorted(negatives.packed(*r) for r in rows)] == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))


def test_scores_beyond_doubles_are_whole():
    a = np.array([[(1 << 30) + 1, 3]], dtype=np.int64)
    assert negatives._scores(a, a).item() == ((1 << 30) + 1) ** 2 + 9
    assert list(negatives.matrix(pa.array([[1], [2, 3]], pa.list_(pa.int64())), 3).ravel()) == [1, 0, 0, 2, 3, 0]


def test_op13_over_hard_rows(spark, tmp_path):
    data = HARD + [(i, [0.2 * (i % 5), 0.3 + 0.01 * (i % 11)], i % 4) for i in range(250, 330)]
    schema = "vec_id bigint, embedding array<float>, label int"
    assert negatives.op13_hard_negatives(spark, write(spark, tmp_path / "all", spark.createDataFrame(data, schema))).count()
    data = [r for r in data if r[0] != 50]
    out = negatives.op13_hard_negatives(spark, write(spark, tmp_path / "some", spark.createDataFrame(data, schema))).collect()
    floor = lambda v: [int(np.floor(256 * float(np.float32(x)))) for x in v]
    rows = {i: ((label + 1) % 10 if i % 7 == 0 else label, floor(v)) for i, v, label in data if i == 100 or i is not None and i >= 200}
    want = brute_negatives(rows, [i for i in rows if i % 50 == 0])
    assert sorted(map(tuple, out)) == want and want


@pytest.mark.parametrize("module", [negatives, parity])
def test_oracles(spark, small, module):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(small, name)}.parquet'")
    for name, sql in module.ORACLES.items():
        got = module.QUERIES[name](spark, small)
        result = con.execute(sql)
        assert [c[0] for c in result.description] == got.columns
        assert sorted(result.fetchall()) == sorted(map(tuple, got.collect()))
