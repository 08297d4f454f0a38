"""Operators 11 to 13 against plain versions, with nulls, ties, repeats, odd vectors, empty tables and clashing names."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.llm import clustering, exactdup, whitening

NAN, INF = float("nan"), float("inf")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def grid(vector):
    return [math.floor(256 * c) for c in vector]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    coarse = (rng.integers(-40, 40, (300, 8)) / 100).tolist()
    return [(i, v) for i, v in enumerate(coarse)] + [(900 + i, coarse[0]) for i in range(150)] + [(7, coarse[7]), (None, coarse[9])]


@pytest.fixture(scope="module")
def odd():
    return [(2000, None), (2001, []), (2002, [0.1] * 7), (2003, [0.1] * 7 + [NAN]), (2004, [0.1] * 7 + [INF]), (2005, [0.1] * 7 + [None]), (2006, [0.1] * 9)]


def frame(spark, data):
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    return df.withColumns({c: F.lit(1) for c in "x v cluster n s cnt dim turn packet ids width component label lost".split()})


def plain_clusters(data, k, rounds, seed=2):
    kept = [(i, grid(v)) for i, v in data]
    first = sorted(((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "~", x) for i, x in kept))[:k]
    centroids = [list(x) for _, x in first]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    nearest = lambda x: min((far(x, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, x in kept:
            own.setdefault(nearest(x)[1], []).append(x)
        centroids = [[sum(v) // len(own[j]) for v in zip(*own[j])] if j in own else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    inertia = {j: sum(d for _, c, d in found if c == j) for _, j, _ in found}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), names[j]) for i, j, d in found), key=repr)


@pytest.mark.parametrize("packing", [{}, {"rows": 7}, {"rows": 50, "widths": (4,)}, {"widths": (2, 8)}])
def test_clusters_equal_plain_rounds(spark, vectors, odd, packing):
    df = frame(spark, vectors + odd)
    assert rows(clustering.cluster_digest(df, k=6, rounds=3, dimensions=8, **packing)) == plain_clusters(vectors, 6, 3)


def test_clusters_of_few_far_and_no_vectors(spark, vectors, odd):
    few = vectors[:3]
    assert rows(clustering.cluster_digest(frame(spark, few), k=6, rounds=2, dimensions=8)) == plain_clusters(few, 6, 2)
    assert clustering.cluster_digest(frame(spark, odd), k=6, dimensions=8).count() == 0
    assert clustering.cluster_digest(frame(spark, vectors).limit(0), k=6, dimensions=8).count() == 0
    far = [(1, [1e12] * 8), (2, [-1e12] * 8), (3, [1.1e12] * 8)]
    got = {r.vec_id: r for r in clustering.cluster_digest(frame(spark, far), k=2, rounds=1, dimensions=8).collect()}
    want = {r[0]: r for r in plain_clusters(far, 2, 1)}
    assert {i: r.cluster for i, r in got.items()} == {i: r[1] for i, r in want.items()}
    assert all(got[i].distance == (r[2] if r[2] < 1 << 63 else None) for i, r in want.items())
    assert all(got[i].centroid_sha256 == r[5] for i, r in want.items())


def plain_whitening(data, components=4):
    kept = [(i, grid(v)) for i, v in data]
    fit = [list(x) for x in {tuple(x) for _, x in kept}]
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    gaps = np.array([[float(x[j] - Fraction(sums[j], n)) for j in range(d)] for x in fit])
    values, axes = np.linalg.eigh(gaps.T @ gaps / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return n, sums, values, axes, float(np.trace(gaps.T @ gaps / n)), kept


def test_whitening_equals_a_plain_one(spark, vectors, odd):
    n, sums, values, axes, trace, kept = plain_whitening(vectors)
    got = whitening.whiten(frame(spark, vectors + odd).repartition(5)).collect()
    assert len(got) == 4 * len(vectors) and {r.n for r in got} == {n}
    deviation = {tuple(x): sum((n * a - s) ** 2 for a, s in zip(x, sums)) for _, x in kept}
    assert sorted((r.deviation for r in got if r.component == 1)) == sorted(deviation[tuple(x)] for _, x in kept)
    by_id = dict(kept)
    for j in range(4):
        mine = {r.vec_id: r.whitened for r in got if r.component == j + 1}
        want = {i: float((np.array(by_id[i]) - np.array(sums) / n) @ axes[:, j] / np.sqrt(values[j])) for i in mine}
        sign = 1 if mine[1] * want[1] > 0 else -1
        assert all(abs(mine[i] - sign * want[i]) < 1e-9 for i in mine)
        assert all(r.explained == pytest.approx(values[j] / trace, rel=1e-9) for r in got if r.component == j + 1)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_covariance_is_exact(spark):
    # a large common offset that a sum of products in doubles would drown in
    rng = np.random.default_rng(3)
    x = rng.integers(-5, 5, (400, 4)) + np.array([10**9, -(10**9), 3, 10**12])
    fit = spark.createDataFrame([(row,) for row in {tuple(map(int, r)) for r in x}], "x array<long>")
    own = np.array([r.x for r in fit.collect()], dtype=object)
    n = len(own)
    mean = [Fraction(int(sum(own[:, j])), n) for j in range(4)]
    want = [[float(sum((a[i] - mean[i]) * (a[j] - mean[j]) for a in own) / n) for j in range(4)] for i in range(4)]
    assert whitening.moments(fit, 4).covariance().tolist() == want


def test_whitening_without_variance(spark, odd):
    same = [(i, [0.25, -0.5, 0.0]) for i in range(9)]
    assert whitening.whiten(frame(spark, same)).count() == 0
    assert whitening.whiten(frame(spark, same[:1])).count() == 0
    assert whitening.whiten(frame(spark, same).limit(0)).count() == 0
    line = [(i, [0.25 * i, 0.5 * i, 0.0]) for i in range(9)]
    got = whitening.whiten(frame(spark, line + odd[:2])).collect()
    assert {r.component for r in got} == {1} and len(got) == 9 and got[0].explained == pytest.approx(1.0)
    far = [(i, [1e17 * (i % 3), float(i)]) for i in range(6)]
    got = whitening.whiten(frame(spark, far)).collect()
    assert all(r.deviation is None and math.isfinite(r.whitened) for r in got) and got[0].identity_error < 1e-4


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for universe, n in ((1, 1), (10, 10), (1 << 20, 0), (1 << 20, 1), (1 << 20, 5000), (1 << 44, 3000), (1000, 999)):
        values = np.sort(rng.choice(min(universe, 1 << 22), n, replace=False).astype(np.int64)) * max(1, universe >> 22)
        shift, payload = exactdup.golomb_encode(values, universe)
        assert exactdup.golomb_decode(n, shift, payload).tolist() == values.tolist()
    # close to the entropy of the gaps
    values = np.unique(rng.integers(0, 1 << 30, 10_000))
    assert len(exactdup.golomb_encode(values, 1 << 30)[1]) * 8 / len(values) < math.log2((1 << 30) / len(values)) + 2


TEXTS = ["Ab c", "aB C", "ab c", "ÄB", "äB", None, "", "x" * 3_000_000, "X" * 3_000_000, "other", "ab  c"]


@pytest.mark.parametrize("options", [{}, {"packet_bytes": 1}, {"packet_rows": 3, "owner_rows": 4, "least_owners": 2}, {"bits": 4, "packet_rows": 5}])
def test_exact_duplicates_equal_plain_groups(spark, options):
    data = list(enumerate(TEXTS)) + [(100 + i, "Hot" if i % 2 else "hOT") for i in range(60)] + [(3, "ÄB"), (3, "ÄB"), (None, "ÄB"), (None, "alone"), (None, "Alone"), (300, "solo")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4).withColumns({c: F.lit(1) for c in "packet print sha body suspect place owner row id kept n".split()})
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in data:
        groups.setdefault(low(t), []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = exactdup.exact_duplicates(df, **options).collect()
    want = sorted(((i, keep[low(t)], len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in data), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    stays = {}
    for r in got:
        if r.kept:
            assert r.doc_id == r.keep_id
            stays[r.text_sha256] = stays.get(r.text_sha256, 0) + 1
    assert stays == {hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups}
    assert exactdup.exact_duplicates(df.limit(0)).count() == 0
