"""Array operators against numpy on small arrays."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import array as A
from tessera.operators import lanes, linalg, masked, products, random, reduce, sets

RNG = np.random.default_rng(20260731)
M = RNG.normal(size=(4, 6)).round(3)
V = np.array([3.0, 1.0, 2.0, 1.0, 0.0, -2.0, 5.0])
T = RNG.integers(-5, 6, size=(2, 3, 4))


@pytest.fixture(scope="module")
def m(spark):
    return A.array(spark, M)


@pytest.fixture(scope="module")
def v(spark):
    return A.array(spark, V)


@pytest.fixture(scope="module")
def t(spark):
    return A.array(spark, T)


def same(a, want, rtol=1e-9):
    got = np.array(a.tolist())
    assert a.shape == np.shape(want)
    np.testing.assert_allclose(got.astype(float), np.asarray(want).astype(float), rtol=rtol, atol=1e-9)


CASES = {
    "transpose": (lambda t: A.transpose(t, (2, 0, 1)), lambda x: x.transpose(2, 0, 1)), "swapaxes": (lambda t: A.swapaxes(t, 0, -1), lambda x: x.swapaxes(0, -1)), "moveaxis": (lambda t: A.moveaxis(t, [0, 1], [-1, 0]), lambda x: np.moveaxis(x, [0, 1], [-1, 0])),
    "rollaxis": (lambda t: A.rollaxis(t, 2, 1), lambda x: np.rollaxis(x, 2, 1)), "reshape": (lambda t: A.reshape(t, (4, -1)), lambda x: x.reshape(4, -1)), "expand": (lambda t: A.expand_dims(t, (0, 2)), lambda x: np.expand_dims(x, (0, 2))),
    "flip": (lambda t: A.flip(t, (0, 2)), lambda x: np.flip(x, (0, 2))), "rot90": (lambda t: A.rot90(t, 3, (1, 2)), lambda x: np.rot90(x, 3, (1, 2))), "roll": (lambda t: A.roll(t, 5), lambda x: np.roll(x, 5)), "roll_axes": (lambda t: A.roll(t, (1, -2), (0, 2)), lambda x: np.roll(x, (1, -2), (0, 2))),
    "tile": (lambda t: A.tile(t, (2, 1, 2)), lambda x: np.tile(x, (2, 1, 2))), "repeat": (lambda t: A.repeat(t, [1, 0, 2], 1), lambda x: np.repeat(x, [1, 0, 2], 1)), "concatenate": (lambda t: A.concatenate([t, t], 2), lambda x: np.concatenate([x, x], 2)),
    "stack": (lambda t: A.stack([t, t], -1), lambda x: np.stack([x, x], -1)), "diagonal": (lambda t: A.diagonal(t, 1, 1, 2), lambda x: x.diagonal(1, 1, 2)), "tril": (lambda t: A.tril(t, -1), lambda x: np.tril(x, -1)), "triu": (lambda t: A.triu(t, 1), lambda x: np.triu(x, 1)),
    "split": (lambda t: A.array_split(t, 3, 2)[1], lambda x: np.array_split(x, 3, 2)[1]), "delete": (lambda t: A.delete(t, slice(0, 3, 2), 2), lambda x: np.delete(x, slice(0, 3, 2), 2)), "pad": (lambda t: A.pad(t, 1, 9), lambda x: np.pad(x, 1, constant_values=9)),
    "getitem": (lambda t: t[:, ::-1, None, 1:3], lambda x: x[:, ::-1, None, 1:3]), "getitem_int": (lambda t: t[-1, ..., 0], lambda x: x[-1, ..., 0]), "getitem_list": (lambda t: t[:, [2, 0, 2]], lambda x: x[:, [2, 0, 2]]), "take": (lambda t: A.take(t, [-1, 5], 2, "wrap"), lambda x: np.take(x, [-1, 5], 2, mode="wrap")),
    "take_clip": (lambda t: A.take(t, [-9, 9], 1, "clip"), lambda x: np.take(x, [-9, 9], 1, mode="clip")), "compress": (lambda t: A.compress([True, False, True], t, 1), lambda x: np.compress([True, False, True], x, 1)), "broadcast": (lambda t: A.broadcast_to(t[:1, :, :1], (5, 3, 4)), lambda x: np.broadcast_to(x[:1, :, :1], (5, 3, 4))),
    "sum": (lambda t: reduce.sum_(t, (0, 2)), lambda x: x.sum((0, 2))), "sum_keep": (lambda t: reduce.sum_(t, 1, True), lambda x: x.sum(1, keepdims=True)), "prod": (lambda t: reduce.prod(t, 0), lambda x: x.prod(0)), "mean": (lambda t: reduce.mean(t), lambda x: x.mean()), "var": (lambda t: reduce.var(t, 2, 1), lambda x: x.var(2, ddof=1)),
    "min": (lambda t: reduce.min_(t, 1), lambda x: x.min(1)), "max": (lambda t: reduce.max_(t, -1), lambda x: x.max(-1)), "argmin": (lambda t: reduce.argmin(t, 2), lambda x: x.argmin(2)), "argmax": (lambda t: reduce.argmax(t), lambda x: x.argmax()), "any": (lambda t: reduce.any_(t, 0), lambda x: x.any(0)),
    "all": (lambda t: reduce.all_(t, 0), lambda x: x.all(0)), "ptp": (lambda t: reduce.ptp(t, 0), lambda x: np.ptp(x, 0)), "count_nonzero": (lambda t: reduce.count_nonzero(t, 1), lambda x: np.count_nonzero(x, 1)), "cumsum": (lambda t: reduce.cumsum(t, 1), lambda x: x.cumsum(1)), "cumsum_flat": (lambda t: reduce.cumsum(t), lambda x: x.cumsum()),
    "cumprod": (lambda t: reduce.cumprod(t, 2), lambda x: x.cumprod(2)), "diff": (lambda t: reduce.diff(t, 2, 2), lambda x: np.diff(x, 2, 2)), "sort": (lambda t: reduce.sort(t, 1), lambda x: np.sort(x, 1)), "argsort": (lambda t: reduce.argsort(t, 2), lambda x: np.argsort(x, 2, kind="stable")), "sort_flat": (lambda t: reduce.sort(t, None), lambda x: np.sort(x, None)),
    "median": (lambda t: reduce.median(t, 1), lambda x: np.median(x, 1)), "matmul": (lambda t: products.matmul(t, A.swapaxes(t, 1, 2)), lambda x: x @ x.swapaxes(1, 2)), "tensordot": (lambda t: products.tensordot(t, t, ([0, 2], [0, 2])), lambda x: np.tensordot(x, x, ([0, 2], [0, 2]))),
    "kron": (lambda t: products.kron(t[0], t[1, :2]), lambda x: np.kron(x[0], x[1, :2])), "cross": (lambda t: products.cross(t[0, :, :3], t[1, :, :3]), lambda x: np.cross(x[0, :, :3], x[1, :, :3])), "outer": (lambda t: products.outer(t[0, 0], t[1, 1]), lambda x: np.outer(x[0, 0], x[1, 1])), "inner": (lambda t: products.inner(t, t), lambda x: np.inner(x, x)),
    "fftshift": (lambda t: lanes.fftshift(t), lambda x: np.fft.fftshift(x)), "ifftshift": (lambda t: lanes.ifftshift(t, 1), lambda x: np.fft.ifftshift(x, 1)), "nan_free_quantile": (lambda t: reduce.quantile(t, 0.3, 2), lambda x: np.quantile(x, 0.3, 2)), "trace": (lambda t: products.trace(t[0]), lambda x: np.trace(x[0])),
}


@pytest.mark.parametrize("name", CASES)
def test_operator(t, name):
    mine, theirs = CASES[name]
    same(mine(t), theirs(T))


@pytest.mark.parametrize("method", ["inverted_cdf", "averaged_inverted_cdf", "closest_observation", "interpolated_inverted_cdf", "hazen", "weibull", "linear", "median_unbiased", "normal_unbiased", "lower", "higher", "midpoint", "nearest"])
def test_quantile_methods(v, method):
    for q in (0.0, 0.25, 0.4, 0.5, 0.9, 1.0):
        same(reduce.quantile(v, q, method=method), np.quantile(V, q, method=method))


def test_nan_rules(spark):
    x = np.array([[1.0, np.nan, 3.0], [4.0, 5.0, 6.0]])
    a = A.array(spark, x)
    for mine, theirs in ((reduce.min_, np.min), (reduce.max_, np.max), (reduce.sum_, np.sum), (reduce.median, np.median), (reduce.nansum, np.nansum), (reduce.nanmin, np.nanmin), (reduce.nanmax, np.nanmax), (reduce.nanmean, np.nanmean), (reduce.nanvar, np.nanvar), (reduce.nanmedian, np.nanmedian), (reduce.nanprod, np.nanprod), (reduce.argmin, np.argmin), (reduce.argmax, np.argmax)):
        same(mine(a, 1), theirs(x, 1))
    same(reduce.nancumsum(a, 1), np.nancumsum(x, 1))
    same(reduce.sort(a, 1), np.sort(x, 1))
    with pytest.raises(Exception, match="All-NaN"):
        reduce.nanargmin(A.array(spark, [np.nan, np.nan])).item()


def test_creation(spark):
    same(A.arange(spark, 2, 9, 3), np.arange(2, 9, 3))
    same(A.linspace(spark, 0, 1, 5, endpoint=False), np.linspace(0, 1, 5, endpoint=False))
    same(A.geomspace(spark, 1, 1000, 4), np.geomspace(1, 1000, 4))
    same(A.eye(spark, 3, 4, -1), np.eye(3, 4, -1))
    same(A.diag(A.array(spark, [1.0, 2.0]), -1), np.diag([1.0, 2.0], -1))
    for mine, theirs in zip(A.meshgrid(A.arange(spark, 2), A.arange(spark, 3)), np.meshgrid(range(2), range(3))):
        same(mine, theirs)
    assert A.zeros(spark, (0, 3)).cells.count() == 0
    for name in ("bartlett", "hanning", "hamming", "blackman"):
        same(getattr(lanes, name)(spark, 9), getattr(np, name)(9))
    same(lanes.kaiser(spark, 9, 5.0), np.kaiser(9, 5.0))


def test_searching_and_sets(spark, v):
    w = np.array([1.0, 7.0, 2.5, -2.0])
    a = A.array(spark, w)
    srt = np.sort(V)
    for side in ("left", "right"):
        same(reduce.searchsorted(A.array(spark, srt), a, side), np.searchsorted(srt, w, side))
    same(reduce.lexsort([v, A.array(spark, [1, 0, 1, 0, 1, 0, 1])]), np.lexsort([V, [1, 0, 1, 0, 1, 0, 1]]))
    for mine, theirs in ((sets.intersect1d, np.intersect1d), (sets.union1d, np.union1d), (sets.setdiff1d, np.setdiff1d), (sets.setxor1d, np.setxor1d)):
        assert [r.v for r in mine(v, a).orderBy("i0").collect()] == theirs(V, w).tolist()
    values, index, inverse, counts = np.unique(V, True, True, True)
    rows = sets.unique_all(v).orderBy("i0").collect()
    assert [(r.v, r["index"], r["count"]) for r in rows] == list(zip(values, index, counts))
    same(sets.unique_inverse(v), inverse)
    same(sets.isin(v, a), np.isin(V, w))
    same(sets.trim_zeros(A.array(spark, [0.0, 0.0, 1.0, 0.0, 2.0, 0.0])), [1, 0, 2])
    same(reduce.bincount(A.array(spark, [1, 1, 4])), [0, 2, 0, 0, 1])
    same(reduce.digitize(v, [0, 1, 2]), np.digitize(V, [0, 1, 2]))
    same(reduce.histogram(v, 4, -2, 5), np.histogram(V, 4, (-2, 5))[0])
    same(reduce.ediff1d(v, [9.0], [8.0]), np.ediff1d(V, [9.0], [8.0]))
    same(reduce.unwrap(A.array(spark, [0.0, 3.0, 6.5, 9.9, 1.0])), np.unwrap([0.0, 3.0, 6.5, 9.9, 1.0]))
    same(reduce.reduceat(v, [0, 3, 5, 1]), np.add.reduceat(V, [0, 3, 5, 1]))
    assert sets.allclose(v, v) and not sets.array_equal(v, a) and sets.array_equiv(A.array(spark, [1, 1]), A.array(spark, [1]))


def test_scatter(spark, t):
    flat = T.copy()
    np.put(flat, [1, 3, 1, -1], [10, 20, 30])
    same(A.put(t, [1, 3, 1, -1], [10, 20, 30]), flat)
    order = np.argsort(T, 2, kind="stable")
    same(A.take_along_axis(t, A.array(spark, order), 2), np.take_along_axis(T, order, 2))
    moved = T.copy()
    np.put_along_axis(moved, order[:, :, :1], -99, 2)
    same(A.put_along_axis(t, A.array(spark, order[:, :, :1]), A.full(spark, (2, 3, 1), -99), 2), moved)
    x = np.zeros(4)
    np.add.at(x, [1, 1, 3], [1.0, 2.0, 5.0])
    same(reduce.at(A.zeros(spark, (4,)), A.array(spark, [1, 1, 3]), A.array(spark, [1.0, 2.0, 5.0])), x)
    same(A.extract(t.map(lambda c: c > 0), t), T[T > 0])
    with pytest.raises(Exception, match="out of bounds"):
        A.take(t, [9], 0).tolist()
    with pytest.raises(A.AxisError):
        t.axis(3)


def test_long_scan_uses_blocks(spark):
    n = reduce.BLOCK * 2 + 17
    total = reduce.cumsum(A.arange(spark, n)).cells.where(F.col("i0").isin(0, reduce.BLOCK, n - 1)).orderBy("i0").collect()
    assert [r.v for r in total] == [k * (k + 1) // 2 for k in (0, reduce.BLOCK, n - 1)]


def test_linalg(spark):
    x = RNG.normal(size=(2, 3, 3))
    spd = x @ x.swapaxes(1, 2) + np.eye(3)
    a, s, b = A.array(spark, x), A.array(spark, spd), RNG.normal(size=(2, 3))
    same(linalg.det(a), np.linalg.det(x))
    same(linalg.inv(a), np.linalg.inv(x), 1e-7)
    same(linalg.solve(a, A.array(spark, b)), np.linalg.solve(x, b[..., None])[..., 0], 1e-7)
    same(linalg.cholesky(s), np.linalg.cholesky(spd))
    same(linalg.eigvalsh(s), np.linalg.eigvalsh(spd))
    same(linalg.svdvals(a), np.linalg.svd(x, compute_uv=False))
    same(linalg.pinv(a), np.linalg.pinv(x), 1e-7)
    q, r = linalg.qr(a)
    same(products.matmul(q, r), x)
    u, w, vt = linalg.svd(a, full_matrices=False)
    same(products.matmul(u.zip(A.expand_dims(w, 1), lambda p, q: p * q), vt), x)
    same(linalg.matrix_power(A.array(spark, x[0]), 5), np.linalg.matrix_power(x[0], 5), 1e-7)
    same(linalg.multi_dot([A.array(spark, x[0]), A.array(spark, x[1]), A.array(spark, b[0])[:, None]]), np.linalg.multi_dot([x[0], x[1], b[0][:, None]]))
    same(linalg.matrix_rank(a), np.linalg.matrix_rank(x))
    same(linalg.cond(a), np.linalg.cond(x), 1e-6)
    for order in ("fro", "nuc", 1, -1, 2, -2, np.inf, -np.inf):
        same(linalg.matrix_norm(A.array(spark, x[0]), order), np.linalg.norm(x[0], order))
    for order in (0, 1, 2, 3, np.inf, -np.inf):
        same(linalg.vector_norm(A.array(spark, b), 1, order), np.linalg.norm(b, order, 1))
    sign, log = linalg.slogdet(a)
    same(log, np.linalg.slogdet(x)[1])
    rows = spark.createDataFrame([([float(c) for c in r], float(r.sum())) for r in RNG.normal(size=(50, 3))], "v array<double>, y double")
    np.testing.assert_allclose(linalg.lstsq_tall(rows, "v", "y"), [1, 1, 1])
    full = np.array([r.v for r in rows.collect()])
    np.testing.assert_allclose(linalg.svd_tall(rows, "v")[0], np.linalg.svd(full, compute_uv=False))


def complexes(a):
    out = np.zeros(a.shape, complex)
    for r in a.cells.collect():
        out[tuple(r[n] for n in a.axes)] = complex(r.v["re"], r.v["im"])
    return out


def test_fft(spark, m):
    np.testing.assert_allclose(complexes(lanes.fft(m, 8, 0, "ortho")), np.fft.fft(M, 8, 0, "ortho"), atol=1e-12)
    np.testing.assert_allclose(complexes(lanes.rfft2(m)), np.fft.rfft2(M), atol=1e-12)
    same(lanes.irfft2(lanes.rfft2(m), M.shape), M)
    np.testing.assert_allclose(complexes(lanes.ifftn(lanes.fftn(m))), M, atol=1e-12)
    same(lanes.hfft(lanes.ihfft(m, axis=1), 6, 1), M)
    c, x = RNG.normal(size=6), RNG.normal(size=6)
    dense = np.array([[c[(i - j) % 6] for j in range(6)] for i in range(6)])
    same(products.Circulant(A.array(spark, c)).apply(A.array(spark, x)), dense @ x)
    found = products.detect(A.array(spark, dense))
    assert isinstance(found, products.Circulant)
    same(found.to_dense(), dense)
    same(products.compose(found, found).to_dense(), dense @ dense)


def test_structured(spark):
    d, x = np.array([1.0, 2.0, 3.0]), np.array([4.0, 5.0, 6.0])
    toeplitz = np.array([[1.0, 2, 3], [4, 1, 2], [5, 4, 1]])
    assert isinstance(products.detect(A.array(spark, np.diag(d))), products.Diagonal)
    found = products.detect(A.array(spark, toeplitz))
    assert isinstance(found, products.Toeplitz)
    same(found.apply(A.array(spark, x)), toeplitz @ x)
    same(found.to_dense(), toeplitz)
    low = products.LowRank(A.array(spark, d[:, None]), A.array(spark, x[:, None]))
    same(products.compose(low, low).to_dense(), np.outer(d, x) @ np.outer(d, x))
    both = products.compose(products.Diagonal(A.array(spark, d)), found)
    same(both.apply(A.array(spark, x)), np.diag(d) @ toeplitz @ x)
    same(products.matmul(A.array(spark, np.diag(d)), A.array(spark, toeplitz), sparse=True), np.diag(d) @ toeplitz)


def test_masked(spark):
    x = np.ma.masked_greater(np.array([[1.0, 9.0, 3.0], [8.0, 9.0, 7.0]]), 6.0)
    a = masked.masked_greater(A.array(spark, x.data), 6.0)
    assert masked.sum_(a, 1).tolist() == [4.0, None] and masked.count(a, 1).tolist() == [2, 0] and masked.mean(a).item() == 2.0
    assert masked.filled(a, 0.0).tolist() == x.filled(0.0).tolist() and masked.is_masked(a)
    assert masked.cumsum(a, 1).tolist() == x.cumsum(1).tolist()
    assert masked.log(A.array(spark, [-1.0, 1.0])).tolist() == [None, 0.0]
    assert masked.divide(A.array(spark, [1.0, 1.0]), A.array(spark, [0.0, 2.0])).tolist() == [None, 0.5]
    assert masked.compressed(a).count() == 2 and masked.allequal(a, a.map(lambda v: F.coalesce(v, F.lit(1.0))))


def test_random(spark):
    rng = random.default_rng(spark, 7)
    n = random.BLOCK + 100
    got = [r.v for r in rng.random(n).cells.orderBy("i0").collect()]
    assert got == np.random.default_rng(7).random(n).tolist()
    for name, args in (("normal", (0, 1)), ("gamma", (2.0,)), ("poisson", (3.0,)), ("integers", (0, 10)), ("vonmises", (0.0, 1.0)), ("geometric", (0.5,))):
        a, b = (getattr(random.default_rng(spark, 3), name)(*args, size=50) for _ in range(2))
        assert a.tolist() == b.tolist()
    rows = rng.dirichlet([1.0, 2.0, 3.0], size=5)
    same(reduce.sum_(rows, 1), np.ones(5))
    assert sorted(rng.permutation(20).tolist()) == list(range(20)) and len(set(rng.choice(30, 10, replace=False).tolist())) == 10
    assert sorted(rng.permuted(A.array(spark, T), 2).tolist()[0][0]) == sorted(T[0, 0].tolist())


def test_matrix(spark):
    from tessera.operators.matrix import asmatrix

    x = RNG.normal(size=(3, 3))
    m, n = asmatrix(A.array(spark, x)), np.matrix(x)
    for mine, theirs in ((m * m, n * n), (m.I, n.I), (m**3, n**3), (m.T, n.T), (m.sum(1), n.sum(1)), (m + m, n + n), (m * 2, n * 2)):
        np.testing.assert_allclose(mine.tolist(), theirs.tolist(), rtol=1e-8)
    assert asmatrix(A.array(spark, [1.0, 2.0])).shape == (1, 2)


def test_masked_shapes(spark):
    a = masked.masked_greater(A.array(spark, [1.0, 9.0]), 5.0)
    assert masked.append(a, a).tolist() == [1.0, None, 1.0, None] and masked.ones_like(a).tolist() == [1.0, None]
    assert masked.reshape(a, (2, 1)).tolist() == [[1.0], [None]] and masked.minimum_fill_value(a) == np.inf and masked.common_fill_value(a, a) == 1e20
    assert masked.make_mask_none(spark, (2,)).tolist() == [False, False] and masked.getmask(a).tolist() == [False, True]


def test_order_statistics_over_ranges(spark):
    """Whole-array quantiles, positions by any type and both directions, with a value that holds a third of the cells."""
    rng = np.random.default_rng(11)
    x = np.concatenate([np.full(400, 0.25), rng.normal(size=800)])
    rng.shuffle(x)
    a = A.array(spark, x)
    for method in ("linear", "lower", "higher", "nearest", "midpoint", "hazen", "inverted_cdf", "closest_observation"):
        for q in (0, 0.003, 0.37, 0.5, 0.999, 1):
            assert reduce.quantile(a, q, method=method).item() == pytest.approx(np.quantile(x, q, method=method))
    assert reduce.quantile(a, 0.5, keepdims=True).shape == (1,)
    assert np.isnan(reduce.median(A.array(spark, [1.0, float("nan"), 2.0])).item())
    assert reduce.nanmedian(A.array(spark, [1.0, float("nan"), 2.0])).item() == 1.5
    assert np.isnan(reduce.nanmedian(A.array(spark, [float("nan")])).item())
    down = reduce.sort(a, descending=True)
    same(down, np.sort(x)[::-1])
    same(reduce.argsort(a, descending=True), np.argsort(-x, kind="stable"))
    z = np.round(x[:200], 1) + 1j * rng.integers(0, 3, 200)
    cells = spark.createDataFrame([(i, (float(v.real), float(v.imag))) for i, v in enumerate(z)], "i0 bigint, v struct<re: double, im: double>")
    got = reduce.sort_complex(A.NdArray(cells, (200,))).cells.orderBy("i0").collect()
    assert [complex(r.v.re, r.v.im) for r in got] == np.sort_complex(z).tolist()


@pytest.mark.parametrize("kind", ["string", "date", "boolean", "decimal(20,3)", "timestamp"])
def test_positions_by_other_types(spark, kind):
    number = (F.col("id") * 7919 % 1000).cast("int")
    made = {"string": F.concat(F.lit("k"), number.cast("string")), "date": F.date_add(F.lit("2020-01-01").cast("date"), number), "boolean": number % 3 == 0,
            "decimal(20,3)": number.cast("decimal(20,3)") / 8, "timestamp": F.timestamp_seconds(number * 3600)}[kind]
    frame = spark.range(1500).select("id", F.when(F.col("id") % 50 != 0, made).alias("k")).cache()
    assert A.range_cuts(frame.select("k"), 4)
    got = [r.id for r in A.dense_rank_positions(frame, [F.col("k"), F.col("id")], 4).orderBy("pos").collect()]
    assert got == [r.id for r in frame.orderBy(F.asc_nulls_last("k"), "id").collect()]
    placed = A.dense_rank_positions(frame, [F.col("k"), F.col("id")], 4, descending=True)
    assert [r.id for r in placed.orderBy("pos").collect()] == [r.id for r in frame.orderBy(F.desc_nulls_last("k"), "id").collect()]
    assert placed.agg(F.max("pos")).first()[0] == 1499


def _broadcast_rows(frame):
    """Rows of the largest broadcast that the driver built for a frame."""
    frame.collect()

    def walk(plan):
        name = plan.nodeName()
        if name == "BroadcastExchange":
            yield plan.metrics().apply("numOutputRows").value()
        inner = plan.executedPlan() if name == "AdaptiveSparkPlan" else plan.plan() if name.endswith("QueryStage") else plan.child() if name == "ReusedExchange" else None
        for below in [inner] if inner else [plan.children().apply(k) for k in range(plan.children().length())]:
            yield from walk(below)

    found = list(walk(frame._jdf.queryExecution().executedPlan()))
    assert found  # each of these plans has one
    return max(found)


@pytest.mark.parametrize("n, k", [(2000, 100), (40000, 3)])
def test_outer_broadcasts_no_repeated_cells(spark, n, k):
    both = A.grid(spark, (n, k), F.pmod(F.col("id") * 7, F.lit(1009)).cast("double"))
    x = np.arange(n * k).reshape(n, k) * 7 % 1009
    out = products.outer(reduce.max_(both, 1), reduce.min_(both, 0))
    assert out.shape == (n, k)
    total = out.cells.agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * (F.col("i0") + 2 * F.col("i1"))).alias("w"))
    assert _broadcast_rows(total) <= A.FEW
    want = np.outer(x.max(1), x.min(0)).astype(float)
    i, j = np.indices(want.shape)
    got = total.first()
    assert (got.n, got.s) == (n * k, want.sum()) and got.w == pytest.approx((want * (i + 2 * j)).sum())


def test_repeated_cells_meet_once(spark, monkeypatch):
    x, y, z = RNG.normal(size=(3, 1)), RNG.normal(size=(2, 1, 4)), RNG.normal(size=(4, 2))
    for few in (A.FEW, 3):  # 3: merged joins
        monkeypatch.setattr(A, "FEW", few)
        a, b = A.array(spark, x), A.array(spark, y)
        same(a.zip(b, lambda p, q: p - q), x - y)
        same(A.broadcast_to(a, (2, 3, 4)).zip(A.broadcast_to(b, (2, 3, 4)), lambda p, q: p - q), x - y)
        same(A.broadcast_to(a, (2, 3, 4)).zip(A.broadcast_to(a, (2, 3, 4)), lambda p, q: p + q), np.broadcast_to(2 * x, (2, 3, 4)))
        same(A.array(spark, 2.0).zip(b, lambda p, q: p * q), 2 * y)
        same(products.matmul(b, A.array(spark, z)), y @ z)


def test_average_broadcasts_no_repeated_weights(spark):
    a = A.grid(spark, (2000, 100), F.pmod(F.col("id") * 7, F.lit(1009)).cast("double"))
    out = reduce.average(a, A.broadcast_to(A.arange(spark, 1, 101), a.shape), 1)
    assert _broadcast_rows(out.cells) <= A.FEW
    same(out, np.average(np.arange(200000).reshape(2000, 100) * 7 % 1009, axis=1, weights=np.arange(1, 101)))


def test_lowrank_broadcasts_no_repeated_cells(spark):
    both = A.grid(spark, (2000, 100), F.pmod(F.col("id") * 7, F.lit(1009)).cast("double") / 1000)
    x = np.arange(200000).reshape(2000, 100) * 7 % 1009 / 1000
    rows, columns = reduce.mean(both, 1), reduce.mean(both, 0)
    whole = products.outer(rows, columns)
    found = products.detect_lowrank(whole)
    assert found.u.shape == (2000, 1) and found.v.shape == (100, 1)
    assert _broadcast_rows(found.apply(columns).cells) <= A.FEW
    assert products.certify(found, whole, columns) < 1e-9
    same(found.apply(columns), np.outer(x.mean(1), x.mean(0)) @ x.mean(0))
    assert products.detect_lowrank(both, most=8) is None
