"""Queries of the operators whose results SQL gives by an identity: factors that multiply to the matrix, transforms that
come back, defining equations that hold. All over the whole price vector or matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import complexes as C
from tessera.functions import polynomials as P
from tessera.functions import types as T
from tessera.functions import ufuncs as U
from tessera.operators import array as A
from tessera.operators import lanes, linalg, masked, products, random, reduce, sets
from tessera.plans.arrays import _holed, on_matrix, on_session, on_vector, vector
from tessera.plans.catalog import register

_M3 = "SELECT i0, i1 // 10 AS i1, i1 % 10 AS i2"
_ONE = f"{_M3}, CASE WHEN i1 // 10 = i1 % 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM m"


def _plus(a, digits=8):
    """Rounded, without negative zeros. Prices have two decimals: rounding to eight meets no ties when they are divided by 1e5."""
    return a.map(lambda v: F.round(v, digits) + F.lit(0.0))


def _real(a):
    return a.map(lambda v: v["re"])


def _squares(m):
    """Every row of 100 prices as a well-conditioned 10 by 10 matrix."""
    small = A.reshape(m.map(lambda v: v / 1e5), (-1, 10, 10))
    return A.NdArray(small.cells.withColumn("v", F.col("v") + F.when(F.col("i1") == F.col("i2"), 60.0).otherwise(0.0)), small.shape)


def _plain(m):
    return A.reshape(m.map(lambda v: v / 1e5), (-1, 10, 10))


def _symmetric(m):
    b = _squares(m)
    return b.zip(A.matrix_transpose(b), lambda x, y: (x + y) / 2)


_B = f"{_M3}, round(v / 1e5 + CASE WHEN i1 // 10 = i1 % 10 THEN 60 ELSE 0 END, 8) + 0.0 AS v FROM m"
_S = "SELECT a.i0, a.i1 // 10 AS i1, a.i1 % 10 AS i2, round((a.v + b.v) / 2e5 + CASE WHEN a.i1 // 10 = a.i1 % 10 THEN 60 ELSE 0 END, 8) + 0.0 AS v FROM m a JOIN m b ON a.i0 = b.i0 AND b.i1 = a.i1 % 10 * 10 + a.i1 // 10"
_TRACE = "SELECT i0, round(sum(v / 1e5 + 60), 8) + 0.0 AS v FROM m WHERE i1 // 10 = i1 % 10 GROUP BY i0"

# --- linear algebra ------------------------------------------------------------
on_matrix("la_inv", lambda m: _plus(products.matmul(linalg.inv(_squares(m)), _squares(m))), _ONE)
on_matrix("la_solve", lambda m: _plus(products.matmul(_squares(m), linalg.solve(_squares(m), _plain(m)))), f"{_M3}, round(v / 1e5, 8) + 0.0 AS v FROM m")
on_matrix("la_cholesky", lambda m: _plus(products.matmul(linalg.cholesky(_symmetric(m)), linalg.cholesky(_symmetric(m), upper=True))), _S)


def _eigh(m):
    w, v = linalg.eigh(_symmetric(m))
    return _plus(products.matmul(v.zip(A.expand_dims(w, 1), lambda x, y: x * y), A.matrix_transpose(v)))


def _svd(m):
    u, s, vt = linalg.svd(_squares(m), full_matrices=False)
    return _plus(products.matmul(u.zip(A.expand_dims(s, 1), lambda x, y: x * y), vt))


def _eig(m):
    """The greatest defect of A v = w v for each matrix."""
    w, v = linalg.eig(_squares(m))
    re, im = products.matmul(_squares(m), v.map(lambda z: z["re"])), products.matmul(_squares(m), v.map(lambda z: z["im"]))
    scaled = v.zip(A.expand_dims(w, 1), C.multiply)
    off = re.zip(_real(scaled), lambda x, y: F.abs(x - y)).zip(im.zip(scaled.map(lambda z: z["im"]), lambda x, y: F.abs(x - y)), F.greatest)
    return reduce.max_(off, (1, 2)).map(lambda v: v < 1e-8)


on_matrix("la_eigh", _eigh, _S)
on_matrix("la_eig", _eig, "SELECT DISTINCT i0, true AS v FROM m")
on_matrix("la_eigvals", lambda m: _plus(reduce.sum_(_real(linalg.eigvals(_squares(m))), 1), 8), _TRACE)
on_matrix("la_eigvalsh", lambda m: _plus(reduce.sum_(linalg.eigvalsh(_symmetric(m)), 1), 8), _TRACE)
on_matrix("la_qr", lambda m: _plus(products.matmul(*linalg.qr(_squares(m)))), _B)
on_matrix("la_svd", _svd, _B)
on_matrix("la_svdvals", lambda m: reduce.sum_(linalg.svdvals(_plain(m)).map(lambda v: v * v), 1), "SELECT i0, round(sum(v / 1e5 * (v / 1e5)), 5) AS v FROM m GROUP BY i0", 5)
on_matrix("la_pinv", lambda m: _plus(products.matmul(_squares(m), linalg.pinv(_squares(m)))), _ONE)
on_matrix("la_matrix_rank", lambda m: linalg.matrix_rank(_squares(m)), "SELECT i0, 10.0::DOUBLE AS v FROM m GROUP BY i0", 1)
on_matrix("la_cond", lambda m: _plus(linalg.cond(_squares(m)).zip(reduce.min_(linalg.svdvals(_squares(m)), 1), lambda c, s: c * s).zip(reduce.max_(linalg.svdvals(_squares(m)), 1), lambda x, y: x - y)), "SELECT DISTINCT i0, 0.0::DOUBLE AS v FROM m")
on_matrix("la_lstsq", lambda m: _plus(products.matmul(_squares(m), linalg.lstsq(_squares(m), _plain(m)))), f"{_M3}, round(v / 1e5, 8) + 0.0 AS v FROM m")


def _slogdet(m):
    sign, logs = linalg.slogdet(_squares(m))
    return _plus(sign.zip(logs, lambda s, x: s * F.exp(x)).zip(linalg.det(_squares(m)), lambda x, y: x / y))


on_matrix("la_slogdet", _slogdet, "SELECT DISTINCT i0, 1.0::DOUBLE AS v FROM m")
on_matrix("la_vector_norm", lambda m: linalg.vector_norm(m, 1), "SELECT i0, round(sqrt(sum(v * v)), 2) AS v FROM m GROUP BY i0", 2)
_GRAM = "g AS (SELECT a.i1 AS i0, b.i1 AS i1, sum(a.v / 1e6 * (b.v / 1e6)) AS v FROM m a JOIN m b ON a.i0 = b.i0 GROUP BY 1, 2)"


def _gramian(m):
    small = m.map(lambda v: v / 1e6)
    return products.matmul(small.T, small)


def _tensor(m):
    """The Gramian plus the identity as a (10, 10, 10, 10) tensor."""
    g = _gramian(m)
    return A.reshape(A.NdArray(g.cells.withColumn("v", F.col("v") + F.when(F.col("i0") == F.col("i1"), 1.0).otherwise(0.0)), g.shape), (10, 10, 10, 10))


_I4 = "SELECT a.range // 10 AS i0, a.range % 10 AS i1, b.range // 10 AS i2, b.range % 10 AS i3, CASE WHEN a.range = b.range THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM range(100) a, range(100) b"
on_matrix("la_matrix_power", lambda m: _plus(products.matrix_power(_gramian(m), 2), 3), f", {_GRAM} SELECT a.i0, b.i1, round(sum(a.v * b.v), 3) + 0.0 AS v FROM g a JOIN g b ON a.i1 = b.i0 GROUP BY 1, 2".lstrip())
on_matrix("la_multi_dot", lambda m: _plus(products.multi_dot([m.map(lambda v: v / 1e6), m.T.map(lambda v: v / 1e6), A.expand_dims(reduce.sum_(m, 1).map(lambda v: v / 1e8), 1)]), 4),
          f", r AS (SELECT i0, sum(v) / 1e8 AS s FROM m GROUP BY i0), y AS (SELECT i1, sum(v / 1e6 * s) AS y FROM m JOIN r USING (i0) GROUP BY i1) SELECT i0, 0::BIGINT AS i1, round(sum(v / 1e6 * y), 4) + 0.0 AS v FROM m JOIN y USING (i1) GROUP BY i0")
on_matrix("la_tensorinv", lambda m: _plus(products.tensordot(linalg.tensorinv(_tensor(m)), _tensor(m), 2)), _I4)
on_matrix("la_tensorsolve", lambda m: _plus(products.tensordot(_tensor(m), linalg.tensorsolve(_tensor(m), A.reshape(reduce.mean(m, 0).map(lambda v: v / 1e5), (10, 10))), 2)), "SELECT i1 // 10 AS i0, i1 % 10 AS i1, round(avg(v) / 1e5, 8) + 0.0 AS v FROM m GROUP BY m.i1")
on_matrix("la_dot", lambda m: products.dot(m, reduce.mean(m, 0)).map(lambda v: v / 1e9), ", c AS (SELECT i1, avg(v) AS c FROM m GROUP BY i1) SELECT i0, round(sum(v * c) / 1e9, 6) AS v FROM m JOIN c USING (i1) GROUP BY i0", 6)
on_vector("la_vdot", lambda p: products.vdot(p, p).map(lambda v: v / 1e12), "SELECT round(sum(v * v) / 1e12, 6) AS v FROM p", 6)
on_matrix("la_vecmat", lambda m: products.vecmat(reduce.mean(m, 1), m).map(lambda v: v / 1e9), ", c AS (SELECT i0, avg(v) AS c FROM m GROUP BY i0) SELECT i1 AS i0, round(sum(v * c) / 1e9, 6) AS v FROM m JOIN c USING (i0) GROUP BY i1", 6)
on_matrix("la_qr_orthonormal", lambda m: _plus(products.matmul(products.qr_orthonormal(m.map(lambda v: v / 1e6)[:, ::5]).T, products.qr_orthonormal(m.map(lambda v: v / 1e6)[:, ::5]))), "SELECT a.range AS i0, b.range AS i1, CASE WHEN a.range = b.range THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM range(20) a, range(20) b")


def _found_lowrank(m):
    """The outer product of the row and column means, found to be of rank one and applied to the column means."""
    rows, columns = [A.kept(reduce.mean(m, k).map(lambda v: v / 1e6), "means") for k in (1, 0)]
    whole = products.outer(rows, columns)
    found = products.detect_lowrank(whole)
    products.certify(found, whole, columns)
    return found.apply(columns)


on_matrix("la_detect_lowrank", _found_lowrank, ", r AS (SELECT i0, avg(v) / 1e6 AS r FROM m GROUP BY i0), c AS (SELECT sum(x * x) AS s FROM (SELECT avg(v) / 1e6 AS x FROM m GROUP BY i1)) SELECT i0, round(r * s, 6) AS v FROM r, c", 6)

# --- FFT -----------------------------------------------------------------------
_ANGLE = "2 * pi() * (k.range * i1 % 100) / 100"


def _parts(a, digits):
    return a.cells.select(*a.axes, (F.round("v.re", digits) + 0.0).alias("re"), (F.round("v.im", digits) + 0.0).alias("im"))


def _scaled(m):
    return m.map(lambda v: v / 1e6)


def _cube(m):
    return A.reshape(_scaled(m), (-1, 10, 10))


for _name, _bins in (("fft", 100), ("rfft", 51)):
    on_matrix(f"nd_{_name}", lambda m, n=_name: _parts(getattr(lanes, n)(_scaled(m)), 9), f"SELECT i0, k.range AS i1, round(sum(v / 1e6 * cos({_ANGLE})), 9) + 0.0 AS re, round(-sum(v / 1e6 * sin({_ANGLE})), 9) + 0.0 AS im FROM m, range({_bins}) k GROUP BY i0, k.range")
_SAME = "SELECT i0, i1, round(v / 1e6, 9) + 0.0 AS v FROM m"
_SAME3 = f"{_M3}, round(v / 1e6, 9) + 0.0 AS v FROM m"
on_matrix("nd_ifft", lambda m: _plus(_real(lanes.ifft(lanes.fft(_scaled(m)))), 9), _SAME)
on_matrix("nd_irfft", lambda m: _plus(lanes.irfft(lanes.rfft(_scaled(m))), 9), _SAME)
on_matrix("nd_ihfft", lambda m: _parts(lanes.ihfft(_scaled(m)), 9), f"SELECT i0, k.range AS i1, round(sum(v / 1e6 * cos({_ANGLE})) / 100, 9) + 0.0 AS re, round(sum(v / 1e6 * sin({_ANGLE})) / 100, 9) + 0.0 AS im FROM m, range(51) k GROUP BY i0, k.range")
on_matrix("nd_hfft", lambda m: _plus(lanes.hfft(lanes.ihfft(_scaled(m))), 9), _SAME)
for _n, _to, _back in (("fftn", lanes.fftn, lanes.ifftn), ("fft2", lanes.fft2, lanes.ifft2)):
    on_matrix(f"nd_{_n}_i{_n}", lambda m, f=_to, g=_back: _plus(_real(g(f(_cube(m)))), 9), _SAME3)
for _n, _to, _back in (("rfftn", lanes.rfftn, lanes.irfftn), ("rfft2", lanes.rfft2, lanes.irfft2)):
    on_matrix(f"nd_{_n}_i{_n}", lambda m, f=_to, g=_back: _plus(g(f(_cube(m))), 9), _SAME3)
on_matrix("nd_ifftshift", lambda m: lanes.ifftshift(A.reshape(m, (-1, 25)), 1), "SELECT (i0 * 100 + i1) // 25 AS i0, ((i0 * 100 + i1) % 25 + 13) % 25 AS i1, v FROM m")
on_session("nd_kaiser", lambda s: _plus(lanes.kaiser(s, 21, 0.0), 9), "SELECT range AS i0, 1.0::DOUBLE AS v FROM range(21)")

# --- shape ---------------------------------------------------------------------
on_matrix("nd_zeros_like", A.zeros_like, "SELECT i0, i1, 0.0::DOUBLE AS v FROM m")
on_matrix("nd_ones_like", A.ones_like, "SELECT i0, i1, 1.0::DOUBLE AS v FROM m")
on_matrix("nd_full_like", lambda m: A.full_like(m, 2.5), "SELECT i0, i1, 2.5::DOUBLE AS v FROM m", 1)
on_matrix("nd_empty_like", lambda m: A.empty_like(m).map(lambda v: v * 0), "SELECT i0, i1, 0.0::DOUBLE AS v FROM m")
on_matrix("nd_copy", lambda m: A.ascontiguousarray(A.copy(m)), "SELECT * FROM m")
on_matrix("nd_swapaxes", lambda m: A.swapaxes(_plain(m), 0, 2), "SELECT i1 % 10 AS i0, i1 // 10 AS i1, i0 AS i2, v / 1e5 AS v FROM m")
on_matrix("nd_rollaxis", lambda m: A.rollaxis(_plain(m), 2), "SELECT i1 % 10 AS i0, i0 AS i1, i1 // 10 AS i2, v / 1e5 AS v FROM m")
on_matrix("nd_permute_dims", lambda m: A.permute_dims(_plain(m), (1, 0, 2)), "SELECT i1 // 10 AS i0, i0 AS i1, i1 % 10 AS i2, v / 1e5 AS v FROM m")
on_matrix("nd_matrix_transpose", lambda m: A.matrix_transpose(_plain(m)), "SELECT i0, i1 % 10 AS i1, i1 // 10 AS i2, v / 1e5 AS v FROM m")
on_matrix("nd_flatten", A.flatten, "SELECT i0 * 100 + i1 AS i0, v FROM m")
on_matrix("nd_broadcast_arrays", lambda m: A.broadcast_arrays(reduce.max_(m, 0), m)[0], "SELECT i0, i1, max(v) OVER (PARTITION BY i1) AS v FROM m")
on_vector("nd_atleast_2d", A.atleast_2d, "SELECT 0::BIGINT AS i0, i0 AS i1, v FROM p")
on_vector("nd_atleast_3d", A.atleast_3d, "SELECT 0::BIGINT AS i0, i0 AS i1, 0::BIGINT AS i2, v FROM p")
on_vector("nd_atleast_1d", A.atleast_1d, "SELECT i0, v FROM p")
on_matrix("nd_vstack", lambda m: A.vstack([m, m]), "SELECT * FROM m UNION ALL SELECT i0 + n, i1, v FROM m, d")
on_matrix("nd_row_stack", lambda m: A.row_stack([m, m]), "SELECT * FROM m UNION ALL SELECT i0 + n, i1, v FROM m, d")
on_matrix("nd_fliplr", A.fliplr, "SELECT i0, 99 - i1 AS i1, v FROM m")
on_matrix("nd_flipud", A.flipud, "SELECT n - 1 - i0 AS i0, i1, v FROM m, d")
on_matrix("nd_diagflat", lambda m: A.diagflat(reduce.max_(m, 0)), ", c AS (SELECT i1, max(v) AS v FROM m GROUP BY i1) SELECT a.range AS i0, b.i1, CASE WHEN a.range = b.i1 THEN v ELSE 0 END AS v FROM range(100) a, c b")
for _n, _i in (("split", 1), ("hsplit", 1)):
    on_matrix(f"nd_{_n}", lambda m, f=getattr(A, _n), n=_n: A.concatenate((f(m, 4, 1) if n == "split" else f(m, 4))[::-1], 1), "SELECT i0, (3 - i1 // 25) * 25 + i1 % 25 AS i1, v FROM m")
on_matrix("nd_vsplit", lambda m: A.concatenate(A.vsplit(A.reshape(m, (-1, 25)), 4)[::-1], 0), ", q AS (SELECT (i0 * 100 + i1) // 25 AS r, i1 % 25 AS i1, v FROM m) SELECT (3 - r // n) * n + r % n AS i0, i1, v FROM q, d")
on_matrix("nd_dsplit", lambda m: A.concatenate(A.dsplit(_plain(m), 2)[::-1], 2), "SELECT i0, i1 // 10 AS i1, (i1 % 10 + 5) % 10 AS i2, v / 1e5 AS v FROM m")
on_vector("nd_append", lambda p: A.append(p, p), "SELECT i0, v FROM p UNION ALL SELECT i0 + (SELECT count(*) FROM p), v FROM p")
on_matrix("nd_unstack", lambda m: A.concatenate(A.unstack(m, 1)[::-1], 0), "SELECT (99 - i1) * n + i0 AS i0, v FROM m, d")
register("nd_diag_indices", "SELECT range AS i0, range AS i1 FROM range(50)")(lambda s, sf: A.diag_indices(s, 50) if not isinstance(A.diag_indices(s, 50), (list, tuple)) else A.diag_indices(s, 50)[0].cells.select("i0", F.col("v").alias("i1")))
on_matrix("nd_ravel_multi_index", lambda m: A.NdArray(m.cells.select(A.ravel_multi_index(["i0", "i1"], m.shape).alias("i0"), "v"), (m.size,)), "SELECT i0 * 100 + i1 AS i0, v FROM m")
on_matrix("nd_unravel_index", lambda m: A.NdArray(m.cells.select(*A.unravel_index(F.col("i0") * 100 + F.col("i1"), (m.size // 25, 25)), "v"), (m.size // 25, 25)), "SELECT (i0 * 100 + i1) // 25 AS i0, i1 % 25 AS i1, v FROM m")
on_matrix("nd_put_along_axis", lambda m: A.put_along_axis(m, A.expand_dims(reduce.argmax(m, 1), 1), A.expand_dims(reduce.min_(m, 1), 1), 1), "SELECT i0, i1, CASE WHEN row_number() OVER (PARTITION BY i0 ORDER BY v DESC, i1) = 1 THEN min(v) OVER (PARTITION BY i0) ELSE v END AS v FROM m")
on_matrix("nd_flatnonzero", lambda m: A.flatnonzero(m.map(lambda v: v > 4e5)), "SELECT i0 * 100 + i1 AS i0 FROM m WHERE v > 4e5")
on_matrix("nd_argwhere", lambda m: A.argwhere(m.map(lambda v: v > 4e5)), "SELECT i0, i1 FROM m WHERE v > 4e5")
on_session("nd_identity", lambda s: A.identity(s, 40), "SELECT a.range AS i0, b.range AS i1, CASE WHEN a.range = b.range THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM range(40) a, range(40) b")
on_session("nd_geomspace", lambda s: A.geomspace(s, 1, 1024, 11), "SELECT range AS i0, round(pow(2, range), 6) AS v FROM range(11)", 6)

# --- reductions and scans ------------------------------------------------------
_NAN = "CASE WHEN i1 % 7 = 0 THEN NULL ELSE v END"
on_matrix("nd_amin", lambda m: reduce.amin(m, 1), "SELECT i0, min(v) AS v FROM m GROUP BY i0")
on_matrix("nd_amax", lambda m: reduce.amax(m, 1), "SELECT i0, max(v) AS v FROM m GROUP BY i0")
on_matrix("nd_all", lambda m: reduce.all_(m.map(lambda v: v > 5000), 1), "SELECT i0, bool_and(v > 5000) AS v FROM m GROUP BY i0")
on_matrix("nd_any", lambda m: reduce.any_(m.map(lambda v: v > 495000), 1), "SELECT i0, bool_or(v > 495000) AS v FROM m GROUP BY i0")
on_matrix("nd_nancumsum", lambda m: reduce.nancumsum(_holed(m), 1), f"SELECT i0, i1, round(coalesce(sum({_NAN}) OVER (PARTITION BY i0 ORDER BY i1), 0), 2) AS v FROM m", 2)
on_matrix("nd_nancumprod", lambda m: reduce.nancumprod(_holed(m.map(lambda v: 1 + v / 1e8)), 1), "SELECT i0, i1, round(product(CASE WHEN i1 % 7 = 0 THEN 1 ELSE 1 + v / 1e8 END) OVER (PARTITION BY i0 ORDER BY i1), 10) AS v FROM m", 10)
on_matrix("nd_nanprod", lambda m: reduce.nanprod(_holed(m.map(lambda v: 1 + v / 1e8)), 1), "SELECT i0, round(product(CASE WHEN i1 % 7 = 0 THEN 1 ELSE 1 + v / 1e8 END), 10) AS v FROM m GROUP BY i0", 10)
on_matrix("nd_nanpercentile", lambda m: reduce.nanpercentile(_holed(m), 30, 1), f"SELECT i0, round(quantile_cont({_NAN}, 0.3), 3) AS v FROM m GROUP BY i0", 3)
on_matrix("nd_nanquantile", lambda m: reduce.nanquantile(_holed(m), 0.75, 1), f"SELECT i0, round(quantile_cont({_NAN}, 0.75), 3) AS v FROM m GROUP BY i0", 3)
on_matrix("nd_quantile", lambda m: reduce.quantile(m, 0.25, 1), "SELECT i0, round(quantile_cont(v, 0.25), 5) AS v FROM m GROUP BY i0", 5)
on_vector("nd_cumulative_sum", lambda p: reduce.cumulative_sum(p, include_initial=True), "SELECT 0::BIGINT AS i0, 0.0::DOUBLE AS v UNION ALL SELECT i0 + 1, round(sum(v) OVER (ORDER BY i0), 2) FROM p", 2)
on_matrix("nd_cumulative_prod", lambda m: reduce.cumulative_prod(m.map(lambda v: 1 + v / 1e8), 1), "SELECT i0, i1, round(product(1 + v / 1e8) OVER (PARTITION BY i0 ORDER BY i1), 10) AS v FROM m", 10)
on_vector("nd_minimum_accumulate", reduce.minimum_accumulate, "SELECT i0, min(v) OVER (ORDER BY i0) AS v FROM p")
on_matrix("nd_unwrap", lambda m: reduce.unwrap(m, period=5e5, axis=1).zip(m, lambda x, y: F.abs(F.round((x - y) / 5e5) - (x - y) / 5e5) < 1e-9), "SELECT i0, i1, true AS v FROM m")
on_vector("nd_sort_complex", lambda p: _real(reduce.sort_complex(p.map(lambda v: F.struct(v.alias("re"), (-v).alias("im"))))), "SELECT row_number() OVER (ORDER BY v, i0) - 1 AS i0, v FROM p")
register("nd_unique_values", "SELECT DISTINCT o_custkey AS v FROM orders")(lambda s, sf: sets.unique_values(vector(s, sf, "o_custkey")).select("v"))
register("nd_unique_counts", "SELECT o_custkey AS v, count(*) AS count FROM orders GROUP BY 1")(lambda s, sf: sets.unique_counts(vector(s, sf, "o_custkey")).select("v", "count"))


def _facts(spark, facts: dict):
    return spark.createDataFrame([(k, str(v)) for k, v in facts.items()], "name string, v string")


def _values(facts: dict) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in facts.items()) + ") t(name, v)"


def on_facts(name, f, told):
    register(name, _values(told))(lambda spark, sf: _facts(spark, f(spark, sf)))


def _compared(spark, sf):
    p = vector(spark, sf)
    near, other = p.map(lambda v: v * (1 + 1e-9)), p.map(lambda v: v + 1)
    return {
        "allclose": sets.allclose(p, near), "allclose_other": sets.allclose(p, other, rtol=0), "array_equal": sets.array_equal(p, p.map(lambda v: v * 1)), "array_equal_other": sets.array_equal(p, other),
        "array_equiv": sets.array_equiv(p, A.expand_dims(p, 0)), "chkfinite": sets.asarray_chkfinite(p).size == p.size, "shares": A.shares_memory(p, A.copy(p)), "may_share": A.may_share_memory(p, other),
        "iscomplexobj": A.iscomplexobj(p), "isrealobj": A.isrealobj(p), "isfortran": A.isfortran(p), "isscalar": A.isscalar(3.0), "iterable": A.iterable(p), "ndim": p.ndim, "itemsize": p.itemsize,
    }


on_facts("nd_predicates", _compared, {
    "allclose": True, "allclose_other": False, "array_equal": True, "array_equal_other": False, "array_equiv": True, "chkfinite": True, "shares": True, "may_share": False,
    "iscomplexobj": False, "isrealobj": True, "isfortran": False, "isscalar": True, "iterable": True, "ndim": 1, "itemsize": 8,
})
on_facts("types_promotion", lambda s, sf: {
    "promote": T.promote_types("i4", "f4"), "common": T.common_type("int", "float"), "result": T.result_type("i2", "u2"), "can_cast": T.can_cast("f8", "f4"), "min_scalar": T.min_scalar_type(300), "iinfo": T.iinfo("i4").max, "finfo": T.finfo("f4").nmant,
    "isdtype": T.isdtype(np.dtype("f8"), "real floating"), "typename": T.typename("d"), "mintypecode": T.mintypecode("if"),
}, {"promote": "float64", "common": "double", "result": "int32", "can_cast": False, "min_scalar": "uint16", "iinfo": 2147483647, "finfo": 23, "isdtype": True, "typename": "double precision", "mintypecode": "f"})
on_vector("types_astype", lambda p: p.map(lambda v: T.astype(v * 1000, "smallint").cast("int")), "SELECT i0, CAST((CAST(trunc(v * 1000) AS BIGINT) + 32768) % 65536 - 32768 AS INTEGER) AS v FROM p")


def _modes(spark, sf):
    before = T.geterr()
    with T.errstate(divide="raise"):
        inside = T.geterr()["divide"]
    call = T.seterrcall(print)
    told = T.geterrcall() is print
    T.seterrcall(call)
    old = T.seterr(over="ignore")
    T.seterr(**old)
    return {"inside": inside, "restored": T.geterr() == before, "call": told, "over": old["over"]}


on_facts("types_error_modes", _modes, {"inside": "raise", "restored": True, "call": True, "over": "warn"})

# --- polynomials ---------------------------------------------------------------
on_facts("poly_algebra", lambda s, sf: {
    "add": [float(x) for x in P.polyadd([1, 2], [3, 4, 5])], "sub": [float(x) for x in P.polysub([1, 2], [3, 4, 5])], "der": [float(x) for x in P.polyder([1, 2, 3])], "int": [float(x) for x in P.polyint([2, 2])],
    "div": [float(x) for x in P.polydiv([1, 3, 2], [1, 1])[0]], "poly": [float(x) for x in P.poly([1, 2])], "roots": sorted(round(float(x), 9) for x in P.roots([1, -3, 2])), "poly1d": float(P.poly1d([1, 2, 3])(2)),
    "trimseq": list(P.trimseq([1, 2, 0, 0])), "trimcoef": [float(x) for x in P.trimcoef([1, 2, 1e-9], 1e-6)], "mapparms": [float(x) for x in P.mapparms([0, 2], [-1, 1])],
}, {"add": [3.0, 5.0, 7.0], "sub": [-3.0, -3.0, -3.0], "der": [2.0, 2.0], "int": [1.0, 2.0, 0.0], "div": [1.0, 2.0], "poly": [1.0, -3.0, 2.0], "roots": [1.0, 2.0], "poly1d": 11.0, "trimseq": [1, 2], "trimcoef": [1.0, 2.0], "mapparms": [-1.0, 1.0]})


def _basis_laws(spark, sf):
    """Laws that every basis' functions keep, as differences of coefficients."""
    out = {}
    a, b = [1.0, 2.0, 0.5], [0.5, -1.0]
    size = lambda x: float(np.abs(np.asarray(x)).max(initial=0.0))
    for basis in ("poly", "cheb", "leg", "lag", "herm", "herme"):
        f = lambda name: P.on_coefficients(basis, name)  # noqa: B023, E731
        product, back = f("mul")(a, b), f("div")(f("mul")(a, b), b)[0]
        laws = {
            "add_sub": size(np.asarray(f("sub")(f("add")(a, b), b)) - a), "mul_div": size(np.asarray(back) - a), "mulx": size(np.asarray(f("mulx")(a)) - f("mul")(a, f("line")(0, 1))), "pow": size(np.asarray(f("pow")(b, 2)) - f("mul")(b, b)),
            "der_int": size(np.asarray(f("der")(f("int")(a))) - a), "roots": size(np.sort(f("roots")(f("fromroots")([0.25, 0.5]))) - [0.25, 0.5]), "companion": size(np.sort(np.linalg.eigvals(f("companion")(f("fromroots")([0.25, 0.5])))) - [0.25, 0.5]), "trim": len(f("trim")([1.0, 0.0])) - 1,
        }
        if basis != "poly":
            laws["2poly"] = size(np.asarray(f("poly2")(f("2poly")(product))) - product)
            nodes, weights = f("gauss")(5)
            laws["gauss"] = size(weights.sum() - {"cheb": math.pi, "leg": 2.0, "lag": 1.0, "herm": math.sqrt(math.pi), "herme": math.sqrt(2 * math.pi)}[basis])
        out |= {f"{basis}_{k}": v < 1e-9 for k, v in laws.items()}
    points = P.on_coefficients("cheb", "pts1")(4), P.on_coefficients("cheb", "pts2")(4)
    out["cheb_pts1"], out["cheb_pts2"] = abs(points[0].sum()) < 1e-12, abs(points[1].sum()) < 1e-12
    out["cheb_interpolate"] = size(P.on_coefficients("cheb", "interpolate")(lambda x: 4 * x**3 - 3 * x, 3) - [0, 0, 0, 1]) < 1e-12
    return out


_LAWS = ["add_sub", "mul_div", "mulx", "pow", "der_int", "roots", "companion", "trim"]
on_facts("poly_basis_laws", _basis_laws, {f"{b}_{k}": True for b in ("poly", "cheb", "leg", "lag", "herm", "herme") for k in [*_LAWS, *(["2poly", "gauss"] if b != "poly" else [])]} | {"cheb_pts1": True, "cheb_pts2": True, "cheb_interpolate": True})


def _series(spark, sf):
    p, q = P.Series("cheb", [1.0, 2.0, 3.0]), P.Series("cheb", [0.0, 1.0])
    near = lambda x, y: bool(np.allclose(x, y))
    return {
        "degree": p.degree(), "cutdeg": p.cutdeg(1).degree(), "truncate": p.truncate(2).degree(), "trim": P.Series("cheb", [1.0, 0.0]).trim().degree(), "samecoef": p.has_samecoef(p.copy()), "samedomain": p.has_samedomain(q), "samewindow": p.has_samewindow(q),
        "sametype": p.has_sametype(q), "integ_deriv": near(p.integ().deriv().coef, p.coef), "roots": near(p.inner(p.roots()), 0), "convert": near(p.convert(kind=np.polynomial.Polynomial).inner(0.3) if hasattr(p.convert(kind=np.polynomial.Polynomial), "inner") else p.convert(kind=np.polynomial.Polynomial)(0.3), p.inner(0.3)),
        "cast": near(np.polynomial.Polynomial.cast(p.inner)(0.3), p.inner(0.3)), "fromroots": near(sorted(np.polynomial.Chebyshev.fromroots([0.2, 0.4]).roots()), [0.2, 0.4]), "identity": near(type(p.inner).identity()(0.7), 0.7), "basis": near(type(p.inner).basis(2)(0.5), -0.5),
        "mapparms": near(p.mapparms(), (0, 1)), "linspace": len(p.linspace(5)[0]), "product": near((p * q).inner(0.3), p.inner(0.3) * q.inner(0.3)), "fit": near(np.polynomial.Chebyshev.fit([0, 1, 2], [1, 3, 5], 1)(3), 7),
    }


on_facts("poly_series", _series, {
    "degree": 2, "cutdeg": 1, "truncate": 1, "trim": 0, "samecoef": True, "samedomain": True, "samewindow": True, "sametype": True, "integ_deriv": True, "roots": True, "convert": True, "cast": True, "fromroots": True, "identity": True, "basis": True,
    "mapparms": True, "linspace": 5, "product": True, "fit": True,
})

# --- random --------------------------------------------------------------------
#: name: (arguments, mean, variance) of each distribution.
MOMENTS = {
    "standard_normal": ((), 0, 1), "normal": ((2, 3), 2, 9), "standard_exponential": ((), 1, 1), "exponential": ((2,), 2, 4), "standard_gamma": ((3,), 3, 3), "gamma": ((3, 2), 6, 12), "beta": ((2, 3), 0.4, 0.04), "chisquare": ((4,), 4, 8), "f": ((6, 20), 20 / 18, 2 * 400 * 24 / (6 * 324 * 16)),
    "uniform": ((1, 4), 2.5, 0.75), "standard_t": ((10,), 0, 1.25), "pareto": ((6,), 0.2, 6 / (25 * 4)), "weibull": ((2,), math.gamma(1.5), 1 - math.gamma(1.5) ** 2), "power": ((2,), 2 / 3, 1 / 18), "laplace": ((1, 2), 1, 8), "gumbel": ((0, 1), 0.5772156649, math.pi**2 / 6),
    "logistic": ((0, 1), 0, math.pi**2 / 3), "lognormal": ((0, 0.5), math.exp(0.125), (math.exp(0.25) - 1) * math.exp(0.25)), "rayleigh": ((2,), 2 * math.sqrt(math.pi / 2), (4 - math.pi) / 2 * 4), "wald": ((1, 3), 1, 1 / 3), "triangular": ((0, 1, 2), 1, 1 / 6), "noncentral_chisquare": ((3, 2), 5, 14),
    "noncentral_f": ((6, 20, 2), 20 * 8 / (6 * 18), 2 * ((6 + 2) ** 2 + (6 + 4) * 18) / (18**2 * 16) * (20 / 6) ** 2), "poisson": ((4,), 4, 4), "binomial": ((10, 0.3), 3, 2.1), "negative_binomial": ((5, 0.5), 5, 10), "geometric": ((0.25,), 4, 12), "integers": ((0, 10), 4.5, 8.25),
    "hypergeometric": ((10, 10, 5), 2.5, 5 * 0.25 * 15 / 19), "logseries": ((0.5,), 0.5 / (0.5 * math.log(2)), 0.5 * (0.5 + math.log(0.5)) * -1 / (0.25 * math.log(0.5) ** 2)), "vonmises": ((0, 4), 0, None), "zipf": ((6,), 1.0369277551433699 / 1.0173430619844491, None),
}
DRAWS = 200_000


def _moments(spark, sf):
    out, rng = {}, random.default_rng(spark, 7)
    for name, (arguments, mean, variance) in MOMENTS.items():
        got = getattr(rng, name)(*arguments, size=DRAWS).cells.agg(F.avg("v"), F.var_samp("v")).first()
        spread = math.sqrt((variance if variance is not None else got[1]) / DRAWS)
        out[f"{name}_mean"] = abs(got[0] - mean) < 6 * spread
        if variance is not None:
            out[f"{name}_variance"] = abs(got[1] / variance - 1) < 0.1
    cauchy = rng.standard_cauchy(size=DRAWS).cells.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.75)))).first()[0]
    out["standard_cauchy_quartiles"] = abs(cauchy[0] + 1) < 0.05 and abs(cauchy[1] - 1) < 0.05
    return out


on_facts("random_moments", _moments, {f"{k}_mean": True for k in MOMENTS} | {f"{k}_variance": True for k, v in MOMENTS.items() if v[2] is not None} | {"standard_cauchy_quartiles": True})


def _arrangements(spark, sf):
    p, rng = vector(spark, sf), random.default_rng(spark, 3)
    total = lambda a: round(a.cells.agg(F.sum(F.col("v").cast("decimal(38,2)"))).first()[0], 2)
    rows = lambda a: a.cells.groupBy("i0").agg(F.sum("v").alias("s")).agg(F.min(F.round("s", 9)), F.max(F.round("s", 9))).first()
    exact = np.random.default_rng(5).random(100_000)
    drawn = np.array(random.default_rng(spark, 5).random(100_000).tolist())
    return {
        "random_exact": bool((exact == drawn).all()), "permutation": total(rng.permutation(p)) == total(p), "shuffle": total(rng.shuffle(p)) == total(p), "permuted": total(rng.permuted(p)) == total(p), "choice": rng.choice(p, 500).cells.join(p.cells.select("v").distinct(), "v").count(),
        "choice_once": rng.choice(1000, 1000, replace=False).cells.select("v").distinct().count(), "bytes": len(rng.bytes(10)), "dirichlet": tuple(rows(rng.dirichlet([1, 2, 3], size=1000))), "multinomial": tuple(rows(rng.multinomial(20, [0.2, 0.8], size=1000))),
        "multivariate_hypergeometric": tuple(rows(rng.multivariate_hypergeometric([5, 6, 7], 4, size=1000))),
    }


on_facts("random_arrangements", _arrangements, {"random_exact": True, "permutation": True, "shuffle": True, "permuted": True, "choice": 500, "choice_once": 1000, "bytes": 10, "dirichlet": (1.0, 1.0), "multinomial": (20, 20), "multivariate_hypergeometric": (4, 4)})

# --- masked arrays -------------------------------------------------------------
_W = "(SELECT i0, i1, CASE WHEN v <= 400000 THEN v END AS w FROM m)"


def _hidden(m):
    return masked.masked_greater(m, 400000.0)


for _name, _sql in (("masked_equal", "v = 250000"), ("masked_not_equal", "v <> 250000"), ("masked_less", "v < 250000"), ("masked_less_equal", "v <= 250000"), ("masked_greater_equal", "v >= 250000")):
    on_matrix(f"ma_{_name}", lambda m, f=getattr(masked, _name): f(m, 250000), f"SELECT i0, i1, CASE WHEN NOT ({_sql}) THEN v END AS v FROM m")
on_matrix("ma_masked_where", lambda m: masked.masked_where(m.map(lambda v: v > 3e5), m), "SELECT i0, i1, CASE WHEN v <= 3e5 THEN v END AS v FROM m")
on_matrix("ma_masked_values", lambda m: masked.masked_values(m, 250000.0, rtol=0.5), "SELECT i0, i1, CASE WHEN abs(v - 250000) > 1e-8 + 0.5 * 250000 THEN v END AS v FROM m")
on_matrix("ma_getmask", lambda m: masked.getmask(_hidden(m)), "SELECT i0, i1, v > 400000 AS v FROM m")
on_matrix("ma_any", lambda m: masked.any_(_hidden(m).map(lambda v: v > 395000), 1), f"SELECT i0, bool_or(w > 395000) AS v FROM {_W} GROUP BY i0")
on_matrix("ma_all", lambda m: masked.all_(_hidden(m).map(lambda v: v > 5000), 1), f"SELECT i0, bool_and(w > 5000) AS v FROM {_W} GROUP BY i0")
on_matrix("ma_cumprod", lambda m: masked.cumprod(_hidden(m).map(lambda v: 1 + v / 1e8), 1), f"SELECT i0, i1, round(CASE WHEN w IS NOT NULL THEN product(coalesce(1 + w / 1e8, 1)) OVER (PARTITION BY i0 ORDER BY i1) END, 10) AS v FROM {_W}", 10)
on_matrix("ma_make_mask", lambda m: masked.make_mask(m.map(lambda v: (v > 4e5).cast("int"))), "SELECT i0, i1, v > 4e5 AS v FROM m")
on_matrix("ma_mask_or", lambda m: masked.mask_or(m.map(lambda v: v > 4e5), m.map(lambda v: v < 1e5)), "SELECT i0, i1, v > 4e5 OR v < 1e5 AS v FROM m")
on_matrix("ma_nonzero", lambda m: masked.nonzero(_hidden(m)), "SELECT i0, i1 FROM m WHERE v <= 400000 AND v <> 0")
on_matrix("ma_zeros_like", lambda m: masked.zeros_like(_hidden(m)), f"SELECT i0, i1, CASE WHEN w IS NOT NULL THEN 0.0 END::DOUBLE AS v FROM {_W}")
on_matrix("ma_masked_all_like", lambda m: masked.masked_all_like(m), "SELECT i0, i1, NULL::DOUBLE AS v FROM m")
on_matrix("ma_transpose", lambda m: masked.transpose(_hidden(m)), f"SELECT i1 AS i0, i0 AS i1, w AS v FROM {_W}")
on_matrix("ma_concatenate", lambda m: masked.concatenate([_hidden(m), m], 0), f"SELECT i0, i1, w AS v FROM {_W} UNION ALL SELECT i0 + n, i1, v FROM m, d")
on_matrix("ma_reshape", lambda m: masked.reshape(_hidden(m), (-1, 25)), f"SELECT (i0 * 100 + i1) // 25 AS i0, i1 % 25 AS i1, w AS v FROM {_W}")
on_matrix("ma_argmax", lambda m: masked.argmax(_hidden(m), 1), f"SELECT i0, i1 AS v FROM {_W} WHERE w IS NOT NULL QUALIFY row_number() OVER (PARTITION BY i0 ORDER BY w DESC, i1) = 1")
on_matrix("ma_argmin", lambda m: masked.argmin(_hidden(m), 1), f"SELECT i0, i1 AS v FROM {_W} WHERE w IS NOT NULL QUALIFY row_number() OVER (PARTITION BY i0 ORDER BY w, i1) = 1")


def _i0_defect(v):
    """log of i0 less its leading term at 1 to 51, which is between 0 and 0.2."""
    x = v / 1e4 + 1
    off = F.log(U.i0(x)) - x + F.log(F.sqrt(2 * math.pi * x))
    return (off > 0) & (off < 0.2)


on_matrix("ufunc_i0_far", lambda m: m.map(_i0_defect), "SELECT i0, i1, true AS v FROM m")
