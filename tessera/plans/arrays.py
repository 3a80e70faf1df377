"""Queries of the array operators, over a price vector and the matrix of its rows of 100."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import polynomials as P
from tessera.operators import array as A
from tessera.operators import lanes, linalg, masked, products, reduce, sets
from tessera.plans.catalog import register, table

_P = "p AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i0, o_totalprice AS v, o_custkey AS c FROM orders)"
_M = _P + ", m AS (SELECT i0 // 100 AS i0, i0 % 100 AS i1, v FROM p WHERE i0 < (SELECT count(*) // 100 * 100 FROM orders)), d AS (SELECT count(*) // 100 AS n FROM orders)"


def vector(spark, sf_dir, value="o_totalprice"):
    return A.from_column(table(spark, sf_dir, "orders"), ["o_orderkey"], value)


def matrix(spark, sf_dir):
    p = vector(spark, sf_dir)
    n = p.size // 100
    return A.reshape(A.NdArray(p.cells.where(F.col("i0") < n * 100), (n * 100,)), (n, 100))


def _cells(a, digits):
    frame = a.cells if isinstance(a, A.NdArray) else a
    return frame.withColumn("v", F.round(F.col("v").cast("double"), digits)) if digits is not None else frame


def on_vector(name, f, sql, digits=None):
    register(name, f"WITH {_P} {sql}")(lambda spark, sf: _cells(f(vector(spark, sf)), digits))


def on_matrix(name, f, sql, digits=None):
    register(name, f"WITH {_M} {sql}")(lambda spark, sf: _cells(f(matrix(spark, sf)), digits))


def on_session(name, f, sql, digits=None):
    register(name, sql)(lambda spark, sf: _cells(f(spark), digits))


# --- creation ------------------------------------------------------------------
on_session("nd_arange", lambda s: A.arange(s, 5, 500, 3), "SELECT range AS i0, CAST(5 + 3 * range AS BIGINT) AS v FROM range(165)")
on_session("nd_linspace", lambda s: A.linspace(s, -1, 1, 201), "SELECT range AS i0, round(-1 + range * 0.01::DOUBLE, 9) AS v FROM range(201)", 9)
on_session("nd_logspace", lambda s: A.logspace(s, 0, 2, 21), "SELECT range AS i0, round(pow(10, range * 0.1::DOUBLE), 6) AS v FROM range(21)", 6)
on_session("nd_zeros_ones_full", lambda s: A.concatenate([A.zeros(s, (2, 3)), A.ones(s, (2, 3)), A.full(s, (2, 3), 7.5)]), "SELECT a.range AS i0, b.range AS i1, CASE WHEN a.range < 2 THEN 0.0 WHEN a.range < 4 THEN 1.0 ELSE 7.5 END::DOUBLE AS v FROM range(6) a, range(3) b", 1)
on_session("nd_eye", lambda s: A.eye(s, 30, 40, 2), "SELECT a.range AS i0, b.range AS i1, CASE WHEN b.range - a.range = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM range(30) a, range(40) b", 1)
on_session("nd_tri", lambda s: A.tri(s, 20, 30, 1), "SELECT a.range AS i0, b.range AS i1, CASE WHEN b.range - a.range <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM range(20) a, range(30) b", 1)
on_session("nd_indices", lambda s: A.indices(s, (4, 5))[1], "SELECT a.range AS i0, b.range AS i1, b.range AS v FROM range(4) a, range(5) b")
on_session("nd_meshgrid", lambda s: A.meshgrid(A.arange(s, 4), A.arange(s, 6))[0], "SELECT a.range AS i0, b.range AS i1, CAST(b.range AS BIGINT) AS v FROM range(6) a, range(4) b")
register("nd_tril_indices", "SELECT a.range AS i0, b.range AS i1 FROM range(9) a, range(9) b WHERE b.range - a.range <= 1")(lambda s, sf: A.tril_indices(s, 9, 1))
register("nd_triu_indices", "SELECT a.range AS i0, b.range AS i1 FROM range(9) a, range(9) b WHERE b.range - a.range >= 1")(lambda s, sf: A.triu_indices(s, 9, 1))

# --- shape and indexing --------------------------------------------------------
on_matrix("nd_transpose", lambda m: m.T, "SELECT i1 AS i0, i0 AS i1, v FROM m")
on_matrix("nd_reshape", lambda m: A.reshape(m, (-1, 25)), "SELECT (i0 * 100 + i1) // 25 AS i0, (i0 * 100 + i1) % 25 AS i1, v FROM m")
on_matrix("nd_ravel", A.ravel, "SELECT i0 * 100 + i1 AS i0, v FROM m")
on_matrix("nd_moveaxis", lambda m: A.moveaxis(A.reshape(m, (-1, 10, 10)), 0, -1), "SELECT i1 // 10 AS i0, i1 % 10 AS i1, i0 AS i2, v FROM m")
on_matrix("nd_expand_squeeze", lambda m: A.squeeze(A.expand_dims(m, 1)), "SELECT * FROM m")
on_matrix("nd_broadcast_to", lambda m: A.broadcast_to(m, (3, *m.shape)), "SELECT range AS i0, i0 AS i1, i1 AS i2, v FROM m, range(3)")
on_matrix("nd_flip", A.flip, "SELECT n - 1 - i0 AS i0, 99 - i1 AS i1, v FROM m, d")
on_matrix("nd_rot90", A.rot90, "SELECT 99 - i1 AS i0, i0 AS i1, v FROM m")
on_matrix("nd_roll", lambda m: A.roll(m, (2, -3), (0, 1)), "SELECT (i0 + 2) % n AS i0, (i1 + 97) % 100 AS i1, v FROM m, d")
on_matrix("nd_tile", lambda m: A.tile(m, (2, 3)), "SELECT i0 + n * a.range AS i0, i1 + 100 * b.range AS i1, v FROM m, d, range(2) a, range(3) b")
on_matrix("nd_repeat", lambda m: A.repeat(m, 3, 1), "SELECT i0, i1 * 3 + range AS i1, v FROM m, range(3)")
on_matrix("nd_concatenate", lambda m: A.concatenate([m, m], 0), "SELECT * FROM m UNION ALL SELECT i0 + n, i1, v FROM m, d")
on_matrix("nd_stack", lambda m: A.stack([m, -m], 1), "SELECT i0, range AS i1, i1 AS i2, CASE WHEN range = 0 THEN v ELSE -v END AS v FROM m, range(2)")
on_matrix("nd_hstack", lambda m: A.hstack([m, m]), "SELECT * FROM m UNION ALL SELECT i0, i1 + 100, v FROM m")
on_vector("nd_column_stack", lambda p: A.column_stack([p, -p]), "SELECT i0, range AS i1, CASE WHEN range = 0 THEN v ELSE -v END AS v FROM p, range(2)")
on_matrix("nd_dstack", lambda m: A.dstack([m, -m]), "SELECT i0, i1, range AS i2, CASE WHEN range = 0 THEN v ELSE -v END AS v FROM m, range(2)")
on_matrix("nd_array_split", lambda m: A.array_split(m, 7, 1)[3], "SELECT i0, i1 - 44 AS i1, v FROM m WHERE i1 >= 44 AND i1 < 58")
on_matrix("nd_diag", lambda m: A.diag(reduce.max_(m, 0), 1), ", c AS (SELECT i1, max(v) AS v FROM m GROUP BY i1) SELECT a.range AS i0, b.range AS i1, CASE WHEN b.range = a.range + 1 THEN c.v ELSE 0 END AS v FROM range(101) a CROSS JOIN range(101) b LEFT JOIN c ON c.i1 = a.range")
on_matrix("nd_diagonal", A.diagonal, "SELECT i0, v FROM m WHERE i0 = i1")
on_matrix("nd_tril", A.tril, "SELECT i0, i1, CASE WHEN i1 <= i0 THEN v ELSE 0 END AS v FROM m")
on_matrix("nd_triu", lambda m: A.triu(m, 1), "SELECT i0, i1, CASE WHEN i1 > i0 THEN v ELSE 0 END AS v FROM m")
on_matrix("nd_fill_diagonal", lambda m: A.fill_diagonal(m, -1.0), "SELECT i0, i1, CASE WHEN i0 = i1 THEN -1 ELSE v END AS v FROM m")
on_matrix("nd_pad", lambda m: A.pad(m, 1), "SELECT a.range AS i0, b.range AS i1, coalesce(v, 0) AS v FROM range((SELECT n + 2 FROM d)) a CROSS JOIN range(102) b LEFT JOIN m ON m.i0 = a.range - 1 AND m.i1 = b.range - 1")
on_vector("nd_insert", lambda p: A.insert(p, 2, -p), "SELECT CASE WHEN i0 < 2 THEN i0 ELSE i0 + (SELECT count(*) FROM p) END AS i0, v FROM p UNION ALL SELECT i0 + 2, -v FROM p")
on_matrix("nd_delete", lambda m: A.delete(m, [0, 5, -1], 1), "SELECT i0, i1 - 1 - CASE WHEN i1 > 5 THEN 1 ELSE 0 END AS i1, v FROM m WHERE i1 NOT IN (0, 5, 99)")
on_matrix("nd_resize", lambda m: A.resize(m, (m.shape[0] * 2, 150)), "SELECT range // 150 AS i0, range % 150 AS i1, v FROM range((SELECT n * 300 FROM d)) JOIN m ON m.i0 * 100 + m.i1 = range % (SELECT n * 100 FROM d)")
on_matrix("nd_getitem_slices", lambda m: m[1::2, ::-3], "SELECT (i0 - 1) // 2 AS i0, (99 - i1) // 3 AS i1, v FROM m WHERE i0 % 2 = 1 AND (99 - i1) % 3 = 0")
on_matrix("nd_take", lambda m: A.take(m, [3, -1, 3], 1), "SELECT i0, q.i1, v FROM m JOIN (VALUES (0, 3), (1, 99), (2, 3)) q(i1, j) ON m.i1 = q.j")
on_vector("nd_put", lambda p: A.put(p, [1, 2, 1, -1], [10.0, 20.0]), "SELECT i0, CASE i0 WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN (SELECT count(*) - 1 FROM p) THEN 20 ELSE v END AS v FROM p")
on_matrix("nd_take_along_axis", lambda m: A.take_along_axis(m, reduce.argsort(m, 1)[:, :3], 1), "SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS i1, v FROM m QUALIFY row_number() OVER (PARTITION BY i0 ORDER BY v, i1) <= 3")
on_matrix("nd_compress", lambda m: A.compress([k % 10 == 0 for k in range(100)], m, 1), "SELECT i0, i1 // 10 AS i1, v FROM m WHERE i1 % 10 = 0")
on_matrix("nd_where", lambda m: A.where(m.map(lambda v: v > 250000), m, -m), "SELECT i0, i1, CASE WHEN v > 250000 THEN v ELSE -v END AS v FROM m")
on_vector("nd_extract", lambda p: A.extract(p.map(lambda v: v > 400000), p), "SELECT row_number() OVER (ORDER BY i0) - 1 AS i0, v FROM p WHERE v > 400000")
on_matrix("nd_nonzero", lambda m: A.nonzero(m.map(lambda v: v > 450000)), "SELECT i0, i1 FROM m WHERE v > 450000")

# --- reductions ----------------------------------------------------------------
for _name, _f, _sql in (
    ("sum", reduce.sum_, "sum(v)"), ("mean", reduce.mean, "avg(v)"), ("min", reduce.min_, "min(v)"), ("max", reduce.max_, "max(v)"), ("ptp", reduce.ptp, "max(v) - min(v)"), ("var", reduce.var, "var_pop(v)"), ("std", reduce.std, "stddev_pop(v)"),
    ("median", reduce.median, "median(v)"), ("count_nonzero", reduce.count_nonzero, "count(*) FILTER (v <> 0)"),
):
    on_matrix(f"nd_{_name}", lambda m, f=_f: f(m, 0), f"SELECT i1 AS i0, round({_sql}, 3)::DOUBLE AS v FROM m GROUP BY i1", 3)
on_matrix("nd_std_ddof1", lambda m: reduce.std(m, 1, 1), "SELECT i0, round(stddev_samp(v), 3) AS v FROM m GROUP BY i0", 3)
on_matrix("nd_prod", lambda m: reduce.prod(m.map(lambda v: v / 250000), 0), "SELECT i1 AS i0, round(exp(sum(ln(v / 250000))), 6) AS v FROM m GROUP BY i1", 6)
on_matrix("nd_all_any", lambda m: A.stack([reduce.all_(m.map(lambda v: v > 1000), 1).astype("int"), reduce.any_(m.map(lambda v: v > 490000), 1).astype("int")], 1), "SELECT i0, range AS i1, CASE range WHEN 0 THEN bool_and(v > 1000) ELSE bool_or(v > 490000) END::INTEGER AS v FROM m, range(2) GROUP BY i0, range")
on_matrix("nd_argmin", lambda m: reduce.argmin(m, 1), "SELECT i0, i1 AS v FROM m QUALIFY row_number() OVER (PARTITION BY i0 ORDER BY v, i1) = 1")
on_matrix("nd_argmax", lambda m: reduce.argmax(m, 1), "SELECT i0, i1 AS v FROM m QUALIFY row_number() OVER (PARTITION BY i0 ORDER BY v DESC, i1) = 1")
on_matrix("nd_average", lambda m: reduce.average(m, A.broadcast_to(A.arange(m.spark, 100).map(lambda v: (v + 1).cast("double")), m.shape), 1), "SELECT i0, round(sum(v * (i1 + 1)) / sum(i1 + 1), 3) AS v FROM m GROUP BY i0", 3)
_NAN = "CASE WHEN i1 % 7 = 0 THEN NULL ELSE v END"


def _holed(m):
    return A.NdArray(m.cells.withColumn("v", F.when(F.col("i1") % 7 == 0, float("nan")).otherwise(F.col("v"))), m.shape)


for _name, _f, _sql in (
    ("nansum", reduce.nansum, f"sum({_NAN})"), ("nanmean", reduce.nanmean, f"avg({_NAN})"), ("nanmin", reduce.nanmin, f"min({_NAN})"), ("nanmax", reduce.nanmax, f"max({_NAN})"), ("nanvar", reduce.nanvar, f"var_pop({_NAN})"),
    ("nanstd", reduce.nanstd, f"stddev_pop({_NAN})"), ("nanmedian", reduce.nanmedian, f"median({_NAN})"),
):
    on_matrix(f"nd_{_name}", lambda m, f=_f: f(_holed(m), 1), f"SELECT i0, round({_sql}, 3) AS v FROM m GROUP BY i0", 3)
on_matrix("nd_nanargmax", lambda m: reduce.nanargmax(_holed(m), 1), "SELECT i0, i1 AS v FROM m WHERE i1 % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY i0 ORDER BY v DESC, i1) = 1")
on_matrix("nd_nanargmin", lambda m: reduce.nanargmin(_holed(m), 1), "SELECT i0, i1 AS v FROM m WHERE i1 % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY i0 ORDER BY v, i1) = 1")
on_matrix("nd_percentile", lambda m: reduce.percentile(m, 90, 1), "SELECT i0, round(quantile_cont(v, 0.9), 3) AS v FROM m GROUP BY i0", 3)
on_matrix("nd_quantile_lower", lambda m: reduce.quantile(m, 0.37, 1, "lower"), "SELECT i0, round(list_sort(list(v))[(floor(99 * 0.37) + 1)::INTEGER], 3) AS v FROM m GROUP BY i0", 3)
on_matrix("nd_quantile_inverted_cdf", lambda m: reduce.quantile(m, 0.37, 1, "inverted_cdf"), "SELECT i0, round(quantile_disc(v, 0.37), 3) AS v FROM m GROUP BY i0", 3)
on_vector("nd_global_median", reduce.median, "SELECT round(median(v), 3) AS v FROM p", 3)

# --- scans, sorting, searching -------------------------------------------------
on_vector("nd_cumsum", reduce.cumsum, "SELECT i0, round(sum(v) OVER (ORDER BY i0), 3) AS v FROM p", 3)
on_matrix("nd_cumprod", lambda m: reduce.cumprod(m.map(lambda v: 1 + v / 1e8), 1), "SELECT i0, i1, round(product(1 + v / 1e8) OVER (PARTITION BY i0 ORDER BY i1), 10) AS v FROM m", 10)
on_vector("nd_maximum_accumulate", reduce.maximum_accumulate, "SELECT i0, max(v) OVER (ORDER BY i0) AS v FROM p")
on_vector("nd_diff", reduce.diff, "SELECT i0 - 1 AS i0, round(v - lag(v) OVER (ORDER BY i0), 6) AS v FROM p QUALIFY i0 > 0", 6)
on_matrix("nd_diff2_axis", lambda m: reduce.diff(m, 2, 1), "SELECT i0, i1 - 2 AS i1, round(v - 2 * lag(v, 1) OVER w + lag(v, 2) OVER w, 5) AS v FROM m WINDOW w AS (PARTITION BY i0 ORDER BY i1) QUALIFY i1 >= 2", 5)
on_vector("nd_ediff1d", lambda p: reduce.ediff1d(p, to_begin=[-1.0]), "SELECT i0, coalesce(round(v - lag(v) OVER (ORDER BY i0), 6), -1) AS v FROM p", 6)
on_vector("nd_sort", reduce.sort, "SELECT row_number() OVER (ORDER BY v, i0) - 1 AS i0, v FROM p")
on_matrix("nd_sort_axis", lambda m: reduce.sort(m, 1, descending=True), "SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v DESC, i1) - 1 AS i1, v FROM m")
on_vector("nd_argsort", reduce.argsort, "SELECT row_number() OVER (ORDER BY v, i0) - 1 AS i0, i0 AS v FROM p")
register("nd_lexsort", f"WITH {_P} SELECT row_number() OVER (ORDER BY c, v, i0) - 1 AS i0, i0 AS v FROM p")(lambda s, sf: reduce.lexsort([vector(s, sf), vector(s, sf, "o_custkey")]).cells)
on_vector("nd_searchsorted", lambda p: reduce.searchsorted(p, A.arange(p.spark, 0, 500000, 777).astype("double")), "SELECT range AS i0, (SELECT count(*) FROM p WHERE v < range * 777) AS v FROM range(644)")
on_vector("nd_top_k", lambda p: reduce.top_k(p, 25), "SELECT i0, v FROM p ORDER BY v DESC, i0 LIMIT 25")
on_vector("nd_histogram", lambda p: reduce.histogram(p, 20, 0, 500000), "SELECT range AS i0, count(v) AS v FROM range(20) LEFT JOIN p ON v BETWEEN 0 AND 500000 AND least(CAST(floor(v / 25000) AS BIGINT), 19) = range GROUP BY range")
register("nd_bincount", f"WITH {_P} SELECT range AS i0, count(c) AS v FROM range((SELECT max(c) + 1 FROM p)) LEFT JOIN p ON c = range GROUP BY range")(lambda s, sf: reduce.bincount(vector(s, sf, "o_custkey")).cells)
on_vector("nd_digitize", lambda p: reduce.digitize(p, [1e5, 2e5, 3e5, 4e5]), "SELECT i0, CAST((v >= 1e5)::INTEGER + (v >= 2e5)::INTEGER + (v >= 3e5)::INTEGER + (v >= 4e5)::INTEGER AS INTEGER) AS v FROM p")
on_vector("nd_reduceat", lambda p: reduce.reduceat(p, [0, 10, 100, 50]), "SELECT k AS i0, round(sum(v), 3) AS v FROM p JOIN (VALUES (0, 0, 9), (1, 10, 99), (2, 100, 100), (3, 50, 1e9)) s(k, a, b) ON i0 BETWEEN a AND b GROUP BY k", 3)
on_vector("nd_ufunc_at", lambda p: reduce.at(A.zeros(p.spark, (7,)), p.map(lambda v: F.pmod(F.floor(v), F.lit(7))), p), "SELECT CAST(floor(v) AS BIGINT) % 7 AS i0, round(sum(v), 2) AS v FROM p GROUP BY 1", 2)

# --- sets ----------------------------------------------------------------------


def _keys(spark, sf):
    return vector(spark, sf, "o_custkey"), A.from_column(table(spark, sf, "part"), ["p_partkey"], "p_partkey")


_S = _P + ", q AS (SELECT p_partkey AS c FROM part)"
register("nd_unique", f"WITH {_P} SELECT row_number() OVER (ORDER BY c) - 1 AS i0, c AS v, min(i0) AS index, count(*) AS count FROM p GROUP BY c")(lambda s, sf: sets.unique_all(_keys(s, sf)[0]))
register("nd_unique_inverse", f"WITH {_P} SELECT i0, dense_rank() OVER (ORDER BY c) - 1 AS v FROM p")(lambda s, sf: sets.unique_inverse(_keys(s, sf)[0]).cells)
for _name, _f, _sql in (("intersect1d", sets.intersect1d, "SELECT c FROM p INTERSECT SELECT c FROM q"), ("union1d", sets.union1d, "SELECT c FROM p UNION SELECT c FROM q"), ("setdiff1d", sets.setdiff1d, "SELECT c FROM q EXCEPT SELECT c FROM p"), ("setxor1d", sets.setxor1d, "(SELECT c FROM p EXCEPT SELECT c FROM q) UNION (SELECT c FROM q EXCEPT SELECT c FROM p)")):
    register(f"nd_{_name}", f"WITH {_S} SELECT row_number() OVER (ORDER BY c) - 1 AS i0, c AS v FROM ({_sql})")(lambda s, sf, f=_f, n=_name: f(*(_keys(s, sf)[::-1] if n == "setdiff1d" else _keys(s, sf))))
register("nd_isin", f"WITH {_P} SELECT i0, c IN (SELECT s_suppkey FROM supplier) AS v FROM p")(lambda s, sf: sets.isin(vector(s, sf, "o_custkey"), A.from_column(table(s, sf, "supplier"), ["s_suppkey"], "s_suppkey")).cells)
on_vector("nd_trim_zeros", lambda p: sets.trim_zeros(A.NdArray(p.cells.withColumn("v", F.when(F.col("i0").between(5, 20), F.col("v")).otherwise(0.0)), p.shape)), "SELECT i0 - 5 AS i0, v FROM p WHERE i0 BETWEEN 5 AND 20")

# --- products ------------------------------------------------------------------
on_matrix("nd_matmul", lambda m: products.matmul(m.T.map(lambda v: v / 1e6), m.map(lambda v: v / 1e6)), "SELECT a.i1 AS i0, b.i1 AS i1, round(sum(a.v / 1e6 * (b.v / 1e6)), 6) AS v FROM m a JOIN m b ON a.i0 = b.i0 GROUP BY a.i1, b.i1", 6)
on_matrix("nd_matvec", lambda m: products.matvec(m, m[0].map(lambda v: v / 1e6)), "SELECT a.i0, round(sum(a.v * (b.v / 1e6)), 2) AS v FROM m a JOIN m b ON b.i0 = 0 AND a.i1 = b.i1 GROUP BY a.i0", 2)
on_vector("nd_inner", lambda p: products.inner(p, p).map(lambda v: v / 1e12), "SELECT round(sum(v * v) / 1e12, 6) AS v FROM p", 6)
on_matrix("nd_vecdot", lambda m: products.vecdot(m, m), "SELECT i0, round(sum(v * v), 0) AS v FROM m GROUP BY i0", 0)
on_matrix("nd_outer", lambda m: products.outer(reduce.max_(m, 1), reduce.min_(m, 0)), ", r AS (SELECT i0, max(v) AS r FROM m GROUP BY i0), c AS (SELECT i1, min(v) AS c FROM m GROUP BY i1) SELECT i0, i1, round(r * c, 4) AS v FROM r, c", 4)
on_matrix("nd_kron", lambda m: products.kron(m, A.array(m.spark, [[1.0, 2.0], [3.0, 4.0]])), "SELECT i0 * 2 + a.range AS i0, i1 * 2 + b.range AS i1, round(v * (1 + 2 * a.range + b.range), 2) AS v FROM m, range(2) a, range(2) b", 2)
on_matrix("nd_tensordot", lambda m: products.tensordot(A.reshape(m, (-1, 10, 10)), A.reshape(m[0], (10, 10)), 2), "SELECT a.i0, round(sum(a.v * b.v), 0) AS v FROM m a JOIN m b ON b.i0 = 0 AND a.i1 = b.i1 GROUP BY a.i0", 0)
on_vector("nd_cross", lambda p: products.cross(A.reshape(p, (-1, 3)).map(lambda v: v / 1e3), A.flip(A.reshape(p, (-1, 3)).map(lambda v: v / 1e3), 1)), ", x AS (SELECT i0 // 3 AS i0, max(v) FILTER (i0 % 3 = 0) / 1e3 AS a, max(v) FILTER (i0 % 3 = 1) / 1e3 AS b, max(v) FILTER (i0 % 3 = 2) / 1e3 AS c FROM p GROUP BY 1) SELECT i0, range AS i1, round(CASE range WHEN 0 THEN b * a - c * b WHEN 1 THEN c * c - a * a ELSE a * b - b * c END, 4) + 0.0 AS v FROM x, range(3)", 4)
on_matrix("nd_trace", lambda m: products.trace(m, 1), "SELECT round(sum(v), 2) AS v FROM m WHERE i1 = i0 + 1", 2)
on_vector("nd_diagonal_operator", lambda p: products.Diagonal(p.map(lambda v: v / 1e3)).apply(p.map(lambda v: v / 1e3)), "SELECT i0, round(v / 1e3 * (v / 1e3), 3) AS v FROM p", 3)
on_matrix("nd_circulant_operator", lambda m: products.Circulant(reduce.max_(m, 0).map(lambda v: v / 1e6)).apply(reduce.min_(m, 0)), ", c AS (SELECT i1, max(v) / 1e6 AS x, min(v) AS y FROM m GROUP BY i1) SELECT (a.i1 + b.i1) % 100 AS i0, round(sum(a.x * b.y), 4) AS v FROM c a, c b GROUP BY 1", 4)
on_matrix("nd_norm", lambda m: linalg.norm(m, axis=1), "SELECT i0, round(sqrt(sum(v * v)), 2) AS v FROM m GROUP BY i0", 2)
on_matrix("nd_norm_1", lambda m: linalg.matrix_norm(m, 1), "SELECT round(max(s), 2) AS v FROM (SELECT sum(abs(v)) AS s FROM m GROUP BY i1)", 2)
on_vector("nd_det2", lambda p: linalg.det(A.reshape(p.map(lambda v: v / 1e5), (-1, 2, 2))), "SELECT i0 // 4 AS i0, round(max(v) FILTER (i0 % 4 = 0) / 1e5 * (max(v) FILTER (i0 % 4 = 3) / 1e5) - max(v) FILTER (i0 % 4 = 1) / 1e5 * (max(v) FILTER (i0 % 4 = 2) / 1e5), 6) AS v FROM p GROUP BY 1", 6)
on_matrix("nd_fftshift", lambda m: lanes.fftshift(m, 1), "SELECT i0, (i1 + 50) % 100 AS i1, v FROM m")
on_session("nd_fftfreq", lambda s: lanes.fftfreq(s, 11, 0.5), "SELECT range AS i0, round(CASE WHEN range < 6 THEN range ELSE range - 11 END / 5.5, 9) AS v FROM range(11)", 9)
on_session("nd_rfftfreq", lambda s: lanes.rfftfreq(s, 11, 0.5), "SELECT range AS i0, round(range / 5.5, 9) AS v FROM range(6)", 9)
for _name, _sql in (("bartlett", "1 - abs(t)"), ("hanning", "0.5 + 0.5 * cos(pi() * t)"), ("hamming", "0.54 + 0.46 * cos(pi() * t)"), ("blackman", "0.42 + 0.5 * cos(pi() * t) + 0.08 * cos(2 * pi() * t)")):
    register(f"nd_{_name}", f"SELECT range AS i0, abs(round({_sql}, 9)) AS v FROM (SELECT range, (2 * range - 50) / 50 AS t FROM range(51))")(lambda s, sf, n=_name: getattr(lanes, n)(s, 51).cells.withColumn("v", F.abs(F.round("v", 9))))

# --- masked arrays -------------------------------------------------------------


def _masked(m):
    return masked.masked_greater(m, 400000.0)


for _name, _f, _sql in (("sum", masked.sum_, "sum(w)"), ("mean", masked.mean, "avg(w)"), ("min", masked.min_, "min(w)"), ("max", masked.max_, "max(w)"), ("count", masked.count, "count(w)"), ("ptp", masked.ptp, "max(w) - min(w)"), ("count_masked", masked.count_masked, "count(*) - count(w)")):
    on_matrix(f"ma_{_name}", lambda m, f=_f: f(_masked(m), 1), f"SELECT i0, round({_sql}, 3)::DOUBLE AS v FROM (SELECT i0, CASE WHEN v <= 400000 THEN v END AS w FROM m) GROUP BY i0", 3)
on_matrix("ma_filled", lambda m: masked.filled(_masked(m), -1.0), "SELECT i0, i1, CASE WHEN v <= 400000 THEN v ELSE -1 END AS v FROM m")
on_matrix("ma_masked_inside", lambda m: masked.masked_inside(m, 1e5, 2e5), "SELECT i0, i1, CASE WHEN v BETWEEN 1e5 AND 2e5 THEN NULL ELSE v END AS v FROM m")
on_matrix("ma_masked_outside", lambda m: masked.masked_outside(m, 1e5, 2e5), "SELECT i0, i1, CASE WHEN v BETWEEN 1e5 AND 2e5 THEN v END AS v FROM m")
on_matrix("ma_masked_invalid", lambda m: masked.masked_invalid(_holed(m)), "SELECT i0, i1, CASE WHEN i1 % 7 <> 0 THEN v END AS v FROM m")
on_matrix("ma_cumsum", lambda m: masked.cumsum(_masked(m), 1), "SELECT i0, i1, round(CASE WHEN v <= 400000 THEN sum(CASE WHEN v <= 400000 THEN v ELSE 0 END) OVER (PARTITION BY i0 ORDER BY i1) END, 2) AS v FROM m", 2)
on_matrix("ma_log", lambda m: masked.log(m.map(lambda v: v - 2e5)), "SELECT i0, i1, CASE WHEN v > 2e5 THEN round(ln(v - 2e5), 9) END AS v FROM m", 9)
on_matrix("ma_compressed", lambda m: masked.compressed(_masked(m)), "SELECT * FROM m WHERE v <= 400000")

# --- polynomials ---------------------------------------------------------------
_C = [1.0, -2.0, 0.5, 0.25]
_BASIS = {
    "poly": ("t", "t * t", "t * t * t"), "cheb": ("t", "(2 * t * t - 1)", "(4 * t * t * t - 3 * t)"), "leg": ("t", "((3 * t * t - 1) / 2)", "((5 * t * t * t - 3 * t) / 2)"),
    "lag": ("(1 - t)", "((t * t - 4 * t + 2) / 2)", "((-t * t * t + 9 * t * t - 18 * t + 6) / 6)"), "herm": ("(2 * t)", "(4 * t * t - 2)", "(8 * t * t * t - 12 * t)"), "herme": ("t", "(t * t - 1)", "(t * t * t - 3 * t)"),
}
for _b, (_x, _y, _z) in _BASIS.items():
    on_vector(f"poly_{_b}val", lambda p, b=_b: p.map(lambda v: P.val(b, v / 500000, _C)), f"SELECT i0, round(1 - 2 * {_x} + 0.5 * {_y} + 0.25 * {_z}, 9) AS v FROM (SELECT i0, v / 500000 AS t FROM p)", 9)
    on_vector(f"poly_{_b}vander", lambda p, b=_b: p.map(lambda v: F.element_at(P.vander(b, v / 500000, 3), 4)), f"SELECT i0, round({_z}, 9) AS v FROM (SELECT i0, v / 500000 AS t FROM p)", 9)
on_vector("poly_valfromroots", lambda p: p.map(lambda v: P.valfromroots(v / 500000, [0.25, 0.5])), "SELECT i0, round((v / 500000 - 0.25) * (v / 500000 - 0.5), 9) AS v FROM p", 9)
on_vector("poly_val2d", lambda p: p.map(lambda v: P.val2d("poly", (v / 500000, v / 250000), [[1.0, 2.0], [3.0, 4.0]])), "SELECT i0, round(1 + 2 * (v / 250000) + 3 * (v / 500000) + 4 * (v / 500000) * (v / 250000), 9) AS v FROM p", 9)


@register("poly_fit", f"WITH {_P} SELECT range AS power, round(CASE range WHEN 0 THEN regr_intercept(v, i0 / 1e4) ELSE regr_slope(v, i0 / 1e4) END, 3) AS c FROM p, range(2) GROUP BY range")
def poly_fit(spark, sf):
    """A line through the prices by position."""
    frame = vector(spark, sf).cells.withColumn("x", F.col("i0") / 1e4)
    c = P.fit("poly", frame, "x", "v", 1)
    return spark.createDataFrame([(k, round(float(v), 3)) for k, v in enumerate(c)], "power bigint, c double")
