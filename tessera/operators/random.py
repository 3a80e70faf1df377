"""Seeded random arrays.

`random` is exact: its values are those of the PCG64 stream, since each value takes one
step and blocks can jump ahead. The other distributions take a varying number of steps,
so each block of values has a stream of its own, spawned from the seed: results depend
on the seed and the block size alone, never on the partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators.array import NdArray, dense_rank_positions, take, unlinear

BLOCK = 1 << 16
DISTRIBUTIONS = (
    "integers", "standard_normal", "normal", "standard_exponential", "exponential", "standard_gamma", "gamma", "beta", "chisquare", "f", "uniform", "standard_cauchy", "standard_t", "pareto", "weibull", "power",
    "laplace", "gumbel", "logistic", "lognormal", "rayleigh", "wald", "vonmises", "triangular", "noncentral_chisquare", "noncentral_f", "poisson", "binomial", "negative_binomial", "geometric", "zipf", "logseries", "hypergeometric",
)
ROWS = ("dirichlet", "multinomial", "multivariate_hypergeometric")


class Generator:
    """Distributions as methods: rng.normal(loc, scale, size=(…))."""

    def __init__(self, spark: SparkSession, seed: int = 0, bits: str = "PCG64"):
        self.spark, self.seed, self.bits, self.calls = spark, seed, bits, 0

    def _blocks(self, shape, draw, kind: str, width: int = 1) -> NdArray:
        shape = tuple(shape) if hasattr(shape, "__iter__") else (shape,)
        n = math.prod(shape)
        self.calls += 1
        count = -(-n // BLOCK)

        def run(batches):
            for batch in batches:
                for b in batch["id"]:
                    size = min(BLOCK, n - b * BLOCK)
                    values = np.asarray(draw(int(b), size))
                    yield pd.DataFrame({"lin": np.arange(b * BLOCK * width, b * BLOCK * width + size * width), "v": values.reshape(-1)})

        whole = (*shape, width) if width > 1 else shape
        flat = self.spark.range(count).repartition(max(1, count), "id").mapInPandas(run, f"lin bigint, v {kind}")
        return NdArray(flat.select(*unlinear(F.col("lin"), whole), "v"), whole)

    def random(self, size) -> NdArray:
        """Uniform in [0, 1), the values of numpy's own generator of that seed."""
        seed, bits = self.seed, self.bits

        def draw(block: int, n: int):
            stream = getattr(np.random, bits)(seed)
            return np.random.Generator(stream.advance(block * BLOCK) if block else stream).random(n)

        return self._blocks(size, draw, "double")

    def __getattr__(self, name: str):
        if name not in DISTRIBUTIONS and name not in ROWS:
            raise AttributeError(name)

        def call(*args, size, **kwargs) -> NdArray:
            seed, bits, number = self.seed, self.bits, self.calls

            def draw(block: int, n: int):
                stream = np.random.SeedSequence(seed, spawn_key=(number, block))
                return getattr(np.random.Generator(getattr(np.random, bits)(stream)), name)(*args, size=n, **kwargs)

            whole = name in ("integers", "poisson", "binomial", "negative_binomial", "geometric", "zipf", "logseries", "hypergeometric", "multinomial", "multivariate_hypergeometric")
            width = draw(0, 1).shape[-1] if name in ROWS else 1
            return self._blocks(size, draw, "bigint" if whole else "double", width)

        return call

    def bytes(self, length: int) -> bytes:
        return np.random.Generator(getattr(np.random, self.bits)(self.seed)).bytes(length)

    def permutation(self, a: NdArray | int, axis: int = 0) -> NdArray:
        """A shuffled copy: places in the order of a hash of seed and place."""
        from tessera.operators.array import arange

        a = arange(self.spark, a) if isinstance(a, int) else a
        self.calls += 1
        name = f"i{a.axis(axis)}"
        places = self.spark.range(a.shape[a.axis(axis)]).select(F.col("id").alias(name), F.xxhash64(F.lit(self.seed), F.lit(self.calls), "id").alias("_h"))
        new = dense_rank_positions(places, [F.col("_h"), F.col(name)]).select(name, "pos")
        return NdArray(a.cells.join(new, name).withColumn(name, F.col("pos")).select(*a.axes, "v"), a.shape)

    shuffle = permutation

    def permuted(self, a: NdArray, axis: int | None = None) -> NdArray:
        """Each lane shuffled on its own."""
        from pyspark.sql import Window

        from tessera.operators.array import ravel, reshape

        if axis is None:
            return reshape(self.permutation(ravel(a)), a.shape)
        name = f"i{a.axis(axis)}"
        lanes = [x for x in a.axes if x != name]
        self.calls += 1
        w = Window.partitionBy(*lanes).orderBy(F.xxhash64(F.lit(self.seed), F.lit(self.calls), *a.axes), name)
        return NdArray(a.cells.withColumn(name, F.row_number().over(w).cast("long") - 1), a.shape)

    def choice(self, a: NdArray | int, size: int, replace: bool = True) -> NdArray:
        from tessera.operators.array import arange

        a = arange(self.spark, a) if isinstance(a, int) else a
        if not replace:
            if size > a.size:
                raise ValueError("Cannot take a larger sample than population when replace is False")
            mixed = self.permutation(a)
            return NdArray(mixed.cells.where(F.col("i0") < size), (size,))
        return take(a, self.integers(0, a.size, size=size))


def default_rng(spark: SparkSession, seed: int = 0) -> Generator:
    return Generator(spark, seed)
