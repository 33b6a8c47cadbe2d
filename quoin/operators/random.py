"""Random arrays. Each block of places has its own jump of one PCG64 stream, so that a seed gives the same
array whatever the partitioning."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..darray import DArray, as_darray, unravel
from ..session import spark

BLOCK = 1 << 16
#: Distributions of numpy.random.Generator, and whether their values are whole numbers.
DISTRIBUTIONS = {
    "random": False, "uniform": False, "normal": False, "beta": False, "binomial": True, "chisquare": False, "exponential": False, "f": False, "gamma": False,
    "geometric": True, "gumbel": False, "hypergeometric": True, "integers": True, "laplace": False, "logistic": False, "lognormal": False, "logseries": True,
    "negative_binomial": True, "noncentral_chisquare": False, "noncentral_f": False, "pareto": False, "poisson": True, "power": False, "rayleigh": False,
    "standard_cauchy": False, "standard_normal": False, "standard_t": False, "triangular": False, "vonmises": False, "wald": False, "weibull": False, "zipf": True,
}


class RandomState:
    def __init__(self, seed: int = 0):
        self.seed(seed)

    def seed(self, seed: int) -> None:
        self._seed, self._calls = seed, 0

    def draw(self, name: str, shape, *args, **kwargs) -> DArray:
        shape = (shape,) if isinstance(shape, int) else tuple(shape)
        size, whole = math.prod(shape), DISTRIBUTIONS[name]
        key, self._calls = np.random.SeedSequence([self._seed, self._calls]), self._calls + 1

        def run(batches):
            at, drawn = -1, None
            for pdf in batches:
                ids = pdf["id"].to_numpy()
                for block in np.unique(ids // BLOCK):
                    if block != at:
                        n = min(BLOCK, size - int(block) * BLOCK)
                        rng = np.random.Generator(np.random.PCG64(key).jumped(int(block)))
                        at, drawn = block, np.asarray(getattr(rng, name)(*args, **kwargs, size=n), np.int64 if whole else float)
                    mine = ids[ids // BLOCK == block]
                    yield pd.DataFrame({"p": mine, "v": drawn[mine - block * BLOCK]})

        # A range of places and not of blocks: Spark takes the draw for as large as it is, and sends it to no driver for a join.
        df = spark().range(size).mapInPandas(run, f"p bigint, v {'bigint' if whole else 'double'}")
        return DArray(df.select(*unravel(F.col("p"), shape), "v"), shape)

    def random_sample(self, size=1) -> DArray:
        return self.draw("random", size)

    def rand(self, *shape) -> DArray:
        return self.draw("random", shape)

    def randn(self, *shape) -> DArray:
        return self.draw("standard_normal", shape)

    def randint(self, low: int, high: int | None = None, size=1) -> DArray:
        low, high = (0, low) if high is None else (low, high)
        return self.draw("integers", size, low, high)

    def permutation(self, x) -> DArray:
        """A shuffled range or the rows of an array in shuffled order: a sort by random keys."""
        from .scan import argsort
        from .select import take

        n = x if isinstance(x, int) else x.shape[0]
        order = argsort(self.draw("random", n))
        return order if isinstance(x, int) else take(x, order, 0)

    def shuffle_rows(self, *arrays: DArray) -> list[DArray]:
        from .select import take

        order = self.permutation(arrays[0].shape[0]).touch()
        return [take(as_darray(a), order, 0) for a in arrays]

    def train_test_split(self, *arrays: DArray, test_size: float | int | None = None, train_size: float | int | None = None, shuffle: bool = True) -> list[DArray]:
        """Train and test parts of each array, by the same rows."""
        from .select import getitem

        n = arrays[0].shape[0]
        count = lambda s: s if isinstance(s, int) else math.ceil(n * s)
        test = count(test_size) if test_size is not None else n - count(train_size) if train_size is not None else math.ceil(n * 0.25)
        mixed = self.shuffle_rows(*arrays) if shuffle else arrays
        return [part for a in mixed for part in (getitem(a, slice(0, n - test)), getitem(a, slice(n - test, n)))]


def _method(name: str):
    def draw(self, *args, shape=None, **kwargs) -> DArray:
        return self.draw(name, 1 if shape is None else shape, *args, **kwargs)

    return draw


for _name in DISTRIBUTIONS:
    setattr(RandomState, _name, _method(_name))

default = RandomState()
