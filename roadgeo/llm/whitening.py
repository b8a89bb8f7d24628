"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Components become whole numbers x = floor(64 * c) + 1000000. With n rows, sums S and y = x - m, m the rounded mean, the matrix
A = n * sum(y y') - sum(y) sum(y)' is whole and is n * n times the covariance, centred before multiplying.

Its characteristic polynomial is found exactly: modulo each of many primes, a row each, by reduction to Hessenberg form; the
residues of a coefficient meet in a group and give the coefficient by Chinese remaindering. All roots are real, so the signs of
the polynomial's coefficients about a point tell how many roots lie above it. Each component, a row again, halves its
interval by that count until it is alone in it, and by the sign of the polynomial to BITS bits below the trace. Components
that stay together to the last bit share an eigenvalue and form a group. A group's vectors come from the null space of
A - e: inverse iteration from as many starts as it has members, in decimal numbers of DIGITS digits, made orthonormal.
The matrix, its polynomial and the vectors are of the size of the dimensions alone, whatever the number of rows.

Cases. A vector that is null, or holds a null or a component that is not finite, is dropped. A null vec_id stays, and repeated rows
count each time. Shorter vectors count as filled up with zeros. Components of no variance have no whitened form and are left
out, so equal rows alone, or an empty table, give no rows. Equal eigenvalues: their vectors are one orthonormal choice, the
same for all rows. Components of 2**46 and beyond raise an error. Columns other than `vec_id` and `embedding` are not read.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgeo.llm.common import discard, staged

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
LARGEST = float(1 << 46)
#: Roots are found to 2**-BITS of the trace; vectors are computed with DIGITS digits, in ROUNDS steps of inverse iteration.
BITS, DIGITS, ROUNDS = 192, 150, 3
#: Sums of products below this are exact in floating point.
EXACT = 2.0**53


@dataclass
class Model:
    """What whitening needs: rows, rounded means, sums about them, vectors (component by dimension), eigenvalues, their share of the trace."""

    n: int
    middle: np.ndarray
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    shares: np.ndarray


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and x, of the rows that remain."""
    wide = lambda c: c.cast("double")
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(wide(c)) & (F.abs(wide(c)) < float("inf")))
    large = F.raise_error(F.lit("a component of 2**46 or more has no exact place in the scatter"))
    x = F.transform("embedding", lambda c: F.when(F.abs(wide(c)) < LARGEST, F.floor(wide(c) * SCALE).cast("bigint") + OFFSET).otherwise(large.cast("bigint")))
    return vectors.where(F.col("embedding").isNotNull() & finite).select("vec_id", x.alias("x"))


def _matrix(x: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of dims numbers, filled up with what a zero becomes."""
    lengths = np.diff(x.offsets.to_numpy())
    out = np.full((len(x), dims), OFFSET, np.int64)
    out[np.arange(dims) < lengths[:, None]] = x.flatten().to_numpy()
    return out


def _added(df: DataFrame, run, keys: list[str]) -> list[tuple]:
    """Exact sums of the values that `run` gives for each partition, by key. They number as the dimensions do."""
    schema = ", ".join(f"{k} int" for k in keys) + ", v decimal(38,0)"
    rows = df.mapInArrow(run, schema).groupBy(*keys).agg(F.sum("v").alias("v")).collect()
    return [tuple(r) for r in rows]


def _emit(columns: dict[str, np.ndarray], values: list[int]) -> pa.RecordBatch:
    with decimal.localcontext(prec=60):
        exact = pa.array([decimal.Decimal(v) for v in values], pa.decimal128(38, 0))
    return pa.RecordBatch.from_pydict({k: pa.array(c, pa.int32()) for k, c in columns.items()} | {"v": exact})


def sums(rows: DataFrame, dims: int) -> list[int]:
    """The sums of x by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, object)
        for batch in batches:
            x = _matrix(batch["x"], dims)
            small = not x.size or int(np.abs(x).max()) * len(x) < 1 << 63
            total += x.astype(np.int64 if small else object).sum(axis=0).astype(object)
        yield _emit({"i": np.arange(dims)}, total.tolist())

    return [int(v) for _, v in sorted(_added(rows.select("x"), run, ["i"]))]


def _products(y: np.ndarray) -> np.ndarray:
    """y' y, exact."""
    if y.size and float(np.abs(y).max()) ** 2 * len(y) < EXACT:
        return (y.T.astype(float) @ y.astype(float)).astype(np.int64).astype(object)
    # Two halves of 27 bits, and 256 rows at once: their sums of products stay below 2**63.
    low = y & (1 << 27) - 1
    high = (y - low) >> 27
    total = np.zeros((y.shape[1],) * 2, object)
    for i, a in enumerate((low, high)):
        for j, b in enumerate((low, high)):
            for row in range(0, len(y), 256):
                total += (a[row : row + 256].T @ b[row : row + 256]).astype(object) * (1 << 27 * (i + j))
    return total


def scatter(rows: DataFrame, n: int, totals: list[int]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """A, the rounded means, and the sums about them."""
    dims = len(totals)
    middle = np.array([(2 * s + n) // (2 * n) for s in totals], np.int64)
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for batch in batches:
            total += _products(_matrix(batch["x"], dims) - middle)
        yield _emit({"i": upper[0], "j": upper[1]}, total[upper].tolist())

    left = [s - n * int(m) for s, m in zip(totals, middle)]
    a = np.zeros((dims, dims), object)
    for i, j, v in _added(rows.select("x"), run, ["i", "j"]):
        a[i, j] = a[j, i] = n * int(v) - left[i] * left[j]
    return a, middle, left


def primes(enough: int) -> list[int]:
    """Primes below 2**31, the largest first, whose product exceeds `enough`."""
    found, product, p = [], 1, (1 << 31) + 1
    while product <= enough:
        p -= 2
        # Strong tests to these bases decide for all numbers of this size.
        if all(_passes(p, base) for base in (2, 3, 5, 7)):
            found.append(p)
            product *= p
    return found


def _passes(p: int, base: int) -> bool:
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    x = pow(base, odd, p)
    return x in (1, p - 1) or any((x := x * x % p) == p - 1 for _ in range(twos - 1))


def polynomial_mod(a: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - a) modulo p, the constant one first."""
    h, d = np.array(a % p, np.int64), len(a)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + int(below[0])
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    # det(t - leading block) of each size, from those of smaller size.
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for m in range(1, d + 1):
        row = np.zeros(d + 1, np.int64)
        row[1:] = minors[m - 1, :-1]
        row -= h[m - 1, m - 1] * minors[m - 1] % p
        chain = 1
        for i in range(m - 1, 0, -1):
            chain = chain * int(h[i, i - 1]) % p
            row -= int(h[i - 1, m - 1]) * chain % p * minors[i - 1] % p
        minors[m] = row % p
    return minors[d].tolist()


def polynomial(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Coefficients of det(t - A), the constant one first: a task takes some of the primes, and a coefficient's residues meet."""
    d, trace = len(a), int(np.trace(a))
    # The roots are not negative and sum up to the trace, so no coefficient exceeds that of d equal roots.
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    listed = spark.createDataFrame([(p,) for p in primes(2 * bound)], "p bigint").repartition(spark.sparkContext.defaultParallelism)

    def residues(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch["p"].tolist():
                yield pd.DataFrame({"p": p, "k": range(d + 1), "residue": polynomial_mod(a, p)})

    def remaindered(group: pd.DataFrame) -> pd.DataFrame:
        value, product = 0, 1
        for p, r in zip(group["p"].tolist(), group["residue"].tolist()):
            value += product * ((r - value) * pow(product, -1, p) % p)
            product *= p
        return pd.DataFrame({"k": [group["k"].iloc[0]], "value": [str(value if 2 * value <= product else value - product)]})

    found = listed.mapInPandas(residues, "p bigint, k int, residue bigint").groupBy("k").applyInPandas(remaindered, "k int, value string")
    return [int(r["value"]) for r in sorted(found.collect(), key=lambda r: r["k"])]


def above(poly: list[int], point: int) -> int:
    """How many roots exceed the point: the changes of sign among the coefficients of poly(t + point), as all roots are real."""
    c = poly[::-1]
    for end in range(len(c) - 1, 0, -1):
        for i in range(1, end + 1):
            c[i] += point * c[i - 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def root(poly: list[int], k: int, shift: int, most: int) -> tuple[int, int, int]:
    """The k-th largest root times 2**shift, as an interval (low, high] of length 1; and the number of the first root in it."""
    d = len(poly) - 1
    scaled = [c << shift * (d - i) for i, c in enumerate(poly)]
    low, high, first, last = 0, most << shift, 1, above(poly, 0)
    while high - low > 1:
        mid = (low + high) // 2
        if first == last:  # alone in its interval: the sign of the polynomial tells the side, as there are first - 1 roots above
            value = 0
            for c in reversed(scaled):
                value = value * mid + c
            exceeds = value != 0 and (value > 0) != ((first - 1) % 2 == 0)
        else:
            n = above(scaled, mid)
            exceeds = n >= k
            if exceeds:
                last = n
            else:
                first = n + 1
        low, high = (mid, high) if exceeds else (low, mid)
    return low, high, first


def null_space(a: np.ndarray, value: decimal.Decimal, size: int) -> np.ndarray:
    """`size` orthonormal vectors (by row) that A - value all but removes."""
    d = len(a)
    with decimal.localcontext(prec=DIGITS):
        lu = np.array([[decimal.Decimal(int(x)) for x in row] for row in a], object)
        lu[np.arange(d), np.arange(d)] -= value
        order, least = np.arange(d), max(value, decimal.Decimal(1)).scaleb(-DIGITS // 2)
        for c in range(d):
            pivot = c + int(np.argmax(np.abs(lu[c:, c])))
            lu[[c, pivot]], order[[c, pivot]] = lu[[pivot, c]], order[[pivot, c]]
            if abs(lu[c, c]) < least:
                lu[c, c] = least
            lu[c + 1 :, c] /= lu[c, c]
            lu[c + 1 :, c + 1 :] -= np.multiply.outer(lu[c + 1 :, c], lu[c, c + 1 :])
        # Any start will do that does not lie across the null space.
        rng = np.random.default_rng(size)
        found = [np.array([decimal.Decimal(int(x)) for x in rng.integers(-(10**6), 10**6, d)], object) for _ in range(size)]
        for _ in range(ROUNDS):
            for k, b in enumerate(found):
                x = b[order]
                for c in range(d):
                    x[c + 1 :] -= lu[c + 1 :, c] * x[c]
                for c in reversed(range(d)):
                    x[c] /= lu[c, c]
                    x[:c] -= lu[:c, c] * x[c]
                for _ in range(2):
                    for other in found[:k]:
                        x = x - other * (other * x).sum()
                    x = x / (x * x).sum().sqrt()
                found[k] = x
        return np.array([[float(v) for v in x] for x in found])


def fit(rows: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of whole vectors; None where there is no variance."""
    spark = rows.sparkSession
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims")).first()
    n, dims = size["n"], size["dims"] or 0
    if not dims:
        return None
    a, middle, left = scatter(rows, n, sums(rows, dims))
    trace = int(np.trace(a))
    if not trace:
        return None
    poly = polynomial(spark, a)
    rank = dims - next(i for i, c in enumerate(poly) if c)
    shift = max(0, BITS - trace.bit_length())

    def roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["component"].tolist():
                low, high, first = root(poly, k, shift, trace + 1)
                yield pd.DataFrame({"first": [first], "component": [k], "value": [str(low + high)]})

    def vectors(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("component")
        with decimal.localcontext(prec=DIGITS):
            value = decimal.Decimal(int(group["value"].iloc[0])) / (1 << shift + 1)
        found = null_space(a, value, len(group))
        return pd.DataFrame({"component": group["component"], "value": float(value / n / n), "share": float(value / trace), "vector": list(found)})

    wanted = spark.range(1, min(components, rank) + 1).select(F.col("id").cast("int").alias("component"))
    isolated = staged(wanted.repartition(min(components, rank), "component").mapInPandas(roots, "first int, component int, value string"), "whitening-roots")
    found = isolated.groupBy("first").applyInPandas(vectors, "component int, value double, share double, vector array<double>")
    model = sorted(found.collect(), key=lambda r: r["component"])
    discard(isolated)
    return Model(n, middle, left, np.array([r["vector"] for r in model]), np.array([r["value"] for r in model]), np.array([r["share"] for r in model]))


def project(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The exact deviation of each row, and its whitened components."""
    y = x - model.middle
    widest = (int(np.abs(y).max()) if y.size else 0) * model.n + max(map(abs, model.sums))
    number = np.int64 if widest**2 * y.shape[1] < 1 << 63 else object
    centred = y.astype(number) * model.n - np.array(model.sums, number)
    return (centred * centred).sum(axis=1), (centred.astype(float) / model.n) @ model.vectors.T / np.sqrt(model.values)


def identity_error(rows: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity. A partition's products are taken about
    its own means; those of all partitions are brought together by their means' distances from the mean of all."""
    dims, upper = len(model.middle), np.triu_indices(len(model.values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, w = project(_matrix(batch["x"], dims), model)
                mean = w.mean(axis=0)
                own = (w - mean).T @ (w - mean)
                yield pa.RecordBatch.from_pydict({
                    "i": pa.array(upper[0], pa.int32()), "j": pa.array(upper[1], pa.int32()), "n": pa.array(np.full(len(upper[0]), len(w)), pa.int64()),
                    "products": own[upper], "a": mean[upper[0]], "b": mean[upper[1]]})

    parts = rows.select("x").mapInArrow(run, "i int, j int, n bigint, products double, a double, b double").groupBy("i", "j")
    total = parts.agg(
        F.sum(F.col("products") + F.col("n") * F.col("a") * F.col("b")).alias("products"),
        F.sum(F.col("n") * F.col("a")).alias("a"), F.sum(F.col("n") * F.col("b")).alias("b"))
    entry = (F.col("products") - F.col("a") * F.col("b") / model.n) / model.n
    return total.agg(F.max(F.abs(entry - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).first()[0]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each remaining row and component."""
    rows = whole_vectors(vectors)
    model = fit(rows, components)
    schema = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error, dims, k = identity_error(rows, model), len(model.middle), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            deviation, w = project(_matrix(batch["x"], dims), model)
            with decimal.localcontext(prec=60):
                exact = pa.array([decimal.Decimal(int(v)) for v in deviation], pa.decimal128(38, 0))
            row = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch["vec_id"].take(row), "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), "n": pa.array(np.full(m * k, model.n), pa.int64()),
                "deviation": exact.take(row), "whitened": w.ravel(), "explained": np.tile(model.shares, m), "identity_error": np.full(m * k, error)})

    return rows.select(F.col("vec_id").cast("bigint"), "x").mapInArrow(run, schema)
