"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

1. *Integers.* Entries become x = floor(1024 c) + 100000. Tasks add up x - 100000 and its products without rounding; a sum
   for each pair of dimensions leaves a task. n * sum(x x') - S S', the scatter, is n squared times the covariance.
2. *Polynomial.* Modulo each of enough primes below 2^31 the scatter is brought to Hessenberg form and its characteristic
   polynomial read off, a task a prime. Chinese remainders give the integer coefficients: their product of primes exceeds
   what the trace allows any of them.
3. *Roots.* All roots are real, so the signs of the polynomial's coefficients about a point count the roots above it
   (Descartes' rule is exact then). Halving, in integers scaled by 2^SCALE, isolates the largest roots and narrows each to
   2^-PRECISION of itself; roots still together then are one of that multiplicity.
4. *Components.* The matrix less a root is factored once, in decimals of DIGITS digits, and solved for a start vector
   until it no longer turns: the null space. A root of multiplicity m gives m vectors, each kept orthogonal to the others.

The driver holds numbers in proportion to the square of the dimension, never to the rows. The work grows with the fourth
power of the dimension; it is meant for up to a few hundred.

Defined cases: rows whose vector is null or holds a null or non-finite entry are dropped; shorter vectors count as followed
by zeros up to the longest; entries beyond 2^40 in amount count as that; repeated rows count each; an eigenvalue of 0 has no
whitened component and gives no rows, so a single vector, equal vectors and an empty table give none; a deviation beyond
64 bits is null; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keydrift.llm import tables

COMPONENTS = 8
OFFSET = 100_000
SCALE = 160
PRECISION = 90
DIGITS = 80
#: Below this, sums of products of doubles are exact.
EXACT = 1 << 53


# ---------------------------------------------------------------- integers


def integers(vectors: Column) -> Column:
    """x - OFFSET of each entry; entries are finite."""
    bound = float(1 << 50)
    return F.transform(vectors, lambda c: F.floor(F.greatest(F.least(c.cast("double") * 1024, F.lit(bound)), F.lit(-bound))))


def usable(vectors: Column) -> Column:
    bad = F.exists(vectors, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _rectangle(values: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as a matrix; shorter rows are followed by zeros."""
    sizes = np.diff(values.offsets.to_numpy())
    width = int(sizes.max(initial=0)) if width is None else width
    out = np.zeros((len(values), width), np.int64)
    flat = values.flatten().to_numpy()
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, total): sums of products of a task's rows; i = -1 has the sums, and (-1, -1) the rows."""
    n, sums, products = 0, np.zeros(0, object), np.zeros((0, 0), object)
    for batch in batches:
        y = _rectangle(batch.column("y"))
        d = y.shape[1]
        if d > len(sums):
            wider, square = np.full(d, 0, object), np.full((d, d), 0, object)
            wider[: len(sums)], square[: len(sums), : len(sums)] = sums, products
            sums, products = wider, square
        largest = int(abs(y).max(initial=0))
        rows = max(1, EXACT // max(1, largest * largest))
        for k in range(0, len(y), rows):
            part = y[k : k + rows]
            # doubles multiply exactly while no sum passes 2^53; a single row beyond that is multiplied as integers
            exact = part.astype(float) if largest * largest < EXACT else part.astype(object)
            found = exact.T @ exact
            products[:d, :d] += found.astype(np.int64).astype(object) if found.dtype != object else found
            sums[:d] += part.astype(object).sum(axis=0)
        n += len(y)
    i, j = np.triu_indices(len(sums))
    rows = [(-1, -1, n), *((-1, int(k), int(s)) for k, s in enumerate(sums)), *((int(a), int(b), int(products[a, b])) for a, b in zip(i, j, strict=True))]
    columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([str(r[2]) for r in rows])]
    yield pa.RecordBatch.from_arrays(columns, ["i", "j", "total"])


def scatter(rows: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums of each dimension of ``y``, and n * sum(y y') - sum(y) sum(y)', all exact."""
    parts = rows.select("y").mapInArrow(_moments, "i int, j int, total string")
    totals = {(r["i"], r["j"]): int(r["total"]) for r in parts.groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    n = totals.get((-1, -1), 0)
    d = sum(i == -1 for i, _ in totals) - 1
    sums = [totals[-1, k] for k in range(d)]
    return n, sums, [[n * totals[min(a, b), max(a, b)] - sums[a] * sums[b] for b in range(d)] for a in range(d)]


# ---------------------------------------------------------------- polynomial


def _is_prime(n: int) -> bool:
    """Miller and Rabin's test, certain below 3.2e9 with these bases."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The largest primes below 2^31 whose product exceeds the bound."""
    found, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """The coefficients, constant first, of det(t - matrix) modulo p, by way of a similar Hessenberg matrix."""
    a, d = matrix.copy() % p, len(matrix)
    for m in range(1, d - 1):
        below = np.flatnonzero(a[m:, m - 1])
        if not len(below):
            continue
        k = m + int(below[0])
        if k != m:
            a[[m, k]] = a[[k, m]]
            a[:, [m, k]] = a[:, [k, m]]
        u = a[m + 1 :, m - 1] * pow(int(a[m, m - 1]), -1, p) % p
        a[m + 1 :] = (a[m + 1 :] - u[:, None] * a[m] % p) % p
        a[:, m] = (a[:, m] + (a[:, m + 1 :] * u % p).sum(axis=1)) % p
    found = [np.array([1], np.int64)]
    for k in range(d):
        following = np.zeros(k + 2, np.int64)
        following[1:] = found[k]
        following[:-1] = (following[:-1] - a[k, k] * found[k]) % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(a[i + 1, i]) % p
            if not chain:
                break
            following[: i + 1] = (following[: i + 1] - int(a[i, k]) * chain % p * found[i]) % p
        found.append(following)
    return found[d] % p


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """The integer coefficients of det(t - matrix), constant first, of a positive semidefinite integer matrix."""
    d, trace = len(matrix), sum(matrix[k][k] for k in range(len(matrix)))
    # the sum of products of k eigenvalues is largest where all are equal
    bound = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_beyond(bound)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for p in batch.column("p").to_pylist():
                reduced = np.array([[v % p for v in row] for row in matrix], np.int64)
                found.append(polynomial_modulo(reduced, p).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array(found, pa.list_(pa.int64()))], ["p", "residues"])

    listed = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), spark.sparkContext.defaultParallelism))
    product = 1
    for p in primes:
        product *= p
    out = [0] * (d + 1)
    for r in listed.mapInArrow(residues, "p long, residues array<long>").collect():
        share = product // r["p"]
        share *= pow(share, -1, r["p"])
        for k, value in enumerate(r["residues"]):
            # signs alternate: taken off, all are in [0, product)
            out[k] += (value if (d - k) % 2 == 0 else -value) % r["p"] * share
    return [v % product * (1 if (d - k) % 2 == 0 else -1) for k, v in enumerate(out)]


# ---------------------------------------------------------------- roots


def _value(poly: list[int], t: int) -> int:
    out = 0
    for c in reversed(poly):
        out = out * t + c
    return out


def roots_above(poly: list[int], t: int) -> int:
    """How many roots, of a polynomial with real roots only, are greater than t."""
    shifted = poly[::-1]
    d = len(poly) - 1
    for k in range(d):
        for i in range(1, d + 1 - k):
            shifted[i] += t * shifted[i - 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def largest_roots(poly: list[int], most: int, scale: int = SCALE, precision: int = PRECISION) -> list[tuple[int, int]]:
    """(root times 2^scale, multiplicity) of the largest positive roots, falling, until ``most`` are counted."""
    d = len(poly) - 1
    scaled = [c << (scale * (d - k)) for k, c in enumerate(poly)]
    positive = roots_above(scaled, 0)
    trace = -scaled[d - 1] if d else 0
    found: list[tuple[int, int]] = []
    wanted = min(most, positive)
    # intervals (low, high] with their counts above low and above high, the highest on top
    todo = [(0, trace + 1, positive, 0)]
    while todo and sum(m for _, m in found) < wanted:
        low, high, above_low, above_high = todo.pop()
        if above_high >= wanted or above_low == above_high:
            continue
        if high - low <= max(1, high >> precision):
            found.append((high, above_low - above_high))
            continue
        if above_low - above_high == 1:
            # alone: the sign changes at the root
            sign = _value(scaled, high) > 0
            if _value(scaled, high) == 0:
                found.append((high, 1))
                continue
            while high - low > max(1, high >> precision):
                middle = (low + high) // 2
                v = _value(scaled, middle)
                if v == 0:
                    low = high = middle
                elif (v > 0) == sign:
                    high = middle
                else:
                    low = middle
            found.append((high, 1))
            continue
        middle = (low + high) // 2
        above = roots_above(scaled, middle)
        todo += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return found


# ---------------------------------------------------------------- components


def null_vectors(matrix: list[list[int]], root: int, m: int, scale: int = SCALE) -> list[list[Decimal]]:
    """m orthogonal unit vectors that matrix - root / 2^scale all but takes to zero."""
    with localcontext() as context:
        context.prec = DIGITS
        d = len(matrix)
        shift = Decimal(root) / (1 << scale)
        a = [[Decimal(v) - (shift if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
        least = max(abs(v) for row in a for v in row) * Decimal(10) ** -(DIGITS - 10) or Decimal(1)
        order = list(range(d))
        for k in range(d):
            top = max(range(k, d), key=lambda i: abs(a[i][k]))
            a[k], a[top] = a[top], a[k]
            order[k], order[top] = order[top], order[k]
            if abs(a[k][k]) < least:
                a[k][k] = least
            for i in range(k + 1, d):
                if a[i][k]:
                    f = a[i][k] = a[i][k] / a[k][k]
                    row, pivot = a[i], a[k]
                    for j in range(k + 1, d):
                        row[j] -= f * pivot[j]

        def solved(b: list[Decimal]) -> list[Decimal]:
            x = [b[i] for i in order]
            for i in range(d):
                x[i] -= sum((a[i][j] * x[j] for j in range(i)), Decimal(0))
            for i in range(d - 1, -1, -1):
                x[i] = (x[i] - sum((a[i][j] * x[j] for j in range(i + 1, d)), Decimal(0))) / a[i][i]
            return x

        found: list[list[Decimal]] = []
        for turn in range(m):
            v = [Decimal((k * 7919 + turn * 104729) % 101 - 50) + Decimal(1) / 3 for k in range(d)]
            for _ in range(4):
                v = solved(v)
                for _ in range(2):
                    for other in found:
                        along = sum((p * q for p, q in zip(v, other, strict=True)), Decimal(0))
                        v = [p - along * q for p, q in zip(v, other, strict=True)]
                size = sum((p * p for p in v), Decimal(0)).sqrt()
                v = [p / size for p in v]
            found.append(v)
        return found


class Whitening:
    """What is learnt of the vectors: ``n``, ``sums`` of x - OFFSET, and for each component its unit vector, the square
    root of its eigenvalue and its share of the variance."""

    def __init__(self, rows: DataFrame, components: int = COMPONENTS) -> None:
        self.n, self.sums, matrix = scatter(rows)
        trace = sum(matrix[k][k] for k in range(len(matrix)))
        self.vectors: list[list[float]] = []
        self.deviations: list[float] = []
        self.explained: list[float] = []
        if not trace:
            return
        wanted = min(components, len(matrix))
        for root, m in largest_roots(characteristic(rows.sparkSession, matrix), wanted):
            for v in null_vectors(matrix, root, min(m, wanted - len(self.vectors))):
                with localcontext() as context:
                    context.prec = DIGITS
                    eigenvalue = Decimal(root) / (1 << SCALE)
                    self.deviations.append(float(eigenvalue.sqrt() / self.n))
                    self.explained.append(float(eigenvalue / trace))
                self.vectors.append([float(x) for x in v])

    def projected(self, rows: DataFrame, key: str = "vec_id") -> DataFrame:
        """key, deviation and the array ``w`` of whitened components of every row."""
        n, sums, d = self.n, self.sums, len(self.sums)
        turn = np.array(self.vectors, float).reshape(len(self.vectors), d).T / np.array(self.deviations, float)
        largest_sum = max(map(abs, sums), default=0)

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y = _rectangle(batch.column("y"), d)
                bound = n * int(abs(y).max(initial=0)) + largest_sum
                # in 64 bits where the squares' sum is sure to fit, else in integers of any size
                kind = np.int64 if bound * bound * max(1, d) < 1 << 63 else object
                off = y.astype(kind) * n - np.array(sums, kind)
                squares = [int(s) for s in (off * off).sum(axis=1)]
                w = (off / n).astype(float) @ turn
                columns = [
                    batch.column(key), pa.array([s if s < 1 << 63 else None for s in squares], pa.int64()),
                    pa.array(list(w), pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, "deviation", "w"])

        kind = rows.schema[key].dataType.simpleString()
        return rows.select(key, "y").mapInArrow(project, f"`{key}` {kind}, deviation long, w array<double>")


def identity_error(projected: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of ``w`` less the identity; two passes, means first."""
    if not k:
        return 0.0
    means = projected.select(*(F.avg(F.col("w")[i]) for i in range(k))).first()
    centred = projected.select(*((F.col("w")[i] - F.lit(means[i])).alias(f"w{i}") for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = centred.select(*(F.avg(F.col(f"w{i}") * F.col(f"w{j}")) for i, j in pairs)).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True))


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error."""
    kept = vectors.select(F.col(f"`{key}`").alias(key), F.col(f"`{vector}`").alias("v")).where(usable(F.col("v")))
    rows = kept.select(key, integers(F.col("v")).alias("y"))
    fitted = Whitening(rows, components)
    k = len(fitted.vectors)
    projected = tables.stored(fitted.projected(rows, key))
    error = identity_error(projected, k)
    explained = F.array(*map(F.lit, fitted.explained)) if k else F.array().cast("array<double>")
    return projected.select(key, "deviation", F.posexplode("w").alias("_k", "whitened")).select(
        key, (F.col("_k") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("_k")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(tables.table(spark, sf_dir, "embeddings"))
