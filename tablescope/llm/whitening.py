"""Embedding whitening by the exact characteristic polynomial of the scatter.

Entries become integers, so the scatter n * sum(x x^T) - S S^T is an exact integer
matrix.  Its characteristic polynomial is computed modulo many primes by
reduction to Hessenberg form, primes dealt over tasks, and put together by
Chinese remainders.  The matrix is symmetric, so all roots are real, and the sign
changes of the shifted polynomial count the roots beyond a point exactly; roots
are isolated by that count and halved to many more bits than a double holds.
Components span the null space at a root and follow from inverse iteration with
integers of the same precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StructField, StructType

from tablescope.functions.session import stored

#: Grid of the integers: x = floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Bits to which a root is known beyond its leading one.
ROOT_BITS = 160
#: Binary places of the numbers in inverse iteration.
PLACES = 448
#: Rows whose products are summed at once.
ROWS = 8192
#: Bits of a limb in which integers travel between tasks.
LIMB = 40
_PRIME_TOP = (1 << 31) - 1
_BASES = (2, 3, 5, 7)


def usable(vectors: pa.Array, dims: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have only finite entries whose integers fit a long (and `dims` of them), and those entries as rows."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    flat = pc.fill_null(vectors.flatten().cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore"):
        bad = np.concatenate([[0], np.cumsum(~(np.abs(flat) < 2.0**62 / SCALE))])
    good = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - sizes]) & (sizes > 0)
    if dims is None:
        return good, sizes
    good &= sizes == dims
    return good, flat[np.repeat(good, sizes)].reshape(-1, dims)


def gridded(entries: np.ndarray) -> np.ndarray:
    """floor(SCALE * entry), without the offset: the scatter doesn't depend on it."""
    return np.floor(SCALE * entries).astype(np.int64)


def _products(x: np.ndarray) -> np.ndarray:
    """x^T x as exact integers."""
    most = int(np.abs(x).max(initial=0))
    if most * most * len(x) < 1 << 53:
        return (x.T.astype(float) @ x.astype(float)).astype(np.int64).astype(object)
    if most * most * len(x) < 1 << 63:
        return (x.T @ x).astype(object)
    return x.T.astype(object) @ x.astype(object)


def _limbs(value: int) -> list[int]:
    """Signed limbs of an integer, lowest first."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def scatter(vectors: DataFrame, column: str, dims: int) -> tuple[int, list[int], np.ndarray]:
    """Rows, sums of the gridded entries with offset, and n * sum(x x^T) - S S^T.

    Every task adds up its own rows; the sums of the tasks meet by place and limb.
    """

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums, total = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = gridded(usable(batch.column(0).slice(at, ROWS), dims)[1])
                rows += len(x)
                sums += x.astype(object).sum(0) if np.abs(x).max(initial=0) >= 1 << 48 else x.sum(0)
                total += _products(x)
        cells = [(0, 0, rows)] + [(1, i, v) for i, v in enumerate(sums)] + [(2 + i, j, total[i, j]) for i in range(dims) for j in range(i, dims)]
        flat = [(i, j, k, v) for i, j, value in cells for k, v in enumerate(_limbs(int(value)))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], pa.int64()) for i in range(4)], names=["i", "j", "k", "v"])

    parts = vectors.select(column).mapInArrow(summed, "i long, j long, k long, v long")
    rows, sums, total = 0, [0] * dims, np.zeros((dims, dims), object)
    for r in parts.groupBy("i", "j", "k").agg(F.sum("v").alias("v")).collect():
        value = r["v"] << (LIMB * r["k"]) if r["v"] >= 0 else -(-r["v"] << (LIMB * r["k"]))
        if r["i"] == 0:
            rows += value
        elif r["i"] == 1:
            sums[r["j"]] += value
        else:
            total[r["i"] - 2, r["j"]] += value
    upper = np.triu(total, 1)
    full = upper + upper.T + np.diag(np.diag(total))
    near = np.array(sums, object)
    return rows, [s + OFFSET * rows for s in sums], rows * full - np.outer(near, near)


def is_prime(n: int) -> bool:
    """Miller's test with bases that decide every number below 2 ** 31."""
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for base in _BASES:
        x = pow(base, d, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(r - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """Primes below 2 ** 31, falling, whose product has more than so many bits."""
    out, have, n = [], 0.0, _PRIME_TOP
    while have <= bits:
        if is_prime(n):
            out.append(n)
            have += math.log2(n)
        n -= 2
    return out


def characteristic(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - matrix) modulo a prime, constant term first."""
    h = np.array(matrix % p, dtype=np.int64)
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + int(below[0])
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        factors = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factors[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factors % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        # p_k = (x - h_kk) p_(k-1) - sum_i h_(k-i,k) * (product of subdiagonal entries) * p_(k-i-1)
        new = np.zeros(d + 1, np.int64)
        new[1:] = polys[k - 1, :-1]
        weights, product = np.zeros(k, np.int64), 1
        weights[k - 1] = h[k - 1, k - 1]
        for i in range(1, k):
            product = product * int(h[k - i, k - i - 1]) % p
            if not product:
                break
            weights[k - 1 - i] = int(h[k - 1 - i, k - 1]) * product % p
        polys[k] = (new - (weights[:, None] * polys[:k] % p).sum(0)) % p
    return polys[d].tolist()


def remaindered(residues: dict[int, list[int]]) -> list[int]:
    """Integers of least size with the given residues, by Garner's mixed digits."""
    moduli = sorted(residues)
    product, out = 1, [0] * len(residues[moduli[0]])
    for p in moduli:
        inverse = pow(product % p, -1, p)
        out = [v + product * ((r - v) * inverse % p) for v, r in zip(out, residues[p], strict=True)]
        product *= p
    return [v - product if v > product // 2 else v for v in out]


def polynomial(spark, matrix: np.ndarray) -> list[int]:
    """Characteristic polynomial of a positive semidefinite integer matrix; primes are dealt over tasks.

    A coefficient is a sum of products of roots, at most C(d, k) * (trace / d) ** k.
    """
    d, trace = len(matrix), int(np.trace(matrix))
    bits = max(math.comb(d, k).bit_length() + k * max(0, (trace // d + 1).bit_length()) for k in range(d + 1)) + 2
    wanted = primes(bits)
    sent = spark.sparkContext.broadcast([[int(v) for v in row] for row in matrix])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array(sent.value, object)
        for batch in batches:
            found = [characteristic(own, p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["p", "residues"])

    parts = min(len(wanted), 4 * spark.sparkContext.defaultParallelism)
    dealt = spark.createDataFrame([(p,) for p in wanted], "p long").repartition(parts, "p")
    return remaindered({r["p"]: r["residues"] for r in dealt.mapInArrow(run, "p long, residues array<long>").collect()})


class Roots:
    """Counts and isolates the roots of a polynomial that has only real, nonnegative ones."""

    def __init__(self, coefficients: list[int]) -> None:
        self.coefficients, self.degree = coefficients, len(coefficients) - 1
        top = max(-coefficients[self.degree - 1], 0) if self.degree else 0
        self.top = 1 << top.bit_length()  # beyond the sum of all roots

    def _scaled(self, places: int) -> list[int]:
        """Coefficients of the polynomial whose roots are 2 ** places times as large."""
        return [c << places * (self.degree - i) for i, c in enumerate(self.coefficients)]

    def beyond(self, at: int, places: int) -> int:
        """How many roots, with multiplicity, exceed at / 2 ** places: the sign changes of the shifted polynomial."""
        c = self._scaled(places)
        for i in range(self.degree):
            for j in range(self.degree - 1, i - 1, -1):
                c[j] += at * c[j + 1]
        signs = [v > 0 for v in c if v]
        return sum(a != b for a, b in zip(signs, signs[1:], strict=False))

    def _sign(self, at: int, places: int) -> int:
        value = 0
        for c in reversed(self._scaled(places)):
            value = value * at + c
        return (value > 0) - (value < 0)

    def largest(self, count: int) -> list[tuple[Fraction, int]]:
        """The largest positive roots, falling, as (value, multiplicity), until `count` are covered.

        Roots that agree in ROOT_BITS bits count as one root with their number
        as multiplicity.
        """
        out, covered = [], 0
        work = [(0, self.top, 0, self.beyond(0, 0), 0)]  # (low, high]: roots beyond low, beyond high
        while work and covered < count:
            low, high, places, over_low, over_high = work.pop()
            here = over_low - over_high
            if not here:
                continue
            narrow = (high - low) << ROOT_BITS <= high
            if here == 1 and not narrow and (found := self._halved(low, high, places)) is not None:
                out.append((found, 1))
                covered += 1
                continue
            if narrow:
                out.append((Fraction(low + high, 2 << places), here))
                covered += here
                continue
            if high - low == 1:
                low, high, places = 2 * low, 2 * high, places + 1
            middle = (low + high) // 2
            over = self.beyond(middle, places)
            work += [(low, middle, places, over_low, over), (middle, high, places, over, over_high)]
        return out

    def _halved(self, low: int, high: int, places: int) -> Fraction | None:
        """The single root in (low, high], by the sign of the polynomial alone."""
        sign = self._sign(high, places)
        if not sign:
            return Fraction(high, 1 << places)
        while (high - low) << ROOT_BITS > high:
            if high - low == 1:
                low, high, places = 2 * low, 2 * high, places + 1
            middle = (low + high) // 2
            now = self._sign(middle, places)
            if not now:
                return Fraction(middle, 1 << places)
            low, high = (low, middle) if now == sign else (middle, high)
        return Fraction(low + high, 2 << places)


def null_space(matrix: np.ndarray, root: Fraction, count: int) -> list[list[float]]:
    """Orthonormal vectors that span the null space of matrix - root, to double precision.

    The matrix is factored with complete pivoting in fixed point; the last
    `count` pivots vanish up to the error of the root and are replaced by one
    unit of the last place.  Inverse iteration then starts from unit vectors.
    """
    d = len(matrix)
    largest = max(1, max(abs(int(v)) for v in matrix.reshape(-1)))
    shift = PLACES - largest.bit_length()
    fixed = (lambda v: v << shift) if shift >= 0 else (lambda v: v >> -shift)
    a = np.array([[fixed(int(v)) for v in row] for row in matrix], object)
    move = root.numerator * (1 << max(shift, 0)) // (root.denominator << max(-shift, 0))
    for i in range(d):
        a[i, i] -= move
    rows, columns = list(range(d)), list(range(d))
    for k in range(d):
        size = np.abs(a[k:, k:])
        i, j = divmod(int(size.argmax()), d - k)
        if i:
            a[[k, k + i]] = a[[k + i, k]]
            rows[k], rows[k + i] = rows[k + i], rows[k]
        if j:
            a[:, [k, k + j]] = a[:, [k + j, k]]
            columns[k], columns[k + j] = columns[k + j], columns[k]
        if k >= d - count or not a[k, k]:
            a[k, k] = 1 if a[k, k] >= 0 else -1
            if k >= d - count:
                a[k, k + 1 :] = 0
                a[k + 1 :, k] = 0
                continue
        a[k + 1 :, k] = (a[k + 1 :, k] << PLACES) // a[k, k]
        a[k + 1 :, k + 1 :] -= (a[k + 1 :, k : k + 1] * a[k, k + 1 :]) >> PLACES

    def solved(b: np.ndarray) -> np.ndarray:
        y = b[rows]
        for k in range(d):
            y[k + 1 :] -= (a[k + 1 :, k] * y[k]) >> PLACES
        for k in range(d - 1, -1, -1):
            y[k] = (y[k] << PLACES) // a[k, k]
            y[:k] -= (a[:k, k] * y[k]) >> PLACES
        out = np.empty(d, object)
        out[columns] = y
        return out

    def unit(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        top = max(1, max(abs(int(x)) for x in v)).bit_length()
        v = np.array([int(x) << PLACES >> top for x in v], object)
        for _ in range(2):
            for o in others:
                v = v - ((o * (int((o * v).sum()) >> PLACES)) >> PLACES)
            norm = math.isqrt(int((v * v).sum()))
            v = np.array([(int(x) << PLACES) // norm for x in v], object)
        return v

    one, found = 1 << PLACES, []
    # the rows eliminated last are the ones the others don't determine
    for n in range(count):
        start = np.array([0] * d, object)
        start[rows[d - 1 - n]] = one
        v = unit(solved(start), found)
        found.append(unit(solved(v), found))
    out = []
    for v in found:
        peak = max(range(d), key=lambda i: (abs(int(v[i])), -i))
        out.append([float(Fraction(int(x) if v[peak] > 0 else -int(x), one)) for x in v])
    return out


def components(spark, matrix: np.ndarray, count: int) -> list[tuple[Fraction, list[float]]]:
    """(eigenvalue, unit eigenvector) of the largest positive eigenvalues, falling; one task per root."""
    trace = int(np.trace(matrix))
    if not trace:
        return []
    found = Roots(polynomial(spark, matrix)).largest(count)
    sent = spark.sparkContext.broadcast([[int(v) for v in row] for row in matrix])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array(sent.value, object)
        for batch in batches:
            for at, top, bottom, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                vectors = null_space(own, Fraction(int(top), int(bottom)), many)
                yield pa.RecordBatch.from_arrays([pa.array([at] * many), pa.array(range(many), pa.int64()), pa.array(vectors, pa.list_(pa.float64()))], names=["at", "nth", "vector"])

    tasks = [(n, str(root.numerator), str(root.denominator), many) for n, (root, many) in enumerate(found)]
    dealt = spark.createDataFrame(tasks, "at long, top string, bottom string, many long").repartition(max(1, len(tasks)), "at")
    rows = sorted(dealt.mapInArrow(run, "at long, nth long, vector array<double>").collect(), key=lambda r: (r["at"], r["nth"]))
    return [(found[r["at"]][0], r["vector"]) for r in rows][:count]


def whiten(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", count: int = 8) -> DataFrame:
    """Rows (id_col, component, n, deviation, whitened, explained, identity_error), one per vector and component.

    Vectors that are null, empty, or hold a null or non-finite entry (or one
    whose integer doesn't fit a long) are left out, as are those of another
    length than the most frequent one (of equally frequent ones the largest).  Repeated
    rows count as often as they occur, null ids are kept, other columns are
    ignored.  Only components with a positive eigenvalue exist, so equal vectors,
    a single one or an empty table give no rows.  `deviation` is a decimal, null
    from 10 ** 38 on.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType
    rows = vectors.select(F.col(f"`{id_col}`"), F.col(f"`{column}`"))

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, sizes = usable(batch.column(0), None)
            yield pa.RecordBatch.from_arrays([pa.array(sizes[good], pa.int64())], names=["dims"])

    lengths = rows.select(column).mapInArrow(measured, "dims long").groupBy("dims").count()
    usual = lengths.orderBy(F.desc("count"), F.desc("dims")).first()
    n, sums, matrix = scatter(rows, column, usual["dims"]) if usual else (0, [], np.zeros((0, 0), object))
    found = components(spark, matrix, count) if n else []
    trace = int(np.trace(matrix)) if n else 0
    near = [s - OFFSET * n for s in sums]
    basis = np.array([v for _, v in found])
    roots = np.array([math.sqrt(e / n**2) for e, _ in found])
    explained = [float(e / trace) for e, _ in found]
    made = StructType([StructField(id_col, kind), StructField("deviation", DecimalType(38, 0)), StructField("values", ArrayType(DoubleType()))])

    def projected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = len(near)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                good, entries = usable(part.column(1), dims)
                x = gridded(entries)
                most = n * int(np.abs(x).max(initial=0)) + max(map(abs, near))
                x = n * x - np.array(near, np.int64) if most < 1 << 62 else n * x.astype(object) - np.array(near, object)
                squares = (x * x).sum(1) if most * most * dims < 1 << 62 else (x.astype(object) ** 2).sum(1)
                exact = [int(v) if v < 10**38 else None for v in squares]
                values = (x.astype(float) / n) @ basis.T / roots
                ids = part.column(0).filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([ids, pa.array(exact, pa.decimal128(38, 0)), pa.array(list(values), pa.list_(pa.float64()))], names=made.names)

    if not found:
        empty = spark.createDataFrame([], made).select(id_col, F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), "deviation", F.lit(0.0).alias("whitened"))
        return empty.select("*", F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    held = stored(rows.mapInArrow(projected, made), "whitened")
    width = len(found)
    each = [F.col("values")[i] for i in range(width)]
    means = held.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(each)]).first()
    centred = held.select(*[(v - means[i]).alias(f"c{i}") for i, v in enumerate(each)])
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    sums_of = centred.agg(*[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{i}_{j}") for i, j in pairs]).first()
    error = max(abs(sums_of[f"s{i}_{j}"] / n - (i == j)) for i, j in pairs)
    shares = F.array(*[F.lit(e) for e in explained])
    return held.select(
        F.col(f"`{id_col}`"), F.posexplode("values").alias("at", "whitened"), "deviation",
    ).select(
        F.col(f"`{id_col}`"), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )
