"""Small vectors and matrices as lists of columns.

A vector is a Python list of columns (or numbers), so every operation is one Catalyst
expression inside whole-stage codegen. ``unpack`` opens an array column, ``pack`` closes it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Vector(list):
    """Columns of a vector; ``array`` is the array column they were read from, if there is one."""

    def __init__(self, items=(), array: Column | None = None):
        super().__init__(items)
        self.array = array


def let(x: Column, *steps) -> Column:
    """steps[-1](... steps[0](x)), each step's argument computed once.

    Without this, an expression that uses its argument several times repeats it, and
    chains of such expressions grow exponentially.
    """
    for step in steps:
        x = F.get(F.transform(F.array(x), step), F.lit(0))
    return x


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def unpack(array: Column | str, n: int, start: int = 0) -> Vector:
    """Elements ``start`` to ``start + n - 1`` of an array column; null behind its end."""
    return Vector((F.get(col(array), F.lit(start + i)) for i in range(n)), col(array) if start == 0 else None)


def packed(x, n: int | None = None) -> Column:
    """An array column of a vector's elements; the one it was read from, if there is one."""
    if isinstance(x, (Column, str)):
        return col(x)
    if n is not None and len(x) != n:
        raise ValueError(f"{n} components are needed, not {len(x)}")
    return x.array if isinstance(x, Vector) and x.array is not None else F.array(*(col(v) for v in x))


def vector(x, n: int) -> Vector:
    """A list of columns from a list, an array column or its name."""
    if isinstance(x, (list, tuple, np.ndarray)):
        if len(x) != n:
            raise ValueError(f"{n} components are needed, not {len(x)}")
        return x if isinstance(x, Vector) else Vector(col(v) for v in x)
    return unpack(x, n)


def pack(v: Sequence) -> Column:
    return F.array(*(col(x) for x in v))


def add(a: Sequence, b: Sequence) -> Vector:
    return [col(x) + col(y) for x, y in zip(a, b, strict=True)]


def subtract(a: Sequence, b: Sequence) -> Vector:
    return [col(x) - col(y) for x, y in zip(a, b, strict=True)]


def scale(a: Sequence, k) -> Vector:
    return [col(x) * col(k) for x in a]


def dot(a: Sequence, b: Sequence) -> Column:
    terms = [col(x) * col(y) for x, y in zip(a, b, strict=True)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def cross(a: Sequence, b: Sequence) -> Vector:
    a, b = [col(x) for x in a], [col(x) for x in b]
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Sequence) -> Column:
    return F.sqrt(dot(a, a))


def matrix(m, rows: int, columns: int) -> list[Vector]:
    """A matrix of literals or columns, checked for its shape; an array column is read row by row."""
    if isinstance(m, (Column, str)):
        flat = unpack(m, rows * columns)
        return [flat[r * columns : (r + 1) * columns] for r in range(rows)]
    if len(m) != rows or any(len(r) != columns for r in m):
        raise ValueError(f"a {rows}x{columns} matrix is needed")
    return [[col(x) for x in r] for r in m]


def transform4(transform) -> list[Vector]:
    """The upper three rows of a rigid transform given as 3x3, 3x4 or 4x4 numbers, or as an array column of 16."""
    if isinstance(transform, (Column, str)):
        return matrix(transform, 4, 4)[:3]
    t = np.asarray(transform, float)
    if t.shape == (3, 3):
        t = np.hstack([t, np.zeros((3, 1))])
    if t.shape not in ((3, 4), (4, 4)):
        raise ValueError("a transform is 3x3, 3x4 or 4x4")
    return [[F.lit(float(x)) for x in row] for row in t[:3]]


def times(m: Sequence[Sequence], v: Sequence) -> Vector:
    return [dot(row, v) for row in m]


def product(a: Sequence[Sequence], b: Sequence[Sequence]) -> list[Vector]:
    return [[dot(row, [r[j] for r in b]) for j in range(len(b[0]))] for row in a]


def transposed(m: Sequence[Sequence]) -> list[Vector]:
    return [list(x) for x in zip(*m)]


def is_finite(*xs) -> Column:
    """True where all are numbers; comparisons with NaN hold in Spark, so they are guarded by this."""
    out = F.lit(True)
    for x in xs:
        c = col(x)
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return out


def between(x, low, high) -> Column:
    """low <= x <= high, false for NaN and null; a None bound is open."""
    c = col(x)
    out = c.isNotNull() & ~F.isnan(c)
    if low is not None:
        out = out & (c >= col(low))
    if high is not None:
        out = out & (c <= col(high))
    return out


def deviate(seed: int | None, *place) -> Column:
    """A standard normal deviate from hashes of a place, by the Box-Muller rule: the same place has the same one each time."""
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(0 if seed is None else int(seed)), F.lit(k), *map(col, place)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.ln(unit(0))) * F.cos(2 * np.pi * unit(1))
