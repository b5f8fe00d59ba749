"""Rigid and affine transforms as expressions, their comparison over points, and volumes carried from one grid to another.

A transform is an array of twelve numbers, three rows of four, that takes a point (an array of three) to another. Everything
is JVM-side: angles, composition and inverses are arithmetic on array elements, and a resampled volume is a higher-order function of
the source volume, row by row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import elastix_parameters, rotation_angle


def _at(m: Column, row: int, column: int) -> Column:
    return F.get(m, F.lit(4 * row + column))


def _flat(rows: Sequence[Sequence[Column]]) -> Column:
    return F.array(*[c.cast("double") for r in rows for c in r])


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value computed once, however often `of` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def rigid(angles: Sequence[Column], shift: Sequence[Column], centre: Sequence[Column]) -> Column:
    """The transform x -> R (x - centre) + centre + shift, with R a turn about y, then x, then z (radians)."""
    (cx, cy, cz), (sx, sy, sz) = ([f(a) for a in angles] for f in (F.cos, F.sin))
    turn = [
        [cz * cy - sz * sx * sy, -sz * cx, cz * sy + sz * sx * cy],
        [sz * cy + cz * sx * sy, cz * cx, sz * sy - cz * sx * cy],
        [-cx * sy, sx, cx * cy],
    ]
    offset = [c + t - sum((turn[i][j] * centre[j] for j in range(3)), F.lit(0.0)) for i, (c, t) in enumerate(zip(centre, shift, strict=True))]
    return _flat([[*row, o] for row, o in zip(turn, offset, strict=True)])


def applied(m: Column, point: Sequence[Column]) -> list[Column]:
    return [sum((_at(m, i, j) * point[j] for j in range(3)), _at(m, i, 3)) for i in range(3)]


def composed(second: Column, first: Column) -> Column:
    """First the one, then the other."""
    entry = lambda a, b, i, j: sum((_at(a, i, k) * _at(b, k, j) for k in range(3)), _at(a, i, 3) if j == 3 else F.lit(0.0))
    return let(second, lambda a: let(first, lambda b: _flat([[entry(a, b, i, j) for j in range(4)] for i in range(3)])))


def inverse(m: Column) -> Column:
    """The way back; null where a transform has none."""

    def cofactors(m: Column) -> Column:
        minor = lambda i, j: _at(m, (i + 1) % 3, (j + 1) % 3) * _at(m, (i + 2) % 3, (j + 2) % 3) - _at(m, (i + 1) % 3, (j + 2) % 3) * _at(m, (i + 2) % 3, (j + 1) % 3)
        return F.array(*[minor(j, i) for i in range(3) for j in range(3)])

    def back(m: Column, c: Column) -> Column:
        of = lambda i, j: F.get(c, F.lit(3 * i + j))
        size = sum((_at(m, 0, j) * of(j, 0) for j in range(3)), F.lit(0.0))
        rows = lambda d: _flat([[*[F.try_divide(of(i, j), d) for j in range(3)], -F.try_divide(sum((of(i, j) * _at(m, j, 3) for j in range(3)), F.lit(0.0)), d)] for i in range(3)])
        return let(size, lambda d: F.when(F.abs(d) > 0, rows(d)))

    return let(m, lambda m: let(cofactors(m), lambda c: back(m, c)))


def rigid_of_parameters(text: Column) -> Column:
    """The transform of a parameter text: three angles and three shifts, and the centre of the turn. A text that lacks one raises, with
    its name; a null text is null."""

    def numbers(name: str, n: int) -> list[Column]:
        found = elastix_parameters(text, name)
        whole = F.when(F.size(found) == n, found).otherwise(F.raise_error(F.concat(F.lit(f"{name} not found in "), F.substring(text, 1, 80))).cast("array<double>"))
        return [F.get(whole, F.lit(i)) for i in range(n)]

    p, c = numbers("TransformParameters", 6), numbers("CenterOfRotationPoint", 3)
    return F.when(text.isNotNull(), rigid(p[:3], p[3:], c))


def compared(pairs: DataFrame, keys: Sequence[str], ours: str, reference: str, points: DataFrame, places: int = 3) -> DataFrame:
    """keys, n, mean and largest distance between the images of the points, and the relative rotation (degrees).

    pairs: keys and two transforms, one row a case. points: keys, x, y, z. Parameters can't be compared, as they depend on a centre; images of
    the same points can. A case without points has nulls.
    """
    met = points.join(pairs, [*keys])
    a, b = (applied(F.col(m), [F.col(c) for c in "xyz"]) for m in (ours, reference))
    far = F.sqrt(sum(((p - q) ** 2 for p, q in zip(a, b, strict=True)), F.lit(0.0)))
    found = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(far), places).alias("disp_mean_mm"), F.round(F.max(far), places).alias("disp_max_mm"))
    angle = F.round(rotation_angle(F.col(ours), F.col(reference)), places).alias("rot_diff_deg")
    return pairs.select(*keys, angle).join(found, [*keys], "left").select(*keys, F.coalesce("n", F.lit(0).cast("long")).alias("n"), "disp_mean_mm", "disp_max_mm", "rot_diff_deg")


# -- resampling --------------------------------------------------------------------------------------------------------


def index_map(source: Column, target: Column, moved: Column | None = None) -> Column:
    """From a voxel of the target grid to the place in the source grid, both with their affines. moved: a transform of the
    target's millimetres to the source's, between the two."""
    there = target if moved is None else composed(moved, target)
    return composed(inverse(source), there)


def resampled(data: Column, shape: Sequence[int], places: Column, to: Sequence[int], nearest: bool = False, outside: float = 0.0) -> Column:
    """An array (x fastest) on a grid of shape `to`: at each voxel the source's value at its place (index_map), from the nearest voxel or
    the eight about it. Places outside the source get `outside`; a null array or map gives null. Memory is that of the two arrays
    and of a few numbers a voxel."""
    nx, ny, nz = shape
    mx, my, mz = to
    sizes = dict(zip("xyz", (nx, ny, nz), strict=True))
    hair = 1e-9  # a place on the last voxel's centre is inside; rounding may put it a hair beyond

    def place(m: Column, i: Column) -> Column:
        return F.struct(*[v.alias(a) for a, v in zip("xyz", applied(m, [i % mx, F.floor(i / mx) % my, F.floor(i / (mx * my))]), strict=True)])

    def read(v: Column, x: Column, y: Column, z: Column) -> Column:
        return F.get(v, (x + nx * (y + ny * z)).cast("int")).cast("double")

    def near(v: Column, p: Column) -> Column:
        at = {a: F.floor(p[a] + 0.5) for a in "xyz"}
        inside = (at["x"] >= 0) & (at["x"] < nx) & (at["y"] >= 0) & (at["y"] < ny) & (at["z"] >= 0) & (at["z"] < nz)
        return F.when(inside, read(v, at["x"], at["y"], at["z"])).otherwise(F.lit(float(outside)))

    def cell(p: Column) -> Column:
        """The voxel at or below a place on each axis, and how far beyond it the place is; null where it is outside."""
        inside, fields = F.lit(True), []
        for a, n in sizes.items():
            inside = inside & (p[a] >= -hair) & (p[a] <= n - 1 + hair)
            low = F.least(F.greatest(F.floor(p[a] + hair), F.lit(0)), F.lit(max(n - 2, 0)))
            fields += [low.alias(a), F.least(F.greatest(p[a] - low, F.lit(0.0)), F.lit(1.0)).alias(f"f{a}")]
        return F.when(inside, F.struct(*fields))

    def blend(v: Column, c: Column) -> Column:
        total = F.lit(0.0)
        for corner in range(8):
            up = {a: corner >> i & 1 for i, a in enumerate("xyz")}
            weight = F.lit(1.0)
            for a in "xyz":
                weight = weight * (c[f"f{a}"] if up[a] else 1 - c[f"f{a}"])
            value = read(v, *[F.least(c[a] + up[a], F.lit(n - 1)) for a, n in sizes.items()])
            total = total + weight * value
        return total

    every = F.sequence(F.lit(0), F.lit(mx * my * mz - 1))

    def made(m: Column, v: Column) -> Column:
        found = F.transform(every, lambda i: place(m, i))
        if nearest:
            return F.transform(found, lambda p: near(v, p))
        return F.transform(F.transform(found, cell), lambda c: F.when(c.isNull(), F.lit(float(outside))).otherwise(blend(v, c)))

    return F.when(data.isNotNull() & places.isNotNull(), let(places, lambda m: let(data, lambda v: made(m, v))))


def fraction_volume(data: Column, voxel_mm3: Column | float) -> Column:
    """Millilitres of a resampled mask: its fractions summed, so that half a voxel counts half."""
    return F.aggregate(data, F.lit(0.0), lambda a, x: a + x) * voxel_mm3 / 1000
