"""Column functions: names, paths, guarded arithmetic, transforms, array masks. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_if_nan(c: Column) -> Column:
    """NaN to null, so aggregates skip it as they skip a missing value."""
    return F.when(~F.isnan(c), c)


def sanitize(path: Column) -> Column:
    """Every path part with spaces as _ and one trailing dot as _."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.regexp_replace(F.translate(p, " ", "_"), r"\.$", "_")), "/")


def subject_id(number: Column) -> Column:
    return F.format_string("sub-%03d", number.cast("int"))


def case_id(subject: Column) -> Column:
    """sub-000 -> WMH_000: what follows the first dash."""
    return F.concat(F.lit("WMH_"), F.regexp_replace(subject, "^[^-]*-", ""))


def named(template: str, **parts: Column) -> Column:
    """A template with every {part} in its place: named("{id}_{kind}.nii.gz", id=..., kind=...). Null where a part is null."""
    pieces = [F.lit(text) if i % 2 == 0 else parts[text].cast("string") for i, text in enumerate(re.split(r"\{(\w+)\}", template))]
    return F.concat(*pieces)


def observer_code(name: Column) -> Column:
    return F.upper(F.regexp_replace(name, "^observer_", ""))


def geometry(values: Column, fmt: str = "%.2f") -> Column:
    """Numbers as text joined by x: 0.96x0.96x3.00."""
    return F.array_join(F.transform(values, lambda v: F.format_string(fmt, v)), "x")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def corrected(raw: Column, bias: Column) -> Column:
    """raw / bias where bias is positive, else 0."""
    return F.when(bias > 0, F.try_divide(raw, bias)).otherwise(F.lit(0.0))


def on_scale(c: Column, kind: str) -> Column:
    """log: ln, null at 0 and below; log1p; anything else: as it is."""
    return {"log": F.when(c > 0, F.ln(c)), "log1p": F.when(c > -1, F.log1p(c))}.get(kind, c)


def from_scale(c: Column, kind: str) -> Column:
    """Only log is undone."""
    return F.exp(c) if kind == "log" else c


def even_round(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def without_label(mask: Column, labels: Column, label: float = 2.0) -> Column:
    """A boolean mask where the label map has another label."""
    return F.zip_with(mask, labels, lambda m, r: m & (r != label))


def with_ignored(labels: Column, reference: Column, label: float = 2.0) -> Column:
    """labels, but `label` wherever the reference has it."""
    return F.zip_with(labels, reference, lambda v, r: F.when(r == label, r).otherwise(v))


def truth_mask(v: Column) -> Column:
    return (v >= 0.5) & (v <= 1.5)


def ignored_mask(v: Column) -> Column:
    return (v >= 1.5) & (v <= 2.5)


def prediction_mask(v: Column, reference: Column, integer: bool) -> Column:
    """v as a mask (integers from 1, reals from 0.5) outside the reference's ignored region."""
    return (v >= (1 if integer else 0.5)) & ~ignored_mask(reference)


def voxel_volume(spacing: Column) -> Column:
    """The product of the first three spacings."""
    return F.aggregate(F.slice(spacing, 1, 3), F.lit(1.0), lambda a, x: a * x)


def same_grid(shape_a: Column, affine_a: Column, shape_b: Column, affine_b: Column, atol: float = 1e-3, rtol: float = 1e-5) -> Column:
    """Equal shapes and affines within atol + rtol * |b|."""
    near = F.zip_with(affine_a, affine_b, lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y))
    return (shape_a == shape_b) & F.forall(near, lambda ok: ok)


def valid_labels(values: Column, allowed: list[float], atol: float = 1e-3) -> Column:
    """Whether all values are finite, whole within atol, and allowed; -0 is 0."""
    whole = F.forall(values, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")) & (F.abs(v - F.rint(v)) <= atol))
    known = F.size(F.array_except(F.array_distinct(F.transform(values, lambda v: F.rint(v) + 0.0)), F.array(*[F.lit(float(a)) for a in allowed]))) == 0
    return F.when(whole, known).otherwise(F.lit(False))


def offending_values(values: Column, allowed: list[float], atol: float = 1e-3, fractions: int = 5, unknown: int = 10) -> Column:
    """What valid_labels objects to, as a struct: n_not_finite, n_fractional, and examples of each, smallest first and each once: up to
    so many fractional values, and whole ones that aren't allowed. A null array gives a null; a null in it counts as not finite."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    told = F.filter(values, finite)
    apart = F.filter(told, lambda v: F.abs(v - F.rint(v)) > atol)
    # Adding 0 makes -0 and 0 one value.
    whole = F.transform(F.filter(told, lambda v: F.abs(v - F.rint(v)) <= atol), lambda v: F.rint(v) + 0.0)
    other = F.array_except(whole, F.array(*[F.lit(float(a)) for a in allowed]))
    first = lambda a, n: F.slice(F.array_sort(F.array_distinct(a)), 1, n)
    found = F.struct(
        (F.size(values) - F.size(told)).cast("long").alias("n_not_finite"), F.size(apart).cast("long").alias("n_fractional"),
        first(apart, fractions).alias("fractional"), first(other, unknown).alias("unknown"),
    )
    return F.when(values.isNotNull(), found)


def case_problem(same: Column, found: Column) -> Column:
    """grid, not finite, fractional or unknown labels: the first that a case with same_grid() and offending_values() has; null without."""
    return F.when(~F.coalesce(same, F.lit(False)), "grid").when(found.isNull(), "no labels").when(found["n_not_finite"] > 0, "not finite").when(found["n_fractional"] > 0, "fractional labels").when(F.size(found["unknown"]) > 0, "unknown labels")


def first_match(*cases: tuple[Column, str], otherwise: str) -> Column:
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def qc_class(max_z: Column, forest: Column, assessed: Column, check: float = 3.0, exclude: float = 5.0) -> Column:
    """not_assessed, exclude (z >= exclude), check (z >= check, or the forest says so), usable: the first that holds."""
    return first_match((~assessed, "not_assessed"), (max_z >= exclude, "exclude"), ((max_z >= check) | forest, "check"), otherwise="usable")


def registration_flag(shift: Column, rotation: Column, correlation: Column, override: Column, most_shift: float = 10.0, most_rotation: float = 10.0, least_correlation: float = 0.5) -> Column:
    return ~override & ((shift > most_shift) | (rotation > most_rotation) | (correlation < least_correlation))


def brain_flag(volume: Column, largest_share: Column, low: float = 900.0, high: float = 2200.0, least_share: float = 0.99) -> Column:
    return ~volume.between(low, high) | (largest_share < least_share)


def has_problem(*checks: Column) -> Column:
    """Not all checks hold; a missing one counts as failed."""
    out = checks[0]
    for c in checks[1:]:
        out = out & c
    return ~F.coalesce(out, F.lit(False))


def displacement(a: Column, b: Column, point: Column) -> Column:
    """Distance between a point's images under two affines (arrays of 12: three rows of four)."""
    image = lambda m, row: F.get(m, F.lit(4 * row)) * point[0] + F.get(m, F.lit(4 * row + 1)) * point[1] + F.get(m, F.lit(4 * row + 2)) * point[2] + F.get(m, F.lit(4 * row + 3))
    return F.sqrt(sum(((image(a, r) - image(b, r)) ** 2 for r in range(3)), F.lit(0.0)))


def rotation_angle(a: Column, b: Column) -> Column:
    """Degrees of the rotation that takes the rotation part of a to that of b."""
    trace = sum((F.get(a, F.lit(4 * i + j)) * F.get(b, F.lit(4 * i + j)) for i in range(3) for j in range(3)), F.lit(0.0))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def elastix_parameters(text: Column, name: str) -> Column:
    """The numbers of `(name v1 v2 ...)` in an elastix parameter text; null where it is absent."""
    found = F.regexp_extract(text, rf"\({name}\s+([^)]*)\)", 1)
    return F.when(found != "", F.transform(F.split(F.trim(found), r"\s+"), lambda x: x.cast("double")))


def utc_stamp(ts: Column) -> Column:
    """ISO 8601 to the second, for a session in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


# The published coefficients of Wichura's AS 241 (numerator, denominator), for the middle, the tails, the far tails.
QUANTILE_MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
QUANTILE_TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
QUANTILE_FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def with_normal_quantiles(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the standard normal's quantile of each column, by its name, for 0 < p < 1; in the JVM. In steps, so that what the
    polynomials share is computed once and generated code stays short."""
    parts = df.withColumns({f"__p_{n}": c for n, c in columns.items()})
    parts = parts.withColumns({f"__r_{n}": F.sqrt(-F.log(F.least(F.col(f"__p_{n}"), 1 - F.col(f"__p_{n}")))) for n in columns})
    made = parts.withColumns({n: _normal_quantile(F.col(f"__p_{n}"), F.col(f"__r_{n}")) for n in columns})
    return made.drop(*[f"__{x}_{n}" for n in columns for x in "pr"])


def _normal_quantile(p: Column, r: Column) -> Column:

    def ratio(coefficients, t: Column) -> Column:
        top, bottom = (F.lit(c[-1]) for c in coefficients)
        for a, b in zip(*(reversed(c[:-1]) for c in coefficients), strict=True):
            top, bottom = top * t + a, bottom * t + b
        return top / bottom

    q = p - 0.5
    tail = F.when(r <= 5, ratio(QUANTILE_TAIL, r - 1.6)).otherwise(ratio(QUANTILE_FAR, r - 5))
    return F.when(F.abs(q) <= 0.425, q * ratio(QUANTILE_MIDDLE, 0.180625 - q * q)).otherwise(F.signum(q) * tail)


def normal_quantile_sql(p: str) -> str:
    """The same as an SQL expression."""

    def ratio(coefficients, t: str) -> str:
        top, bottom = (repr(c[-1]) for c in coefficients)
        for a, b in zip(*(reversed(c[:-1]) for c in coefficients), strict=True):
            top, bottom = f"({top} * {t} + {a!r})", f"({bottom} * {t} + {b!r})"
        return f"{top} / {bottom}"

    q, r = f"({p} - 0.5e0)", f"sqrt(-ln(least({p}, 1 - {p})))"
    return f"CASE WHEN abs{q} <= 0.425e0 THEN {q} * {ratio(QUANTILE_MIDDLE, f'(0.180625e0 - {q} * {q})')} WHEN {r} <= 5 THEN sign{q} * {ratio(QUANTILE_TAIL, f'({r} - 1.6e0)')} ELSE sign{q} * {ratio(QUANTILE_FAR, f'({r} - 5)')} END"
