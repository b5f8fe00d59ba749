"""Stratified bootstrap of cells of any size, without ever having a cell in one place.

A resample draws as many rows of each stratum as it has, with replacement. How many of them fall into which part of the stratum
is multinomial, and so is a part's number over its rows. So a cell's rows are dealt to parts of about PART rows, and the
draws are dealt down a binary tree over the parts: at each node a binomial number goes to the left half. The generator of a node
is seeded by its name, so a task finds its part's numbers by walking from the root to it, without asking anyone, and draws inside
the part. What leaves a task are sums over the part for each draw, which add up over parts and strata.

This is the distribution of drawing from the whole stratum at once. With a single part it is that procedure itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

#: Rows of a part, about, and numbers that are drawn at once.
PART, DRAWN = 4096, 1 << 18


def cell_name(keys: Sequence[str]) -> Column:
    """The key values of a cell as one string that is never null."""
    return F.concat_ws("\x1f", F.lit("cell"), *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])


def hashed_parts(df: DataFrame, order: Sequence[str], part: int = PART) -> DataFrame:
    """Rows (_cell, ...) with _part and _levels, dealt by a hash of the order columns: the same whatever the partitioning."""
    sizes = df.groupBy("_cell").agg(F.greatest(F.ceil(F.count(F.lit(1)) / part), F.lit(1)).cast("long").alias("_parts"))
    met = df.join(sizes, "_cell").withColumn("_part", F.pmod(F.xxhash64(*order), F.col("_parts")))
    return met.withColumn("_levels", levels(F.col("_parts"))).drop("_parts")


def levels(parts: Column) -> Column:
    """Levels of a binary tree with so many leaves."""
    return F.ceil(F.log2(parts.cast("double")) - 1e-9).cast("int")


_NO_PATH = "cast(array() as array<struct<level int, n long, left long, right boolean>>)"


def paths(rows: DataFrame) -> DataFrame:
    """_cell, _s, _part, _path of rows (_cell, _s, _part, _levels, ...): from the root down, each node's rows, those of its left half,
    and whether the part is in the right one. Only numbers of rows are aggregated and joined; a cell of one part has no row."""
    parts = rows.where("_levels > 0").groupBy("_cell", "_s", "_part", "_levels").agg(F.count(F.lit(1)).alias("n"))
    deep = written(parts, "parts")  # read three times
    each = deep.select("_cell", "_s", "_part", "n", "_levels", F.explode(F.sequence(F.lit(0), F.col("_levels"))).alias("level"))
    each = each.withColumn("node", F.expr("shiftright(_part, _levels - level)"))
    nodes = each.groupBy("_cell", "_s", "level", "node").agg(F.sum("n").alias("n"))
    steps = each.where("level > 0").select("_cell", "_s", "_part", "level", (F.col("level") - 1).alias("up"), F.shiftright("node", 1).alias("parent"), (F.shiftright("node", 1) * 2).alias("first"), (F.col("node") % 2 == 1).alias("right"))
    above = nodes.select("_cell", "_s", F.col("level").alias("up"), F.col("node").alias("parent"), "n")
    beside = nodes.select("_cell", "_s", "level", F.col("node").alias("first"), F.col("n").alias("left"))
    met = steps.join(above, ["_cell", "_s", "up", "parent"]).join(beside, ["_cell", "_s", "level", "first"], "left")
    step = F.struct(F.col("level").cast("int").alias("level"), "n", F.coalesce("left", F.lit(0)).cast("long").alias("left"), "right")
    return met.groupBy("_cell", "_s", "_part").agg(F.array_sort(F.collect_list(step)).alias("_path"))  # a row a level


def with_paths(rows: DataFrame, walks: DataFrame | None = None) -> DataFrame:
    """Rows (_cell, _s, _part, _levels, ...) with their _path, of paths()."""
    walks = paths(rows) if walks is None else walks
    return rows.join(walks, ["_cell", "_s", "_part"], "left").withColumn("_path", F.coalesce("_path", F.expr(_NO_PATH)))


def _generator(seed: int, *name) -> np.random.Generator:
    return np.random.default_rng([seed, *(zlib.crc32(str(x).encode()) for x in name)])


def counts(cell: str, part: int, strata: Sequence[tuple[str, int, list]], n_boot: int, seed: int, drawn: int = DRAWN) -> Iterator[tuple[slice, np.ndarray]]:
    """(draws, how often each row of the part was drawn in each), a block of draws at a time. strata: (name, rows, path), in the
    order of the rows. Equal names give equal numbers."""
    plan = []
    for name, size, path in strata:
        at = np.full(n_boot, path[0]["n"] if len(path) else size, dtype=np.int64)
        for i, step in enumerate(path):
            node = part >> (len(path) - i)
            left = _generator(seed, cell, name, i, node).binomial(at, step["left"] / step["n"])
            at = at - left if step["right"] else left
        plan.append((size, at, _generator(seed, cell, name, "in", part)))
    rows = sum(size for size, _, _ in plan)
    block = max(1, drawn // max(rows, 1))
    for begin in range(0, n_boot, block):
        own, out = slice(begin, min(begin + block, n_boot)), []
        for size, at, rng in plan:
            n = own.stop - own.start
            which = np.repeat(np.arange(n) * size, at[own])
            which += rng.integers(0, size, len(which))
            out.append(np.bincount(which, minlength=n * size).reshape(n, size))
        yield own, np.concatenate(out, axis=1)


def strata_of(pdf: pd.DataFrame) -> list[tuple[str, int, list]]:
    """The strata of a part's rows, which are sorted by them."""
    return [(name, len(own), own["_path"].iloc[0]) for name, own in pdf.groupby("_s", sort=True)]


def draws(rows: DataFrame, order: Sequence[str], values: Sequence[str], n_boot: int, seed: int, by_part: bool = False, walks: DataFrame | None = None) -> DataFrame:
    """_cell, _draw, _n and the sum of each value column over each resample; by_part: those of each _part.

    rows: with_paths() rows, or rows without paths and walks, their paths(): a path is then told once to a part. In a task is one
    part of one cell, sorted by stratum and order first.
    """
    names = [*values]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return of(key, pdf, strata_of)

    def led(key: tuple, pdf: pd.DataFrame, walk: pd.DataFrame) -> pd.DataFrame:
        path = dict(zip(walk["_s"], walk["_path"], strict=True))
        return of(key, pdf, lambda p: [(name, len(own), path.get(name, [])) for name, own in p.groupby("_s", sort=True)])

    def of(key: tuple, pdf: pd.DataFrame, strata) -> pd.DataFrame:
        pdf = pdf.sort_values(["_s", *order])
        x = np.concatenate([pdf[names].to_numpy(dtype=float), np.ones((len(pdf), 1))], axis=1)
        sums = np.empty((n_boot, len(names) + 1))
        for own, c in counts(key[0], int(key[1]), strata(pdf), n_boot, seed):
            sums[own] = c @ x
        out = pd.DataFrame(sums[:, :-1], columns=names)
        return out.assign(_cell=key[0], _part=int(key[1]), _draw=np.arange(n_boot), _n=sums[:, -1].astype(np.int64))[["_cell", "_part", "_draw", "_n", *names]]

    schema = T.StructType.fromDDL("_cell string, _part long, _draw int, _n long")
    for v in names:
        schema = schema.add(v, T.DoubleType())
    columns = ["_cell", "_part", "_s", *dict.fromkeys([*order, *names])]
    if walks is None:
        made = rows.select(*columns, "_path").groupBy("_cell", "_part").applyInPandas(one, schema)
    else:
        made = rows.select(*columns).groupBy("_cell", "_part").cogroup(walks.groupBy("_cell", "_part")).applyInPandas(led, schema)
    return made if by_part else made.groupBy("_cell", "_draw").agg(F.sum("_n").alias("_n"), *[F.sum(v).alias(v) for v in names])


def few(table: DataFrame, most: int = 500_000) -> DataFrame:
    """A written table with a row a cell, told to every task where it has at most so many rows (counted first)."""
    return F.broadcast(table) if table.count() <= most else table


def stratum_sums(df: DataFrame, keys: Sequence[str], value: str, stratum: str | None, order: str, n_boot: int, seed: int, part: int = PART, together: Sequence[str] = ()) -> DataFrame:
    """keys, _s, _draw, _v, _n: the sum and number of each resample of each stratum of each cell, written. df: rows whose value isn't null.

    together: those of the keys (a metric, say) whose cells take the same draws where they have the same rows. Each cell's draws have
    the distribution they would have alone; rows that several cells share are drawn once for all of them.
    """
    own, many = [k for k in keys if k not in together], [k for k in keys if k in together]
    s = F.coalesce(F.col(stratum).cast("string"), F.lit("\x00")) if stratum else F.lit("")
    rows = df.select(*keys, s.alias("_stratum"), F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"))
    rows = rows.withColumns({"_cell": cell_name([*own, "_stratum"]), "_s": cell_name(many)})
    cells = written(rows.groupBy("_cell", "_s", "_stratum", *keys).agg(F.count(F.lit(1)).alias("_n")), "cells")
    sizes = cells.groupBy("_cell").agg(F.greatest(F.ceil(F.max("_n") / part), F.lit(1)).cast("long").alias("_parts"))
    # Rows that go together have to meet in one part: they are dealt by their order alone.
    at = F.xxhash64("_o") if many else F.xxhash64("_o", "_v")
    dealt = rows.select("_cell", "_s", "_o", "_v").join(few(sizes), "_cell").withColumns({"_part": F.pmod(at, F.col("_parts")), "_levels": levels(F.col("_parts"))}).drop("_parts")
    walks = written(paths(dealt), "paths")

    def one(key: tuple, pdf: pd.DataFrame, walk: pd.DataFrame) -> pd.DataFrame:
        path = dict(zip(walk["_s"], walk["_path"], strict=True))
        alike: dict[tuple, list] = {}  # rows and path -> the cells that have them
        for name, mine in pdf.sort_values(["_s", "_o", "_v"]).groupby("_s", sort=True):
            steps = path.get(name, [])
            told = (tuple((x["level"], x["n"], x["left"], x["right"]) for x in steps), mine["_o"].to_numpy().tobytes() if mine["_o"].dtype != object else tuple(mine["_o"]))
            alike.setdefault(told, []).append((name, steps, mine["_v"].to_numpy(dtype=float)))
        out = []
        for them in alike.values():
            x = np.stack([v for _, _, v in them], axis=1)
            sums = np.empty((n_boot, len(them)))
            for block, c in counts(key[0], int(key[1]), [("", len(x), them[0][1])], n_boot, seed):
                sums[block] = c @ x
            out += [(key[0], name, sums[:, i]) for i, (name, _, _) in enumerate(them)]
        return pd.DataFrame(out, columns=["_cell", "_s", "_sums"])

    made = dealt.select("_cell", "_part", "_s", "_o", "_v").groupBy("_cell", "_part").cogroup(walks.groupBy("_cell", "_part")).applyInPandas(one, "_cell string, _s string, _sums array<double>")
    drawn = made.select("_cell", "_s", F.posexplode("_sums").alias("_draw", "_v")).groupBy("_cell", "_s", "_draw").agg(F.sum("_v").alias("_v"))
    told = cells.withColumnsRenamed({"_stratum": "_in"})
    return written(drawn.join(told, ["_cell", "_s"]).select(*keys, F.col("_in").alias("_s"), "_draw", "_v", "_n"), "draws")


def means(df: DataFrame, keys: Sequence[str], value: str, stratum: str | None, order: str, n_boot: int, seed: int, part: int = PART, together: Sequence[str] = ()) -> DataFrame:
    """keys, _draw, _mean: the mean of each resample of each cell. df: rows whose value isn't null. together: see stratum_sums()."""
    made = stratum_sums(df, keys, value, stratum, order, n_boot, seed, part, together)
    return made.groupBy(*keys, "_draw").agg((F.sum("_v") / F.sum("_n")).alias("_mean"))


def intervals(made: DataFrame, keys: Sequence[str], **columns: Column | str) -> DataFrame:
    """keys, and <name>_from and <name>_to: the middle 95 % of each column over the draws; nulls are skipped."""
    q = {n: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975))) for n, c in columns.items()}
    found = made.groupBy(*keys).agg(*[x.alias(f"_{n}") for n, x in q.items()])
    return found.select(*keys, *[F.get(f"_{n}", F.lit(i)).alias(f"{n}_{end}") for n in columns for i, end in enumerate(("from", "to"))])


def order_statistics(rows: DataFrame, order: Sequence[str], value: str, found: DataFrame, ranks: DataFrame, n_boot: int, seed: int, walks: DataFrame | None = None) -> DataFrame:
    """_cell, _draw, _rank, value: the value at each rank (from 0) of each resample.

    rows: with_paths() rows (or walks apart, as in draws()) whose parts follow the order of the value in the cell. found: draws(by_part=True) of the same rows.
    ranks: _cell, _rank. What was drawn in the parts before tells which part of a draw holds a rank; only that part draws again, from
    the same generators, and finds it among its rows.
    """
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_cell", "_draw").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = found.select("_cell", "_part", "_draw", "_n", before.alias("_before")).join(ranks, "_cell")
    wanted = spans.where("_rank >= _before and _rank < _before + _n").select("_cell", "_part", "_draw", "_rank", (F.col("_rank") - F.col("_before")).alias("_within"))

    def one(key: tuple, pdf: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        columns = ["_cell", "_draw", "_rank", value]
        if want.empty or pdf.empty:
            return pd.DataFrame(columns=columns)
        pdf, want = pdf.sort_values(["_s", *order]), want.sort_values("_draw")
        x, draw, within = pdf[value].to_numpy(dtype=float), want["_draw"].to_numpy(), want["_within"].to_numpy()
        up, got = np.argsort(x, kind="stable"), np.empty(len(want))
        for own, c in counts(key[0], int(key[1]), strata_of(pdf), n_boot, seed):
            a, b = np.searchsorted(draw, [own.start, own.stop])
            if a < b:
                upto = np.cumsum(c[:, up], axis=1)
                for i in range(a, b):
                    got[i] = x[up[np.searchsorted(upto[draw[i] - own.start], within[i], side="right")]]
        return pd.DataFrame({"_cell": key[0], "_draw": draw, "_rank": want["_rank"].to_numpy(), value: got})[columns]

    if walks is not None:  # the few parts that hold a rank
        wanted = written(wanted, "wanted")
        rows = with_paths(rows.join(few(written(wanted.select("_cell", "_part").distinct(), "held")), ["_cell", "_part"], "left_semi"), walks)
    kept = rows.select("_cell", "_part", "_s", "_path", *dict.fromkeys([*order, value]))
    return kept.groupBy("_cell", "_part").cogroup(wanted.groupBy("_cell", "_part")).applyInPandas(one, f"_cell string, _draw int, _rank long, `{value}` double")
