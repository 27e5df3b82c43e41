"""Block bootstraps by slices of a sample: no task holds a cell's sample.

A cell's values are packed in order into pieces, one row each, and the pieces are
counted along the cell. Slices of SLICE block starts are put together from the
pieces that hold their values and those that their last blocks reach. Within a
slice values are summed along, so that a block's sum is the difference of two
sums. Which blocks a round takes comes from a generator of counters: the number of
(round, block) is mixed to 31 bits, so that any task draws any part of any round,
again and again alike. A task has a slice and a share of the rounds, of about DRAWS
draws; it draws those rounds and adds the blocks that begin in its slice. Draws are
never rows: only the sums of (cell, slice, round) leave the tasks. A share takes a
copy of the slice, so that there are at most SHARES of them: what is moved stays in
proportion to the values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidebar.functions.selection import met
from tidebar.functions.shared import kept
from tidebar.params import BOOTSTRAP_ROUNDS, BOOTSTRAP_SEED

#: Steps of the order that one piece of a cell's values spans.
PIECE = 1 << 16
#: Block starts of one slice of a cell, draws of one task, draws made at once, and most shares of a cell's rounds.
SLICE, DRAWS, AT_ONCE, SHARES = 1 << 22, 1 << 28, 1 << 15, 4
#: The generator: products of 31-bit numbers stay below 2^62.
MODULUS, FIRST, SECOND, ADDED = 2147483647, 1103515245, 1588635695, 12345
#: Beyond the number of any block.
APART = 1000000007
LEVELS = (0.025, 0.975)


def block_length(n: str) -> str:
    """SQL: the cube root of a sample's size, 10 at least."""
    return f"greatest(10, cast(round(pow({n}, 1D / 3)) as bigint))"


def _folded(x: np.ndarray, spare: np.ndarray) -> None:
    """x %= MODULUS, by the quotient: numpy divides by a constant much faster than it takes a remainder."""
    np.floor_divide(x, MODULUS, out=spare)
    spare *= MODULUS
    x -= spare


def mixed(x: np.ndarray, spare: np.ndarray | None = None) -> np.ndarray:
    """x, numbers from 0 below 2^31 or so, mixed to 31 bits in place, in two steps of a product and a folded shift."""
    spare = np.empty_like(x) if spare is None else spare
    for factor, shift in ((FIRST, 15), (SECOND, 13)):
        x *= factor
        x += ADDED
        _folded(x, spare)
        np.right_shift(x, shift, out=spare)
        x ^= spare
    return x


def _drawn(values: np.ndarray, begin: int, n: int, length: int, own: int, turns: np.ndarray, size: int, at_once: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each round: the sum of its whole blocks that begin in the slice of values from place begin on, and of its filling part."""
    sums = np.concatenate([[0.0], np.cumsum(values)])
    whole, rest = divmod(n, length)
    k, here = np.arange(whole + (rest > 0)), min(size, n - length + 1 - begin)
    full, part = np.zeros(len(turns)), np.zeros(len(turns))
    u = mixed(own + turns)
    v = mixed(u + APART)
    rows, columns = max(1, at_once // len(k)), min(len(k), at_once)
    ahead, alone = sums[length:], here == n - length + 1
    for i in range(0, len(turns), rows):
        for j in range(0, len(k), columns):
            some = k[j : j + columns]
            at = u[i : i + rows, None] + some
            spare = np.empty_like(at)
            mixed(at, spare)
            at ^= v[i : i + rows, None]
            mixed(at, spare)
            at *= n - length + 1
            at >>= 31
            at -= begin
            blocks = int(np.searchsorted(some, whole))
            last, at = at[:, blocks:], at[:, :blocks]
            if alone:
                full[i : i + rows] += (ahead.take(at) - sums.take(at)).sum(axis=1)
            else:
                turn, place = np.nonzero((at >= 0) & (at < here))
                at = at[turn, place]
                full[i : i + rows] += np.bincount(turn, weights=ahead.take(at) - sums.take(at), minlength=len(last))
            if last.size:  # the last one fills the sample up
                last = last[:, 0]
                there = (last >= 0) & (last < here)
                last = np.where(there, last, 0)
                part[i : i + rows] += (sums[last + rest] - sums[last]) * there
    return full, part


def sample(df: DataFrame, by: list[str], value: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pieces of the values in order: by, _start, _n, _values; the cells: by, n, total, length), without unknown values. Pieces are written, as they are read more than once."""
    rest, span = [c for c in order[:-1] if c not in by], order[-1]
    x = df.where(F.col(value).isNotNull()).select(*by, *rest, span, F.expr(f"{span} div {PIECE}").alias("_piece"), F.col(value).cast("double").alias("_x"))
    group = [*by, *rest, "_piece"]
    schema = T.StructType([x.schema[c] for c in group] + [T.StructField("_n", T.LongType()), T.StructField("_total", T.DoubleType()), T.StructField("_values", T.BinaryType())])

    def packed(part: pa.Table) -> pa.Table:
        values = part.sort_by(span)["_x"].to_numpy()
        own = [pa.array([len(values)]), pa.array([float(values.sum())]), pa.array([values.tobytes()], pa.binary())]
        return pa.table([*part.select(group).slice(0, 1).columns, *own], names=schema.names)

    pieces = kept(x.groupBy(*group).applyInArrow(packed, schema), "sample")
    cells = pieces.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_total").alias("total")).withColumn("length", F.expr(block_length("n")))
    # where pieces start comes from their counts alone, one short row a piece
    earlier = Window.partitionBy(*by).orderBy(*rest, "_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(*group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    placed = met(pieces.select(*group, "_n", "_values"), starts, group).select(*by, "_start", "_n", "_values")
    return placed, kept(cells.withColumn("_cell", F.monotonically_increasing_id()), "cells")


def rounds(values: DataFrame, cells: DataFrame, by: list[str], stream: Column | None = None, times: int = BOOTSTRAP_ROUNDS, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """by, n, round, blocks, moving: a round's mean of floor(n / length) whole blocks, and with the part that fills it up to n values. Cells of fewer than two blocks have none.

    stream: a number that gives cells draws of their own; else all cells of one size draw alike.
    """
    own = ((stream if stream is not None else F.lit(0)) + seed).cast("long") % MODULUS
    some = cells.where("n >= 2 * length").withColumn("_own", own)
    shares = F.expr(f"least({times}, {SHARES}, cast(ceil({times}D * (n div length + 1) / {DRAWS}) as bigint))")
    at = met(values, some.withColumn("_shares", shares), by).select("_cell", "n", "length", "_own", "_shares", "_start", "_n", "_values")
    at = at.withColumn("_slice", F.explode(F.expr(f"sequence(greatest(0, _start - length + 1) div {SLICE}, least(_start + _n - 1, n - length) div {SLICE})")))
    at = at.withColumn("_share", F.explode(F.expr("sequence(0L, _shares - 1)")))

    def drawn(part: pa.Table) -> pa.Table:
        cell, n, length, own, shares, at, share = (part[c][0].as_py() for c in ("_cell", "n", "length", "_own", "_shares", "_slice", "_share"))
        starts, packs = part["_start"].to_numpy(), part["_values"]
        in_order = np.argsort(starts)
        values = np.concatenate([np.frombuffer(packs[int(i)].as_buffer(), dtype=np.float64) for i in in_order])
        skipped = at * size - int(starts[in_order[0]])
        turns = np.arange(share * times // shares, (share + 1) * times // shares)
        full, rest = _drawn(values[skipped : skipped + size + length - 1], at * size, n, length, own, turns, size, at_once)
        return pa.table({"_cell": np.full(len(turns), cell), "round": turns, "_s": full, "_p": rest})

    size, at_once = SLICE, AT_ONCE  # as they are when the plan is made
    made = at.groupBy("_cell", "_slice", "_share").applyInArrow(drawn, "_cell long, round long, _s double, _p double")
    sums = made.groupBy("_cell", "round").agg(F.sum("_s").alias("_s"), F.sum("_p").alias("_p")).join(some, "_cell")
    return sums.select(*by, "n", "round", (F.col("_s") / (F.expr("n div length") * F.col("length"))).alias("blocks"), ((F.col("_s") + F.col("_p")) / F.col("n")).alias("moving"))


def interval(means: DataFrame, by: list[str], mean: Column) -> DataFrame:
    """by, ci_low, ci_high: of the rounds' means."""
    low, high = (F.percentile(mean, F.lit(x)) for x in LEVELS)
    return means.groupBy(*by).agg(low.alias("ci_low"), high.alias("ci_high"))
