"""Running composition over ordered rows: moving averages, automata and last-seen rows without a group in one place.

Each row is an element of a monoid, an affine map or a transition table for example, kept as an array of fixed width.
Rows are dealt by ranges of (key, order), so a key may span any number of partitions and a partition hold any number of
keys.  A task composes the rows of each of its keys by doubling, batch by batch.  Only the key that lies across a
boundary needs more: one row a partition says what its last key amounts to, these rows are folded in order, and a
partition's first key gets what came before it.  The rows move once.

Defined cases: null keys are one key, null order values come first; rows with equal key and order are taken in any
order, so the order columns should tell rows apart; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import kept


@dataclass(frozen=True)
class Monoid:
    """Elements are rows of a matrix of ``width`` columns."""

    width: int

    kind = "double"

    def identity(self) -> np.ndarray:
        raise NotImplementedError

    def then(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row by row, ``a`` first and ``b`` after it."""
        raise NotImplementedError

    def column(self, a: Column, b: Column) -> Column:
        """The same of two array columns."""
        raise NotImplementedError


class Affine(Monoid):
    """x -> a x + b as (a, b)."""

    def __init__(self) -> None:
        super().__init__(2)

    def identity(self) -> np.ndarray:
        return np.array([1.0, 0.0])

    def then(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack((b[:, 0] * a[:, 0], b[:, 0] * a[:, 1] + b[:, 1]), axis=1)

    def column(self, a: Column, b: Column) -> Column:
        return F.array(b[0] * a[0], b[0] * a[1] + b[1])


class Transitions(Monoid):
    """The state that follows each of ``width`` states."""

    kind = "bigint"

    def identity(self) -> np.ndarray:
        return np.arange(self.width)

    def then(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.take_along_axis(b, a, axis=1)

    def column(self, a: Column, b: Column) -> Column:
        return F.transform(a, lambda s: F.get(b, s.cast("int")))


class Latest(Monoid):
    """The latest value of each of ``width`` slots; -1 where there was none."""

    kind = "bigint"

    def identity(self) -> np.ndarray:
        return np.full(self.width, -1)

    def then(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(b >= 0, b, a)

    def column(self, a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.when(y >= 0, y).otherwise(x))


class Chains(Monoid):
    """For each of ``kinds`` slots the citations that its latest row leads through, as (slot, root, rows, mask).

    ``slot``: whose row before these the first of them cites (-1: none); ``root``: the first of them, -1 if there are
    none, ``rows`` their number, ``mask`` all their masks or-ed.
    """

    kind = "bigint"

    def __init__(self, kinds: int):
        super().__init__(4 * kinds)
        self.kinds = kinds

    def identity(self) -> np.ndarray:
        out = np.zeros((self.kinds, 4), np.int64)
        out[:, 0], out[:, 1] = np.arange(self.kinds), -1
        return out.ravel()

    def then(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.reshape(-1, self.kinds, 4), b.reshape(-1, self.kinds, 4)
        slot = b[:, :, 0]
        x = np.take_along_axis(a, np.maximum(slot, 0)[:, :, None], axis=1)
        x = np.where((slot < 0)[:, :, None], [-1, -1, 0, 0], x)
        root = np.where(x[:, :, 1] >= 0, x[:, :, 1], b[:, :, 1])
        return np.stack((x[:, :, 0], root, x[:, :, 2] + b[:, :, 2], x[:, :, 3] | b[:, :, 3]), axis=2).reshape(-1, self.width)

    def column(self, a: Column, b: Column) -> Column:
        out = []
        for k in range(self.kinds):
            slot, root, rows, mask = (b[4 * k + i] for i in range(4))
            at = (F.greatest(slot, F.lit(0)) * 4).cast("int")
            x = [F.when(slot < 0, F.lit(none)).otherwise(F.get(a, at + i)) for i, none in enumerate((-1, -1, 0, 0))]
            out += [x[0], F.when(x[1] >= 0, x[1]).otherwise(root), x[2] + rows, x[3].bitwiseOR(mask)]
        return F.array(*out)


def composed(values: np.ndarray, fresh: np.ndarray, monoid: Monoid) -> np.ndarray:
    """Each row after all rows of its segment up to it; a segment begins where ``fresh``."""
    out = values.copy()
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
    place = np.arange(len(fresh)) - first
    step = 1
    while step <= place.max(initial=0):
        at = np.flatnonzero(place >= step)
        out[at] = monoid.then(out[at - step], out[at])
        step *= 2
    return out


def _changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether each row's key differs from that of the row before it (the first one: no)."""
    out = np.zeros(batch.num_rows, bool)
    for k in keys:
        a, b = batch.column(k).slice(0, batch.num_rows - 1), batch.column(k).slice(1)
        same = pc.fill_null(pc.equal(a, b), False)
        out[1:] |= ~pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return out


def _local(monoid: Monoid, keys: list[str]):
    """Adds ``__before``, what came before a row in its key and partition, its ``__seq`` and whether its key is the first."""
    dtype = np.float64 if monoid.kind == "double" else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, carry, seq, first = None, monoid.identity().astype(dtype), 0, True
        for b in batches:
            if not b.num_rows:
                continue
            values = b.column("__element").flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, monoid.width)
            fresh = _changes(b, keys)
            key = tuple(b.column(k)[0].as_py() for k in keys)
            fresh[0] = last_key is None or key != last_key
            if seq and fresh[0]:
                first = False
            start = monoid.identity().astype(dtype) if fresh[0] else carry
            opened = fresh.copy()
            opened[0] = True
            head = values[:1].copy()
            values = values.copy()
            values[:1] = monoid.then(start[None, :], head)
            after = composed(values, opened, monoid)
            before = np.concatenate((start[None, :], after[:-1]))
            before[1:][fresh[1:]] = monoid.identity()
            later = np.cumsum(np.concatenate(([False], fresh[1:]))) > 0
            firsts = np.zeros(b.num_rows, bool) if not first else ~later
            flat = pa.array(before.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, monoid.width, dtype=np.int32)), flat)
            rows = pa.array(np.arange(seq, seq + b.num_rows))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, rows, pa.array(firsts)], names=[*b.schema.names, "__before", "__seq", "__first"])
            last_key, carry, seq = tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys), after[-1], seq + b.num_rows
            first = bool(firsts[-1])

    return run


def running(df: DataFrame, keys: list[str], order: list[str], element: Column, monoid: Monoid, out: str = "before") -> DataFrame:
    """Adds ``out``: the composition of the rows before each row in its key."""
    kind = f"array<{monoid.kind}>"
    dealt = df.withColumn("__element", element.cast(kind)).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__part", F.spark_partition_id())
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    local = kept(dealt.mapInArrow(_local(monoid, keys), f"{names}, __before {kind}, __seq bigint, __first boolean"), "scan")
    key = F.struct(F.lit(0).alias("__all"), *keys)
    ends = local.groupBy("__part").agg(
        F.min_by(key, "__seq").alias("first"),
        F.max_by(F.struct(key.alias("key"), "__before", "__element", "__first"), "__seq").alias("last"),
    )
    whole = monoid.column(F.col("last.__before"), F.col("last.__element"))
    table = ends.select("__part", "first", "last.key", F.col("last.__first").alias("single"), whole.alias("whole")).orderBy("__part").collect()  # a row a partition
    dtype = np.float64 if monoid.kind == "double" else np.int64
    carry, open_key, rows = monoid.identity().astype(dtype), None, []
    for r in table:
        start = carry if r["first"] == open_key else monoid.identity().astype(dtype)
        rows.append((r["__part"], start.tolist()))
        own = np.array(r["whole"], dtype)
        carry = monoid.then(start[None, :], own[None, :])[0] if r["single"] else own
        open_key = r["key"]
    starts = df.sparkSession.createDataFrame(rows, f"__part int, __start {kind}")
    met = local.join(F.broadcast(starts), "__part")  # a row a partition
    before = F.when(F.col("__first"), monoid.column(F.col("__start"), F.col("__before"))).otherwise(F.col("__before"))
    return met.withColumn(out, before).select(*df.columns, out)


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, keep: float = 0.9, start: float = 0.0) -> DataFrame:
    """Adds ``average``: b <- keep b + (1 - keep) value in order, from ``start``; a null value leaves it as it is."""
    v = F.col(value).cast("double")
    own = F.array(F.when(v.isNull(), F.lit(1.0)).otherwise(F.lit(keep)), F.coalesce(v * (1 - keep), F.lit(0.0)))
    met = running(df.withColumn("__own", own), keys, order, F.col("__own"), Affine())
    after = Affine().column(F.col("before"), F.col("__own"))
    return met.withColumn("average", after[0] * start + after[1]).drop("before", "__own")


def run_automaton(df: DataFrame, keys: list[str], order: list[str], symbol: str, table: list[dict[str, int]], other: list[int]) -> DataFrame:
    """Adds ``state`` after each row, from state 0: ``table[s]`` by symbol, ``other[s]`` for symbols that it doesn't have."""
    symbols = sorted({x for t in table for x in t})
    step = F.lit(None)
    for x in symbols:
        step = F.when(F.col(symbol) == x, F.array(*(F.lit(t.get(x, o)) for t, o in zip(table, other, strict=True)))).otherwise(step)
    own = F.coalesce(step, F.array(*map(F.lit, other))).cast("array<bigint>")
    monoid = Transitions(len(table))
    met = running(df.withColumn("__own", own), keys, order, F.col("__own"), monoid)
    return met.withColumn("state", F.get("__own", F.get("before", F.lit(0)).cast("int"))).drop("before", "__own")


def latest_rows(df: DataFrame, keys: list[str], order: list[str], ident: str, kind: str, kinds: list[str], needs: dict[str, str]) -> DataFrame:
    """Adds ``cites``: the id of the latest earlier row of the kind that a row's kind needs, null if there is none.

    Ids are integers from 0; kinds that need nothing cite nothing.
    """
    slot = {k: i for i, k in enumerate(kinds)}
    own = F.array(*(F.when(F.col(kind) == k, F.col(ident)).otherwise(F.lit(-1)) for k in kinds)).cast("array<bigint>")
    met = running(df, keys, order, own, Latest(len(kinds)))
    cited = F.lit(None).cast("bigint")
    for k, need in sorted(needs.items()):
        cited = F.when(F.col(kind) == k, F.get("before", F.lit(slot[need]))).otherwise(cited)
    return met.withColumn("cites", F.when(cited >= 0, cited)).drop("before")


def latest_lineage(df: DataFrame, keys: list[str], order: list[str], ident: str, kind: str, kinds: list[str], needs: dict[str, str], mask: Column) -> DataFrame:
    """Adds ``root``, ``depth`` and ``mask`` of the citations of ``latest_rows``, in one pass however deep they are.

    ``root``: the row at their end, ``depth``: how many lie between, ``mask``: all masks or-ed, the row's own included.
    """
    slot = {k: i for i, k in enumerate(kinds)}
    need, at = F.lit(-1), F.lit(-1)
    for k, i in slot.items():
        at = F.when(F.col(kind) == k, F.lit(i)).otherwise(at)
        need = F.when(F.col(kind) == k, F.lit(slot[needs[k]] if k in needs else -1)).otherwise(need)
    monoid = Chains(len(kinds))
    row = [F.col("__need"), F.col(ident), F.lit(1), F.col("__mask")]
    rest = monoid.identity().reshape(-1, 4).tolist()
    own = F.array(*(F.when(F.col("__at") == i, x).otherwise(F.lit(y)).cast("bigint") for i in range(len(kinds)) for x, y in zip(row, rest[i], strict=True)))
    met = running(df.withColumn("__at", at).withColumn("__need", need).withColumn("__mask", mask.cast("bigint")), keys, order, own, monoid, "__chain")
    cited = [F.when(F.col("__need") >= 0, F.get("__chain", F.col("__need") * 4 + i)) for i in (1, 2, 3)]
    met = met.withColumn("root", F.when(cited[0] >= 0, cited[0]).otherwise(F.col(ident))).withColumn("depth", F.coalesce(cited[1], F.lit(0)).cast("bigint"))
    return met.withColumn("mask", F.coalesce(cited[2], F.lit(0)).bitwiseOR(F.col("__mask")).cast("bigint")).drop("__at", "__need", "__mask", "__chain")
