"""Features of the rows before each row, for tables in which one key may hold most of the rows.

A `History` is a table with an entity (such as the customer) and a total order (such as the event
second and the event id). Entities of ordinary size are one window partition each. Heavy entities,
found by counting, are range-partitioned by their order into blocks of bounded size; the blocks are
checkpointed so that a row never changes its block. A feature of a heavy entity is the window result
inside the block combined with the running result over all earlier blocks, which has one row per
block. Both ways give the same values.

Each step on heavy rows reads them several times and joins the results, so a chain of steps would
repeat all earlier ones in its plan. The rows are therefore checkpointed again before such a step
when they already carry the result of another.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from backtrail.operators.lookups import heavy_keys, split_by_keys, spread_join
from backtrail.settings import ensure_checkpoint_folder, setting

BLOCK = "_block"


@dataclass(frozen=True)
class Past:
    """One value of all earlier rows of the entity (and of the same `by` columns)."""

    kind: str
    value: Column | None = None
    by: tuple[str, ...] = ()
    current: bool = False

    @staticmethod
    def count(*by: str) -> Past:
        """How many earlier rows."""
        return Past("count", None, by)

    @staticmethod
    def sum(value, *by: str, current: bool = False) -> Past:
        """Sum over earlier rows, 0 when there are none."""
        return Past("sum", _col(value), by, current)

    @staticmethod
    def max(value, *by: str, current: bool = False) -> Past:
        return Past("max", _col(value), by, current)

    @staticmethod
    def min(value, *by: str, current: bool = False) -> Past:
        return Past("min", _col(value), by, current)

    @staticmethod
    def previous(value, *by: str) -> Past:
        """The value on the row just before, null values included."""
        return Past("previous", _col(value), by)

    @staticmethod
    def latest(value, *by: str) -> Past:
        """The most recent value that is not null."""
        return Past("latest", _col(value), by)


@dataclass(frozen=True)
class Within:
    """One value of the rows whose time lies in [t - seconds, t)."""

    kind: str
    value: Column | None
    seconds: int

    @staticmethod
    def count(seconds: int, where: Column | None = None) -> Within:
        flag = F.lit(1) if where is None else F.when(where, F.lit(1))
        return Within("sum", flag.cast("long"), seconds)

    @staticmethod
    def sum(value, seconds: int) -> Within:
        """Sum, 0 when the window is empty. Pass whole numbers (cents): they add without rounding."""
        return Within("sum", _col(value), seconds)

    @staticmethod
    def max(value, seconds: int) -> Within:
        return Within("max", _col(value), seconds)


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


@dataclass(frozen=True)
class History:
    """Rows of many entities in order. `light` holds ordinary entities, `heavy` the cut ones."""

    light: DataFrame | None
    heavy: DataFrame | None
    entity: tuple[str, ...]
    order: tuple[str, ...]
    flat: bool = True
    blocks: int = 0  # blocks of `heavy` are numbered below this

    @staticmethod
    def of(df: DataFrame, entity: list[str] | str, order: list[str], rows_per_task: int | None = None) -> History:
        """`order` must decide every tie; its first column is the time for `within`."""
        keys = (entity,) if isinstance(entity, str) else tuple(entity)
        limit = rows_per_task or setting(df.sparkSession, "backtrail.rows.per.task")
        if not keys:
            total, limit = df.count(), min(limit, setting(df.sparkSession, "backtrail.rows.per.global.task"))
            if total <= limit:
                return History(df, None, keys, tuple(order))
            return History(None, _cut(df, keys, order, total, limit), keys, tuple(order), blocks=-(-total // limit))
        ensure_checkpoint_folder(df.sparkSession)
        total, most = df.groupBy(*keys).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
        if most <= limit:
            return History(_dealt(df, keys, total), None, keys, tuple(order))
        hot, light = split_by_keys(df, heavy_keys(df, list(keys), limit), list(keys))
        many = hot.count()
        return History(_dealt(light, keys, total - many), _cut(hot, keys, order, many, limit), keys, tuple(order), blocks=-(-many // limit))

    # -- assembling ---------------------------------------------------------------------------

    def each(self, change: Callable[[DataFrame], DataFrame]) -> History:
        """Apply a row-wise change to every row."""
        return replace(
            self,
            light=None if self.light is None else change(self.light),
            heavy=None if self.heavy is None else change(self.heavy),
        )

    def with_columns(self, columns: dict[str, Column]) -> History:
        return self.each(lambda df: df.withColumns(columns))

    def frame(self) -> DataFrame:
        """All rows as one table again."""
        if self.heavy is None:
            return self.light
        rest = self.heavy.drop(BLOCK)
        return rest if self.light is None else self.light.unionByName(rest)

    # -- rows before ----------------------------------------------------------------------------

    def past(self, **features: Past) -> History:
        """Add one column per feature."""
        light = None if self.light is None else self._past_light(self.light, features)
        heavy = self._flattened()
        if heavy is not None:
            base = heavy
            groups: dict[tuple[str, ...], dict[str, Past]] = {}
            for name, feature in features.items():
                groups.setdefault(feature.by, {})[name] = feature
            for by, group in groups.items():
                heavy = self._past_heavy(heavy, base, by, group)
        return replace(self, light=light, heavy=heavy, flat=heavy is None)

    def changes(self, **values: Column) -> History:
        """Add how many rows up to and with each have another value than the row just before; null is no value."""
        h = self
        for name, value in values.items():
            was, new = f"_{name}_was", f"_{name}_new"
            h = h.past(**{was: Past.previous(value)})
            h = h.with_columns({new: F.coalesce((F.col(was) != value).cast("long"), F.lit(0))})
            h = h.past(**{name: Past.sum(new, current=True)}).each(lambda df, helpers=(was, new): df.drop(*helpers))
        return h

    def _flattened(self) -> DataFrame | None:
        return self.heavy if self.heavy is None or self.flat else self.heavy.checkpoint()

    def _past_light(self, df: DataFrame, features: dict[str, Past]) -> DataFrame:
        return df.withColumns(
            {
                name: _finish(p, _local(p, Window.partitionBy(*self.entity, *p.by).orderBy(*self.order), self.order))
                for name, p in features.items()
            }
        )

    def _past_heavy(self, df: DataFrame, base: DataFrame, by: tuple[str, ...], group: dict[str, Past]) -> DataFrame:
        """Add one group of features to `df`; the sums over blocks are taken from the `base` rows."""
        keys = [*self.entity, *by]
        inside = Window.partitionBy(*keys, BLOCK).orderBy(*self.order)
        local = df.withColumns({f"_in_{n}": _local(p, inside, self.order) for n, p in group.items()})
        blocks = base.groupBy(*keys, BLOCK).agg(*[_whole(p, self.order).alias(n) for n, p in group.items()])
        earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        carried = blocks.select(
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            F.col(BLOCK).alias("_k_block"),
            *[_carry(p, F.col(n), earlier).alias(f"_before_{n}") for n, p in group.items()],
        )
        match = F.col(BLOCK) == F.col("_k_block")
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        joined = local.join(carried, match, "left")
        out = joined.withColumns(
            {n: _finish(p, _combine(p, F.col(f"_before_{n}"), F.col(f"_in_{n}"))) for n, p in group.items()}
        )
        return out.drop(
            "_k_block", *[f"_k_{k}" for k in keys], *[f"_in_{n}" for n in group], *[f"_before_{n}" for n in group]
        )

    # -- time windows -----------------------------------------------------------------------------

    def within(self, **features: Within) -> History:
        """Add one column per time-window feature; time is the first order column, in seconds."""
        light = None if self.light is None else self._within_light(self.light, features)
        heavy = self._flattened()
        if heavy is not None:
            heavy = self._within_heavy(heavy, features)
        return replace(self, light=light, heavy=heavy, flat=heavy is None)

    def _within_light(self, df: DataFrame, features: dict[str, Within]) -> DataFrame:
        time = Window.partitionBy(*self.entity).orderBy(self.order[0])
        columns = {}
        for name, w in features.items():
            if w.kind == "sum":
                # Two growing frames cost one pass; a sliding sum would add each row up again.
                upto = F.sum(w.value).over(time.rangeBetween(Window.unboundedPreceding, -1))
                gone = F.sum(w.value).over(time.rangeBetween(Window.unboundedPreceding, -w.seconds - 1))
                columns[name] = F.coalesce(upto, F.lit(0)) - F.coalesce(gone, F.lit(0))
            else:
                columns[name] = F.max(w.value).over(time.rangeBetween(-w.seconds, -1))
        return df.withColumns(columns)

    def _within_heavy(self, df: DataFrame, features: dict[str, Within]) -> DataFrame:
        """Rows are first folded to one per second, which bounds every group below by its seconds.

        The window [t - w, t) covers the end of one w-long stretch and the start of the next, so its
        value is that of the later rows of the stretch before joined with the earlier rows of this one.
        """
        clock = self.order[0]
        keys = [*self.entity, clock]
        seconds = df.groupBy(*keys).agg(
            *[(F.sum(w.value) if w.kind == "sum" else F.max(w.value)).alias(n) for n, w in features.items()]
        )
        whole = F.struct(*keys).alias("_key")  # as one value, in which null equals null
        result = seconds.select(whole)
        for width in sorted({w.seconds for w in features.values()}):
            names = [n for n, w in features.items() if w.seconds == width]
            own = seconds.select(
                *keys,
                F.floor(F.col(clock) / width).alias("_stretch"),
                F.col(clock).alias("_at"),
                F.lit(True).alias("_own"),
                *names,
            )
            tail = own.select(
                *keys,
                (F.col("_stretch") + 1).alias("_stretch"),
                (F.col("_at") + width).alias("_at"),
                F.lit(False).alias("_own"),
                *names,
            )
            stretch = Window.partitionBy(*self.entity, "_stretch")
            before = stretch.orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
            after = stretch.orderBy(F.col("_at").desc()).rangeBetween(Window.unboundedPreceding, 0)
            columns = {}
            for n in names:
                fold = F.sum if features[n].kind == "sum" else F.max
                here = fold(F.when(F.col("_own"), F.col(n))).over(before)
                there = fold(F.when(~F.col("_own"), F.col(n))).over(after)
                if features[n].kind == "sum":
                    columns[f"_w_{n}"] = F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0))
                else:
                    columns[f"_w_{n}"] = F.greatest(here, there)
            part = own.unionByName(tail).withColumns(columns).filter("_own")
            result = result.join(part.select(whole, *[F.col(f"_w_{n}").alias(n) for n in names]), "_key")
        return spread_join(df.withColumn("_key", whole), result, ["_key"]).drop("_key")

    # -- neighbouring rows --------------------------------------------------------------------------

    def neighbours(
        self, columns: Callable[[WindowSpec], dict[str, Column]], before: int = 0, after: int = 0
    ) -> History:
        """Add columns computed over frames that reach at most `before` rows back and `after` ahead."""
        return self.staged(lambda df, keys: df.withColumns(columns(Window.partitionBy(*keys).orderBy(*self.order))), before, after)

    def staged(self, steps: Callable[[DataFrame, list[str]], DataFrame], before: int = 0, after: int = 0) -> History:
        """Apply steps that look at most `before` rows back and `after` ahead; they get the rows and the columns that part them."""
        light = self.light
        if light is not None:
            light = steps(light, list(self.entity))
        heavy = self.heavy
        if heavy is not None:
            size = max(setting(heavy.sparkSession, "backtrail.rows.per.task"), before + after + 1)
            numbered = replace(self, light=None).past(_rn=Past.count()).heavy
            chunk, place = F.floor(F.col("_rn") / size), F.col("_rn") % size
            homes = F.array_compact(
                F.array(
                    chunk,
                    # the last rows of a chunk are also seen by the next, the first rows by the one before
                    F.when(place >= size - before, chunk + 1),
                    F.when((place < after) & (chunk > 0), chunk - 1),
                )
            )
            spread = numbered.withColumn("_home", chunk).withColumn("_chunk", F.explode(homes))
            heavy = (
                steps(spread, [*self.entity, "_chunk"])
                .filter(F.col("_chunk") == F.col("_home"))
                .drop("_rn", "_home", "_chunk")
            )
        return replace(self, light=light, heavy=heavy, flat=heavy is None)


def _dealt(df: DataFrame, keys: tuple[str, ...], rows: int) -> DataFrame:
    """Rows shuffled by entity into partitions of a bounded number of rows.

    The windows of a chain of features sort the same rows again and again in one stage, and each sort holds its own copy of the
    partition. So the partitions grow in number with the rows, not in size; small tables are left to the session's settings.
    """
    parts = -(-rows // setting(df.sparkSession, "backtrail.rows.per.partition"))
    if parts <= 1:
        return df.repartition(*keys)
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), *keys)


def _cut(df: DataFrame, entity: tuple[str, ...], order: list[str], rows: int, limit: int) -> DataFrame:
    """Number blocks of about `limit` rows in order and freeze them in a checkpoint."""
    ensure_checkpoint_folder(df.sparkSession)
    blocks = -(-rows // limit)
    ranged = df.repartitionByRange(blocks, *entity, *order)
    return ranged.withColumn(BLOCK, F.spark_partition_id()).checkpoint()


def _local(p: Past, window: WindowSpec, order: tuple[str, ...]) -> Column:
    """The value inside one window partition; wrapped in a struct where null is a value."""
    frame = window.rowsBetween(Window.unboundedPreceding, 0 if p.current else -1)
    if p.kind == "count":
        return (F.row_number().over(window) - 1).cast("long")
    if p.kind == "previous":
        return F.lag(F.struct(p.value.alias("v"))).over(window)
    if p.kind == "latest":
        return F.last(p.value, ignorenulls=True).over(frame)
    return getattr(F, p.kind)(p.value).over(frame)


def _whole(p: Past, order: tuple[str, ...]) -> Column:
    """The value of a whole block."""
    if p.kind == "count":
        return F.count(F.lit(1))
    if p.kind == "previous":
        return F.max(F.struct(*order, F.struct(p.value.alias("v")).alias("row")))["row"]
    if p.kind == "latest":
        return F.max(F.when(p.value.isNotNull(), F.struct(*order, p.value.alias("v"))))["v"]
    return getattr(F, p.kind)(p.value)


def _carry(p: Past, block: Column, earlier: WindowSpec) -> Column:
    """The value of all earlier blocks."""
    if p.kind in ("count", "sum"):
        return F.sum(block).over(earlier)
    if p.kind in ("previous", "latest"):
        return F.last(block, ignorenulls=True).over(earlier)
    return getattr(F, p.kind)(block).over(earlier)


def _combine(p: Past, before: Column, inside: Column) -> Column:
    if p.kind in ("count", "sum"):
        return F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0))
    if p.kind in ("previous", "latest"):
        return F.coalesce(inside, before)
    return (F.greatest if p.kind == "max" else F.least)(before, inside)


def _finish(p: Past, value: Column) -> Column:
    if p.kind == "previous":
        return value["v"]
    return F.coalesce(value, F.lit(0)) if p.kind == "sum" else value
