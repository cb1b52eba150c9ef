"""History of entities that don't fit a task: the rows of operators.history by a two-level prefix scan.

Items are placed by ranges of (entity, order), cut into blocks in their order and written with their block, so an entity with
half of all rows lies in many blocks of bounded size. Each block computes its own running moments; the moments of whole blocks
are merged by Chan's formula and carried into the blocks that follow. Of a block only the first entity can have begun before,
so what is carried has at most one row for each block, and is broadcast.

Rows of one clock value are first merged into a tick, before any shuffle. Without a tie-break the ticks are the items and rows
take their tick's history; with one the rows are, and only rolling counts come from ticks. A rolling frame is the
difference of two prefixes: the one at the row's clock and the one `width` before, which is looked up by placing a query
among the ticks. Sums of rolling frames are differences of running sums, so they are exact for whole numbers only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flag
from ..session import shared_folder
from .history import History

#: Items of a block, and the most blocks.
BLOCK_ROWS, MOST_BLOCKS = 1_000_000, 20_000
#: Ranges of items, each a task, that are sorted before they are cut: no more than this, or than BLOCK_ROWS of their items make.
#: The driver gets a sample for each range, whatever the number of blocks.
RANGES = 48
#: A tick with more than this share of all rows is joined by broadcast; there are at most so many of them.
HEAVY_TICKS = 10_000
_BLOCK, _PRIOR = "__block", "__prior_moments"


def _joined(a: DataFrame, b: DataFrame, names: tuple[str, ...], how: str = "left") -> DataFrame:
    """A join on equal or both null `names`, which come once."""
    other = b.withColumnsRenamed({n: f"__{n}_b" for n in names})
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"__{n}_b"))
    done = a.join(other, on, how)
    return done if how == "left_anti" else done.drop(*(f"__{n}_b" for n in names))


def placed(df: DataFrame, by: str, order: tuple[str, ...], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`df` as a table with its block, a number that grows with (by, order)."""
    spark, total = df.sparkSession, df.count()
    block_rows = max(block_rows, -(-total // MOST_BLOCKS))
    n = min(total // block_rows + 1, max(total // BLOCK_ROWS + 1, RANGES))
    path = shared_folder(spark, "history-blocks")
    out = df.repartitionByRange(n, by, *order).sortWithinPartitions(by, *order)
    # The id is the range and, in its lower 33 bits, the place in it.
    out = out.withColumn(_BLOCK, F.monotonically_increasing_id()).withColumn(_BLOCK, F.expr(f"shiftright({_BLOCK}, 33) * {2**33}L + ({_BLOCK} & {2**33 - 1}L) div {block_rows}"))
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def _carried(local: DataFrame, totals: DataFrame, by: str) -> DataFrame:
    return _joined(local, F.broadcast(totals), (by, _BLOCK))


def running_sums(df: DataFrame, by: str, order: tuple[str, ...], sums: dict[str, str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`df` with the sums of columns ({output: column}) over the earlier rows of the same `by`, 0 without any. Order is total."""
    rows = placed(df, by, order, block_rows)
    before = Window.partitionBy(by, _BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(by).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(by, _BLOCK).agg(*(F.sum(c).alias(f"__c_{k}") for k, c in sums.items()))
    totals = totals.withColumn("__prior", F.count("*").over(blocks)).withColumns({f"__c_{k}": F.sum(f"__c_{k}").over(blocks) for k in sums}).where("__prior > 0")
    local = rows.select("*", *(F.sum(c).over(before).alias(f"__l_{k}") for k, c in sums.items()))
    done = _carried(local, totals, by)
    return done.select(*df.columns, *((F.coalesce(f"__l_{k}", F.lit(0)) + F.coalesce(f"__c_{k}", F.lit(0))).alias(k) for k in sums))


def _merged(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Chan's formula: the moments of both; each has n (values), mean and m2, which are null or 0 without values."""
    na, nb = a["n"], b["n"]
    n, delta = na + nb, F.coalesce(b["mean"], F.lit(0.0)) - F.coalesce(a["mean"], F.lit(0.0))
    mean = F.when(na == 0, b["mean"]).when(nb == 0, a["mean"]).otherwise(a["mean"] + delta * nb / n)
    m2 = F.coalesce(a["m2"], F.lit(0.0)) + F.coalesce(b["m2"], F.lit(0.0)) + F.when((na > 0) & (nb > 0), delta * delta * na * nb / n).otherwise(0.0)
    return {"n": n, "mean": mean, "m2": m2}


def _running(items: DataFrame, w, pivot: Column) -> tuple[Column, Column, Column]:
    """n, mean and m2 over the window's frame of items that have n, mean and m2 themselves; `pivot` is a value near the means."""
    d = F.coalesce(items["mean"], pivot) - pivot
    a, b = F.sum(F.col("n") * d).over(w), F.sum(F.col("m2") + F.col("n") * d * d).over(w)
    n = F.coalesce(F.sum("n").over(w), F.lit(0))
    spread = F.greatest(b - a * a / F.nullif(n, F.lit(0)), F.lit(0.0))
    return n, F.when(n > 0, pivot + a / n), F.coalesce(spread, F.lit(0.0))


def running_moments(items: DataFrame, by: str, order: tuple[str, ...], shares: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`items` with a struct `prior` of the earlier items of the same `by`: rows, n, mean, m2, total, top, last and shares.

    items: rows, n (values), mean, m2, total, top (largest value), and counts named as `shares`; the clock is the first of
    `order`, which is total."""
    rows = placed(items, by, order, block_rows)
    inside = Window.partitionBy(by, _BLOCK)
    before = inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__pivot", F.coalesce(F.first("mean", True).over(inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0)))
    counted = ["rows", *shares]

    def prefix(df: DataFrame, w, pivot: str) -> DataFrame:
        n, mean, m2 = _running(df, w, F.col(pivot))
        return df.select("*", n.alias("l_n"), mean.alias("l_mean"), m2.alias("l_m2"), F.sum("total").over(w).alias("l_total"), F.max("top").over(w).alias("l_top"), F.max("last").over(w).alias("l_last"), *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"l_{c}") for c in counted))

    local = prefix(rows.withColumn("last", F.col(order[0])), before, "__pivot")
    # A block's own moments: those before its last item, and that item.
    own = _merged({k: F.col(f"l_{k}") for k in ("n", "mean", "m2")}, {k: F.col(k) for k in ("n", "mean", "m2")})
    whole = F.struct(*(x.alias(k) for k, x in own.items()), (F.coalesce("l_total", F.lit(0.0)) + F.coalesce("total", F.lit(0.0))).alias("total"), F.greatest("l_top", "top").alias("top"), F.col("last"), *((F.col(f"l_{c}") + F.col(c)).alias(c) for c in counted))
    totals = local.groupBy(by, _BLOCK).agg(F.max_by(whole, F.struct(*order)).alias("b")).select(by, _BLOCK, "b.*")
    blocks = Window.partitionBy(by).orderBy(_BLOCK)
    totals = totals.withColumn("__first", F.coalesce(F.first("mean", True).over(blocks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0)))
    carry = prefix(totals, blocks.rowsBetween(Window.unboundedPreceding, -1), "__first").where("l_rows > 0")
    carry = carry.select(by, _BLOCK, *(F.col(c).alias(f"c{c[1:]}") for c in carry.columns if c.startswith("l_")))
    done = _carried(local, carry, by)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = _merged({"n": zero("c_n"), "mean": F.col("c_mean"), "m2": F.col("c_m2")}, {k: F.col(f"l_{k}") for k in ("n", "mean", "m2")})
    prior = F.struct(
        *((zero(f"c_{c}") + F.col(f"l_{c}")).alias(c) for c in counted), *(x.alias(k) for k, x in both.items()),
        (F.coalesce("c_total", F.lit(0.0)) + F.coalesce("l_total", F.lit(0.0))).alias("total"), F.greatest("c_top", "l_top").alias("top"), F.greatest("c_last", "l_last").alias("last"),
    )
    return done.select(*items.columns, prior.alias("prior"))


def ticks(df: DataFrame, h: History) -> DataFrame:
    """The rows of each (entity, clock) as one item."""
    x = F.col(h.amount).cast("double")
    shares = [F.sum(F.when(p, 1).otherwise(0)).alias(f"s{i}") for i, p in enumerate(h.shares.values())]
    return df.groupBy(h.entity, h.clock).agg(F.count(F.lit(1)).alias("rows"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("m2"), F.sum(x).alias("total"), F.max(x).alias("top"), *shares)


def _rolling(t: DataFrame, h: History, block_rows: int) -> DataFrame:
    """entity, clock and the rolling counts and sums of each tick."""
    widths = sorted({*h.rolling_counts.values(), *h.rolling_sums.values()})
    clock = F.col(h.clock).cast("long")
    # Of equal times a query comes before the tick, which lies in the frame.
    points = F.array(F.struct(clock.alias("at"), F.lit(0).cast("long").alias("width"), F.col("rows").alias("r"), F.coalesce("total", F.lit(0.0)).alias("s")), *(F.struct((clock - w).alias("at"), F.lit(w).cast("long").alias("width"), F.lit(0).cast("long").alias("r"), F.lit(0.0).alias("s")) for w in widths))
    seq = t.select(h.entity, h.clock, F.explode(points).alias("p")).select(h.entity, h.clock, "p.*").withColumn("tick", (F.col("width") == 0).cast("int"))
    run = running_sums(seq, h.entity, ("at", "tick", "width"), {"rows_before": "r", "total_before": "s"}, block_rows)
    at = lambda c, w: F.max(F.when(F.col("width") == w, F.col(c)))
    return run.groupBy(h.entity, h.clock).agg(
        *((at("rows_before", 0) - at("rows_before", w)).cast("int").alias(k) for k, w in h.rolling_counts.items()),
        *((at("total_before", 0) - at("total_before", w)).alias(k) for k, w in h.rolling_sums.items()),
    )


def _with_ticks(df: DataFrame, t: DataFrame, h: History, total: int) -> DataFrame:
    """`df` with the columns of its tick; rows of the heaviest ticks, which one task couldn't join, meet them by broadcast."""
    key = (h.entity, h.clock)
    heavy = F.broadcast(t.where(F.col("tick_rows") > max(total // HEAVY_TICKS, 1000)))
    light = t.where(F.col("tick_rows") <= max(total // HEAVY_TICKS, 1000))
    return _joined(df, heavy, key, "inner").unionByName(_joined(_joined(df, heavy.select(*key), key, "left_anti"), light, key)).drop("tick_rows")


def add_history_in_blocks(df: DataFrame, h: History, min_count: int = 3, min_std: float = 1e-5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The columns and rows of add_history, with no task that holds all rows of an entity.

    Clocks are whole numbers and not null. A null entity is an entity of its own; an empty table gives an empty one. With a
    tie-break, (clock, tie-break) tells the rows of an entity apart."""
    total, shares = df.count(), [f"s{i}" for i in range(len(h.shares))]
    t = ticks(df, h)
    if h.tie_break:
        x = F.col(h.amount).cast("double")
        made = {"rows": F.lit(1).cast("long"), "n": x.isNotNull().cast("long"), "mean": x, "m2": F.lit(0.0), "total": x, "top": x} | {f"s{i}": p.cast("int").cast("long") for i, p in enumerate(h.shares.values())}
        # The row as one value: its columns may have the items' names.
        items = df.select(h.entity, h.clock, h.tie_break, F.struct("*").alias("__row"), *(v.alias(k) for k, v in made.items()))
        out = running_moments(items, h.entity, (h.clock, h.tie_break), shares, block_rows).select("__row.*", F.col("prior").alias(_PRIOR))
        looked_up = t.select(h.entity, h.clock, F.col("rows").alias("tick_rows"))
    else:
        out = df
        looked_up = running_moments(t, h.entity, (h.clock,), shares, block_rows).select(h.entity, h.clock, F.col("rows").alias("tick_rows"), F.col("prior").alias(_PRIOR))
    if h.rolling_counts or h.rolling_sums:
        looked_up = _joined(looked_up, _rolling(t, h, block_rows), (h.entity, h.clock))
    out = _with_ticks(out, looked_up, h, total)
    p, n = (lambda c: F.col(f"{_PRIOR}.{c}")), h.names["count"]
    std = F.when(p("n") > 1, F.sqrt(p("m2") / (p("n") - 1)))
    out = out.withColumns({
        n: p("rows").cast("int"), h.names["sum"]: p("total"), h.names["mean"]: p("total") / F.nullif(p("n"), F.lit(0)), h.names["std"]: std, h.names["max"]: p("top"),
        h.names["first"]: flag(p("rows") == 0), h.names["since"]: F.when(p("rows") > 0, F.col(h.clock) - p("last")).cast("int"),
        **{k: F.when(p("rows") > 0, p(f"s{i}") / p("rows")) for i, k in enumerate(h.shares)},
    })
    z = F.when((F.col(n) >= min_count) & (F.col(h.names["std"]) > min_std), (F.col(h.amount) - F.col(h.names["mean"])) / F.col(h.names["std"]))
    out = out.withColumn(h.names["zscore"], z)
    names = [h.names[k] for k in ("count", "sum", "mean", "std", "max")] + [*h.rolling_counts, *h.rolling_sums] + [h.names[k] for k in ("first", "since", "zscore")] + [*h.shares]
    return out.select(*df.columns, *names)
