"""Listings, fills, average-cost books and mark-to-market over order tables."""

from __future__ import annotations



from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rolling import finite


# -- slippage models: a share of the price from filled size, daily volume and side --


def flat_slippage(bps: float):
    return lambda size, adv: F.lit(bps / 1e4)


def linear_impact(k: float):
    return lambda size, adv: F.coalesce(F.try_divide(k / 1e4 * F.abs(size), F.nullif(adv, F.lit(0.0))), F.lit(0.0))


def square_root_impact(k: float):
    return lambda size, adv: F.coalesce(k / 1e4 * F.sqrt(F.try_divide(F.abs(size), F.nullif(adv, F.lit(0.0)))), F.lit(0.0))


# -- listings ---------------------------------------------------------------------


def tradeable(prices: DataFrame, lives: DataFrame, symbol: str, day: str) -> DataFrame:
    """prices with tradeable: the day lies in the symbol's listing (null ends are open); unknown symbols are.

    lives: symbol, listing, delisting.  Joined by symbol, so any number of
    symbols is a hash or merge join with the days as a residual condition.
    """
    joined = prices.join(lives.select(symbol, "listing", "delisting"), symbol, "left")
    inside = (F.col("listing").isNull() | (F.to_date(day) >= F.to_date("listing"))) & (F.col("delisting").isNull() | (F.to_date(day) <= F.to_date("delisting")))
    return joined.withColumn("tradeable", inside)


def apply_lifecycle(prices: DataFrame, lives: DataFrame, symbol: str, day: str, price: str) -> DataFrame:
    """prices with null outside the listing."""
    return tradeable(prices, lives, symbol, day).withColumn(price, F.when(F.col("tradeable"), F.col(price))).drop("listing", "delisting")


def lifecycle_returns(prices: DataFrame, lives: DataFrame, symbol: str, day: str, price: str) -> DataFrame:
    """Returns inside the listing; the first row after a delisting has the terminal return, later ones null.

    lives has action (close_at_last, mark_to_zero or prorate) and recovery: the
    terminal return is 0, -1 or recovery - 1.
    """
    over = Window.partitionBy(symbol).orderBy(day)
    joined = tradeable(prices, lives, symbol, day).join(lives.select(symbol, "action", "recovery"), symbol, "left")
    inside = F.when(F.col("tradeable"), F.col(price))
    after = F.coalesce(F.to_date(day) > F.to_date("delisting"), F.lit(False))
    staged = joined.withColumn("_x", inside).withColumn("_after", after).withColumn("_k", F.sum(after.cast("int")).over(over))
    terminal = F.when(F.col("action") == "close_at_last", 0.0).when(F.col("action") == "mark_to_zero", -1.0).otherwise(F.col("recovery") - 1.0)
    change = F.try_divide(F.col("_x"), F.nullif(F.lag("_x").over(over), F.lit(0.0))) - 1.0
    return staged.withColumn("ret", F.when(F.col("_after"), F.when(F.col("_k") == 1, terminal)).otherwise(change)).drop("_x", "_after", "_k", "listing", "delisting", "action", "recovery")


def detect_delistings(prices: DataFrame, symbol: str, day: str, price: str, min_gap: int = 5) -> DataFrame:
    """Symbols without a finite price on the last min_gap days of the calendar or more: symbol, delisting (their last priced day)."""
    days = prices.select(day).distinct().withColumn("_i", F.row_number().over(Window.orderBy(day)))  # a row by day
    last = days.agg(F.max("_i").alias("_last"))
    seen = prices.filter(finite(F.col(price)).isNotNull()).groupBy(symbol).agg(F.max(day).alias("delisting"))
    placed = seen.join(F.broadcast(days), seen["delisting"] == days[day]).crossJoin(F.broadcast(last))
    return placed.filter(F.col("_last") - F.col("_i") >= min_gap).select(symbol, "delisting")


# -- fills ------------------------------------------------------------------------


def execute_fills(orders: DataFrame, adv: DataFrame, symbol: str, day: str, model, min_size: float = 1.0, max_participation: float = 0.1) -> DataFrame:
    """orders (signed size, price) with reason, filled, fill_price, slippage and cost.

    MISSING_DATE: no volume row; NO_LIQUIDITY: volume not positive;
    BELOW_MIN_SIZE: the capped size is below the least; CAPPED_PARTICIPATION: more
    than the share of volume was asked for; else OK.
    """
    joined = orders.join(adv.select(symbol, day, "adv", F.lit(True).alias("_found")), [symbol, day], "left")
    cap = F.col("adv") * max_participation
    want = F.abs("size")
    allowed = F.least(want, cap)
    reason = F.when(F.col("_found").isNull(), "MISSING_DATE").when(finite(F.col("adv")).isNull() | (F.col("adv") <= 0), "NO_LIQUIDITY").when(allowed < min_size, "BELOW_MIN_SIZE").when(want > cap, "CAPPED_PARTICIPATION").otherwise("OK")
    filled = F.when(reason.isin("OK", "CAPPED_PARTICIPATION"), F.signum("size") * allowed).otherwise(0.0)
    staged = joined.withColumn("reason", reason).withColumn("filled", filled)
    slip = F.when(F.col("filled") != 0, model(F.col("filled"), F.col("adv"))).otherwise(0.0)
    staged = staged.withColumn("slippage", slip).withColumn("fill_price", F.col("price") * (1.0 + F.signum("filled") * F.col("slippage")))
    return staged.withColumn("cost", F.abs("filled") * F.col("fill_price")).drop("_found")


def submit(fills: DataFrame, kind: str) -> DataFrame:
    """fills with the order's status; only MARKET orders are taken."""
    reason = F.col("reason")
    status = F.when(F.col(kind) != "MARKET", "REJECTED").when(reason == "OK", "FILLED").when(reason == "CAPPED_PARTICIPATION", "PARTIAL").otherwise("REJECTED")
    return fills.withColumn("status", status)


class Warmup:
    """Named indicators over a price table, computed together in one pass per window.

    add(name, build) takes a function from the window of a key to a Column;
    membership() and materialize() give DataFrames, so looking an indicator up
    is a filter or a join.
    """

    def __init__(self, prices: DataFrame, key: str, order: str):
        self.prices, self.key, self.order, self.builders = prices, key, order, {}

    def add(self, name: str, build) -> "Warmup":
        if name in self.builders or name in self.prices.columns:
            raise ValueError(f"{name} is there already")
        self.builders[name] = build
        return self

    def materialize(self, keep: bool = False) -> DataFrame:
        """prices with all indicators; keep holds them in memory and on disk for lookups."""
        by = Window.partitionBy(self.key).orderBy(self.order)
        made = self.prices.select("*", *[b(by).alias(n) for n, b in self.builders.items()])
        return made.persist() if keep else made

    def universe(self, members: DataFrame) -> DataFrame:
        """prices of the members (key, order) only."""
        return self.prices.join(members.select(self.key, self.order).distinct(), [self.key, self.order], "left_semi")


def liquidity_mask(rows: DataFrame, adv: DataFrame, symbol: str, day: str, min_adv: float = 0.0) -> DataFrame:
    """rows with liquid: there is a finite volume above min_adv for the day."""
    joined = rows.join(adv.select(symbol, day, "adv"), [symbol, day], "left")
    return joined.withColumn("liquid", F.coalesce(finite(F.col("adv")) > min_adv, F.lit(False)))


# -- book -------------------------------------------------------------------------


def book(fills: DataFrame, key: str, order: list[str], size: str = "filled", price: str = "fill_price") -> DataFrame:
    """Every fill with the position after it: pos, avg_cost, realized.

    Adding re-averages the cost, reducing realises profit at it, and a flip
    starts again at the fill's price.  The fold runs inside the JVM over each
    key's fills in order.
    """
    item = F.struct(*[F.col(c) for c in order], F.col(size).alias("_q"), F.col(price).alias("_p"))
    start = F.struct(F.lit(0.0).alias("pos"), F.lit(0.0).alias("avg_cost"), F.lit(0.0).alias("realized"))

    def step(s: Column, x: Column) -> Column:
        q, p, pos = x["_q"], x["_p"], s["pos"]
        after = pos + q
        same = pos * q >= 0
        closing = F.least(F.abs(pos), F.abs(q)) * F.signum(pos)
        gained = F.when(same, 0.0).otherwise(closing * (p - s["avg_cost"]))
        cost = F.when(q == 0, s["avg_cost"]).when(F.abs(after) < 1e-12, 0.0).when(same, F.try_divide(pos * s["avg_cost"] + q * p, after)).when(pos * after > 0, s["avg_cost"]).otherwise(p)
        return F.struct(F.when(F.abs(after) < 1e-12, 0.0).otherwise(after).alias("pos"), cost.alias("avg_cost"), (s["realized"] + gained).alias("realized"))

    grouped = fills.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.select(key, F.size("items").cast("long").alias("n_fills"), F.aggregate("items", start, step).alias("b")).select(key, "n_fills", "b.*")


def equity(fills: DataFrame, prices: DataFrame, symbol: str, day: str, initial_cash: float) -> DataFrame:
    """Cash, market value and total at the end of each day of prices: day, cash, value, total; unpriced positions give null.

    A row by day and symbol: signed sizes and cash summed up to the day by
    windows, no loop over days.
    """
    flow = fills.groupBy(symbol, day).agg(F.sum("filled").alias("q"), F.sum(F.col("filled") * F.col("fill_price")).alias("m"))
    grid = prices.select(symbol, day, F.col("price").alias("mark")).join(flow, [symbol, day], "full")
    over = Window.partitionBy(symbol).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    held = grid.withColumn("pos", F.coalesce(F.sum("q").over(over), F.lit(0.0)))
    by_day = held.groupBy(day).agg(F.sum(F.coalesce("m", F.lit(0.0))).alias("m"), F.sum(F.when(F.col("pos") != 0, F.col("pos") * F.col("mark")).otherwise(0.0)).alias("value"), F.count_if((F.abs("pos") > 1e-12) & F.col("mark").isNull()).alias("_unpriced"))
    cash = initial_cash - F.sum("m").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0))  # a row by day
    value = F.when(F.col("_unpriced") == 0, F.col("value"))
    return by_day.select(day, cash.alias("cash"), value.alias("value")).withColumn("total", F.col("cash") + F.col("value"))


def run(orders: DataFrame, prices: DataFrame, adv: DataFrame, lives: DataFrame | None, symbol: str, day: str, order: list[str], model, initial_cash: float, **profile) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An order table through listing gates, fills, book and equity: (fills, positions, equity)."""
    gated = orders if lives is None else tradeable(orders, lives, symbol, day).filter("tradeable").drop("listing", "delisting", "tradeable")
    priced = gated.join(prices.select(symbol, day, "price"), [symbol, day]).filter(finite(F.col("price")).isNotNull())
    fills = execute_fills(priced, adv, symbol, day, model, **profile)
    done = fills.filter("filled <> 0")
    return fills, book(done, symbol, order), equity(done, prices, symbol, day, initial_cash)


# -- quaternions: struct<w, x, y, z> ----------------------------------------------


def quaternion(w, x, y, z) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in zip("wxyz", (w, x, y, z))])


def quat_multiply(a: Column, b: Column) -> Column:
    aw, ax, ay, az = (a[c] for c in "wxyz")
    bw, bx, by, bz = (b[c] for c in "wxyz")
    return quaternion(aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw)


def quat_conjugate(q: Column) -> Column:
    return quaternion(q["w"], -q["x"], -q["y"], -q["z"])


def quat_norm(q: Column) -> Column:
    return F.sqrt(sum((q[c] * q[c] for c in "xyz"), q["w"] * q["w"]))


def quat_normalize(q: Column) -> Column:
    n = F.when(quat_norm(q) < 1e-12, F.raise_error(F.lit("quaternion without length")).cast("double")).otherwise(quat_norm(q))
    return quaternion(*[q[c] / n for c in "wxyz"])


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def quat_angle(q: Column) -> Column:
    return 2.0 * F.acos(_clip(F.abs(q["w"])))


def quaternion_distance(a: Column, b: Column) -> Column:
    return 2.0 * F.acos(_clip(F.abs(sum((a[c] * b[c] for c in "xyz"), a["w"] * b["w"]))))


def slerp(a: Column, b: Column, t: float) -> Column:
    """Along the shorter arc; nearly equal rotations are mixed linearly."""
    dot = sum((a[c] * b[c] for c in "xyz"), a["w"] * b["w"])
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    angle = F.acos(_clip(F.abs(dot)))
    near = F.abs(dot) > 1 - 1e-4
    safe = F.when(near, 1.0).otherwise(F.sin(angle))
    u = F.when(near, 1.0 - t).otherwise(F.sin((1.0 - t) * angle) / safe)
    v = F.when(near, t).otherwise(F.sin(t * angle) / safe) * sign
    mixed = quaternion(*[u * a[c] + v * b[c] for c in "wxyz"])
    return quaternion(*[mixed[c] / quat_norm(mixed) for c in "wxyz"])


def quat_rotate(q: Column, v: Column) -> Column:
    """v (struct x, y, z) turned by the unit quaternion."""
    turned = quat_multiply(quat_multiply(q, quaternion(F.lit(0.0), v["x"], v["y"], v["z"])), quat_conjugate(q))
    return F.struct(*[turned[c].alias(c) for c in "xyz"])


def to_axis_angle(q: Column) -> Column:
    s = F.sqrt(F.greatest(F.lit(0.0), 1.0 - q["w"] * q["w"]))
    axis = [F.when(s < 1e-12, 1.0 if c == "x" else 0.0).otherwise(q[c] / F.when(s < 1e-12, 1.0).otherwise(s)).alias(c) for c in "xyz"]
    return F.struct(F.struct(*axis).alias("axis"), (2.0 * F.acos(_clip(q["w"]))).alias("angle"))


def from_axis_angle(x: Column, y: Column, z: Column, angle: Column) -> Column:
    n = F.sqrt(x * x + y * y + z * z)
    s = F.sin(angle / 2.0) / n
    return quaternion(F.cos(angle / 2.0), x * s, y * s, z * s)


def to_rotation_matrix(q: Column) -> Column:
    w, x, y, z = (q[c] for c in "wxyz")
    rows = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
    return F.array(*[F.array(*r) for r in rows])


def composerotations(df: DataFrame, key: str, order: str, q: str) -> DataFrame:
    """The product of each key's rotations in order, newest on the left."""
    one = quaternion(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), F.col(q).alias("q"))))
    return df.groupBy(key).agg(items.alias("items")).select(key, F.aggregate("items", one, lambda a, x: quat_multiply(x["q"], a)).alias("q"))


def rollholonomy(q: Column, w: int, over) -> Column:
    """Angle of the product of the frame's rotations; null in short frames."""
    one = quaternion(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    frame = over.rowsBetween(1 - w, 0)
    product = F.aggregate(F.collect_list(q).over(frame), one, lambda a, x: quat_multiply(x, a))
    return F.when(F.count(q).over(frame) == w, quat_angle(product))


def posteriorentropy(gamma: Column) -> Column:
    """Entropy of an array of probabilities, 0 log 0 being 0."""
    return F.aggregate(gamma, F.lit(0.0), lambda s, g: s - F.when(g > 0, g * F.log(F.when(g > 0, g).otherwise(1.0))).otherwise(0.0))


