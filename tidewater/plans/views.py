"""Shapes that the operators work on, built from the business tables: once for Spark, once as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F



def by_series() -> WindowSpec:
    """Of s in order of d.  Columns and windows are made when a query is built, for they need a session."""
    return Window.partitionBy("s").orderBy("d")


def by_name() -> WindowSpec:
    return Window.partitionBy("name").orderBy("t")


def ordered_avg(x: Column, order: Column) -> Column:
    """Aggregate: the mean, added up in one order, so that equal values tie to the last bit however rows are dealt to tasks.  Groups are held whole."""
    rows = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("o"), x.alias("x")))))
    return F.try_divide(F.aggregate(rows, F.lit(0.0), lambda total, row: total + row["x"]), F.count(x))


class Views:
    """Lazily read and shaped tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def px(self) -> DataFrame:
        """Daily mean order price by status: s, d, x."""
        return self.table("orders").groupBy(F.col("o_orderstatus").alias("s"), F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("x"))

    @property
    def holes(self) -> DataFrame:
        """px with a null on every day of the year divisible by 17, and a second series y: s, d, x, y."""
        gap = F.dayofyear("d") % 17 == 0
        full = self.table("orders").groupBy(F.col("o_orderstatus").alias("s"), F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("x"), F.count("*").cast("double").alias("n"))
        return full.select("s", "d", F.when(~gap, F.col("x")).alias("x"), (F.col("x") * 0.5 + F.col("n") * 1000).alias("y"))

    @property
    def ret(self) -> DataFrame:
        """Returns of px: s, d, r (the first day of a series is left out)."""
        return self.px.select("s", "d", (F.col("x") / F.lag("x").over(by_series()) - 1).alias("r")).filter("r IS NOT NULL")

    @property
    def both(self) -> DataFrame:
        """Returns of the statuses F and O on days that have both: d, a, b."""
        r = self.ret
        return r.filter("s = 'F'").select("d", F.col("r").alias("a")).join(r.filter("s = 'O'").select("d", F.col("r").alias("b")), "d")

    @property
    def ticks(self) -> DataFrame:
        """Events as trades: symbol, ts, seq, px."""
        return self.table("events").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("px"))

    @property
    def bars(self) -> DataFrame:
        """Daily bars of ticks: s, d, o, h, l, c, n."""
        return self.ticks.groupBy(F.col("symbol").alias("s"), F.to_date("ts").alias("d")).agg(F.min_by("px", "seq").alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", "seq").alias("c"), F.count("*").alias("n"))

    @property
    def panel(self) -> DataFrame:
        """Daily factor and next day's return by user: t, name, f, fwd."""
        daily = self.table("events").groupBy(F.to_date("ts").alias("t"), F.col("user_id").alias("name")).agg(ordered_avg(F.col("value"), F.col("event_id")).alias("f"))
        return daily.withColumn("fwd", F.try_divide(F.lead("f").over(by_name()), F.nullif(F.col("f"), F.lit(0.0))) - 1)

    @property
    def opt(self) -> DataFrame:
        """Option terms from line items: id columns, S, K, T, r, sigma."""
        line = self.table("lineitem").join(self.table("part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
        return line.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("S"), F.col("p_retailprice").alias("K"), (F.col("l_quantity") / 50).alias("T"), F.col("l_tax").alias("r"), (0.1 + 3 * F.col("l_discount")).alias("sigma"))


#: The same shapes for DuckDB, as common table expressions.
SQL = {
    "px": "px AS (SELECT o_orderstatus AS s, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS x FROM orders GROUP BY 1, 2)",
    "holes": "holes AS (SELECT s, d, CASE WHEN dayofyear(d) % 17 <> 0 THEN x END AS x, x * 0.5::DOUBLE + n * 1000 AS y FROM (SELECT o_orderstatus AS s, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS x, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2))",
    "ret": "ret AS (SELECT * FROM (SELECT s, d, x / lag(x) OVER (PARTITION BY s ORDER BY d) - 1 AS r FROM (SELECT o_orderstatus AS s, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS x FROM orders GROUP BY 1, 2)) WHERE r IS NOT NULL)",
    "ticks": "ticks AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS px FROM events)",
    "bars": "bars AS (SELECT event_type AS s, CAST(ts AS DATE) AS d, arg_min(value, event_id) AS o, max(value) AS h, min(value) AS l, arg_max(value, event_id) AS c, count(*) AS n FROM events GROUP BY 1, 2)",
    "panel": "panel AS (SELECT t, name, f, lead(f) OVER (PARTITION BY name ORDER BY t) / nullif(f, 0) - 1 AS fwd FROM (SELECT CAST(ts AS DATE) AS t, user_id AS name, avg(value) AS f FROM events GROUP BY 1, 2))",
    "opt": "opt AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity AS S, p_retailprice AS K, l_quantity / 50 AS T, l_tax AS r, 0.1::DOUBLE + 3 * l_discount AS sigma FROM lineitem JOIN part ON l_partkey = p_partkey)",
}
SQL["both"] = SQL["ret"] + ", both_ AS (SELECT x.d, x.r AS a, y.r AS b FROM ret x JOIN ret y ON x.d = y.d WHERE x.s = 'F' AND y.s = 'O')"


def with_views(body: str, *names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " " + body
