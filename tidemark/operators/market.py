"""Prices, benchmarks, macro views, usage and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest_quotes(series: DataFrame) -> DataFrame:
    """(symbol, ts, price, previous_close, change, change_pct) of the last two prices of a symbol (WIN-06). Prior close 0 or missing: no change."""
    w = W.partitionBy("symbol").orderBy("ts")
    x = series.withColumn("previous_close", F.lag("price").over(w))
    last = x.groupBy("symbol").agg(F.max_by(F.struct("ts", "price", "previous_close"), "ts").alias("q")).select("symbol", "q.*")
    ok = F.col("previous_close") != 0
    return last.withColumns({"change": F.when(ok, F.col("price") - F.col("previous_close")), "change_pct": F.when(ok, 100 * (F.col("price") - F.col("previous_close")) / F.col("previous_close"))})


def fresh(latest: DataFrame, now, ttl_seconds: int) -> DataFrame:
    """Rows no older than the time to live (STR-04, batch)."""
    return latest.where(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("ts") <= ttl_seconds)


def portfolio_day(holdings: DataFrame, quotes: DataFrame) -> DataFrame:
    """(fund, total, priced, avg_change_pct, gainers, losers, as_of): the plain mean over priced holdings (AGG-17)."""
    x = holdings.join(quotes.select("symbol", "change_pct", "ts"), "symbol", "left")
    return x.groupBy("fund").agg(F.count("*").alias("total"), F.count("change_pct").alias("priced"), F.avg("change_pct").alias("avg_change_pct"), F.count_if(F.col("change_pct") > 0).alias("gainers"), F.count_if(F.col("change_pct") < 0).alias("losers"), F.max("ts").alias("as_of"))


def sector_benchmarks(holdings: DataFrame, quotes: DataFrame, proxies: DataFrame) -> DataFrame:
    """(fund, sector, holdings, weight_pct, portfolio, benchmark, delta): sectors against their proxy; what is missing stays null (JON-26)."""
    x = holdings.join(quotes.select("symbol", "change_pct"), "symbol", "left")
    s = x.groupBy("fund", "sector").agg(F.count("*").alias("holdings"), F.avg("change_pct").alias("portfolio"))
    s = s.withColumn("weight_pct", 100 * F.col("holdings") / F.sum("holdings").over(W.partitionBy("fund")))
    b = proxies.join(quotes.select("symbol", F.col("change_pct").alias("benchmark")), "symbol", "left").select("sector", "benchmark")
    return s.join(b, "sector", "left").withColumn("delta", F.col("portfolio") - F.col("benchmark"))


def country_macro(countries: DataFrame, indicators: DataFrame, index_quotes: DataFrame, names: list[str]) -> DataFrame:
    """A row for each country: its indicators side by side and its index (JON-27)."""
    wide = indicators.groupBy("country").pivot("indicator", names).agg(F.max("value"))
    return countries.join(wide, "country", "left").join(index_quotes, "country", "left")


def latest_value(observations: DataFrame) -> DataFrame:
    """The most recent non-null value of each (country, indicator) (SRC-18)."""
    return observations.where("value is not null").groupBy("country", "indicator").agg(F.max_by("value", "date").alias("value"), F.max("date").alias("date"))


def usage(log: DataFrame, since) -> DataFrame:
    """(user, action, n) since an instant (AGG-18)."""
    return log.where(F.col("ts") >= F.lit(since).cast("timestamp")).groupBy("user", "action").agg(F.count("*").alias("n"))


def quota(members: DataFrame, calls: DataFrame) -> DataFrame:
    """(user, limit, used, remaining, within): the most generous plan of a user against today's calls (AGG-19)."""
    plan = members.groupBy("user").agg(F.max_by("plan", F.struct("limit", "plan")).alias("plan"), F.max("limit").alias("limit"))
    x = plan.join(calls.groupBy("user").agg(F.count("*").alias("used")), "user", "left").na.fill(0, ["used"])
    return x.withColumns({"remaining": F.greatest(F.lit(0), F.col("limit") - F.col("used")), "within": F.col("used") < F.col("limit")})


def latest_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key (AGG-28, SNK-03)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def newest(rows: DataFrame, time: str, tie: str, limit: int) -> DataFrame:
    """The newest rows, undated ones last (TOP-07, TOP-09, WIN-07)."""
    return rows.orderBy(F.col(time).desc_nulls_last(), F.desc(tie)).limit(limit)
