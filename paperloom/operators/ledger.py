"""Ledger operators (A8, A40, L2, L3, L6, W6, W11, T-1, T-2, P14, P31, P34, J21; L1, L4, L5: wallet.py). Amounts are integer cents."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.telemetry import ratio

BLOCK_FACTOR, MARKUP, CREDIT = 1.5, 2, 0.005  # fixed values


def signed(tx: DataFrame):
    return F.when(F.col("type") == "credit", F.col("amount")).otherwise(-F.col("amount"))


def profit(tx: DataFrame, as_of: str, days: int) -> DataFrame:
    """Charges, costs, margin in percent and mean charge of debits in the window; zeros if there are none."""
    debits = tx.where((F.col("type") == "debit") & (F.col("created_at") >= F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {days} days")))
    charged, cost = F.coalesce(F.sum("amount"), F.lit(0)), F.coalesce(F.sum("cost_real"), F.lit(0))
    return debits.agg(
        F.count("*").alias("n"), charged.alias("charged"), cost.alias("cost"), (charged - cost).alias("profit"), (ratio(charged - cost, charged) * 100).alias("margin"), ratio(charged, F.count("*")).alias("mean_charge")
    )


def balance(tx: DataFrame) -> DataFrame:
    """Total (credits less debits), blocked (open entries) and available, the total less the blocked, of each user."""
    out = tx.groupBy("user_id").agg(F.sum(signed(tx)).alias("total"), F.sum(F.when(F.col("status") == "O", F.col("amount")).otherwise(0)).alias("blocked"), F.count("*").alias("entries"))
    return out.withColumn("available", F.col("total") - F.col("blocked"))


def running_balance(tx: DataFrame) -> DataFrame:
    """Each user's balance after each entry."""
    order = Window.partitionBy("user_id").orderBy("created_at", "tx_id").rowsBetween(Window.unboundedPreceding, 0)
    return tx.select("tx_id", "user_id", F.sum(signed(tx)).over(order).alias("balance_after"))


def first_breach(tx: DataFrame, limit: int) -> DataFrame:
    """The first entry of each user whose running cost is above the limit, once."""
    order = Window.partitionBy("user_id").orderBy("created_at", "tx_id").rowsBetween(Window.unboundedPreceding, 0)
    costs = tx.withColumn("running", F.sum("cost_real").over(order)).where(F.col("running") > limit)
    first = F.min_by(F.struct("tx_id", "running"), F.struct("created_at", "tx_id"))
    return costs.groupBy("user_id").agg(first.alias("f")).select("user_id", "f.tx_id", "f.running")


def page(tx: DataFrame, user_id: int, offset: int, limit: int, kind: str | None = None) -> DataFrame:
    """T-1: a page of a user's entries, newest first, with the exact number of all of them."""
    mine = tx.where(F.col("user_id") == user_id)
    mine = mine if kind is None else mine.where(F.col("type") == kind)
    total = mine.agg(F.count("*").alias("total_count"))
    rows = mine.orderBy(F.desc("created_at"), F.desc("tx_id")).offset(offset).limit(limit)
    return rows.crossJoin(total).select("tx_id", "type", "amount", "total_count")  # a page by one row


def top_balances(users: DataFrame, most: int) -> DataFrame:
    """T-2, P34: the users of the highest balances; blank names are left out."""
    return users.where(F.trim("name") != "").orderBy(F.desc("balance"), "user_id").limit(most)


def orphan_blocks(tx: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Blocked entries older than so many hours."""
    old = F.col("created_at") < F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {hours} hours")
    return tx.where((F.col("status") == "O") & old).select("tx_id", "user_id", "amount")


def settle(tx: DataFrame, cap_at_block: bool = True) -> DataFrame:
    """L2: the client's cost is twice the real one, capped at the block if wished; the rest of the block is refunded."""
    blocked = F.ceil(F.col("amount") * BLOCK_FACTOR).cast("long")
    cost = F.col("cost_real") * MARKUP
    cost = F.least(cost, blocked) if cap_at_block else cost
    return tx.select("tx_id", blocked.alias("blocked"), cost.alias("client_cost"), F.greatest(F.lit(0), blocked - cost).alias("refund"))


def analysis_state(events: DataFrame) -> DataFrame:
    """The last state of each analysis; events: (analysis_id, at, seq, status)."""
    return events.groupBy("analysis_id").agg(F.max_by("status", F.struct("at", "seq")).alias("status"))


def credits(amount):
    """Credits for an amount of currency, rounded up."""
    return F.ceil(amount / F.lit(CREDIT)).cast("long")


def tenant(rows: DataFrame, user_id: int) -> DataFrame:
    """A tenant sees its own rows only."""
    return rows.where(F.col("user_id") == user_id)


def price_cascade(models: DataFrame, prices: DataFrame, default: tuple[float, float] = (1.0, 4.0), near: int = 5) -> DataFrame:
    """The price of each model by name: exact, with - and _ as dots, else the closest price name that is a prefix
    of it or has it as prefix and differs by less than ``near`` characters, else the default. prices: (name, price_in,
    price_out), a dimension of some hundred rows."""
    bare = lambda c: F.translate(F.lower(c), "-_", "..")
    m = models.select(F.col("model"), bare(F.col("model")).alias("m"))
    p = prices.select("name", "price_in", "price_out", bare(F.col("name")).alias("p"))
    apart = F.abs(F.length("m") - F.length("p"))
    prefix = (F.col("m").startswith(F.col("p")) | F.col("p").startswith(F.col("m"))) & (apart < near)
    tier = F.when(F.col("model") == F.col("name"), 0).when(F.col("m") == F.col("p"), 1).when(prefix, 2)
    hits = m.join(p, (F.substring("m", 1, 1) == F.substring("p", 1, 1)) & tier.isNotNull()).withColumn("rank", F.struct(tier, apart, "name"))
    best = hits.groupBy("model").agg(F.min_by(F.struct("name", "price_in", "price_out"), "rank").alias("b"))
    out = m.select("model").distinct().join(best, "model", "left")
    return out.select("model", F.coalesce("b.name", F.lit("default")).alias("priced_as"), F.coalesce("b.price_in", F.lit(default[0])).alias("price_in"), F.coalesce("b.price_out", F.lit(default[1])).alias("price_out"))
