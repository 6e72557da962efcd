"""Queries over the ledger."""

from pyspark.sql import functions as F

from paperloom.operators import ledger as g
from paperloom.operators import wallet as w
from paperloom.plans.registry import query
from paperloom.plans.telemetry import r
from paperloom.plans.views_sql import VIEWS, using
from paperloom.sources import views as v

AS_OF = "1998-01-01 00:00:00"
SIGNED = """case when "type" = 'credit' then amount else -amount end"""
RUN = "over (partition by user_id order by created_at, tx_id rows unbounded preceding)"


@query(
    "a08_profit",
    using(
        "wallet_tx",
        f"""select count(*) n, coalesce(sum(amount), 0)::bigint charged, coalesce(sum(cost_real), 0)::bigint cost, coalesce(sum(amount) - sum(cost_real), 0)::bigint profit,
  {r('sum(amount) - sum(cost_real)', 'coalesce(sum(amount), 0)')} * 100 margin, {r('coalesce(sum(amount), 0)')} mean_charge
  from wallet_tx where "type" = 'debit' and created_at >= timestamp '{AS_OF}' - interval 365 day""",
    ),
)
def profit(spark, d):
    return g.profit(v.wallet_tx(spark, d), AS_OF, 365)


@query("a40_balances", using("wallet_tx", f"select user_id, sum({SIGNED})::bigint total, sum(case when status = 'O' then amount else 0 end)::bigint blocked, count(*) entries, sum({SIGNED})::bigint - sum(case when status = 'O' then amount else 0 end)::bigint available from wallet_tx group by 1"))
def balances(spark, d):
    return g.balance(v.wallet_tx(spark, d))


@query("w11_running_balance", using("wallet_tx", f"select tx_id, user_id, (sum({SIGNED}) {RUN})::bigint balance_after from wallet_tx"))
def running_balance(spark, d):
    return g.running_balance(v.wallet_tx(spark, d))


@query(
    "w06_first_breach",
    using("wallet_tx", "select user_id, tx_id, running from (select *, row_number() over (partition by user_id order by created_at, tx_id) n from b where running > 50000000) where n = 1", f"b as (select *, (sum(cost_real) {RUN})::bigint running from wallet_tx)"),
)
def first_breach(spark, d):
    return g.first_breach(v.wallet_tx(spark, d), 50_000_000)


@query(
    "t01_ledger_page",
    using("wallet_tx", """select tx_id, "type", amount, (select count(*) from wallet_tx where user_id = 1) total_count from wallet_tx where user_id = 1 order by created_at desc, tx_id desc limit 5 offset 2"""),
)
def ledger_page(spark, d):
    return g.page(v.wallet_tx(spark, d), 1, 2, 5)


@query("t02_top_balances", using("balances", "select * from balances where trim(name) <> '' order by balance desc, user_id limit 500"))
def top_balances(spark, d):
    return g.top_balances(v.balances(spark, d), 500)


@query("p14_orphan_blocks", using("wallet_tx", f"select tx_id, user_id, amount from wallet_tx where status = 'O' and created_at < timestamp '{AS_OF}' - interval 24 hour"))
def orphan_blocks(spark, d):
    return g.orphan_blocks(v.wallet_tx(spark, d), AS_OF)


# Requests of a wallet: credits; open entries block, and 40 days later settle or, where the amount is odd, cancel; others debit.
REQUESTS = """a as (select user_id, created_at, tx_id, "type", status, amount // 100 amount, cost_real // 100 cost from wallet_tx),
requests as (select user_id, created_at "at", tx_id * 2 seq, case when "type" = 'credit' then 'credit' when status = 'O' then 'block' else 'debit' end kind, case when "type" <> 'credit' and status <> 'O' then cost else amount end amount, tx_id analysis_id from a
  union all select user_id, created_at + interval 40 days, tx_id * 2 + 1, case when amount % 2 = 1 then 'cancel' else 'settle' end, cost, tx_id from a where "type" <> 'credit' and status = 'O'),
numbered as (select *, row_number() over (partition by user_id order by "at", seq) n from requests)"""
# The fold, a request of each user a step; held: what a block wants, open: the analyses that have one.
FOLD = """recursive f as (select user_id, 0::bigint n, null::bigint seq, null::varchar kind, null::bigint analysis_id, null::boolean accepted, null::bigint charged, null::bigint held, balance total, 0::bigint blocked, []::bigint[] "open" from opening
  union all select user_id, n, seq, kind, analysis_id, ok, case when ok then c else 0 end, case when ok and kind = 'block' then h else 0 end,
    case when not ok then total when kind = 'credit' then total + amount else greatest(0, total - c) end, case when not ok then blocked when kind = 'block' then blocked + h when kind in ('settle', 'cancel') then blocked - h else blocked end,
    case when ok and kind = 'block' then list_append("open", analysis_id) when ok and kind in ('settle', 'cancel') then list_filter("open", lambda x: x <> analysis_id) else "open" end
  from (select *, case when kind = 'credit' then amount > 0 when kind = 'debit' then amount > 0 and total - blocked >= c when kind = 'block' then amount > 0 and total - blocked >= h when kind = 'settle' then amount > 0 and list_contains("open", analysis_id) else list_contains("open", analysis_id) end ok
    from (select r.*, f.total, f.blocked, f."open", (e.est * 3 + 1) // 2 h, case r.kind when 'debit' then r.amount * 2 when 'settle' then least(r.amount * 2, (e.est * 3 + 1) // 2) else 0 end c
      from f join numbered r on r.user_id = f.user_id and r.n = f.n + 1 join (select tx_id, amount est from a) e on e.tx_id = r.analysis_id)))"""


def requests(spark, d):
    tx = v.wallet_tx(spark, d).withColumns({"amount": F.floor(F.col("amount") / 100), "cost": F.floor(F.col("cost_real") / 100)})
    credit, opened = F.col("type") == "credit", (F.col("type") != "credit") & (F.col("status") == "O")
    kind = F.when(credit, "credit").when(opened, "block").otherwise("debit")
    asked = tx.select("user_id", F.col("created_at").alias("at"), (F.col("tx_id") * 2).alias("seq"), kind.alias("kind"), F.when(credit | opened, F.col("amount")).otherwise(F.col("cost")).alias("amount"), F.col("tx_id").alias("analysis_id"))
    ended = F.when(F.col("amount") % 2 == 1, "cancel").otherwise("settle")
    later = tx.where(opened).select("user_id", (F.col("created_at") + F.expr("interval 40 days")).alias("at"), (F.col("tx_id") * 2 + 1).alias("seq"), ended.alias("kind"), F.col("cost").alias("amount"), F.col("tx_id").alias("analysis_id"))
    return asked.withColumn("at", F.col("at").cast("timestamp")).unionByName(later.withColumn("at", F.col("at").cast("timestamp")))


def _folded(body: str, opening: str, rows: str = REQUESTS) -> str:
    ctes = ", ".join(f"{n} as ({VIEWS[n]})" for n in ("wallet_tx", "balances"))
    return f"with recursive {ctes}, opening as ({opening}), {rows}, {FOLD.removeprefix('recursive ')} {body}"


@query("l01_wallet_decisions", _folded("select user_id, seq, kind, accepted, charged, held, total, blocked, total - blocked available from f where n > 0", "select user_id, greatest(balance, 0) balance from balances"))
def wallet_decisions(spark, d):
    """Every request in order, with what it did."""
    opening = v.balances(spark, d).select("user_id", F.greatest("balance", F.lit(0)).alias("balance"))
    out = w.decisions(requests(spark, d), opening)
    return out.select("user_id", "seq", "kind", "accepted", "charged", "held", "total", "blocked", "available")


BLOCKS = """a as (select user_id, tx_id, created_at, amount // 100 amount from wallet_tx), numbered as (select user_id, tx_id * 2 seq, 'block' kind, amount, tx_id analysis_id, row_number() over (partition by user_id order by created_at, tx_id) n from a)"""


@query("l01_block", _folded("select analysis_id tx_id, held blocked, accepted from f where n > 0", "select user_id, balance from balances", BLOCKS))
def block(spark, d):
    """L1: every entry as a block of its user's balance, each on what the earlier ones left."""
    tx = v.wallet_tx(spark, d)
    asked = tx.select("user_id", F.col("created_at").alias("at"), "tx_id", F.lit("block").alias("kind"), F.floor(F.col("amount") / 100).alias("amount"), F.col("tx_id").alias("analysis_id"), F.col("tx_id").alias("seq"))
    out = w.decisions(asked, v.balances(spark, d).select("user_id", "balance"))
    return out.select(F.col("seq").alias("tx_id"), F.col("held").alias("blocked"), "accepted")


@query("l02_settle", using("wallet_tx", "select tx_id, b blocked, least(cost_real * 2, b) client_cost, greatest(0, b - least(cost_real * 2, b)) refund from (select *, ceil(amount * 1.5::double)::bigint b from wallet_tx)"))
def settle(spark, d):
    return g.settle(v.wallet_tx(spark, d))


@query("r06_analysis_state", using("model_calls", """select user_id analysis_id, last("role" order by created_at, call_id) status from model_calls group by 1"""))
def analysis_state(spark, d):
    calls = v.model_calls(spark, d)
    return g.analysis_state(calls.select(F.col("user_id").alias("analysis_id"), F.col("created_at").alias("at"), F.col("call_id").alias("seq"), F.col("role").alias("status")))


@query("p31_credits", using("wallet_tx", "select tx_id, ceil(amount / 100.0::double / 0.005::double)::bigint credits from wallet_tx"))
def credits(spark, d):
    return v.wallet_tx(spark, d).select("tx_id", g.credits(F.col("amount") / 100.0).alias("credits"))


@query("j24_role_semijoin", using("balances", "select user_id, name from balances where exists (select 1 from orders where o_custkey = user_id and o_orderpriority like '1%')"))
def role_semijoin(spark, d):
    admins = v.table(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("user_id"))
    return v.balances(spark, d).join(admins, "user_id", "left_semi").select("user_id", "name")


@query("j25_default_rows", using("balances", "select user_id, 0::bigint balance from balances where not exists (select 1 from orders where o_custkey = user_id and o_orderstatus = 'P')"))
def default_rows(spark, d):
    have = v.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"))
    return v.balances(spark, d).join(have, "user_id", "left_anti").select("user_id", F.lit(0).cast("long").alias("balance"))


@query(
    "j21_price_cascade",
    """with m as (select distinct lower(p_type) model, replace(replace(lower(p_type), '-', '.'), '_', '.') m from part),
p as (select distinct lower(split_part(p_type, ' ', 1)) "name", 1.5 price_in, 6.0 price_out from part where p_size <= 25),
h as (select model, "name", price_in, price_out, case when model = "name" then 0 when m = "name" then 1 when starts_with(m, "name") or starts_with("name", m) then 2 end tier, abs(len(m) - len("name")) apart from m, p),
b as (select * from (select *, row_number() over (partition by model order by tier, apart, "name") n from h where tier < 2 or tier = 2 and apart < 8) where n = 1)
select model, coalesce("name", 'default') priced_as, coalesce(price_in, 1.0)::double price_in, coalesce(price_out, 4.0)::double price_out from m left join b using (model)""",
)
def price_cascade(spark, d):
    part = v.table(spark, d, "part")
    prices = part.where("p_size <= 25").select(F.lower(F.element_at(F.split("p_type", " "), 1)).alias("name"), F.lit(1.5).alias("price_in"), F.lit(6.0).alias("price_out")).distinct()
    return g.price_cascade(part.select(F.lower("p_type").alias("model")).distinct(), prices, near=8)
