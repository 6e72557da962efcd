"""DuckDB CTEs of the views in sources/views.py."""

VIEWS = {
    "model_calls": """select event_id call_id, ts created_at, user_id, concat('m', user_id % 7) model,
  case event_id % 5 when 0 then 'E1' when 1 then 'A1' when 2 then 'J1' when 3 then 'TRIAGE' else 'FINAL' end as "role",
  event_type <> 'error' success, floor("value" * 1000)::bigint latency, k total_tokens, k % 5 = 0 was_retry,
  case when event_type = 'error' then case k % 3 when 0 then 'TIMEOUT' when 1 then 'JSON_PARSE' else 'RATE_LIMIT' end end error_type,
  case when event_type = 'error' then case k % 3 when 0 then 'request timeout' when 1 then 'cannot parse json' else 'http 429' end end error_message
  from (select *, json_extract_string(props, '$.k')::bigint k from events)""",
    "wallet_tx": """select o_custkey user_id, o_orderkey tx_id, o_orderdate created_at, case when o_orderstatus = 'P' then 'credit' else 'debit' end as "type",
  round(o_totalprice * 100)::bigint amount, floor(round(o_totalprice * 100)::bigint / 2)::bigint cost_real, o_orderstatus status from orders""",
    "balances": "select c_custkey user_id, c_name as \"name\", round(c_acctbal * 100)::bigint balance, c_mktsegment segment from customer",
    "spans": """select l_orderkey doc_id, concat('E', l_suppkey % 7) extractor_id, case l_returnflag when 'A' then 'date' when 'N' then 'amount' else 'fact' end item_type,
  (l_partkey % 40) * 5 s, (l_partkey % 40) * 5 + l_quantity::bigint e, concat('v', l_linenumber) as "value", l_linenumber::bigint line, concat('A', l_suppkey % 4) auditor_id,
  case l_linenumber % 4 when 0 then 'baixo' when 1 then 'medio' when 2 then 'alto' else 'critico' end severity from lineitem""",
    "page_boundaries": "select doc_id, p page_num, 50 * (p - 1) page_start, 50 * p page_end from (select distinct doc_id from spans), (select unnest(range(1, 6))::bigint p)",
    "versions": "select user_id nid, event_id as \"version\", ts published from events where event_type = 'purchase'",
    "fact_dates": "select user_id nid, event_id fact_id, ts fact_date from events where event_type = 'error'",
}
NEEDS = {"page_boundaries": ["spans"]}


def using(names: str, body: str, more: str = "") -> str:
    """A statement with the CTEs that names lists, and those that they need; more: further CTEs."""
    wanted: list[str] = []
    for n in names.split():
        wanted += [x for x in [*NEEDS.get(n, []), n] if x not in wanted]
    ctes = [f"{n} as ({VIEWS[n]})" for n in wanted] + ([more] if more else [])
    return f"with {', '.join(ctes)} {body}"
