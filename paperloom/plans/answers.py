"""Queries over answers of models: text around, and within, JSON made from the events."""

from pyspark.sql import functions as F

from paperloom.functions import json_text as j
from paperloom.plans.registry import query
from paperloom.sources import views as v

# How an event's record is wrapped or cut, by the last digit of its id, with the tier that reads it. {k}: a number of the event.
KINDS = [
    ('{{"id": {id}, "items": [{{"k": {k}}}, {{"k": 1}}]}}', "direct"),
    ('The result:\n```json\n{{"id": {id}, "items": [{{"k": {k}}}, {{"k": 1}}]}}\n```\nas asked {{so}}', "fenced"),
    ('```json\n{{"id": {id}, "items": [{{"k": {k}}}, {{"k": 1}}, {{"k": 77', "fence without end"),
    ('Sure! {{"id": {id}, "findings": [{{"k": {k}}}, {{"k": 1}}]}} Anything else?', "object"),
    ('Answer: {{"id": {id}, "note": "a ] and }} in it", "items": [{{"k": {k}}}, {{"k": 1}}, {{"k": "cut he', "object without end"),
    ("In order: [{k}, 1] of {id}", "array"),
    ('In order: [{k}, [1, {id}], [7, "cut', "array without end"),
    ("Here is {id}", "prefix"),
    ("nothing for {id}", None),
    ('```\n{{"id": {id}, "items": [{{"k": {k}}}, {{"k": 1}},],}}\n```', "fenced, repaired"),
]
K = "json_extract_string(props, '$.k')::bigint"


def _sql(template: str) -> str:
    shown = template.format(id="~id~", k="~k~").replace("'", "''")
    return f"replace(replace('{shown}', '~id~', event_id::varchar), '~k~', k::varchar)"


def answers(spark, d):
    """(event_id, k, answer)."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = v.table(spark, d, "events").select("event_id", k.alias("k"))
    shown = [F.replace(F.replace(F.lit(t.format(id="~id~", k="~k~")), F.lit("~id~"), F.col("event_id").cast("string")), F.lit("~k~"), F.col("k").cast("string")) for t, _ in KINDS]
    return e.withColumn("answer", F.element_at(F.array(*shown), (F.col("event_id") % len(KINDS) + 1).cast("int")))


TIER = "case event_id % 10 " + " ".join(f"when {i} then {'null' if t is None else repr(t)}" for i, (_, t) in enumerate(KINDS)) + " end"


@query(
    "n01_answers",
    f"""with e as (select event_id, {K} k from events) select event_id, {TIER} tier,
  case when event_id % 10 in (7, 8) then 0 else 2 end n_items, case when event_id % 10 in (0, 1, 2, 3, 4, 9) then k + 1 end sum_k,
  case when event_id % 10 in (0, 1, 2, 3, 4, 9) then event_id end id from e""",
)
def parsed_answers(spark, d):
    """The tier that reads each answer, and what its list holds."""
    found = answers(spark, d).select("event_id", j.extracted(F.col("answer")).alias("x"))
    found = found.select("event_id", "x.tier", j.parsed(F.col("x.json")).alias("v"))
    found = found.withColumn("list", j.items(F.col("v"), "findings", "items"))
    ks = F.array_compact(F.transform("list", lambda i: F.try_variant_get(i, "$.k", "long")))
    total = F.when(F.size(ks) > 0, F.aggregate(ks, F.lit(0).cast("long"), lambda s, x: s + x))
    return found.select("event_id", "tier", F.size("list").alias("n_items"), total.alias("sum_k"), F.try_variant_get("v", "$.id", "long").alias("id"))


@query(
    "n04_continuations",
    f"""select user_id, event_id, case event_type when 'click' then k when 'view' then 0 when 'purchase' then 2 end last_item_id
  from (select *, {K} k from events) where event_type in ('click', 'view', 'purchase')""",
)
def continuations(spark, d):
    """Answers that say that more is to come, and after which item."""
    k = F.get_json_object("props", "$.k")
    e = v.table(spark, d, "events").withColumn(
        "answer",
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"status": "to_be_continued", "last_item_id": '), k, F.lit("}")))
        .when(F.col("event_type") == "view", '```json\n{"status": "to_be_continued"}\n```')
        .when(F.col("event_type") == "purchase", 'x {"items": [{"id": 1}, {"status": "to_be_continued"}]}')
        .otherwise('{"status": "done", "items": [{"id": 1}]}'),
    )
    value = j.parsed(j.extracted(F.col("answer"))["json"])
    return e.select("user_id", "event_id", j.continuation(value).cast("long").alias("last_item_id")).where("last_item_id is not null")
