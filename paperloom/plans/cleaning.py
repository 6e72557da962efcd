"""Queries over texts and their cleaned versions."""

from pyspark.sql import functions as F

from paperloom.operators import diffs
from paperloom.plans.documents import docs
from paperloom.plans.registry import query

# Lines are numbered, so that repeated ones have one alignment only. Of each twelve, every other one is changed: spaces
# doubled, a mark added, a letter replaced, a digit added, the line removed, another line put in before it.
LINES = """lines as (select doc_id, line_num, concat(line_num, ': ', line) line from (select doc_id, unnest(range(1, len(l) + 1)) line_num, unnest(l) line from (select doc_id, string_split("text", chr(10)) l from documents))),
changed as (select *, case line_num % 12 when 1 then 'fix_spacing' when 3 then 'fix_punctuation' when 5 then case when contains(line, 'e') then 'fix_encoding' end when 7 then 'fix_word' when 9 then 'removed' when 11 then 'inserted' end change_type from lines)"""


def cleaned(spark, d):
    turn = lambda i, n: i % 12 == n  # noqa: E731  (i from 0)
    new = lambda x, i: (
        F.when(turn(i, 0), F.array(F.replace(x, F.lit(" "), F.lit("  "))))
        .when(turn(i, 2), F.array(F.concat(x, F.lit("!"))))
        .when(turn(i, 4), F.array(F.replace(x, F.lit("e"), F.lit("é"))))
        .when(turn(i, 6), F.array(F.concat(x, F.lit("7"))))
        .when(turn(i, 8), F.array().cast("array<string>"))
        .when(turn(i, 10), F.array(F.concat(F.lit("new "), x), x))
        .otherwise(F.array(x))
    )
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x))
    rows = docs(spark, d).select("doc_id", lines.alias("lines"))
    return rows.select("doc_id", F.array_join("lines", "\n").alias("original"), F.array_join(F.flatten(F.transform("lines", new)), "\n").alias("cleaned"))


@query("x17_line_changes", f"with {LINES} select doc_id, line_num::int line_num, change_type from changed where change_type is not null")
def line_changes(spark, d):
    return diffs.line_changes(cleaned(spark, d)).select("doc_id", "line_num", "change_type")


@query("x17_change_counts", f"with {LINES} select doc_id, change_type, count(*) n from changed where change_type is not null group by 1, 2")
def change_counts(spark, d):
    return diffs.change_counts(diffs.line_changes(cleaned(spark, d)))
