"""A wallet's requests decided in their order: blocks, settlements, cancellations, debits and credits.

Whether a request is accepted changes what later ones find, so this is a fold over each user's requests in the order of (at,
seq): they are dealt by user, sorted, and read row by row with the state of one user in hand, its balance and its open blocks.
A user with a third of all requests is one task's work, by the nature of the thing, but never one array; others aren't held up
by it, as each task only carries on.

Requests: (user_id, at, seq, kind, amount, analysis_id), amounts in cents. ``credit`` adds the amount. ``debit`` takes MARKUP
times the amount if the available balance, total less blocked, covers it. ``block`` holds BLOCK_FACTOR times the amount, rounded
up, on the same condition. ``settle`` charges MARKUP times the amount, at most what its analysis has blocked, and frees the rest;
the total doesn't fall under zero. ``cancel`` frees the block.

Defined results: an amount that is null or not positive is refused as not_positive (but for cancel), another kind as
unknown_kind, settling or cancelling without an open block as no_block; a second block of an analysis adds to the first. Users
without an opening balance begin at zero; with several, at their sum. A null user is a user; requests of equal (at, seq) go by
kind, analysis_id and amount. Repeated rows are requests of their own.
"""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_FACTOR, MARKUP = (3, 2), 2  # fixed values: 1.5 as a fraction, and twice the real cost
DECISION = "user_id long, seq long, kind string, analysis_id long, accepted boolean, reason string, charged long, held long, freed long, total long, blocked long, available long"


class Wallet:
    """One user's state. ``decide`` gives (accepted, reason, charged, held, freed) and changes it."""

    def __init__(self, total: int = 0, blocks: dict | None = None):
        self.total, self.blocks = total, dict(blocks or {})
        self.blocked = sum(self.blocks.values())

    def decide(self, kind: str, amount: int | None, analysis_id) -> tuple[bool, str, int, int, int]:
        if kind not in ("credit", "debit", "block", "settle", "cancel"):
            return False, "unknown_kind", 0, 0, 0
        if kind != "cancel" and (amount or 0) <= 0:
            return False, "not_positive", 0, 0, 0
        if kind == "credit":
            self.total += amount
            return True, "ok", 0, 0, 0
        if kind in ("debit", "block"):
            wanted = amount * MARKUP if kind == "debit" else -(-amount * BLOCK_FACTOR[0] // BLOCK_FACTOR[1])
            if self.total - self.blocked < wanted:
                return False, "insufficient", 0, 0, 0
            if kind == "debit":
                self.total -= wanted
                return True, "ok", wanted, 0, 0
            self.blocks[analysis_id] = self.blocks.get(analysis_id, 0) + wanted
            self.blocked += wanted
            return True, "ok", 0, wanted, 0
        held = self.blocks.pop(analysis_id, None)
        if held is None:
            return False, "no_block", 0, 0, 0
        self.blocked -= held
        charged = min(amount * MARKUP, held) if kind == "settle" else 0
        self.total = max(0, self.total - charged)
        return True, "ok", charged, 0, held - charged


def _folder():
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(DECISION))

    def fold(batches):
        user, wallet = object(), Wallet()
        for batch in batches:
            out = []
            for user_id, seq, kind, amount, analysis_id, opens in zip(*(batch.column(c).to_pylist() for c in ("user_id", "seq", "kind", "amount", "analysis_id", "opens")), strict=True):
                if user_id != user:
                    user, wallet = user_id, Wallet()
                if opens:
                    wallet.total += amount or 0
                    continue
                decision = wallet.decide(kind, amount, analysis_id)
                out.append((user_id, seq, kind, analysis_id, *decision, wallet.total, wallet.blocked, wallet.total - wallet.blocked))
            columns = zip(*out, strict=True) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return fold


def decisions(requests: DataFrame, opening: DataFrame) -> DataFrame:
    """Each request with its decision, what it charged, held and freed, and the balance after it. opening: (user_id,
    balance)."""
    asked = requests.select(F.col("user_id").cast("long"), "at", F.col("seq").cast("long"), "kind", F.col("amount").cast("long"), F.col("analysis_id").cast("long"), F.lit(False).alias("opens"))
    null = F.lit(None)
    first = opening.select(F.col("user_id").cast("long"), null.cast(requests.schema["at"].dataType).alias("at"), null.cast("long").alias("seq"), null.cast("string").alias("kind"), F.col("balance").cast("long").alias("amount"), null.cast("long").alias("analysis_id"), F.lit(True).alias("opens"))
    rows = first.unionByName(asked).repartition("user_id").sortWithinPartitions("user_id", F.desc("opens"), "at", "seq", "kind", "analysis_id", "amount")
    return rows.mapInArrow(_folder(), DECISION)
