import random

from paperloom.operators import wallet

REQUEST = "user_id long, at long, seq long, kind string, amount long, analysis_id long"


def decided(spark, requests, opening):
    rows = wallet.decisions(spark.createDataFrame(requests, REQUEST), spark.createDataFrame(opening, "user_id long, balance long")).collect()
    return {r.seq: (r.accepted, r.reason, r.charged, r.held, r.freed, r.total, r.blocked, r.available) for r in rows}


def test_of_two_blocks_of_90_on_100_one_is_accepted(spark):
    got = decided(spark, [(1, 1, 1, "block", 60, 10), (1, 2, 2, "block", 60, 11)], [(1, 100)])
    assert got == {1: (True, "ok", 0, 90, 0, 100, 90, 10), 2: (False, "insufficient", 0, 0, 0, 100, 90, 10)}


def test_each_kind_of_request(spark):
    asked = [
        (1, 1, 1, "block", 21, 10),  # holds 31.5, rounded up
        (1, 2, 2, "debit", 35, None),  # 70 of the available 68
        (1, 3, 3, "debit", 34, None),
        (1, 4, 4, "settle", 10, 10),
        (1, 4, 5, "settle", 10, 10),
        (1, 5, 6, "credit", 50, None),
        (1, 6, 7, "block", 10, 11),
        (1, 7, 8, "settle", 99, 11),  # capped at the block
        (1, 8, 9, "block", 10, 12),
        (1, 9, 10, "cancel", None, 12),
        (1, 10, 11, "credit", 0, None),
        (1, 11, 12, "debit", None, None),
        (1, 12, 13, "gift", 5, None),
        (2, 1, 14, "debit", 1, None),
        (None, 1, 15, "credit", 7, None),
    ]
    assert decided(spark, asked, [(1, 60), (1, 40), (3, 5)]) == {
        1: (True, "ok", 0, 32, 0, 100, 32, 68),
        2: (False, "insufficient", 0, 0, 0, 100, 32, 68),
        3: (True, "ok", 68, 0, 0, 32, 32, 0),
        4: (True, "ok", 20, 0, 12, 12, 0, 12),
        5: (False, "no_block", 0, 0, 0, 12, 0, 12),
        6: (True, "ok", 0, 0, 0, 62, 0, 62),
        7: (True, "ok", 0, 15, 0, 62, 15, 47),
        8: (True, "ok", 15, 0, 0, 47, 0, 47),
        9: (True, "ok", 0, 15, 0, 47, 15, 32),
        10: (True, "ok", 0, 0, 15, 47, 0, 47),
        11: (False, "not_positive", 0, 0, 0, 47, 0, 47),
        12: (False, "not_positive", 0, 0, 0, 47, 0, 47),
        13: (False, "unknown_kind", 0, 0, 0, 47, 0, 47),
        14: (False, "insufficient", 0, 0, 0, 0, 0, 0),
        15: (True, "ok", 0, 0, 0, 7, 0, 7),
    }


def test_many_users_at_once_go_as_each_alone(spark):
    """In any order of rows and over batches; the money adds up."""
    rng = random.Random(3)
    asked = []
    for i in range(6000):
        user = rng.choice([1, 1, 1, rng.randrange(40)])  # one has most of the requests
        kind = rng.choice(["block", "block", "settle", "cancel", "debit", "credit"])
        asked.append((user, i // 2, i, kind, rng.randrange(1, 400), rng.randrange(60)))
    states = {u: wallet.Wallet(1000) for u in range(41)}
    want = {}
    for user, _, seq, kind, amount, analysis_id in sorted(asked, key=lambda r: (r[0], r[1], r[2])):
        w = states[user]
        want[seq] = (*w.decide(kind, amount, analysis_id), w.total, w.blocked, w.total - w.blocked)
        assert w.total >= w.blocked >= 0 and w.blocked == sum(w.blocks.values())
    rng.shuffle(asked)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        assert decided(spark, asked, [(u, 1000) for u in range(41)]) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_requests(spark):
    assert decided(spark, [], [(1, 5)]) == {}
