import random
from datetime import date, timedelta

import pytest

from ledgerloom.operators import ranks
from ledgerloom.plans import netting

CUBE = "transaction_id string, account_id string, person string, abs_amount decimal(18,2), day date, flow string, atom string"


def brute(rows, days):
    """The first legal pair again and again. rows: (id, account, person, amount, day, side)."""
    legal = [(abs((o[4] - i[4]).days), o[4], i[4], o[1], i[1], o[0], i[0]) for o in rows if o[5] == "out" for i in rows
             if i[5] == "in" and o[2:4] == i[2:4] and o[1] != i[1] and abs((o[4] - i[4]).days) <= days]
    gone, pairs = set(), []
    for *_, o, i in sorted(legal):
        if o not in gone and i not in gone:
            gone |= {o, i}
            pairs.append((o, i))
    return sorted(pairs)


def cube(spark, rows):
    atoms = {"out": "TRANSFER_OUT_SAVINGS", "in": "TRANSFER_IN_DEPOSIT"}
    data = [(i, a, p, m, d, "excluded" if s in atoms else "spend", atoms.get(s, "FOOD_AND_DRINK_COFFEE")) for i, a, p, m, d, s in rows]
    return spark.createDataFrame(data, CUBE)


def netted(spark, rows, days=5):
    return sorted((r["out_id"], r["in_id"]) for r in netting.transfer_netting(cube(spark, rows), days).collect())


def on(k):
    return date(2024, 1, 1) + timedelta(k)


def test_a_same_account_candidate_does_not_use_up_a_rank(spark):
    from decimal import Decimal

    m = Decimal("50.00")
    rows = [("o1", "a", "p", m, on(0), "out"), ("i0", "a", "p", m, on(0), "in"), ("i1", "b", "p", m, on(1), "in"),
            ("far", "b", "p", m, on(30), "in"), ("none", "a", "p", None, on(0), "in"), ("undated", "c", "p", m, None, "in")]
    assert netted(spark, rows) == [("o1", "i1")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    from decimal import Decimal

    rng = random.Random(seed)
    rows = [(f"t{k:03}", f"a{rng.randrange(4)}", f"p{rng.randrange(2)}", Decimal(rng.choice((100, 100, 100, 250))), on(rng.randrange(25)),
             rng.choice(("out", "in"))) for k in range(160)]
    rows += [(f"x{k}", "a1", "p0", Decimal(100), on(3), "spend") for k in range(3)]
    want = brute([r for r in rows if r[5] != "spend"], 5)
    assert len(want) > 30
    assert netted(spark, rows) == want


def test_no_transfers(spark):
    assert netted(spark, []) == []


def test_places_within_keys_that_span_partitions(spark):
    rows = [(k % 3 or None, k) for k in range(100)] + [(7, 5), (7, 5)]
    df = spark.createDataFrame(rows, "key int, at int").repartition(5)
    got = {(r["key"], r["at"], r["place"]) for r in ranks.numbered(df, ["key"], ["at"]).collect()}
    want = set()
    for key in {k for k, _ in rows}:
        want |= {(key, at, i) for i, at in enumerate(sorted(a for k, a in rows if k == key))}
    assert got == want


def test_a_day_full_of_accounts_is_netted_at_once(spark, monkeypatch):
    from decimal import Decimal

    made = []
    kept = netting.lineage.stored
    monkeypatch.setattr(netting.lineage, "stored", lambda df, name: made.append(name) or kept(df, name))
    rows = [(f"o{k:02}", f"a{k:02}", "p", Decimal(100), on(0), "out") for k in range(12)]
    rows += [(f"i{k:02}", f"b{k:02}", "p", Decimal(100), on(0), "in") for k in range(15)]
    assert netted(spark, rows) == [(f"o{k:02}", f"i{k:02}") for k in range(12)]
    assert made.count("netted") == 2  # one round and the one that finds nothing


@pytest.mark.parametrize("seed", [3, 4])
def test_accounts_that_stand_on_both_sides_against_brute_force(spark, seed):
    from decimal import Decimal

    rng = random.Random(seed)
    rows = []
    for p in range(12):  # few days and accounts, so that most places meet their own account
        accounts, size = rng.randrange(1, 5), rng.randrange(1, 4)
        rows += [(f"t{p}-{k:02}", f"a{rng.randrange(accounts)}", f"p{p}", Decimal(100), on(rng.randrange(size)), rng.choice(("out", "in")))
                 for k in range(rng.randrange(4, 26))]
    want = brute(rows, 5)
    assert len(want) > 30
    assert netted(spark, rows) == want
