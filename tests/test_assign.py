"""Matching against a plain walk over every file, and the order of the rules."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

from build import OFFSET, contract, contracts, load, loads, slot, utc
from tidewatch.operators.assign import assign_loads
from tidewatch.operators.contracts import contract_validity
from tidewatch.operators.replay import SPILL
from tidewatch.operators.schedule import expand_schedule

START, END = date(2026, 9, 1), date(2026, 9, 30)


def run(spark, cal, rows, cons):
    v = contract_validity(contracts(spark, cons))
    cand = expand_schedule(v, cal, START - timedelta(days=6), END + timedelta(days=3), SPILL)
    out = assign_loads(loads(spark, rows), cand, v).collect()
    return cand.collect(), {r["load_id"]: (r["slot_key"], r["business_date"], r["reason"]) for r in out}


def plain(rows, cands, keys):
    """One file after the other; ``cands`` of one sender as (deadline, slot, date, window start, cadence)."""
    filled, out = set(), {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        t, hint = r[3], r[5]
        d = (t + OFFSET).date()
        near = sorted(c for c in cands if d - timedelta(days=4) <= c[2] <= d + timedelta(days=1))
        free = lambda cs: [c for c in cs if c[1:3] not in filled]  # noqa: B023, E731
        today = [c for c in near if c[2] == d]

        def choose():
            if hint in keys:
                mine = [c for c in near if c[1] == hint and c[2] <= d]
                if free(mine):
                    return max(free(mine), key=lambda c: c[2]), "HINT"
                if mine:
                    return max(mine, key=lambda c: c[2]), "ADDITIONAL"
            opened = free(today)
            for reason, some in (("ON_TIME", [c for c in opened if c[3] <= t <= c[0]]), ("LATE", [c for c in opened if c[0] < t])):
                if some:
                    return some[0], reason
            taken = [c for c in today if c[1:3] in filled]
            if taken:
                after = [c for c in taken if c[0] >= t]
                return (after[0] if after else max(taken, key=lambda c: c[0])), "ADDITIONAL"
            if opened:
                return opened[0], "EARLY"
            past = free([c for c in near if c[2] < d])
            if past:
                return max(past, key=lambda c: c[0]), "LATE"
            ahead = free([c for c in near if c[2] > d and c[4] in ("WEEKLY", "MONTHLY")])
            return (ahead[0], "EARLY") if ahead else (None, "UNSCHEDULED")

        c, reason = choose()
        out[r[0]] = (c[1], c[2], reason) if c else ("__unscheduled__", d, reason)
        if c:
            filled.add(c[1:3])
    return out


def test_against_plain_walk(spark, tr_calendar):
    rng = random.Random(5)
    slots = [
        [slot("am", start=360, deadline=600), slot("pm", start=900, deadline=1080), slot("wk", "WEEKLY", weekdays=[3, 6], start=480, deadline=720)],
        [slot("m", "MONTHLY", month_days=[10, 20], last=True, start=0, deadline=1380), slot("noon", "WEEKLY", weekdays=[2], start=600, deadline=840)],
        [slot("daily")],
    ]
    cons, rows = [], []
    for i in range(9):
        name = f"I{i}"
        cons.append(contract(name, slots[i % 3]))
        # The last sender delivers hundreds of files a day: most of them cannot change what is filled.
        for n in range(60 if i < 8 else 3000):
            day = START + timedelta(days=rng.randrange(30) if i < 8 else rng.randrange(6))
            hint = rng.choice([None, None, "am", "wk", "m", "nonsense"])
            rows.append(load(n, name, utc(day, rng.randrange(1440)), 10, hint=hint))
    cands, got = run(spark, tr_calendar, rows, cons)
    mine = defaultdict(list)
    for c in cands:
        mine[c["institution"]].append((c["deadline_utc"], c["slot_key"], c["business_date"], c["window_start_utc"], c["cadence"]))
    for c in cons:
        want = plain([r for r in rows if r[1] == c[0]], mine[c[0]], {s[0] for s in c[6]})
        assert {k: got[k] for k in want} == want, c[0]


def test_rules(spark, tr_calendar):
    wed = date(2026, 9, 16)
    rows = [load(i, "a", utc(wed - timedelta(days=2 - i), 420)) for i in range(2)]  # Monday and Tuesday
    rows += [load(2, "a", utc(wed, 420)), load(3, "a", utc(wed, 540)), load(4, "a", utc(wed + timedelta(days=1), 420))]
    rows += [load(5, "a", utc(date(2026, 9, 19), 540)), load(6, "a", utc(date(2026, 9, 19), 600)), load(7, "none", utc(wed, 420))]
    _, got = run(spark, tr_calendar, rows, [contract("a")])
    assert got["a-L00002"] == ("daily", wed, "ON_TIME")
    assert got["a-L00003"] == ("daily", wed, "ADDITIONAL")
    assert got["a-L00005"] == ("daily", date(2026, 9, 18), "LATE")
    assert got["a-L00006"] == ("__unscheduled__", date(2026, 9, 19), "UNSCHEDULED")
    assert got["none-L00007"] == (None, None, "NO_CONTRACT")
    assert datetime is not None
