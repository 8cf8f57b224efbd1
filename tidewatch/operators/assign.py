"""Which expected delivery does an arriving file fulfil?

The rules look at what earlier files of the same sender have filled, so a naive version walks all files
of a sender in order in one task. Here only the files that can change that state are walked:

* Between two boundaries (midnight, a window start, a deadline) the set of open deliveries only
  shrinks, so among files with the same hint those that fill something form a prefix, at most as long
  as the number of candidate deliveries. ``_leaders`` keeps that prefix, picked in two salted steps,
  so a sender with a third of all files is spread over many tasks.
* ``_walk`` runs the rules over the leaders, whose number depends on the calendar and the number of
  slots, not on the number of files.
* Every other file is an addition to a filled delivery or unscheduled; ``assign_loads`` derives its
  target from the fills with array functions.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch import fixed
from tidewatch.functions.scalar import local_date
from tidewatch.session import settle, spread

SALTS = 64
FILLS = "institution STRING, load_id STRING, slot_key STRING, business_date DATE, reason STRING, received_at TIMESTAMP, day DATE"
LIMIT_BEFORE_SHUFFLE = 1000  # below this, Spark cuts each input partition before it shuffles


def candidate_windows(candidates: DataFrame) -> DataFrame:
    """Per (institution, version, local day): deliveries due from 4 days before to 1 day after, in (deadline, slot) order."""
    reach = F.sequence(F.date_sub("business_date", 1), F.date_add("business_date", fixed.LATE_LOOKBACK_DAYS))
    one = F.struct(
        F.col("deadline_utc").alias("dl"),
        F.col("slot_key").alias("slot"),
        F.col("business_date").alias("bd"),
        F.col("window_start_utc").alias("ws"),
    )
    return (
        candidates.select("institution", "version", F.explode(reach).alias("day"), one.alias("c"))
        .groupBy("institution", "version", "day")
        .agg(F.array_sort(F.collect_list("c")).alias("win"))
    )


def with_contract(loads: DataFrame, validity: DataFrame) -> DataFrame:
    """Adds the contract in force on the UTC day of receipt, the local day and a hint that names a known slot."""
    c = validity.select(
        "institution", "version", "timezone", "valid_from", "valid_to", F.transform("slots", lambda s: s["key"]).alias("slot_keys")
    )
    on = F.to_date("l.received_at")
    cond = (
        (F.col("l.institution") == F.col("c.institution"))
        & (on >= F.col("c.valid_from"))
        & (F.col("c.valid_to").isNull() | (on < F.col("c.valid_to")))
    )
    joined = loads.alias("l").join(c.alias("c"), cond, "left").select("l.*", "c.version", "c.timezone", "c.slot_keys")
    hint = F.col("slot_hint") if "slot_hint" in loads.columns else F.lit(None).cast("string")
    return joined.withColumns(
        {
            "day": local_date(F.col("received_at"), F.col("timezone")),
            "hint": F.when(F.array_contains("slot_keys", hint), hint),
        }
    ).drop("slot_keys")


def _leaders(placed: DataFrame, most: int) -> DataFrame:
    """The first k files of each class, k being the number of candidate deliveries around its day.

    ``most`` is the largest k of any contract. As a literal it lets Spark cut every input partition to
    ``most`` rows per class before the shuffle, so files that cannot be leaders never travel; the salt
    spreads what is left of a hot class over many tasks.
    """
    t = F.col("received_at")
    today = F.filter("win", lambda c: c["bd"] == F.col("day"))
    phase = F.size(F.filter(today, lambda c: c["ws"] <= t)) * 1000 + F.size(F.filter(today, lambda c: c["dl"] < t))
    rows = placed.filter(F.size("win") > 0).select(
        "institution", "version", "day", "hint", phase.alias("phase"), "received_at", "load_id", F.size("win").alias("k")
    )
    cls = ["institution", "version", "day", "hint", "phase"]
    salt = F.pmod(F.xxhash64("load_id"), F.lit(SALTS))
    order = [F.col("received_at"), F.col("load_id")]
    first = W.partitionBy(*cls, "salt").orderBy(*order)
    second = W.partitionBy(*cls).orderBy(*order)
    limit = F.lit(most) if most < LIMIT_BEFORE_SHUFFLE else F.col("k")
    return (
        rows.withColumn("salt", salt)
        .withColumn("rn", F.row_number().over(first))
        .filter(F.col("rn") <= limit)
        .withColumn("rn", F.row_number().over(second))
        .filter("rn <= k")
        .drop("salt", "rn", "phase", "k")
    )


def _walk(leaders: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
    """Fills of one sender. Both inputs are bounded by its calendar and slots."""
    due: dict[tuple[int, object], list[tuple]] = defaultdict(list)
    known = cands["c_filled"].astype(bool)
    filled = set(zip(cands.loc[known, "c_slot_key"], cands.loc[known, "c_business_date"]))
    cands = cands.rename(columns=lambda c: c.removeprefix("c_")).sort_values(["deadline_utc", "slot_key"])
    for ver, slot, bd, ws, dl, cad in zip(
        cands["version"], cands["slot_key"], cands["business_date"], cands["window_start_utc"], cands["deadline_utc"], cands["cadence"]
    ):
        due[(ver, bd)].append((slot, bd, ws, dl, cad))
    out = []
    one_day = pd.Timedelta(days=1)
    leaders = leaders.sort_values(["received_at", "load_id"])
    for load_id, ver, day, hint, t in zip(
        leaders["load_id"], leaders["version"], leaders["day"], leaders["hint"], leaders["received_at"]
    ):
        days = [(pd.Timestamp(day) + one_day * i).date() for i in range(-fixed.LATE_LOOKBACK_DAYS, 2)]
        past = [c for d in days[:-2] for c in due[(ver, d)]]
        today = due[(ver, days[-2])]
        pick = None
        if isinstance(hint, str):
            reachable = [c for c in past + today if c[0] == hint]
            if reachable:
                vacant = [c for c in reachable if c[:2] not in filled]
                if vacant:
                    pick = (max(vacant, key=lambda c: c[1]), "HINT")
                    out.append((load_id, *pick[0][:2], pick[1], t, day))
                    filled.add(pick[0][:2])
                continue
        vacant = [c for c in today if c[:2] not in filled]
        inside = [c for c in vacant if c[2] <= t <= c[3]]
        overdue = [c for c in vacant if c[3] < t]
        if inside:
            pick = (inside[0], "ON_TIME")
        elif overdue:
            pick = (overdue[0], "LATE")
        elif len(vacant) < len(today):
            continue
        elif vacant:
            pick = (vacant[0], "EARLY")
        else:
            missed = [c for c in past if c[:2] not in filled]
            ahead = [c for c in due[(ver, days[-1])] if c[:2] not in filled and c[4] in ("WEEKLY", "MONTHLY")]
            if missed:
                pick = (max(sorted(missed, key=lambda c: (c[3], c[0])), key=lambda c: c[3]), "LATE")
            elif ahead:
                pick = (ahead[0], "EARLY")
        if pick:
            out.append((load_id, *pick[0][:2], pick[1], t, day))
            filled.add(pick[0][:2])
    return pd.DataFrame(out, columns=["load_id", "slot_key", "business_date", "reason", "received_at", "day"])


def find_fills(placed: DataFrame, candidates: DataFrame, most: int) -> DataFrame:
    def per_sender(key, left, right):  # noqa: ANN001, ANN202
        fills = _walk(left, right)
        fills.insert(0, "institution", key[0])
        return fills

    lead = _leaders(placed, most)
    names = ["institution", "version", "slot_key", "business_date", "window_start_utc", "deadline_utc", "cadence"]
    cand = candidates.select(*[F.col(c).alias(f"c_{c}") for c in names], F.col("filled").alias("c_filled"))
    return (
        spread(lead, "institution")
        .groupBy("institution")
        .cogroup(spread(cand, "c_institution").groupBy("c_institution"))
        .applyInPandas(per_sender, FILLS)
    )


def assign_loads(loads: DataFrame, candidates: DataFrame, validity: DataFrame, filled: DataFrame | None = None) -> DataFrame:
    """Adds version, slot_key, business_date and reason to every load.

    ``candidates``: ``expand_schedule(..., spill_days=(4, 2))`` of the versions in ``validity``. ``filled`` holds the
    (institution, slot_key, business_date) that loads before these have filled, whatever their time of receipt.
    """
    slot_day = ["institution", "slot_key", "business_date"]
    none = candidates.select(*slot_day).limit(0)
    before = (none if filled is None else filled.select(*slot_day)).distinct().withColumn("filled", F.lit(True))
    candidates = candidates.drop("filled").join(before, slot_day, "left").withColumn("filled", F.coalesce("filled", F.lit(False)))
    days = candidate_windows(candidates)
    key = ["institution", "version", "day"]
    dated = with_contract(loads, validity)
    most = (fixed.LATE_LOOKBACK_DAYS + 2) * int(validity.agg(F.max(F.size("slots"))).first()[0] or 0)
    fills = settle(find_fills(dated.join(days, key), candidates, most), "fills")
    # Everything a file needs to know about its day meets it in one join on (institution, version, day):
    # the candidate deliveries, when today's were filled, and which files of the day filled something.
    # The lists are bounded by the sender's slots; a hot day is split by the adaptive skew join.
    earlier = before.select("institution", "slot_key", "business_date", F.timestamp_seconds(F.lit(0)).alias("received_at"), F.lit("").alias("load_id"))
    of_today = fills.select(*earlier.columns).unionByName(earlier).groupBy("institution", F.col("business_date").alias("day")).agg(
        F.collect_list(F.struct("slot_key", "received_at", "load_id")).alias("day_fills")
    )
    by_file = fills.groupBy("institution", "day").agg(
        F.map_from_entries(F.collect_list(F.struct("load_id", F.struct("slot_key", "business_date", "reason")))).alias("fillers")
    )
    lookup = days.join(of_today, ["institution", "day"], "left").join(by_file, ["institution", "day"], "left")
    mine = F.try_element_at("fillers", F.col("load_id"))
    rows = dated.join(lookup, key, "left").withColumns(
        {"f_slot": mine["slot_key"], "f_bd": mine["business_date"], "f_reason": mine["reason"]}
    )

    t, me, d = F.col("received_at"), F.col("load_id"), F.col("day")

    def filled_before(c: Column) -> Column:
        return F.exists(
            F.coalesce("day_fills", F.array()),
            lambda f: (f["slot_key"] == c["slot"]) & ((f["received_at"] < t) | ((f["received_at"] == t) & (f["load_id"] < me))),
        )

    today = F.filter(F.coalesce("win", F.array()), lambda c: (c["bd"] == d) & filled_before(c))
    rows = rows.withColumns(
        {
            "has_today": F.exists(F.coalesce("win", F.array()), lambda c: c["bd"] == d),
            "filled": today,
            "hinted": F.when(
                F.col("hint").isNotNull(),
                F.array_max(F.transform(F.filter("win", lambda c: (c["slot"] == F.col("hint")) & (c["bd"] <= d)), lambda c: c["bd"])),
            ),
        }
    )
    last_dl = F.array_max(F.transform("filled", lambda c: c["dl"]))
    target = F.coalesce(
        F.get(F.filter("filled", lambda c: c["dl"] >= t), F.lit(0)), F.get(F.filter("filled", lambda c: c["dl"] == last_dl), F.lit(0))
    )
    fills_it = F.col("f_reason").isNotNull()
    by_hint = F.col("hinted").isNotNull()
    known = F.col("version").isNotNull()
    slot = (
        F.when(fills_it, F.col("f_slot"))
        .when(by_hint, F.col("hint"))
        .when(F.col("has_today"), target["slot"])
        .when(known, F.lit(fixed.UNSCHEDULED_SLOT))
    )
    bd = F.when(fills_it, F.col("f_bd")).when(by_hint, F.col("hinted")).when(known, d)
    reason = (
        F.when(fills_it, F.col("f_reason"))
        .when(by_hint | F.col("has_today"), "ADDITIONAL")
        .when(known, "UNSCHEDULED")
        .otherwise("NO_CONTRACT")
    )
    return rows.select(*[F.col(c) for c in loads.columns], "version", "timezone", slot.alias("slot_key"), bd.alias("business_date"), reason.alias("reason"))
