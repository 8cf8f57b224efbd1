"""One institution per case; all cases run in one evaluation."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from build import QUALITY, contract, contracts, load, loads, slot, utc
from tidewatch.operators.detectors.messages import with_messages
from tidewatch.operators.evaluate import evaluate
from tidewatch.operators.replay import replay_occurrences
from tidewatch.session import settle

TARGET = date(2026, 9, 16)
MIN = 60


def at(h, m=0):
    return utc(TARGET, h * MIN + m)


def business_days(n):
    holidays = {date(2026, 8, 30), date(2026, 7, 15)}
    out, d = [], TARGET - timedelta(days=1)
    while len(out) < n:
        if d.isoweekday() < 6 and d not in holidays:
            out.append(d)
        d -= timedelta(days=1)
    return out[::-1]


DAYS = business_days(40)


def history(name):
    rows = []
    for i, d in enumerate(DAYS):
        n = int(100000 * (1 + 0.01 * (i % 5 - 2)))
        rows.append(load(i, name, utc(d, 450 + (i % 7) * 3), n))
    return rows


# case -> (files on the target day, now)
CASES = {
    "ok": ([dict(at=at(7, 40))], at(12)),
    "missing": ([], at(10, 1)),
    "risk": ([], at(8, 30)),
    "pending": ([], at(7)),
    "late": ([dict(at=at(11, 30))], at(12)),
    "low": ([dict(at=at(7, 40), records=40000)], at(12)),
    "healed": ([dict(at=at(7, 40), records=40000), dict(at=at(8, 50), records=60000)], at(12)),
    "unit": ([dict(at=at(7, 40), amount=100000 * 50000)], at(12)),
    "dup": ([dict(at=at(7, 40), content="hash-dup-5")], at(12)),
    "twice": ([dict(at=at(7, 40), content="same", records=50000), dict(at=at(8), content="same", records=50000)], at(12)),
    "stale": ([dict(at=at(7, 40), records=102000)], at(12)),
    "zero": ([dict(at=at(7, 40), zero=30000, negative=4)], at(12)),
    "limit": ([dict(at=at(7, 40))], at(12)),
    "early": ([dict(at=at(5, 30))], at(12)),
    "drift": ([dict(at=at(9, 30))], at(12)),
}


@pytest.fixture(scope="module")
def decided(spark, tr_calendar):
    rows, cons, nows = [], [], []
    for name, (files, now) in CASES.items():
        rows += history(name)
        rows += [load(100 + i, name, f.pop("at"), **f) for i, f in enumerate([dict(x) for x in files])]
        limits = [("cap", "record_count", None, 90000.0, "CRITICAL", "not")] if name == "limit" else []
        cons.append(contract(name, limits=limits))
        nows.append((name, now))
    # Saturday file of a sender without a weekend delivery, with negative amounts; a sender without history.
    rows += history("sat") + [load(100, "sat", utc(TARGET, 460)), load(101, "sat", utc(TARGET + timedelta(days=3), 460), negative=12)]
    rows += [load(101 + i, "sat", utc(TARGET + timedelta(days=i), 460)) for i in (1, 2)]
    rows += [load(0, "new", at(7, 40), 10)]
    cons += [contract("sat", [slot()]), contract("new")]
    nows += [("sat", datetime(2026, 9, 20)), ("new", at(12))]
    c = contracts(spark, cons)
    occ, _ = replay_occurrences(loads(spark, rows), c, tr_calendar, DAYS[0], TARGET + timedelta(days=4), datetime(2026, 9, 21))
    now = spark.createDataFrame(nows, "institution STRING, now TIMESTAMP")
    ready = occ.join(now, "institution").filter("first_received_at is null or first_received_at <= now")
    return settle(evaluate(ready, c, F.col("now")), "cases")


@pytest.fixture(scope="module")
def results(decided):
    out = {}
    rows = decided.filter((F.col("business_date") == F.lit(TARGET)) | (F.col("slot_key") == "__unscheduled__")).collect()
    for r in rows:
        out.setdefault(r["institution"], []).append((r["status"], {f["code"]: f for f in r["findings"]}, r))
    return out


def one(results, name):
    got = [x for x in results[name] if x[2]["business_date"] == TARGET]
    assert len(got) == 1
    return got[0]


@pytest.mark.parametrize(
    "name,status,codes",
    [
        ("ok", "RECEIVED", set()),
        ("missing", "MISSING", {"MISSING_DELIVERY"}),
        ("risk", "AT_RISK", {"DELIVERY_AT_RISK"}),
        ("pending", "PENDING", set()),
        ("late", "LATE", {"LATE_DELIVERY"}),
        ("low", "RECEIVED", {"VOLUME_LOW"}),
        ("healed", "RECEIVED", set()),
        ("dup", "RECEIVED", {"DUPLICATE_FILE"}),
        ("twice", "RECEIVED", {"DUPLICATE_FILE"}),
        ("zero", "RECEIVED", {"ZERO_AMOUNT_RECORDS", "NEGATIVE_AMOUNTS"}),
        ("limit", "RECEIVED", {"LIMIT_BREACH"}),
        ("early", "RECEIVED", {"EARLY_DELIVERY"}),
        ("drift", "RECEIVED", {"ARRIVAL_DRIFT"}),
        ("unit", "RECEIVED", {"UNIT_SCALE_SUSPECT"}),
        ("stale", "RECEIVED", {"STALE_DATA"}),
    ],
)
def test_case(results, name, status, codes):
    got_status, findings, _ = one(results, name)
    assert (got_status, set(findings)) == (status, codes)


def test_numbers(results):
    _, _, ok = one(results, "ok")
    assert abs(ok["baselines"]["record_count"]["expected"] / 100000 - 1) < 0.03
    _, late, _ = one(results, "late")
    assert late["LATE_DELIVERY"]["observed"] == 90 and late["LATE_DELIVERY"]["severity"] == "WARNING"
    _, low, row = one(results, "low")
    assert low["VOLUME_LOW"]["severity"] == "CRITICAL"
    assert sorted(f["metric"] for f in row["findings"]) == ["record_count", "total_amount"]
    _, unit, _ = one(results, "unit")
    assert abs(unit["UNIT_SCALE_SUSPECT"]["score"] - 100) < 1


def test_unscheduled(results):
    rows = [x for x in results["sat"] if x[2]["slot_key"] == "__unscheduled__"]
    assert len(rows) == 1
    status, findings, _ = rows[0]
    assert status == "UNSCHEDULED" and findings["UNEXPECTED_DELIVERY"]["severity"] == "INFO" and "NEGATIVE_AMOUNTS" in findings


def test_learning(results):
    status, findings, row = one(results, "new")
    assert status == "RECEIVED" and not findings and not row["baselines"]


def test_messages(decided):
    m = {(r["institution"], r["code"]): r["message"] for r in with_messages(decided.filter(F.col("business_date") == F.lit(TARGET))).collect()}
    assert m[("missing", "MISSING_DELIVERY")].startswith("'daily dosya' dosyası son teslim saati 10:00'e kadar gelmedi.")
    assert m[("late", "LATE_DELIVERY")] == "'daily dosya' dosyası son teslim saatinden 1 sa 30 dk sonra geldi (16.09 11:30, son teslim 10:00)."
    assert m[("zero", "ZERO_AMOUNT_RECORDS")] == "Kayıtların %30,0'i sıfır tutarlı (izin verilen en fazla %5,0)."
    assert m[("limit", "LIMIT_BREACH")] == "Kural 'cap': Kayıt sayısı 100.000, üst sınır 90.000. (not)"
    assert "düşük: 20.000.000 TL (beklenen 49.000.000 TL" in m[("low", "VOLUME_LOW")] and "Kısmi dosya olabilir" in m[("low", "VOLUME_LOW")]
    assert "x100 katı" in m[("unit", "UNIT_SCALE_SUSPECT")]
    assert "15.09.2026" in m[("stale", "STALE_DATA")]
    assert QUALITY[6] == "INFO"
