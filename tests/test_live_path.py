"""The monitor's further inputs and outputs: labels, days, shadow engines, bounded reads, incidents from its messages."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from build import contract, contracts, load, loads, utc
from tidewatch.operators.evaluate import ENGINES, champion
from tidewatch.operators.replay import alert_codes, replay
from tidewatch.streaming import cases as C
from tidewatch.streaming.monitor import LABEL, Monitor, Shadow
from tidewatch.streaming.store import Latest, Numbers, Seen

FIRST = date(2026, 9, 1)


def days(n, start=FIRST):
    return [d for d in (start + timedelta(days=i) for i in range(n)) if d.isoweekday() <= 5]


def test_labels_shadow_and_incidents(spark, tr_calendar, tmp_path):
    """A low day is labelled away, so a later equal one alerts; a raising challenger leaves the rest alone; MISSING becomes LATE in one incident."""
    c = contracts(spark, [contract("a")])
    inst = spark.createDataFrame([("a", 1)], "institution STRING, tier INT")
    rows = [load(i, "a", utc(d, 450), 1000 + 7 * (i % 5)) for i, d in enumerate(days(36))]
    low = days(36)[-1]
    rows[-1] = load(len(rows) - 1, "a", utc(low, 700), 300)
    label = spark.createDataFrame([("a", "daily", days(36)[20], "EXCLUDE")], LABEL)
    m = Monitor(spark, str(tmp_path / "m"), c, tr_calendar, inst, labels=lambda: label)

    def broken(learned, now):
        raise ValueError("a challenger's own fault")

    shadow = Shadow(m, {"broken": broken, "mix-shift-v2": ENGINES["mix-shift-v2"], "same": champion})
    m.on_loads(loads(spark, rows[:-1]), 0)
    m.sweep(utc(low, 640), 0)  # the deadline has passed
    early = m.latest_decisions().filter(F.col("business_date") == F.lit(low)).first()
    assert early["status"] == "MISSING"
    last = loads(spark, rows[-1:])
    m.on_loads(last, 1)
    shadow.on_loads(last, 1)
    whole = replay(loads(spark, rows), c, tr_calendar, FIRST, low, utc(low, 700), labels=label)
    pair = lambda df: {r["business_date"]: (r["status"], r["codes"]) for r in df.select("business_date", "status", alert_codes(F.col("findings")).alias("codes")).collect()}
    live = pair(m.latest_decisions().filter("load_count > 0"))
    want = pair(whole.filter("load_count > 0"))
    assert {d: v for d, v in live.items() if d >= low - timedelta(days=6)} == {d: v for d, v in want.items() if d >= low - timedelta(days=6)}
    assert live[low][0] == "LATE" and "VOLUME_LOW" in live[low][1]
    got = {(r["challenger"], r["status"]) for r in shadow.results.read().filter(F.col("business_date") == F.lit(low)).collect()}
    assert got == {("mix-shift-v2", "LATE"), ("same", "LATE")}
    assert [(r["challenger"], r["error"]) for r in shadow.failures.read([1], "challenger STRING, error STRING, at TIMESTAMP").collect()] == [("broken", "a challenger's own fault")]

    # the messages of all batches, read as a stream
    src = spark.readStream.schema(C.MESSAGE).option("recursiveFileLookup", "true").parquet(str(tmp_path / "m/messages"))
    C.write_changelog(C.stream_reconcile(src, "EventTime", "60 days"), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    log = C.read_changelog(spark, str(tmp_path / "log")).filter((F.col("business_date") == F.lit(low)) & (F.col("category") == "TIMELINESS")).orderBy("seq").collect()
    assert [(r["kind"], r["codes"], r["severity"]) for r in log] == [("OPENED", ["MISSING_DELIVERY"], "CRITICAL"), ("UPDATED", ["LATE_DELIVERY"], "WARNING")]
    assert len({r["incident_id"] for r in log}) == 1


def test_day_begins(spark, tr_calendar, tmp_path):
    c = contracts(spark, [contract("a"), contract("b"), contract("gone")])
    inst = spark.createDataFrame([("a", 1, True), ("b", 1, True), ("gone", 1, False)], "institution STRING, tier INT, active BOOLEAN")
    m = Monitor(spark, str(tmp_path / "m"), c, tr_calendar, inst)
    day = days(5)[0]
    m.on_loads(loads(spark, [load(1, "a", utc(day, 420), 10)]), 0)
    for batch in (0, 1):
        m.materialize(day, batch)
    got = {r["institution"]: r["status"] for r in m.latest_decisions().filter(F.col("business_date") == F.lit(day)).collect()}
    assert got == {"a": "RECEIVED", "b": "PENDING"}


def test_a_batch_run_again_changes_nothing(spark, tr_calendar, tmp_path):
    c = contracts(spark, [contract("a")])
    m = Monitor(spark, str(tmp_path / "m"), c, tr_calendar, spark.createDataFrame([("a", 1)], "institution STRING, tier INT"))
    one, two = (loads(spark, [load(i, "a", utc(d, 450), 1000, content="same-content") for i, d in part]) for part in ([(0, FIRST)], [(1, days(3)[1]), (2, days(3)[1])]))
    m.on_loads(one, 0)
    m.on_loads(two, 1)
    state = sorted(map(str, m.state.read().collect()))
    decided = sorted(map(str, m.latest_decisions().collect()))
    m.on_loads(two, 1)
    assert sorted(map(str, m.state.read().collect())) == state and sorted(map(str, m.latest_decisions().collect())) == decided
    assert m.state.read().filter("files = 2").count() == 1 and m.loads().count() == 3


@pytest.mark.parametrize("fold", [2, 100])
def test_latest(spark, tmp_path, fold):
    t = Latest(spark, str(tmp_path / "t"), ["k"], "k INT, v INT", fold=fold, order="k")
    want = {}
    for b in range(7):
        t.tidy(b)
        rows = [(k, 10 * b + k) for k in range(b, b + 3)]
        t.write(spark.createDataFrame(rows, "k INT, v INT"), b)
        t.write(spark.createDataFrame(rows, "k INT, v INT"), b)  # run again
        want |= dict(rows)
        assert {r["k"]: r["v"] for r in t.read().collect()} == want
        assert len(t.log.numbers()) <= 2 * fold + 1
    assert {r["k"]: r["v"] for r in t.read(where=F.col("k") > 4).collect()} == {k: v for k, v in want.items() if k > 4}


def test_seen(spark, tmp_path):
    """Also with a filter that is full: more buckets are read, the answer is the same."""
    for words in (1, 1 << 12):
        s = Seen(spark, str(tmp_path / f"s{words}"), ["a", "b"], "a STRING, b STRING, n INT", buckets=4, words=words, fold=2)
        schema = "a STRING, b STRING, n INT"
        for b in range(5):
            s.tidy(b)
            s.add(spark.createDataFrame([(f"x{k}", str(b), 100 * b + k) for k in range(50)], schema), b)
        asked = spark.createDataFrame([("x7", "3"), ("x49", "0"), ("x50", "1"), ("x1", "9"), (None, "1")], "a STRING, b STRING")
        assert sorted(r["n"] for r in s.find(asked).collect()) == [49, 307]
        with pytest.raises(ValueError, match="folded"):
            s.find(asked, before=1)
        assert s.suspects(asked).count() == 2 or words == 1
        assert s.find(asked.limit(0)).count() == 0
        # the filter is one word per place, whatever the number of batches
        assert s._words(None).count() <= 4 * words


def test_numbers(spark, tmp_path):
    """One order for several queries; the same number again for a batch that is run again; only what no query repeats is folded."""
    n = Numbers(spark, str(tmp_path / "n"), kept=3)
    assert [n.of("loads", 0), n.of("sweep", 0), n.of("sweep", 1), n.of("loads", 1), n.of("sweep", 1), n.of("loads", 1)] == [0, 1, 2, 3, 2, 3]
    assert n.settled("loads", "sweep") == 2
    for b in range(2, 12):
        assert n.of("sweep", b) == b + 2
    assert n.of("loads", 1) == 3 and n.settled("loads", "sweep") == 3 and Numbers(spark, str(tmp_path / "n")).of("loads", 2) == 14
