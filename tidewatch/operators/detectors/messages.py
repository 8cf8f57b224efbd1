"""The sentence an operator reads for each finding, from its numbers and the decision it belongs to.

Texts are rendered on the long table of findings, after the scan that finds them: few occurrences alert.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed
from tidewatch.functions.scalar import duration, hhmm, local_minutes, lookup, metric_value, money, num, pct, severity_rank

KEY = ["institution", "slot_key", "business_date"]
CONTEXT = [
    "slot_label",
    "timezone",
    "first_received_at",
    "deadline_utc",
    "window_start_utc",
    "arrival",
    "prev",
    "quality",
    "baselines",
    "month_phase",
    "judged_at",
]


def explain_baseline(b: Column, phase: Column) -> Column:
    """What the expected value rests on; small effects are left out."""

    def factor(value: Column, at_least: float, text: Column) -> Column:
        return F.when(F.abs(value - 1) >= at_least, text)

    return F.concat_ws(
        "; ",
        F.format_string("son %d benzer teslimattan öğrenilen seviye %s", b["n"].cast("int"), num(b["level"])),
        factor(b["month_phase_factor"], 0.05, F.concat(lookup(fixed.PHASE_LABELS, phase), F.lit(" etkisi x"), num(b["month_phase_factor"], 2))),
        factor(b["weekday_factor"], 0.05, F.concat(F.lit("haftanın günü etkisi x"), num(b["weekday_factor"], 2))),
        factor(b["annual_factor"], 0.05, F.concat(F.lit("geçen yılın mevsimsel değişimi x"), num(b["annual_factor"], 2))),
        factor(b["trend_per_30d"], 0.01, F.concat(F.lit("aylık eğilim x"), num(b["trend_per_30d"], 3))),
    )


def _message() -> Column:
    say = F.format_string
    code, metric = F.col("code"), F.col("metric")
    obs, exp, lo, hi = (F.col(c) for c in ("observed", "expected", "lower", "upper"))
    first, tz, bd = F.col("first_received_at"), F.col("timezone"), F.col("business_date")
    came = F.col("_came")
    deadline, window = F.col("_deadline"), F.col("_window")
    label = F.concat(F.lit("'"), F.col("slot_label"), F.lit("' dosyası"))
    ratio = obs / exp
    low = code == "VOLUME_LOW"
    factor = F.get_json_object("evidence", "$.factor").cast("double")
    times = F.when(factor > 1, F.concat(F.lit("x"), factor.cast("int").cast("string"))).otherwise(
        F.concat(F.lit("/"), F.bround(1 / factor, 0).cast("int").cast("string"))
    )
    note = F.get_json_object("evidence", "$.note")
    below = F.coalesce(obs < lo, F.lit(False))
    # Message formats.
    return (
        F.when(code == "UNEXPECTED_DELIVERY", say("Sözleşmede beklenmeyen bir günde (%s) teslimat alındı (%s).", F.date_format(bd, "dd.MM.yyyy"), came))
        .when(
            code == "MISSING_DELIVERY",
            say("%s son teslim saati %s'e kadar gelmedi. Müşteriler bu kurumun güncel borçlarını ödeyemiyor olabilir.", label, deadline),
        )
        .when(
            code == "DELIVERY_AT_RISK",
            say(
                "Dosya genellikle %s civarında gelir (geçmiş teslimatların %%97'si %s'den önce). Saat %s itibarıyla henüz gelmedi; "
                "son teslim %s. Kurumla proaktif iletişim önerilir.",
                hhmm(F.col("arrival.median")),
                hhmm(F.col("arrival.p97")),
                hhmm(local_minutes(F.col("judged_at"), tz)),
                deadline,
            ),
        )
        .when(
            code == "LATE_DELIVERY",
            say(
                "%s son teslim saatinden %s sonra geldi (%s %s, son teslim %s).",
                label,
                duration(obs),
                F.date_format(F.from_utc_timestamp(first, tz), "dd.MM"),
                came,
                deadline,
            ),
        )
        .when(
            (code == "EARLY_DELIVERY") & (F.to_date(F.from_utc_timestamp(first, tz)) < bd),
            say("Dosya beklenen günden önce geldi (%s).", F.date_format(first, "dd.MM.yyyy")),
        )
        .when(
            code == "EARLY_DELIVERY",
            say("Dosya beklenen pencereden önce geldi (%s, pencere başlangıcı %s). Eski/yanlış dosya olmadığı teyit edilebilir.", came, window),
        )
        .when(
            code == "ARRIVAL_DRIFT",
            say("Dosya süresinde geldi ancak alışılmıştan geç (%s; olağan %s). Eğilim sürerse son teslim riski oluşabilir.", came, hhmm(exp)),
        )
        .when(
            code.isin("VOLUME_LOW", "VOLUME_HIGH"),
            F.concat(
                say(
                    "%s beklenenden %%%s %s: %s (beklenen %s, olağan aralık %s – %s). Dayanak: %s.",
                    lookup(fixed.METRIC_LABELS, metric),
                    num(F.abs((ratio - 1) * 100)),
                    F.when(low, "düşük").otherwise("yüksek"),
                    F.col("_obs"),
                    metric_value(metric, exp),
                    metric_value(metric, lo),
                    metric_value(metric, hi),
                    explain_baseline(F.col("_baseline"), F.col("month_phase")),
                ),
                F.when(low, " Kısmi dosya olabilir; tamamlayıcı dosya beklenebilir.").otherwise(""),
            ),
        )
        .when(
            code == "MIX_SHIFT",
            say(
                "%s olağan dışı: %s (beklenen %s, aralık %s–%s). Toplamlar normal görünse de dosyanın bileşimi değişmiş olabilir "
                "(eksik/yeni segment).",
                lookup({k: v[2] for k, v in fixed.RATIOS.items()}, metric),
                num(obs, 3),
                num(exp, 3),
                num(lo, 3),
                num(hi, 3),
            ),
        )
        .when(
            code == "DUPLICATE_FILE",
            "Bu dosyanın içeriği daha önce alınmış bir dosyayla birebir aynı (içerik özeti eşleşiyor). "
            "Borçların mükerrer yüklenmesi ve çift tahsilat riski var.",
        )
        .when(
            code == "STALE_DATA",
            say(
                "Kayıt sayısı, toplam tutar ve müşteri sayısı %s teslimatıyla birebir aynı. Kurum borç verisini güncellememiş olabilir.",
                F.date_format("prev.business_date", "dd.MM.yyyy"),
            ),
        )
        .when(
            code == "UNIT_SCALE_SUSPECT",
            say(
                "Ortalama borç tutarı olağan değerin %s katı (%s vs %s), kayıt sayısı ise normal. Kuruş/TL birim hatası şüphesi: "
                "müşterilere yanlış tutar gösterilebilir.",
                times,
                money(obs),
                money(exp),
            ),
        )
        .when(code == "ZERO_AMOUNT_RECORDS", say("Kayıtların %s'i sıfır tutarlı (izin verilen en fazla %s).", pct(obs, 1), pct(hi, 1)))
        .when(code == "NEGATIVE_AMOUNTS", F.concat(num(obs), F.lit(" kayıtta negatif borç tutarı var.")))
        .when(code == "DUPLICATE_RECORDS", say("Dosya içindeki kayıtların %s'i mükerrer (eşik %s).", pct(obs, 1), pct(hi, 1)))
        .when(
            code == "LIMIT_BREACH",
            F.concat(
                say(
                    "Kural '%s': %s %s, %s sınır %s.",
                    F.get_json_object("evidence", "$.limit_id"),
                    lookup(fixed.METRIC_LABELS, metric),
                    F.col("_obs"),
                    F.when(below, "alt").otherwise("üst"),
                    metric_value(metric, F.when(below, lo).otherwise(hi)),
                ),
                F.coalesce(F.concat(F.lit(" ("), F.nullif(note, F.lit("")), F.lit(")")), F.lit("")),
            ),
        )
    )


def with_messages(decisions: DataFrame, *extra: str) -> DataFrame:
    """One row per finding with its position, rank and message."""
    tz = F.col("timezone")
    long = (
        decisions.filter(F.size("findings") > 0)
        .select(*KEY, *extra, *CONTEXT, F.posexplode("findings").alias("ord", "f"))
        .select(*KEY, *extra, *CONTEXT, "ord", "f.*")
        .withColumns(
            {
                "_came": hhmm(local_minutes(F.col("first_received_at"), tz)),
                "_deadline": hhmm(local_minutes(F.col("deadline_utc"), tz)),
                "_window": hhmm(local_minutes(F.col("window_start_utc"), tz)),
                "_obs": metric_value(F.col("metric"), F.col("observed")),
                "_baseline": F.try_element_at("baselines", F.col("metric")),
            }
        )
    )
    return long.withColumns({"message": _message(), "severity_rank": severity_rank(F.col("severity"))}).drop(
        *CONTEXT, "_came", "_deadline", "_window", "_obs", "_baseline"
    )
