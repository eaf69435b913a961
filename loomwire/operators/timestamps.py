"""Mixed timestamp formats and time zones brought to one instant (problem 6).

A text is taken apart by built-in expressions into a date, a time of day and a zone. All-numeric
dates have up to three readings. Which of them a source uses is estimated by
expectation-maximisation over the mixture of orders of each source: a value has a likelihood
under every valid reading, which is higher if the date lies shortly before the row was fetched;
the posterior picks the reading, and a value whose posterior stays below a bound is marked as
ambiguous. Each row enters only by the pattern of its likelihoods, at most 27 per source, so the
iterations run over counts, inside one expression per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Orders of the parts of an all-numeric date.
ORDERS = ("mdy", "dmy", "ymd")
#: Weight, in rows, of the order that the source's profile states; of the others; iterations.
PRIOR, OTHER, ROUNDS = 100.0, 0.5, 12
#: Likelihood of a reading that is not shortly before the time of fetching, and what is shortly.
FAR, NEAR_DAYS = 0.05, 60
#: Posterior up to which a value with two readings is marked ambiguous.
AMBIGUOUS = 0.9

# Month names and abbreviations, without accents, by month.
MONTHS = (
    "january jan enero ene januar janner janvier janv",
    "february feb febrero februar feber fevrier fevr fev",
    "march mar marzo marz mrz mars",
    "april apr abril abr avril avr",
    "may mayo mai",
    "june jun junio juni juin",
    "july jul julio juli juillet juil",
    "august aug agosto ago aout",
    "september sep sept septiembre setiembre septembre",
    "october oct octubre oktober okt octobre",
    "november nov noviembre novembre",
    "december dec diciembre dic dezember dez decembre",
)
# Minutes east of UTC of zone letters, where one meaning prevails ...
LETTERS = {
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "AST": -240, "ADT": -180, "BRT": -180, "BRST": -120, "ART": -180, "CLT": -240, "CLST": -180, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120,
    "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "TRT": 180, "SAST": 120, "WAT": 60, "EAT": 180, "GST": 240, "PKT": 300, "IST": 330,
    "WIB": 420, "ICT": 420, "HKT": 480, "SGT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}
# ... and in zones where they mean something else.
LETTERS_IN = {("CST", "Asia/"): 480, ("IST", "Europe/Dublin"): 60, ("IST", "Asia/Jerusalem"): 120, ("BST", "Asia/Dhaka"): 360, ("AST", "Asia/"): 180, ("EST", "Australia/"): 600, ("EDT", "Australia/"): 660}
#: Letters that mean UTC everywhere.
_UTC = ("Z", "UTC", "GMT", "UT")

_TIME = r"(?<![\d/.-])(\d{1,2})\s?(?::|h|时|点|uhr )\s?(\d{2})(?:\s?(?:[:分])\s?(\d{2})(?:[.,](\d{1,9}))?)?(?:分|秒)?(?!\d)"
_DAY_HALF = r"\b([ap])\.?\s?m\b\.?|(上午|下午)"


def _int(text: Column, pattern: str, group: int) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")), F.lit("9999999999")).cast("int")


def _valid(y: Column, m: Column, d: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.coalesce(y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= last), F.lit(False))


def _day_number(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a valid date, null else."""
    ok = _valid(y, m, d)
    return F.when(ok, F.unix_date(F.make_date(F.when(ok, y), F.when(ok, m), F.when(ok, d))))


def parse_parts(time: Column) -> Column:
    """Struct of the parts of a time text: ``epoch`` (microseconds, of a bare number); ``y``, ``m``,
    ``d`` of an unequivocal date; ``y``, ``a``, ``b`` of an all-numeric one with the year last;
    ``us`` of the day; ``off`` (minutes) or ``letters`` of the zone. All null if there is no date."""
    x = F.lower(F.trim(F.regexp_replace(F.regexp_replace(time, r"[\x{200B}\x{FEFF}\x{200E}\x{200F}]", ""), r"[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+", " ")))
    x = F.translate(x, "áàâäéèêëíîïóôöúûüñç：，", "aaaaeeeeiiiooouuunc:,")
    # compact forms get separators
    x = F.regexp_replace(x, r"^(\d{4})(\d{2})(\d{2})[t ]?(\d{2})(\d{2})(\d{2})(?=$|[^\d])", "$1-$2-$3 $4:$5:$6")
    x = F.regexp_replace(x, r"^(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(?=$|[^\d])", "$1-$2-$3 $4:$5")
    x = F.regexp_replace(x, r"(\d)t(\d{1,2}:)", "$1 $2")
    bare = F.when(x.rlike(r"^\d{1,13}$|^\d{15,17}$"), x.try_cast("bigint"))
    epoch = F.when(F.length(x) <= 11, bare * 1_000_000).when(F.length(x) <= 13, bare * 1_000).otherwise(bare)
    h, mi, s = (_int(x, _TIME, k) for k in (1, 2, 3))
    frac = F.rpad(F.substring(F.regexp_extract(x, _TIME, 4), 1, 6), 6, "0").try_cast("int")
    frac = F.when(F.regexp_extract(x, _TIME, 4) == "", 0).otherwise(frac)
    half = F.concat(F.regexp_extract(x, _DAY_HALF, 1), F.regexp_extract(x, _DAY_HALF, 2))
    pm = half.isin("p", "下午")
    hour = F.when(half == "", h).when(half.isin("上午", "下午") & (h > 12), h).when((h < 1) | (h > 12), None).when(pm, h % 12 + 12).otherwise(h % 12)
    timed = h.isNotNull()
    sound = F.coalesce(hour.between(0, 23) & mi.between(0, 59) & F.coalesce(s, F.lit(0)).between(0, 59), F.lit(False))
    us = F.when(~timed, 0).when(sound, ((hour * 60 + mi).cast("bigint") * 60 + F.coalesce(s, F.lit(0))) * 1_000_000 + F.coalesce(frac, F.lit(0)))
    off = r"(?:\d|[ap]m|utc|gmt|\s)\s?([+-])(\d{2}):?(\d{2})?$"
    sign = F.regexp_extract(x, off, 1)
    minutes = _int(x, off, 2) * 60 + F.coalesce(_int(x, off, 3), F.lit(0))
    offset = F.when(timed & (sign != ""), F.when(sign == "-", -minutes).otherwise(minutes))
    letters = F.upper(F.regexp_extract(x, r"\d\s?(?:[ap]\.?m\.? ?)?\(?([a-z]{1,5})\)?$", 1))
    letters = F.when(timed & ~letters.isin("", "AM", "PM", "H", "UHR", "A", "P"), letters)
    ymd = r"(?<![\d])(\d{4})\s?(?:[-/.]|年)\s?(\d{1,2})\s?(?:[-/.]|月)\s?(\d{1,2})(?!\d)"
    dm = r"(?<![\d])(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?!\d)"
    names = "|".join(sorted((n for ns in MONTHS for n in ns.split()), key=lambda n: (-len(n), n)))
    by_name = F.create_map(*[F.lit(v) for m, ns in enumerate(MONTHS, 1) for n in ns.split() for v in (n, m)])
    first = rf"(?<!\d)(\d{{1,2}})(?:st|nd|rd|th|er|\.)? ?(?:de |of )?({names})\.?,? ?(?:de |del )?(\d{{4}})(?!\d)"
    second = rf"\b({names})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?!\d)"
    month1, month2 = (F.get(F.array(by_name[F.regexp_extract(x, p, k)]), F.lit(0)) for p, k in ((first, 2), (second, 1)))
    y = F.coalesce(_int(x, ymd, 1), _int(x, dm, 3), _int(x, first, 3), _int(x, second, 3))
    m = F.when(x.rlike(ymd), _int(x, ymd, 2)).when(x.rlike(dm), None).otherwise(F.coalesce(month1, month2))
    d = F.when(x.rlike(ymd), _int(x, ymd, 3)).when(x.rlike(dm), None).otherwise(F.coalesce(_int(x, first, 1), _int(x, second, 2)))
    return F.struct(
        epoch.alias("epoch"), y.alias("y"), m.alias("m"), d.alias("d"),
        _int(x, dm, 1).alias("a"), _int(x, dm, 2).alias("b"), us.alias("us"), offset.alias("off"), letters.alias("letters"),
    )


def _letter_offset(letters: Column, zone: Column) -> Column:
    found = F.when(letters.isin(*_UTC), 0)
    for (name, start), minutes in LETTERS_IN.items():
        found = found.when((letters == name) & zone.startswith(start), minutes)
    table = F.create_map(*[F.lit(v) for kv in LETTERS.items() for v in kv])
    return found.otherwise(F.get(F.array(F.try_element_at(table, F.coalesce(letters, F.lit("")))), F.lit(0)))


def _weights(patterns: DataFrame) -> DataFrame:
    """Mixture weights of ORDERS by source (of) from rows of source, prior and three likelihoods."""
    n = len(ORDERS)
    grouped = patterns.groupBy("source", "date_order", "l").agg(F.count(F.lit(1)).cast("double").alias("c"))
    lists = grouped.groupBy("source", "date_order").agg(F.collect_list(F.struct("l", "c")).alias("rows"))
    prior = F.array(*[F.when(F.col("date_order") == o, PRIOR).otherwise(OTHER) for o in ORDERS])

    def step(w: Column, _: Column) -> Column:
        def post(r: Column, k: int) -> Column:
            total = sum((w[j] * r["l"][j] for j in range(1, n)), w[0] * r["l"][0])
            return F.when(total > 0, r["c"] * w[k] * r["l"][k] / total).otherwise(0.0)

        def mass_of(k: int) -> Column:
            return F.aggregate("rows", prior[k], lambda acc, r: acc + post(r, k))

        mass = [mass_of(k) for k in range(n)]
        total = mass[0] + mass[1] + mass[2]
        return F.transform(F.array(*mass), lambda v: v / total)

    start = F.transform(prior, lambda v: v / (prior[0] + prior[1] + prior[2]))
    return lists.select(F.col("source").alias("of"), F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step).alias("w"))


def normalise_times(df: DataFrame, profiles: DataFrame, time: str = "time", key: str = "raw_id", source: str = "source_name", fetched: str = "fetched_at") -> DataFrame:
    """``key``, ``source``, order (the reading chosen of an all-numeric date, else null), posterior,
    ambiguous and epoch_us, the instant in microseconds, of every row of ``df``.

    ``profiles`` has source_name, zone_id and date_order. A text without a possible date (null,
    blank, relative, impossible, a time of day alone) has a null epoch_us; parts not given are
    zero. A time without offset or zone is local in the zone of its source, UTC if the source has
    no profile or no valid zone; in a repeated hour the first pass counts, in a skipped one the
    offset before the change. A null source or a null time of fetching only lacks that evidence.
    Rows are kept as they are, repeated ones too; no rows give no rows. A profile that is listed
    twice would repeat rows and is reduced to one.
    """
    one = profiles.groupBy(F.col("source_name").alias("ps")).agg(F.min_by(F.struct("zone_id", "date_order"), F.struct("zone_id", "date_order")).alias("p")).where("ps is not null")
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.to_date(F.col(fetched)).alias("seen"), F.col(time).alias("time"))
    rows = rows.withColumn("t", parse_parts(F.col("time"))).drop("time")
    rows = rows.join(one, F.col("source") == F.col("ps"), "left").select("key", "source", "seen", "t", "p.zone_id", "p.date_order")
    t = F.col("t")
    days = {"mdy": _day_number(t["y"], t["a"], t["b"]), "dmy": _day_number(t["y"], t["b"], t["a"]), "ymd": _day_number(t["y"], t["m"], t["d"])}
    lag = {o: F.unix_date("seen") - v for o, v in days.items()}
    like = [F.when(days[o].isNull(), 0.0).when(F.coalesce(lag[o].between(-1, NEAR_DAYS), F.lit(True)), 1.0).otherwise(FAR) for o in ORDERS]
    rows = rows.select("*", F.array(*[days[o] for o in ORDERS]).alias("days"), F.array(*like).alias("l"))
    numeric = t["a"].isNotNull()
    weights = _weights(rows.where(numeric).select("source", "date_order", "l"))
    rows = rows.join(weights, F.col("source").eqNullSafe(F.col("of")), "left")
    # a source without a numeric date has no weights, and no need of any
    w = F.coalesce("w", F.array(*[F.lit(1 / 3)] * 3))
    scores = F.transform(F.arrays_zip(w.alias("w"), F.col("l").alias("l")), lambda z: z["w"] * z["l"])
    rows = rows.withColumn("score", scores).withColumn("best", F.array_max("score"))
    pick = F.array_position("score", F.col("best")).cast("int")
    total = F.aggregate("score", F.lit(0.0), lambda a, v: a + v)
    day = F.when(F.col("best") > 0, F.get("days", pick - 1))
    local = day.cast("bigint") * 86_400_000_000 + t["us"]
    offset = F.coalesce(t["off"], _letter_offset(t["letters"], F.coalesce("zone_id", F.lit(""))))
    zone = F.when(F.col("zone_id").rlike(r"^(?:UTC|GMT|[A-Za-z]+(?:/[A-Za-z0-9_+-]+){1,2})$"), F.col("zone_id")).otherwise("UTC")
    instant = F.when(offset.isNotNull(), local - offset.cast("bigint") * 60_000_000).otherwise(F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), zone)))
    return rows.select(
        F.col("key").alias(key),
        F.col("source").alias(source),
        F.when(numeric & (F.col("best") > 0), F.get(F.array(*map(F.lit, ORDERS)), pick - 1)).alias("order"),
        F.when(numeric & (total > 0), F.col("best") / total).alias("posterior"),
        F.coalesce(numeric & (total > 0) & (F.col("best") / total <= AMBIGUOUS), F.lit(False)).alias("ambiguous"),
        F.coalesce(F.col("t.epoch"), instant).alias("epoch_us"),
    )


def wrong_dates(items: DataFrame, times: DataFrame, key: str = "item_id", raw_key: str = "raw_id", date: str = "source_date") -> DataFrame:
    """``key`` and epoch_us of the items that are dated other than the listing row they came from.
    ``times`` is of :func:`normalise_times`, keyed by ``raw_key``. Items without a listing row,
    with an undated one or without a date of their own have no row."""
    dated = times.where("epoch_us is not null").select(F.col(raw_key).alias("rk"), "epoch_us")
    both = items.where(F.col(raw_key).isNotNull()).select(key, raw_key, date).join(dated, F.col(raw_key) == F.col("rk"))
    return both.where(F.unix_micros(F.col(date)) != F.col("epoch_us")).select(key, "epoch_us")
