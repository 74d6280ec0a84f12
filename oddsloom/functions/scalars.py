"""Cleaning and parsing functions as Column expressions. Spark runs in ANSI mode, so casts are tried."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of Asian lines.
LINE_NAMES = {
    "平手": 0.0, "平": 0.0, "半球": 0.5, "一球": 1.0, "球半": 1.5, "一球半": 1.5, "两球": 2.0, "两球半": 2.5, "三球": 3.0, "三球半": 3.5,
    "四球": 4.0, "四球半": 4.5, "五球": 5.0, "五球半": 5.5, "六球": 6.0, "六球半": 6.5, "半": 0.5, "一": 1.0, "两": 2.0, "三": 3.0, "四": 4.0, "五": 5.0,
}
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def identifier(value: Column) -> Column:
    """Text of an id: null for nothing, integral numbers without a fraction."""
    number_ = value.try_cast("double")
    integral = value.rlike(r"^\s*-?\d+\.0+\s*$")
    return F.when(value.isNull() | (value == ""), None).when(integral, number_.cast("bigint").cast("string")).otherwise(F.trim(value))


def number(value: Column) -> Column:
    """A finite double, or null."""
    x = value.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def timestamp(value: Column, anchor: Column, offset_hours: int | None = 8) -> Column:
    """UTC time of ``M-D HH:MM[:SS]`` (year nearest ``anchor``), six comma parts with a zero-based month, or ISO text.

    Text without an offset is read at ``offset_hours``; with no such offset it is null.
    """
    s = F.trim(value)
    shift = F.expr(f"INTERVAL {offset_hours or 0} HOURS")

    def local(x: Column) -> Column:
        return x - shift if offset_hours is not None else F.lit(None).cast("timestamp")

    short = s.rlike(r"^\d{1,2}-\d{1,2} \d{2}:\d{2}(:\d{2})?$")
    parts = F.split(s, "[- ]")
    clock = F.when(F.length(F.get(parts, F.lit(2))) == 5, F.concat(F.get(parts, F.lit(2)), F.lit(":00"))).otherwise(F.get(parts, F.lit(2)))

    def in_year(k: int) -> Column:
        year = (F.year(anchor) + k).cast("string")
        return F.try_to_timestamp(F.concat_ws("", year, F.lit("-"), F.lpad(F.get(parts, F.lit(0)), 2, "0"), F.lit("-"), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm:ss"))

    choices = F.filter(F.array(in_year(-1), in_year(0), in_year(1)), lambda x: x.isNotNull())
    gap = F.transform(choices, lambda x: F.struct(F.abs(F.unix_micros(x) - F.unix_micros(anchor)).alias("gap"), x.alias("at")))
    nearest = F.get(F.array_sort(gap), F.lit(0))["at"]
    bits = F.split(s, ",")
    month = F.get(bits, F.lit(1))
    zero_based = F.when(month.rlike("^[0-9]+-1$"), F.regexp_extract(month, "^([0-9]+)-1$", 1).try_cast("int") - 1).otherwise(month.try_cast("int"))
    comma = F.when(F.size(bits) == 6, F.try_make_timestamp(F.get(bits, F.lit(0)).try_cast("int"), zero_based + 1, *(F.get(bits, F.lit(k)).try_cast("int") for k in (2, 3, 4)), F.get(bits, F.lit(5)).try_cast("decimal(8,6)")))
    zoned = s.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    iso = F.when(zoned, s.try_cast("timestamp")).otherwise(local(s.try_cast("timestamp")))
    return F.when(short, local(nearest)).when(s.contains(","), local(comma)).when(s != "", iso)


def asian_line(raw: Column, market: Column) -> Column:
    """A line from a number, a fraction of two or a name; named handicaps are negative unless received."""
    s = F.trim(raw)
    receiving = s.startswith("受")
    body = F.regexp_replace(s, "^受让?", "")
    names = F.create_map(*(x for k, v in LINE_NAMES.items() for x in (F.lit(k), F.lit(v))))
    nums = F.transform(F.split(body, "/"), lambda p: F.coalesce(F.try_element_at(names, p), number(p)))
    line = F.when(~F.exists(nums, lambda x: x.isNull()), F.aggregate(nums, F.lit(0.0), lambda a, x: a + x) / F.size(nums))
    named = (market == "ah") & body.rlike("[平半球一两三四五六]")
    return F.when(named, F.when(receiving, F.abs(line)).otherwise(-F.abs(line))).otherwise(line)


def fold(text: Column) -> Column:
    """Lower case, full-width characters narrowed, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, WIDE, NARROW)), r"\s+", " "))


def fold_strict(text: Column) -> Column:
    """As ``fold``, keeping word characters and CJK only."""
    return F.regexp_replace(F.lower(F.translate(text, WIDE, NARROW)), r"[^\w㐀-鿿]+", "")


# fixed values: words that name no club
STOP_WORDS = ("fc", "cf", "afc", "sc", "ac", "calcio", "football", "club")


def name_tokens(name: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    plain = F.lower(F.translate(name, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"))
    return F.array_distinct(F.filter(F.split(F.regexp_replace(plain, "[^a-z0-9]+", " "), " "), lambda t: (t != "") & ~t.isin(*stop)))


def name_score(a: Column, b: Column) -> Column:
    """1 for equal names, else the greater of token Jaccard and 0.92 for containment."""
    ta, tb = name_tokens(a), name_tokens(b)
    sa, sb = F.concat_ws(" ", ta), F.concat_ws(" ", tb)
    jaccard = F.size(F.array_intersect(ta, tb)) / F.greatest(F.size(F.array_union(ta, tb)), F.lit(1))
    inside = F.when((sa != "") & (sb != "") & (sa.contains(sb) | sb.contains(sa)), 0.92).otherwise(0.0)
    return F.when((sa == sb) & (sa != ""), 1.0).when((sa == "") | (sb == ""), 0.0).otherwise(F.greatest(jaccard, inside))


def stable_id(prefix: str, text: Column, length: int = 16) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text, 256), 1, length))


# fixed values: forms of access tokens and keys, and named secrets
SECRET = r"(?i)(?:gh[pousr]_[a-z0-9]{20,}|github_pat_[a-z0-9_]{20,}|sk-[a-z0-9_-]{20,}|-----begin [a-z ]*private key-----|bearer\s+[a-z0-9._~+/=-]{8,}|(?:api[_-]?key|token|secret|password|cookie)\s*[:=]\s*[^\s,;]+)"
HOME_PATH = r"(?:[A-Za-z]:\\[^\s\"']+|/(?:home|Users)/[^\s\"']+)"


def redact(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SECRET, "[REDACTED]"), HOME_PATH, "[REDACTED_PATH]")


def has_secret(text: Column) -> Column:
    return F.coalesce(text.rlike(SECRET), F.lit(False))


def season_start(text: Column, low: int = 1900, high: int = 2200) -> Column:
    year = F.regexp_extract(text, r"(\d{4})", 1).try_cast("int")
    return F.when(year.between(low, high), year)


def freshness(age_hours: Column, hard: float, soft: float) -> Column:
    return F.when(age_hours > hard, "STALE_BLOCK").when(age_hours > soft, "STALE_WARNING").otherwise("FRESH")


def schedule_pressure(rest_days: Column, next_days: Column, travel_km: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(rest_days < 3, "REST_LT_3D").when(rest_days < 4, "REST_LT_4D"),
            F.when(next_days <= 3, "NEXT_PRIORITY_LE_3D").when(next_days <= 5, "NEXT_PRIORITY_LE_5D"),
            F.when(travel_km >= 2500, "LONG_TRAVEL"),
        )
    )


def draw_branch(label: Column) -> Column:
    return F.when(label.isin("1", "EXCLUDED"), "EXCLUDED").when(label.isin("0", "NOT_EXCLUDED"), "NOT_EXCLUDED").otherwise("UNKNOWN")


def lead_lag(lead_minutes: Column, followed: Column) -> Column:
    """Six labels from who moved first and whether the other side followed."""
    return (
        F.when(lead_minutes.isNull(), "LEAD_UNKNOWN")
        .when((lead_minutes > 0) & followed, "SECONDARY_LEADS_CONFIRMED")
        .when((lead_minutes > 0) & followed.isNull(), "SECONDARY_LEADS_PENDING")
        .when(lead_minutes > 0, "SECONDARY_LEADS_UNCONFIRMED")
        .when(lead_minutes < 0, "MAINSTREAM_LEADS")
        .otherwise("SIMULTANEOUS")
    )


def match_status(state: Column, has_score: Column) -> Column:
    return F.when((state == "-1") | has_score, "finished").when(state == "0", "pre_match").otherwise("UNKNOWN")


def alias_product(home: Column, away: Column) -> Column:
    return F.flatten(F.transform(home, lambda h: F.transform(away, lambda a: F.concat(h, F.lit(" vs "), a))))
