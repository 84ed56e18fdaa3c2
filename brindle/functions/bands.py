"""Urgency bands, remaining-time texts, progress and square-root milestones as column expressions.

Every function takes seconds (double) or timestamps as columns; the as-of time is always an argument.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band codes and their labels.
LABELS = {"expired": "已逝", "critical": "危急", "long_term": "悠远", "C": "紧迫", "B": "适中", "A": "从容", "out": "特殊"}
#: Progress: fixed shares, or (weeks of the band, lowest, highest) for a share that falls with the hours left.
FIXED_PROGRESS = {"expired": 1.0, "critical": 0.95, "long_term": 0.05}
CLAMPED_PROGRESS = {"C": (3, 0.7, 0.9), "B": (9, 0.4, 0.65), "A": (12, 0.15, 0.35)}


def remaining_seconds(as_of: Column, deadline: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", as_of, deadline) / 1e6


def band(seconds: Column) -> Column:
    """Code of the first band that holds; the order matters, since the bands are not monotone."""
    hours, days = seconds / 3600, seconds / 86400
    weeks = days / 7
    rules = (
        ("expired", seconds <= 0),
        ("critical", hours < 4),
        ("long_term", weeks > 12),
        ("C", hours.between(4, 24)),
        ("C", days.between(1, 2)),
        ("C", weeks.between(1, 3)),
        ("B", (days > 2) & (days <= 4)),
        ("B", (weeks > 3) & (weeks <= 9)),
        ("A", (days > 4) & (days <= 7)),
        ("A", (weeks > 9) & (weeks <= 12)),
    )
    out = F.lit("out")
    for code, holds in reversed(rules):
        out = F.when(holds, code).otherwise(out)
    return out


def label(code: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))[code]


def remaining_text(seconds: Column) -> Column:
    """Days, hours and minutes left or gone; fractions of a second are cut off toward zero."""
    whole = seconds.cast("bigint")
    size = F.abs(whole)
    days, hours, minutes = F.floor(size / 86400), F.floor(size % 86400 / 3600), F.floor(size % 3600 / 60)
    hm, m = F.format_string("%d时%d分", hours, minutes), F.format_string("%d分", minutes)
    gone = F.when(days > 0, F.format_string("%d日%d时", days, hours)).when(hours > 0, hm).otherwise(m)
    left = F.when(days > 0, F.concat(F.format_string("%d日", days), hm)).when(hours > 0, hm).otherwise(m)
    return F.when(whole <= 0, F.concat(F.lit("已逝 "), gone)).otherwise(F.concat(F.lit("余 "), left))


def progress(seconds: Column, code: Column) -> Column:
    out = F.lit(0.5)
    for name, share in FIXED_PROGRESS.items():
        out = F.when(code == name, share).otherwise(out)
    for name, (weeks, low, high) in CLAMPED_PROGRESS.items():
        out = F.when(code == name, F.greatest(F.lit(low), F.least(F.lit(high), 1 - seconds / 3600 / (weeks * 168)))).otherwise(out)
    return out


def month_day(t: Column) -> Column:
    return F.concat(F.month(t), F.lit("/"), F.dayofmonth(t))


def ordinal(n: Column) -> Column:
    return F.format_string("%02d", n)


@dataclass(frozen=True)
class Milestones:
    first: Column
    second: Column
    first_formula: Column
    second_formula: Column


def milestones(seconds: Column, as_of: Column, days_only: bool = False) -> Milestones:
    """Two dates on the way to the deadline, at the square root of what is left and of what is left then.

    In days if at least two whole ones are left (halves round to even), else in hours if at least two are. With
    ``days_only`` shorter spans have none.
    """
    days = F.bround(seconds / 86400).cast("bigint")
    hours = F.bround(seconds / 86400 * 24).cast("bigint")
    by_day = days >= 2
    total = F.when(by_day, days).when(F.lit(not days_only) & (hours >= 2), hours)
    n1 = F.floor(F.sqrt(total))
    rest = total - n1
    n2 = F.when(rest > 0, F.floor(F.sqrt(rest))).otherwise(0)
    unit = F.when(by_day, "日").otherwise("时")

    def formula(of: Column, n: Column) -> Column:
        return F.concat(F.lit("√"), of, F.when(F.abs(F.sqrt(of) - n) < 0.001, " = ").otherwise(" ≈ "), n, unit)

    def moment(n: Column) -> Column:
        day = month_day(F.date_add(F.to_date(as_of), n.cast("int")))
        then = F.timestamp_add("HOUR", n.cast("int"), as_of)
        clock = F.date_format(then, "HH:mm")
        hour = F.when(F.to_date(then) == F.to_date(as_of), clock).otherwise(F.concat(month_day(then), F.lit(" "), clock))
        return F.when(total.isNotNull(), F.when(by_day, day).otherwise(hour))

    has_second = n2 > 0
    return Milestones(moment(n1), F.when(has_second, moment(n1 + n2)), formula(total, n1), F.when(has_second, formula(rest, n2)))


def log_position(hours: Column, most: Column) -> Column:
    """Place on a timeline from 0 to 100, near items spread out."""
    return F.when(most > 0, F.log1p(hours) / F.log1p(most) * 100).otherwise(0.0)


def stars(score: Column) -> Column:
    return F.least(F.lit(5), F.ceil(score / 2)).cast("int")


def file_kind(path: Column) -> Column:
    """video, audio or text by the extension, other otherwise."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("mp4", "mov", "avi", "mkv", "flv", "wmv", "webm"), "video").when(ext.isin("mp3", "wav", "m4a", "flac", "aac", "ogg"), "audio").when(ext.isin("txt", "md", "doc", "docx", "pdf", "html"), "text").otherwise("other")
