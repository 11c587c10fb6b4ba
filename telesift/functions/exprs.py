"""Column functions for titles, times, tags and broadcast fields."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WIDE_DIGITS = "０１２３４５６７８９"
BROADCAST_FLAGS = r"(\s*\[[^\[]*\])+\s*$"
DIGIT, ZERO, OTHER = "[0-9０-９]", "[0０]", "[1-9１-９]"


def up_to(n: str) -> str:
    """A pattern of numbers of as many digits as n that are n or less, without a zero in front."""
    out = []
    for i, c in enumerate(n):
        least = "1" if i == 0 else "0"
        below = chr(ord(c) - (i < len(n) - 1))
        if below >= least:
            wide = lambda x: WIDE_DIGITS[int(x)]
            head = "".join(f"[{x}{wide(x)}]" for x in n[:i])
            out.append(f"{head}[{least}-{below}{wide(least)}-{wide(below)}]" + f"{DIGIT}{{{len(n) - 1 - i}}}")
    return f"(?:{'|'.join(out)})"


#: Digits of an episode number, after zeros: four at most.  The fifth of a number up to 65535 counts for its value, but
#: stays in the text; larger numbers are none.
NUMBER = f"(?={DIGIT})(?:({ZERO}*(?:{OTHER}{DIGIT}{{0,3}})?)(?!{DIGIT})|({ZERO}*(?={up_to('65535')}){DIGIT}{{4}})(?=({DIGIT})))"
#: series, number after a number sign, number between 第 and 話, rest
EPISODE = rf"(?s)^(.*?)(?:[#＃]{NUMBER}|第[ 　]*{NUMBER}(?:[ 　]*話)?)(.*)$"


def trim_u(x: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def ascii_fold(x: Column) -> Column:
    """A-Z lower-cased, all else unchanged: how text is compared."""
    return F.translate(x, UPPER, UPPER.lower())


def contains_folded(x: Column, needle: str) -> Column:
    """Literal substring search that ignores the case of A-Z only."""
    return ascii_fold(x).contains(needle.translate(str.maketrans(UPPER, UPPER.lower())))


def like_escape(x: Column) -> Column:
    """Backslash before backslash, percent sign and underscore."""
    for c in ("\\", "%", "_"):
        x = F.replace(x, F.lit(c), F.lit("\\" + c))
    return x


def fmt_ms(ms: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on; negative times are 0."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000)
    h, m, sec = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, sec)).otherwise(F.format_string("%02d:%02d", m, sec))


def fmt_ms_millis(ms: Column) -> Column:
    """HH:MM:SS.mmm with as many hours as it takes."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, ms % 1000)


def display_title(title: Column, episode: Column, subtitle: Column) -> Column:
    """Title, #episode and subtitle, as far as they are there, with a blank between."""
    return F.concat_ws(" ", F.nullif(title, F.lit("")), F.concat(F.lit("#"), episode.cast("string")), F.nullif(trim_u(subtitle), F.lit("")))


def time_range(start: Column, end: Column) -> Column:
    return F.concat(fmt_ms(start), F.lit(" – "), fmt_ms(end))


def tag_list(x: Column) -> Column:
    """Lines of a text, trimmed, without the blank ones; repeats stay."""
    return F.filter(F.transform(F.split(x, "\n"), trim_u), lambda t: t != "")


@F.pandas_udf(StringType())
def normalize_title(x: pd.Series) -> pd.Series:
    """NFKC, then lower case."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).lower())


def program_key(series: Column, title: Column) -> Column:
    """The series if there is one, else the title unless it is unknown, else empty."""
    series, title = F.coalesce(series, F.lit("")), F.coalesce(title, F.lit(""))
    return F.when(series != "", series).when(title != "(unknown)", title).otherwise("")


def file_stem(path: Column) -> Column:
    """The last part of a path without its extension; null if there is none."""
    return F.nullif(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?/*$", 1), F.lit(""))


def strip_icons(x: Column) -> Column:
    """Without the enclosed characters U+1F100 to U+1F2FF."""
    return F.regexp_replace(x, r"[\x{1F100}-\x{1F2FF}]", "")


def strip_flags(x: Column) -> Column:
    """Without flags in square brackets at the end."""
    return trim_u(F.regexp_replace(trim_u(x), BROADCAST_FLAGS, ""))


def number(digits: Column) -> Column:
    """An integer from ASCII or full-width digits; null without any."""
    return F.nullif(F.translate(digits, WIDE_DIGITS, "0123456789"), F.lit("")).cast("int")


def leading_number(x: Column) -> Column:
    """struct(value, digits) of the number that a text starts with: its value and the digits it takes; null if there is none."""
    pattern = f"^{NUMBER}"
    plain, head, fifth = (F.regexp_extract(x, pattern, i) for i in (1, 2, 3))
    return F.when(x.rlike(pattern), F.struct(number(F.concat(plain, head, fifth)).alias("value"), F.char_length(F.concat(plain, head)).alias("digits")))


def series_episode(title: Column) -> Column:
    """struct(series, episode, subtitle) of a title: #N or 第N話, else split at the first blank."""
    hit = title.rlike(EPISODE)

    def part(i):
        return F.regexp_extract(title, EPISODE, i)

    episode = F.when(hit, F.coalesce(number(part(2)), number(F.concat(part(3), part(4))), number(part(5)), number(F.concat(part(6), part(7)))))
    blank = r"(?s)^([^ 　]*)[ 　](.*)$"
    series = F.when(hit, trim_u(part(1))).when(title.rlike(blank), trim_u(F.regexp_extract(title, blank, 1))).otherwise(trim_u(title))
    rest = F.when(hit, part(8)).when(title.rlike(blank), F.regexp_extract(title, blank, 2)).otherwise("")
    return F.struct(series.alias("series"), episode.alias("episode"), F.nullif(strip_flags(rest), F.lit("")).alias("subtitle"))


def bcd_byte(b: Column) -> Column:
    """Two decimal digits packed in a byte; null if a half is above 9."""
    hi, lo = F.shiftright(b, 4), b.bitwiseAND(F.lit(15))
    return F.when((hi <= 9) & (lo <= 9), hi * 10 + lo)


def decode_mjd(mjd: Column, h: Column, m: Column, s: Column) -> Column:
    """Wall-clock time from a modified Julian date and BCD hour, minute, second; null if any is invalid."""
    h, m, s = bcd_byte(h), bcd_byte(m), bcd_byte(s)
    day = F.date_add(F.lit("1858-11-17").cast("date"), mjd.cast("int"))
    good = (mjd != 0xFFFF) & (h < 24) & (m < 60) & (s < 60)
    return F.when(good, F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), F.when(good, h).otherwise(0), F.when(good, m).otherwise(0), F.when(good, s).otherwise(0)))


def air_date(start_jst: Column, modified_utc: Column) -> Column:
    """The date on air: of the start time, else of the file's time shifted to Japan."""
    return F.coalesce(F.to_date(start_jst), F.to_date(modified_utc + F.expr("INTERVAL 9 HOURS")))


def parse_pts(b0: Column, b1: Column, b2: Column, b3: Column, b4: Column) -> Column:
    """A 33-bit presentation time from its five bytes."""
    b0, b1, b2, b3, b4 = (b.cast("long") for b in (b0, b1, b2, b3, b4))

    high = F.shiftleft(F.shiftright(b0, 1).bitwiseAND(F.lit(7)), 30)
    middle = F.shiftleft(b1, 22).bitwiseOR(F.shiftleft(F.shiftright(b2, 1), 15))
    return high.bitwiseOR(middle).bitwiseOR(F.shiftleft(b3, 7)).bitwiseOR(F.shiftright(b4, 1))


def cache_paths(stem: Column, caption_id: Column, frame: Column) -> Column:
    """Where the images of a caption are kept."""
    return F.struct(F.format_string("%s/thumbs/%d_%02d.jpg", stem, caption_id, frame).alias("thumb"), F.format_string("%s/full/%d_%02d.jpg", stem, caption_id, frame).alias("full"), F.format_string("%s/preview/%d.jpg", stem, caption_id).alias("preview"), F.format_string("%s/sub/%d.png", stem, caption_id).alias("sub"))


def active_query(x: Column) -> Column:
    """The trimmed query if it has two bytes or more, else null."""
    t = trim_u(x)
    return F.when(F.octet_length(t) >= 2, t)
