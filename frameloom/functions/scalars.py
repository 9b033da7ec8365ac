"""Scalar expressions on sizes, times, paths, patterns and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB = 1024.0
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mkv", ".mov")


def one_decimal(x: Column) -> Column:
    """Text with one decimal, rounded from the exact binary value, exact halves to the even digit, as C's ``%.1f`` does."""
    return F.replace(F.format_number(x.cast("double"), 1), F.lit(","), F.lit(""))


def format_size(size: Column, units: tuple[str, ...] = ("B", "KB", "MB", "GB", "TB")) -> Column:
    """1536 as ``1.5 KB``; the last unit is unbounded."""
    out = None
    for i, unit in enumerate(units[:-1]):
        text = F.concat(one_decimal(size / KIB**i), F.lit(f" {unit}"))
        out = F.when(size < KIB ** (i + 1), text) if out is None else out.when(size < KIB ** (i + 1), text)
    return out.otherwise(F.concat(one_decimal(size / KIB ** (len(units) - 1)), F.lit(f" {units[-1]}")))


def format_mib(size: Column) -> Column:
    """1572864 as ``1.5 Mo``."""
    return F.concat(one_decimal(size / KIB**2), F.lit(" Mo"))


def format_seconds(seconds: Column) -> Column:
    """12.25 as ``12.2s``."""
    return F.concat(one_decimal(seconds), F.lit("s"))


def format_mmss(seconds: Column) -> Column:
    """Minutes unbounded, fractions dropped."""
    return F.format_string("%02d:%02d", F.floor(seconds / 60), F.floor(F.pmod(seconds, F.lit(60.0))))


def format_eta(seconds: Column) -> Column:
    """``1h 02m 03s`` above an hour, else ``02m 03s``."""
    h, m, s = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600.0)) / 60), F.floor(F.pmod(seconds, F.lit(60.0)))
    return F.when(seconds > 3600, F.format_string("%dh %02dm %02ds", h, m, s)).otherwise(F.format_string("%02dm %02ds", F.floor(seconds / 60), s))


def progress_seconds(line: Column) -> Column:
    """Whole seconds of ``time=HH:MM:SS.hh``, null if absent."""
    part = [F.regexp_extract(line, r"time=(\d{2}):(\d{2}):(\d{2})\.\d{2}", i).try_cast("long") for i in (1, 2, 3)]
    return part[0] * 3600 + part[1] * 60 + part[2]


def progress_fraction_seconds(line: Column) -> Column:
    """Seconds with fraction of ``time=H:M:S.f``, null if absent."""
    part = [F.regexp_extract(line, r"time=(\d+):(\d+):(\d+\.\d+)", i).try_cast("double") for i in (1, 2, 3)]
    return part[0] * 3600 + part[1] * 60 + part[2]


def progress_split_seconds(line: Column) -> Column:
    """Seconds of what follows ``time=`` up to white space, if it is three numbers between colons; null otherwise."""
    said = F.split(F.regexp_extract(line, r"time=\s*(\S+)", 1), ":")
    part = [F.get(said, F.lit(i)).try_cast("double") for i in range(3)]
    return F.when(F.size(said) == 3, part[0] * 3600 + part[1] * 60 + part[2])


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def extension(path: Column) -> Column:
    """From the last dot of the name; leading dots don't count."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.substr(name, F.lit(1), F.length(name) - F.length(extension(path)))


def percent(part: Column, whole: Column) -> Column:
    """Truncated, at most 100; 0 without a whole."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.least(F.try_divide(part * 100.0, whole).cast("int"), F.lit(100)))


def darker(lightness: Column, by: int = 50) -> Column:
    """A colour's lightness (0 to 255) less ``by``, at least 0."""
    return F.greatest(lightness - by, F.lit(0))


def reduction_percent(before: Column, after: Column) -> Column:
    return F.when(before > 0, (before - after) / before * 100).otherwise(F.lit(0.0))
