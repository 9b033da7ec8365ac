"""Checks that give the first failure or collect all of them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes, formats, codecs and message parts that decide.
SCHEMES = ("http", "https", "ftp", "rtsp", "rtmp")
FORMATS = (".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm", ".m4v", ".3gp", ".ogv", ".ts", ".m2ts", ".mts")
LARGEST = 50 * 1024**3
VIDEO_CODECS = ("libx264", "libx265", "libvpx-vp9", "mpeg4")
AUDIO_CODECS = ("aac", "mp3", "libvorbis", "flac")
CORRUPTED, UNSUPPORTED = ("moov atom not found", "corrompue"), ("format non supporté",)
#: Types that extensions stand for where a type is checked.
MIME = {
    ".mp4": "video/mp4", ".m4v": "video/x-m4v", ".avi": "video/x-msvideo", ".mkv": "video/x-matroska", ".mov": "video/quicktime", ".wmv": "video/x-ms-wmv", ".flv": "video/x-flv",
    ".webm": "video/webm", ".3gp": "video/3gpp", ".ogv": "video/ogg", ".ts": "video/mp2t", ".m2ts": "video/mp2t", ".mts": "video/mp2t", ".mp3": "audio/mpeg", ".txt": "text/plain",
}
IDLE_STATES = ("idle", "error")
ERROR_PREFIX = "Erreur"
LARGEST_BATCH = 1000


def file_check(exists: Column, is_file: Column, extension: Column, size: Column, mime: Column) -> Column:
    return (
        F.when(~exists, "missing").when(~is_file, "not a file").when(~F.lower(extension).isin(*FORMATS), "unsupported format")
        .when(size == 0, "empty").when(size > LARGEST, "too large").when(mime.isNotNull() & ~mime.startswith("video/"), "not a video").otherwise("valid")
    )


def mime_of(extension: Column) -> Column:
    """Type that the extension stands for, null if unknown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair]), F.lower(extension))


def directory_check(exists: Column, is_directory: Column, writable: Column, must_exist: bool = True, check_writable: bool = False) -> Column:
    out = F.when(exists & ~is_directory, "not a directory")
    if must_exist:
        out = F.when(~exists, "missing").when(exists & ~is_directory, "not a directory")
    if check_writable:
        out = out.when(exists & ~writable, "not writable")
    return out.otherwise("valid")


def busy(state: Column) -> Column:
    return ~state.isin(*IDLE_STATES)


def is_error_state(state: Column) -> Column:
    return state.startswith(ERROR_PREFIX)


def batch_check(files: Column, valid: Column, most: int = LARGEST_BATCH) -> Column:
    """Array of the errors of a whole batch; those of its files are rows of their own."""
    found = F.array(
        F.when(files == 0, "no file"), F.when(files > most, F.concat(F.lit("too many files ("), files.cast("string"), F.lit(f" > {most})"))),
        F.when((files > 0) & (valid == 0), "no valid file"),
    )
    return F.filter(found, lambda e: e.isNotNull())


def range_check(value: Column, low=None, high=None) -> Column:
    out = F.when(value.isNull(), "not a number")
    if low is not None:
        out = out.when(value < low, "too small")
    if high is not None:
        out = out.when(value > high, "too large")
    return out.otherwise("valid")


def starts_with_pattern(value: Column, pattern: str) -> Column:
    return value.rlike(f"^(?:{pattern})")


def valid_url(url: Column) -> Column:
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return scheme.isin(*SCHEMES) & (F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1) != "")


def parameter_errors(crf: Column, video: Column, audio: Column, width: Column, height: Column) -> Column:
    """Array of all errors."""
    both = width.isNotNull() & height.isNotNull()
    found = F.array(
        F.when(~crf.between(0, 51), "crf"), F.when(~video.isin(*VIDEO_CODECS), "video codec"), F.when(~audio.isin(*AUDIO_CODECS), "audio codec"),
        F.when(both & ~width.between(1, 7680), "width"), F.when(both & ~height.between(1, 7680), "height"),
    )
    return F.filter(found, lambda e: e.isNotNull())


def error_route(message: Column) -> Column:
    def holds(parts: tuple[str, ...]) -> Column:
        return reduce(or_, [message.contains(p) for p in parts])

    return F.when(holds(CORRUPTED), "corrupted").when(holds(UNSUPPORTED), "unsupported").otherwise("other")
