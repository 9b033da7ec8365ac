"""Routing, outcome and statistics of conversion jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.scalars import one_decimal

THRESHOLD = 100 * 1024 * 1024
ATTEMPTS = 3


def should_convert(exists: Column, is_file: Column, ratio: Column, size: Column, ignore_converted: bool = True, threshold: int | None = THRESHOLD) -> Column:
    """First reason against, in order, or ``convert``."""
    out = F.when(~exists, "missing").when(~is_file, "not a file")
    if ignore_converted:
        out = out.when(ratio > 0, "already converted")
    if threshold is not None:
        out = out.when(size <= threshold, "below threshold")
    return out.otherwise("convert")


def within(size: Column, threshold: float | None) -> Column:
    return F.lit(True) if threshold is None else size <= threshold


def accepted(before: Column, after: Column, attempt: Column, threshold: float | None, several: bool = True) -> Column:
    fits = within(after, threshold)
    return (after < before) & (fits | F.lit(not several) | (attempt >= ATTEMPTS))


def outcome(before: Column, after: Column, attempt: Column, threshold: float | None, several: bool = True) -> Column:
    """reduced, reduced above threshold, not smaller, or above threshold."""
    ok, fits = accepted(before, after, attempt, threshold, several), within(after, threshold)
    return F.when(ok & fits, "reduced").when(ok, "reduced above threshold").when(after >= before, "not smaller").otherwise("above threshold")


def original_goes(ok: Column, after: Column, threshold: float | None, if_smaller: bool, if_above: bool) -> Column:
    """Whether the original is deleted after an accepted result."""
    return ok & F.lit(if_smaller) & (within(after, threshold) | F.lit(if_above))


def original_fate(ok: Column, after: Column, threshold: float | None, replace: bool, if_smaller: bool, if_above: bool) -> Column:
    """What becomes of the original: replaced, deleted or kept."""
    if replace:
        return F.when(ok, "replaced").otherwise("kept")
    return F.when(original_goes(ok, after, threshold, if_smaller, if_above), "deleted").otherwise("kept")


def message(before: Column, after: Column, attempt: Column, threshold: float | None, several: bool = True) -> Column:
    """The text shown for an attempt; null while another attempt follows."""
    ok, fits = accepted(before, after, attempt, threshold, several), within(after, threshold)
    rate = (before - after) / before * 100
    final = F.lit(not several) | (attempt >= ATTEMPTS)
    return (
        F.when(ok & fits, F.concat(F.lit("Succès (-"), one_decimal(rate), F.lit("%)"))).when(ok, F.concat(F.lit("Réduit (-"), one_decimal(rate), F.lit("%) mais > seuil")))
        .when(final & (after >= before), F.concat(F.lit("Échec: taille finale +"), one_decimal(-rate), F.lit("%")))
        .when(final, F.concat(F.lit("Échec: taille finale (-"), one_decimal(rate), F.lit("%) > seuil")))
    )


def selected(ratio: Column, ignore_converted: bool = True) -> Column:
    """Chosen at first: not converted before, or such files aren't ignored."""
    return ~F.coalesce(ratio > 0, F.lit(False)) | F.lit(not ignore_converted)


def list_state(ratio: Column) -> Column:
    return F.when(ratio > 0, F.concat(F.lit("Déjà converti (-"), one_decimal(ratio), F.lit("%)"))).otherwise("En attente")


#: Defaults of the settings, and attempts where none are listed.
DEFAULTS = {
    "use_size_threshold": True, "size_threshold": THRESHOLD, "manual_mode": False, "crf": 28, "preset": "medium", "delete_if_smaller": False, "delete_if_threshold": False,
    "replace_original": False, "ignore_converted": True, "multiple_attempts": True,
}
DEFAULT_ATTEMPTS = ((28, "medium"), (30, "slow"), (32, "veryslow"))
SETTINGS = (
    "struct<use_size_threshold: boolean, size_threshold: long, manual_mode: boolean, crf: int, preset: string, delete_if_smaller: boolean, delete_if_threshold: boolean, replace_original: boolean, "
    "ignore_converted: boolean, multiple_attempts: boolean, attempts: array<struct<crf: int, preset: string>>>"
)


def settings_of(text: Column) -> Column:
    """Struct of all settings that a JSON text gives; fields that it lacks, or all if it can't be read, are the defaults."""
    read = F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, SETTINGS))

    def attempt(crf: Column, preset: Column) -> Column:
        return F.struct(F.coalesce(crf, F.lit(DEFAULTS["crf"])).alias("crf"), F.coalesce(preset, F.lit(DEFAULTS["preset"])).alias("preset"))

    listed = F.transform(read["attempts"], lambda a: attempt(a["crf"], a["preset"]))
    usual = F.array(*[attempt(F.lit(c), F.lit(p)) for c, p in DEFAULT_ATTEMPTS])
    fields = [F.coalesce(read[k], F.lit(v).cast("long") if k == "size_threshold" else F.lit(v)).alias(k) for k, v in DEFAULTS.items()]
    return F.struct(*fields, F.when(F.coalesce(F.size(listed), F.lit(0)) > 0, listed).otherwise(usual).alias("attempts"))


def attempt_parameters(settings: Column, attempt: Column) -> Column:
    """Struct (codec, crf, preset) of an attempt; null where the settings list fewer attempts."""
    listed = F.get(settings["attempts"], attempt - 1)
    chosen = F.when(settings["manual_mode"], F.struct(settings["crf"].alias("crf"), settings["preset"].alias("preset"))).otherwise(listed)
    return F.when(chosen.isNotNull(), F.struct(F.lit("libx264").alias("codec"), chosen["crf"].alias("crf"), chosen["preset"].alias("preset")))


#: Parameters by attempt with a change of codec.
PROGRESSIVE = {1: ("libx264", 23, "medium"), 2: ("libx264", 28, "slow"), 3: ("libx265", 32, "veryslow")}


def progressive_parameters(attempt: Column) -> Column:
    """Struct (codec, crf, preset) of the progressive table; null beyond it."""
    out = None
    for n, (codec, crf, preset) in PROGRESSIVE.items():
        value = F.struct(F.lit(codec).alias("codec"), F.lit(crf).alias("crf"), F.lit(preset).alias("preset"))
        out = F.when(attempt == n, value) if out is None else out.when(attempt == n, value)
    return out


def transcode_command(source: Column, target: Column, parameters: Column) -> Column:
    """Array of the arguments that an encoder process would get; starting it is the caller's."""
    return F.array(
        F.lit("ffmpeg"), F.lit("-i"), source, F.lit("-c:v"), parameters["codec"], F.lit("-crf"), parameters["crf"].cast("string"), F.lit("-preset"), parameters["preset"],
        F.lit("-y"), target,
    )


def first_accepted(attempts: DataFrame, key: list[str], threshold: float | None) -> DataFrame:
    """attempts (key, before, attempt, after): the first accepted attempt of each key, else its last."""
    ok = accepted(F.col("before"), F.col("after"), F.col("attempt"), threshold)
    rank = F.struct((~ok).alias("refused"), F.when(ok, F.col("attempt")).otherwise(-F.col("attempt")).alias("order"))
    chosen = attempts.groupBy(*key).agg(F.min_by(F.struct("attempt", "after", ok.alias("accepted")), rank).alias("c"))
    return chosen.select(*key, F.col("c.attempt").alias("attempt"), F.col("c.after").alias("after"), F.col("c.accepted").alias("accepted"))


def statistics(jobs: DataFrame) -> DataFrame:
    """jobs (before, after, attempts, success): one row; without rows all are 0."""
    ok = F.col("success")
    ratio = F.when(F.col("before") > 0, F.col("after") / F.col("before")).otherwise(F.lit(0.0))
    return jobs.agg(
        F.coalesce(F.sum(F.when(ok, F.col("before") - F.col("after"))), F.lit(0.0)).alias("space_saved"),
        F.coalesce(F.avg(F.when(ok, ratio)), F.lit(0.0)).alias("avg_ratio"),
        F.coalesce(F.avg(F.when(ok, 1.0).otherwise(0.0)), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg("attempts"), F.lit(0.0)).alias("avg_attempts"),
    )
