"""Versioned fault fingerprints: which frames count, what is hashed, how it reads.

A version is a (frame limit, signature) pair in ``VERSIONS``; published versions stay
frozen, because the version is part of a group's key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultsift.functions import frames as fr
from faultsift.functions import text as tx

MINIFIED_MIN_FRAMES = 3
MINIFIED_SHARE = 0.6


def _function_name(frame: Column) -> Column:
    return F.coalesce(tx.blank_to_null(frame["function"]), F.lit("<anonymous>"))


def scope_signature(frame: Column) -> Column:
    """``class#function``, or the file where there is no class."""
    scope = F.coalesce(tx.blank_to_null(frame["declaring_class"]),
                       tx.blank_to_null(frame["file"]), F.lit("<unknown>"))
    return F.concat(scope, F.lit("#"), _function_name(frame))


def file_repeats_class(file: Column, declaring_class: Column) -> Column:
    stem = F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")
    outer = F.substring_index(declaring_class, "$", 1)
    return (outer == stem) | outer.endswith(F.concat(F.lit("."), stem))


def file_scope_signature(frame: Column) -> Column:
    """Like ``scope_signature`` but keeps a file that says more than the class does."""
    scope, file = tx.blank_to_null(frame["declaring_class"]), tx.blank_to_null(frame["file"])
    keeps_file = scope.isNotNull() & file.isNotNull() & ~file_repeats_class(file, scope)
    return F.when(keeps_file, F.concat(file, F.lit(":"), scope, F.lit("#"),
                                       _function_name(frame))
                  ).otherwise(scope_signature(frame))


@dataclass(frozen=True)
class Version:
    number: int
    max_frames: int
    signature: Callable[[Column], Column]


VERSIONS: dict[int, Version] = {
    1: Version(1, 8, scope_signature),
    2: Version(2, 3, file_scope_signature),
}


def version(number: int) -> Version:
    if number not in VERSIONS:
        raise ValueError(f"unknown fingerprint version {number}; known: {sorted(VERSIONS)}")
    return VERSIONS[number]


def looks_minified(in_app: Column) -> Column:
    short = F.size(F.filter(in_app, lambda f: F.length(f["function"]) <= 2))
    return (F.exists(in_app, lambda f: F.coalesce(f["file"].contains(".min."), F.lit(False)))
            | ((F.size(in_app) >= MINIFIED_MIN_FRAMES)
               & (short / F.size(in_app) >= MINIFIED_SHARE)))


def with_frames(df: DataFrame) -> DataFrame:
    """Add ``resolved_platform``, ``frames`` and ``in_app_frames``."""
    return (df
            .withColumn("resolved_platform", fr.resolve_platform(df["platform"], df["stacktrace"]))
            .withColumn("frames", fr.frames_for(F.col("resolved_platform"), F.col("stacktrace")))
            .withColumn("in_app_frames", F.filter("frames", lambda f: f["in_app"])))


def with_fingerprint(df: DataFrame, number: int = 1) -> DataFrame:
    """Add fingerprint, version, input, title, culprit, degraded_reason and frames.

    Needs service, platform, exception_type, message, stacktrace. Row-local: it runs
    inside the scan stage and adds no exchange.
    """
    v = version(number)
    empty = F.array().cast(fr.FRAME_TYPE)
    staged = (
        with_frames(df)
        .withColumn("normalized_message", tx.normalize_message(F.col("message")))
        .withColumn("normalized_type", tx.normalize_type(F.col("exception_type")))
        .withColumn("degraded_reason",
                    F.when(F.size("frames") == 0, F.lit("no_frames"))
                    .when(F.size("in_app_frames") == 0, F.lit("no_in_app_frames"))
                    .when(looks_minified(F.col("in_app_frames")), F.lit("minified")))
        .withColumn("_selected",
                    F.when(F.col("degraded_reason") == "no_in_app_frames", F.col("frames"))
                    .when(F.col("degraded_reason").isNull(), F.col("in_app_frames"))
                    .otherwise(empty)))
    identity = F.when(
        F.size("_selected") == 0,
        F.concat(F.lit("message="), F.col("normalized_message"))
    ).otherwise(F.array_join(
        F.transform(F.slice("_selected", 1, v.max_frames),
                    lambda f: F.concat(F.lit("frame="), v.signature(f))), "\n"))
    lead = F.coalesce(F.get("in_app_frames", F.lit(0)), F.get("frames", F.lit(0)))
    return (
        staged
        .withColumn("fingerprint_input", F.concat_ws(
            "\n", F.lit(f"v{v.number}"),
            F.concat(F.lit("platform="), F.col("resolved_platform")),
            F.concat(F.lit("service="), F.col("service")),
            F.concat(F.lit("type="), F.col("normalized_type")),
            identity,
            F.concat(F.lit("degraded="), F.col("degraded_reason"))))
        # Never null by construction; said so to the optimizer, which would otherwise
        # push a null test of this whole expression below every later join.
        .withColumn("fingerprint", F.coalesce(
            F.substring(F.sha2("fingerprint_input", 256), 1, 32), F.lit("")))
        .withColumn("fingerprint_version", F.lit(v.number))
        .withColumn("group_id", group_key(F.col("fingerprint"), F.col("fingerprint_version")))
        .withColumn("title", tx.title(F.col("normalized_type"), F.col("normalized_message")))
        .withColumn("culprit", F.when(F.size("frames") > 0, v.signature(lead)))
        .drop("_selected"))


def group_key(fingerprint: Column, number: Column) -> Column:
    """Group id derived from the composite key: stable across runs, no join needed."""
    return F.concat(fingerprint, F.lit("-v"), number.cast("string"))
