"""Stack traces to arrays of frames, row-local and without Python workers.

Each line is rewritten once by a regex into separator-joined groups and split;
lines that are no frames do not split and fall out by their size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultsift.functions.text import WHITESPACE, blank_to_null, is_blank, strip

# ---- fixed values ---------------------------------------------------------------
JAVA_FRAME = r"^\s*at\s+(?:([\w.$]+)/)?([\w.$]+)\.([\w$<>]+)\(([^)]*)\)\s*$"
JAVA_SOURCE = r"^.+?:\d+$"
JAVA_VENDOR_PREFIXES = (
    "java.", "javax.", "jakarta.", "jdk.", "sun.", "com.sun.", "org.springframework.",
    "org.apache.", "org.hibernate.", "org.eclipse.", "org.jboss.", "org.slf4j.",
    "ch.qos.logback.", "com.zaxxer.", "org.postgresql.", "com.fasterxml.",
    "tools.jackson.", "io.netty.", "reactor.", "org.junit.", "org.mockito.",
    "org.testcontainers.", "org.flywaydb.", "kotlin.", "scala.", "groovy.",
    "org.codehaus.groovy.",
)
_LINE_END = r"\n\x0B\f\r\x85\u2028\u2029"
_INDENT = "".join(c for c in WHITESPACE if c not in "\n\x0b\f\r\u2028\u2029")
FIRST_AT = (rf"(?:\A|\R)([{_INDENT}]*at [^{_LINE_END}]*[^{_INDENT}{_LINE_END}][^{_LINE_END}]*)")
V8_FRAME = r"^\s*at\s+(?:(.*?)\s+\((.*)\)|(.*?))\s*$"
V8_LOCATION = r"^(.*?):(\d+)(?::(\d+))?$"
NODE_MODULE = r"^.*node_modules/([^/]+)/(.*)$"
SOURCE_ROOTS = ("src", "dist", "lib", "build", "out", "pages", "components", "server")
JAVA_ALIASES = ("java", "jvm", "kotlin", "scala")
JAVASCRIPT_ALIASES = ("javascript", "js", "node", "nodejs", "typescript", "ts")
# -----------------------------------------------------------------------------------

_SEP = "\u0001"
FRAME_TYPE = ("array<struct<module:string,declaring_class:string,function:string,"
              "file:string,line:int,in_app:boolean>>")


def _lines(trace: Column) -> Column:
    return F.split(trace, r"\R")


def _groups(trace: Column, pattern: str, count: int) -> Column:
    layout = _SEP.join(f"${i}" for i in range(1, count + 1))
    split = F.transform(
        _lines(trace), lambda line: F.split(F.regexp_replace(line, pattern, layout), _SEP))
    return F.filter(split, lambda parts: F.size(parts) == count)


def _starts_with_any(c: Column, prefixes) -> Column:
    quoted = "|".join(p.replace(".", r"\.") for p in prefixes)
    return c.rlike(f"^(?:{quoted})")


def declared_platform(name: Column) -> Column:
    """Wire name to platform: a known alias, else 'unknown'."""
    key = F.lower(F.btrim(name, F.lit("".join(map(chr, range(33))))))
    return (F.when(key.isin(*JAVA_ALIASES), F.lit("java"))
            .when(key.isin(*JAVASCRIPT_ALIASES), F.lit("javascript"))
            .otherwise(F.lit("unknown")))


def java_confidence(trace: Column) -> Column:
    # The first line that starts with "at " once trimmed; a search stops there, splitting would not.
    first_at = F.regexp_extract(trace, FIRST_AT, 1)
    points = (F.when(trace.contains(".java:"), 50).otherwise(0)
              + F.when(trace.contains("Caused by:"), 20).otherwise(0)
              + F.when(trace.contains("common frames omitted") | trace.contains("more"), 10)
              .otherwise(0)
              + F.when(first_at.rlike(JAVA_FRAME), 30).otherwise(0))
    return F.when(~is_blank(trace), F.least(points, F.lit(100))).otherwise(0)


def javascript_confidence(trace: Column) -> Column:
    points = (F.when(trace.rlike(r"(?m):\d+:\d+\)?\s*$"), 60).otherwise(0)
              + F.when(trace.contains("node_modules/") | trace.contains("node:internal"), 25)
              .otherwise(0)
              + F.when(trace.contains(".js") | trace.contains(".ts") | trace.contains(".mjs"), 15)
              .otherwise(0))
    return F.when(~is_blank(trace), F.least(points, F.lit(100))).otherwise(0)


def resolve_platform(declared: Column, trace: Column) -> Column:
    """A declared platform is trusted; otherwise the more confident format wins."""
    known = declared_platform(declared)
    # The one-element transform binds both, which would otherwise be computed twice.
    both = F.array(F.struct(java_confidence(trace).alias("java"), javascript_confidence(trace).alias("js")))
    found = F.transform(both, lambda c: F.when((c["java"] > 0) & (c["java"] >= c["js"]), F.lit("java"))
                        .when(c["js"] > 0, F.lit("javascript")).otherwise(F.lit("unknown")))
    return F.when(known != "unknown", known).otherwise(F.get(found, F.lit(0)))


def java_method(name: Column) -> Column:
    return F.when(name.startswith("lambda"), F.regexp_replace(
        name, r"^(lambda(?:\$.*)?)\$\d*$", "$1")).otherwise(name)


def java_in_app(declaring_class: Column) -> Column:
    return ~_starts_with_any(declaring_class, JAVA_VENDOR_PREFIXES)


def java_frames(trace: Column) -> Column:
    def frame(g: Column) -> Column:
        source = g[3]
        numbered = source.rlike(JAVA_SOURCE)
        number = F.substring_index(source, ":", -1)
        return F.struct(
            F.nullif(g[0], F.lit("")).alias("module"),
            g[1].alias("declaring_class"),
            java_method(g[2]).alias("function"),
            F.when(numbered, F.left(source, F.length(source) - F.length(number) - 1))
            .otherwise(blank_to_null(source)).alias("file"),
            F.when(numbered, F.coalesce(number.try_cast("int"), F.lit(-1)))
            .otherwise(-1).alias("line"),
            java_in_app(g[1]).alias("in_app"))

    return F.transform(_groups(trace, JAVA_FRAME, 4), frame)


def _slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def _in_node_module(path: Column) -> Column:
    # The byte search spares most paths the regex.
    return path.contains("node_modules/") & path.rlike(NODE_MODULE)


def javascript_in_app(p: Column) -> Column:
    """Of a path with forward slashes."""
    outside = (p.contains("node_modules/") | p.startswith("node:") | p.startswith("internal/")
               | (p == "native") | p.startswith("<anonymous>"))
    return ~outside & (p.contains("/") | p.contains("."))


def javascript_frames(trace: Column) -> Column:
    """V8 call sites as frames; the steps bind what the next one mentions repeatedly."""
    def place(g: Column) -> Column:
        # Groups 2 and 3 exclude each other, so joining them picks the location.
        return F.concat(g[1], g[2])

    def called(g: Column) -> Column:
        name = strip(F.regexp_replace(strip(g[0]), r"^(?:async )?(?:new )?", ""))
        located = F.split(F.regexp_replace(_slashed(place(g)), V8_LOCATION, f"$1{_SEP}$2"), _SEP)
        return F.struct(name.alias("name"), located.alias("at"))

    def pathed(s: Column) -> Column:
        path = s["at"][0]
        return F.struct(
            blank_to_null(s["name"]).alias("name"), path.alias("path"),
            F.when(path.startswith("file://"), F.substring(path, 8, 1 << 30)).otherwise(path)
            .alias("clean"),
            F.coalesce(F.get(s["at"], F.lit(1)).try_cast("int"), F.lit(-1)).alias("line"))

    def rooted(s: Column) -> Column:
        # From the last source root on; still led by a slash where there is none.
        whole = F.concat(F.lit("/"), F.rtrim(s["clean"], F.lit("/")))
        roots = "|".join(SOURCE_ROOTS)
        return F.struct(
            s["name"].alias("name"), s["path"].alias("path"), s["clean"].alias("clean"),
            s["line"].alias("line"),
            F.regexp_replace(whole, f"^.*/((?:{roots})/.*)$", "$1").alias("tail"))

    def frame(s: Column) -> Column:
        name, clean, tail = s["name"], s["clean"], s["tail"]
        dotted = F.substring(name, 2, 1 << 30).contains(".")
        last = F.substring_index(name, ".", -1)
        file = (F.when(_in_node_module(clean),
                       F.regexp_replace(clean, NODE_MODULE, "node_modules/$1/$2"))
                .when(clean.startswith("node:") | ~clean.contains("/"), clean)
                .when(tail.startswith("/"), F.substring_index(tail, "/", -1))
                .otherwise(tail))
        return F.struct(
            F.when(_in_node_module(s["path"]), F.regexp_extract(s["path"], NODE_MODULE, 1))
            .alias("module"),
            F.when(dotted, F.left(name, F.length(name) - F.length(last) - 1))
            .alias("declaring_class"),
            F.when(dotted, last).otherwise(name).alias("function"),
            file.alias("file"), s["line"].alias("line"),
            javascript_in_app(s["path"]).alias("in_app"))

    sites = F.filter(_groups(trace, V8_FRAME, 3), lambda g: ~is_blank(place(g)))
    steps = F.transform(F.transform(F.transform(sites, called), pathed), rooted)
    return F.transform(steps, frame)


def frames_for(platform: Column, trace: Column) -> Column:
    """Frames by platform; an empty array when there is nothing to read."""
    empty = F.array().cast(FRAME_TYPE)
    readable = ~is_blank(trace)
    return (F.when(readable & (platform == "java"), java_frames(trace))
            .when(readable & (platform == "javascript"), javascript_frames(trace))
            .otherwise(empty))
