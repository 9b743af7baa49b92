"""Secret scans: base patterns, and weak parts of credentials that are linked by an interval join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # runs of fewer never count, and runs are whole
# Parts that count beside others only.
ENDPOINT = r"""(?:https?|ftp|ssh|jdbc:[a-z]+|mongodb|postgres|mysql|redis|amqp)://[^\s"'<>|]+"""
LOGIN = r"""(?i)(?:username|user|login|client_id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
KINDS = ("assign", "access", "hex", "weak_secret", "weak_access", "login", "endpoint")
BLOCK = 64
NOWHERE = -(1 << 30)  # before every place of a text
SPAN = "array<struct<start:int,turn:int,end:int,kind:string>>"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _found(text: Column, pattern: str, needed: Column | None = None) -> Column:
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return hits if needed is None else F.when(needed, hits).otherwise(_none("array<string>"))


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, whole, joined) -> Column:
    """What `whole` gives for the first i values, for every i.

    In blocks of BLOCK values and over the blocks, so that no array grows by one element at a time: a row of n values
    costs BLOCK n / 2 + (n / BLOCK)^2 / 2 steps.
    """
    def over(blocks: Column) -> Column:
        before = _let(F.transform(blocks, whole), lambda tops: F.transform(
            tops, lambda _, b: whole(F.slice(tops, F.lit(1), b))))
        return F.flatten(F.zip_with(blocks, before, lambda block, base: F.transform(
            block, lambda _, j: joined(base, whole(F.slice(block, F.lit(1), j + 1))))))

    def blocks(known: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(known) - 1) / BLOCK).cast("int")),
                           lambda b: F.slice(known, b * BLOCK + 1, F.lit(BLOCK)))

    return _let(values, lambda known: F.when(F.size(known) > 0, _let(blocks(known), over)).otherwise(_none("array<int>")))


def _running_sum(values: Column) -> Column:
    return _running(values, lambda some: F.aggregate(some, F.lit(0), lambda a, x: a + x), lambda a, b: a + b)


def _running_max(values: Column) -> Column:
    return _running(values, lambda some: F.coalesce(F.array_max(some), F.lit(NOWHERE)), F.greatest)


def _places(hits: Column, text: Column, pattern: str) -> Column:
    """(start, end) of every match: lengths of the texts between the matches, added up."""
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    ends = _running_sum(F.zip_with(hits, between, lambda hit, gap: F.length(gap) + F.length(hit)))
    placed = F.zip_with(hits, ends, lambda hit, end: F.struct(
        (end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("hit")))
    return F.when(F.size(hits) > 0, placed).otherwise(_none("array<struct<start:int,end:int,hit:string>>"))


def _spans(places: Column, kind: str, keep=None) -> Column:
    chosen = places if keep is None else F.filter(places, keep)
    return F.transform(chosen, lambda p: F.struct(
        p["start"].alias("start"), F.lit(KINDS.index(kind)).alias("turn"), p["end"].alias("end"),
        F.lit(kind).alias("kind")))


def _swept(parts: Column, asked_at, sides: dict[str, Column], holds) -> Column:
    """The parts for which `holds`, given a part and by side the last end of all intervals of that side that
    start at or before `asked_at` of the part: parts and intervals are sorted by place into one line and swept once."""
    names = list(sides)
    nowhere, nobody = F.lit(NOWHERE), F.lit(None).cast("struct<start:int,turn:int,end:int,kind:string>")

    def point(at: Column, asks: int, ends: dict[str, Column], part: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(asks).alias("asks"), part.alias("part"),
                        *(ends.get(n, nowhere).alias(n) for n in names))

    def points(side: str) -> Column:
        return F.transform(sides[side], lambda o: point(o["start"], 0, {side: o["end"]}, nobody))

    def last_ends(line: Column, side: str) -> Column:
        return _running_max(F.transform(line, lambda x: x[side])).alias(side)

    def sweep(line: Column) -> Column:
        met = _let(F.struct(*(last_ends(line, n) for n in names)), lambda ends: F.transform(
            line, lambda x, i: F.struct(x["part"].alias("part"), *(ends[n][i].alias(n) for n in names))))
        return F.transform(F.filter(met, lambda x: x["part"].isNotNull() & holds(x["part"], x)), lambda x: x["part"])

    line = F.array_sort(F.concat(*(points(n) for n in names),
                                 F.transform(parts, lambda p: point(asked_at(p), 1, {}, p))))
    return F.when(F.size(parts) > 0, _let(line, sweep)).otherwise(_none(SPAN))


def find_secrets(docs: DataFrame, *, text_column: str = "text", carry: tuple[str, ...] = ("doc_id",),
                 reach: int = 160) -> DataFrame:
    """The carried columns, `base` and `spans`: arrays of (start, turn, end, kind), sorted, in code points.

    Base spans are whole matches: assignments of 12 characters or more to a telling name, access
    identifiers of 18 or more, runs of 16 or more lower-case hex digits. `spans` holds these and the linked weak
    parts. Weak parts are assignments of 6 to 11 characters, access identifiers below 18, logins, and
    endpoints (URLs). Each has a scope, `reach` code points to either side, and is joined with the
    parts whose interval meets it: an identifier or login counts beside a secret, a short secret beside an
    identifier, login or endpoint, an endpoint where a secret and an identifier or login are both in scope. Alone, weak
    parts are not reported. A weak part inside a base span is that span's.

    Column functions only, row by row and without a shuffle; parts and scopes are
    sorted by place and swept once. Null and empty texts have no spans; repeated rows stay; an empty table gives no
    rows; a carried column named `base` or `spans` is left out.
    """
    names = [n for n in carry if n.lower() not in ("base", "spans")]
    kept = [docs[n] for n in names]
    text = F.col("__text")
    cut = docs.select(*kept, F.coalesce(docs[text_column], F.lit("")).alias("__text"))
    cut = cut.select(*names, "__text", _found(text, ASSIGN).alias("__a"), _found(text, HEX).alias("__h"),
                     _found(text, ACCESS, F.contains(text, F.lit("AKIA"))).alias("__k"))
    secret = (F.size("__a") > 0) | (F.size("__h") > 0)
    cut = cut.select("*", _found(text, ENDPOINT, secret & F.contains(text, F.lit("://"))).alias("__e"),
                     _found(text, LOGIN, secret).alias("__l"))
    placed = cut.select(*names, *(_places(F.col(c), text, p).alias(c) for c, p in (
        ("__a", ASSIGN), ("__h", HEX), ("__k", ACCESS), ("__e", ENDPOINT), ("__l", LOGIN))))
    size = lambda p: F.length(F.regexp_extract(p["hit"], ASSIGN, 2))
    kinds = placed.select(
        *names,
        _spans(F.col("__a"), "assign", lambda p: size(p) >= 12).alias("assign"),
        _spans(F.col("__k"), "access", lambda p: F.length(p["hit"]) >= 18).alias("access"),
        _spans(F.col("__h"), "hex").alias("hex"),
        _spans(F.col("__a"), "weak_secret", lambda p: size(p).between(6, 11)).alias("weak_secret"),
        _spans(F.col("__k"), "weak_access", lambda p: F.length(p["hit"]) < 18).alias("weak_access"),
        _spans(F.col("__l"), "login").alias("login"), _spans(F.col("__e"), "endpoint").alias("endpoint"))
    sides = kinds.select(
        *names, "weak_secret", "endpoint", F.concat("assign", "access", "hex").alias("__base"),
        F.concat("assign", "hex", "weak_secret").alias("__secret"),
        F.concat("access", "weak_access", "login").alias("__who"), F.concat("weak_access", "login").alias("__weak"))
    weak = F.concat("weak_secret", "__weak", "endpoint")
    free = sides.withColumn("__free", _swept(weak, lambda p: p["start"], {"base": F.col("__base")},
                                             lambda p, last: last["base"] < p["end"]))

    def beside(p: Column, last: Column) -> Column:
        meets = lambda side: last[side] >= p["start"] - reach
        return (F.when(p["kind"] == "weak_secret", meets("who") | meets("endpoint"))
                .when(p["kind"] == "endpoint", meets("secret") & meets("who")).otherwise(meets("secret")))

    linked = _swept(F.col("__free"), lambda p: p["end"] + reach, {
        "secret": F.col("__secret"), "who": F.col("__who"), "endpoint": F.col("endpoint")}, beside)
    return free.select(*names, F.array_sort("__base").alias("base"),
                        F.array_sort(F.concat("__base", linked)).alias("spans"))


def described(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with every span, or group of overlapping spans, replaced by the mark."""
    walked = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when((s["start"] >= acc["at"]) & ((s["start"] > acc["at"]) | (acc["at"] == 0)), F.concat(
                acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
            .otherwise(acc["out"]).alias("out")))
    rest = lambda w: F.concat(w["out"], F.substring(text, w["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.transform(F.array(walked), rest)[0]).otherwise(text)
