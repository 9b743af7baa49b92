import pytest
from helpers import JAVA_TRACE, NODE_TRACE
from pyspark.sql import functions as F

from faultsift.functions import fingerprint as fp
from faultsift.functions import frames as fr
from faultsift.functions import text as tx
from faultsift.operators import grouping

PAIRS = [
    ("order 8f14e45f-ceea-467a-9a1e-6b19d2f0e1a1 not found", "order <uuid> not found"),
    ("connection to 10.0.14.7:5432 refused", "connection to <ip> refused"),
    ("user alice@example.com is unknown", "user <email> is unknown"),
    ("GET https://api.example.com/v2/carts failed", "GET <url> failed"),
    ("retry 3 of 5 after 250 ms", "retry <num> of <num> after <num> ms"),
    ("expected at 2026-08-07T11:57:26Z", "expected at <timestamp>"),
    ("object at 0x7ffee3b2c9a0 released", "object at <hex> released"),
    ("checksum d41d8cd98f00b204e9800998ecf8427e mismatch", "checksum <hex> mismatch"),
    ("cannot read /var/lib/app/data/cache.db", "cannot read <path>"),
    ("too   many\n\tspaces", "too many spaces"),
    (None, ""), ("   ", ""), ("cart is empty", "cart is empty"),
    ("1,a", "<num>a"), ("é12", "é<num>"), ("\u2003wide\u2003", "wide"),
]


def test_message_pairs(spark):
    df = spark.createDataFrame(PAIRS, "given string, wanted string")
    bad = df.withColumn("got", tx.normalize_message(F.col("given"))).filter("got <> wanted")
    assert bad.collect() == []


def test_types_and_titles(spark):
    df = spark.createDataFrame([
        ("a.b.C$$Lambda$12/0x1", "a.b.C"), ("a.b.C$3", "a.b.C"), (" a.B ", "a.B"),
        (None, "<unknown>"), ("  ", "<unknown>"), ("a.Outer$Inner", "a.Outer$Inner")],
        "given string, wanted string")
    assert df.filter(tx.normalize_type(F.col("given")) != F.col("wanted")).collect() == []
    t = spark.createDataFrame([("a.b.NPE", "cart <num> is empty"), ("x.", ""), ("E", "m" * 300)],
                              "k string, m string")
    got = [r[0] for r in t.select(tx.title(F.col("k"), F.col("m"))).collect()]
    assert got[0] == "NPE: cart <num> is empty" and got[1] == "x."
    assert len(got[2]) == 200 and got[2].endswith("…")


def _frames(spark, trace, maker):
    return spark.createDataFrame([(trace,)], "t string").select(maker(F.col("t"))).first()[0]


def test_java_trace(spark):
    frames = _frames(spark, JAVA_TRACE, fr.java_frames)
    assert len(frames) == 6
    own = [f"{f.declaring_class}#{f.function}" for f in frames if f.in_app]
    assert own == ["com.example.checkout.CartService#total",
                   "com.example.checkout.CheckoutController#submit",
                   "com.example.checkout.CartService#validate"]
    assert frames[2].module == "java.base" and frames[0].line == 42


@pytest.mark.parametrize("line,field,value", [
    ("\tat com.example.Generated.run(Unknown Source)", "file", "Unknown Source"),
    ("\tat com.example.Generated.run(Unknown Source)", "line", -1),
    ("\tat com.example.Service.<init>(Service.java:12)", "function", "<init>"),
    ("\tat com.example.Service.lambda$total$3(Service.java:30)", "function", "lambda$total"),
    ("\tat com.example.Service.lambda$5(Service.java:30)", "function", "lambda"),
])
def test_java_lines(spark, line, field, value):
    assert getattr(_frames(spark, line, fr.java_frames)[0], field) == value


def test_node_trace(spark):
    frames = _frames(spark, NODE_TRACE, fr.javascript_frames)
    assert len(frames) == 5 and sum(f.in_app for f in frames) == 2
    assert (frames[0].function, frames[0].file, frames[0].line) == (
        "resolveUser", "src/services/user.js", 31)
    assert frames[2].module == "express" and frames[2].declaring_class == "Layer"


@pytest.mark.parametrize("line,expected", [
    ("    at new Checkout (/app/src/checkout.js:22:11)", {"function": "Checkout"}),
    ("    at /app/src/anon.js:3:9", {"function": None, "file": "src/anon.js"}),
    ("    at Array.map (<anonymous>)", {"in_app": False}),
    ("    at Object.<anonymous> (/app/index.js:1:1)",
     {"declaring_class": "Object", "function": "<anonymous>"}),
    ("    at file:///app/src/esm.mjs:5:11", {"file": "src/esm.mjs", "line": 5}),
    ("    at total (/home/dev/work/checkout/src/cart.js:10:5)", {"file": "src/cart.js"}),
    ("    at boot (/app/index.js:1:1)", {"file": "index.js"}),
    ("    at async Promise.all (index 0)", {"in_app": False}),
    ("    at total (cart.js:10:5)", {"in_app": True, "file": "cart.js"}),
    ("    at a (/x/src/y/lib/z.js:1:2:3)", {"file": "lib/z.js:1", "line": 2}),
    ("    at a (C:\\w\\src\\b.js:7)", {"file": "src/b.js", "line": 7}),
    ("    at .hidden (/a/src/)", {"function": ".hidden", "declaring_class": None, "file": "src"}),
])
def test_v8_lines(spark, line, expected):
    frame = _frames(spark, line, fr.javascript_frames)[0]
    assert {k: getattr(frame, k) for k in expected} == expected


def test_empty_location_is_no_frame(spark):
    assert _frames(spark, "    at foo ()\n    at \nnot a frame", fr.javascript_frames) == []


def test_confidence(spark):
    df = spark.createDataFrame([(JAVA_TRACE,), (NODE_TRACE,), (None,), (" ",)], "t string")
    got = [tuple(r) for r in df.select(fr.java_confidence(F.col("t")),
                                       fr.javascript_confidence(F.col("t"))).collect()]
    assert got[0][0] > 50 and got[1][1] > 50 and got[2] == (0, 0) and got[3] == (0, 0)


def _fp(spark, rows, version):
    cols = "service string, platform string, exception_type string, message string, stacktrace string"
    return fp.with_fingerprint(spark.createDataFrame(rows, cols), version).select(
        "fingerprint", "degraded_reason", "culprit", "title", "fingerprint_input").collect()


def _java(*frames):
    return "x.E: m\n" + "\n".join(f"\tat {f}" for f in frames)


A = ["com.acme.A.alpha(A.java:1)", "com.acme.B.beta(B.java:2)", "com.acme.C.gamma(C.java:3)"]


@pytest.mark.parametrize("left,right,v1,v2", [
    (_java(*A), _java(*[f.replace("java:", "java:9") for f in A]), True, True),
    (_java(*A, "org.springframework.X.x(X.java:1)"), _java(*A, "org.apache.Y.y(Y.java:1)"), True, True),
    (_java(*A, "com.acme.D.delta(D.java:1)"), _java(*A, "com.acme.E.eps(E.java:1)"), False, True),
    (_java(A[0], "com.acme.X.xray(X.java:1)"), _java(A[0], "com.acme.Y.yolk(Y.java:1)"), False, False),
    ("E: m\n    at Object.<anonymous> (/a/src/index.js:1:1)",
     "E: m\n    at Object.<anonymous> (/a/src/worker.js:1:1)", True, False),
])
def test_same_or_different(spark, left, right, v1, v2):
    for version, same in ((1, v1), (2, v2)):
        a, b = _fp(spark, [("s", None, "x.E", "m 1", t) for t in (left, right)], version)
        assert (a.fingerprint == b.fingerprint) is same


def test_fingerprint_rules(spark):
    for version in (1, 2):
        rows = _fp(spark, [
            ("s", None, "x.NPE", "cart 41 is empty", None),
            ("s", None, "x.NPE", "cart 77 is empty", None),
            ("t", None, "x.NPE", "cart 77 is empty", None),
            ("s", None, "x.E", "m", _java("org.springframework.A.a(A.java:1)")),
            ("s", None, "E", "m", "E: x\n    at q (https://c.example.com/bundle.min.js:1:5)"),
            ("s", None, "E", "m", "E: x\n    at q (https://c.example.com/bundle.min.js:1:9)"),
            ("s", None, "E", "m", _java("com.example.Checkout$CartService.total(Checkout.java:42)")),
            ("s", "java", "E", "m", NODE_TRACE),
        ], version)
        assert rows[0].fingerprint == rows[1].fingerprint != rows[2].fingerprint
        assert rows[0].degraded_reason == "no_frames" and rows[0].culprit is None
        assert rows[0].title == "NPE: cart <num> is empty" and len(rows[0].fingerprint) == 32
        assert rows[3].degraded_reason == "no_in_app_frames"
        assert rows[3].culprit == "org.springframework.A#a"
        assert rows[4].degraded_reason == "minified" and rows[4].fingerprint == rows[5].fingerprint
        assert rows[6].culprit == "com.example.Checkout$CartService#total"
        assert rows[7].degraded_reason == "no_frames"
    with pytest.raises(ValueError):
        fp.version(3)


def test_replay_merges_splits_and_control(spark):
    index = "E: m\n    at Object.<anonymous> (/a/src/index.js:1:1)"
    worker = "E: m\n    at Object.<anonymous> (/a/src/worker.js:1:1)"
    rows = [("e1", _java(*A, "com.acme.D.delta(D.java:1)")), ("e2", _java(*A, "com.acme.E.eps(E.java:1)")),
            ("e3", index), ("e4", worker)]
    base = spark.createDataFrame(rows, "event_id string, stacktrace string").select(
        "*", F.lit("s").alias("service"), F.lit(None).cast("string").alias("platform"),
        F.lit("x.E").alias("exception_type"), F.lit("m").alias("message"),
        F.timestamp_seconds(F.lit(0)).alias("received_at"))
    stored = fp.with_fingerprint(base, 1)
    groups = stored.groupBy("group_id").agg(F.min("title").alias("title"))
    again = grouping.replay(stored, 1)
    assert grouping.replay_merges(again, groups).count() == 0
    assert grouping.replay_splits(again, groups).count() == 0
    changed = grouping.replay(stored, 2)
    assert [r.members for r in grouping.replay_merges(changed, groups).collect()] == [2, 2]
    assert [r["into"] for r in grouping.replay_splits(changed, groups).collect()] == [2]
    untraced = stored.withColumn("stacktrace", F.lit(None).cast("string"))
    c = grouping.replay_coverage(grouping.replay(untraced, 2), groups, 2).first()
    assert (c.groups_total, c.groups_covered, c.events_replayed) == (3, 0, 0)
    assert grouping.replay(stored, 2, limit=2).agg(F.sum("events")).first()[0] == 2


def test_first_frame_line_is_found_as_by_splitting(spark):
    from faultsift.functions import frames, text

    ends = ["\n", "\r\n", "\r", "\x0b", "\x85", " "]
    traces = [end.join(parts) for end in ends for parts in (
        ["x", "at ", "  at a.B.c(D.java:1)"], ["at a.B.c(D.java:1)"], ["", "\x1c　at a.B.c(D)", "at b"],
        ["xat a", "at\t", " at  "], ["Caused by: at y", "\tat z \t"])]
    df = spark.createDataFrame([(t,) for t in traces], "t string")
    lines = F.filter(F.split("t", r"\R"), lambda l: text.strip(l).startswith("at "))
    for r in df.select(F.coalesce(F.get(lines, F.lit(0)), F.lit("")).alias("old"),
                       F.regexp_extract("t", frames.FIRST_AT, 1).alias("new")).collect():
        assert r.old == r.new
