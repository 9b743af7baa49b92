"""Readers for the star-schema Parquet tables, and the error feed made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trace(family: Column, k: Column, event_id: Column, user: Column) -> Column:
    """One stack trace per fault family; the line numbers vary, the frames do not."""
    line = (event_id % 500 + 1).cast("string")
    variant = (k % 4).cast("string")
    checkout = F.concat(
        F.lit("java.lang.IllegalStateException: cart is empty\n"
              "\tat com.acme.checkout.CartService.total(CartService.java:"), line,
        F.lit(")\n\tat com.acme.checkout.Cart$Line.lambda$sum$"), (user % 10).cast("string"),
        F.lit("(Cart.java:88)\n"
              "\tat java.base/java.lang.reflect.Method.invoke(Method.java:580)\n"
              "\tat org.springframework.web.Handler.invoke(Handler.java:255)\n"
              "Caused by: java.lang.NullPointerException: total\n"
              "\tat com.acme.checkout.Price.of(Price.java:"), line,
        F.lit(")\n\t... 46 common frames omitted"))
    node = F.concat(
        F.lit("TypeError: Cannot read properties of undefined\n"
              "    at Session.load"), (k % 2).cast("string"), F.lit(" (/app/"), user.cast("string"),
        F.lit("/src/services/user.js:"), line,
        F.lit(":18)\n    at async handler (file:///srv/dist/routes/cart.mjs:12:22)\n"
              "    at new Checkout (C:\\work\\lib\\checkout.ts:7:1)\n"
              "    at Layer.handle [as handle_request] "
              "(/app/node_modules/express/lib/router/layer.js:95:5)\n"
              "    at async Promise.all (index 0)\n"
              "    at /app/index"), variant,
        F.lit(".js:3:9\n"
              "    at processTicksAndRejections (node:internal/process/task_queues:95:5)"))
    vendor = F.concat(
        F.lit("org.postgresql.util.PSQLException: connection refused\n"
              "\tat org.postgresql.Driver.connect(Driver.java:"), line,
        F.lit(")\n\tat com.zaxxer.hikari.pool.HikariPool.<init>(Unknown Source)"))
    minified = F.concat(
        F.lit("Error: x\n    at a (https://cdn.example.com/bundle.min.js:1:"), line,
        F.lit(")\n    at b (https://cdn.example.com/bundle.min.js:1:77)"))
    nested = F.concat(
        F.lit("com.acme.ledger.PostingException: unbalanced\n"
              "\tat com.acme.ledger.Book$Entry.post(Book.java:"), line,
        F.lit(")\n\tat com.acme.ledger.Batch.run(Loader"), variant,
        F.lit(".java:9)\n"
              "\tat com.acme.ledger.Main.main(Main.java)"))
    return (F.when(family == "checkout", checkout)
            .when(family.isin("node", "mislabelled"), node)
            .when(family == "vendor", vendor)
            .when(family == "minified", minified)
            .when(family == "nested", nested))


def fault_feed(events: DataFrame) -> DataFrame:
    """Map every row of the ``events`` table to a raw error event.

    One fault family holds over a third of the rows; a tenth of the rows moves to one
    hour of its day (bursts); one service pauses for whole days; a tenth of the records is
    delivered twice; some are invalid and some use the legacy payload fields.
    """
    r, u = F.col("event_id"), F.col("user_id")
    base = events.select(
        "event_id", "user_id", "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.md5(r.cast("string")).alias("digest"))
    k, digest = F.col("k"), F.col("digest")
    family = (F.when(k < 35, "checkout").when(k < 55, "node").when(k < 65, "vendor")
              .when(k < 72, "minified").when(k < 78, "mislabelled").when(k < 95, "plain")
              .otherwise("nested"))
    moved = (
        F.when((F.col("event_type") == "signup") & (F.dayofmonth("ts") % 10 == 0),
               F.col("ts") - F.expr("interval 1 day"))
        .when(k % 10 == 0,
              F.expr("date_trunc('day', ts) + interval 13 hours + (ts - date_trunc('hour', ts))"))
        .otherwise(F.col("ts")))
    message = (
        F.when(r % 97 == 5, F.lit("   "))
        .when(r % 109 == 11, F.repeat(F.lit("m"), 4001))
        .when(r % 8 == 0, F.concat(F.lit("order "), _uuid(digest), F.lit(" not found")))
        .when(r % 8 == 1, F.concat(F.lit("connection to 10.0."), k.cast("string"), F.lit("."),
                                   (u % 256).cast("string"), F.lit(":5432 refused")))
        .when(r % 8 == 2, F.concat(F.lit("user user"), u.cast("string"),
                                   F.lit("@example.com is unknown")))
        .when(r % 8 == 3, F.concat(F.lit("GET https://api.example.com/v2/carts/"),
                                   r.cast("string"), F.lit(" failed")))
        .when(r % 8 == 4, F.concat(F.lit("retry "), k.cast("string"), F.lit(" of 5 after "),
                                   F.col("cents").cast("string"), F.lit(" ms")))
        .when(r % 8 == 5, F.concat(F.lit("expected at "),
                                   F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
        .when(r % 8 == 6, F.concat(F.lit("object at 0x"), F.substring(digest, 1, 8),
                                   F.lit(" checksum "), digest, F.lit(" mismatch")))
        .otherwise(F.concat(F.lit("cannot read /var/lib/app/"), k.cast("string"),
                            F.lit("/cache.db   twice\n\tagain"))))
    full_type = (
        F.when(family == "checkout", F.lit("java.lang.IllegalStateException"))
        .when(family.isin("node", "mislabelled"), F.lit("TypeError"))
        .when(family == "vendor", F.concat(F.lit("org.postgresql.util.PSQLException$$Lambda$14/0x"),
                                           F.substring(digest, 1, 6)))
        .when(family == "minified", F.lit("Error"))
        .when(family == "nested", F.concat(F.lit("com.acme.ledger.PostingException$"),
                                           (u % 9).cast("string")))
        .otherwise(F.when(r % 3 == 0, F.lit(None)).otherwise(F.lit("com.acme.Plain."))))
    platform = (
        F.when(family == "mislabelled", F.lit("java"))
        .when(r % 4 == 0, F.lit(None).cast("string"))
        .when(r % 4 == 1, F.lit("python"))
        .when(family.isin("checkout", "vendor", "nested"),
              F.when(r % 50 == 2, F.lit(" Scala ")).otherwise(F.lit("java")))
        .when(family.isin("node", "minified"), F.lit("TypeScript"))
        .otherwise(F.lit(None).cast("string")))
    trace = _trace(family, k, r, u)
    full_release = F.when(r % 6 == 0, F.lit(None)).otherwise(
        F.concat(F.lit("1."), F.dayofmonth("ts").cast("string"), F.lit(".0")))
    kjson = F.concat(F.lit('{"k":'), k.cast("string"))
    payload = (
        F.when(r % 7 == 0, F.concat(kjson, F.lit(',"exceptionType":"com.acme.Legacy$1","release":"0.9.'),
                                    (k % 3).cast("string"), F.lit('"}')))
        .when(r % 7 == 1, F.concat(kjson, F.lit(',"exceptionType":["x"],"release":'),
                                   k.cast("string"), F.lit("}")))
        .when((r % 7 == 2) & trace.isNotNull() & ~family.isin("node", "mislabelled"),
              F.concat(kjson, F.lit(',"stacktrace":["'),
                       F.replace(F.replace(trace, F.lit("\t"), F.lit("    ")),
                                 F.lit("\n"), F.lit('","')), F.lit('", 3, null]}')))
        .otherwise(F.concat(kjson, F.lit("}"))))
    from_array = (r % 7 == 2) & ~family.isin("node", "mislabelled")
    first = base.select(
        F.when(r % 211 == 0, F.lit(None)).otherwise(_uuid(digest)).alias("event_id"),
        moved.alias("received_at"),
        F.when(r % 101 == 7, F.lit("")).when(k < 35, F.lit("checkout-api"))
        .otherwise(F.concat("event_type", F.lit("-svc"))).alias("service"),
        F.when(r % 103 == 9, F.repeat(F.lit("x"), 21))
        .when(F.col("event_type") == "error", F.lit("error"))
        .when(r % 3 == 0, F.lit("warning")).otherwise(F.lit("info")).alias("level"),
        message.alias("message"),
        platform.alias("platform"),
        F.when(r % 7 == 0, F.lit(None)).when(r % 7 == 1, F.lit(" "))
        .otherwise(full_type).alias("exception_type"),
        F.when(from_array, F.lit(None)).otherwise(trace).alias("stacktrace"),
        F.when(r % 7 == 0, F.lit(None)).when(r % 7 == 1, F.lit(" "))
        .otherwise(full_release).alias("release"),
        payload.alias("payload"),
        F.when(r % 10 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        .alias("_copies"))
    return (first
            .withColumn("seq", F.explode("_copies")).drop("_copies")
            .withColumn("received_at",
                        F.timestamp_micros(F.unix_micros("received_at")
                                           + F.col("seq") * 300_000_000)))


def _uuid(digest: Column) -> Column:
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
                       F.substring(digest, 13, 4), F.substring(digest, 17, 4),
                       F.substring(digest, 21, 12))


def status_log(groups: DataFrame) -> DataFrame:
    """Manual status changes derived from the groups: resolve, then reopen or ignore some."""
    n = F.col("event_count")
    first, last = F.unix_micros("first_seen"), F.unix_micros("last_seen")

    def at(part: int, of: int) -> Column:
        return F.timestamp_micros(first + F.floor((last - first) * part / of))

    none = F.lit(None).cast("string")
    changes = F.filter(F.array(
        F.when(n % 2 == 0, F.struct(at(1, 2).alias("changed_at"), F.lit("resolved").alias("status"),
                                    F.when(n % 4 == 0, F.lit("2.0.0")).alias("release"))),
        F.when(n % 6 == 0, F.struct(at(3, 4).alias("changed_at"), F.lit("open").alias("status"),
                                    none.alias("release"))),
        F.when(n % 5 == 0, F.struct(at(1, 3).alias("changed_at"), F.lit("ignored").alias("status"),
                                    none.alias("release"))),
        F.when(n % 7 == 0, F.struct(at(1, 1).alias("changed_at"), F.lit("resolved").alias("status"),
                                    none.alias("release")))), lambda c: c.isNotNull())
    return groups.select("group_id", F.explode(changes).alias("_c")).select("group_id", "_c.*")


def attempt_log(alerts: DataFrame) -> DataFrame:
    """Delivery attempts derived from the alerts: some succeed, some fail, some never ran."""
    minute = F.minute("created_at")
    tries = F.sequence(F.lit(1), minute % 6)
    wins = (minute % 2 == 0)
    return (alerts.filter(minute % 6 > 0)
            .select("alert_id", "created_at", minute.alias("_m"), wins.alias("_wins"),
                    F.explode(tries).alias("_i"))
            .select("alert_id",
                    F.timestamp_micros(F.unix_micros("created_at") + F.col("_i") * 60_000_000)
                    .alias("attempted_at"),
                    (F.col("_wins") & (F.col("_i") == F.col("_m") % 6)).alias("ok"),
                    F.when(~(F.col("_wins") & (F.col("_i") == F.col("_m") % 6)),
                           F.concat(F.lit("timeout "), F.repeat(F.lit("e"), 600))).alias("error")))
