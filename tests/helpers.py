import datetime as dt

from pyspark.sql import types as T

JAVA_TRACE = """java.lang.NullPointerException: Cannot invoke "String.length()" because "s" is null
\tat com.example.checkout.CartService.total(CartService.java:42)
\tat com.example.checkout.CheckoutController.submit(CheckoutController.java:88)
\tat java.base/jdk.internal.reflect.DirectMethodHandleAccessor.invoke(DirectMethodHandleAccessor.java:103)
\tat java.base/java.lang.reflect.Method.invoke(Method.java:580)
\tat org.springframework.web.method.support.InvocableHandlerMethod.doInvoke(InvocableHandlerMethod.java:255)
Caused by: java.lang.IllegalStateException: cart is empty
\tat com.example.checkout.CartService.validate(CartService.java:19)
\t... 46 common frames omitted"""
NODE_TRACE = """TypeError: Cannot read properties of undefined (reading 'id')
    at resolveUser (/app/src/services/user.js:31:18)
    at async handler (/app/src/routes/checkout.js:12:22)
    at Layer.handle [as handle_request] (/app/node_modules/express/lib/router/layer.js:95:5)
    at next (/app/node_modules/express/lib/router/route.js:144:13)
    at processTicksAndRejections (node:internal/process/task_queues:95:5)"""

RAW = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("received_at", T.TimestampType()),
    T.StructField("seq", T.IntegerType()), T.StructField("service", T.StringType()),
    T.StructField("level", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("platform", T.StringType()), T.StructField("exception_type", T.StringType()),
    T.StructField("stacktrace", T.StringType()), T.StructField("release", T.StringType()),
    T.StructField("payload", T.StringType())])


def raw_event(event_id, at, **over):
    row = dict(event_id=event_id, received_at=at, seq=0, service="checkout", level="error",
               message="boom", platform=None, exception_type="java.lang.Boom", stacktrace=None,
               release=None, payload=None)
    row.update(over)
    return tuple(row[f.name] for f in RAW.fields)


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def rollups(spark, rows):
    return spark.createDataFrame(rows, "group_id string, bucket_start timestamp, event_count bigint")


def simple_events(spark, rows):
    """(group_id, received_at, event_id[, release])"""
    full = [r if len(r) == 4 else (*r, None) for r in rows]
    return spark.createDataFrame(
        full, "group_id string, received_at timestamp, event_id string, release string")


def minutes(n):
    return dt.timedelta(minutes=n)
