"""Event rows for tests: minutes from a base time, a kind, an app and what else differs."""

import datetime as dt

from pyspark.sql import types as T

BASE = dt.datetime(2024, 3, 5, 9, 0, tzinfo=dt.timezone.utc)
SCHEMA = T.StructType(
    [
        T.StructField("stream", T.IntegerType()), T.StructField("date", T.DateType()), T.StructField("seq", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("kind", T.StringType()),
        T.StructField("app", T.StringType()), T.StructField("app_path", T.StringType()), T.StructField("title", T.StringType()), T.StructField("url", T.StringType()), T.StructField("doc_path", T.StringType()),
        T.StructField("doc_title", T.StringType()), T.StructField("sensitive", T.BooleanType()), T.StructField("visible_text", T.ArrayType(T.StringType())),
    ]
)


def activity(spark, *rows, base=BASE):
    """rows: (minute, kind, app, title) and perhaps a dict of other columns."""
    out = []
    for seq, (minute, kind, app, title, *more) in enumerate(rows):
        r = {"stream": 0, "date": base.date(), "seq": seq, "ts": None if minute is None else base + dt.timedelta(minutes=minute), "kind": kind, "app": app, "app_path": None, "title": title, "url": None, "doc_path": None, "doc_title": None, "sensitive": None, "visible_text": None}
        out.append(r | (more[0] if more else {}))
    return spark.createDataFrame([tuple(r[f.name] for f in SCHEMA.fields) for r in out], SCHEMA)


A, C, U, P, L = "applicationActivated", "windowChanged", "urlChanged", "privacyBoundary", "sessionLocked"
MIN = 60_000
