"""The event contract: schemas, kinds, thresholds. Wire names are camelCase, columns of derived tables snake_case."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the event contract: kinds by their wire names.
WINDOW_KINDS = ("applicationActivated", "windowChanged", "urlChanged", "privacyBoundary")
AWAY_KINDS = ("sessionLocked", "screenSlept", "applicationTerminated")
KINDS = (
    "collectorStarted", "applicationActivated", "windowChanged", "focusedElementChanged", "selectionChanged", "textInput", "documentChanged", "pointerClick", "urlChanged",
    "documentContextChanged", "uiSnapshot", "applicationTerminated", "screenSlept", "screenWoke", "sessionLocked", "sessionUnlocked", "privacyBoundary",
)
#: Kinds that a recorder emits.
EMITTED_KINDS = ("collectorStarted", "applicationActivated", "windowChanged", "urlChanged", "privacyBoundary", "applicationTerminated", "screenSlept", "screenWoke", "sessionLocked", "sessionUnlocked")

#: Silence credited as activity at most, and silence that ends an episode (if longer), in ms.
CREDIT_MS, IDLE_MS = 300_000, 900_000
MAX_DOCUMENTS, MAX_TEXT = 8, 36
#: The public form's caps.
PUBLIC_URLS, PUBLIC_TITLES, PUBLIC_DOCUMENTS, PUBLIC_TEXT = 8, 5, 5, 14
#: Less active time than this isn't worth a line.
WORTH_MS = 60_000
#: Of titles with equal hold times the headline is the one first seen last.
TIES_GO_LAST = True

_application = T.StructType([T.StructField("name", T.StringType()), T.StructField("path", T.StringType()), T.StructField("pid", T.LongType()), T.StructField("bundleId", T.StringType())])
_element = T.StructType([T.StructField("role", T.StringType()), T.StructField("title", T.StringType()), T.StructField("value", T.StringType()), T.StructField("isSensitive", T.BooleanType())])
EVENT = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("application", _application),
        T.StructField("windowTitle", T.StringType()),
        T.StructField("accessibilityTrusted", T.BooleanType()),
        T.StructField("pointerCaptureAvailable", T.BooleanType()),
        T.StructField("isSensitive", T.BooleanType()),
        T.StructField("element", _element),
        T.StructField("selectedElements", T.ArrayType(_element)),
        T.StructField("textChange", T.StructType([T.StructField("inserted", T.StringType()), T.StructField("deleted", T.StringType())])),
        T.StructField("browser", T.StructType([T.StructField("url", T.StringType()), T.StructField("isPrivate", T.BooleanType())])),
        T.StructField("document", T.StructType([T.StructField("path", T.StringType()), T.StructField("title", T.StringType())])),
        T.StructField("visibleText", T.ArrayType(T.StringType())),
    ]
)
