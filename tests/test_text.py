import pytest
from pyspark.sql import functions as F

from daytrace.functions import textfn, timefn
from daytrace.sources import jsonl


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("raw", "words"),
    [("Hello, hello world", ["hello", "world"]), ("a bc a1", ["bc", "a1"]), ("x", []), ("", []), ("Straße ÉTÉ 12", ["straße", "été", "12"]), ("go go stop go", ["go", "stop", "go"])],
)
def test_tokenize(spark, raw, words):
    assert one(spark, raw, textfn.tokenize) == words


@pytest.mark.parametrize(
    ("raw", "out"),
    [("https://a.b/c?token=1", "https://a.b/c"), ("https://a.b/c#d", "https://a.b/c"), ("https://a.b//", "https://a.b"), (" about:blank ", "about:blank"), ("notes", "notes")],
)
def test_strip_query(spark, raw, out):
    assert one(spark, raw, textfn.strip_query) == out


@pytest.mark.parametrize(
    ("raw", "out"),
    [
        ("  two   words ", "two words"), ("x", None), ("sk-abc", None), ("Bearer abc", None), ("ghp_1", None), ("token abcdefghij0123456789abc", None), ("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz"),
        ("C:\\Users\\me", None), ("\\\\srv\\x", None), ("file:///x", None), ("card 4111 1111 1111 1111 ok", "card … ok"), ("call 555-1234", "call 555-1234"), ("123456789012. end", "…. end"), ("y" * 130, "y" * 119 + "…"), (None, None),
    ],
)
def test_redact_line(spark, raw, out):
    assert one(spark, raw, textfn.redact_line) == out


def test_redact_lines_keeps_order_budget_and_title(spark):
    rows = [(2, 0, "menu"), (0, 1, "typed words"), (1, 2, "The title"), (1, 3, "long line of content"), (1, 4, "typed words"), (1, 5, "ok!")]
    f = lambda c: textfn.redact_lines(c, 3, 18, F.lit("The  title"))
    assert one(spark, rows, f, "array<struct<surface:int,seq:int,line:string>>") == ["typed words", "ok!", "menu"]


@pytest.mark.parametrize(
    ("raw", "out"),
    [("github.com/x", "https://github.com/x"), ("http://a", "http://a"), ("how to cook", None), (".com", None), ("a.", None), ("localhost", None), ("about:blank", "about:blank"), ("", None), (None, None)],
)
def test_normalize_url(spark, raw, out):
    assert one(spark, raw, textfn.normalize_url) == out


def test_document_rules(spark):
    df = spark.createDataFrame([(None, "C:\\a\\b.txt"), (" T ", "x/y"), ("  ", "/x/y/"), (None, None)], "t string, p string")
    assert [r.l for r in df.select(textfn.document_label(F.col("t"), F.col("p")).alias("l")).collect()] == ["b.txt", "T", "y", None]
    assert one(spark, "D:/x y", textfn.document_path) == "D:/x y" and one(spark, "two\nlines", textfn.document_path) is None
    df = spark.createDataFrame([("abc", "x ABC y"), ("ab", "ab"), (None, "x")], "t string, w string")
    assert [r.n for r in df.select(textfn.document_names_window(F.col("t"), F.lit(None).cast("string"), F.col("w")).alias("n")).collect()] == [True, False, False]


@pytest.mark.parametrize(
    ("raw", "out"),
    [("Summary: a\nb", "a b"), ('"quoted"', "quoted"), ('"a" and "b"', '"a" and "b"'), ("one\n\n\ntwo\nthree", "one\n\ntwo three"), ("here is the SUMMARY: x", "x"), ("", "")],
)
def test_tidy(spark, raw, out):
    assert one(spark, raw, textfn.tidy) == out


@pytest.mark.parametrize(("ms", "cut", "near"), [(0, "0s", "0s"), (30_000, "30s", "30s"), (2_700_000, "45m", "45m"), (7_200_000, "2h", "2h"), (8_100_000, "2h 15m", "2h 15m"), (-5, "0s", "0s"), (59_600, "59s", "1m"), (3_599_999, "59m", "1h")])
def test_durations(spark, ms, cut, near):
    assert one(spark, ms, timefn.human_duration, "long") == cut and one(spark, ms, timefn.rounded_duration, "long") == near


def test_instants(spark):
    f = lambda c: timefn.format_instant(timefn.parse_instant(c))
    assert one(spark, "2024-03-05T10:00:00.1239+01:00", f) == "2024-03-05T09:00:00.123Z"
    assert one(spark, "2024-03-05", f) is None and one(spark, "yesterday", f) is None


def test_small_rules(spark):
    assert one(spark, "C:\\x\\KeePassXC.exe", textfn.file_stem) == "KeePassXC"
    assert one(spark, "MSEDGE", textfn.browser_of) == "edge" and one(spark, "word", textfn.browser_of) is None
    assert one(spark, "Bearer  abc ", textfn.bearer) == "abc" and one(spark, "Basic x", textfn.bearer) is None
    assert one(spark, " \n ", textfn.one_line) == "Untitled"
    assert one(spark, 820, timefn.file_size, "long") == "820 bytes" and one(spark, 2_100, timefn.file_size, "long") == "2.1 kB"
    assert one(spark, "a-b_1", textfn.valid_id) and not one(spark, "../x", textfn.valid_id)


def test_a_line_is_not_collapsed_again_for_each_use(spark):
    lines = F.array(F.struct(F.lit(0).alias("surface"), F.lit(0).alias("seq"), F.col("id").cast("string").alias("line")))
    plan = spark.range(1).select(textfn.redact_lines(lines, 3, 100))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?U)\s+") <= 2


def test_a_log_path_is_cut_at_its_slashes(spark):
    """No pattern looks for the end of a path: it would try every place of it, for each line."""
    cases = {
        "file:/r/log/batch=017-append/date=2024-01-02/part-0.json": ("017-append", "part-0.json", "2024-01-02"),
        "file:/r/log/batch=017-append/date=2024-1-2/part-0.json": ("017-append", "part-0.json", "None"),
        "file:/r/log/batch=017-append/date=__HIVE_DEFAULT_PARTITION__/p.json": ("017-append", "p.json", "None"),
        "file:/batch=1/date=2024-01-02/events/2024-01-03.jsonl": ("", "", "2024-01-03"),
        "file:/r/events/old 2024-01-03.jsonl": ("", "", "2024-01-03"),
        "file:/r/events/2024-02-31.jsonl": ("", "", "None"),
        "file:/r/events/x.jsonl": ("", "", "None"),
        "2024-01-03.jsonl": ("", "", "2024-01-03"),
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    got = df.select("p", *[c.cast("string").alias(n) for n, c in zip("bfd", jsonl._of_path(F.col("p")))])
    assert {r.p: (r.b, r.f, str(r.d)) for r in got.collect()} == cases
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_trim_and_words_are_those_of_the_patterns(spark):
    """Over all characters of the basic plane and some beyond."""
    chars = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x1F600, 0x1F610), *range(0x10400, 0x10410)]]
    df = spark.createDataFrame([(f"{c}a {c}b{c}{c} Zz É9 {c}",) for c in chars], "t string")
    trimmed = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    words = F.transform(F.filter(F.split("t", r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: F.char_length(w) >= 2), F.lower)
    name = F.regexp_extract(F.regexp_replace("t", r"[/\\]+$", ""), r"[^/\\]*$", 0)
    label = F.nullif(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""), F.lit(""))
    none = F.lit(None).cast("string")
    pairs = ((trimmed, textfn.trimmed(F.col("t"))), (words, textfn.words(F.col("t"))), (label, textfn.document_label(none, F.col("t"))))
    assert list(df.agg(*[F.count_if(~a.eqNullSafe(b)) for a, b in pairs]).first()) == [0, 0, 0]
