"""Functions against plain Python on odd values."""

import random

import pytest
from pyspark.sql import functions as F

from tablegov.functions import checks as K
from tablegov.functions import content as C
from tablegov.functions import cron as R
from tablegov.functions import files as P
from tablegov.functions import text as X


def apply(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r.r for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


def test_sizes(spark):
    def human(n):
        unit, symbol = 1, "B"
        for p, s in enumerate(["KB", "MB", "GB", "TB", "PB", "EB"], start=1):
            if n >= 1 << 10 * p:
                unit, symbol = 1 << 10 * p, s
        return f"{n / unit:.1f}{symbol}"

    def stepped(n):
        i = 0
        while n >= 1024 and i < 4:
            n, i = int(n / 1024), i + 1
        return "0B" if n == 0 and i == 0 else f"{n:.2f}{['B', 'KB', 'MB', 'GB', 'TB'][i]}"

    random.seed(2)
    values = [0, 1, 1023, 1024, 1536, 10000, 100001221, 443648, 256 * 5, 64 * 19] + [
        random.randrange(1 << random.randrange(1, 52)) for _ in range(300)] + [1024 * k // 20 for k in range(20, 900)]
    assert apply(spark, values, X.bytes_human, "bigint") == [human(n) for n in values]
    assert apply(spark, values, X.file_size, "bigint") == [stepped(n) for n in values]


def test_fixed_rounds_by_exact_value(spark):
    random.seed(4)
    values = [0.005, 0.015, 1.005, 2.675, 0.125, 0.375, 1e-9, 12345.675] + [random.randrange(10 ** 6) / 8 for _ in range(200)] + [
        random.random() * 10 ** random.randrange(6) for _ in range(300)] + [k / 1000 for k in range(5, 4000, 10)]
    got = apply(spark, values, lambda v: X.fixed(v, 2), "double")
    assert got == [f"{v:.2f}" for v in values]


def test_growth_text(spark):
    assert apply(spark, [0.0, 0.5, -0.123456, 0.00125, 10.0, 0.2, 1.00006], X.growth_text, "double") == [
        "-", "50%", "12.35%", "0.13%", "1000%", "20%", "100.01%"]


def test_case(spark):
    s = ["user_name", "USER_name", "a", "", "_x__y", "one"]
    assert apply(spark, s, X.to_pascal) == ["".join(w.capitalize() for w in v.split("_")) for v in s]
    assert apply(spark, s, X.to_lower_camel) == [
        v.split("_")[0] + "".join(w.capitalize() for w in v.split("_")[1:]) for v in s]
    assert apply(spark, ["UserName", "HTTPServer", "getHTTPCode2X", "x"], X.to_snake) == [
        "user_name", "http_server", "get_http_code2_x", "x"]
    assert apply(spark, [*s, "fooBar", None], X.class_name) == ["UserName", "UserName", "A", "", "XY", "One", "FooBar", ""]


def test_text_tests(spark):
    s = ["", "  ", " a", "\t", None]
    assert apply(spark, s, X.is_blank) == [True, True, False, False, None]
    assert apply(spark, s, X.is_empty) == [True, False, False, False, True]
    assert apply(spark, ["http://a", "https://b", "HTTP://c", "mailto:x"], X.is_http) == [True, True, False, False]
    assert apply(spark, ["http:x", "mailto:x", "tel:1", "/a"], X.is_external) == [True, True, True, False]
    assert apply(spark, ["A", "", None], lambda v: X.equals_ci(v, "a")) == [True, False, False]
    assert apply(spark, ["abc", "xbc"], lambda v: X.starts_any(v, ["", "ab"])) == [True, False]
    assert apply(spark, ["B", "z", None], lambda v: X.map_ci({"b": "1"}, v)) == ["1", "", ""]


def test_times(spark):
    s = ["2024-02-30 00:00:00", "2024-02-29 23:59:59", "2024-1-5 1:2:3", "2024-01-05", None]
    assert [str(x) if x else None for x in apply(spark, s, lambda v: X.fmt_ts(X.parse_ts(v)))] == [
        None, "2024-02-29 23:59:59", "2024-01-05 01:02:03", None, None]
    assert [str(x) if x else None for x in apply(spark, s, X.parse_date)] == [None, None, None, "2024-01-05", None]
    assert apply(spark, ["9:5:1", "24:00:00", "12:00"], X.parse_time) == ["09:05:01", None, None]
    assert apply(spark, [0, None], X.unix_to_ts, "bigint") == ["1970-01-01 00:00:00", None]


def test_requests(spark):
    df = spark.createDataFrame([(" 1.1.1.1 , 2", "p"), ("", "p"), (None, None)], "f string, p string")
    assert [r[0] for r in df.select(X.client_ip(F.col("f"), F.col("p"))).collect()] == ["1.1.1.1", "p", None]
    assert apply(spark, ["0.12s", "3", "bad", None], X.process_seconds) == [0.12, 3.0, None, None]
    assert apply(spark, ["x" * 2001, "x" * 2000], X.truncate_payload) == [X.PAYLOAD_MARKER, "x" * 2000]
    assert apply(spark, ["aA1", "aaaaaa", "AAAAAA", "Aaaaaa", "Aaaaa1"], X.weak_password) == [
        "length", "upper", "lower", "digit", None]


def test_checks(spark):
    assert apply(spark, ["13812345678", "14012345678", "", None, "1381234567"], K.valid_mobile) == [True, False, True, True, False]
    assert apply(spark, ["14012345678", "", "12012345678"], K.is_phone) == [True, False, False]
    assert apply(spark, [" ab ", "a", "1a", "", None], K.valid_code) == [True, False, False, True, True]
    assert apply(spark, ["", None], lambda v: K.valid_code(v, required=True)) == [False, False]
    assert apply(spark, ["a@b.co", "a@b", None], K.valid_email) == [True, False, False]
    assert apply(spark, ["https://h/a/b.git", "ssh://h/a/b", "git@h:a/b", "file://h/x"], K.is_git_url) == [True, False, False, True]
    assert apply(spark, ["xab", "ab", "", None], lambda v: K.re_match(v, "a|b")) == [False, True, False, False]
    assert apply(spark, ["x\nab"], lambda v: K.re_search(v, "a")) == [True]
    assert apply(spark, ["1.2.3.4", "256.1.1.1", "01.2.3.4", None], K.valid_ip) == [True, False, True, False]
    assert apply(spark, ["172.15.0.1", "172.16.0.1", None, ""], K.location_label) == [
        K.UNKNOWN_LABEL, K.PRIVATE_LABEL, None, None]


def test_row_rules(spark):
    df = spark.createDataFrame([("ab", "0", None), (" ", "2", "x" * 256), ("a b", "1", ""), ("--", "0", ""), ("a_b", "0", ""), ("x" * 51, None, "")],
                               "name string, status string, description string")
    good, bad = K.split_valid(df, K.demo_rules())
    assert sorted(r.name for r in good.collect()) == ["--", "ab"]
    assert {r.name: r.errors for r in bad.collect()} == {
        " ": ["name_empty", "status", "description_length"], "a b": ["name_characters"], "a_b": ["name_characters"],
        "x" * 51: ["name_length", "status"]}


def test_chat(spark):
    s = ['{"a": 1}', ' {"a": 1}\n', 'x ```json\n{"b": 2}\n``` y', "```json```", "{bad}", "none", "```json {\"c\":1}"]
    assert apply(spark, s, C.extract_json_block) == ['{"a": 1}', '{"a": 1}', '{"b": 2}', None, None, None, None]
    assert apply(spark, ["打开角色管理和用户管理", "打开角色", "用户管理", "看看去日志"], C.nav_intent) == [
        "/system/user", "/system/role", None, "/system/log"]
    df = spark.createDataFrame([("", "abcdefghij"), ("t", "x"), (None, "")], "n string, s string")
    assert [r[0] for r in df.select(C.title_of(F.col("n"), F.col("s"))).collect()] == ["abcdefgh", "t", C.DEFAULT_TITLE]
    assert apply(spark, ["a<!-- <b> -->c<br/>d&amp;"], C.strip_tags) == ["acd&amp;"]


def test_definitions(spark):
    assert apply(spark, [" a, ,b ", "", None], C.args_list) == [["a", "b"], [], []]
    assert apply(spark, ['{"a": 1, "b": "x"}', "bad", None], C.kwargs_map) == [{"a": "1", "b": "x"}, {}, {}]
    assert apply(spark, ["1 2 3 4 5", "* * * * 1", "1 2 3", "a 1 1 1 1"], C.interval_seconds) == [
        1 + 120 + 10800 + 345600 + 3024000, 604800, None, None]
    t = ["VARCHAR(64) COLLATE x", "int unsigned", "tinyint(1)", "tinyint(4)", "text[]", "ARRAY[int]", "timestamp without time zone",
         "decimal(10, 2)", "", "varchar(x)", "character varying(30)"]
    assert apply(spark, t, C.base_type) == ["varchar", "int", "boolean", "tinyint", "array", "array", "timestamp", "decimal", "", "varchar", "character"]
    assert apply(spark, t, C.type_length) == [64, 0, 1, 4, 0, 0, 0, 10, 0, 0, 30]
    assert apply(spark, t, C.map_type)[:8] == ["string", "int", "boolean", "smallint", "array<string>", "array<string>", "timestamp_ntz", "decimal(38,18)"]


@pytest.mark.parametrize("cron,ok", [
    ("0 0 12 * * ?", True), ("0 0 12 * *", False), ("0 60 12 * * ?", False), ("5-4 0 0 * * ?", False), ("4-5 0 0 * * ?", True),
    ("0/15 0 0 * * ?", True), ("30/30 0 0 * * ?", False), ("0 0 0 15W * ?", True), ("0 0 0 L * 5L", True), ("0 0 0 ? 1,12 2#3", True),
    ("0 0 0 ? 13 *", False), ("0 0 24 * * ?", False), ("0 0 0 * * ? 2026", True), ("0 0 0 * * ? 2020", False), ("0 0 0 * * ? 2026,2034", True),
    ("0 0 0 * * ? 2036", False), ("0 0 0 * * ? 2026-2050", True), ("0 0 0 * * ? 2026/3", True), ("  0  0 0 * * ?  ", True), ("", False),
    ("0 0 0 * * ? x", False), ("0 0 1,2,23 * * 1-5", True), ("0 0 0 * * 8", False), ("59,00 0 0 * * ?", True),
])
def test_cron(spark, cron, ok):
    assert apply(spark, [cron], lambda v: R.valid_cron(v, 2026)) == [ok]


def test_files(spark):
    s = ["a/b/.c.TXT", "x", "d/e", ".h"]
    assert apply(spark, s, P.path_parent) == ["a/b", "", "d", ""]
    assert apply(spark, s, P.path_depth) == [2, 0, 1, 0]
    assert apply(spark, s, P.path_extension) == [".txt", "", "", ".h"]
    assert apply(spark, s, P.path_hidden) == [True, False, False, True]
    assert apply(spark, ["a/b/c", "x"], P.ancestors_of) == [["", "a", "a/b"], [""]]
    assert apply(spark, ["ok.txt", "../x", "a%2Fb", "a%252e%252e", " <a>.b. ", "???", "", None, "100%", "a+b"],
                 lambda v: P.safe_name(v, F.lit("gen"))) == ["ok.txt", "gen", "gen", "gen", "a.b", "gen", "gen", "gen", "100%", "a+b"]
    heads = [b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\nx", b"GIF89a", b"PK\x03\x04" + b"x" * 50, b"PK\x03\x04 [Content_Types].xml", b"%PDF-1", b"?",
             b"PK\x03\x04" + b"x" * 1000 + b"[Content_Types].xml"]
    kinds = apply(spark, [bytearray(h) for h in heads], P.file_kind, "binary")
    assert kinds == ["image/jpeg", "image/png", "image/gif", "application/zip", P.OFFICE_KIND, "application/pdf", None, "application/zip"]
