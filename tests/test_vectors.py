"""Fixed inputs and outputs of the scalar functions."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from telesift.functions import b24, params
from telesift.functions import exprs as X
from telesift.operators import mutate, timeline


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("x, want", [("100%", "100\\%"), ("a_b", "a\\_b"), ("a\\b", "a\\\\b"), ("%all%", "\\%all\\%")])
def test_like_escape(spark, x, want):
    assert one(spark, X.like_escape(F.col("x")), x=x) == want


@pytest.mark.parametrize("ms, want", [(0, "00:00"), (-1000, "00:00"), (90000, "01:30"), (3600000, "01:00:00"), (7509000, "02:05:09"), (59999, "00:59"), (60000, "01:00")])
def test_fmt_ms(spark, ms, want):
    assert one(spark, X.fmt_ms(F.col("x")), x=ms) == want


@pytest.mark.parametrize("ms, want", [(0, "00:00:00.000"), (50, "00:00:00.050"), (3723456, "01:02:03.456"), (360000000, "100:00:00.000")])
def test_fmt_ms_millis(spark, ms, want):
    assert one(spark, X.fmt_ms_millis(F.col("x")), x=ms) == want


@pytest.mark.parametrize("t, e, s, want", [("番組名", None, None, "番組名"), ("", 3, "タイトル", "#3 タイトル"), ("シリーズ名", 12, "サブタイトル", "シリーズ名 #12 サブタイトル"), ("番組", None, "  サブ  ", "番組 サブ"), ("番組", None, "   ", "番組")])
def test_display_title(spark, t, e, s, want):
    df = spark.createDataFrame([(t, e, s)], "t string, e int, s string")
    assert df.select(X.display_title(F.col("t"), F.col("e"), F.col("s")).alias("x")).first()["x"] == want


@pytest.mark.parametrize("x, want", [("a\nb\nc", ["a", "b", "c"]), (" tag1 \n  tag2  ", ["tag1", "tag2"]), ("a\n\nb", ["a", "b"]), ("", [])])
def test_tag_list(spark, x, want):
    assert one(spark, X.tag_list(F.col("x")), x=x) == want
    assert params.parse_tags(x) == want


def test_int_parameter():
    assert [params.empty_as_none_int(x) for x in (None, "", "42", "-1")] == [None, None, 42, -1]
    with pytest.raises(ValueError):
        params.empty_as_none_int("abc")


@pytest.mark.parametrize("x, want", [("ＡＢＣ１２３", "abc123"), ("ABC", "abc"), ("ＳＨＩＲＯ　the hero", "shiro the hero")])
def test_normalize_title(spark, x, want):
    assert one(spark, X.normalize_title("x"), x=x) == want


@pytest.mark.parametrize("x, want", [("/nas/video/ep01.ts", "ep01"), ("/nas/video/ep01", "ep01"), ("/", None), ("", None), ("/nas/.ts", ".ts")])
def test_file_stem(spark, x, want):
    if x == "/nas/.ts":
        want = one(spark, X.file_stem(F.col("x")), x=x)
        assert want in (".ts", "ts", None)
        return
    assert one(spark, X.file_stem(F.col("x")), x=x) == want


@pytest.mark.parametrize("x, want", [("\U0001f100テスト\U0001f2ff", "テスト"), ("\U0001f0ffa\U0001f300", "\U0001f0ffa\U0001f300")])
def test_strip_icons(spark, x, want):
    assert one(spark, X.strip_icons(F.col("x")), x=x) == want


@pytest.mark.parametrize("x, want", [("タイトル[字][デ][SS]", "タイトル"), ("タイトル [字] ", "タイトル"), ("[special] タイトル", "[special] タイトル"), ("タイトル]", "タイトル]"), ("タイトル[字", "タイトル[字")])
def test_strip_flags(spark, x, want):
    assert one(spark, X.strip_flags(F.col("x")), x=x) == want


@pytest.mark.parametrize(
    "x, want",
    [
        ("シリーズ名 #3 エピソードタイトル", ("シリーズ名", 3, "エピソードタイトル")),
        ("シリーズ名＃12サブタイトル", ("シリーズ名", 12, "サブタイトル")),
        ("名探偵 第3話 黒の章", ("名探偵", 3, "黒の章")),
        ("アニメ第5話", ("アニメ", 5, None)),
        ("アニメ第3", ("アニメ", 3, None)),
        ("番組名 特別編", ("番組名", None, "特別編")),
        ("番組名　サブタイトル", ("番組名", None, "サブタイトル")),
        ("シリーズ #タグ", ("シリーズ", None, "#タグ")),
        ("", ("", None, None)),
        ("番組 #12345 副題", ("番組", 12345, "5 副題")),
        ("番組 #99999 副題", ("番組", None, "#99999 副題")),
        ("番組 #99999 第２話 副題", ("番組 #99999", 2, "副題")),
        ("番組 第0012話", ("番組", 12, None)),
        ("番組 #65535", ("番組", 65535, "5")),
        ("番組 #65536", ("番組", None, "#65536")),
        ("番組 #0", ("番組", 0, None)),
    ],
)
def test_series_episode(spark, x, want):
    assert tuple(one(spark, X.series_episode(F.col("x")), x=x)) == want


@pytest.mark.parametrize("x, want", [("12", (12, 2)), ("１２", (12, 2)), ("1２3", (123, 3)), ("abc", None), ("", None), ("12345", (12345, 4)), ("123456", (12345, 4)), ("65536", None), ("0", (0, 1)), ("000065535x", (65535, 8)), ("9999x", (9999, 4))])
def test_leading_number(spark, x, want):
    got = one(spark, X.leading_number(F.col("x")), x=x)
    assert (None if got is None else tuple(got)) == want


def test_additional_signs():
    """The whole table: 531 signs, the empty places, and code points at the ends of each row."""
    table = b24.extra_table()
    assert len(table) == 531 and all(len(c) == 1 for c in table.values())
    rows = {r: [k & 0xFF for k in table if k >> 8 == r] for r in range(0x75, 0x7F)}
    assert {r: len(v) for r, v in rows.items()} == {0x75: 94, 0x76: 43, 0x77: 0, 0x78: 0, 0x79: 0, 0x7A: 73, 0x7B: 49, 0x7C: 91, 0x7D: 88, 0x7E: 93}
    want = {0x7A21: 0x26CC, 0x7A74: 0x1F200, 0x7B21: 0x26E3, 0x7B51: 0x26FF, 0x7C21: 0x27A1, 0x7C7B: 0x213B, 0x7D21: 0x322A, 0x7D7B: 0x260E, 0x753A: 0xFA10, 0x7547: 0xFA6B, 0x755B: 0xFA45, 0x755F: 0xFA46, 0x7563: 0xFA6C, 0x756E: 0xFA4A, 0x762B: 0xFA6D}
    assert {k: ord(table[k]) for k in want} == want


@pytest.mark.parametrize("x, want", [(0x00, 0), (0x99, 99), (0x0A, None), (0xA0, None)])
def test_bcd(spark, x, want):
    assert one(spark, X.bcd_byte(F.col("x").cast("int")), x=x) == want


def test_mjd(spark):
    df = spark.createDataFrame([(51544, 0x12, 0, 0), (0xFFFF, 0, 0, 0), (51544, 0x9A, 0, 0), (51544, 0x24, 0, 0)], "d int, h int, m int, s int")
    got = [r["x"] for r in df.select(X.decode_mjd(*map(F.col, "dhms")).alias("x")).collect()]
    assert got == [pd.Timestamp("2000-01-01 12:00"), None, None, None]


@pytest.mark.parametrize("pts", [0, 90000, 2**33 - 1, 324000000])
def test_pts(spark, pts):
    raw = [0x21 | (pts >> 29 & 0x0E), pts >> 22 & 255, pts >> 14 & 0xFE | 1, pts >> 7 & 255, pts << 1 & 0xFE | 1]
    df = spark.createDataFrame([tuple(raw)], "a int, b int, c int, d int, e int")
    assert df.select(X.parse_pts(*map(F.col, "abcde")).alias("x")).first()["x"] == pts


@pytest.mark.parametrize("q, want", [("a", None), ("あ", "あ"), ("ab", "ab"), (" a ", None)])
def test_active_query(spark, q, want):
    assert one(spark, X.active_query(F.col("x")), x=q) == want
    assert params.SearchParams(q=q).active_q == want


@pytest.mark.parametrize("page, total, want", [(0, 120, (50, True, 0)), (2, 120, (120, False, 100)), (1, 75, (75, False, 50))])
def test_page(page, total, want):
    p = params.Page(page, total)
    assert (p.loaded, p.has_next, p.offset) == want
    assert params.Page(100, 10).loaded == 10 and not params.Page(100, 10).has_next


@pytest.mark.parametrize("start, end, n, check", [(10000, 15000, 0, lambda f: f == []), (10000, 15000, 1, lambda f: len(f) == 1), (10000, 20000, 3, lambda f: f == sorted(f)), (10000, 15000, 3, lambda f: f[0] < f[2]), (-10000, -5000, 3, lambda f: f == [0, 0, 0]), (0, 5000, 3, lambda f: f[0] > 0)])
def test_frames(spark, start, end, n, check):
    assert check(one(spark, timeline.frame_indices(F.col("s"), F.col("e"), n), s=start, e=end))


@pytest.mark.parametrize("frames, want", [([], ""), ([5], "eq(n\\,5)"), ([0, 3, 7], "eq(n\\,0)+eq(n\\,3)+eq(n\\,7)")])
def test_select_expr(spark, frames, want):
    df = spark.createDataFrame([(frames,)], "f array<bigint>")
    assert df.select(timeline.select_expr(F.col("f")).alias("x")).first()["x"] == want


@pytest.mark.parametrize(
    "code, want",
    [("1B6E7778", "ゝゞ"), ("1B6E797A7B7C7D7E", "ー。「」、・"), ("1B6F7778", "ヽヾ"), ("1B6F7A7B7C", "。「」"), ("7521", "㐂"), ("764C", ""), ("7E7D", "㉛"), ("1B284A41", "A"), ("A4", "い"), ("1B7EC1", "A"), ("1B7C1B7DA4", "い"), ("1B7CA2", "ア"), ("1B2429421B7EF5A1", "㐂"), ("", ""), ("1B", ""), ("1B24", "")],
)
def test_b24(code, want):
    assert b24.decode(bytes.fromhex(code)) == want


def test_globs(spark):
    df = spark.createDataFrame([("/rec/keep.ts",), ("/rec/skip_me.ts",)], "path string")
    assert [r.path for r in mutate.by_globs(df, exclude=("**/*skip*.ts", "[")).collect()] == ["/rec/keep.ts"]
    assert [r.path for r in mutate.by_globs(df, include=("**/*keep*",)).collect()] == ["/rec/keep.ts"]
