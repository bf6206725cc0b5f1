import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kifulake.functions import charset, normalize, points
from kifulake.functions.predicates import Interval, split_test

DATES = {
    "2/3 October 1996": "1996-10-02,03",
    "December 30&31, 1999": "1999-12-30,31",
    "30/31 december 1999": "1999-12-30,31",
    "1999-Dec-30,31": "1999-12-30,31",
    "1999/12/30,1999/12/31": "1999-12-30,31",
    "1999-01-31,02-01": "1999-01-31,02-01",
    "1999-12-30,31,2000-01-01": "1999-12-30,31,2000-01-01",
    "1999-12-29..31": "1999-12-29..31",
    "1999-12-29/30/31": "1999-12-29,30,31",
    "1999-12-29,30 or 31": "1999-12-29,30,31",
    "31st of December 1999": "1999-12-31",
    "30 and 31 December 1999.": "1999-12-30,31",
    "December 31 '99": "1999-12-31",
    "19991230": "1999-12-30",
    "Jan-93": "1993-01",
    "2013-0629": "2013-06-29",
    "1999-12-06..2000-01-03": "1999-12-06..2000-01-03",
    "10-11.01.2002": "2002-01-10..11",
    "1901-3-26 - 4-14": "1901-03-26..04-14",
    "3 October to 7 November 1896.": "1896-10-03..11-07",
    "1935年9月7日播放": "1935-09-07",
    "(天保14年) 1843-4-19": "1843-04-19",
    "昭和10年9月7日": "1935-09-07",
    "21 May, 7, 12 and 30 June, 1, 19 and 25 July 1920.": "1920-05-21,06-07,12,30,07-01,19,25",
}


@pytest.mark.parametrize(("text", "want"), DATES.items())
def test_dates(text, want):
    assert normalize.date(text) == want
    assert normalize.date(want) == want


def test_dates_that_are_not():
    for text in ("unknown", "", "31 foo 1999", "1999-13-01"):
        assert normalize.date(text) is None


@pytest.mark.parametrize(("function", "cases"), [
    (normalize.rank, {"9th dan": "9d", "9-Dan": "9d", "6d pro": "6d pro", "6 dan pro": "6p", "3 kyu": "3k", "9d": "9d"}),
    (normalize.komi, {"5 1/2": "5.5", "6,5": "6.5", "2 3/4": "2.75", "none": "0", "-64.50": "-64.5", "Reverse, 20p": "-20", "0.000000": "0", "214": "2.25", "234": "2.75", "6.50": "6.5", "x": "x"}),
    (normalize.time, {"8 hours each": "8h", "7h36m35s": "7h36m35s"}),
    (normalize.result, {"W+5目": "W+5", "和棋": "0", "B+中押胜": "B+R", "B+R": "B+R", "B+R.": "B+R", "B+resignation": "B+R", "B+Time": "B+T", "B+F": "B+F", "B+Forfeit": "B+F", "jigo": "0", "J": "0", "Draw - triple ko": "0", "NR": "Void", "Void {Triple ko}": "Void", "B+3.5": "B+3.5", "B+3,5": "B+3.5", "W wins": "W+", "W+0": "0", "W+3points": "W+3", "Black wins by 1 1/2 pts.": "B+1.5", "Black wins by 11.5 point": "B+11.5", "B+ by .5": "B+0.5", "B+ by resign": "B+R", "B+1 3/4": "B+1.75", "B+0.5 (W connects ko)": "B+0.5", "White + 3": "W+3", "no result": "Void", "White forfeits on time": "B+T", "黒中押し勝ち!": "B+R", "白中押し勝ち。": "W+R", "無勝負": "Void", "game suspended": "game suspended"}),
])
def test_values(spark, function, cases):
    df = spark.createDataFrame(list(cases.items()), "a string, b string").withColumn("c", function(F.col("a")))
    assert [(r.a, r.b) for r in df.collect()] == [(r.a, r.c) for r in df.collect()]


def test_quarters_doubled(spark):
    row = spark.createDataFrame([("2.75", "W+0.25")], "k string, r string").select(normalize.komi(F.col("k"), True), normalize.result(F.col("r"), True)).first()
    assert tuple(row) == ("5.5", "W+0.5")


def test_intervals():
    assert Interval.parse("5") == Interval(5, 5)
    assert Interval.parse("5-") == Interval(5, None)
    assert Interval.parse("-5") == Interval(None, 5)
    assert Interval.parse("3-7") == Interval(3, 7)
    assert Interval.parse("-") == Interval(None, None)
    for bad in ("7-3", "", "x"):
        with pytest.raises(ValueError):
            Interval.parse(bad)


def test_tests_are_cut_at_the_first_operator():
    assert split_test("DT:2003=x") == ("DT", ":", "2003=x")
    assert split_test("DT!") == ("DT", "!", "")
    assert split_test("DT!=a") == ("DT", "!=", "a")


@given(st.integers(0, 18), st.integers(0, 18))
def test_symmetries_are_permutations(x, y):
    images = {points.mirrored(t, x, y, 18) for t in range(8)}
    assert all(0 <= a <= 18 and 0 <= b <= 18 for a, b in images)
    assert points.mirrored(3, *points.mirrored(3, x, y, 18), 18) == (x, y)
    assert points.mirrored(2, *points.mirrored(6, x, y, 18), 18) == (x, y)


def test_human_points():
    assert points.human_to_letters("C14") == "cf"
    assert points.letters_to_human("cf") == "C14"
    assert points.letters_to_human("is") == "J1"
    for bad in ("I5", "A20", "AA"):
        with pytest.raises(ValueError):
            points.human_to_letters(bad)


@pytest.mark.parametrize(("name", "text"), [("EUC-KR", "대국 기록 안조영"), ("GB2312", "中国围棋甲级联赛第一轮"), ("Big5", "臺灣圍棋棋譜紀錄"), ("Shift_JIS", "第五十二期本因坊戦リーグ"), ("UTF-8", "囲碁")])
def test_charsets(name, text):
    data = f"(;PB[{text}])".encode(charset.SETS[name])
    assert name in charset.candidates(data)
    assert charset.to_utf8(data, name).decode() == f"(;CA[UTF-8]PB[{text}])"


def test_charset_statements():
    assert charset.detect(b"(;PB[abc])") == {"charset": "ASCII", "candidates": ["ASCII"], "stated": None, "verdict": "unstated"}
    korean = "(;CA[KS_C_5601]PB[안조영])".encode("euc_kr")
    assert charset.detect(korean)["verdict"] == "ok" and charset.detect(korean)["charset"] == "EUC-KR"
    assert charset.detect("(;CA[UTF-8]PB[안조영])".encode("euc_kr"))["verdict"] == "wrong"
    assert charset.detect("(;CA[Klingon]PB[é])".encode())["verdict"] == "unknown"
