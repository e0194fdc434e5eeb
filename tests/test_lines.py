import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st

from cuespark.functions import line_window as window_column
from cuespark.kernel.lines import LOST, line_window, wrapped


def test_windows_scroll_and_stop_at_the_end():
    text = "aaaabbbbccccdddd"
    assert line_window(text, 4, 0, 2) == (["aaaa", "bbbb"], False, True, 0)
    assert line_window(text, 4, 1, 2) == (["bbbb", "cccc"], True, True, 1)
    assert line_window(text, 4, 2, 2) == line_window(text, 4, 99, 2) == (["cccc", "dddd"], True, False, 2)
    assert line_window(text, 4, -5, 9) == (["aaaa", "bbbb", "cccc", "dddd"], False, False, 0)
    assert line_window(text, 0, 0, 2).lines == line_window(text, 4, 0, 0).lines == []
    assert line_window("", 4, 0, 2) == line_window("", 4, 7, 2) == ([""], False, False, 0)


def test_breaks_of_the_text_are_kept():
    assert line_window("one\n  two\r\n\nfour", 20, 0, 9).lines == ["one", "  two", "", "four"]
    assert list(wrapped("abcd\nx", 4)) == ["abcd", "x"] and list(wrapped("x\n", 4)) == ["x"]


def test_wide_and_joined_characters():
    assert list(wrapped("日本語です", 4)) == ["日本", "語で", "す"]
    assert list(wrapped("e\u0301e\u0301e\u0301", 2)) == ["e\u0301e\u0301", "e\u0301"]
    assert list(wrapped("日a", 1)) == [LOST, "a"]
    assert list(wrapped("👩\u200d👩\u200d👧x", 2)) == ["👩\u200d👩\u200d👧", "x"]


def test_nothing_hostile_gets_through():
    assert list(wrapped("a\x1b[31m\u202eb", 20)) == [f"a{LOST}[31m{LOST}b"]
    assert list(wrapped("a" + "\u0301" * 1000, 20)) == [LOST]
    shown = line_window("\u200b" * 200_000, 20, 0, 3)
    assert len(shown.lines) == 3 and shown.after and all(len(x.encode()) < 400 for x in shown.lines)


@given(st.text(alphabet="ab 日é\u0301\n\r\u200b🎬", max_size=60), st.integers(1, 6), st.integers(0, 12), st.integers(1, 4))
def test_a_window_is_a_part_of_all_lines(text, width, offset, count):
    lines = list(wrapped(text, width))
    got = line_window(text, width, offset, count)
    begin = offset if offset < len(lines) else max(0, len(lines) - count)
    assert got == (lines[begin : begin + count], begin > 0, begin + count < len(lines), begin)


def test_column(spark):
    table = spark.createDataFrame(pd.DataFrame({"t": ["abcdef", None]}, dtype=object), "t string").select(window_column("t", 2, 1, 1).alias("w")).collect()
    assert tuple(table[0].w) == (["cd"], True, True, 1) and tuple(table[1].w) == (None, None, None, None)
