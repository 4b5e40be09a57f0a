"""Numeric safety: statements that are the same, that changed, and that can't be read."""

from __future__ import annotations

import pytest

from lexiscope.operators.numbers import claims_of, safety

SAME = [
    ("en", "Revenue was 1,200.", "Revenue was 1200."), ("en", "Due January 2, 2024.", "Due 2 January 2024."), ("en", "It cost USD 1,200.", "It cost USD 1200."), ("en", "Growth was 30 percent.", "Growth was 30%."),
    ("en", "The route is 1 km.", "The route is 1000 m."), ("en", "Choose one option.", "Choose 1 option."), ("en", "at 09:05", "at 9:05"), ("en", "A 3-year plan.", "A 3-year plan."), ("en", "chapter 1: Introduction", "chapter 1: Introduction"),
    ("en", "Version 1, then 2.", "Version 1, then 2."), ("en", "Choose the first option.", "Choose the second option."), ("en", "on 2024-01-02", "on January 2, 2024"), ("en", "a kilo is 1 kg", "a kilo is 1000 g"), ("en", None, ""),
    ("ko", "매출은 1,200이었다.", "매출은 1200이었다."), ("ko", "성장률은 30퍼센트다.", "성장률은 30%다."), ("ko", "하나를 선택한다.", "1개를 선택한다."), ("ko", "3만 명", "30000 명"), ("ko", "23,000명이다.", "2만 3천 명이다."), ("ko", "비용은 3천만 원이다.", "비용은 30000000원이다."),
    ("ko", "이 일이 중요하다.", "이 일은 중요하다."), ("ko", "열정이 필요하다.", "의욕이 필요하다."), ("ko", "2024년 1월 2일이다.", "2024-01-02 이다."),
    ("zh", "收入为1,200。", "收入为1200。"), ("zh", "增长百分之30。", "增长30%。"), ("zh", "选择一项。", "选择1项。"), ("zh", "这是一般说明。", "这是一定说明。"), ("ja", "成長率は30パーセントです。", "成長率は30%です。"), ("ja", "一つ選びます。", "1つ選びます。"),
]
CHANGED, UNREAD, AMBIGUOUS, WORDS = "numeric_claim_changed", "unsupported_numeric_syntax", "ambiguous_numeric_syntax", "unsupported_word_number"
UNSAFE = [
    ("en", "5 km", "5 kg", CHANGED), ("en", "January 3, 2020", "March 3, 2020", CHANGED), ("en", "The balance is -5.", "The balance is 5.", CHANGED), ("en", "The balance is −5.", "The balance is 5.", CHANGED), ("en", "Values 1, then 1.", "Value 1.", CHANGED), ("en", "at 9:30", "at 9:45", CHANGED),
    ("en", "3 < x", "3 > x", UNREAD), ("en", "Range 1-2.", "Range 1-2.", UNREAD), ("en", "Ratio 1:2.", "Ratio 1:2.", UNREAD), ("en", "Value ３０.", "Value ３０.", UNREAD), ("en", "p < .05", "p > .05", UNREAD), ("en", "v2x is 3", "v2x is 3", UNREAD),
    ("en", "20 °C", "20 °F", AMBIGUOUS), ("en", "Ratio 1/2.", "Ratio 1/2.", AMBIGUOUS), ("en", "$5", "$5", AMBIGUOUS), ("en", "Feb 3, 2026", "Feb 3, 2026", AMBIGUOUS), ("en", "5 km/h", "5 km/h", AMBIGUOUS), ("en", "1,2 items", "1,2 items", "ambiguous_number_grouping"),
    ("en", "Choose thirteen options.", "Choose one option.", WORDS), ("en", "twenty one", "twenty one", WORDS), ("en", "one two", "one two", WORDS), ("zh", "十二", "十二", WORDS), ("ja", "十二", "十二", WORDS), ("ko", "열두 명", "열두 명", WORDS),
    ("zh", "一台设备。", "二台设备。", CHANGED), ("ja", "一台です。", "二台です。", CHANGED), ("ko", "하나를 선택한다.", "둘을 선택한다.", CHANGED), ("ko", "하나만 남았다.", "남았다.", CHANGED), ("ko", "예산은 1억 2천만 원이다.", "예산은 1억 3천만 원이다.", CHANGED),
]


@pytest.mark.parametrize("lang, a, b", SAME)
def test_same(lang, a, b):
    assert safety(a, b, lang) == (True, None)


@pytest.mark.parametrize("lang, a, b, reason", UNSAFE)
def test_unsafe(lang, a, b, reason):
    assert safety(a, b, lang) == (False, reason)


@pytest.mark.parametrize("text, claims", [("예산은 1억 2천만 원이다.", ["number:120000000/1"]), ("예산은 2천 3만 원이다.", ["number:2000/1", "number:30000/1"]), ("예산은 1.5억 2천만 원이다.", ["number:150000000/1", "number:20000000/1"]), ("3만5천 원", ["number:35000/1"]), ("별점 5점 만점에 4점이다.", ["number:5/1", "number:4/1"])])
def test_korean_magnitudes(text, claims):
    assert claims_of(text, "ko") == (claims, None)
