"""UTF-8 read as GBK, in words with characters that GBK lacks."""

import re

import pytest

from lorespark.llm import encodings as E

TEXT = "数据管道每天晚上运行一次，检查所有记录的编码是否正确。"
PAIR = (("gbk", "utf-8"),)
known = set(TEXT).__contains__


def misread(text):
    return text.encode().decode("gbk", "replace")


@pytest.mark.parametrize("cut", range(4, 16))
def test_pieces_around_lost_bytes_are_turned_back(cut):
    whole = TEXT[:cut] + "x" + TEXT[cut:]
    wrong = misread(whole)
    out = E.repairs(wrong, PAIR, known)
    assert "\ufffd" in wrong and out.count("\ufffd") <= wrong.count("\ufffd")
    assert re.fullmatch(re.sub("\ufffd+", ".{1,2}", out), whole)  # one or two characters in a row are lost


def test_other_characters_outside_gbk_stay():
    wrong = misread(TEXT[:6])
    assert E.repairs(wrong + "🙂" + wrong, PAIR, known) == TEXT[:6] + "🙂" + TEXT[:6]
    assert E.repairs(wrong + "🙂" + misread(TEXT[:2]), PAIR, known) == TEXT[:6] + "🙂" + TEXT[:2]


def test_clean_text_and_long_words():
    assert E.repairs(TEXT + "\ufffd🙂" + TEXT, PAIR, known) is None
    assert E.repairs("茅台🙂", PAIR, known) is None
    long = (misread(TEXT[:6]) + "\ufffd") * 20_000
    assert E.repairs(long, PAIR, known) == (TEXT[:6] + "\ufffd") * 20_000
