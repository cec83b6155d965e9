import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import words as W


def test_plain_undoes_disguises():
    texts = ["In­suf​fi⁠cient", "Ｉｎｓｕｆｆｉｃｉｅｎｔ", "<p>Insufficient</p>", "In<b>suffi</b>cient", "INSUFFICIENT", "&#73;nsufficient"]
    assert {W.fold(W.plain(t)).strip() for t in texts} == {"insufficient"}
    assert W.fold(W.plain("Félix")) == W.fold(W.plain("Félix"))
    assert W.plain("a&nbsp;b<br/>c") == "a b\nc"
    assert W.plain("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"


def test_tags_of_any_length_go_and_other_angles_stay():
    words = " ".join(f"w{i}" for i in range(200))
    assert W.plain(f'one <a title="{words}" data-x=\'{words}\' href=u.html>two</a> three') == "one two three"
    assert W.plain(f"<p class={'c' * 900}>a</p><!-- {words} --><td nowrap>b<img src=x hidden />c") == "\na\n\nbc"
    assert W.plain("<!DOCTYPE html><x-note k='v'>n</x-note> <tei:w>m</tei:w>") == "n m"
    for text in ("if x <y and then some words> z", "a <b and c> d", "List<int> of <unknown>", "x <- y, 3 <4> 5", "<" * 50, "<a href='x", "<p "):
        assert W.plain(text) == text
    assert W.plain("&lt;b&gt;bold&lt;/b&gt; 1 &lt; 2") == "bold 1 < 2"


def test_long_texts_of_angles_take_linear_time():
    for part in ("<a ", "<a b=", '<a b="c" ', "<a b=c d", "</", "<!-", "< x"):
        began = time.process_time()
        W.plain(part * 60_000)
        assert time.process_time() - began < 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab Z9_-é中文\t.", max_size=30), max_size=8))
def test_words_agree_with_a_pattern(texts):
    texts = [W.fold(t) for t in texts]
    hashes, owner = W.words(texts)
    expected = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[中文]|[^\W_中文]+", t)]
    assert owner.tolist() == [i for i, _ in expected]
    names = {}
    for h, (_, w) in zip(hashes.tolist(), expected):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_windows():
    values = np.array([5, 3, 9, 1, 7, 2, 8], np.uint64)
    for width in range(1, 8):
        assert W.window_minimum(values, width).tolist() == [min(values[i : i + width].tolist()) for i in range(8 - width)]
    assert len(W.shingles(values, 8)) == 0 and len(W.shingles(values, 7)) == 1
    assert [len(b) for b in W.blocks([(0, "x" * 10), (1, ""), (2, "y" * 50), (3, "z")], 20)] == [3, 1]
