"""Disguised words of each kind reach the lattice and are restored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from sievelake.llm import toxicity
from sievelake.llm._text import Words

PLAIN = "stupid fools kill and bully the ass in hell with fuck and shit " * 50


@pytest.fixture(scope="module")
def lm(spark):
    return toxicity.language_model(toxicity.count_trigrams(spark.createDataFrame([(PLAIN,)], "text string")))


@pytest.mark.parametrize(
    ("text", "word"),
    [("a$$", "ass"), ("ki11", "kill"), ("he11.", "hell"), ("bu11y", "bully"), ("k1ll", "kill"), ("sh!t", "shit")]
    + [("stuupid", "stupid"), ("fuuck", "fuck"), ("stuuupid", "stupid"), ("455", "ass"), ("4$5.", "ass")]
    + [("st.upid", "stupid"), ("st--upid", "stupid"), ("f_uck", "fuck"), ("k i l l", "kill"), ("k  i   l  l", "kill"), ("k - i -- l - l", "kill"), ("fu ck", "fuck"), ("fu  -  ck", "fuck"), ("stu pid", "stupid"), ("the fu ck and", "fuck"), ("k\ni\nl\nl", "kill")],
)
def test_kinds(lm, text, word):
    common = np.sort(np.unique(Words(pa.array(["the and"])).hash))
    rows, said = toxicity.restored(pa.array(["plain words", text]), lm, {}, common)
    assert 1 in rows and word in " ".join(x for r, x in zip(rows, said) if r == 1).split(), said


def test_plain_words_are_no_suspects():
    texts = pa.array(["hello all, we will sell the old apple!!", "in 2020, really", "ok | $$$ !!!"])
    common = np.sort(np.unique(Words(texts).hash))
    assert toxicity.suspects(texts, common)[:2] == ([], [])


def test_common_words(spark):
    d = spark.createDataFrame([("hello the cat " * 20 + "stuupid",)], "text string")
    h = Words(pa.array(["hello the cat stuupid"])).hash
    assert toxicity._among(h, toxicity.common_words(d)).tolist() == [True, True, True, False]
    assert len(toxicity.common_words(d.limit(0))) == 0
