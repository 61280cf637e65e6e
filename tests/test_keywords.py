"""The keyword automaton against a plain search, and gates of nulls, empty and very long texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from reqwatch.config import EngineConfig
from reqwatch.functions import fixed
from reqwatch.functions.keywords import JOINED, LANE, PER_LONG, Automaton, Gates
from reqwatch.operators import detect


def _plain(groups, text) -> int:
    low = (text or "").lower()
    return sum(1 << k for k, words in enumerate(groups) if any(w in low for w in words))


def _whole(row) -> int:
    return sum(int(v) << PER_LONG * k for k, v in enumerate(row))


def test_masks_are_those_of_a_plain_search():
    groups = detect.rule_gates(EngineConfig()).groups
    assert len(groups) > 2 * PER_LONG
    draw = random.Random(3)
    pieces = [w for g in groups for w in g] + ["x", " ", "K", "İ", "é", "\0"]
    texts = ["".join(draw.choice(pieces)[: draw.randint(1, 30)].swapcase() for _ in range(draw.randint(0, 200))) for _ in range(400)]
    found = Automaton(groups).masks(texts)
    assert [_whole(r) for r in found] == [_plain(groups, t) for t in texts]


@pytest.mark.parametrize("words", [("he", "she", "his", "hers"), ("aaaa", "aa"), ("abcabd", "bcab", "x")])
def test_words_within_words(words):
    groups = tuple((w,) for w in words)
    texts = ["ushers", "AAAAA", "aa", "abcabcabd", "", None, "x" * 3]
    assert [_whole(r) for r in Automaton(groups).masks(texts)] == [_plain(groups, t) for t in texts]


def test_words_at_the_edges_of_lanes_and_of_texts():
    one = Automaton((("needle",), ("dle",)))
    for at in range(LANE - 8, LANE + 8):
        assert _whole(one.masks(["." * at + "Needle" + "." * LANE])[0]) == 3
    assert not one.masks(["nee", "dl", "e"]).any()  # a word does not reach from one text to the next
    long = "." * (JOINED + LANE) + "needle"
    assert [_whole(r) for r in one.masks(["dle", long, None, "x"])] == [2, 3, 0, 0]


def test_words_in_capitals_match_no_lower_cased_text_and_odd_words_are_refused():
    assert not Automaton((("Abc",),)).masks(["abc Abc"]).any()
    for odd in ("", "é"):
        with pytest.raises(ValueError):
            Automaton(((odd,),))


def test_gates_of_rows(spark):
    texts = [None, "", "plain words", "SELECT x", "a" * 300_000 + "<Script", "../", "K" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", detect.open_gates(F.col("t")).alias("o")).orderBy("id")
    for (_, o), t in zip(df.collect(), texts):
        low = (t or "").lower()
        want = {c: any(w in low for w in ws) for c, ws in {"screened": fixed.PRESCREEN, **fixed.CATEGORY_KEYWORDS}.items()}
        assert o.asDict() == want


def test_first_bytes_alone_count_even_when_they_end_amid_a_character(spark):
    gates = Gates()
    df = spark.createDataFrame([("é" * 5 + "select",), ("select" + "é" * 5,)], "t string")
    cut = F.substring(F.col("t").cast("binary"), 1, 9).cast("string")
    rows = df.select(gates.test(gates.masks(F.col("t"), 9), "sql").alias("a"), gates.test(gates.masks(cut), "sql").alias("b")).collect()
    assert [tuple(r) for r in rows] == [(False, False), (True, True)]
