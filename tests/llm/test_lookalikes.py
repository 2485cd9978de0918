import unicodedata
from collections import defaultdict
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlane.llm import lookalikes
from siftlane.llm.lookalikes import INVISIBLE, LOOK_ALIKE, look_classes, one_form, same_look, transducer

ALIKE = {x: g[0] for g in LOOK_ALIKE for x in g[1:]}


def plain(text):
    """The definition for the characters of the test tables, by library functions over the whole text."""
    text = "".join(c for c in text if unicodedata.category(c) != "Cf" and c not in INVISIBLE)
    text = "".join(" " if unicodedata.category(c) == "Zs" else c for c in text)
    return unicodedata.normalize("NFC", "".join(ALIKE.get(c, c) for c in unicodedata.normalize("NFKD", text)))


def brute(rows):
    of = defaultdict(list)
    for doc, text in set(rows):
        if text is not None:
            of[plain(text)].append((doc, text))
    return {(min(a, b), max(a, b)) for x in of.values() for (a, s), (b, t) in combinations(x, 2) if s != t and a != b}


SAME = [("Ｔｈｅ", "The"), ("Τhе", "The"), ("ﬁn", "fin"), ("𝐚b", "ab"), ("é", "é"), ("е́", "é"), ("e‍́", "é"), ("a b", "a b"), ("a　b", "a b"), ("x​y⁠z﻿", "xyz"), ("­ab", "ab"), ("О", "O"), ("ṩ", "ṩ"), ("ṩ", "ṩ"), ("і́", "í"), ("й", "й"), ("ё", "ë"), ("１２", "12"), ("ﾊﾞ", "バ"), ("각", "각"), ("́a", "́а"), ("V", "Ѵ"), ("v", "ѵ"), ("u", "υ"), ("y", "γ"), ("G", "Ԍ"), ("F", "Ϝ"), ("Ψ", "Ѱ")]
OTHER = [("a", "A"), ("é", "e"), ("O", "0"), ("l", "1"), ("a b", "a  b"), ("a\nb", "a b"), ("a\n", "a\r\n"), ("a,b", "a.b"), ("²", "2"), ("①", "1"), ("k", "к"), ("З", "3"), ("ß", "ss"), ("ſ", "s"), ("T", "т"), ("Ӏ", "l"), ("σ", "o"), ("г", "r")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert transducer().rewrite(a) == transducer().rewrite(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other(a, b):
    assert transducer().rewrite(a) != transducer().rewrite(b)


@settings(max_examples=500, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aеό̈‍Ａ𝐚ﬁ  ")), max_size=12))
def test_one_pass_is_final(text):
    t = transducer()
    once = t.rewrite(text)
    assert t.rewrite(once) == once and t.rewrite(unicodedata.normalize("NFD", text)) == once == t.rewrite(unicodedata.normalize("NFC", text))


def test_whole_table(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    assert {(r.a, r.b) for r in same_look(d).collect()} == brute(rows) and brute(rows)


def test_edges(spark):
    rows = [(1, "abc"), (2, "аbc"), (3, "abc"), (4, None), (5, ""), (6, "​"), (7, ""), (8, "x" * 50_000), (9, "x" * 49_999 + "ｘ"), (1, "abc"), (10, "ABC")]
    d = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumns({"look": F.lit("l"), "raw": F.lit("r"), "doc": F.lit(1)})
    got = [(r.a, r.b) for r in same_look(d).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) == {(1, 2), (2, 3), (5, 6), (6, 7), (8, 9)}
    assert same_look(d.limit(0)).count() == 0
    assert look_classes(d).filter("doc = 4").count() == 0 and d.filter("doc_id = 4").select(one_form("text")).first()[0] is None


def test_hot_looks_and_texts_meet_in_blocks(spark, monkeypatch):
    """One look that a third of all texts have, one text that a third of all documents have."""
    monkeypatch.setattr(lookalikes, "BLOCK", 5)
    rows = [(k, "ab" + "\u200b" * (k % 23)) for k in range(40)] + [(100 + k, "cо") for k in range(40)] + [(200, "co"), (201, "со")] + [(300 + k, f"t{k}") for k in range(40)]
    d = spark.createDataFrame(rows + rows[:9], "doc_id BIGINT, text STRING")
    got = [(r.a, r.b) for r in same_look(d).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert look_classes(d).count() == len(rows)
