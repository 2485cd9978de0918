"""Visually identical text with different characters (problem 9).

Method: a longest-match transducer over grapheme clusters. Its mapping is compiled once from rules over the Unicode
tables and checked for conflicts; a text is then rewritten in one pass. A cluster is a base character with the marks and
invisible characters after it; clusters that the compiled table does not hold are formed by the same rules and kept.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftlane.operators.skew import in_blocks
from siftlane.session import cut

#: Rows of one look, or of one text, that meet in a task; more are split into blocks of about so many.
BLOCK = 4096

# Letters of one case that look alike; the first of each group stands for all.
LOOK_ALIKE = (
    "AΑА", "BΒВ", "CСϹ", "EΕЕ", "FϜ", "GԌ", "HΗН", "IΙІӀ", "JЈͿ", "KΚК", "MΜМϺ", "NΝ", "OΟО", "PΡР", "QԚ", "SЅ", "TΤТ", "VѴ", "WԜ", "XΧХ", "YΥУҮ", "ZΖ", "ГΓ", "ПΠ", "ФΦ", "ΨѰ",
    "aаα", "cсϲ", "dԁ", "eе", "hһ", "iіι", "jјϳ", "lӏ", "oоο", "pрρ", "qԛ", "sѕ", "uυ", "vνѵ", "wԝ", "xхχ", "yуүγ", "кκ", "фφϕ", "ψѱ", "єϵ",
)
# Kinds of compatibility forms that look like what they stand for.
STYLES = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
# Compatibility forms of letters that do not look like them.
UNLIKE = "ſẛ"
# Characters without a form of their own that are not of category Cf.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, [*range(0x180B, 0x180E), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]))


def _invisible(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or ch in INVISIBLE


def _plain(ch: str) -> str:
    """``ch`` without style, width, joining and composition; marks stay, look-alikes are not yet replaced."""
    if _invisible(ch):
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    kind, _, rest = unicodedata.decomposition(ch).rpartition("> ")
    if not rest or ch in UNLIKE:
        return ch
    parts = [chr(int(x, 16)) for x in rest.split()]
    if not kind or kind + ">" in STYLES or kind == "<compat" and all(x.isalpha() for x in parts):
        return "".join(map(_plain, parts))
    return ch


class Transducer:
    """The compiled mapping. ``table`` maps clusters that change; ``rewrite`` applies it in one pass."""

    def __init__(self) -> None:
        alike = {x: group[0] for group in LOOK_ALIKE for x in group[1:]}
        self.rest: dict[str, str] = {}
        self._form = lambda cluster: unicodedata.normalize("NFC", "".join(alike.get(x, x) for ch in cluster for x in _plain(ch)))
        self.table: dict[str, str] = {}
        marks = []
        for code in range(0xA0, sys.maxunicode + 1 if sys.maxunicode < 0x30000 else 0x30000):
            if 0xD800 <= code < 0xE000 or 0x3400 <= code < 0x9FFF or 0xAC00 <= code < 0xD7A4:
                continue
            ch = chr(code)
            form = self._form(ch)
            # what joins the character before it: marks, forms of marks, vowels and finals of Hangul
            if unicodedata.category((form or ch)[0]) in ("Mn", "Mc", "Me") or 0x1160 <= code < 0x1200:
                marks.append(ch)
            if form != ch:
                self._add(ch, form)
            parts = unicodedata.normalize("NFD", ch)
            if len(parts) > 1:
                self._add(parts, form)
        hidden = "".join(map(re.escape, (x for x in map(chr, (*range(0xA0, 0x30000), *range(0xE0000, 0xE0200))) if _invisible(x))))
        for x in map(chr, range(0xE0000, 0xE0200)):
            if _invisible(x):
                self._add(x, "")
        self._check(alike)
        after = hidden + "".join(map(re.escape, marks))
        # the longest match takes a base with all that follows it; other characters are clusters of one
        self.clusters = [re.compile(f"[^{x}]?[{x}]+", re.DOTALL) for x in (after, "".join(c for c in after if c < "\U00010000"))]
        self.single = {ord(x): y for x, y in self.table.items() if len(x) == 1}

    def _add(self, cluster: str, form: str) -> None:
        if self.table.setdefault(cluster, form) != form:
            raise ValueError(f"two forms of {cluster!r}: {self.table[cluster]!r} and {form!r}")

    def _check(self, alike: dict[str, str]) -> None:
        """No form changes again, look-alikes keep their case, and letters never become digits or digits letters."""
        for cluster, form in self.table.items():
            if self._form(form) != form:
                raise ValueError(f"the form {form!r} of {cluster!r} is not final")
            if any(x.isalpha() for x in cluster) != any(x.isalpha() for x in form) and any(x.isdigit() for x in cluster + form):
                raise ValueError(f"{cluster!r} and {form!r} mix letters and digits")
        for a, b in alike.items():
            if a.isupper() != b.isupper():
                raise ValueError(f"{a!r} and {b!r} differ in case")

    def _cluster(self, s: str) -> str:
        form = self.table.get(s)
        if form is None and (form := self.rest.get(s)) is None:
            form = self._form(s)
            if len(s) < 5 and len(self.rest) < 100_000:
                self.rest[s] = form
        return form

    def rewrite(self, text: str) -> str:
        """The one form of ``text``. Case, accents, digits, punctuation, line breaks and the number of blanks stay."""
        if text.isascii():
            return text
        out, last = [], 0
        # the class of characters within the basic plane is looked up at once, so it is used where it suffices
        for m in self.clusters[max(text) < "\U00010000"].finditer(text):
            out += (text[last : m.start()].translate(self.single), self._cluster(m[0]))
            last = m.end()
        out.append(text[last:].translate(self.single))
        return "".join(out)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    """Compiled once a process."""
    return Transducer()


@F.arrow_udf(StringType())
def _rewritten(texts: pa.Array) -> pa.Array:
    t = transducer()
    return pa.array([None if x is None else t.rewrite(x) for x in texts.to_pylist()], pa.string())


def one_form(text: Column | str) -> Column:
    """The text in its one form: texts that look the same are equal in it. Null stays null, empty stays empty."""
    return _rewritten(F.col(text) if isinstance(text, str) else text)


def look_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, look, raw): two documents look the same if ``look`` is equal, and are the same text if ``raw`` is, too.

    ``look`` and ``raw`` are 128-bit digests, so texts of any length stay where they are read. Null texts are left out;
    an empty text looks like one of only invisible characters. Rows that repeat count once.
    """
    return docs.select(F.col(key).alias("doc"), F.md5(one_form(text)).alias("look"), F.md5(text).alias("raw")).filter(F.col("raw").isNotNull()).distinct()


def same_look(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b), a < b: the pairs of documents whose texts differ but look the same, each once.

    Copies of one text are first counted as one, and only looks with several texts are paired, text by text; documents
    come in at the end, so a text that a third of all documents share is compared once with each of its look-alikes.
    """
    d = cut(look_classes(docs, key, text))
    texts = d.select("look", "raw").distinct()
    several = cut(texts.groupBy("look").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))
    # looks of very many texts are compared block by block, of which only i <= j meet
    blocks = f"cast(ceil(n / {BLOCK}) as int)"
    texts = texts.join(several, "look").selectExpr("look", "raw", f"{blocks} as k", f"cast(pmod(xxhash64(raw), {blocks}) as int) as own")
    p, q = texts.selectExpr("look", "raw", "own as i", "explode(sequence(own, k - 1)) as j"), texts.selectExpr("look", "raw as other", "explode(sequence(0, own)) as i", "own as j")
    pairs = cut(p.join(q, ["look", "i", "j"]).filter("i < j or raw < other").select("raw", "other"))
    docs_of = cut(d.join(several, "look", "left_semi").select("raw", "doc"))
    left, right = in_blocks(pairs, docs_of, "raw", BLOCK)
    first = left.join(right, ["raw", "_i", "_j"]).selectExpr("doc as x", "other as raw")
    left, right = in_blocks(cut(first), docs_of, "raw", BLOCK)
    both = left.join(right, ["raw", "_i", "_j"]).selectExpr("x", "doc as y").filter("x <> y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
