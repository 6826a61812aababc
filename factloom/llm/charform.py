"""One character form for texts that look alike (problem 2).

``visual_form`` brings a text to a form that is equal for two texts exactly if they read the same
letter for letter: default-ignorable characters go, compatibility characters and look-alike letters
become the plain letter, accents are composed, blank space becomes single spaces. Letter case stays;
``folded`` adds full case folding for comparisons that leave case aside.

Superscripts, subscripts, fractions and circled forms are kept as they are: they do not look like
the figure or letter that compatibility normalisation would put in their place.

Texts made of characters that are already in that form (tested by one regular expression in the
JVM) never leave the JVM; only the others go through an Arrow UDF, once per distinct value of a batch.
Null stays null, an empty or blank text becomes the empty text.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.storage import materialize

# Characters that need no change besides blank space (Java and Python classes alike).
PLAIN = (
    "\\t\\n\\r -~\\u1EA0-\\u1EF9\\u0110-\\u0111\\u01A0-\\u01A1\\u01AF-\\u01B0\\u0102-\\u0103"
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝÞàáâãäåæçèéêëìíîïñòóôõöøùúûüýþÿ©«»×÷"
    "\\u4E00-\\u9FFF\\u0128-\\u0129\\u0168-\\u0169–—‘’“”•€。"
)
ASCII_BLANKS = " \\t\\r\\x0B\\x0C\\x1C-\\x1F"
DIRTY_JAVA = f"[^{PLAIN}\\x{{1F300}}-\\x{{1FAFF}}]"

# Characters the Unicode standard calls default-ignorable.
_IGNORABLE = re.compile(
    "[\\u00AD\\u034F\\u061C\\u115F\\u1160\\u17B4\\u17B5\\u180B-\\u180F\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u206F"
    "\\u3164\\uFE00-\\uFE0F\\uFEFF\\uFFA0\\uFFF0-\\uFFF8\\U000E0000-\\U000E0FFF]+"
)
# Letters (decomposed) and marks that look like another one, and that one, script by script, after the
# Unicode consortium's public table of confusable characters, as far as the twin is a letter or mark of ASCII (and Đ).
_ALIKE_PAIRS = (
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿαγινορυϳ", "ABEZHIKMNOPTYXJayivopuj"),
    ("АВЕЅІЈКМНОРСТУХѴӀҮԌԚԜаеорсухѕіјһҺԁԛԝүѵӏғԍ", "ABESIJKMHOPCTYXVIYGQWaeopcyxsijhHdqwyvlfg"),
    ("ՕՏՍԼօոսցհզյ", "OSULonughqj"),
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᎩᏃ", "ABCDEGHJKLMPRSTVWYZ"),
    ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
    ("ɑɡɩɪıʋʏᴄᴏᴜᴠᴡᴢꜱ", "agiiiuycouvwzs"),
    ("ƉÐ‐‑‒−ǃ", "ĐĐ----!"),
)
_ALIKE = {a: b for left, right in _ALIKE_PAIRS for a, b in zip(left, right, strict=True)}
_ALIKE_RE = re.compile(f"[{re.escape(''.join(_ALIKE))}]")
_BLANKS = re.compile(r"\s+")
_BLANKS_IN_LINE = re.compile(r"[^\S\n]+")
_KEPT = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>")


@lru_cache(1)
def _kept() -> frozenset[str]:
    """The characters whose compatibility form looks different, found by rule in the Unicode data."""
    return frozenset(chr(c) for c in range(0xA0, 0x1F200) if unicodedata.decomposition(chr(c)).startswith(_KEPT))


def _decomposed(text: str) -> str:
    """Compatibility decomposition of all but the kept characters."""
    if _kept().isdisjoint(text):
        return unicodedata.normalize("NFKD", text)
    return "".join(c if c in _kept() else unicodedata.normalize("NFKD", c) for c in text)


def visual_form(text: str, keep_lines: bool = False) -> str:
    """The visual form of one text; with ``keep_lines`` line feeds stay where they are."""
    text = _IGNORABLE.sub("", text)
    if not text.isascii():
        text = _ALIKE_RE.sub(lambda m: _ALIKE[m[0]], _decomposed(text))
        text = unicodedata.normalize("NFC", text)
    text = text.replace("ß", "ss").replace("ẞ", "SS")
    if keep_lines:
        return _BLANKS_IN_LINE.sub(" ", text)
    return _BLANKS.sub(" ", text).strip(" ")


def visual_pieces(text: str) -> list[str]:
    """What each character of a text adds to its visual form, before accents are composed and blanks are joined."""
    return [_piece(c) for c in text]


@lru_cache(50_000)
def _piece(c: str) -> str:
    if _IGNORABLE.fullmatch(c):
        return ""
    if not c.isascii():
        c = _ALIKE_RE.sub(lambda m: _ALIKE[m[0]], _decomposed(c))
    return c.replace("ß", "ss").replace("ẞ", "SS")


def folded(text: str) -> str:
    """The visual form with full case folding."""
    return unicodedata.normalize("NFC", visual_form(text).casefold())


def _vectorised(keep_lines: bool, fold: bool = False):
    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        known = {v: visual_form(v, keep_lines) for v in values.dropna().unique()}
        if fold:
            known = {v: unicodedata.normalize("NFC", f.casefold()) for v, f in known.items()}
        return pd.Series([known.get(v) for v in values], dtype=object)

    return form


def dirty(text: Column) -> Column:
    """Whether a text has characters that may not be in the visual form; ASCII has no other form."""
    return (F.octet_length(text) != F.length(text)) & text.rlike(DIRTY_JAVA)


def _blanks_joined(text: Column, keep_lines: bool) -> Column:
    if keep_lines:
        return F.regexp_replace(text, f"[{ASCII_BLANKS}]+", " ")
    return F.trim(F.regexp_replace(text, f"[{ASCII_BLANKS}\\n]+", " "))


def form_column(text: Column, keep_lines: bool = False) -> Column:
    """``visual_form`` as a column; only texts with unusual characters visit Python."""
    return _blanks_joined(F.coalesce(_vectorised(keep_lines)(F.when(dirty(text), text)), text), keep_lines)


def folded_column(text: Column, keep_lines: bool = False) -> Column:
    """``folded`` as a column. Of the plain characters none folds to anything but its small letter; the others are folded in Python."""
    return _blanks_joined(F.coalesce(_vectorised(keep_lines, True)(F.when(dirty(text), text)), F.lower(text)), keep_lines)


def with_forms(df: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(record_kind, record_key, form, raw): digests of the visual form and of the text itself.

    Both are 128-bit digests, so that equal digests mean equal texts. Texts with unusual characters get their form once per
    distinct value of the whole table. Null and empty texts give no row. A blank text gets the empty form, which
    ``look_alike_pairs`` leaves out: a filter here would be pushed below the form and compute it twice.
    """
    t = F.col("t")
    own = df.select(F.col(key).alias("record_key"), F.col(text).alias("t")).where("t is not null and t <> ''")
    plain = F.when(~dirty(t), F.unhex(F.md5(_blanks_joined(t, False))))
    rows = own.select("record_key", plain.alias("plain"), F.unhex(F.md5(t)).alias("raw"))
    values = own.select("t").where(dirty(t)).groupBy(F.unhex(F.md5(t)).alias("raw")).agg(F.any_value("t").alias("t"))
    forms = values.select("raw", F.unhex(F.md5(_blanks_joined(_vectorised(False)(t), False))).alias("unusual"))
    both = rows.join(forms, "raw", "left")  # left for the join's own choice: the texts are on neither side
    return both.select(F.lit(kind).alias("record_kind"), "record_key", F.coalesce("plain", "unusual").alias("form"), "raw")


def look_alike_pairs(forms: DataFrame, salts: int = 16) -> DataFrame:
    """(record_kind, key_a, key_b): rows of one kind with the same form but another raw text.

    Rows whose form occurs in one spelling only leave by an aggregate that combines on the map
    side. What remains is joined on the form, salted, so that a text with very many copies is
    spread over ``salts`` tasks. Rows with the same raw text are never paired with each other.
    Empty input gives no row; a key that is null takes part in no pair.
    """
    forms = materialize(forms, "forms").where(F.col("form") != F.unhex(F.md5(F.lit(""))))
    several = forms.groupBy("record_kind", "form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi")
    # shuffled on purpose: the variants grow with the table
    rows = materialize(forms.join(several.select("record_kind", "form").hint("merge"), ["record_kind", "form"], "left_semi"), "variants")
    a = rows.select("record_kind", "form", F.col("record_key").alias("key_a"), F.col("raw").alias("raw_a"))
    a = a.withColumn("salt", F.pmod(F.xxhash64("key_a"), F.lit(salts)))
    b = rows.select("record_kind", "form", F.col("record_key").alias("key_b"), F.col("raw").alias("raw_b"))
    b = b.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    pairs = a.join(b.hint("merge"), ["record_kind", "form", "salt"]).where("key_a < key_b and raw_a <> raw_b")
    return pairs.select("record_kind", "key_a", "key_b").distinct()
