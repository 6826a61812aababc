"""Text scalars as native columns. Null in, null out unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as blank space (a class body valid in Java and RE2).
BLANK = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Fixed value: characters removed as icons; the third range also covers CJK and Hangul, as in the original rule.
ICONS = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}"
    r"\x{2640}-\x{2642}\x{2600}-\x{2B55}\x{200D}\x{23CF}\x{23E9}\x{231A}\x{FE0F}\x{3030}\x{10000}-\x{10FFFF}]+"
)
# Fixed value: query terms and the synonyms that expand them, in this order.
GLOSSARY = (
    ("claim", ("statement", "assertion", "allegation")),
    ("evidence", ("proof", "support", "documentation")),
    ("false", ("incorrect", "inaccurate", "misleading", "wrong")),
    ("true", ("correct", "accurate", "verified", "confirmed")),
    ("refuted", ("debunked", "disproven", "contradicted")),
    ("supported", ("confirmed", "validated", "corroborated")),
    ("stock", ("shares", "equity", "securities")),
    ("investment", ("capital", "funding", "portfolio")),
    ("profit", ("gain", "return", "earnings")),
    ("loss", ("decline", "drop", "deficit")),
    ("market", ("exchange", "trading", "financial")),
    ("verify", ("confirm", "validate", "authenticate", "check")),
    ("source", ("reference", "citation", "origin")),
    ("fact", ("truth", "reality", "data")),
)
# Fixed value: the classification prompt.
PROMPT = (
    "You are an expert fact-checker verifying Vietnamese claims based on the provided evidence.\n\n"
    "Classify the claim based on ALL the evidence and answer with ONLY a single letter:\n"
    "- A: The evidence supports the claim\n- B: The evidence contradicts the claim\n"
    "- C: There is not enough evidence to support or refute the claim\n\nClaim: {claim}\n\nEvidence: {evidence}\n\nConclusion: "
)
# Fixed value: phrases that give a generated claim away.
# Words too common in English text to search for.
STOPWORDS = tuple(
    "a an the and or but if then than so of in on at by for from with to as is are was were be been being am do does did have has had it its this that these those he she they we you i his her their our your my "
    "me him them us not no nor can could will would shall should may might must about into over under again more most other some such only own same too very".split()
)
LEAKS = ("evidence:", "false because", "true because", "is supported by", "contradicts", "return only", "json")


def collapse_blank(text: Column) -> Column:
    """Runs of blank space to one space, trimmed; null to the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANK}]+", " "))


def normalize(text: Column) -> Column:
    """Lower case, without punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}_{BLANK}]", ""), f"[{BLANK}]+", " "))


def ascii_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def word_tokens(text: Column) -> Column:
    """Runs of letters, figures and underscores in the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def overlap_ratio(query: Column, document: Column) -> Column:
    """Share of the query's distinct ASCII tokens that the document has; 0 if either has none."""
    q, d = F.array_distinct(ascii_tokens(query)), F.array_distinct(ascii_tokens(document))
    return F.when((F.size(q) == 0) | (F.size(d) == 0), 0.0).otherwise(F.size(F.array_intersect(q, d)) / F.size(q))


def is_verbatim(text: Column) -> Column:
    """Whether a query is a whole article: 1200 characters or 200 ASCII tokens and more."""
    flat = collapse_blank(text)
    return (F.length(flat) >= 1200) | (F.size(ascii_tokens(flat)) >= 200)


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last one an ellipsis; unchanged for ``most`` of 0 or less."""
    if most <= 0:
        return text
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def expand_query(text: Column, glossary: tuple = GLOSSARY) -> Column:
    """The query and the first two synonyms of every glossary term it contains, in the glossary's order."""
    low = F.lower(text)
    return F.concat_ws(" ", text, *[F.when(low.contains(term), F.lit(" ".join(synonyms[:2]))) for term, synonyms in glossary])


def strip_icons(text: Column) -> Column:
    """Without emoji and icons, single spaces; an empty text stays as it is."""
    return F.when(F.length(text) > 0, F.trim(F.regexp_replace(F.regexp_replace(text, ICONS, ""), f"[{BLANK}]+", " "))).otherwise(text)


def safe_name(name: Column, most: int = 80) -> Column:
    """Letters, figures, spaces, hyphens and underscores of a name; "unknown" if none is left."""
    clean = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N} _-]", ""))
    return F.substring(F.when(clean == "", F.lit("unknown")).otherwise(clean), 1, most)


def first_filled(*columns: Column) -> Column:
    """The first value that is not blank, trimmed; else the empty text."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def prompt(claim: Column, evidence: Column, template: str = PROMPT) -> Column:
    """The template with claim and evidence filled in."""
    head, rest = template.split("{claim}")
    middle, tail = rest.split("{evidence}")
    return F.concat(F.lit(head), F.coalesce(claim, F.lit("")), F.lit(middle), F.coalesce(evidence, F.lit("")), F.lit(tail))


def retrieval_tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Words of the lower-cased text without addresses and stop words; only runs of letters and figures count.

    Part-of-speech tags and base forms need language data, which a caller may apply to the array.
    """
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"http\S+|www\.\S+", " ")
    return F.filter(F.regexp_extract_all(bare, F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: ~w.isin(*stopwords))


def feedback_id(post_id: Column) -> Column:
    """The base64 form of a post's feedback id."""
    return F.base64(F.encode(F.concat(F.lit("feedback:"), post_id), "UTF-8"))


def reply_json(reply: Column) -> Column:
    """The outermost braces of a model reply, without its thinking part; null if there are none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""), r"(?s)(\{.*\})", 1), F.lit(""))


def leak_free_claim(claim: Column) -> Column:
    """Length, leakage and format gates of a generated claim."""
    flat = collapse_blank(claim)
    n = F.size(F.split(flat, " "))
    leak = F.lit(False)
    for phrase in LEAKS:
        leak = leak | F.lower(flat).contains(phrase)
    marked = flat.startswith("- ") | flat.startswith("* ") | flat.startswith("1. ")
    return (flat != "") & n.between(5, 50) & ~leak & ~marked


def env_flag(value: str | None, default: bool = False) -> bool:
    """Whether a setting is on."""
    return default if value is None else value.strip().lower() in {"1", "true", "yes", "y", "on"}


def field_boost(field: str) -> tuple[str, float]:
    """``name^boost`` parted; a boost that is no number counts 1."""
    name, _, boost = field.partition("^")
    try:
        return name.strip(), float(boost) if boost else 1.0
    except ValueError:
        return name.strip(), 1.0


def strip_period(text: Column) -> Column:
    """Without trailing periods and blanks."""
    return F.regexp_replace(F.trim(text), r"\.+$", "")


def lower_first(text: Column) -> Column:
    """The first character in lower case."""
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))
