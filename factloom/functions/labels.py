"""Label texts to class ids under three policies.

0 is supported, 1 refuted, 2 not enough information. ``loader`` sends unknown labels to 2; ``fusion``
gives null for them (the caller decides to fail); ``tuned`` sends them to 2 and truncates numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label texts in capitals, by class and policy.
ALIASES = {
    "loader": (
        ("ĐÚNG", "DUNG", "TRUE", "SUPPORTED", "LEGIT", "LEGITIMATE", "0"),
        ("SAI", "FALSE", "REFUTED", "SCAM", "1"),
        ("NEI", "NOT ENOUGH INFO", "NOT ENOUGH INFORMATION", "INSUFFICIENT", "2"),
    ),
    "fusion": (
        ("TRUE", "ĐÚNG", "DUNG", "SUPPORTED", "LEGIT", "0"),
        ("FALSE", "SAI", "REFUTED", "SCAM", "FAKE", "1"),
        ("NEI", "THIEU", "NOT ENOUGH INFO", "NOT ENOUGH INFORMATION", "INSUFFICIENT", "2"),
    ),
    "tuned": (
        ("A", "TRUE", "SUPPORTED", "LEGIT", "LEGITIMATE", "ĐÚNG", "DUNG", "0"),
        ("B", "FALSE", "REFUTED", "SCAM", "SAI", "1"),
        ("C", "THIEU", "THIẾU", "NEI", "NOT ENOUGH INFO", "NOT ENOUGH INFORMATION", "INSUFFICIENT", "2"),
    ),
}
VERDICTS = ("Đúng", "Sai", "Chưa chắc chắn")


def label_id(label: Column, policy: str = "loader") -> Column:
    """The class id of a label text."""
    number = label.try_cast("double")
    text = F.upper(F.trim(label))
    named = F.lit(None).cast("int")
    for k in (2, 1, 0):
        named = F.when(text.isin(*ALIASES[policy][k]), k).otherwise(named)
    if policy == "loader":
        by_number = F.when(number.isin(0.0, 1.0, 2.0), number.cast("int"))
    else:
        whole = F.when((number > -1) & (number < 3), number.cast("int"))
        by_number = F.when(whole.isin(0, 1, 2), whole)
    found = F.coalesce(by_number, named)
    return found if policy == "fusion" else F.coalesce(found, F.lit(2))


def verdict(class_id: Column) -> Column:
    """The verdict text of a class id; the last one for anything unknown."""
    return F.when(class_id == 0, VERDICTS[0]).when(class_id == 1, VERDICTS[1]).otherwise(VERDICTS[2])
