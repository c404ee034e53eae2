"""Flow labels: cleaned text, family, attack flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatlake.constants import FAMILY_PATTERNS


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def label_clean(text: Column) -> Column:
    printable = F.regexp_replace(text, r"[^\p{Print}]+", "-")
    return F.when(is_blank(text), "Unlabeled").otherwise(F.trim(printable))


def attack_family(text: Column) -> Column:
    family = F.when(is_blank(text), "Unlabeled")
    for pattern, name in FAMILY_PATTERNS:
        family = family.when(text.ilike(f"%{pattern}%"), name)
    return family.otherwise("Other")


def is_attack(text: Column) -> Column:
    """NULL for unlabeled rows, 0 for benign ones, 1 otherwise."""
    return F.when(is_blank(text), None).when(text.ilike("%BENIGN%"), 0).otherwise(1)


def class_name(attack_flag: Column) -> Column:
    return F.when(attack_flag == 0, "Benign").when(attack_flag == 1, "Attack").otherwise("Unlabeled")
