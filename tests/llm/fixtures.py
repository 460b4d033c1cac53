"""Small tables with every awkward case, and plain definitions to compare with."""

from __future__ import annotations

import re

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, label long, size string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    prose = "the quick brown fox jumps over the lazy dog near the quiet river bank today"
    rows = [
        (1, prose, "en", "a"),
        (2, prose, "en", "a"),
        (2, prose, "en", "a"),
        (3, prose.replace("lazy", "idle"), "en", "b"),
        (4, None, "en", "b"),
        (5, "", None, None),
        (6, " \n\t ", "en", None),
        (None, "one two", None, "c"),
        (None, None, None, None),
        (7, "word " * 30_000, "en", "a"),
        (8, "É ü ñ ß x\n\nÉ ü ñ ß x\r\nlast", "fr", "é"),
        (9, "\n".join(f"line {i} of many different lines here" for i in range(40)), "en", "a"),
        (10, "x" * 70_000, "en", "z"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, "s") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
