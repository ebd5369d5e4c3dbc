import re

import pytest

LONG = "lorem ipsum dolor sit amet " * 40_000


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


#: Null ids and texts, empty, blank and very long texts, ties, repeated rows; columns that clash with results' names.
ODD = [
    (1, "All rights reserved. The quick brown fox jumps over the lazy dog, again and again and again!", "en", "a"),
    (2, "All rights reserved. The quick brown fox jumps over the lazy dog, again and again and again!", "en", "a"),
    (2, "All rights reserved. The quick brown fox jumps over the lazy dog, again and again and again!", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \n\t ", "de", "b"),
    (6, LONG, "en", "a"),
    (7, "ein zwei", "de", None),
    (8, "EIN  zwei", "de", "b"),
    (None, "CC-BY: the GNU General Public License\nund weiter", "de", "b"),
    (9, "x" * 600_000 + " tail", None, "c"),
    (10, "éè \U0001f600 cc by cc by", "fr", "c"),
]


@pytest.fixture
def odd(spark):
    rows = [(*r, 1, "x", 0.5, 7) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, labels string, score double, size long")


@pytest.fixture
def empty(odd):
    return odd.where("false")
