import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, h long, predicted int, matches string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like the operators' own."""
    long = " ".join(f"w{i % 997} and the" for i in range(6000))
    rows = [
        (0, "The cat of the house and the dog.\nIt was on the mat.", "en", "a", 1, 0.5, "r", 1, 0, "m"),
        (1, "The cat of the house and the dog.\nIt was on the mat.", "en", "a", 1, 0.5, "r", 1, 0, "m"),
        (2, None, "en", "a", None, None, None, None, None, None),
        (3, "", None, None, None, None, None, None, None, None),
        (4, long, "en", "b", 1, 0.5, "r", 1, 0, "m"),
        (5, "  \n\t ", "fr", "b", 1, 0.5, "r", 1, 0, "m"),
        (6, "les chats de la maison et le chien", "fr", None, 1, 0.5, "r", 1, 0, "m"),
        (7, "12345 678 !!!", "fr", "a", 1, 0.5, "r", 1, 0, "m"),
        (8, "one two", "en", "a", 1, 0.5, "r", 1, 0, "m"),
        (9, "ONE Two", None, "a", 1, 0.5, "r", 1, 0, "m"),
        (None, "one two", "en", "a", 1, 0.5, "r", 1, 0, "m"),
        (10, "les chats de la maison et le chien", "fr", "c", 1, 0.5, "r", 1, 0, "m"),
        (10, "les chats de la maison et le chien", "fr", "c", 1, 0.5, "r", 1, 0, "m"),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)
