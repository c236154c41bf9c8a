"""Text functions, Column to Column, all inside generated code or built-in higher-order functions.

White space is that of Unicode ((?U)), as Python's split() and strip() have it; lengths are in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that topic comparison leaves out.
STOPWORDS = [
    "the", "and", "for", "that", "this", "with", "you", "are", "was",
    "have", "from", "not", "can", "but", "what", "how", "its", "your",
    "more", "will", "all", "been", "they", "their", "when", "about",
    "which", "there", "also", "has", "had", "would", "could", "should",
    "each", "than", "then", "some", "into", "our", "any", "who", "may",
]

# What counts as a number and as a block of code, the tolerance, the special strings.
NUMBER = r"-?\d+\.?\d*"
CODE_BLOCK = r"(?s)```python\s*(.*?)```"
TOLERANCE = 1e-3
SPECIAL_TOKENS = ["<|beginoftext|>", "<|pad|>", "<|user|>", "<|assistant|>", "<|system|>"]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def split_words(c: Column) -> Column:
    """Words between white space; none for an empty text."""
    bare = strip(c)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"(?U)\s+"))


def preview_words(c: Column, n: int) -> Column:
    w = split_words(c)
    return F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, F.lit("...")).otherwise(F.lit("")))


def simple_words(c: Column) -> Column:
    """Distinct runs of three or more letters a-z of the lower-cased text, without stopwords."""
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOPWORDS]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_f1(prediction: Column, reference: Column) -> Column:
    """F1 of the sets of lower-cased words: 1 if both are empty, 0 if one is."""
    p, r = F.array_distinct(split_words(F.lower(prediction))), F.array_distinct(split_words(F.lower(reference)))
    common = F.size(F.array_intersect(p, r))
    precision, recall = common / F.size(p), common / F.size(r)
    return (
        F.when((F.size(p) == 0) & (F.size(r) == 0), F.lit(1.0))
        .when((F.size(p) == 0) | (F.size(r) == 0) | (common == 0), F.lit(0.0))
        .otherwise(2 * precision * recall / (precision + recall))
    )


def extract_code(c: Column) -> Column:
    """The first fenced Python block, stripped; null if there is none."""
    return F.when(F.regexp_like(c, F.lit(CODE_BLOCK)), strip(F.regexp_extract(c, CODE_BLOCK, 1)))


def last_number(c: Column) -> Column:
    return F.element_at(F.nullif(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)), F.array().cast("array<string>")), -1)


def parse_number(c: Column) -> Column:
    """A number with commas between its digits; null if it is none."""
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def within_tolerance(got: Column, expected: Column) -> Column:
    return F.abs(got - expected) <= TOLERANCE * (F.abs(expected) + 1e-8)


def strip_special(c: Column) -> Column:
    for token in SPECIAL_TOKENS:
        c = F.replace(c, F.lit(token), F.lit(""))
    return strip(c)
