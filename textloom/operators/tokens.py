"""Tokens, role marks and loss masks.

Tokenizers: ``bytes`` (ids are UTF-8 bytes; without loss, no vocabulary) runs inside Spark; ``bpe`` takes a tokenizer file and an Arrow
function. The estimate of four characters to a token is ``functions.messages.estimate_tokens``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.numbers import let

# Ids of the end token and of the five tokens added after it.
EOS, BOS, PAD, USER, ASSISTANT, SYSTEM = 50256, 50257, 50258, 50259, 50260, 50261
ROLES = {"user": USER, "assistant": ASSISTANT, "system": SYSTEM}
INTS = "array<int>"


def bytes_ids(text: Column) -> Column:
    """Ids of the bytes of a text: each byte is read as a character, whose number is the byte."""
    own = F.coalesce(text, F.lit(""))
    letters = F.split(F.decode(F.encode(own, "UTF-8"), "ISO-8859-1"), "")
    return F.when(own == "", F.array().cast(INTS)).otherwise(F.transform(letters, F.ascii))


def bpe_ids(tokenizer_file: str) -> Callable[[Column], Column]:
    """Ids by a tokenizer file, in Arrow batches."""

    @F.pandas_udf(INTS)
    def encode(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        return pd.Series([e.ids for e in tokenizer.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)])

    return encode


def tokenize_text(text: Column, ids: Callable[[Column], Column] = bytes_ids) -> Column:
    """Ids and the end token."""
    return F.concat(ids(text), F.array(F.lit(EOS)))


def role_id(role: Column) -> Column:
    """Null for a role without a token."""
    out = F.lit(None).cast("int")
    for name, i in ROLES.items():
        out = F.when(role == name, F.lit(i)).otherwise(out)
    return out


def conversation_tokens(messages: Column, policy: str = "assistant_only", ids: Callable[[Column], Column] = bytes_ids) -> Column:
    """struct<t, m>, arrays of tokens and loss masks: BOS, then for each message its role token (if it has one) and content, then EOS.

    ``assistant_only`` trains the content of assistants, their role tokens, the user token that follows an assistant, and an EOS
    after one; ``all`` trains everything but BOS. A missing role is user, missing content empty.
    """
    role = lambda m: F.coalesce(m.role, F.lit("user"))
    every = policy == "all"
    none = F.array().cast(INTS)

    def part(m: Column, i: Column) -> Column:
        before = F.when(i > 0, role(F.get(messages, i - 1)))
        own = F.lit(1) if every else F.when((role(m) == "assistant") | ((role(m) == "user") & F.coalesce(before == "assistant", F.lit(False))), 1).otherwise(0)
        trained = F.lit(1) if every else F.when(role(m) == "assistant", 1).otherwise(0)
        known = role_id(role(m)).isNotNull()
        mark, marked = (F.when(known, F.array(x)).otherwise(none) for x in (role_id(role(m)), own))
        return let(ids(m.content), lambda x: F.struct(F.concat(mark, x).alias("t"), F.concat(marked, F.array_repeat(trained, F.size(x))).alias("m")))

    last = role(F.get(messages, F.size(messages) - 1))
    end = F.lit(1) if every else F.when(last == "assistant", 1).otherwise(0)
    all_ = lambda parts, c: F.flatten(F.transform(parts, lambda p: p[c]))
    whole = lambda parts: F.struct(F.concat(F.array(F.lit(BOS)), all_(parts, "t"), F.array(F.lit(EOS))).alias("t"), F.concat(F.array(F.lit(0)), all_(parts, "m"), F.array(end)).alias("m"))
    return let(F.transform(messages, part), whole)


def tokenize_conversation(messages: Column, policy: str = "assistant_only", ids: Callable[[Column], Column] = bytes_ids) -> Column:
    """``conversation_tokens`` as an array of struct<t, m>."""
    return let(conversation_tokens(messages, policy, ids), lambda s: F.zip_with(s.t, s.m, lambda t, m: F.struct(t.alias("t"), m.alias("m"))))


def prompt_ids(question: Column, ids: Callable[[Column], Column] = bytes_ids) -> Column:
    return F.concat(F.array(F.lit(BOS), F.lit(USER)), ids(question), F.array(F.lit(ASSISTANT)))


def encode_chat(messages: Column, ids: Callable[[Column], Column] = bytes_ids) -> Column:
    """A conversation without its end, ready for the assistant's turn."""
    return let(conversation_tokens(messages, ids=ids).t, lambda t: F.concat(F.slice(t, F.lit(1), F.size(t) - 1), F.array(F.lit(ASSISTANT))))


def pad_to(a: Column, size: int, fill: int) -> Column:
    """Cut or filled to ``size``."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(fill), size)), 1, size)


def truncate_at(a: Column, stop: int, keep_stop: bool = False) -> Column:
    """What stands before the first ``stop`` token."""
    at = F.array_position(a, F.lit(stop)).cast("int")
    return F.when(at == 0, a).otherwise(F.slice(a, F.lit(1), at if keep_stop else at - 1))


def crop_left(a: Column, size: int, start: Column, end: Column) -> Column:
    """struct<tokens, start, end>: the last ``size`` tokens, with the span moved along (start may fall below 0)."""
    over = F.greatest(F.size(a) - size, F.lit(0))
    return F.struct(F.slice(a, over + 1, F.lit(size)).alias("tokens"), (start - over).cast("long").alias("start"), (end - over).cast("long").alias("end"))


def truncated(a: Column, size: int = 2048) -> Column:
    """The first ``size`` ids of a document."""
    return F.slice(a, 1, size)


def pad_to_longest(df: DataFrame, batch: str, ids: str, fill: int = PAD) -> DataFrame:
    """Adds width, the longest of the batch, and fills ``ids`` on the right to it."""
    width = df.groupBy(batch).agg(F.max(F.size(ids)).alias("width"))
    gap = F.array_repeat(F.lit(fill), F.col("width") - F.size(ids))
    return df.join(width, batch).withColumn(ids, F.concat(ids, gap))
