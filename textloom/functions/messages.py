"""Functions on conversations: arrays of struct<role, content>, as Column to Column with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import strip

MESSAGES = "array<struct<role:string,content:string>>"
# Fixed value: turns of a dialogue in one text.
DIALOGUE = r"(?s)\n\n(Human|Assistant): (.*?)(?=\n\n(?:Human|Assistant): |$)"


def message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def nest(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation with its messages in order."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return turns.groupBy(key).agg(F.transform(rows, lambda m: message(m.role, m.content)).alias("messages"))


def unnest(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    return conversations.select(key, F.posexplode("messages").alias("turn", "m")).select(key, F.col("turn").cast("long").alias("turn"), "m.role", "m.content")


def of_role(m: Column, role: str) -> Column:
    return F.filter(m, lambda x: x.role == role)


def alternate_roles(turns: Column) -> Column:
    """Texts to messages of user and assistant by turns."""
    return F.transform(turns, lambda t, i: message(F.when(i % 2 == 0, "user").otherwise("assistant"), t))


def parse_dialogue(text: Column) -> Column:
    """Messages of a text with "Human:" and "Assistant:" paragraphs; those without content are left out."""
    roles = F.regexp_extract_all(text, F.lit(DIALOGUE), F.lit(1))
    contents = F.regexp_extract_all(text, F.lit(DIALOGUE), F.lit(2))
    both = F.zip_with(roles, contents, lambda r, c: message(F.when(r == "Human", "user").otherwise("assistant"), strip(c)))
    return F.filter(both, lambda m: m.content != "")


def render_dialogue(m: Column) -> Column:
    return F.array_join(F.transform(m, lambda x: F.concat(F.lit("\n\n"), F.when(x.role == "user", "Human").otherwise("Assistant"), F.lit(": "), x.content)), "")


def strip_trailing_user(m: Column) -> Column:
    """Without a last message that is an empty one of the user."""
    last = F.get(m, F.size(m) - 1)
    return F.when((last.role == "user") & (last.content == ""), F.slice(m, F.lit(1), F.size(m) - 1)).otherwise(m)


def append_empty_user(m: Column) -> Column:
    return F.concat(m, F.array(message(F.lit("user"), F.lit(""))))


def ua_pairs(m: Column) -> Column:
    """Pairs (user, assistant) at even places once system messages are out; a pair out of step is skipped."""
    own = F.filter(m, lambda x: x.role != "system")
    at = F.when(F.size(own) < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.size(own) - 2, F.lit(0)), F.lit(2)))
    pairs = F.transform(at, lambda i: F.struct(F.get(own, i).alias("user"), F.get(own, i + 1).alias("assistant")))
    return F.filter(pairs, lambda p: (p.user.role == "user") & (p.assistant.role == "assistant"))


def last_user(m: Column) -> Column:
    own = of_role(m, "user")
    return F.get(own, F.size(own) - 1).content


def first_system(m: Column, default: str) -> Column:
    return F.coalesce(F.get(of_role(m, "system"), 0).content, F.lit(default))


def last_assistant(m: Column) -> Column:
    own = of_role(m, "assistant")
    return F.coalesce(F.get(own, F.size(own) - 1).content, F.lit(""))


def total_chars(m: Column) -> Column:
    return F.aggregate(m, F.lit(0), lambda a, x: a + F.length(x.content)).cast("long")


def n_turns(m: Column) -> Column:
    return F.size(of_role(m, "assistant")).cast("long")


def estimate_tokens(m: Column) -> Column:
    """Four characters to a token, one token for each role and two for the ends."""
    return F.aggregate(m, F.lit(2).cast("long"), lambda a, x: a + F.greatest(F.lit(1), F.floor(F.length(x.content) / 4)) + 1)


def common_prefix(a: Column, b: Column) -> Column:
    """Number of equal leading elements."""
    n = F.least(F.size(a), F.size(b))
    equal = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    first = F.array_position(equal, F.lit(False))
    return F.when(first == 0, n).otherwise(first - 1).cast("long")


def common_length(seqs: Column, from_right: bool = False) -> Column:
    """Equal leading (or trailing) elements of all arrays of an array."""
    own = F.transform(seqs, F.reverse) if from_right else seqs
    base = F.get(own, 0)
    return F.aggregate(own, F.size(base).cast("long"), lambda acc, s: F.least(acc, common_prefix(base, s)))


def reject_reason(conversation: Column) -> Column:
    """Why a raw conversation (struct of system and messages, an array of [code, text]) isn't valid; null if it is."""
    m = conversation.messages
    code = lambda x: F.get(x, 0)
    n = F.size(m)
    pairs = F.zip_with(F.slice(m, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(m, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: code(a) == code(b))
    return (
        F.when(m.isNull() | (n < 1), "no messages")
        .when(~F.forall(m, lambda x: x.isNotNull() & (F.size(x) == 2) & F.coalesce(code(x).isin("u", "a"), F.lit(False))), "bad item")
        .when(F.exists(pairs, lambda same: same), "roles repeat")
        .when(code(F.get(m, 0)) != "u", "first is no user")
        .when(code(F.get(m, n - 1)) != "a", "last is no assistant")
    )


def from_raw(conversation: Column) -> Column:
    """Messages of a valid raw conversation, the stripped system text first if there is one."""
    system = strip(F.coalesce(conversation.system, F.lit("")))
    own = F.transform(conversation.messages, lambda x: message(F.when(F.get(x, 0) == "u", "user").otherwise("assistant"), F.coalesce(F.get(x, 1), F.lit("None"))))
    return F.when(system != "", F.concat(F.array(message(F.lit("system"), system)), own)).otherwise(own)
