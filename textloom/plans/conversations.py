"""Queries on conversations, texts, tokens and chunks."""

from pyspark.sql import functions as F

from textloom.functions import formats, text
from textloom.functions import messages as M
from textloom.operators import packing, preference, profile, tokens
from textloom.plans.registry import CHATS, chats, query, table
from textloom.sources import readers

STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
WORDS = f"list_distinct(list_filter(regexp_extract_all(lower({{0}}), '[a-z]{{{{3,}}}}'), lambda w: w NOT IN ({STOP})))"
SIZE = 257


def joined(a, sep=","):
    return F.array_join(F.transform(a, lambda x: x.cast("string")), sep)


def shown(m):
    return F.array_join(F.transform(m, lambda x: F.concat(x.role, F.lit(":"), x.content)), "|")


SHOWN = "array_to_string(list_transform({0}, lambda x: x.role || ':' || x.content), '|')"
USERS = "list_filter(m, lambda x: x.role = 'user')"
ASSISTANTS = "list_filter(m, lambda x: x.role = 'assistant')"


@query(f"WITH {CHATS} SELECT conv_id, string_agg(CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || m[i].content, '|' ORDER BY i) AS chat FROM (SELECT conv_id, m, unnest(range(1, len(m) + 1)) AS i FROM c) GROUP BY conv_id")
def alternate_roles(spark, sf_dir):
    return chats(spark, sf_dir).select("conv_id", shown(M.alternate_roles(F.transform("messages", lambda x: x.content))).alias("chat"))


PARSED = f"list_transform(list_filter(m, lambda x: {STRIP.format('x.content')} <> ''), lambda x: {{'role': CASE WHEN x.role = 'user' THEN 'user' ELSE 'assistant' END, 'content': {STRIP.format('x.content')}}})"


@query(f"WITH {CHATS} SELECT conv_id, CAST(len(p) AS BIGINT) AS n, {SHOWN.format('p')} AS chat FROM (SELECT conv_id, {PARSED} AS p FROM c)")
def parse_dialogue(spark, sf_dir):
    own = chats(spark, sf_dir).select("conv_id", M.parse_dialogue(M.render_dialogue(F.col("messages"))).alias("p"))
    return own.select("conv_id", F.size("p").cast("long").alias("n"), shown(F.col("p")).alias("chat"))


@query(f"WITH {CHATS} SELECT conv_id, CAST(len(m) AS BIGINT) AS n, m[len(m)].role AS last_role FROM c")
def strip_trailing_user(spark, sf_dir):
    own = chats(spark, sf_dir).withColumn("m", F.when(F.pmod("conv_id", F.lit(2)) == 0, M.append_empty_user(F.col("messages"))).otherwise(F.col("messages")))
    own = own.select("conv_id", M.strip_trailing_user(F.col("m")).alias("m"))
    return own.select("conv_id", F.size("m").cast("long").alias("n"), F.get("m", F.size("m") - 1).role.alias("last_role"))


UA = """p AS (SELECT conv_id, o, i FROM (SELECT conv_id, o, unnest(range(1, len(o), 2)) AS i FROM (SELECT conv_id, list_filter(m, lambda x: x.role <> 'system') AS o FROM c))
  WHERE o[i].role = 'user' AND o[i + 1].role = 'assistant')"""


@query(f"WITH {CHATS}, {UA} SELECT c.conv_id AS conv_id, count(i) AS n, CAST(coalesce(sum(length(o[i].content)), 0) AS BIGINT) AS user_chars, CAST(coalesce(sum(length(o[i + 1].content)), 0) AS BIGINT) AS assistant_chars FROM c LEFT JOIN p ON c.conv_id = p.conv_id GROUP BY 1")
def ua_pairs(spark, sf_dir):
    own = chats(spark, sf_dir).select("conv_id", M.ua_pairs(F.col("messages")).alias("p"))
    chars = lambda side: F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.length(x[side].content))
    return own.select("conv_id", F.size("p").cast("long").alias("n"), chars("user").alias("user_chars"), chars("assistant").alias("assistant_chars"))


@query(f"WITH {CHATS} SELECT conv_id, u[len(u)].content AS question, coalesce(list_filter(m, lambda x: x.role = 'system')[1].content, 'none') AS system FROM (SELECT *, {USERS} AS u FROM c)")
def last_user(spark, sf_dir):
    return chats(spark, sf_dir).select("conv_id", M.last_user(F.col("messages")).alias("question"), M.first_system(F.col("messages"), "none").alias("system"))


@query(f"WITH {CHATS} SELECT conv_id, coalesce(a[len(a)].content, '') AS answer FROM (SELECT *, {ASSISTANTS} AS a FROM c)")
def last_assistant(spark, sf_dir):
    return chats(spark, sf_dir).select("conv_id", M.last_assistant(F.col("messages")).alias("answer"))


RAW = f"""WITH {CHATS}, r AS (SELECT conv_id, coalesce(list_filter(m, lambda x: x.role = 'system')[1].content, '') AS system,
    list_transform(list_filter(m, lambda x: x.role <> 'system'), lambda x, i: {{'code': CASE WHEN conv_id % 7 = 3 AND i = 2 THEN 'z' WHEN conv_id % 7 = 4 THEN 'u' WHEN x.role = 'user' THEN 'u' ELSE 'a' END, 'text': x.content}}) AS m FROM c),
  v AS (SELECT *, CASE WHEN len(m) = 0 THEN 'no messages'
    WHEN len(list_filter(m, lambda x: x.code NOT IN ('u', 'a'))) > 0 THEN 'bad item'
    WHEN len(list_filter(m[2:], lambda x, i: x.code = m[i].code)) > 0 THEN 'roles repeat'
    WHEN m[1].code <> 'u' THEN 'first is no user'
    WHEN m[len(m)].code <> 'a' THEN 'last is no assistant' END AS reason FROM r)
"""


def raw_json(spark, sf_dir):
    own = F.filter("messages", lambda x: x.role != "system")
    code = lambda x, i: F.when((F.pmod("conv_id", F.lit(7)) == 3) & (i == 1), "z").when(F.pmod("conv_id", F.lit(7)) == 4, "u").when(x.role == "user", "u").otherwise("a")
    items = F.transform(own, lambda x, i: F.array(code(x, i), x.content))
    raw = F.struct(F.get(M.of_role(F.col("messages"), "system"), 0).content.alias("system"), items.alias("messages"))
    return chats(spark, sf_dir).select("conv_id", F.to_json(F.array(raw)).alias("value"))


@query(RAW + "SELECT conv_id, reason AS reject_reason FROM v")
def validate_conversations(spark, sf_dir):
    return readers.ingest_custom(raw_json(spark, sf_dir)).select("conv_id", "reject_reason")


@query(
    RAW
    + f"""SELECT conv_id, 'custom' AS source, CAST(len(m) + CASE WHEN {STRIP.format('system')} <> '' THEN 1 ELSE 0 END AS BIGINT) AS n,
  CASE WHEN {STRIP.format('system')} <> '' THEN 'system' ELSE 'user' END AS first_role FROM v WHERE reason IS NULL"""
)
def ingest_validate(spark, sf_dir):
    own = readers.ingest_custom(raw_json(spark, sf_dir)).where("reject_reason is null")
    return own.select("conv_id", "source", F.size("messages").cast("long").alias("n"), F.get("messages", 0).role.alias("first_role"))


@query("SELECT conv_id, CAST(sum(greatest(1, length(text) // 4) + 1) + 2 AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def estimate_tokens(spark, sf_dir):
    return chats(spark, sf_dir).select("conv_id", M.estimate_tokens(F.col("messages")).alias("tokens"))


@query("SELECT item_id, 'user:' || text || '|assistant:' || substr(text, 1, 20) || '|user:' AS chat FROM benchmark")
def fmt_qa(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", shown(formats.question_answer(F.col("text"), F.substring("text", 1, 20))).alias("chat"))


@query("SELECT item_id, 'user:' || text || '|assistant:' || text || 'x' AS chat, 'f' || item_id AS entry_point FROM benchmark")
def fmt_code_completion(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", shown(formats.code_completion(F.col("text"), F.lit("x"))).alias("chat"), F.concat(F.lit("f"), "item_id").alias("entry_point"))


@query("SELECT text, 'mbpp' AS source FROM benchmark")
def fmt_mbpp(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("text", F.lit("mbpp").alias("source"))


@query(
    """SELECT p_partkey, 'user:Multiple Choice question: ' || p_name || chr(10) || '- ' || p_brand || '=A' || chr(10) || '- ' || p_type || '=B' || chr(10) || '- none=C'
    || '|assistant:' || ['A', 'B', 'C'][1 + p_partkey % 3] || '|user:' AS chat FROM part"""
)
def fmt_multiple_choice(spark, sf_dir):
    k = F.pmod("p_partkey", F.lit(3)).cast("int")
    answer = F.when(F.pmod("p_partkey", F.lit(2)) == 0, k.cast("string")).otherwise(F.get(F.array(F.lit("A"), F.lit("B"), F.lit("C")), k))
    choices = F.array("p_brand", "p_type", F.lit("none"))
    return table(spark, sf_dir, "part").select("p_partkey", shown(formats.multiple_choice(F.col("p_name"), choices, answer)).alias("chat"))


@query(
    """SELECT item_id, 'Complete the following Python function. Answer with a Python code block.' || chr(10) || chr(10) || '```python' || chr(10) || text || chr(10) || '```' AS question,
    text AS test_prefix, 'assert f(1)' || chr(10) || 'check(f)' AS test_suffix,
    text || chr(10) || chr(10) || 'Answer with a Python code block. It has to pass:' || chr(10) || 'assert a' || chr(10) || 'assert b' AS problem FROM benchmark"""
)
def fmt_rl_prompt(spark, sf_dir):
    own = table(spark, sf_dir, "benchmark").select("item_id", formats.completion_prompt(F.col("text"), F.lit("f"), F.lit("assert f(1)")).alias("p"), formats.problem_prompt(F.col("text"), F.array(F.lit("assert a"), F.lit("assert b"))).alias("q"))
    return own.select("item_id", "p.question", "p.test_prefix", "p.test_suffix", F.col("q.question").alias("problem"))


@query(f"SELECT doc_id, array_to_string(w[1:7], ' ') || CASE WHEN len(w) > 7 THEN '...' ELSE '' END AS preview FROM (SELECT doc_id, regexp_split_to_array({STRIP.format('text')}, '\\s+') AS w FROM documents)")
def preview_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview_words(F.col("text"), 7).alias("preview"))


FENCED = "CASE WHEN doc_id % 3 = 0 THEN 'no code ' || doc_id || ' and 1.5' ELSE 'so' || chr(10) || '```python' || chr(10) || '  print(' || doc_id || ')' || chr(10) || '```' || ' then ```python x```' END"


def fenced():
    block = F.concat(F.lit("so\n```python\n  print("), "doc_id", F.lit(")\n```"), F.lit(" then ```python x```"))
    return F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("no code "), "doc_id", F.lit(" and 1.5"))).otherwise(block)


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'print(' || doc_id || ')' END AS code FROM documents")
def extract_code(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.extract_code(fenced()).alias("code"))


@query("SELECT doc_id, n[len(n)] AS number FROM (SELECT doc_id, regexp_extract_all(text, '-?[0-9]+\\.?[0-9]*') AS n FROM documents)")
def last_number(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.last_number(F.col("text")).alias("number"))


LENGTHS = "list_transform(string_split(text, ' '), lambda w: length(w))"


def lengths(c="text"):
    return F.transform(F.split(c, " "), lambda w: F.length(w))


@query(
    f"SELECT doc_id, CASE WHEN p IS NULL THEN len(t) ELSE p - 1 END AS before, CASE WHEN p IS NULL THEN len(t) ELSE p END AS through FROM (SELECT doc_id, t, nullif(list_position(t, 9), 0) AS p FROM (SELECT doc_id, {LENGTHS} AS t FROM documents))"
)
def truncate_eos(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", lengths().alias("t"))
    return own.select("doc_id", F.size(tokens.truncate_at(F.col("t"), 9)).cast("long").alias("before"), F.size(tokens.truncate_at(F.col("t"), 9, True)).cast("long").alias("through"))


@query("SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS n, array_to_string(list_sort(w), ' ') AS words FROM (SELECT conv_id, turn, " + WORDS.format("text").replace("{{", "{").replace("}}", "}") + " AS w FROM conversations WHERE role = 'user')")
def simple_words(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", text.simple_words(F.col("text")).alias("w"))
    return own.select("conv_id", "turn", F.size("w").cast("long").alias("n"), F.array_join(F.array_sort("w"), " ").alias("words"))


JACCARD = f"""u AS (SELECT conv_id, turn, {WORDS.format('text').replace('{{', '{').replace('}}', '}')} AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS users FROM conversations WHERE role = 'user'),
  j AS (SELECT a.conv_id AS conv_id, a.users AS users, b.k - 1 AS place, CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 1.0::DOUBLE
    ELSE len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) END AS s FROM u a JOIN u b ON a.conv_id = b.conv_id WHERE a.k = 1 AND b.k > 1)"""


@query(f"WITH {JACCARD} SELECT conv_id, place, round(s, 6) AS similarity FROM j")
def topic_jaccard(spark, sf_dir):
    own = chats(spark, sf_dir).select("conv_id", F.posexplode(profile.topic_jaccard(F.col("messages"))).alias("place", "s"))
    return own.select("conv_id", (F.col("place") + 1).cast("long").alias("place"), F.round("s", 6).alias("similarity"))


@query(
    f"""WITH {CHATS}, {JACCARD}, t AS (SELECT conv_id, any_value(users) AS users, sum(s) AS total, count(*) AS n, max(CASE WHEN s < 0.05 THEN 1 ELSE 0 END) AS switched FROM j GROUP BY conv_id)
    SELECT source, count(*) AS n, round(sum(total) / sum(t.n), 6) AS mean_jaccard, round(avg(switched), 6) AS switch_share, round(avg(users), 6) AS mean_user_turns FROM t JOIN c ON t.conv_id = c.conv_id GROUP BY source"""
)
def topic_switch_stats(spark, sf_dir):
    own = profile.topic_switches(chats(spark, sf_dir))
    return own.select("source", "n", *[F.round(c, 6).alias(c) for c in ("mean_jaccard", "switch_share", "mean_user_turns")])


TURNS = f"WITH {CHATS}, t AS (SELECT CAST(len({ASSISTANTS}) AS BIGINT) AS t FROM c) "


@query(
    TURNS
    + """SELECT count(*) AS n, round(avg(t), 6) AS mean, CAST(median(t) AS DOUBLE) AS median, max(t) AS max, count(*) FILTER (t = 1) / count(*) AS share_1, count(*) FILTER (t = 2) / count(*) AS share_2,
    count(*) FILTER (t IN (3, 4)) / count(*) AS share_3_4, count(*) FILTER (t >= 5) / count(*) AS share_5_up, count(*) FILTER (t >= 3) / count(*) AS share_3_up FROM t"""
)
def turn_distribution(spark, sf_dir):
    return profile.turn_distribution(chats(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query(
    TURNS
    + """, b AS (SELECT CASE WHEN t <= 1 THEN '1' WHEN t = 2 THEN '2' WHEN t <= 4 THEN '3-4' WHEN t <= 9 THEN '5-9' ELSE '10+' END AS bucket, count(*) AS n FROM t GROUP BY 1)
    SELECT bucket, n, CAST(greatest(1, round_even(n / (SELECT sum(n) FROM b) * 20, 0)) AS BIGINT) AS bar FROM b"""
)
def turn_histogram(spark, sf_dir):
    return profile.turn_histogram(chats(spark, sf_dir))


@query(
    """WITH l AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
    w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS p, list_distinct(list_filter(regexp_split_to_array(lower(before), '\\s+'), lambda x: x <> '')) AS r FROM l WHERE before IS NOT NULL),
    k AS (SELECT conv_id, turn, len(p) AS np, len(r) AS nr, len(list_intersect(p, r)) AS n FROM w)
    SELECT conv_id, turn, round(CASE WHEN np = 0 AND nr = 0 THEN 1.0 WHEN n = 0 THEN 0.0 ELSE 2.0::DOUBLE * n / (np + nr) END, 6) AS f1 FROM k"""
)
def token_f1(spark, sf_dir):
    own = chats(spark, sf_dir).select("conv_id", F.posexplode("messages").alias("turn", "m"), "messages").where("turn > 0")
    return own.select("conv_id", F.col("turn").cast("long").alias("turn"), F.round(text.token_f1(F.col("m.content"), F.get("messages", F.col("turn") - 1).content), 6).alias("f1"))


PREFIXES = f"""WITH {CHATS}, s AS (SELECT conv_id, list_transform(m, lambda x: list_transform(string_split(x.content, ' '), lambda w: length(w))) AS seqs FROM c),
  p AS (SELECT conv_id, seqs, list_min(list_transform(seqs, lambda t: len(t))) AS least FROM s)
  SELECT conv_id, """
PREFIX = "CAST(coalesce(list_min(list_filter(range(0, least), lambda i: len(list_filter(seqs, lambda t: t[{0}] <> seqs[1][{1}])) > 0)), least) AS BIGINT)"


def sequences(spark, sf_dir):
    return chats(spark, sf_dir).select("conv_id", F.transform("messages", lambda x: F.transform(F.split(x.content, " "), lambda w: F.length(w))).alias("seqs"))


@query(PREFIXES + PREFIX.format("i + 1", "i + 1") + " AS prefix, " + PREFIX.format("len(t) - i", "len(seqs[1]) - i") + " AS suffix FROM p")
def common_prefix(spark, sf_dir):
    return sequences(spark, sf_dir).select("conv_id", M.common_length(F.col("seqs")).alias("prefix"), M.common_length(F.col("seqs"), True).alias("suffix"))


def pairs(spark, sf_dir):
    """Chosen: a conversation. Rejected: the same with its last message cut to half and, for odd ones, another turn."""
    n = F.size("messages")
    last = F.get("messages", n - 1)
    short = M.message(last.role, F.substring(last.content, F.lit(1), F.floor(F.length(last.content) / 2).cast("int")))
    more = F.when(F.pmod("conv_id", F.lit(2)) == 1, F.array(M.message(F.lit("assistant"), F.lit("Sorry.")))).otherwise(F.array().cast(M.MESSAGES))
    return chats(spark, sf_dir).select("conv_id", F.col("messages").alias("chosen"), F.concat(F.slice("messages", F.lit(1), n - 1), F.array(short), more).alias("rejected"), "source")


PAIRS = f"""WITH {CHATS}, p AS (SELECT conv_id, source, m AS chosen, list_concat(m[:len(m) - 1], [{{'role': m[len(m)].role, 'content': substr(m[len(m)].content, 1, length(m[len(m)].content) // 2)}}],
  CASE WHEN conv_id % 2 = 1 THEN [{{'role': 'assistant', 'content': 'Sorry.'}}] ELSE [] END) AS rejected FROM c)
"""


@query(PAIRS + "SELECT conv_id, CAST(len(chosen) - 1 AS BIGINT) AS shared, CAST(1 AS BIGINT) AS chosen_rest, CAST(len(rejected) - len(chosen) + 1 AS BIGINT) AS rejected_rest FROM p")
def pref_shared_prefix(spark, sf_dir):
    own = pairs(spark, sf_dir).select("conv_id", preference.shared_prefix(F.col("chosen"), F.col("rejected")).alias("s"))
    return own.select("conv_id", F.size("s.prefix").cast("long").alias("shared"), F.size("s.chosen_rest").cast("long").alias("chosen_rest"), F.size("s.rejected_rest").cast("long").alias("rejected_rest"))


def _stats(measure, c, r):
    return f"""SELECT '{measure}' AS measure, count(*) AS n, round(avg({c}), 6) AS chosen_mean, CAST(median({c}) AS DOUBLE) AS chosen_median, round(avg({r}), 6) AS rejected_mean, CAST(median({r}) AS DOUBLE) AS rejected_median,
    round(avg({c} - {r}), 6) AS diff_mean, CAST(median({c} - {r}) AS DOUBLE) AS diff_median, CAST(min({c} - {r}) AS BIGINT) AS diff_min, CAST(max({c} - {r}) AS BIGINT) AS diff_max FROM q"""


@query(
    PAIRS
    + ", q AS (SELECT list_sum(list_transform(chosen, lambda x: length(x.content))) AS cc, list_sum(list_transform(rejected, lambda x: length(x.content))) AS rc, len(list_filter(chosen, lambda x: x.role = 'assistant')) AS ct, len(list_filter(rejected, lambda x: x.role = 'assistant')) AS rt FROM p) "
    + _stats("chars", "cc", "rc")
    + " UNION ALL "
    + _stats("turns", "ct", "rt")
)
def pref_stats(spark, sf_dir):
    own = profile.preference_stats(pairs(spark, sf_dir))
    return own.withColumns({c: F.round(c, 6) for c in ("chosen_mean", "rejected_mean", "diff_mean")})


@query(
    PAIRS
    + f""", d AS (SELECT conv_id, {PARSED.replace('(m,', '(chosen,')} AS chosen, {PARSED.replace('(m,', '(rejected,')} AS rejected FROM p)
    SELECT conv_id, 'hh' AS source, {SHOWN.format('chosen')} AS chosen, {SHOWN.format('rejected')} AS rejected FROM d WHERE len(chosen) > 0 AND len(rejected) > 0"""
)
def build_pref_pairs(spark, sf_dir):
    own = pairs(spark, sf_dir).select("conv_id", M.render_dialogue(F.col("chosen")).alias("chosen"), M.render_dialogue(F.col("rejected")).alias("rejected"))
    return preference.from_dialogues(own, "hh").select("conv_id", "source", shown(F.col("chosen")).alias("chosen"), shown(F.col("rejected")).alias("rejected"))


# ------------------------------------------------------------------ tokens


@query("SELECT item_id, strlen(text) + 1 AS n, 50256 AS last FROM benchmark")
def tokenize_text(spark, sf_dir):
    own = table(spark, sf_dir, "benchmark").select("item_id", tokens.tokenize_text(F.col("text")).alias("t"))
    return own.select("item_id", F.size("t").cast("long").alias("n"), F.element_at("t", -1).alias("last"))


@query(
    """WITH t AS (SELECT conv_id, turn, role, strlen(text) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
    SELECT conv_id, CAST(sum(n + 1) + 2 AS BIGINT) AS n_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN n + 1 WHEN role = 'user' AND before = 'assistant' THEN 1 ELSE 0 END)
      + CASE WHEN arg_max(role, turn) = 'assistant' THEN 1 ELSE 0 END AS BIGINT) AS n_trained, CAST(sum(n + 1) + 1 AS BIGINT) AS n_trained_all FROM t GROUP BY conv_id"""
)
def conv_mask_counts(spark, sf_dir):
    own = chats(spark, sf_dir).select("conv_id", tokens.conversation_tokens(F.col("messages")).alias("p"), tokens.conversation_tokens(F.col("messages"), "all").alias("q"))
    count = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return own.select("conv_id", F.size("p.t").cast("long").alias("n_tokens"), count("p.m").alias("n_trained"), count("q.m").alias("n_trained_all"))


@query(f"SELECT doc_id, 64 - least(64, len(t)) AS n_pad, CAST(list_sum(t[1:64]) AS BIGINT) AS total FROM (SELECT doc_id, {LENGTHS} AS t FROM documents)")
def pref_pad(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", tokens.pad_to(lengths(), 64, -1).alias("t"))
    total = F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + F.greatest(x, F.lit(0)))
    return own.select("doc_id", F.size(F.filter("t", lambda x: x == -1)).cast("long").alias("n_pad"), total.alias("total"))


@query(
    """WITH t AS (SELECT conv_id, turn, role, strlen(text) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
    s AS (SELECT conv_id, CAST(sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn) - n AS BIGINT) AS p, role, before FROM t)
    SELECT conv_id, min(CASE WHEN role = 'assistant' OR (role = 'user' AND before = 'assistant') THEN p END) + 1 AS first_trained, CAST(1 AS BIGINT) AS n_bos, bool_or(role = 'user') AS has_user
    FROM s GROUP BY conv_id HAVING bool_or(role = 'assistant')"""
)
def chunk_context_check(spark, sf_dir):
    own = chats(spark, sf_dir).select("conv_id", tokens.conversation_tokens(F.col("messages")).alias("p"))
    own = own.select("conv_id", F.col("p.t").alias("t"), F.array_position("p.m", F.lit(1)).alias("first_trained"))
    return own.where("first_trained > 0").select("conv_id", "first_trained", F.size(F.filter("t", lambda x: x == tokens.BOS)).cast("long").alias("n_bos"), F.array_contains("t", tokens.USER).alias("has_user"))


def word_rows(spark, sf_dir):
    """Word lengths as tokens; one in five is trained."""
    t = lengths()
    return table(spark, sf_dir, "documents").select("doc_id", "source", t.alias("t"), F.transform(t, lambda x, i: F.when(i % 5 == 0, 1).otherwise(0)).alias("m"))


STREAM = f"""WITH d AS (SELECT doc_id, {LENGTHS} AS t FROM documents), f AS (SELECT doc_id, i, t[i + 1] AS t, CASE WHEN i % 5 = 0 THEN 1 ELSE 0 END AS m FROM (SELECT doc_id, t, unnest(range(0, len(t))) AS i FROM d)),
  k AS (SELECT t, m, row_number() OVER (ORDER BY doc_id, i) - 1 AS r FROM f), """


@query(
    STREAM
    + f"""g AS (SELECT r // {SIZE} AS chunk, r % {SIZE} AS o, t, m FROM k)
    SELECT chunk, count(*) - 1 AS n, CAST(sum(t) FILTER (o < {SIZE - 1}) AS BIGINT) AS inputs, CAST(sum(t) FILTER (o > 0) AS BIGINT) AS labels, CAST(sum(m) FILTER (o > 0) AS BIGINT) AS trained FROM g GROUP BY chunk HAVING count(*) = {SIZE}"""
)
def pack_linear(spark, sf_dir):
    c = packing.linear_chunks(word_rows(spark, sf_dir), ["t", "m"], ["doc_id"], SIZE)
    ids, labels, mask = packing.shifted(F.col("t"), F.col("m"))
    own = c.select("chunk", ids, labels, mask)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return own.select("chunk", F.size("labels").cast("long").alias("n"), total("input_ids").alias("inputs"), total("labels").alias("labels"), total("loss_mask").alias("trained"))


@query(STREAM + f"g AS (SELECT r // {SIZE} AS chunk, r % {SIZE} AS o, t FROM k) SELECT chunk, 50257 AS first, CAST(sum(t) FILTER (o < {SIZE - 1}) AS BIGINT) AS rest FROM g GROUP BY chunk HAVING count(*) = {SIZE}")
def pack_linear_bos(spark, sf_dir):
    c = packing.linear_chunks(word_rows(spark, sf_dir), "t", ["doc_id"], SIZE).select("chunk", packing.with_bos(F.col("tokens"), tokens.BOS).alias("t"))
    return c.select("chunk", F.get("t", 0).alias("first"), (F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x) - tokens.BOS).alias("rest"))


@query(
    STREAM
    + "g AS (SELECT r // 1025 AS chunk, r % 1025 AS o, t FROM k), w AS (SELECT chunk FROM g GROUP BY chunk HAVING count(*) = 1025) SELECT chunk, o // 256 AS row, CAST(sum(t) AS BIGINT) AS inputs FROM g WHERE chunk IN (SELECT chunk FROM w) AND o < 1024 GROUP BY 1, 2"
)
def pack_batch(spark, sf_dir):
    c = packing.linear_chunks(word_rows(spark, sf_dir), "t", ["doc_id"], 4 * 256 + 1)
    rows = c.select("chunk", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("tokens", i * 256 + 1, F.lit(256)))).alias("row", "t"))
    return rows.select("chunk", F.col("row").cast("long").alias("row"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x).alias("inputs"))


ALIGNED = """WITH RECURSIVE d AS (SELECT doc_id // 500 AS stream, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) AS k, least({size}, {length}) AS n FROM documents),
  f AS (SELECT stream, k, n, CASE WHEN n = {size} THEN 0 ELSE n END AS used, CAST(0 AS BIGINT) AS chunk, CAST(CASE WHEN n = {size} THEN 1 ELSE 0 END AS BIGINT) AS next FROM d WHERE k = 1
    UNION ALL SELECT d.stream, d.k, d.n,
      CASE WHEN CASE WHEN f.used > 0 AND f.used + d.n > {size} THEN d.n ELSE f.used + d.n END = {size} THEN 0 WHEN f.used > 0 AND f.used + d.n > {size} THEN d.n ELSE f.used + d.n END,
      CASE WHEN f.used > 0 AND f.used + d.n > {size} THEN f.next + 1 ELSE f.next END,
      CASE WHEN f.used > 0 AND f.used + d.n > {size} THEN f.next + 1 ELSE f.next END + CASE WHEN CASE WHEN f.used > 0 AND f.used + d.n > {size} THEN d.n ELSE f.used + d.n END = {size} THEN 1 ELSE 0 END
    FROM f JOIN d ON d.stream = f.stream AND d.k = f.k + 1)
"""
WORD_COUNT = "len(string_split(text, ' '))"


@query(
    ALIGNED.format(size=2048, length=WORD_COUNT)
    + ", g AS (SELECT stream, chunk, count(*) AS n_seqs, 2048 - CAST(sum(n) AS BIGINT) AS n_pad FROM f GROUP BY 1, 2) SELECT stream, chunk, n_seqs, n_pad FROM g WHERE (stream, chunk) NOT IN (SELECT stream, max(chunk) FROM g GROUP BY stream) OR n_pad = 0"
)
def pack_aligned(spark, sf_dir):
    own = word_rows(spark, sf_dir).withColumn("stream", F.floor(F.col("doc_id") / 500))
    return packing.aligned_chunks(own, "t", "m", "stream", ["doc_id"], 2048).select("stream", "chunk", "n_seqs", "n_pad")


@query(
    ALIGNED.format(size=2048, length=WORD_COUNT)
    + ", g AS (SELECT stream, chunk, count(*) AS c, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY 1, 2) SELECT stream, count(*) AS chunks, CAST(sum(2048 - n) AS BIGINT) AS pad, CAST(sum(c) AS BIGINT) AS sequences FROM g GROUP BY stream"
)
def sim_pack(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 500).alias("stream"), F.size(F.split("text", " ")).alias("n"))
    return packing.sim_pack(own, "n", "stream", ["doc_id"], 2048)


REPORT = ALIGNED.replace("doc_id // 500 AS stream", "conv_id // 200 AS stream").replace("PARTITION BY doc_id // 500 ORDER BY doc_id", "PARTITION BY conv_id // 200 ORDER BY conv_id").replace("FROM documents", "FROM e").replace("WITH RECURSIVE d", "WITH RECURSIVE e AS (SELECT conv_id, CAST(sum(greatest(1, length(text) // 4) + 1) + 2 AS BIGINT) AS tokens FROM conversations GROUP BY conv_id), d")


@query(
    REPORT.format(size=1024, length="tokens")
    + ", g AS (SELECT stream, chunk, count(*) AS c, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY 1, 2) SELECT stream, count(*) AS chunks, round(sum(1024 - n) / (count(*) * 1024), 6) AS pad_share, round(sum(n) / sum(c), 6) AS mean_tokens FROM g GROUP BY stream"
)
def pack_report(spark, sf_dir):
    own = chats(spark, sf_dir).select("conv_id", F.floor(F.col("conv_id") / 200).alias("stream"), M.estimate_tokens(F.col("messages")).alias("n"))
    r = packing.sim_pack(own, "n", "stream", ["conv_id"], 1024)
    return r.select("stream", "chunks", F.round(F.col("pad") / (F.col("chunks") * 1024), 6).alias("pad_share"), F.round((F.col("chunks") * 1024 - F.col("pad")) / F.col("sequences"), 6).alias("mean_tokens"))


def marked_chunks(spark, sf_dir):
    own = chats(spark, sf_dir).withColumn("p", tokens.conversation_tokens(F.col("messages")))
    return packing.linear_chunks(own.select("conv_id", F.col("p.t").alias("tokens"), F.col("p.m").alias("mask")), ["tokens", "mask"], ["conv_id"], SIZE)


MARKS = f"""WITH t AS (SELECT conv_id, turn, role, strlen(text) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
  e AS (SELECT conv_id, -1 AS turn, 0 AS part, 1 AS n, 'BOS' AS kind, 0 AS m FROM t GROUP BY conv_id
    UNION ALL SELECT conv_id, turn, 0, 1, role, CASE WHEN role = 'assistant' OR (role = 'user' AND before = 'assistant') THEN 1 ELSE 0 END FROM t
    UNION ALL SELECT conv_id, turn, 1, n, 'text', CASE WHEN role = 'assistant' THEN 1 ELSE 0 END FROM t
    UNION ALL SELECT conv_id, 1000000, 0, 1, 'EOS', CASE WHEN arg_max(role, turn) = 'assistant' THEN 1 ELSE 0 END FROM t GROUP BY conv_id),
  x AS (SELECT conv_id, turn, part, kind, m, unnest(range(0, n)) AS i FROM e),
  k AS (SELECT kind, m, row_number() OVER (ORDER BY conv_id, turn, part, i) - 1 AS r FROM x),
  g AS (SELECT r // {SIZE} AS chunk, r % {SIZE} AS o, kind, m FROM k WHERE r < (SELECT count(*) FROM k) // {SIZE} * {SIZE}),
  s AS (SELECT *, CASE WHEN kind IN ('BOS', 'user', 'assistant', 'system', 'EOS') THEN 1 ELSE 0 END AS b FROM g)
"""


@query(MARKS + "SELECT chunk, count(*) FILTER (kind = 'BOS') AS n_bos, CAST(0 AS BIGINT) AS n_pad, CAST(sum(m) AS BIGINT) AS n_loss FROM s GROUP BY chunk")
def chunk_counters(spark, sf_dir):
    count = lambda c, v: F.size(F.filter(c, lambda x: x == v)).cast("long")
    return marked_chunks(spark, sf_dir).select("chunk", count("tokens", tokens.BOS).alias("n_bos"), count("tokens", tokens.PAD).alias("n_pad"), count("mask", 1).alias("n_loss"))


@query(MARKS + ", q AS (SELECT *, CAST(sum(b) OVER (PARTITION BY chunk ORDER BY o) AS BIGINT) AS section FROM s) SELECT chunk, section, CASE WHEN max(b) = 1 THEN max(CASE WHEN b = 1 THEN kind END) ELSE '[MID-CONV]' END AS role, count(*) AS n_tokens, max(m) = 1 AS trained FROM q GROUP BY chunk, section")
def chunk_sections(spark, sf_dir):
    names = {tokens.BOS: "BOS", tokens.EOS: "EOS", tokens.USER: "user", tokens.ASSISTANT: "assistant", tokens.SYSTEM: "system"}
    return packing.sections(["chunk"], marked_chunks(spark, sf_dir), names)


@query(
    PAIRS
    + """, n AS (SELECT conv_id, list_sum(list_transform(chosen, lambda x: strlen(x.content) + 1)) + 2 AS c, list_sum(list_transform(rejected, lambda x: strlen(x.content) + 1)) + 2 AS r,
      list_position(list_transform(chosen, lambda x: x.role), 'assistant') AS ca, list_position(list_transform(rejected, lambda x: x.role), 'assistant') AS ra, chosen, rejected FROM p),
    f AS (SELECT conv_id, c, r, CASE WHEN ca > 0 THEN 1 + coalesce(list_sum(list_transform(chosen[:ca - 1], lambda x: strlen(x.content) + 1)), 0) END AS c1, CASE WHEN ra > 0 THEN 1 + coalesce(list_sum(list_transform(rejected[:ra - 1], lambda x: strlen(x.content) + 1)), 0) END AS r1 FROM n)
    SELECT conv_id, CAST(greatest(0, 1024 - c) AS BIGINT) AS chosen_pad, CAST(greatest(0, 1024 - r) AS BIGINT) AS rejected_pad FROM f WHERE c1 < 1024 AND r1 < 1024"""
)
def pref_prepare(spark, sf_dir):
    own = preference.prepared(pairs(spark, sf_dir), 1024)
    n = lambda c: F.size(F.filter(c, lambda x: x == tokens.PAD)).cast("long")
    return own.select("conv_id", n("chosen_ids").alias("chosen_pad"), n("rejected_ids").alias("rejected_pad"))


@query(
    REPORT.replace("conv_id // 200", "conv_id % 3 + conv_id // 200 * 3").format(size=2048, length="tokens")
    + ", g AS (SELECT stream % 3 AS source, stream, chunk, count(*) AS c FROM f GROUP BY 1, 2, 3), z AS (SELECT conv_id % 3 AS source, avg(tokens) AS mean FROM e GROUP BY 1) SELECT ['smoltalk', 'lima', 'ultrachat_gen'][1 + g.source] AS source, CAST(sum(c) AS BIGINT) AS n, round(any_value(mean), 6) AS mean_tokens, count(*) AS chunks, CAST(count(*) // 4 AS BIGINT) AS steps FROM g JOIN z ON g.source = z.source GROUP BY g.source"
)
def profile_sources(spark, sf_dir):
    """Each source is packed shard by shard."""
    own = chats(spark, sf_dir).select("source", "conv_id", F.concat_ws(":", "source", F.floor(F.col("conv_id") / 200)).alias("stream"), M.estimate_tokens(F.col("messages")).alias("n"))
    mean = own.groupBy("source").agg(F.avg("n").alias("mean"))
    packed = packing.sim_pack(own, "n", "stream", ["conv_id"], 2048).groupBy(F.substring_index("stream", ":", 1).alias("source")).agg(F.sum("sequences").alias("n"), F.sum("chunks").alias("chunks"))
    return packed.join(mean, "source").select("source", "n", F.round("mean", 6).alias("mean_tokens"), "chunks", profile.training_steps(F.col("chunks"), 2, 2).alias("steps"))
