"""Literal cases, executable specifications and invariants of the operators."""

import contextlib
import io
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.functions import formats, messages, text
from textloom.sources.schemas import CALCULATOR_ITEM
from textloom.operators import evals, mixing, ordering, packing, preference, rewards, splits, synth, tokens
from textloom.sources import readers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit_messages(rows):
    return F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in rows])


@pytest.mark.parametrize(
    ("got", "want", "ok", "reward"),
    [("2.0", "2.0", True, 1.0), ("", "2.0", False, 0.0), ("2.001", "2.0", True, 1.0), ("3.0", "2.0", True, 0.5), ("abc", "ABC", True, 1.0), ("abc", "ABC", False, 0.0), ("1,000", "1000", False, 0.7)],
)
def test_reward(spark, got, want, ok, reward):
    assert one(spark, rewards.score_stdout(F.lit(got), F.lit(want), F.lit(ok))) == reward


def test_text_functions(spark):
    assert one(spark, text.strip(F.lit("  a b \n"))) == "a b"
    assert one(spark, text.split_words(F.lit("  "))) == []
    assert one(spark, text.token_f1(F.lit(""), F.lit(" "))) == 1.0
    assert one(spark, text.token_f1(F.lit("a"), F.lit(""))) == 0.0
    assert one(spark, text.token_f1(F.lit("A b"), F.lit("a c"))) == 0.5
    assert one(spark, text.extract_code(F.lit("x ```python\n a \n``` y"))) == "a"
    assert one(spark, text.extract_code(F.lit("none"))) is None
    assert one(spark, text.last_number(F.lit("1 then -2.5"))) == "-2.5"
    assert one(spark, text.last_number(F.lit("none"))) is None
    assert one(spark, text.preview_words(F.lit("a  b c"), 2)) == "a b..."
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    assert one(spark, text.strip_special(F.lit("<|user|> hi <|pad|>"))) == "hi"


def test_message_functions(spark):
    m = [("system", "s"), ("user", "a"), ("user", "b"), ("assistant", "c"), ("user", "d"), ("assistant", "e"), ("user", "")]
    pairs = one(spark, messages.ua_pairs(lit_messages(m)))
    assert [(p.user.content, p.assistant.content) for p in pairs] == []  # out of step, not resynchronised
    assert len(one(spark, messages.ua_pairs(lit_messages(m[:2] + m[3:])))) == 2
    assert len(one(spark, messages.strip_trailing_user(lit_messages(m)))) == 6
    dialogue = "\n\nHuman: one\n\ntwo \n\nAssistant: \n\nHuman: x\n\nAssistant: y\n"
    assert [(x.role, x.content) for x in one(spark, messages.parse_dialogue(F.lit(dialogue)))] == [("user", "one\n\ntwo"), ("user", "x"), ("assistant", "y")]
    assert one(spark, messages.common_length(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3)), F.array(F.lit(1))))) == 1


@pytest.mark.parametrize(
    ("raw", "reason"),
    [
        ('{"messages": [["u", "hi"], ["a", "yo"]]}', None), ('{"messages": []}', "no messages"), ('{"system": "x"}', "no messages"), ('{"messages": [["x", "hi"]]}', "bad item"),
        ('{"messages": [["u"]]}', "bad item"), ('{"messages": [["u", "a"], ["u", "b"]]}', "roles repeat"), ('{"messages": [["a", "b"]]}', "first is no user"), ('{"messages": [["u", "b"]]}', "last is no assistant"),
    ],
)
def test_validation(spark, raw, reason):
    assert readers.ingest_custom(spark.createDataFrame([(f"[{raw}]",)], "value string")).first().reject_reason == reason


def test_answers(spark):
    assert [one(spark, formats.answer_index(F.lit(x))) for x in ("C", "1", 0)] == [2, 1, 0]
    with pytest.raises(Exception, match="no answer"):
        one(spark, formats.answer_index(F.lit("E")))


def loss_mask(conversation, policy):
    ids, mask, before = [tokens.BOS], [0], None
    for role, content in conversation:
        role = role or "user"
        every = policy == "all"
        if role in tokens.ROLES:
            ids.append(tokens.ROLES[role])
            mask.append(int(every or role == "assistant" or (role == "user" and before == "assistant")))
        body = list((content or "").encode())
        ids += body
        mask += [int(every or role == "assistant")] * len(body)
        before = role
    return ids + [tokens.EOS], mask + [int(policy == "all" or before == "assistant")]


def test_conversation_tokens(spark):
    for c in ([("user", "hé"), ("assistant", "yo"), ("user", "")], [("system", "s"), ("tool", "t"), (None, None), ("assistant", "")]):
        rows = spark.createDataFrame([(c,)], "m array<struct<role:string,content:string>>")
        for policy in ("assistant_only", "all"):
            got = rows.select(tokens.tokenize_conversation(F.col("m"), policy).alias("p")).first().p
            assert ([x.t for x in got], [x.m for x in got]) == loss_mask(c, policy)


def test_bytes(spark):
    for t in ("", "a", "é\u0000ß", "漢字 🙂", "x" * 300):
        assert one(spark, tokens.bytes_ids(F.lit(t))) == list(t.encode())


def test_bpe(spark):
    files = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    file = files.path("byte_bpe_50k.json")
    rows = spark.createDataFrame([("Hello there, world",), ("",), (None,)], "t string")
    got = [r.i for r in rows.select(tokens.tokenize_text(F.col("t"), tokens.bpe_ids(file)).alias("i")).collect()]
    assert got == [[*Tokenizer.from_file(file).encode(t, add_special_tokens=False).ids, tokens.EOS] for t in ("Hello there, world", "", "")]


def test_arrays(spark):
    a = F.array(*[F.lit(x) for x in (1, 2, 9, 3)])
    assert one(spark, tokens.truncate_at(a, 9)) == [1, 2] and one(spark, tokens.truncate_at(a, 9, True)) == [1, 2, 9] and one(spark, tokens.truncate_at(a, 7)) == [1, 2, 9, 3]
    assert one(spark, tokens.pad_to(a, 6, 0)) == [1, 2, 9, 3, 0, 0] and one(spark, tokens.pad_to(a, 2, 0)) == [1, 2]
    c = one(spark, tokens.crop_left(a, 3, F.lit(0), F.lit(4)))
    assert (c.tokens, c.start, c.end) == ([2, 9, 3], -1, 3)
    assert one(spark, rewards.generation_mask(F.lit(3), F.lit(2), 4)) == [0, 0, 1, 1, 0, 0]


def test_running_sums_and_numbers(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(10**6), k, rng.randrange(9)) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, o long, k long, v long").withColumns({"part": F.lit(1), "key": F.lit(2), "a.b": F.lit(3)}).repartition(7)
    got = {r.k: r.s for r in ordering.running_sum(df, ["o", "k"], F.col("v"), "s", ["g"]).collect()}
    total = defaultdict(int)
    for g, o, k, v in sorted(rows, key=lambda r: (r[1], r[2])):
        assert got[k] == total[g]
        total[g] += v
    numbers = [r.n for r in ordering.row_numbers(df, ["o", "k"], "n").orderBy("o", "k").collect()]
    assert numbers == list(range(3000))


def test_order_of_any_type(spark):
    """Texts, times and decimals, one value that holds most rows, and nulls: places as a sort gives them, and many buckets."""
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", f"é{rng.randrange(500)}", None]), k) for k in range(4000)]
    df = spark.createDataFrame(rows, "s string, k long").withColumns({"d": F.col("k").cast("decimal(20,2)") / 7, "t": F.timestamp_seconds(F.col("k") * 3600), "h": F.when(F.col("k") % 4 == 0, F.col("k")).otherwise(5), "z": F.when(F.col("k") % 9 > 0, F.col("k"))}).repartition(6)
    for order in (["s", "k"], ["d"], ["t"], ["h", "k"], ["z", "k"], ["h", "s", "k"]):
        assert ordering.bucketed(df, order, "b").select("b").distinct().count() > 8, order
        got = [r.k for r in ordering.row_numbers(df, order, "n").orderBy("n").collect()]
        assert got == [r.k for r in df.orderBy(*order).collect()], order
    assert ordering.row_numbers(df.limit(0), ["s"], "n").count() == 0


def next_fit(lengths, size, flush):
    out, used = [], []
    for n in lengths:
        n = min(n, size)
        if used and sum(used) + n > size:
            out.append(used)
            used = []
        used = [*used, n]
        if sum(used) == size:
            out.append(used)
            used = []
    return out + ([used] if flush and used else [])


@pytest.mark.parametrize("seed", range(4))
def test_packing_against_loops(spark, seed):
    rng = random.Random(seed)
    rows = [(i % 2, i, [rng.randrange(99) for _ in range(rng.choice([1, 3, 8, 16, 17, 40, 0][: 6 + seed % 2]))]) for i in range(rng.choice([1, 50, 121]))]
    df = spark.createDataFrame(rows, "s long, i long, t array<int>").withColumn("m", F.transform("t", lambda t: t % 2)).repartition(5)
    for flush in (False, True):
        got = packing.aligned_chunks(df, "t", "m", "s", ["i"], 16, flush).collect()
        for s in (0, 1):
            own = sorted((r.chunk, r.n_seqs, r.n_pad, len(r.tokens)) for r in got if r.s == s)
            want = next_fit([len(t) for k, _, t in rows if k == s], 16, flush)
            assert own == [(k, len(c), 16 - sum(c), 16) for k, c in enumerate(want)]
            at, sequences = 0, [t[:16] for k, _, t in rows if k == s]
            for r in sorted((r for r in got if r.s == s), key=lambda r: r.chunk):
                ids = [x for t in sequences[at : at + r.n_seqs] for x in t]
                at += r.n_seqs
                assert r.tokens == ids + [tokens.PAD] * r.n_pad and r.mask == [x % 2 for x in ids] + [0] * r.n_pad
    flat = [x for _, _, t in rows for x in t]
    got = [list(r.tokens) for r in packing.linear_chunks(df, "t", ["i"], 16).orderBy("chunk").collect()]
    assert got == [flat[k : k + 16] for k in range(0, len(flat) - 15, 16)]
    fit = one(spark, packing.fit_lengths(F.array(*[F.lit(len(t)) for _, _, t in rows]), 16))
    want = next_fit([len(t) for _, _, t in rows], 16, True)
    assert (fit.chunks, fit.pad) == (len(want), sum(16 - sum(c) for c in want))


def test_splits_are_disjoint_and_complete(spark):
    df = spark.range(1000).selectExpr("id", "id div 100 as shard")
    for out in (splits.by_shard(df, "shard"), splits.by_fraction(df, "shard", "id", 0.1), splits.by_shard(df, "shard", "last")):
        assert out.count() == 1000
        assert out.where("split = 'val'").count() == 100
    lone = splits.by_shard(df.where("shard = 0"), "shard", fallback=True)
    assert lone.groupBy("split").count().collect() == [("train", 100), ("val", 100)] or lone.count() == 200
    owners = splits.shard_owners(spark.range(3).withColumnRenamed("id", "shard"), 4, 2).collect()
    assert {r.shard for r in owners} == {0, 1, 2} and len(owners) == 8  # readers share when there are few shards


def test_writers(spark, tmp_path):
    df = spark.range(1000).repartition(3)
    writers.write_shards(df, f"{tmp_path}/w", "id", rows=100)
    assert readers.read_shards(spark, f"{tmp_path}/w").count() == 1000
    writers.write_once(spark.range(5), f"{tmp_path}/w")
    assert readers.read_shards(spark, f"{tmp_path}/w").count() == 1000
    ordered = readers.with_order(spark, f"{tmp_path}/w")
    assert ordered.groupBy("shard").count().where("count > 100").count() == 0
    metrics = spark.createDataFrame([("loss", 1.5)], "metric string, value double")
    writers.append_metrics(metrics, f"{tmp_path}/m", 3)
    assert spark.read.parquet(f"{tmp_path}/m").first().step == 3


def test_readers(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Eval Task,Random baseline\nx,25\n")
    (tmp_path / "i.jsonl").write_text('{"query": "q", "choices": ["a", "b"], "gold": 1}\n{"context": "c", "continuation": "d"}\n')
    assert readers.read_baselines(spark, f"{tmp_path}/b.csv").first().baseline == 25.0
    assert readers.read_json_lines(spark, f"{tmp_path}/i.jsonl").where("gold = 1").count() == 1
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([("y",)], "b string")
    assert readers.union_columns(a, b).columns == ["a", "b"]
    assert readers.flattened(spark.createDataFrame([((1, 2),)], "t struct<p:int,q:int>")).columns == ["p", "q"]


def test_mixing_shares_and_restart(spark):
    weights = {"a": 3, "b": 1}
    rows = spark.createDataFrame([("a", i, f"a{i}") for i in range(10)] + [("b", i, f"b{i}") for i in range(3)], "source string, i long, x string")
    out = mixing.mixed(mixing.draws(spark, 4000, weights, 1), rows, "i").collect()
    assert len(out) == 4000 and 0.7 < sum(r.source == "a" for r in out) / 4000 < 0.8
    b = [r.x for r in sorted(out, key=lambda r: r.draw) if r.source == "b"]
    assert b[:7] == ["b0", "b1", "b2", "b0", "b1", "b2", "b0"]


def test_few_shot_is_never_oneself(spark):
    out = mixing.few_shot(spark.range(40).selectExpr("id", "id % 4 as g"), "id", "g", 5).collect()
    seen = defaultdict(set)
    for r in out:
        assert r.id != r.other and r.id % 4 == r.other % 4
        seen[r.id].add(r.other)
    assert {len(s) for s in seen.values()} == {5} and len(seen) == 40


def test_preferences(spark):
    df = spark.createDataFrame([("\n\nHuman: q\n\nAssistant: a", "\n\nHuman: q\n\nAssistant: "), ("none", "\n\nHuman: q")], "chosen string, rejected string")
    assert [len(r.rejected) for r in preference.from_dialogues(df, "s").collect()] == [1]
    s = one(spark, preference.shared_prefix(lit_messages([("user", "a"), ("assistant", "b")]), lit_messages([("user", "a"), ("assistant", "c"), ("user", "d")])))
    assert (len(s.prefix), len(s.chosen_rest), len(s.rejected_rest)) == (1, 1, 2)


def test_decisions(spark):
    losses = spark.createDataFrame([(1, o, p, float(x)) for o, xs in enumerate([[9, 2, 2], [0, 2, 2], [9, 3, 1]]) for p, x in enumerate(xs)], "example_id long, option int, pos int, loss double")
    spans = spark.createDataFrame([(1, o, 2, 4) for o in range(3)], "example_id long, option int, start int, end int")
    gold = spark.createDataFrame([(1, 0)], "example_id long, gold int")
    r = evals.decide(losses, spans, gold).first()
    assert (r.predicted, r.correct) == (0, True)  # the first of ties
    empty = evals.core_metric(spark.createDataFrame([], "label string, correct boolean"), spark.createDataFrame([], "label string, baseline double")).first()
    assert (empty.core, empty.labels) == (0.0, 0)


def test_calculator_problems(spark):
    rows = synth.calculator_problems(spark, 600).collect()
    for r in rows:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            exec(r.calculator_code, {})  # noqa: S102  our own code
        assert abs(float(out.getvalue()) - float(r.expected_output)) <= 1e-3 * (abs(float(r.expected_output)) + 1e-8) + 1e-9
    assert 0.15 < sum(r.has_error for r in rows) / 600 < 0.25
    assert {r.problem_type for r in rows} == {"arithmetic", "statistics", "conversion"}
    for r in rows:
        told = r.response.split("By hand: ")[1].split("\n")[0]
        assert r.response.rstrip().endswith(f"Result: {r.expected_output}") and (told != r.expected_output) == r.has_error
    assert [f.name for f in CALCULATOR_ITEM] == synth.calculator_problems(spark, 1).columns
    assert len({r.question for r in rows}) > 500 and len({r.problem_type for r in rows if r.has_error}) == 3
    assert rows[:10] == synth.calculator_problems(spark, 10).collect() != synth.calculator_problems(spark, 10, rank=1).collect()
    assert all(r.perfect == r.n for r in synth.quality_counters(synth.calculator_problems(spark, 300)).collect())


def test_topic_switches(spark):
    pool = spark.createDataFrame([("a", i, [("user", f"q{i}.{k} " * 20) if k % 2 == 0 else ("assistant", f"r{i}.{k} " * 20) for k in range(6)]) for i in range(30)], "source string, i long, messages array<struct<role:string,content:string>>")
    out = synth.topic_switches(pool, "i", 100, {"a": 1.0}, budget=400)
    rows = out.withColumn("n", messages.estimate_tokens(F.col("messages"))).collect()
    assert len(rows) == 100
    for r in rows:
        body = [m for m in r.messages if m.role != "system"]
        assert r.n <= 400 and [m.role for m in body] == ["user", "assistant"] * r.n_pairs
    assert 0.3 < sum(r.messages[0].role == "system" for r in rows) / 100 < 0.7
    small = synth.topic_switches(pool.select("source", "i", F.array(*[F.struct(F.lit(r).alias("role"), F.lit("x").alias("content")) for r in ("user", "assistant")]).alias("messages")), "i", 5, {"a": 1.0}, budget=1200, p_system=0.0)
    assert {r.n_pairs for r in small.collect()} == {(1200 - 2) // 4}  # the budget alone ends a conversation
    assert any(len({m.content.split(".")[0][1:] for m in r.messages if m.role == "user"}) > 1 for r in rows)
