"""Queries on generated data, with SQL that makes the same rows."""

from pyspark.sql import functions as F

from textloom.functions.numbers import GOLDEN, MASK, hash32_sql
from textloom.operators import synth
from textloom.plans.registry import CHATS, chats, query
from textloom.plans.conversations import UA


def draws_sql(row: str, seed: int, n: int, columns: str, source: str) -> str:
    """Query text: the columns, and r, an array of n draws."""
    own = hash32_sql(f"xor({row} & {MASK}, {hash32_sql(f'({row} >> 32) + {seed}')})")
    return f"SELECT {columns}, list_transform(range({n}), lambda k: {hash32_sql(f'(own + k * {GOLDEN}) & {MASK}')}) AS r FROM (SELECT *, {own} AS own FROM {source})"


def pick(k: int, lo: int, hi: int) -> str:
    return f"(((r[{k + 1}] * {hi - lo + 1}) >> 32) + {lo})"


def calculator_sql(n: int, seed: int) -> str:
    off = lambda v, at: f"{v} + CASE WHEN has_error AND {at} THEN sign * greatest(2, abs({v}) * percent // 100) ELSE 0 END"
    text = lambda x: f"regexp_replace(printf('%.4f', {x}), '(\\.\\d+?)0+$', '\\1')"
    units = [str([u[k] for u in synth.UNITS]) for k in range(3)]
    return f"""WITH d AS ({draws_sql('i', seed, synth.DRAWS, 'i', f'range({n}) t(i)')}),
    p AS (SELECT *, {pick(0, 0, 2)} AS type, {pick(1, 0, 99)} < {synth.SLIP_PERCENT} AS has_error, {pick(2, 0, 1)} * 2 - 1 AS sign, {pick(3, 5, 15)} AS percent, {pick(4, 20, 90)} AS a, {pick(5, 2, 19)} AS b,
      {pick(6, 2, 9)} AS c, {pick(7, 1, 40)} AS d, {pick(8, 0, 2)} AS slip, {synth.READINGS}[{pick(4, 0, 2)} + 1] AS size, {pick(4, 0, len(synth.UNITS) - 1)} + 1 AS which, {pick(5, 2, 250)} AS amount FROM d),
    q AS (SELECT *, list_transform(r[6:5 + size], lambda x: ((x * 90) >> 32) + 10) AS readings, {units[0]}[which] AS large, {units[1]}[which] AS small, {units[2]}[which] AS factor, {off('(a + b)', 'slip = 0')} AS shelf FROM p),
    s AS (SELECT *, list_sum(readings) AS total, array_to_string(readings, ', ') AS listed, {off('(shelf * c)', 'slip = 1')} AS all_, {off('(amount * factor)', 'true')} AS product FROM q),
    t AS (SELECT *, {off('(all_ - d)', 'slip = 2')} AS rest, {off('total', 'true')} AS said FROM s),
    o AS (SELECT has_error, ['arithmetic', 'statistics', 'conversion'][type + 1] AS problem_type,
      CASE type WHEN 0 THEN 'A depot has ' || a || ' crates on each shelf and puts ' || b || ' more on each. There are ' || c || ' shelves. It sends ' || d || ' crates away. How many crates stay?'
        WHEN 1 THEN 'A gauge showed these values: ' || listed || '. What is their mean?' ELSE 'How many ' || small || ' are ' || amount || ' ' || large || '?' END AS question,
      CASE type WHEN 0 THEN 'One shelf: ' || a || ' + ' || b || ' = ' || shelf || chr(10) || 'All shelves: ' || shelf || ' * ' || c || ' = ' || all_ || chr(10) || 'Left over: ' || all_ || ' - ' || d || ' = ' || rest
        WHEN 1 THEN 'The ' || size || ' values add up to ' || said || '.' || chr(10) || said || ' / ' || size || ' = ' || {text('said / size')}
        ELSE 'From ' || large || ' to ' || small || ' the factor is ' || factor || '.' || chr(10) || amount || ' * ' || factor || ' = ' || product END AS steps,
      CASE type WHEN 0 THEN rest::VARCHAR WHEN 1 THEN {text('said / size')} ELSE product::VARCHAR END AS told,
      CASE type WHEN 0 THEN ((a + b) * c - d)::VARCHAR WHEN 1 THEN {text('total / size')} ELSE (amount * factor)::VARCHAR END AS expected_output,
      CASE type WHEN 0 THEN 'shelf = ' || a || ' + ' || b || chr(10) || 'print(shelf * ' || c || ' - ' || d || ')' WHEN 1 THEN 'values = [' || listed || ']' || chr(10) || 'print(sum(values) / len(values))'
        ELSE 'print(' || amount || ' * ' || factor || ')' END AS calculator_code FROM t)
    SELECT question, steps || chr(10) || 'By hand: ' || told || chr(10) || chr(10) || '```python' || chr(10) || calculator_code || chr(10) || '```' || chr(10) || chr(10)
      || CASE WHEN has_error THEN 'The program prints ' || expected_output || ' and not ' || told || ', so a step above is wrong. Result: ' || expected_output ELSE 'The program prints the same. Result: ' || expected_output END AS response,
      expected_output, has_error, problem_type, calculator_code FROM o"""


@query(calculator_sql(2000, 42))
def gen_calculator(spark, sf_dir):
    return synth.calculator_problems(spark, 2000)


@query(calculator_sql(500, 42 + synth.VALIDATION_SEED + 1))
def gen_calculator_validation(spark, sf_dir):
    return synth.calculator_problems(spark, 500, seed=42 + synth.VALIDATION_SEED, rank=1)


@query(f"SELECT problem_type, count(*) AS n, count(*) AS perfect, round(avg(has_error::INT), 6) AS error_rate, 1.0::DOUBLE AS mean_reward FROM ({calculator_sql(2000, 42)}) GROUP BY problem_type")
def calculator_counters(spark, sf_dir):
    own = synth.quality_counters(synth.calculator_problems(spark, 2000))
    return own.select("problem_type", "n", F.col("perfect").cast("long").alias("perfect"), F.round("error_rate", 6).alias("error_rate"), "mean_reward")


SWITCHES = f"""WITH {CHATS}, {UA}, g AS (SELECT p.conv_id AS conv_id, any_value(source) AS source,
    list(greatest(1, length(o[i].content) // 4) + greatest(1, length(o[i + 1].content) // 4) + 2 ORDER BY i) AS costs FROM p JOIN c ON p.conv_id = c.conv_id GROUP BY p.conv_id),
  b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY conv_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM g),
  l AS (SELECT 1 + 2048 // min(list_min(costs)) AS stretches FROM b),
  v AS (SELECT conv, CASE WHEN r[1] / 4294967296 < 0.5 THEN 'smoltalk' WHEN r[1] / 4294967296 < 0.7 THEN 'lima' ELSE 'ultrachat_gen' END AS source, CASE WHEN r[2] / 4294967296 < 0.5 THEN 1 ELSE 0 END AS system
    FROM ({draws_sql('conv', 42, 2, 'conv', 'range(500) t(conv)')})),
  e AS ({draws_sql('(conv * stretches + stretch)', 43, 2, 'conv, source, system, stretch', '(SELECT v.*, stretches, unnest(range(0, stretches)) AS stretch FROM v, l)')}),
  j AS (SELECT conv, e.source AS source, system, stretch, unnest(costs[1:1 + len(list_filter(range(1, 33), lambda t: e.r[2] < (1::BIGINT << (32 - t))))]) AS cost, generate_subscripts(costs[1:1 + len(list_filter(range(1, 33), lambda t: e.r[2] < (1::BIGINT << (32 - t))))], 1) AS place
    FROM e JOIN b ON e.source = b.source AND b.k = (e.r[1] * b.n) >> 32),
  u AS (SELECT *, sum(cost) OVER (PARTITION BY conv ORDER BY stretch, place) AS used FROM j)
SELECT conv, any_value(source) AS source, count(*) AS n_pairs, 2 * count(*) + any_value(system) AS n_messages FROM u WHERE 2 + 8 * system + used <= 2048 GROUP BY conv"""


@query(SWITCHES)
def gen_topic_switch(spark, sf_dir):
    own = synth.topic_switches(chats(spark, sf_dir), "conv_id", 500, {"smoltalk": 0.5, "lima": 0.2, "ultrachat_gen": 0.3})
    return own.select("conv", "source", "n_pairs", F.size("messages").cast("long").alias("n_messages"))
