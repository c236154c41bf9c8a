"""Queries on overlap scores of texts."""

from pyspark.sql import functions as F

from textloom.functions.text import split_words
from textloom.operators import overlap
from textloom.plans.registry import query, table

WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"

#: Documents without every seventh word against the whole, and n-grams up to 4 of both.
CUT = f"""WITH w AS (SELECT doc_id, lang, {WORDS} AS r FROM documents),
  s AS (SELECT doc_id, lang, 0 AS side, r AS w FROM w UNION ALL SELECT doc_id, lang, 1, list_filter(r, lambda x, i: i % 7 <> 0) FROM w),
  e AS (SELECT doc_id, side, w, lead(w, 1) OVER o AS x, lead(w, 2) OVER o AS y, lead(w, 3) OVER o AS z FROM (SELECT doc_id, side, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM s) WINDOW o AS (PARTITION BY doc_id, side ORDER BY i)),
  g AS (SELECT doc_id, side, n, g, count(*) AS c FROM (SELECT doc_id, side, 1 AS n, w AS g FROM e UNION ALL SELECT doc_id, side, 2, w || ' ' || x FROM e UNION ALL SELECT doc_id, side, 3, w || ' ' || x || ' ' || y FROM e
    UNION ALL SELECT doc_id, side, 4, w || ' ' || x || ' ' || y || ' ' || z FROM e) WHERE g IS NOT NULL GROUP BY ALL),
  m AS (SELECT a.doc_id AS doc_id, a.n AS n, CAST(sum(least(a.c, b.c)) AS BIGINT) AS m FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.n = b.n AND a.g = b.g AND a.side < b.side GROUP BY ALL),
  h AS (SELECT doc_id, {', '.join(f'max(m) FILTER (WHERE n = {n}) AS m{n}' for n in (1, 2, 3, 4))} FROM m GROUP BY doc_id),
  k AS (SELECT a.doc_id AS doc_id, a.lang AS lang, len(b.w) AS p, len(a.w) AS r, coalesce(m1, 0) AS m1, coalesce(m2, 0) AS m2, coalesce(m3, 0) AS m3, coalesce(m4, 0) AS m4
    FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.side < b.side LEFT JOIN h ON a.doc_id = h.doc_id)
"""
MEAN = "CASE WHEN least(m1, m2, m3, m4) > 0 THEN exp((ln(m1 / p1) + ln(m2 / p2) + ln(m3 / p3) + ln(m4 / p4)) / 4) * CASE WHEN p >= r THEN 1 ELSE exp(1 - r / p) END ELSE 0 END"


def cut_texts(spark, sf_dir):
    words = split_words(F.col("text"))
    cut = F.array_join(F.filter(words, lambda _, i: (i + 1) % 7 != 0), " ")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", overlap.overlap(cut, F.col("text")).alias("o"))


@query(
    CUT + f"SELECT doc_id, p, r, m1, m2, m3, m4, round({MEAN}, 6) AS bleu FROM (SELECT *, greatest(p, 1)::DOUBLE AS p1, greatest(p - 1, 1) AS p2, greatest(p - 2, 1) AS p3, greatest(p - 3, 1) AS p4 FROM k)"
)
def bleu(spark, sf_dir):
    """Whole documents without every seventh word."""
    matches = [F.get("o.matches", n).alias(f"m{n + 1}") for n in range(4)]
    return cut_texts(spark, sf_dir).select("doc_id", "o.p", "o.r", *matches, F.round(overlap.bleu(F.col("o")), 6).alias("bleu"))


@query(
    CUT
    + f"""SELECT lang, round({MEAN}, 6) AS bleu FROM (SELECT lang, sum(p)::DOUBLE AS p, sum(r)::DOUBLE AS r, sum(p)::DOUBLE AS p1, sum(greatest(p - 1, 0))::DOUBLE AS p2, sum(greatest(p - 2, 0))::DOUBLE AS p3,
    sum(greatest(p - 3, 0))::DOUBLE AS p4, sum(m1)::DOUBLE AS m1, sum(m2)::DOUBLE AS m2, sum(m3)::DOUBLE AS m3, sum(m4)::DOUBLE AS m4 FROM k GROUP BY lang)"""
)
def corpus_bleu(spark, sf_dir):
    return cut_texts(spark, sf_dir).groupBy("lang").agg(F.round(overlap.corpus_bleu("o"), 6).alias("bleu"))


@query(
    f"""WITH w AS (SELECT doc_id, {WORDS.replace('text', 'lower(text)')} AS w FROM documents),
  e AS (SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS x FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM w)),
  g AS (SELECT doc_id, n, g, count(*) AS c FROM (SELECT doc_id, 1 AS n, w AS g FROM e UNION ALL SELECT doc_id, 2, w || ' ' || x FROM e) WHERE g IS NOT NULL GROUP BY ALL),
  m AS (SELECT a.doc_id AS doc_id, a.n AS n, sum(least(a.c, b.c))::DOUBLE AS m FROM g a JOIN g b ON a.doc_id + 1 = b.doc_id AND a.n = b.n AND a.g = b.g GROUP BY ALL)
SELECT a.doc_id AS doc_id, round(coalesce(2 * x.m / (len(a.w) + len(b.w)), 0), 6) AS rouge_1, round(coalesce(2 * y.m / (len(a.w) + len(b.w) - 2), 0), 6) AS rouge_2
FROM w a JOIN w b ON a.doc_id + 1 = b.doc_id LEFT JOIN m x ON x.doc_id = a.doc_id AND x.n = 1 LEFT JOIN m y ON y.doc_id = a.doc_id AND y.n = 2"""
)
def rouge_n(spark, sf_dir):
    """Each document against the next."""
    own = table(spark, sf_dir, "documents").select("doc_id", "text")
    after = own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    o = own.join(after, "doc_id").select("doc_id", overlap.overlap(F.col("text"), F.col("next"), most=2, lower=True).alias("o"))
    return o.select("doc_id", F.round(overlap.rouge_n(F.col("o")), 6).alias("rouge_1"), F.round(overlap.rouge_n(F.col("o"), 2), 6).alias("rouge_2"))


#: Each turn and the one after it, as words.
TURNS = f"""WITH RECURSIVE w AS (SELECT conv_id, turn, {WORDS.replace('text', 'lower(text)')} AS w FROM conversations),
  c AS (SELECT a.conv_id AS conv_id, a.turn AS turn, a.w AS a, b.w AS b FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)"""


def turns(spark, sf_dir, **options):
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = own.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return own.join(after, ["conv_id", "turn"]).select("conv_id", "turn", overlap.overlap(F.col("text"), F.col("next"), most=1, lower=True, **options).alias("o"))


@query(
    TURNS
    + """, l AS (SELECT conv_id, turn, 0 AS i, list_transform(b, lambda x: 0) AS row FROM c UNION ALL
    SELECT l.conv_id, l.turn, i + 1, list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN b[k] = a[i + 1] THEN 1 + CASE WHEN k = 1 THEN 0 ELSE row[k - 1] END ELSE row[k] END)))
    FROM l JOIN c ON l.conv_id = c.conv_id AND l.turn = c.turn WHERE i < len(a) AND len(b) > 0)
SELECT l.conv_id AS conv_id, l.turn AS turn, CAST(row[len(b)] AS BIGINT) AS common, round(2 * row[len(b)]::DOUBLE / (len(a) + len(b)), 6) AS rouge_l FROM l JOIN c ON l.conv_id = c.conv_id AND l.turn = c.turn WHERE i = len(a) AND len(b) > 0"""
)
def rouge_l(spark, sf_dir):
    """Each turn against the next."""
    return turns(spark, sf_dir, common=True).where("o.r > 0").select("conv_id", "turn", "o.common", F.round(overlap.rouge_l(F.col("o")), 6).alias("rouge_l"))


@query(
    TURNS
    + f""", u AS (SELECT conv_id, turn, 0 AS side, a AS w FROM c UNION ALL SELECT conv_id, turn, 1, b FROM c),
  e AS (SELECT conv_id, turn, side, i, w[i] AS w, CASE WHEN length(regexp_replace(w[i], '{overlap.ENDINGS}', '')) >= 3 THEN regexp_replace(w[i], '{overlap.ENDINGS}', '') ELSE w[i] END AS s
    FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM u)),
  e1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, side, w ORDER BY i) AS k FROM e),
  m1 AS (SELECT x.conv_id AS conv_id, x.turn AS turn, x.i AS i, y.i AS j FROM e1 x JOIN e1 y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.w = y.w AND x.k = y.k AND x.side < y.side),
  left_ AS (SELECT * FROM e WHERE (conv_id, turn, side, i) NOT IN (SELECT conv_id, turn, 0, i FROM m1 UNION ALL SELECT conv_id, turn, 1, j FROM m1)),
  e2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, side, s ORDER BY i) AS k FROM left_),
  al AS (SELECT * FROM m1 UNION ALL SELECT x.conv_id, x.turn, x.i, y.i FROM e2 x JOIN e2 y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.s = y.s AND x.k = y.k AND x.side < y.side),
  br AS (SELECT *, CASE WHEN lag(i) OVER o = i - 1 AND lag(j) OVER o = j - 1 THEN 0 ELSE 1 END AS new FROM al WINDOW o AS (PARTITION BY conv_id, turn ORDER BY i)),
  t AS (SELECT conv_id, turn, count(*)::DOUBLE AS m, sum(new)::DOUBLE AS runs FROM br GROUP BY conv_id, turn)
SELECT c.conv_id AS conv_id, c.turn AS turn, round(CASE WHEN m IS NULL THEN 0 ELSE (m / len(a)) * (m / len(b)) / ({overlap.ALPHA} * m / len(a) + {1 - overlap.ALPHA} * m / len(b)) * (1 - {overlap.GAMMA} * pow(runs / m, {overlap.BETA})) END, 6) AS meteor
FROM c LEFT JOIN t ON c.conv_id = t.conv_id AND c.turn = t.turn"""
)
def meteor(spark, sf_dir):
    """Each turn against the next."""
    return turns(spark, sf_dir, align=True).select("conv_id", "turn", F.round(overlap.meteor(F.col("o")), 6).alias("meteor"))
