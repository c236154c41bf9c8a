"""The operators bound to the standard tables, with the parameters meant for production."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import language_id, warc
from textloom.llm.best_fit import fill
from textloom.llm.decontaminate import contamination
from textloom.llm.divergence import divergence
from textloom.llm.embedding_dedup import linked
from textloom.llm.jaccard_join import joined_documents
from textloom.llm.line_dedup import apply_bitmaps, keep_bitmaps
from textloom.llm.packing import pack
from textloom.llm.phrases import collocations
from textloom.llm.quote_links import chat_text, conversations
from textloom.llm.suffix_dedup import repeated_spans
from textloom.llm.token_counts import token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))


#: For small tables; the recursion walks the links of each vector.
OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT vec_id, vec_id AS x FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.x = l.a
), c AS (SELECT vec_id, min(x) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.a
"""


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_documents(table(spark, sf_dir, "documents"))


#: For small tables; the recursion walks the links of each document.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 5 * c >= 4 * (x.n + y.n - c)
), r AS (SELECT doc_id, doc_id AS x FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.x = l.a),
g AS (SELECT doc_id, min(x) AS component_id FROM r GROUP BY doc_id),
k AS (SELECT a, count(*) AS n_links, min(b) FILTER (WHERE same) AS twin FROM l GROUP BY a)
SELECT g.doc_id AS doc_id, least(g.doc_id, coalesce(twin, g.doc_id)) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, g.doc_id = component_id AS kept
FROM g LEFT JOIN k ON g.doc_id = k.a
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = apply_bitmaps(docs, keep_bitmaps(docs))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), often AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE doc_id <> last) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE last IS NULL OR doc_id = last), '')) AS kept_sha256
FROM lines LEFT JOIN often ON lines.key = often.key GROUP BY doc_id
"""


def op4_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations in reply order, without quotations. Messages without a conv_id belong to none and are left out; ``reply_ordered`` returns them."""
    turns = F.array_join(F.transform("messages", lambda m: m.turn.cast("string")), ",")
    parents = F.array_join(F.transform("messages", lambda m: F.coalesce(m.parent_turn.cast("string"), F.lit("-"))), ",")
    out = conversations(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "part", "n_messages", "n_quotes", "n_linked", turns.alias("turns"), parents.alias("parents"), chat_text().alias("chat"))


#: For tables in which no turn comes twice and conversations are no longer than ``MOST_MESSAGES``; the recursion walks the replies.
OP4_SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations
), lines AS (
  SELECT conv_id, turn, i, ls[i] AS line, regexp_extract(ls[i], '^[ \t]*(>[> \t]*)', 1) AS marks,
    regexp_matches(ls[i], '(?i)^[ \t]*on .*wrote:[ \t]*$') AND i < len(ls) AND regexp_matches(coalesce(ls[i + 1], ''), '^[ \t]*>') AS intro
  FROM (SELECT conv_id, turn, ls, unnest(range(1, len(ls) + 1)) AS i FROM m)
), lev AS (
  SELECT *, len(marks) - len(replace(marks, '>', '')) AS level FROM lines
), bodies AS (
  SELECT conv_id, turn, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT intro), ''), chr(10)) AS body
  FROM lev GROUP BY conv_id, turn
), runs AS (
  SELECT conv_id, turn, level, line, i, i - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY i) AS run FROM lev
), pas AS (
  SELECT conv_id, turn, level, run, lower(trim(regexp_replace(string_agg(line, chr(10) ORDER BY i), '[\s>]+', ' ', 'g'))) AS p,
    string_agg(regexp_replace(line, '^[ \t]*>[> \t]*', ''), chr(10) ORDER BY i) AS raw
  FROM runs WHERE level > 0 GROUP BY conv_id, turn, level, run
), cut AS (
  SELECT conv_id, turn, CAST(NULL AS BIGINT) AS level, CAST(NULL AS BIGINT) AS run, body AS x FROM bodies UNION ALL SELECT conv_id, turn, level, run, raw FROM pas WHERE p <> ''
), whole AS (
  SELECT DISTINCT conv_id, turn, level, run, lower(trim(regexp_replace(y, '[\s>]+', ' ', 'g'))) AS p
  FROM (SELECT *, unnest(list_concat([x], regexp_split_to_array(x, '\n\s*\n'), string_split(x, chr(10)))) AS y FROM cut)
), parts AS (
  SELECT conv_id, turn, level, run, p FROM whole UNION
  SELECT conv_id, turn, level, run, unnest(string_split(regexp_replace(p, '([.!?]) ', '\1' || chr(1), 'g'), chr(1))) FROM whole
), votes AS (
  SELECT conv_id, turn, level, run, near, count(*) AS votes FROM (
    SELECT a.conv_id AS conv_id, a.turn AS turn, a.level AS level, a.run AS run, a.p AS p, max(b.turn) AS near FROM parts a JOIN parts b ON a.conv_id = b.conv_id AND a.p = b.p AND b.turn < a.turn
    WHERE a.level IS NOT NULL AND b.level IS NULL AND a.p <> '' GROUP BY ALL) GROUP BY ALL
), most AS (
  SELECT conv_id, turn, level, run, arg_max(near, (votes, near)) AS near FROM votes GROUP BY ALL
), equal AS (
  SELECT a.conv_id AS conv_id, a.turn AS turn, a.level AS level, a.run AS run, max(b.turn) AS equal FROM pas a JOIN whole b ON a.conv_id = b.conv_id AND a.p = b.p AND b.turn < a.turn WHERE b.level IS NULL GROUP BY ALL
), hits AS (
  SELECT pas.conv_id AS conv_id, pas.turn AS turn, pas.level AS level, coalesce(equal, near) AS source FROM pas
  LEFT JOIN equal e ON pas.conv_id = e.conv_id AND pas.turn = e.turn AND pas.level = e.level AND pas.run = e.run LEFT JOIN most v ON pas.conv_id = v.conv_id AND pas.turn = v.turn AND pas.level = v.level AND pas.run = v.run
  WHERE p <> ''
), links AS (
  SELECT conv_id, turn, count(*) AS n_quotes, count(source) AS n_linked, arg_max(source, (-level, source)) FILTER (WHERE source IS NOT NULL) AS quoted FROM hits GROUP BY conv_id, turn
), o AS (
  SELECT m.conv_id AS conv_id, m.turn AS turn, coalesce(m.role, 'user') AS role, body, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked,
    coalesce(quoted, lag(m.turn) OVER (PARTITION BY m.conv_id ORDER BY m.turn)) AS parent
  FROM m JOIN bodies ON m.conv_id = bodies.conv_id AND m.turn = bodies.turn LEFT JOIN links ON m.conv_id = links.conv_id AND m.turn = links.turn
), tree AS (
  SELECT conv_id, turn, [turn] AS path FROM o WHERE parent IS NULL
  UNION ALL SELECT o.conv_id, o.turn, list_append(path, o.turn) FROM o JOIN tree ON o.conv_id = tree.conv_id AND o.parent = tree.turn
)
SELECT o.conv_id AS conv_id, CAST(0 AS BIGINT) AS part, count(*) AS n_messages, CAST(sum(n_quotes) AS BIGINT) AS n_quotes, CAST(sum(n_linked) AS BIGINT) AS n_linked,
  string_agg(CAST(o.turn AS VARCHAR), ',' ORDER BY path) AS turns, string_agg(coalesce(CAST(parent AS VARCHAR), '-'), ',' ORDER BY path) AS parents,
  string_agg('<|' || role || '|>' || chr(10) || body, chr(10) ORDER BY path) AS chat
FROM o JOIN tree ON o.conv_id = tree.conv_id AND o.turn = tree.turn GROUP BY o.conv_id
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict(docs, model, columns=["doc_id"])
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "lang_shares")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with passages that others hold; spans lists first and last word of each, from 0."""
    found = repeated_spans(table(spark, sf_dir, "documents")).where("n_repeated > 0")
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s.start.cast("string"), F.lit("-"), (s.end - 1).cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_repeated", spans.alias("spans"))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM w)
), d AS (SELECT g FROM g GROUP BY g HAVING min(doc_id) <> max(doc_id)),
h AS (SELECT doc_id, i, i + 50 AS e FROM g WHERE g IN (SELECT g FROM d)),
o AS (SELECT *, CASE WHEN i <= lag(e) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM h),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM o),
s AS (SELECT doc_id, min(i) AS a, max(e) AS b FROM k GROUP BY doc_id, island)
SELECT s.doc_id AS doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, CAST(sum(b - a) AS BIGINT) AS n_repeated, string_agg(a || '-' || (b - 1), ',' ORDER BY a) AS spans
FROM s JOIN w ON s.doc_id = w.doc_id GROUP BY s.doc_id
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), pat AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), win AS (
  SELECT doc_id, i, l, array_to_string(w[i : i + l - 1], ' ') AS s
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, (SELECT DISTINCT l FROM pat))
), occ AS (
  SELECT doc_id, i, win.l AS l, item_id FROM win JOIN pat ON win.l = pat.l AND win.s = pat.s
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM occ) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    directory = warc.write(pages)
    keys = pages.select(warc.capture_key(F.col("url"), F.col("page_id")).alias("key"))
    return warc.fetch(directory, keys, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang AS lang, source, t.term AS term, count(*) AS n FROM t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
gn AS (SELECT g.lang AS lang, g.source AS source, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (
  SELECT gn.lang AS lang, gn.source AS source, k.term AS term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.n + v.v) AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v) AS BIGINT) AS q
  FROM gn JOIN v ON gn.lang = v.lang JOIN kept k ON gn.lang = k.lang LEFT JOIN c ON gn.lang = c.lang AND gn.source = c.source AND k.term = c.term
), s AS (
  SELECT a.lang AS lang, a.source AS source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT x.lang AS lang, x.source AS source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON x.lang = s.lang AND x.source = s.source AND y.source = s.item
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || '.,;:!?' || chr(11) || chr(12) || chr(13) || chr(9), 'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 9) || ' ') AS text FROM documents
), w AS (
  SELECT lang, list_filter(string_split(piece, ' '), lambda x: x <> '') AS w FROM (SELECT lang, unnest(string_split(text, chr(10))) AS piece FROM d)
), g AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) t(k))
), f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND n >= 10),
parts AS (
  SELECT lang, phrase, a, cut, array_to_string(w[1 : cut], ' ') AS first, array_to_string(w[cut + 1 : k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)
), cuts AS (
  SELECT p.lang AS lang, p.phrase AS phrase, a, cut, l.n AS l, r.n AS r, CAST((1000000::HUGEINT * a * a) // (l.n::HUGEINT * r.n) AS BIGINT) AS score
  FROM parts p JOIN f l ON p.lang = l.lang AND p.first = l.phrase JOIN f r ON p.lang = r.lang AND p.rest = r.phrase
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, part, max(a) AS held FROM (SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS part FROM c WHERE k = 3) GROUP BY ALL
), kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON b.lang = i.lang AND b.phrase = i.part WHERE held IS NULL OR 100 * held < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang AS lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n ON ranked.lang = n.lang WHERE rank <= 2000
"""


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_jaccard_join, op3_line_dedup, op4_quote_links, op5_language_id, op6_suffix_dedup, op7_token_counts, op8_decontamination, op9_warc, op10_packing, op11_source_divergence, op12_best_fit, op13_collocations)}
ORACLES: dict[str, str] = {"op1_embedding_dedup": OP1_SQL, "op2_jaccard_join": OP2_SQL, "op3_line_dedup": OP3_SQL, "op4_quote_links": OP4_SQL, "op6_suffix_dedup": OP6_SQL, "op8_decontamination": OP8_SQL, "op9_warc": OP9_SQL, "op11_source_divergence": OP11_SQL, "op13_collocations": OP13_SQL}
