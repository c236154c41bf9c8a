"""Operator 3: lines that many documents repeat, found with DataFrame functions only.

Each line long enough becomes a 128-bit hash of its key with its document and position; texts stay where they are. The hashes
are dealt by range, a document's positions of a hash become one row, and the rows are sorted within a partition by hash and document, and streamed: along a hash, the first document in that order
(the largest doc_id) keeps its lines, and the later ones lose theirs once the stream has seen, or sees in the next few rows,
``min_docs`` documents. A row looks at no more than ``min_docs`` neighbours, so nothing is held for a hash however common it is.
The hashes that hold more than one in ``HEAVY`` of all rows, or more than ``MOST_LIGHT`` rows whatever the table's size, would still
be one task's work; counts with partial sums find those (there can't be more than rows / bound), and their rows are decided where
they lie, by a broadcast of their largest doc_id. Beyond ``MOST_BROADCAST`` such hashes, which takes 10**12 lines, they are joined.

The result is a keep bitmap for each document that loses lines: 64 positions to a number, compressed by leaving out the numbers that are all ones.
``apply_bitmaps`` cuts the texts by it; texts of the documents without one stay where they are, unless the ids of the others are too many to broadcast.

Edge cases: a null or empty text is one empty line and keeps it; rows that repeat a doc_id count as one document, and each
of them is cut like it; rows without a doc_id are neither counted nor cut; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import fresh, parts, stored

MIN_CHARS = 40
MIN_DOCS = 5
HEAVY = 1000
LEAST_HEAVY = 1000
ROWS_EACH = 2_000_000
MOST_LIGHT = ROWS_EACH  # rows of a key in one task's stream, however large the table is
MOST_BROADCAST = 500_000
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space of ASCII at both ends, with A-Z lower-cased."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\f\r"))
    # lower() is many times as fast, and the same where all characters are ASCII
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, SMALL))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_mark(doc_id: Column, text: Column) -> Column:
    """Tells apart rows that share a doc_id."""
    return F.xxhash64(doc_id, text)


def keep_bitmaps(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, row_mark, keeps (map from position div 64 to the bits of kept lines, without the numbers that are all ones) for each row that loses lines."""
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where("doc_id is not null")
    seen = (
        source.select("doc_id", row_mark(F.col("doc_id"), F.col("text")).alias("row_mark"), F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("pos", "key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "row_mark", "pos")
    )
    seen = stored(seen, "lines")
    rows = seen.count()
    bound = max(LEAST_HEAVY, min(rows // HEAVY, MOST_LIGHT))
    often = seen.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > bound)
    often = stored(often.select("h1", "h2"), "often")  # fewer than rows / bound
    small = F.broadcast if rows // bound <= MOST_BROADCAST else (lambda df: df)
    heavy = (
        seen.join(small(often), ["h1", "h2"]).select("h1", "h2", "doc_id").distinct()
        .groupBy("h1", "h2").agg(F.max("doc_id").alias("last"), F.count("*").alias("docs"))
        .select("h1", "h2", F.when(F.col("docs") >= min_docs, F.col("last")).alias("last"))
    )
    heavy = stored(heavy, "heavy")
    heavy_drops = seen.join(small(heavy), ["h1", "h2"]).where("doc_id != last").select("doc_id", "row_mark", "pos")
    order = Window.partitionBy("h1", "h2").orderBy(F.desc("doc_id"))
    light = (
        seen.join(small(heavy), ["h1", "h2"], "left_anti")
        .repartitionByRange(parts(rows, ROWS_EACH, int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "h1", "h2")
        .groupBy("h1", "h2", "doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("row_mark", "pos"))).alias("at"))
        .select("doc_id", "at", F.row_number().over(order).alias("k"), F.count("*").over(order.rowsBetween(1, min_docs - 1)).alias("after"))
        .where((F.col("k") > 1) & (F.col("k") + F.col("after") >= min_docs))
        .select("doc_id", F.inline("at"))
    )
    return (
        heavy_drops.unionByName(light)
        .groupBy("doc_id", "row_mark", F.expr("pos div 64").cast("int").alias("word"))
        .agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))"))).alias("bits"))
        .groupBy("doc_id", "row_mark")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("keeps"))
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the lines cut from their text, plus n_lines (before) and n_dropped."""
    made = ["n_lines", "n_dropped"]
    own = [c for c in docs.columns if c not in made]
    id_, mark, keeps = (fresh(c, docs.columns) for c in ("id", "mark", "keeps"))
    b = stored(bitmaps, "bitmaps").select(F.col("doc_id").alias(id_), F.col("row_mark").alias(mark), F.col("keeps").alias(keeps))
    t = F.col(f"`{text}`").cast("string")
    ids = stored(b.select(F.col(id_).alias(doc_id)).distinct(), "ids")
    few = ids.count() <= MOST_BROADCAST
    cut_docs = docs.join(F.broadcast(ids), doc_id, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]) if few else docs
    joined = cut_docs.join(b, (F.col(f"`{doc_id}`") == F.col(id_)) & (row_mark(F.col(f"`{doc_id}`"), t) == F.col(mark)), "left")
    cut = F.expr(f"array_join(filter(split(coalesce(cast(`{text}` as string), ''), '\\n', -1), (x, i) -> (shiftright(coalesce(try_element_at({keeps}, cast(i div 64 as int)), -1L), cast(i % 64 as int)) & 1L) = 1L), '\\n')")
    n_dropped = F.when(F.col(keeps).isNull(), F.lit(0).cast("long")).otherwise(F.expr(f"aggregate(map_values({keeps}), 0L, (a, x) -> a + 64 - bit_count(x))"))
    n_lines = (F.octet_length(F.coalesce(t, F.lit(""))) - F.octet_length(F.replace(F.coalesce(t, F.lit("")), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines")
    out = joined.select(*[(F.when(F.col(keeps).isNull(), F.col(f"`{c}`")).otherwise(cut).alias(c) if c == text else F.col(f"`{c}`")) for c in own], n_lines, n_dropped.alias("n_dropped"))
    if not few:
        return out
    rest = docs.join(F.broadcast(ids), doc_id, "left_anti")
    return out.unionByName(rest.select(*[F.col(f"`{c}`") for c in own], n_lines, F.lit(0).cast("long").alias("n_dropped")))
