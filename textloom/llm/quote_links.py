"""Operator 4: conversations rebuilt from quotations, with DataFrame functions only.

A line that begins with ``>`` marks (blanks between them allowed) is quoted at the level that their number gives. Neighbouring lines of one
level are a passage. The rest of a message is its body; a line like "On ... wrote:" right before a quotation goes with it. Passages, and of each
body the whole, its paragraphs and its lines, are normalised (marks and white space to single blanks, lower case) and
hashed to 128 bits. A passage links to the last earlier message of its conversation with an equal part, found in one ordered pass along
each hash, without pairs. Where the whole passage has no match, its paragraphs, lines and sentences are looked up so, among those of the bodies, and it links
to the message that most of them come from (the later of several). A message replies to the message that its outermost linked passage comes from (the later of several), else to the
one before it.

Reply order is that of threads: a message, then the replies to it in the order of turns, each with all that hangs below it. Turns that follow the one before them
form runs, and a run hangs where its first turn replies; in this order a run comes in one piece, then the runs that hang on it, those on its last turn first. So a
place is the start of the run and the place within. Sizes and starts of runs come by pointer doubling, with as many rounds as the logarithm of the depth and none where
nothing branches; sums along turns go by chunks of ``SPAN`` turns. No step needs a whole conversation in one task.

A conversation of up to ``MOST_MESSAGES`` messages and ``MOST_BYTES`` bytes comes as one row; its texts move once. A larger one comes in rows of ``PART`` messages, by their
place in the whole.

Edge cases: a null text is an empty body; messages without a turn stand before the others, without a parent; messages without a conversation are returned by
``reply_ordered`` without parent and place, and left out by ``conversations``; rows that repeat a conversation and turn share parent and counts, each is a message, and they stand together
(by role and content); rows that repeat a text too are messages, but their quotations count once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import among, discard, stored

SPAN = 4096
MOST_MESSAGES = 4096
MOST_BYTES = 16 << 20
PART = 256
QUOTED = r"^[ \\t]*>[> \\t]*"
WROTE = r"(?i)^[ \\t]*on .*wrote:[ \\t]*$"


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\s>]+", " ")))


def hashed(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def body(text: str) -> Column:
    """The text without quoted lines and the lines that introduce them."""
    lines = f"split(coalesce({text}, ''), '\\n', -1)"
    cut = F.expr(f"trim(BOTH '\\n' FROM array_join(filter({lines}, (x, i) -> not (x rlike '{QUOTED}') and not (x rlike '{WROTE}' and coalesce(get({lines}, i + 1) rlike '{QUOTED}', false))), '\\n'))")
    return F.when(F.contains(F.col(text), F.lit(">")), cut).otherwise(F.expr(f"trim(BOTH '\\n' FROM coalesce({text}, ''))"))


def split_parts(text: Column | str) -> Column:
    """The whole text, its paragraphs and its lines, normalised."""
    return F.array_distinct(F.transform(F.flatten(F.array(F.array(text), F.split(text, r"\n\s*\n", -1), F.split(text, "\n", -1))), normal))


def sentences(parts: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(parts, lambda x: F.split(x, r"(?<=[.!?]) ", -1))))


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, own and run (which passage of the message), level, passage (normalised) and raw (its lines without marks) of each quoted passage."""
    quoting = messages.where(F.expr(f"text rlike '(?m){QUOTED}'")).select("conv_id", "turn", "text").distinct()
    quoted = quoting.select("conv_id", "turn", F.xxhash64("text").alias("own"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    marks = F.regexp_extract("line", r"^[ \t]*(>[> \t]*)", 1)
    lined = quoted.select("conv_id", "turn", "own", "pos", "line", F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"))
    message = Window.partitionBy("conv_id", "turn", "own").orderBy("pos")
    begins = F.when(F.lag("level").over(message) == F.col("level"), 0).otherwise(1)
    runs = lined.withColumn("begins", begins).withColumn("run", F.sum("begins").over(message)).where("level > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n")
    return runs.groupBy("conv_id", "turn", "own", "run", "level").agg(normal(joined).alias("passage"), F.regexp_replace(joined, r"(?m)^[ \t]*>[> \t]*", "").alias("raw")).where("passage != ''")


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, n_quotes, n_linked, quoted_turn (null where nothing links) of messages with quotations. A stored table."""
    found = stored(passages(messages), "passages")
    if found.isEmpty():
        kinds = dict(found.dtypes)
        return messages.sparkSession.createDataFrame([], f"conv_id {kinds['conv_id']}, turn long, n_quotes long, n_linked long, quoted_turn long")
    threads = stored(found.select("conv_id").distinct(), "threads")
    bodies = among(messages, threads, "conv_id").select("conv_id", "turn", body("text").alias("body"))
    key = ["conv_id", "turn", "own", "run", "level"]
    bare = [F.lit(None).cast(t).alias(c) for c, t in (("own", "long"), ("run", "long"), ("level", "int"))]
    marked = lambda parts, whole: F.transform(parts, lambda x: F.struct(x.alias("part"), F.lit(whole).alias("whole")))
    of_body = F.concat(marked(split_parts("body"), True), marked(sentences(split_parts("body")), False))
    of_passage = F.concat(marked(F.array("passage"), True), marked(F.array_distinct(F.concat(split_parts("raw"), sentences(split_parts("raw")))), False))
    parts = bodies.select("conv_id", "turn", *bare, F.inline(of_body)).unionByName(found.select(*key, F.inline(of_passage))).where("part != ''")
    both = parts.select(*key, "whole", *hashed(F.col("part")))
    along = Window.partitionBy("conv_id", "h1", "h2").orderBy("turn", F.col("level").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda which: F.last(F.when(F.col("level").isNull() & which, F.col("turn")), ignorenulls=True).over(along)
    looked = both.select(*key, "whole", before(F.col("whole")).alias("equal"), before(F.lit(True)).alias("near")).where("level is not null")
    votes = looked.groupBy(*key, "near").agg(F.max(F.when(F.col("whole"), F.col("equal"))).alias("equal"), F.sum(F.when(F.col("whole"), 0).otherwise(1)).alias("votes"))
    most = F.max(F.when(F.col("near").isNotNull(), F.struct("votes", "near"))).getField("near")
    linked = votes.groupBy(*key).agg(F.coalesce(F.max("equal"), most).alias("source"))
    nearest = F.max(F.when(F.col("source").isNotNull(), F.struct((-F.col("level")).alias("l"), "source")))
    return stored(linked.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count("source").alias("n_linked"), nearest.getField("source").alias("quoted_turn")), "links")


def sums_before(df: DataFrame, by: list[str], order: str, chunk: Column, **values: Column) -> DataFrame:
    """Adds, for each name, the sum (or, for a name that begins with last, the greatest) of the values before this row in the order, within its ``by`` group. The
    order goes with the chunk, so a window holds a chunk or the chunks' sums."""
    fold = {name: F.max if name.startswith("last") else F.sum for name in values}
    own = df.withColumn("__chunk", chunk).withColumns({f"__{k}": v for k, v in values.items()})
    earlier = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy(*by, "__chunk").agg(*[fold[k](f"__{k}").alias(f"__{k}") for k in values])
    totals = totals.select(*by, "__chunk", *[fold[k](f"__{k}").over(earlier).alias(f"__carried_{k}") for k in values])
    out = own.withColumns({f"__{k}": fold[k](f"__{k}").over(inside) for k in values}).join(totals, [*by, "__chunk"])
    both = {k: F.coalesce(f"__{k}", f"__carried_{k}") if k.startswith("last") else F.coalesce(f"__{k}", F.lit(0)) + F.coalesce(f"__carried_{k}", F.lit(0)) for k in values}
    return out.select(*df.columns, *[v.alias(k) for k, v in both.items()])


def threads(turns: DataFrame, quoting: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn and place (of the first message of the turn) for distinct turns (conv_id, turn, n: its messages)."""
    chunk = F.floor(F.col("turn") / SPAN)
    own = sums_before(turns, ["conv_id"], "turn", chunk, at=F.col("n"), last=F.col("turn"))
    own = own.join(quoting.select("conv_id", "turn", "quoted_turn"), ["conv_id", "turn"], "left")
    own = own.select("conv_id", "turn", "n", "at", F.coalesce("quoted_turn", "last").alias("parent_turn"), (F.col("last").isNull() | (F.col("quoted_turn") != F.col("last"))).alias("opens"))
    own = own.withColumn("opens", F.coalesce("opens", F.lit(False)))
    own = sums_before(own, ["conv_id"], "turn", chunk, last_run=F.when(F.col("opens"), F.col("turn")))
    own = stored(own.withColumn("run", F.when(F.col("opens"), F.col("turn")).otherwise(F.col("last_run"))).drop("last_run", "opens"), "turns")
    heads = own.where("turn = run").select("conv_id", "run", F.col("parent_turn").alias("hook"), F.col("at").alias("begins"))
    hooks = own.select("conv_id", F.col("turn").alias("hook"), F.col("run").alias("up"))
    runs = stored(own.groupBy("conv_id", "run").agg(F.sum("n").alias("n")).join(heads, ["conv_id", "run"]).join(hooks, ["conv_id", "hook"], "left"), "runs")
    starts = runs.select("conv_id", "run", F.lit(0).cast("long").alias("start"))
    if not runs.where("up is not null").isEmpty():
        sizes = doubled(runs.select("conv_id", "run", "up", F.col("n").alias("value")), up=False).withColumnRenamed("value", "size")
        hung = runs.where("up is not null").select("conv_id", "run", "hook", "up").join(sizes, ["conv_id", "run"])
        of_hook = hung.groupBy("conv_id", "up", "hook").agg(F.sum("size").alias("size")).withColumn("back", -F.col("hook"))
        hooks = sums_before(of_hook, ["conv_id", "up"], "back", F.floor(F.col("back") / SPAN), later=F.col("size")).select("conv_id", "hook", "later")
        placed = sums_before(hung, ["conv_id", "up", "hook"], "run", F.floor(F.col("run") / SPAN), sooner=F.col("size")).join(hooks, ["conv_id", "hook"])
        above = runs.select("conv_id", F.col("run").alias("up"), F.col("n").alias("length"))
        moved = placed.join(above, ["conv_id", "up"]).select("conv_id", "run", "up", (F.col("length") + F.col("later") + F.col("sooner")).alias("value"))
        roots = runs.where("up is null").select("conv_id", "run", "up", F.lit(0).cast("long").alias("value"))
        starts = doubled(moved.unionByName(roots), up=True).withColumnRenamed("value", "start")
    placed = own.join(runs.select("conv_id", "run", "begins").join(starts, ["conv_id", "run"]), ["conv_id", "run"])
    return placed.select("conv_id", "turn", "parent_turn", (F.col("start") + F.col("at") - F.col("begins")).alias("place"))


def doubled(runs: DataFrame, up: bool) -> DataFrame:
    """conv_id, run and the sum of ``value`` over the run and all runs above it (``up``), or all below it. ``up`` names the run that each hangs on; with each round it
    names one twice as far away."""
    own = stored(runs, "tree")
    while not own.where("up is not null").isEmpty():
        far = own.select("conv_id", F.col("run").alias("up"), F.col("up").alias("next"), F.col("value").alias("more"))
        jumped = own.join(far, ["conv_id", "up"], "left")
        if up:
            after = jumped.select("conv_id", "run", F.col("next").alias("up"), (F.col("value") + F.coalesce("more", F.lit(0))).alias("value"))
        else:
            below = own.where("up is not null").groupBy("conv_id", F.col("up").alias("run")).agg(F.sum("value").alias("below"))
            after = jumped.join(below, ["conv_id", "run"], "left").select("conv_id", "run", F.col("next").alias("up"), (F.col("value") + F.coalesce("below", F.lit(0))).alias("value"))
        before, own = own, stored(after, "tree")
        discard(before)
    return own.select("conv_id", "run", "value")


def columns_of(messages: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    return messages.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").cast("string").alias("text"))


def counted(messages: DataFrame) -> DataFrame:
    return messages.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.count("*").alias("n"))


def reply_ordered(messages: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each message: conv_id, turn, role, content (its body), n_quotes, n_linked, parent_turn, and place (from 0, in the reply order of its conversation)."""
    own = columns_of(messages, conv_id, turn, role, text)
    quoting = links(own.where("conv_id is not null and turn is not null"))
    return in_place(own, threads(counted(own), quoting), quoting)


def in_place(own: DataFrame, order: DataFrame, quoting: DataFrame) -> DataFrame:
    facts = stored(order.join(quoting.drop("quoted_turn"), ["conv_id", "turn"], "left"), "places")
    rows = own.select("conv_id", "turn", "role", body("text").alias("content")).join(facts, ["conv_id", "turn"], "left")
    together = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "content")) - 1
    zero = F.lit(0).cast("long")
    return rows.select("conv_id", "turn", "role", "content", F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"), "parent_turn", F.when(F.col("place").isNotNull(), F.col("place") + together).alias("place"))


def conversations(messages: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most_messages: int = MOST_MESSAGES, most_bytes: int = MOST_BYTES, part: int = PART) -> DataFrame:
    """conv_id, part, n_messages, n_quotes, n_linked and messages, an array of turn, parent_turn, role and content in reply order. Part is 0 and the conversation whole up to
    ``most_messages`` messages and ``most_bytes`` bytes; larger ones have a row for every ``part`` messages of their order (messages without a turn in parts
    below 0). Messages without a conv_id are left out."""
    own = columns_of(messages, conv_id, turn, role, text).where("conv_id is not null")
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"))
    large = stored(sizes.where((F.col("n") > most_messages) | (F.col("bytes") > most_bytes)).select("conv_id", "n"), "large")
    quoting = links(own.where("turn is not null"))
    none = quoting.isEmpty()
    rows = among(own, large.select("conv_id"), "conv_id", "left_anti").select("conv_id", F.struct("turn", "role", body("text").alias("content")).alias("m"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    if none:
        grouped = grouped.withColumn("facts", F.lit(None).cast("map<bigint,struct<place:bigint,parent_turn:bigint,n_quotes:bigint,n_linked:bigint>>"))
    else:
        known = stored(quoting.select("conv_id").distinct(), "threads")
        order = threads(counted(among(own, known, "conv_id")), quoting).join(quoting.drop("quoted_turn"), ["conv_id", "turn"], "left")
        facts = F.struct("turn", F.struct("place", "parent_turn", "n_quotes", "n_linked"))
        of_small = among(order, large.select("conv_id"), "conv_id", "left_anti").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(facts)).alias("facts"))
        grouped = grouped.join(of_small, "conv_id", "left")
    turns = F.array_sort(F.array_distinct(F.filter(F.transform("ms", lambda m: m.turn), lambda t: t.isNotNull())))
    grouped = grouped.withColumn("turns", turns)
    known_of = lambda t: F.when(F.col("facts").isNotNull() & t.isNotNull(), F.try_element_at("facts", t))
    before = lambda t: F.when(t.isNotNull() & (t != F.get("turns", 0)), F.get("turns", F.array_position("turns", t).cast("int") - 2))
    placed = F.transform("ms", lambda m: F.struct(known_of(m.turn).place.alias("place"), m.turn.alias("turn"), F.when(F.col("facts").isNotNull(), known_of(m.turn).parent_turn).otherwise(before(m.turn)).alias("parent_turn"), m.role.alias("role"), m.content.alias("content")))
    total = lambda c: F.coalesce(F.aggregate(F.map_values("facts"), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x[c], F.lit(0))), F.lit(0).cast("long"))
    array = lambda ms: F.transform(F.sort_array(ms), lambda m: F.struct(m.turn, m.parent_turn, m.role, m.content))
    small = grouped.select("conv_id", F.lit(0).cast("long").alias("part"), F.size("ms").cast("long").alias("n_messages"), total("n_quotes").alias("n_quotes"), total("n_linked").alias("n_linked"), array(placed).alias("messages"))
    if large.isEmpty():
        return small
    much = among(own, large.select("conv_id"), "conv_id")
    rows = in_place(much, threads(counted(much), quoting), quoting).join(large, "conv_id")
    split = F.coalesce(F.floor(F.col("place") / part), -1 - F.pmod(F.xxhash64("role", "content"), F.ceil(F.col("n") / part)))
    first = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("place")) == 1  # rows that share a turn share its counts
    rows = rows.withColumns({"part": split, "counts": F.col("turn").isNotNull() & first})
    counts = lambda c: F.sum(F.when(F.col("counts"), F.col(c)).otherwise(0)).alias(c)
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n_messages"), counts("n_quotes"), counts("n_linked"), array(F.collect_list(F.struct("place", "turn", "parent_turn", "role", "content"))).alias("messages"))
    return small.unionByName(parts)


def chat_text(messages: str = "messages") -> Column:
    """``<|role|>`` and the content of each message, each on lines of its own."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), F.coalesce(m.role, F.lit("user")), F.lit("|>\n"), m.content)), "\n")
