import random
import re
from collections import Counter

from textloom.llm import quote_links as Q


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, content string")
    return {(r.conv_id, r.turn, r.role): r for r in Q.reply_ordered(df).collect()}


ROWS = [
    (1, 0, "a", "First point here.\n\nSecond  POINT here.", ""),
    (1, 1, "b", "Another thing.", ""),
    (1, 2, "c", "On Monday a wrote:\n> second point\n> here.\nI agree.", ""),
    (1, 3, "d", ">> First point here.\n> I agree.\n\nMe too", ""),
    (1, 4, "e", "> never written\nWhat?", ""),
    (1, 9, "f", " > > another thing.\n>  me too\nDone", ""),
    (2, 0, "a", "> I agree.\nother thread", ""),
    (2, 1, "b", None, ""),
    (2, 1, "x", "twice", ""),
    (None, 1, "n", "> q\nno thread", ""),
    (3, None, "n", "no turn", ""),
    (4, 0, "a", "", ""),
]


def test_links_levels_and_bodies(spark):
    got = run(spark, ROWS)
    show = {k[2] if k[0] == 1 else k: (r.parent_turn, r.n_quotes, r.n_linked, r.content) for k, r in got.items()}
    assert show["a"] == (None, 0, 0, "First point here.\n\nSecond  POINT here.")
    assert show["b"] == (0, 0, 0, "Another thing.")
    assert show["c"] == (0, 1, 1, "I agree.")
    assert show["d"] == (2, 2, 2, "Me too")
    assert show["e"] == (3, 1, 0, "What?")
    assert show["f"] == (3, 2, 2, "Done")
    assert show[(2, 0, "a")] == (None, 1, 0, "other thread")
    assert show[(2, 1, "b")][0] == 0 and show[(2, 1, "b")][3] == "" and show[(2, 1, "x")][0] == 0
    assert show[(None, 1, "n")] == (None, 0, 0, "no thread")
    assert show[(3, None, "n")][0] is None and show[(4, 0, "a")][3] == ""
    assert len(got) == len(ROWS)


def test_trimmed_quotations(spark):
    rows = [
        (1, 0, "a", "One is here.\n\nTwo is here.\n\nThree is here.", ""),
        (1, 1, "b", "A line to begin with\nand one to go on\nand a last one", ""),
        (1, 2, "c", "First sentence. Second, a longer one! And a third?", ""),
        (1, 3, "d", "Between.", ""),
        (1, 4, "e", "> Two is here.\n>\n> Three is here.\nyes", ""),
        (1, 5, "f", "> A line to begin with\n> and one to go on\nso", ""),
        (1, 6, "g", "> Second, a\n> longer one!\nno", ""),
        (1, 7, "h", "> never said\nwhat", ""),
    ]
    got = {k[1]: (r.parent_turn, r.n_quotes, r.n_linked) for k, r in run(spark, rows).items()}
    assert [got[t] for t in (4, 5, 6, 7)] == [(0, 1, 1), (1, 1, 1), (2, 1, 1), (6, 1, 0)]


def parts_of(text):
    own = [text, *re.split(r"\n\s*\n", text), *text.split("\n")]
    return {normal(x) for x in own}


def normal(text):
    return re.sub(r"[\s>]+", " ", text).strip().lower()


def sentences(parts):
    return {y for x in parts for y in re.split(r"(?<=[.!?]) ", x)}


def brute(rows):
    """For each conversation its messages in reply order, and the counts: one loop over turns, one walk over the tree."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: r[1])
        bodies, parent, counts, said = {}, {}, [0, 0], []
        for r in own:
            lines = (r[3] or "").split("\n")
            quoted = [bool(re.match(r"[ \t]*>", x)) for x in lines]
            kept = [x for i, x in enumerate(lines) if not quoted[i] and not (re.match(r"(?i)[ \t]*on .*wrote:[ \t]*$", x) and i + 1 < len(lines) and quoted[i + 1])]
            bodies[id(r)] = "\n".join(kept).strip("\n")
        turns = sorted({r[1] for r in own})
        for turn in turns:
            linked = []
            for text in {r[3] for r in own if r[1] == turn}:
                level, found = 0, []
                for line in (text or "").split("\n"):
                    marks = re.match(r"[ \t]*(>[> \t]*)", line)
                    now = marks[1].count(">") if marks else 0
                    if now and now != level:
                        found.append((now, []))
                    if now:
                        found[-1][1].append(line)
                    level = now
                for level, lines in found:
                    passage = normal("\n".join(lines))
                    if not passage:
                        continue
                    counts[0] += 1
                    whole = [t for t, b in said if passage in parts_of(b)]
                    if not whole:
                        pieces = parts_of("\n".join(re.sub(r"^[ \t]*>[> \t]*", "", x) for x in lines))
                        near = Counter(max(c) for x in pieces | sentences(pieces) if x and (c := [t for t, b in said if x in parts_of(b) | sentences(parts_of(b))]))
                        whole = [max(near, key=lambda t: (near[t], t))] if near else []
                    if whole:
                        counts[1] += 1
                        linked.append((-level, max(whole)))
            before = [t for t in turns if t < turn]
            parent[turn] = max(linked)[1] if linked else before[-1] if before else None
            said += [(turn, bodies[id(r)]) for r in own if r[1] == turn]
        order = []
        todo = [t for t in turns if parent[t] is None][::-1]
        while todo:
            t = todo.pop()
            order += [(t, parent[t], role, content) for role, content in sorted((r[2], bodies[id(r)]) for r in own if r[1] == t)]
            todo += [x for x in turns if parent[x] == t][::-1]
        out[conv] = (order, *counts)
    return out


def threads(seed, sizes):
    """Random conversations: plain turns, quotations of earlier messages at one or two levels, whole or cut, of distant ones too, some rows and turns twice."""
    rng = random.Random(seed)
    rows = []
    for conv, size in enumerate(sizes):
        said = []
        for turn in range(size):
            body = "\n\n".join("\n".join(f"Line {rng.randrange(400)} of c{conv} here. And {rng.randrange(50)} more!" for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 2)))
            text = body
            if said and rng.random() < 0.4:
                quoted = said[rng.choice([-1, -1, rng.randrange(len(said)), max(-len(said), -3)])]
                lines = quoted.split("\n")
                lines = lines[rng.randrange(len(lines)) :] if rng.random() < 0.3 else [x for x in lines]
                passage = "\n".join("> " + x for x in lines)
                if len(said) > 1 and rng.random() < 0.4:
                    passage = "\n".join(">> " + x for x in said[rng.randrange(len(said))].split("\n")) + "\n" + passage
                text = rng.choice(["", "On Tuesday x wrote:\n"]) + passage + "\n" + body
            if rng.random() < 0.05:
                text = "> nobody said this\n" + body
            rows.append((conv, turn * (3 if conv % 2 else 1), rng.choice("uab"), text, ""))
            said.append(body)
            if rng.random() < 0.05:
                rows.append(rows[-1])
            if rng.random() < 0.03:
                rows.append((*rows[-1][:3], "another at that turn", ""))
    return rows


def rebuilt(df, **more):
    out = {}
    for r in Q.conversations(df, **more).orderBy("conv_id", "part").collect():
        own = out.setdefault(r.conv_id, ([], 0, 0))
        out[r.conv_id] = (own[0] + [(m.turn, m.parent_turn, m.role, m.content) for m in r.messages], own[1] + r.n_quotes, own[2] + r.n_linked)
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(Q, "SPAN", 8)  # read on the driver, where the columns are made
    rows = threads(5, [1, 2, 3, 8, 8, 12, 20, 40, 150])
    want = brute(rows)
    assert sum(x[2] for x in want.values()) > 60 and any(b - a > 1 for o, _, _ in want.values() for (a, *_), (b, *_) in zip(o, o[1:], strict=False))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, content string").repartition(3)
    assert rebuilt(df) == want
    assert rebuilt(df, most_messages=10, part=7) == want  # in parts
    assert {r.part for r in Q.conversations(df, most_messages=10, part=7).where("conv_id = 8").collect()} == set(range(-(-len(want[8][0]) // 7)))
    placed = {}
    for r in Q.reply_ordered(df).orderBy("conv_id", "place").collect():
        placed.setdefault(r.conv_id, []).append((r.turn, r.parent_turn, r.role, r.content))
    assert placed == {k: v[0] for k, v in want.items()}


def test_a_hot_conversation(spark):
    rng = random.Random(8)
    rows = [(1, t, "u", (f"> message {rng.randrange(t)}\n" if t and rng.random() < 0.2 else "") + f"message {t}", "") for t in range(9000)] + [(c, t, "u", "hello", "") for c in range(2, 500) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, content string").repartition(8)
    parts = Q.conversations(df).where("conv_id = 1").orderBy("part").collect()
    assert [len(p.messages) for p in parts] == [256] * 35 + [40]
    order = [m for p in parts for m in p.messages]
    parent = {m.turn: m.parent_turn for m in order}
    children = {}
    for t in range(9000):
        quoted = re.match("> message (\\d+)", rows[t][3])
        assert parent[t] == (int(quoted[1]) if quoted else t - 1 if t else None)
        children.setdefault(parent[t], []).append(t)
    walk, todo = [], [0]
    while todo:
        walk.append(todo.pop())
        todo += children.get(walk[-1], [])[::-1]
    assert [m.turn for m in order] == walk


def test_sql_on_quotations(spark):
    import duckdb

    from textloom.llm.queries import OP4_SQL

    rows = [r for r in {(r[0], r[1]): r for r in threads(7, [3, 8, 8, 12, 20, 40])}.values()]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, content string")
    conversations = df.drop("content").toPandas()  # noqa: F841  DuckDB reads it
    want = {r[0]: r[1:] for r in duckdb.sql(OP4_SQL.replace("count(*) AS n_messages, ", "")).select("conv_id, n_quotes, n_linked, turns, parents, chat").fetchall()}
    found = Q.conversations(df).select("conv_id", "n_quotes", "n_linked", "messages", Q.chat_text().alias("chat")).collect()
    got = {r.conv_id: (r.n_quotes, r.n_linked, ",".join(str(m.turn) for m in r.messages), ",".join("-" if m.parent_turn is None else str(m.parent_turn) for m in r.messages), r.chat) for r in found}
    assert got == want and sum(x[1] for x in want.values()) > 10


def test_nulls_stand_first(spark):
    df = spark.createDataFrame([(1, None, "b", "late"), (1, 0, "a", "x"), (1, 1, "a", "> x\ny"), (1, None, "a", None), (None, 1, "a", "z")], "conv_id long, turn long, role string, text string")
    for most in (100, 2):
        rows = Q.conversations(df, most_messages=most, part=10).orderBy("part").collect()
        assert sorted([(m.turn, m.parent_turn, m.content) for r in rows for m in r.messages], key=str) == sorted([(None, None, ""), (None, None, "late"), (0, None, "x"), (1, 0, "y")], key=str)
        assert sum(r.n_linked for r in rows) == 1


def test_nothing_and_plan(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = Q.conversations(df)
    assert out.count() == 0 and Q.reply_ordered(df).count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
