"""Conversation structure repair by Knuth's lightest derivation.

A conversation is damaged by a rule (for tests of the repair), its faults are counted, and the cheapest
edits are found that turn the initials of its roles into ``(s?(ua)+)?``. Items are weighted deductions:

* [i, q]: the first i rows are repaired and the roles so far end in state q (nothing, s, u or a);
* [i, q] and an edit of row i (keep, rerole, delete) give [i + 1, q'];  [i, q] and an insertion give [i, q'].

The weight of a derivation is (cost, audit), audit being the initials of its edits in order; the function of
every rule adds costs and joins audits. It is superior (no result is below an antecedent) and monotone: two
audits of one item with equal costs are never prefixes of each other, since a longer one would hold a further
insertion. So items popped from the agenda by (cost, audit) are final, until the goal is.

The same deductions join parts: a conversation is sorted over range partitions and cut into parts of at most
``PART`` rows, each of which gives the lightest derivation from any state to any state. Parts are folded
``FAN`` at a time, [part k, q] and [q -> q' in part k] giving [part k + 1, q'], until one is left, and its
choice of states is handed down again. No conversation meets in one task for that; only its SHA-256, which
has no parts, takes the texts of a conversation one by one in order through a task that holds one at a time.

Defined cases: nulls of any column count as one space, but rows with a null conv_id are a conversation and
null turns come first; rows of one turn are ordered by role and the SHA-256 of their text; an empty role has no
initial and cannot be kept; rows may be repeated and count as duplicates; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

#: White space, states with the role initials they allow, and the roles of new rows.
SPACE = " \t\n\x0b\x0c\r"
NEXT = {"0": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}
ROLES = {"u": "user", "a": "assistant"}
STATES, ACCEPTED = "0SUA", "0A"
PART, FAN = 256, 64
KEYS = ["conv_id", "turn", "role", "digest"]
COUNTS = "rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"
CELLS = "cells array<struct<start:string,end:string,cost:long,audit:string,path:string>>"

Weight = tuple[int, str, str]


def lightest(starts: Iterable[tuple[Weight, tuple]], deduce: Callable[[tuple], Iterable[tuple[Weight, tuple]]], goals: set, all_goals: bool) -> dict:
    """The lightest weights of ``goals``: of the first that becomes final, or of all that can be derived."""
    agenda, final, found = [(*w, item) for w, item in starts], set(), {}
    heapq.heapify(agenda)
    while agenda:
        cost, audit, path, item = heapq.heappop(agenda)
        if item in final:
            continue
        final.add(item)
        if item in goals:
            found[item] = (cost, audit, path)
            if not all_goals or len(found) == len(goals):
                break
        for (more, letters, states), to in deduce(item):
            if to not in final:
                heapq.heappush(agenda, (cost + more, audit + letters, path + states, to))
    return found


def insertions(state: str) -> list[tuple[Weight, str]]:
    return [((2, "I", ""), NEXT[state][x]) for x in ROLES if x in NEXT[state]]


def edits(state: str, initial: str, fault: str) -> list[tuple[Weight, str]]:
    """The edits of one row, and the states they lead to."""
    out = [((3, "D", ""), state)]
    if fault not in ("blank", "duplicate"):
        more = int(fault == "truncated")
        if initial in NEXT[state]:
            out.append(((more, "K", ""), NEXT[state][initial]))
        out += [((2 + more, "R", ""), NEXT[state][x]) for x in ROLES if x in NEXT[state]]
    return out


def repaired_part(rows: list[tuple[str, str]], starts: str, whole: bool) -> list[dict]:
    """Lightest derivations over rows (initial, fault); of a whole conversation just the one of its goal."""
    def deduce(item):
        i, state = item
        for weight, to in insertions(state):
            yield weight, (i, to)
        if i < len(rows):
            for weight, to in edits(state, *rows[i]):
                yield weight, (i + 1, to)

    goals = {(len(rows), q) for q in (ACCEPTED if whole else STATES)}
    return [{"start": q, "end": end, "cost": w[0], "audit": w[1], "path": ""} for q in starts for (_, end), w in lightest([((0, "", ""), (0, q))], deduce, goals, not whole).items()]


def folded(parts: list[list[dict]], starts: str) -> list[dict]:
    """The cells of consecutive parts taken together; their paths name the states between parts."""
    by_start = [{q: [c for c in cells if c["start"] == q] for q in STATES} for cells in parts]

    def deduce(item):
        k, state = item
        if k < len(parts):
            for c in by_start[k][state]:
                yield (c["cost"], c["audit"], c["end"]), (k + 1, c["end"])

    goals = {(len(parts), q) for q in STATES}
    return [{"start": q, "end": end, "cost": w[0], "audit": w[1], "path": w[2]} for q in starts for (_, end), w in lightest([((0, "", q), (0, q))], deduce, goals, True).items()]


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows that the damage leaves, with ``copies``, and the digest of each text."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("_d")).where("_d <> 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_d") == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def marked(rows: DataFrame) -> DataFrame:
    """A narrow row (keys, copy, initial, fault) for each row, without its text."""
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    own = F.when(end == "", "blank").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    once = rows.withColumn("own", own).groupBy(*KEYS, "own").agg(F.sum("copies").alias("n"))
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = once.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("place")).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "place")
    seen = once.join(first, once["conv_id"].eqNullSafe(first["c"]) & (once["role"] == first["r"]) & (once["digest"] == first["d"]))
    each = seen.withColumn("original", F.col("place").eqNullSafe(place)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    fault = F.when((F.col("own") != "blank") & ~(F.col("original") & (F.col("copy") == 1)), "duplicate").otherwise(F.col("own"))
    return each.select(*KEYS, "copy", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def counts_of(rows: list[tuple[str, str]], turns: list[int | None]) -> dict:
    faults, known = [f for _, f in rows], [t for t in turns if t is not None]
    illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:], strict=False))
    return {"rows": len(rows), **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")}, "illegal": illegal, "first": rows[0][0], "last": rows[-1][0],
            "low": known[0] if known else None, "high": known[-1] if known else None, "turns": len(set(known))}


def added(a: dict, b: dict) -> dict:
    """Counts of two consecutive parts together."""
    out = {f: a[f] + b[f] for f in ("rows", "blank", "duplicate", "truncated")}
    same = a["high"] is not None and a["high"] == b["low"]
    return out | {"illegal": a["illegal"] + b["illegal"] + (a["last"] + b["first"] not in ("su", "ua", "au")), "first": a["first"], "last": b["last"], "low": b["low"] if a["low"] is None else a["low"],
                  "high": a["high"] if b["high"] is None else b["high"], "turns": a["turns"] + b["turns"] - same}


def parts_of(rows: DataFrame, part: int = PART) -> DataFrame:
    """A row for each part of a conversation: its place, counts, cells and the keys of its rows."""
    order = [*KEYS, "copy"]
    kind = dict(rows.dtypes)["conv_id"]
    shape = f"conv_id {kind}, task int, no long, {COUNTS}, {CELLS}, keys array<struct<turn:long,role:string,digest:binary>>"

    def run(batches):
        task, no, out = TaskContext.get().partitionId(), 0, []
        conv, rows, keys, fresh = None, [], [], False  # the first conversation of a task may have begun in an earlier one

        def close(ended: bool):
            nonlocal no
            cells = repaired_part(rows, "0" if fresh else STATES, fresh and ended)
            out.append({"conv_id": conv, "task": task, "no": no, **counts_of(rows, [k["turn"] for k in keys]), "cells": cells, "keys": list(keys)})
            no += 1
            rows.clear()
            keys.clear()

        started = False
        for b in batches:
            for c, turn, role, digest, _, initial, fault in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if started and c != conv:
                    close(True)
                    fresh = True
                elif len(rows) >= part:
                    close(False)
                    fresh = False
                conv, started = c, True
                rows.append((initial, fault))
                keys.append({"turn": turn, "role": role, "digest": digest})
            if len(out) >= 500:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out.clear()
        if rows:
            close(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    arrow = arrow_shape(shape, rows)
    return rows.select(*order, "initial", "fault").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, shape)


def arrow_shape(shape: str, df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], shape).schema)


def fold_level(parts: DataFrame, fan: int) -> DataFrame:
    """``fan`` consecutive parts of each conversation as one; ``place`` numbers the parts of a conversation."""
    shape = f"conv_id {dict(parts.dtypes)['conv_id']}, place long, {COUNTS}, {CELLS}"
    names = [c.split()[0] for c in COUNTS.split(", ")]
    arrow = arrow_shape(shape, parts)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        total = {n: rows[0][n] for n in names}
        for r in rows[1:]:
            total = added(total, r)
        place = rows[0]["place"] // fan
        cells = folded([r["cells"] for r in rows], "0" if place == 0 else STATES)
        return pa.Table.from_pylist([{"conv_id": rows[0]["conv_id"], "place": place, **total, "cells": cells}], arrow)

    grouped = parts.withColumn("group", F.expr(f"place div {fan}")).groupBy("conv_id", "group")
    return grouped.applyInArrow(run, shape)


def goal() -> Column:
    """The lightest of a conversation's cells that start with nothing and end in an accepted state."""
    cells = F.filter("cells", lambda c: (c["start"] == "0") & c["end"].isin(*ACCEPTED))
    return F.array_min(F.transform(cells, lambda c: F.struct(c["cost"].alias("cost"), c["audit"].alias("audit"), c["path"].alias("path"), c["end"].alias("end"))))


def by_place(parts: DataFrame) -> DataFrame:
    """``parts`` with ``place``, their number within the conversation from 0, and ``many``, how many it has.

    A conversation has a part for each 256 rows, and one more for each task it spans.
    """
    at = F.array_sort(F.collect_list(F.struct("task", "no")))
    places = parts.groupBy("conv_id").agg(at.alias("_at")).select(F.col("conv_id").alias("_c"), F.size("_at").alias("many"), F.posexplode("_at").alias("place", "_p"))
    joined = parts.join(places, parts["conv_id"].eqNullSafe(places["_c"]) & (parts["task"] == F.col("_p.task")) & (parts["no"] == F.col("_p.no")))
    return joined.select(*parts.columns, F.col("place").cast("long").alias("place"), "many")


def same_conversation(a: DataFrame, b: DataFrame, other: str = "_c") -> Column:
    return a["conv_id"].eqNullSafe(b[other])


def solved(parts: DataFrame, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(conversations with counts and ``goal``), (parts with the states they go from and to)."""
    names = [c.split()[0] for c in COUNTS.split(", ")]
    single = parts.where("many = 1")
    levels = [parts.where("many > 1").select("conv_id", "place", *names, "cells")]
    while (levels[-1].agg(F.max("place")).first()[0] or 0) > 0:
        levels.append(stored(fold_level(levels[-1], fan)))
    tops = single.select("conv_id", *names, goal().alias("goal"))
    chosen = single.select("conv_id", "place", F.lit("0").alias("start"), goal()["end"].alias("end"))
    if len(levels) > 1:
        top = levels[-1].select("conv_id", "place", *names, goal().alias("goal"))
        tops = tops.unionByName(top.drop("place"))
        down = top.select("conv_id", "place", F.lit("0").alias("start"), F.col("goal.end").alias("end"))
        for level in levels[:0:-1]:
            asked = down.select(F.col("conv_id").alias("_c"), F.col("place").alias("_p"), F.col("start").alias("_s"), F.col("end").alias("_e"))
            met = level.join(asked, same_conversation(level, asked) & (F.col("place") == F.col("_p"))).select("conv_id", "place", picked().alias("cell"))
            steps = met.select("conv_id", "place", F.split("cell.path", "").alias("p")).select("conv_id", "place", F.posexplode(F.expr("transform(sequence(1, size(p) - 1), i -> struct(p[i - 1] AS start, p[i] AS end))")).alias("i", "s"))
            down = steps.select("conv_id", (F.col("place") * fan + F.col("i")).alias("place"), "s.start", "s.end")
        chosen = chosen.unionByName(down)
    return tops, chosen


def picked() -> Column:
    """The cell between the states ``_s`` and ``_e``."""
    return F.get(F.filter("cells", lambda c: (c["start"] == F.col("_s")) & (c["end"] == F.col("_e"))), F.lit(0))


def actions(parts: DataFrame, chosen: DataFrame) -> DataFrame:
    """(keys, place, i, act): the edits at every row, insertions before it and, after the last of a part, behind it."""
    asked = chosen.select(F.col("conv_id").alias("_c"), F.col("place").alias("_p"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    cells = parts.join(asked, same_conversation(parts, asked) & (parts["place"] == F.col("_p"))).select("conv_id", "place", "keys", picked()["audit"].alias("audit"))
    acts = F.regexp_extract_all("audit", F.lit("(I*[KRD](?:I+$)?)"), F.lit(1))
    each = cells.select("conv_id", "place", F.posexplode(F.arrays_zip("keys", acts.alias("acts"))).alias("i", "r"))
    return each.select("conv_id", "r.keys.turn", "r.keys.role", "r.keys.digest", "place", "i", F.col("r.acts").alias("act"))


def hashes(rows: DataFrame, acts: DataFrame) -> DataFrame:
    """(conv_id, sha): SHA-256 of the repaired rows of every conversation, streamed in order."""
    kind = dict(rows.dtypes)["conv_id"]
    texts = rows.select(*KEYS, F.lit(-1).cast("long").alias("place"), F.lit(0).alias("i"), "text", F.lit(None).cast("string").alias("act"))
    both = texts.unionByName(acts.select(*KEYS, "place", "i", F.lit(None).cast("string").alias("text"), "act"))
    shape = f"conv_id {kind}, sha string"
    arrow = arrow_shape(shape, rows)

    def run(batches):
        out, conv, sha, state, text = [], None, None, "0", None
        begun = False

        def write(line: str):
            nonlocal begun
            sha.update((("\n" if begun else "") + line).encode())
            begun = True

        for b in batches:
            for c, role, own, act in zip(*(x.to_pylist() for x in (b.column(0), b.column(2), b.column(6), b.column(7))), strict=True):
                if sha is None or c != conv:
                    if sha is not None:
                        out.append({"conv_id": conv, "sha": sha.hexdigest()})
                    conv, sha, state, begun = c, hashlib.sha256(), "0", False
                if act is None:
                    text = own  # acts on rows of these keys follow
                    continue
                for letter in act:
                    if letter == "D":
                        continue
                    to = next(x for x in ("ua" if letter in "IR" else role[:1]) if x in NEXT[state])
                    state = NEXT[state][to]
                    write(f"{role if letter == 'K' else ROLES[to]}:{'' if letter == 'I' else text}")
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out.clear()
        if sha is not None:
            out.append({"conv_id": conv, "sha": sha.hexdigest()})
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    order = [*KEYS, "place", "i"]
    return both.select(*order, "text", "act").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, shape)


def repair(conversations: DataFrame, part: int = PART, fan: int = FAN) -> DataFrame:
    """One row per conv_id of ``conversations``: faults, cost and audit of the cheapest repair, hash of what it gives."""
    rows = damaged(conversations)
    parts = stored(parts_of(marked(rows), part))
    placed = by_place(parts)
    tops, chosen = solved(placed, fan)
    sha = hashes(rows, actions(placed, chosen)).withColumnRenamed("conv_id", "_h")
    tops = tops.withColumnRenamed("conv_id", "_c")
    ids = conversations.select("conv_id").distinct()
    found = ids.join(tops, same_conversation(ids, tops), "left").join(sha, ids["conv_id"].eqNullSafe(sha["_h"]), "left")
    gaps = F.expr("try_cast(CAST(high AS DECIMAL(20, 0)) - low + 1 - turns AS BIGINT)")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return found.select("conv_id", zero(gaps).alias("gaps"), *(zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")), zero(F.col("goal.cost")).alias("cost"),
                        F.coalesce("goal.audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op12(spark, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH RECURSIVE bits(i, v, k) AS (
    SELECT range, range, 0 FROM range(256) UNION ALL
    SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
dealt AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[CAST(xor(c & 255, b) AS INTEGER) + 1])), 4294967295) % 20 AS d FROM keyed, crc),
changed AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM dealt WHERE d <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos, right(rtrim(text, E' \t\n\x0B\x0C\r'), 1) AS last FROM changed),
faulty AS (SELECT conv_id, turn, role, text, pos, substr(role, 1, 1) AS initial,
    CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM faulty GROUP BY conv_id),
follows(q, x, q2) AS (VALUES ('0', 's', 'S'), ('0', 'u', 'U'), ('S', 'u', 'U'), ('U', 'a', 'A'), ('A', 'u', 'U')),
news(x, line) AS (VALUES ('u', 'user:'), ('a', 'assistant:')),
inserts AS (SELECT DISTINCT q, q AS q2, 0 AS c, '' AS a, CAST([] AS VARCHAR[]) AS out FROM follows UNION ALL SELECT q, q2, 2, 'I', [line] FROM follows JOIN news USING (x)
    UNION ALL SELECT f.q, g.q2, 4, 'II', [m.line, n.line] FROM follows f JOIN news m USING (x) JOIN follows g ON g.q = f.q2 JOIN news n ON n.x = g.x),
steps AS (SELECT conv_id, pos, q, q2, CAST(fault = 'truncated' AS INTEGER) AS c, 'K' AS a, [role || ':' || text] AS out FROM faulty JOIN follows ON x = initial WHERE fault NOT IN ('blank', 'duplicate')
    UNION ALL SELECT conv_id, pos, q, q2, 2 + CAST(fault = 'truncated' AS INTEGER), 'R', [line || text] FROM faulty, follows JOIN news USING (x) WHERE fault NOT IN ('blank', 'duplicate')
    UNION ALL SELECT conv_id, pos, q, q, 3, 'D', CAST([] AS VARCHAR[]) FROM faulty, (SELECT DISTINCT q FROM follows)),
best(conv_id, pos, q, w) AS (
    SELECT conv_id, CAST(0 AS BIGINT), '0', {'c': CAST(0 AS BIGINT), 'a': '', 'out': CAST([] AS VARCHAR[])} FROM counts UNION ALL
    SELECT b.conv_id, b.pos + 1, s.q2, min({'c': CAST(b.w.c + i.c + s.c AS BIGINT), 'a': b.w.a || i.a || s.a, 'out': list_concat(list_concat(b.w.out, i.out), s.out)})
    FROM best b JOIN inserts i ON i.q = b.q JOIN steps s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.pos = b.pos + 1 AND s.q = i.q2 GROUP BY b.conv_id, b.pos, s.q2),
done AS (SELECT b.conv_id, min({'c': CAST(b.w.c + i.c AS BIGINT), 'a': b.w.a || i.a, 'out': list_concat(b.w.out, i.out)}) AS w
    FROM best b JOIN counts n ON n.conv_id IS NOT DISTINCT FROM b.conv_id AND n.n = b.pos JOIN inserts i ON i.q = b.q WHERE i.q2 IN ('0', 'A') GROUP BY b.conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(w.c, 0) AS cost, coalesce(w.a, '') AS audit, sha256(coalesce(array_to_string(w.out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""

QUERIES = {"op12_conversation_structure_repair": op12}
ORACLES = {"op12_conversation_structure_repair": SQL}
