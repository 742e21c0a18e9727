"""Chat formatting with minimum-cost role repair.

A conversation is legal if an optional system turn comes first and user and assistant
turns alternate after it, the user first. Each turn is kept, relabelled, merged into the
turn before it, or kept behind an inserted empty turn; dynamic programming over the
automaton's states finds the cheapest way.

Conversations of at most SEGMENT turns are dealt by their id and decided whole, in one
exchange. Longer ones are range-partitioned by conversation and turn, so that a
conversation of any length is spread over tasks. Each stretch of at most SEGMENT turns becomes a matrix of
least costs from state to state. A conversation's matrices are multiplied within each
partition first and then over its partitions, so that no task holds more of one
conversation than a partition's stretches or a matrix for each partition. That fixes the
states in which each partition's turns begin and end, then those of each stretch, and the
stretches are decided apart.
"""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import null_safe, written

#: Turns in a stretch, and in a rendered part.
SEGMENT = 1024
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs, a relabel of an unknown role being the cheaper one.
COST = {"merge": 1, "insert": 2, "relabel": 2, "name": 1, "join": 3}
FAR = 1 << 40


def moves(role: str | None) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, action) for a turn, in order of preference among equals."""
    own = ROLES.index(role) + 1 if role in ROLES else None
    out = []
    for q in range(4):
        for to in NEXT[q]:
            if to == own:
                out.append((q, to, 0, "keep"))
            else:
                out.append((q, to, COST["relabel" if own else "name"], "relabel"))
            out += [(q, own, COST["insert"], f"insert {ROLES[to - 1]}") for t in NEXT[to] if t == own]
        if q != START:
            out.append((q, q, COST["merge" if q == own else "join"], "merge"))
    order = {"keep": 0, "merge": 1, "insert": 2, "relabel": 3}
    return sorted(out, key=lambda m: (m[0], m[2], order[m[3].split()[0]], m[1]))


_MOVES = {r: moves(r) for r in (*ROLES, None)}


def _steps(role: str | None) -> list[tuple[int, int, int, str]]:
    return _MOVES[role if role in ROLES else None]


def least(roles: list, entry: int) -> list[list[int]]:
    """Least cost of each state after 0, 1, ... turns from an entry state."""
    costs = [[0 if q == entry else FAR for q in range(4)]]
    for role in roles:
        now, after = costs[-1], [FAR] * 4
        for q, to, cost, _ in _steps(role):
            if now[q] + cost < after[to]:
                after[to] = now[q] + cost
        costs.append(after)
    return costs


def decide(roles: list, entry: int, leave: int) -> list[tuple[str, int]]:
    """(action, state) for each turn on a cheapest way from entry to leave."""
    costs, out, state = least(roles, entry), [], leave
    for k in range(len(roles) - 1, -1, -1):
        for q, to, cost, action in _steps(roles[k]):
            if to == state and costs[k][q] < FAR and costs[k][q] + cost == costs[k + 1][state]:
                out.append((action, state))
                state = q
                break
    return out[::-1]


def repair_roles(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each row of turns: (id, at, n_turns, role, text, action, new_role).

    at counts a conversation's turns from 0 in the order of turn (nulls last), then of a
    hash of role and text; n_turns is their number. Roles are compared in lower case
    without white space around; others, and null, count as unknown. A null text is
    empty. Rows with a null id make one conversation. Repeated rows are turns of their
    own. Other columns are ignored; an empty table gives an empty result. Of ways that
    cost the same, the first state (system, user, assistant) to end in decides; then, from
    the last turn back, the first state to come from (none, system, user, assistant), then
    the order keep, merge, insert, relabel; in conversations of more than SEGMENT turns
    where stretches meet also the first state.
    """
    role = F.lower(F.trim(turns[role_col].cast("string")))
    rows = turns.select(turns[id_col].alias("id"), turns[turn_col].alias("turn"), role.alias("role"), F.coalesce(turns[text_col], F.lit("")).alias("text")).withColumn("tie", F.xxhash64("role", "text")).withColumn("uid", F.monotonically_increasing_id())
    order = [F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("tie"), F.col("uid")]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "turn")}
    schema = f"id {kinds['id']}, at bigint, n_turns bigint, role string, text string, action string, new_role string"

    def whole(batches):
        """Decides conversations that stand together, in order, one at a time."""
        import pyarrow as pa

        own, held = object(), []

        def decided(kind):
            costs = least([r for _, r, _ in held], START)[-1]
            found = decide([r for _, r, _ in held], START, min(range(4), key=lambda q: costs[q]))
            names = ["id", "at", "n_turns", "role", "text", "action", "new_role"]
            columns = [[i for i, _, _ in held], range(len(held)), [len(held)] * len(held), [r for _, r, _ in held], [t for _, _, t in held], [a for a, _ in found], [ROLES[q - 1] for _, q in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, pa.int64(), pa.int64(), *[pa.string()] * 4], strict=True)], names)

        for batch in batches:
            kind = batch.column("id").type
            out = []
            for row in zip(*[batch.column(c).to_pylist() for c in ("id", "role", "text")], strict=True):
                if held and row[0] != own:
                    out.append(decided(kind))
                    held = []
                own = row[0]
                held.append(row)
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if held:
            yield decided(kind)

    long = written(rows.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > SEGMENT).select("id"))
    some_long = not long.isEmpty()
    short = null_safe(rows, long, ["id"], "left_anti") if some_long else rows
    told = short.repartition("id").sortWithinPartitions(*order).mapInArrow(whole, schema)
    named = lambda df: df.withColumnRenamed("id", id_col)
    if not some_long:
        return named(told)
    rows = null_safe(rows, long, ["id"], "left_semi")

    def number(batches):
        import numpy as np
        import pyarrow as pa

        part, last, seg, within = TaskContext.get().partitionId(), object(), 0, 0
        for batch in batches:
            segs, ats = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int32)
            for k, own in enumerate(batch.column("id").to_pylist()):
                if own != last or within == SEGMENT:
                    seg, within, last = seg + 1, 0, own
                segs[k], ats[k] = seg, within
                within += 1
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "turn", "role", "text")], pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(segs), pa.array(ats)], ["id", "turn", "role", "text", "part", "seg", "k"])

    # joins here are sort-merge joins: both sides grow with the turns, whatever their files weigh
    cut = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"id {kinds['id']}, turn {kinds['turn']}, role string, text string, part int, seg bigint, k int"))
    stretches = cut.groupBy("part", "seg").agg(F.first("id").alias("id"), F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("role", F.lit("")).alias("role")))), lambda x: x["role"]).alias("roles"))

    @F.pandas_udf("array<bigint>")
    def matrix(lists):
        return lists.map(lambda roles: [c for q in range(4) for c in least(list(roles), q)[-1]])

    def step(costs, m):
        """Least costs after a matrix, and the state before on the way to each."""
        came = [min(range(4), key=lambda q: costs[q] + m[4 * q + to]) for to in range(4)]
        return [min(FAR, costs[came[to]] + m[4 * came[to] + to]) for to in range(4)], came

    @F.pandas_udf("array<bigint>")
    def product(lists):
        def one(some):
            rows = [[0 if q == p else FAR for q in range(4)] for p in range(4)]
            for s in some:
                rows = [step(costs, s["m"])[0] for costs in rows]
            return [c for costs in rows for c in costs]

        return lists.map(one)

    def chain(some, entry, leave, before):
        """Where each of the chained pieces begins and ends on a cheapest way; without leave, to the cheapest end."""
        some, costs, back = list(some), [0 if q == entry else FAR for q in range(4)], []
        for s in some:
            costs, came = step(costs, s["m"])
            back.append(came)
        state, out, after = min(range(4), key=lambda q: costs[q]) if leave is None else leave, [], before + sum(s["n"] for s in some)
        for s, came in zip(reversed(some), reversed(back), strict=True):
            after -= s["n"]
            out.append({"piece": s["piece"], "entry": came[state], "leave": state, "before": after})
            state = came[state]
        return out

    pieces = "array<struct<piece:bigint,entry:int,leave:int,before:bigint>>"

    @F.pandas_udf(pieces)
    def over_parts(lists):
        return lists.map(lambda some: chain(some, 0, None, 0))

    @F.pandas_udf(pieces)
    def within_part(lists, entries, leaves, befores):
        import pandas as pd

        return pd.Series([chain(some, int(e), int(to), int(b)) for some, e, to, b in zip(lists, entries, leaves, befores, strict=True)])

    measured = written(stretches.select("part", "seg", "id", "roles", F.size("roles").cast("long").alias("n"), matrix("roles").alias("m")))
    listed = F.array_sort(F.collect_list(F.struct(F.col("piece"), "n", "m"))).alias("some")
    total = F.aggregate("some", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    # a conversation's stretches in one partition, told by their first number
    own = written(measured.withColumn("piece", F.col("seg")).groupBy("id", "part").agg(F.min("seg").alias("lead"), listed))
    wholes = own.select("id", F.col("part").cast("long").alias("piece"), "lead", total.alias("n"), product("some").alias("m"))
    leads = wholes.select(F.col("piece").cast("int").alias("part"), "lead", "id")
    chains = wholes.groupBy("id").agg(listed).select("id", total.alias("total"), F.explode(over_parts("some")).alias("s"))
    ends = null_safe(leads, chains.select("id", "total", F.col("s.piece").cast("int").alias("part"), "s.entry", "s.leave", "s.before").hint("merge"), ["id", "part"]).drop("id")
    inner = own.select("part", "lead", "some").join(ends.hint("merge"), ["part", "lead"]).select("part", "total", F.explode(within_part("some", "entry", "leave", "before")).alias("s"))
    ends = inner.select("part", F.col("s.piece").alias("seg"), "total", "s.entry", "s.leave", "s.before")

    @F.pandas_udf("array<struct<action:string,state:int>>")
    def decided(roles, entries, leaves):
        return roles.combine(entries, lambda r, e: (r, e)).combine(leaves, lambda re, to: [{"action": a, "state": s} for a, s in decide(list(re[0]), int(re[1]), int(to))])

    done = measured.join(ends.hint("merge"), ["part", "seg"]).select("part", "seg", "before", "total", F.posexplode(decided("roles", "entry", "leave")).alias("k", "d"))
    out = cut.join(done.hint("merge"), ["part", "seg", "k"])
    out = out.select(
        "id", (F.col("before") + F.col("k")).alias("at"), F.col("total").alias("n_turns"), "role", "text", F.col("d.action").alias("action"), F.element_at(F.array(*map(F.lit, ROLES)), F.col("d.state")).alias("new_role")
    )
    return named(told.unionByName(out))


def render(repaired: DataFrame, *, id_col: str = "conv_id", opening: str = "<|{}|>\n", closing: str = "<|end|>\n") -> DataFrame:
    """(id, part, n_turns, n_kept, n_merged, n_inserted, n_relabelled, cost, rendered): the repaired
    conversations as text, part k of those with more than SEGMENT turns having turns k * SEGMENT on.
    Parts put together give the whole. A merged text follows a line break; an inserted turn is empty.

    `repaired` is what repair_roles gives: at numbers a conversation's turns without gaps or
    ties, action and new_role aren't null. A null text or role counts as it does there, an
    empty text is an empty turn; rows with a null id are one conversation; repeated turns
    stand as often as they are given; an empty table gives an empty result."""
    before, after = opening.split("{}")
    begin = lambda r: F.concat(F.lit(before), r, F.lit(after))
    end = F.when(F.col("at") > 0, F.lit(closing)).otherwise("")
    inserted = F.regexp_extract("action", "^insert (.*)", 1)
    said = (
        F.when(F.col("action") == "merge", F.concat(F.lit("\n"), F.col("text")))
        .when(inserted != "", F.concat(end, begin(inserted), F.lit(closing), begin(F.col("new_role")), F.col("text")))
        .otherwise(F.concat(end, begin(F.col("new_role")), F.col("text")))
    )
    said = F.concat(said, F.when(F.col("at") == F.col("n_turns") - 1, F.lit(closing)).otherwise(""))
    known = F.col("role").isin(*ROLES)
    cost = (
        F.when(F.col("action") == "keep", 0)
        .when(F.col("action") == "merge", F.when(known & (F.col("role") == F.col("new_role")), COST["merge"]).otherwise(COST["join"]))
        .when(F.col("action") == "relabel", F.when(known, COST["relabel"]).otherwise(COST["name"]))
        .otherwise(COST["insert"])
    )
    count = lambda what: F.count_if(F.col("action").startswith(what))
    parts = repaired.withColumn("said", said).groupBy(id_col, F.expr(f"at div {SEGMENT}").alias("part"))
    return parts.agg(
        F.first("n_turns").alias("n_turns"), count("keep").alias("n_kept"), count("merge").alias("n_merged"), count("insert").alias("n_inserted"), count("relabel").alias("n_relabelled"), F.sum(cost).cast("long").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]), "").alias("rendered"),
    )
