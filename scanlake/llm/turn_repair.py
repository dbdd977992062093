"""Broken conversations: the cheapest edits that make the turns alternate again.

The role initials of a sound conversation are ``(s?(ua)+)?``. A row may be kept (K, 0), get the role of user or assistant
(R, 2) or be deleted (D, 3); an empty turn of user or assistant may be inserted anywhere (I, 2). Blank rows and repeated
rows must go; a truncated row that stays costs 1 more. Of the cheapest repairs the one whose letters are ASCII-least is taken.

Method: Wagner-Fischer alignment of the turns with the target string of each feasible length. Targets that end alike are
suffixes of each other, so one table, filled from the end, serves all lengths: its last row holds the cost of each. Ukkonen's
band leaves out cells that cost more than an incumbent (a repair found in one pass). The lengths of least cost are backtraced
and their letters compared.

Rows are aligned in blocks of ``BLOCK``, each from every state of the target (nothing yet, after the system turn, after a user,
after an assistant) to every state; blocks are then chained from the last to the first. Inserts before a row belong to the row's block,
so two audits of one block are never prefixes of each other and the least whole is made of least pieces. A conversation of more than
``LONG_ROWS`` rows or ``LONG_BYTES`` never enters one task: its blocks are aligned apart, the chain carries four costs a block,
and its repair comes in several parts.

Rows are ordered by turn (null first), then role and text. Null roles and texts read as one space. Rows without a conversation id are
one conversation of their own. A role that is empty can't be kept. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scanlake.llm.tables import map_batches
from scanlake.scale import lagged, running_sum, stable

BLOCK = 128
#: A conversation beyond either is repaired in parts.
LONG_ROWS, LONG_BYTES = 4096, 64 << 20
SPACE = " \t\n\v\f\r"
ROLES = {"u": "user", "a": "assistant"}
FAULTS = ("blank", "duplicate", "truncated")
#: States of the target: nothing yet, after the system turn, after a user, after an assistant; and the letter that comes next.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {SYSTEM: "u", USER: "a", ASSISTANT: "u"}
#: What closes a target: nothing, or the turns that are missing from its last pair.
CLOSING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
LEGAL = {"su", "ua", "au"}
INFINITE = 1 << 60

TURN = "struct<edit:string,fault:string,turn:bigint,role:string,text:string>"
COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def code_of(initial: str, fault: str | None) -> str:
    """One letter a row: its initial (x for one no target has), upper case if truncated; d if it must go."""
    if fault in ("blank", "duplicate"):
        return "d"
    letter = initial if initial and initial in "sua" else "x"
    return letter.upper() if fault == "truncated" else letter


def _incumbent(rows: str) -> int:
    """Cost of a repair found in one pass: the upper bound that makes the band."""
    want, cost = "u", 0
    for c in rows:
        letter, cost = c.lower(), cost + c.isupper()
        if letter == want:
            want = "a" if want == "u" else "u"
        elif letter in ROLES:
            cost += 2
        else:
            cost, want = cost + 2, "a" if want == "u" else "u"
    return cost


def _table(rows: str, exit_state: int, bound: int) -> list[dict[int, int]]:
    """``table[q][r]``: least cost of aligning the last q rows with the last r letters of a target that ends in ``exit_state``."""
    ends = "au" if exit_state == ASSISTANT else "ua"  # letters at r = 1, 2, 3, ...
    table = [{0: 0}]
    for q, c in enumerate(reversed(rows), 1):
        below, here = table[-1], {}
        letter, extra = c.lower(), int(c.isupper())
        first = max(0, q - bound // 3)
        for r in range(first, q + bound // 2 + 1):
            cost = below.get(r, INFINITE) + 3
            if r:
                cost = min(cost, below.get(r - 1, INFINITE) + extra + (0 if ends[(r - 1) % 2] == letter else 2), here.get(r - 1, INFINITE) + 2)
            if cost <= bound:
                here[r] = cost
        here.setdefault(0, 3 * q)
        table.append(here)
    return table


def _letters(rows: str, table: list[dict[int, int]], exit_state: int, start: int, r: int) -> str:
    """ASCII-least letters of the cheapest alignment of ``rows[start:]`` with the last r letters of the target."""
    ends, out, n = "au" if exit_state == ASSISTANT else "ua", [], len(rows)
    q = n - start
    while q or r:
        cost = table[q][r]
        if q and table[q - 1].get(r, INFINITE) + 3 == cost:
            out.append("D")
            q -= 1
        elif r and table[q].get(r - 1, INFINITE) + 2 == cost:
            out.append("I")
            r -= 1
        else:
            out.append("K" if rows[n - q].lower() == ends[(r - 1) % 2] else "R")
            q, r = q - 1, r - 1
    return "".join(out)


def _with_forced(code: str, letters: str) -> str:
    """Put in the D of every row that must go, as early as its place allows (D is the least letter)."""
    out, at = [], 0
    for e in letters:
        while code[at : at + 1] == "d":
            out.append("D")
            at += 1
        out.append(e)
        at += e != "I"
    return "".join(out) + "D" * (len(code) - at)


@functools.lru_cache(maxsize=5_000)
def align(code: str) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) -> (cost, letters) of a block of rows, without inserts after its last row."""
    rows = code.replace("d", "")
    n, forced = len(rows), 3 * (len(code) - len(rows))
    found: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(before: int, after: int, cost: int, letters: str) -> None:
        found[before, after] = min(found.get((before, after), (INFINITE, "")), (cost, letters))

    bound = _incumbent(rows) + 8  # changing the state before costs an insert, the state after a deletion
    tables = {x: _table(rows, x, bound) for x in (USER, ASSISTANT)}
    for before in range(4):
        offer(before, before, 3 * n, "D" * n)
    for after, table in tables.items():
        # the target's length fixes its first letter
        for first, states in (("u", (NOTHING, SYSTEM, ASSISTANT)), ("a", (USER,))):
            lengths = [r for r in table[n] if r and ("ua"[r % 2] if after == ASSISTANT else "au"[r % 2]) == first]
            least = min((table[n][r] for r in lengths), default=INFINITE)
            for letters in [_letters(rows, table, after, 0, r) for r in lengths if table[n][r] == least]:
                for before in states:
                    offer(before, after, least, letters)
        # a target with a system turn: only deletions come before the row that is kept for it
        opened = [(3 * i + c.isupper() + table[n - i - 1][r], i, r) for i, c in enumerate(rows) if c in "sS" and 3 * i <= bound
                  for r in table[n - i - 1] if r and ("ua"[r % 2] if after == ASSISTANT else "au"[r % 2]) == "u"]
        least = min((cost for cost, _, _ in opened), default=INFINITE)
        for cost, i, r in opened:
            if cost == least:
                offer(NOTHING, after, cost, "D" * i + "K" + _letters(rows, table, after, i + 1, r))
    for i, c in enumerate(rows):
        if c in "sS":
            offer(NOTHING, SYSTEM, 3 * (n - 1) + c.isupper(), "D" * i + "K" + "D" * (n - 1 - i))
    return {k: (cost + forced, _with_forced(code, letters)) for k, (cost, letters) in found.items()}


Row = tuple[int, int, int, int]  # state before, state after, cost, rank of the letters among those of one state before


def ranks(table: dict[tuple[int, int], tuple[int, str]]) -> list[Row]:
    order = sorted(table, key=lambda k: (k[0], table[k][1]))
    return [(before, after, table[before, after][0], i) for i, (before, after) in enumerate(order)]


def step_back(rows: list[Row], rest: list[int]) -> tuple[list[int], list[int]]:
    """Costs from each state before a block, given those after it, and the state after it that the best repair takes."""
    best = [(INFINITE, 0, NOTHING)] * 4
    for before, after, cost, rank in rows:
        best[before] = min(best[before], (cost + rest[after], rank, after))
    return [b[0] for b in best], [b[2] for b in best]


CLOSING_COST = [2 * len(CLOSING[s]) for s in range(4)]


def cheapest(code: str) -> str:
    """Letters of the whole repair of a conversation given as one letter a row."""
    blocks = [align(code[i : i + BLOCK]) for i in range(0, len(code), BLOCK)]
    rest, choices = list(CLOSING_COST), []
    for b in reversed(blocks):
        rest, choice = step_back(ranks(b), rest)
        choices.append(choice)
    state, out = NOTHING, []
    for b, choice in zip(blocks, reversed(choices)):
        out.append(b[state, choice[state]][1])
        state = choice[state]
    return "".join(out) + CLOSING[state]


def cost_of(code: str, letters: str) -> int:
    at, cost = 0, 0
    for e in letters:
        cost += {"K": 0, "I": 2, "R": 2, "D": 3}[e]
        if e != "I":
            cost += e != "D" and code[at].isupper()
            at += 1
    return cost


def edited(rows: list[tuple], faults: list, letters: str, state: int = NOTHING) -> list[dict]:
    """The edits in order, with the texts: ``rows`` are (turn, role, text), the state is that of the target before them."""
    out, at = [], 0
    for e in letters:
        turn, role, text, fault = (None, None, "", None) if e == "I" else (*rows[at], faults[at])
        at += e != "I"
        if e in "IR":
            role = ROLES[NEXT.get(state, "u")]
        if e != "D":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        out.append({"edit": e, "fault": fault, "turn": turn, "role": role, "text": text})
    return out


def gaps(turns: set) -> int:
    turns = turns - {None}
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0


def own_fault(text: str) -> str | None:
    """The fault a text has by itself."""
    seen = text.rstrip(SPACE)
    return "blank" if not seen else None if seen[-1] in ".!?" else "truncated"


def _whole(rows: list[tuple]) -> dict:
    """The repair of a conversation of bounded size; ``rows`` in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        fault = own_fault(text)
        if fault != "blank" and (role, text) in seen:
            fault = "duplicate"
        seen.add((role, text))
        faults.append(fault)
    code = "".join(code_of(role[:1], f) for (_, role, _), f in zip(rows, faults))
    letters = cheapest(code)
    initials = [role[:1] for _, role, _ in rows]
    counts = {f: faults.count(f) for f in FAULTS}
    return {"gaps": gaps({t for t, _, _ in rows}), **counts, "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "cost": cost_of(code, letters), "audit": letters, "turns": edited(rows, faults, letters)}


def _key() -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def _short(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations that fit a task: rows sorted within partitions, one conversation held at a time."""
    schema = f"conv_id {kind}, part long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<{TURN}>"
    ordered = rows.repartition("_k").sortWithinPartitions("_k", F.col("turn").asc_nulls_first(), "role", "text")
    turn_type = pa.list_(pa.struct([("edit", pa.string()), ("fault", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))

    def out(done: list[tuple]) -> pa.RecordBatch:
        ids, repairs = [d[0] for d in done], [d[1] for d in done]
        longs = [pa.array([r[c] for r in repairs], pa.int64()) for c in ("gaps", *COUNTS)]
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids), pa.array([0] * len(done), pa.int64()), *longs, pa.array([r["audit"] for r in repairs], pa.string()), pa.array([r["turns"] for r in repairs], turn_type)],
            names=["conv_id", "part", "gaps", *COUNTS, "audit", "turns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, conv, held, done, size = None, None, [], [], 0
        for batch in batches:
            ids = batch.column("conv_id")
            for i, (k, *row) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("_k", "turn", "role", "text")])):
                if k != key:
                    if held:
                        done.append((conv, _whole(held)))
                    if size > LONG_BYTES // 8 or len(done) >= 1000:
                        yield out(done)
                        done, size = [], 0
                    key, conv, held = k, ids.slice(i, 1), []
                held.append(tuple(row))
                size += len(row[1]) + len(row[2])
        if held:
            done.append((conv, _whole(held)))
        if done:
            yield out(done)

    return map_batches(ordered, run, schema)


def _chained(blocks: DataFrame) -> DataFrame:
    """(_k, block, before, after, last): states of the best repair around each block; two passes over the blocks in order.

    A pass holds four costs (or one state) at a time, however many blocks a conversation has.
    """
    def back(batches):
        key, rest = None, []
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                if r["_k"] != key:
                    key, rest = r["_k"], list(CLOSING_COST)
                rest, choice = step_back([tuple(x) for x in r["rows"]], rest)
                out.append({"_k": key, "block": r["block"], "choice": choice})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("_k", pa.string()), ("block", pa.int64()), ("choice", pa.list_(pa.int32()))]))

    def forth(batches):
        key, state = None, NOTHING
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["_k"] != key:
                    key, state = r["_k"], NOTHING
                after = r["choice"][state]
                out.append({"_k": key, "block": r["block"], "before": state, "after": after})
                state = after
            yield pa.RecordBatch.from_pylist(out, pa.schema([("_k", pa.string()), ("block", pa.int64()), ("before", pa.int32()), ("after", pa.int32())]))

    last_first = blocks.select("_k", "block", "rows").repartition("_k").sortWithinPartitions("_k", F.desc("block"))
    choices = map_batches(last_first, back, "_k string, block long, choice array<int>")
    return map_batches(choices.repartition("_k").sortWithinPartitions("_k", "block"), forth, "_k string, block long, before int, after int")


def _is(value: str, c: Column) -> Column:
    return c.eqNullSafe(F.lit(value))


def _long(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations that fit no task, as one row a block."""
    least = -(-LONG_BYTES // BLOCK)
    weight = F.greatest(F.octet_length("text").cast("long") + F.octet_length("role"), F.lit(least))
    tail = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    placed = running_sum(rows, ["_k"], [F.col("turn").asc_nulls_first(), "role", "text"], weight, "until")
    placed = placed.withColumn("block", F.floor((F.col("until") - weight) / (least * BLOCK))).withColumn(
        "said", F.when(tail == "", "blank").when(~tail.isin(".", "!", "?"), "truncated")).withColumn("initial", F.substring("role", 1, 1))
    placed = stable(placed.withColumn("seen", F.sha2(F.to_json(F.struct("role", "text")), 256)))
    firsts = placed.filter("said is null or said <> 'blank'").groupBy("_k", "seen").agg(F.min("until").alias("until")).select("_k", "until", F.lit(True).alias("first"))
    told = placed.select("_k", "until", "block", "said", "initial").join(firsts, ["_k", "until"], "left")
    fault = F.when(F.col("said") == "blank", "blank").when(F.col("first").isNull(), "duplicate").otherwise(F.col("said"))
    one = F.struct("until", F.col("initial").alias("i"), fault.alias("f"))
    grouped = told.groupBy("_k", "block").agg(F.array_sort(F.collect_list(one)).alias("r"))

    def solve(batches):
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                initials, faults = [x["i"] for x in b["r"]], [x["f"] for x in b["r"]]
                table = align("".join(map(code_of, initials, faults)))
                out.append({"_k": b["_k"], "block": b["block"], "rows": [list(x) for x in ranks(table)], "first": initials[0], "tail": initials[-1], "faults": faults,
                            "illegal": sum(x + y not in LEGAL for x, y in zip(initials, initials[1:])),
                            "tables": [{"before": k[0], "after": k[1], "cost": v[0], "letters": v[1]} for k, v in table.items()]})
            yield pa.RecordBatch.from_pylist(out, arrow)

    arrow = pa.schema([("_k", pa.string()), ("block", pa.int64()), ("rows", pa.list_(pa.list_(pa.int64()))), ("first", pa.string()), ("tail", pa.string()), ("faults", pa.list_(pa.string())),
                       ("illegal", pa.int64()), ("tables", pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())])))])
    schema = "_k string, block long, rows array<array<long>>, first string, tail string, faults array<string>, illegal long, tables array<struct<before:int,after:int,cost:bigint,letters:string>>"
    solved = stable(map_batches(grouped, solve, schema))
    ends = solved.groupBy("_k").agg(F.max("block").alias("final"))
    met = lagged(solved.select("_k", "block", "first", "tail"), ["_k"], ["block"], ["tail"])
    met = met.select("_k", "block", F.when(F.concat("prev.tail", "first").isin(*LEGAL) | F.col("prev").isNull(), 0).otherwise(1).alias("met"))
    taken = F.element_at(F.filter("tables", lambda t: (t["before"] == F.col("before")) & (t["after"] == F.col("after"))), 1)
    chosen = solved.join(_chained(solved), ["_k", "block"]).join(met, ["_k", "block"]).join(ends, "_k").withColumn("t", taken)
    is_last = F.col("block") == F.col("final")
    closing = F.when(is_last, F.element_at(F.array(*[F.lit(CLOSING[s]) for s in range(4)]), F.col("after") + 1)).otherwise("")
    count = [F.size(F.filter("faults", functools.partial(_is, x))).cast("long").alias(x) for x in FAULTS]
    chosen = chosen.select("_k", "block", "before", "faults", *count, (F.col("illegal") + F.col("met")).alias("illegal"),
                           (F.col("t.cost") + 2 * F.length(closing)).alias("cost"), F.concat("t.letters", closing).alias("audit"))
    spread = F.max("turn").cast("long") - F.min("turn") + 1
    holes = placed.groupBy("_k", "turn").agg(F.first("conv_id").alias("conv_id")).groupBy("_k").agg(F.coalesce(spread - F.count("turn"), F.lit(0)).alias("gaps"))
    texts = placed.groupBy("_k", "block").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("until", "turn", "role", "text"))).alias("said"))
    whole = texts.join(chosen, ["_k", "block"]).join(holes, "_k")
    out_schema = f"conv_id {kind}, part long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<{TURN}>"
    turn_type = pa.list_(pa.struct([("edit", pa.string()), ("fault", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))

    def write(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one block at a time: each may hold LONG_BYTES
                b = batch.slice(i, 1)
                r = b.drop_columns(["conv_id"]).to_pylist()[0]
                turns = edited([(x["turn"], x["role"], x["text"]) for x in r["said"]], r["faults"], r["audit"], r["before"])
                yield pa.RecordBatch.from_arrays(
                    [b.column("conv_id"), pa.array([r["block"]], pa.int64()), *[pa.array([r[c]], pa.int64()) for c in ("gaps", *COUNTS)], pa.array([r["audit"]]), pa.array([turns], turn_type)],
                    names=["conv_id", "part", "gaps", *COUNTS, "audit", "turns"])

    return map_batches(whole, write, out_schema)


def _apart(conversations: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The repairs of the conversations that fit a task, and those of the others if there are any."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select(_key().alias("_k"), "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    size = F.octet_length("role") + F.octet_length("text")
    long = rows.groupBy("_k").agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("b")).filter(f"n > {LONG_ROWS} or b > {LONG_BYTES}").select("_k")
    if long.isEmpty():
        return _short(rows, kind), None
    long = stable(long)
    return _short(rows.join(long, "_k", "left_anti"), kind), _long(rows.join(long, "_k", "left_semi"), kind)


def repairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, gaps, blank, duplicate, truncated, illegal, cost, audit, turns) of every conversation that has a row.

    ``turns`` are the edits in order (edit, fault, turn, role, text; inserted ones have no turn); those that are not D are the repaired
    conversation. A long one has several parts: counts, cost and audit are of the part, ``gaps`` of the conversation.
    ``illegal`` counts neighbouring rows (before the repair) whose initials are not su, ua or au. Other columns are not read.
    """
    short, long = _apart(conversations)
    return short if long is None else short.unionByName(long)


def _or_space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def _lot() -> Column:
    return F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn"))) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """Test damage by ``crc32(conv_id:turn) % 20``: 0 drops the row, 1 empties it, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's."""
    rows = conversations.select("conv_id", "turn", _or_space("role").alias("role"), _or_space("text").alias("text"), _lot().alias("lot")).filter("lot <> 0")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def digested(conversations: DataFrame) -> DataFrame:
    """One row a conversation: counts and audit of its ``repairs``, ``repaired_sha256`` of its repaired ``role:text`` lines.

    A conversation in one part is digested where it lies. SHA-256 runs through a text in order, so the parts of a long conversation stream
    through one task, a part at a time.
    """
    kept = F.filter("turns", lambda t: t["edit"] != "D")
    lines = F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"))
    names = ["conv_id", "gaps", *COUNTS, "audit", "repaired_sha256"]
    short, long = _apart(conversations)
    whole = short.select(*names[:-1], F.sha2(F.coalesce(lines, F.lit("")), 256).alias(names[-1]))
    if long is None:
        return whole

    def out(c: dict) -> pa.RecordBatch:
        longs = [pa.array([c[x]], pa.int64()) for x in ("gaps", *COUNTS)]
        return pa.RecordBatch.from_arrays([c["id"], *longs, pa.array(["".join(c["audit"])]), pa.array([c["sha"].hexdigest()])], names=names)

    def run(batches):
        key, now = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1)
                r = b.drop_columns(["conv_id"]).to_pylist()[0]
                if r["_k"] != key:
                    if now:
                        yield out(now)
                    key, now = r["_k"], {"id": b.column("conv_id"), "gaps": r["gaps"], **dict.fromkeys(COUNTS, 0), "audit": [], "sha": hashlib.sha256(), "line": ""}
                for x in COUNTS:
                    now[x] += r[x]
                now["audit"].append(r["audit"])
                if r["said"] is not None:
                    now["sha"].update((now["line"] + r["said"]).encode())
                    now["line"] = "\n"
        if now:
            yield out(now)

    kind = conversations.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    parts = long.select(_key().alias("_k"), "conv_id", "part", "gaps", *COUNTS, "audit", lines.alias("said"))
    return whole.unionByName(map_batches(parts.repartition("_k").sortWithinPartitions("_k", "part"), run, schema))


def damage_report(conversations: DataFrame) -> DataFrame:
    """The repairs of the damaged conversations as digests, one row a conversation id; zeros where the damage left no row."""
    told = digested(damaged(conversations))
    lost = conversations.groupBy("conv_id").agg(F.max(_lot()).alias("top")).filter("top = 0")
    zeros = [F.lit(0).cast("long").alias(c) for c in ("gaps", *COUNTS)]
    return told.unionByName(lost.select("conv_id", *zeros, F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256")))
