"""Conversation structure repair: the cheapest edits of a conversation's turns by depth-first branch and bound."""
from __future__ import annotations

import hashlib

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Turns of a block; a conversation within one block is solved whole, a longer one block by block for every entry and exit state.
BLOCK = 256
#: Costs of Keep, Rerole, Delete, Insert and of a truncated turn that stays (fixed values).
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: What a repaired conversation may look like is an automaton: state, then initial, then next state.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ENDS = (START, ASSISTANT)
#: The only role an edit can write in a state.
WRITES = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
#: Results of short symbol strings that a Python worker keeps.
CACHE = 200_000


def suffix_bounds(rows: list[tuple[str, int]]) -> list[tuple[int, ...]]:
    """By rows done and state: what the rows from there on cost at least, in a relaxed problem where any state may end it."""
    out = [(0, 0, 0, 0)]
    for kind, n in reversed(rows):
        after, here = out[-1], []
        for state in range(4):
            cost = DELETE * n + after[state]
            if kind != "x":
                stays, kept = CUT if kind.isupper() else 0, NEXT[state].get(kind.lower())
                cost = min(cost, REROLE + stays + after[NEXT[state][WRITES[state]]], cost if kept is None else KEEP + stays + after[kept])
            here.append(cost)
        for _ in range(2):  # an insert leads to another state of the same place
            here = [min(here[s], INSERT + here[NEXT[s][WRITES[s]]]) for s in range(4)]
        out.append(tuple(here))
    return out[::-1]


def cheapest(rows: list[tuple[str, int]], entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """``(cost, audit)`` of the cheapest edits, ASCII-least among equals, that lead from ``entry`` into one of ``exits``.

    A row is ``(kind, n)``: ``s u a o`` by role initial, upper case when truncated, or ``x`` for ``n`` turns in a row that
    must go. Depth first over an explicit stack, the most promising edit first; a node is (rows done, state). It is given up
    when its cost and the suffix bound exceed the incumbent, when they equal it and its audit is already greater, or when the
    node was entered with a better (cost, audit) before. The stack empties: the incumbent is then proved to be the optimum."""
    least, total, best = suffix_bounds(rows), len(rows), None
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        if best is not None:
            bound = cost + least[at][state]
            if bound > best[0] or bound == best[0] and audit > best[1][:len(audit)]:
                continue
        known = table.get((at, state))
        if known is not None and known <= (cost, audit):
            continue
        table[at, state] = cost, audit
        if at == total and state in exits and (best is None or (cost, audit) < best):
            best = cost, audit
        written = NEXT[state][WRITES[state]]
        edits = [(at, written, cost + INSERT, audit + "I")]
        if at < total:
            kind, n = rows[at]
            edits.append((at + 1, state, cost + DELETE * n, audit + "D" * n))
            if kind != "x":
                stays, kept = CUT if kind.isupper() else 0, NEXT[state].get(kind.lower())
                edits.append((at + 1, written, cost + REROLE + stays, audit + "R"))
                if kept is not None:
                    edits.append((at + 1, kept, cost + KEEP + stays, audit + "K"))
        edits.sort(key=lambda e: (e[2] + least[e[0]][e[1]], e[3]), reverse=True)
        stack += edits
    return best


_KNOWN: dict = {}


def _solve(rows: list[tuple[str, int]], entry: int, exits: tuple[int, ...]):
    if len(rows) > 16:
        return cheapest(rows, entry, exits)
    key = (tuple(rows), entry, exits)
    if key not in _KNOWN:
        if len(_KNOWN) > CACHE:
            _KNOWN.clear()
        _KNOWN[key] = cheapest(rows, entry, exits)
    return _KNOWN[key]


class _Block:
    """Turns of one conversation in a row: fault counts, border initials and the rows to solve."""

    def __init__(self, conversation, whole_start: bool):
        self.conversation, self.whole_start = conversation, whole_start
        self.rows: list[tuple[str, int]] = []
        self.size = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None

    def _drop(self, n: int) -> None:
        if self.rows and self.rows[-1][0] == "x":
            self.rows[-1] = "x", self.rows[-1][1] + n
        else:
            self.rows.append(("x", n))

    def add(self, initial: str, blank: bool, truncated: bool, seen: bool, n: int) -> None:
        """``n`` equal turns at one place; all but the first of them, or all when ``seen`` earlier, are duplicates."""
        again = 0 if blank else n if seen else n - 1
        self.blank += n if blank else 0
        self.duplicate += again
        if not blank and not seen:
            self.truncated += truncated
            kind = initial if initial in ("s", "u", "a") else "o"
            self.rows.append((kind.upper() if truncated else kind, 1))
        if blank or again:
            self._drop(n if blank else again)
        if self.size:
            self.illegal += legal(self.last, initial)
        else:
            self.first = initial
        self.illegal += (n - 1) * legal(initial, initial)
        self.last = initial
        self.size += n

    def table(self, whole: bool) -> list[dict]:
        """The best of every (entry, exit); a conversation known to be whole needs one."""
        if whole:
            cost, audit = _solve(self.rows, START, ENDS)
            return [{"entry": START, "exit": ASSISTANT, "cost": cost, "audit": audit}]
        found = [(a, b, _solve(self.rows, a, (b,))) for a in ((START,) if self.whole_start else range(4)) for b in range(4)]
        return [{"entry": a, "exit": b, "cost": x[0], "audit": x[1]} for a, b, x in found if x is not None]


def legal(before: str, after: str) -> int:
    """1 where two adjacent role initials may not follow each other."""
    return 0 if before + after in ("su", "ua", "au") else 1


_BLOCKS = ("seq long, part_first boolean, whole boolean, size long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
           "best array<struct<entry: int, exit: int, cost: long, audit: string>>")


def _blocks(kind, block: int):
    """Sorted turns of a task to blocks: a conversation that begins and ends inside the task and fits a block is whole."""
    def cut(batches):
        import pyarrow as pa

        base, index, held, done, edge, earlier = TaskContext.get().partitionId() << 32, 0, None, [], True, False

        def close(whole_end: bool):
            nonlocal index
            done.append({"conv": held.conversation, "seq": base + index, "whole": held.whole_start and whole_end, "size": held.size, "blank": held.blank, "duplicate": held.duplicate,
                         "truncated": held.truncated, "illegal": held.illegal, "first": held.first, "last": held.last, "best": held.table(held.whole_start and whole_end), "part_first": edge})
            index += 1

        def flush():
            out = pa.RecordBatch.from_pylist(done, schema=pa.schema([("conv", kind), ("seq", pa.int64()), ("part_first", pa.bool_()), ("whole", pa.bool_()), ("size", pa.int64()), ("blank", pa.int64()),
                                                                     ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()),
                                                                     ("best", pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))]))
            done.clear()
            return out

        for batch in batches:
            for conv, initial, blank, truncated, seen, n in zip(*(batch.column(c).to_pylist() for c in ("conv", "initial", "blank", "truncated", "seen", "n"))):
                if held is not None and (conv != held.conversation or held.size >= block):
                    same = conv == held.conversation
                    close(not same)
                    edge = edge and same
                    held = _Block(conv, not same)
                elif held is None:
                    held = _Block(conv, False)  # it may have begun in the task before
                held.add(initial, blank, truncated, seen, n)
                if len(done) >= 2000:
                    yield flush()
        if held is not None:
            close(False)  # it may go on in the next task
        if done:
            yield flush()
    return cut


def _chain(kind):
    """Blocks of a conversation in order: the best (cost, audit) per state is carried from block to block."""
    def chain(batches):
        import pyarrow as pa

        names = ("blank", "duplicate", "truncated", "illegal")
        schema = pa.schema([("conv", kind), *((n, pa.int64()) for n in names), ("cost", pa.int64()), ("audit", pa.string())])
        out, conv, states, counts, last = [], None, None, None, None

        def close():
            cost, audit = min(states[s] for s in ENDS if s in states)
            out.append({"conv": conv, "cost": cost, "audit": audit} | counts)

        for batch in batches:
            for row in batch.to_pylist():
                if states is None or row["conv"] != conv:
                    if states is not None:
                        close()
                    conv, states, counts, last = row["conv"], {START: (0, "")}, dict.fromkeys(names, 0), None
                after: dict[int, tuple[int, str]] = {}
                for x in row["best"]:
                    if x["entry"] in states:
                        cost, audit = states[x["entry"]]
                        new = cost + x["cost"], audit + x["audit"]
                        if x["exit"] not in after or new < after[x["exit"]]:
                            after[x["exit"]] = new
                states = after
                for n in names:
                    counts[n] += row[n]
                counts["illegal"] += 0 if last is None else legal(last, row["first"])
                last = row["last"]
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        if states is not None:
            close()
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    return chain


def _apply(kind, digests: bool):
    """Turns sorted behind their conversation's audit: the repaired turns, or the SHA-256 of each repaired conversation.

    Only the turn at hand is held; the hash runs along."""
    def apply(batches):
        import pyarrow as pa

        fields = [("conv", kind), ("sha256", pa.string())] if digests else [("conv", kind), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
        schema, out, held = pa.schema(fields), [], 0
        conv = audit = None
        at = position = 0
        state, digest = START, None

        def put(edit: str, role: str, text: str):
            nonlocal position, held
            if digests:
                digest.update(("\n" if position else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            else:
                out.append({"conv": conv, "position": position, "edit": edit, "role": role, "text": text})
                held += len(text)
            position += 1

        def inserts():
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                role = WRITES[state]
                put("I", ROLES[role], "")
                state, at = NEXT[state][role], at + 1

        def close():
            if audit is not None:
                inserts()
                if digests:
                    out.append({"conv": conv, "sha256": digest.hexdigest()})

        for batch in batches:
            for c, line, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "audit", "role", "text"))):
                if line is not None:
                    close()
                    conv, audit, at, position, state, digest = c, line, 0, 0, START, hashlib.sha256()
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    role = ROLES[WRITES[state]]
                state = NEXT[state][role[:1]]
                put(edit, role, text)
                if len(out) >= 4096 or held > 8_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out.clear()
                    held = 0
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        close()
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    return apply


def _arrow(df: DataFrame, column: str):
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(df.schema[column].dataType)


def _turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    return rows.withColumn("digest", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))


def _last_character(text: Column) -> Column:
    """The last character that is no ASCII white space; empty when there is none."""
    return F.right(F.regexp_replace(text, r"[\t-\r ]+\z", ""), F.lit(1))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per conversation: ``conv_col``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``.

    Turns are taken by ``turn_col`` (nulls first); turns of one number by role, then by the SHA-256 of the text. Null roles and
    texts are one space, so such a text is blank and such a role has to be rewritten; an empty role has no initial and fits
    nowhere. A null conversation id is a conversation of its own; repeated rows are duplicates; other columns are ignored; an
    empty table gives no rows. ``gaps`` is 0 where all turn numbers are null. ``audit`` holds the initials of the cheapest edits.

    Equal turns of one number are one row with a count from the first shuffle on, and no shuffle carries a text. Turns are
    dealt by ranges of (conversation, number, role, digest), so a conversation of any length spreads over tasks. Each task solves
    blocks of ``block`` turns for every state they can be entered and left in; the blocks' tables are chained.
    """
    kind, arrow = turns.schema[conv_col].dataType.simpleString(), _arrow(turns, conv_col)
    rows = _turns(turns, conv_col, turn_col, role_col, text_col)
    last = _last_character(F.col("text"))
    same = (rows.select("conv", "turn", "role", "digest", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
            .groupBy("conv", "turn", "role", "digest").agg(F.first("blank").alias("blank"), F.first("truncated").alias("truncated"), F.count(F.lit(1)).alias("n")))
    same = staged(same, "turns")
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    first = (same.groupBy("conv", "role", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("places")).filter("places > 1")
             .select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"))
    marked = same.join(first, same["conv"].eqNullSafe(first["c"]) & (same["role"] == first["r"]) & (same["digest"] == first["d"]), "left")
    marked = marked.select("conv", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), "blank", "truncated", F.coalesce(place > F.col("first"), F.lit(False)).alias("seen"), "n")
    order = ("conv", "turn", "role", "digest")
    dealt = staged(marked, "marked").repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = staged(dealt.select("conv", "initial", "blank", "truncated", "seen", "n").mapInArrow(_blocks(arrow, block), f"conv {kind}, {_BLOCKS}"), "blocks")
    counts = ("blank", "duplicate", "truncated", "illegal")
    whole = blocks.filter("whole").select("conv", *counts, F.col("best")[0]["cost"].alias("cost"), F.col("best")[0]["audit"].alias("audit"))
    cut = blocks.filter("NOT whole").select("conv", "seq", *counts, "first", "last", "best")
    chained = (cut.repartition("conv").sortWithinPartitions("conv", "seq")
               .mapInArrow(_chain(arrow), f"conv {kind}, {', '.join(f'{c} long' for c in counts)}, cost long, audit string"))
    numbers = same.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")).withColumnRenamed("conv", "c")
    out = whole.unionByName(chained)
    return out.join(numbers, out["conv"].eqNullSafe(numbers["c"])).select(F.col("conv").alias(conv_col), "gaps", *counts, "cost", "audit")


def _sorted_turns(turns: DataFrame, report: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = _turns(turns, conv_col, turn_col, role_col, text_col).withColumn("audit", F.lit(None).cast("string"))
    heads = report.select(F.col(conv_col).alias("conv"), "audit").selectExpr(
        "conv", f"CAST(NULL AS {turns.schema[turn_col].dataType.simpleString()}) AS turn", "CAST(NULL AS STRING) AS role", "CAST(NULL AS STRING) AS text", "CAST(NULL AS BINARY) AS digest", "audit")
    both = rows.unionByName(heads).withColumn("behind", F.col("audit").isNull())
    return both.repartition("conv").sortWithinPartitions("conv", "behind", "turn", "role", "digest").select("conv", "audit", "role", "text")


def repaired_turns(turns: DataFrame, report: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns after the edits of ``report``: ``conv_col``, ``position`` from 0, ``edit`` (K, R or I), ``role``, ``text``."""
    out = _sorted_turns(turns, report, conv_col, turn_col, role_col, text_col).mapInArrow(
        _apply(_arrow(turns, conv_col), False), f"conv {turns.schema[conv_col].dataType.simpleString()}, position long, edit string, role string, text string")
    return out.withColumnRenamed("conv", conv_col)


def repaired_digests(turns: DataFrame, report: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_col``, ``repaired_sha256``: SHA-256 over the ``role:text`` of the repaired turns, joined by line feeds.

    A hash over a whole conversation has to read it in order: one task streams it, turn by turn, from a sort that can spill."""
    out = _sorted_turns(turns, report, conv_col, turn_col, role_col, text_col).mapInArrow(
        _apply(_arrow(turns, conv_col), True), f"conv {turns.schema[conv_col].dataType.simpleString()}, sha256 string")
    return out.select(F.col("conv").alias(conv_col), F.col("sha256").alias("repaired_sha256"))


def damage(conversations: DataFrame) -> DataFrame:
    """Known faults for a test of the repair, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a turn, 1 empties its text,
    2 removes its sentence marks, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), fault.alias("fault")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """The report of damaged conversations and the digest of what is left, for every original id, those with no turn left too."""
    broken = damage(conversations)
    report = staged(repair(broken), "repair")
    digests = repaired_digests(broken, report).withColumnRenamed("conv_id", "c")
    found = report.join(digests, report["conv_id"].eqNullSafe(digests["c"])).drop("c").withColumnRenamed("conv_id", "c")
    ids = conversations.groupBy("conv_id").agg(F.lit(1).alias("one"))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return (ids.join(found, ids["conv_id"].eqNullSafe(found["c"]), "left")
            .select("conv_id", *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))
