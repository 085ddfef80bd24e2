"""Conversation structure repair: the cheapest edits that make role order legal, found by depth-first branch-and-bound."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from pressroute.llm.common import stage
from pressroute.operators.joins import match, split_join

#: A conversation of more rows is cut into blocks of at most so many.
BLOCK_ROWS = 1024
BLANKS = " \t\n\x0b\x0c\r"
FAULTS = BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Rows of a conversation that one task cannot judge alone.
OPEN = -1
DELETE, INSERT, REROLE, STAYS_TRUNCATED = 2, 5, 1, 5
NEVER = 1 << 50

# What has been said last: nothing, the system, the user, the assistant. The legal order is s?(ua)+ or nothing.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Where a row of the right role leads from each state, and that role.
FORCED = [(USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user")]
LEGAL_PAIRS = {"su", "ua", "au"}


def _with_inserts(costs: list[int]) -> list[int]:
    for _ in range(2):  # two in a row at most: three lead where one leads
        costs = [min(c, INSERT + costs[FORCED[q][0]]) for q, c in enumerate(costs)]
    return costs


def suffix_bounds(rows: list[tuple[str, int]], exits: list[int] | None) -> list[list[int]]:
    """``bounds[i][state]``: no legal edit of rows i, i + 1, .. from there costs less. ``exits`` are the costs of what
    follows the last row, by state; None if nothing follows."""
    bounds = [exits if exits is not None else _with_inserts([0, NEVER, NEVER, 0])]
    for initial, fault in reversed(rows):
        after, stays = bounds[-1], STAYS_TRUNCATED if fault == TRUNCATED else 0
        costs = [DELETE + c for c in after]
        if fault not in (BLANK, DUPLICATE):
            for q in range(4):
                costs[q] = min(costs[q], REROLE + stays + after[FORCED[q][0]])
                if (q, initial) in KEPT:
                    costs[q] = min(costs[q], stays + after[KEPT[q, initial]])
        bounds.append(_with_inserts(costs))
    return bounds[::-1]


def cheapest_edits(rows: list[tuple[str, int]], entry: int = START, exits: list[int] | None = None) -> tuple[int, str, int] | None:
    """``(cost, audit, state)`` of the cheapest edits of ``rows`` (role initial, fault), of equal costs the ASCII-least audit.

    Depth first with an explicit stack, the child with the lowest bound first. A prefix is given up when its cost and
    the suffix bound exceed the incumbent's cost, or equal it with a greater audit, or when its node (rows done, state)
    has been reached by a prefix that was no worse. Two prefixes of one node and one cost are never prefixes of each
    other, so the lesser of them stays the lesser whatever follows. An empty stack proves the incumbent.
    """
    bounds = suffix_bounds(rows, exits)
    end = exits if exits is not None else [0, NEVER, NEVER, 0]
    best: tuple[int, str, int] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        least = cost + bounds[i][state]
        if least >= NEVER or best and (least > best[0] or least == best[0] and audit > best[1][:len(audit)]):
            continue
        if (i, state) in reached and reached[i, state] <= (cost, audit):
            continue
        reached[i, state] = (cost, audit)
        if i == len(rows) and end[state] < NEVER and (best is None or (cost + end[state], audit) < best[:2]):
            best = (cost + end[state], audit, state)
        children = []
        if i < len(rows):
            initial, fault = rows[i]
            stays = STAYS_TRUNCATED if fault == TRUNCATED else 0
            children.append((i + 1, state, cost + DELETE, audit + "D"))
            if fault not in (BLANK, DUPLICATE):
                children.append((i + 1, FORCED[state][0], cost + REROLE + stays, audit + "R"))
                if (state, initial) in KEPT:
                    children.append((i + 1, KEPT[state, initial], cost + stays, audit + "K"))
        if i < len(rows) or exits is None:
            children.append((i, FORCED[state][0], cost + INSERT, audit + "I"))
        stack += sorted(children, key=lambda c: (c[2] + bounds[c[0]][c[1]], c[3]), reverse=True)
    return best


def edits_of(audit: str, rows: list[tuple[str, int]], entry: int = START) -> list[tuple[str, str, str | None, str]]:
    """Per row ``(before, edit, role, after)``: initials of rows to insert, the letter, and the new role if there is one."""
    out, state, before, at = [], entry, "", 0
    for letter in audit:
        if letter == "I":
            state, role = FORCED[state]
            before += role[0]
            continue
        role = None
        if letter == "R":
            state, role = FORCED[state]
        elif letter == "K":
            state = KEPT[state, rows[at][0]]
        out.append((before, letter, role, ""))
        before, at = "", at + 1
    if before and out:
        out[-1] = (*out[-1][:3], before)
    return out


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults planted by crc32(``conv_id:turn``) mod 20: 0 drops the row, 1 empties its
    text, 2 takes out ``.!?``, 3 repeats it, 4 makes it the user's. Nulls count as one space (ids and turns stay null)."""
    def said(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    case = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20))
    return rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), case.alias("__case")).where("__case <> 0").select(
        "conv_id", "turn", F.when(F.col("__case") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("__case") == 1, "").when(F.col("__case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("__case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy")).drop("__copy")


def _known(rows: DataFrame) -> DataFrame:
    """The rows with ``said``, a digest of conversation, role and text. Null roles and texts count as one space."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    parts = F.concat(F.octet_length(conv).cast("string"), conv, F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.unhex(F.sha2(parts, 256)).alias("said"))


EDIT = ["before", "edit", "new_role", "after"]


def _table(rows: list[tuple], names: list[str], types: dict):
    import pyarrow as pa

    columns = zip(*rows) if rows else ([] for _ in names)
    return pa.record_batch([pa.array(list(c), types[n]) for n, c in zip(names, columns)], names)


def _groups(batches: Iterator, keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows whose first ``keys`` cells are equal, over the borders of batches."""
    key, run = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if run and row[:keys] != key:
                yield key, run
                run = []
            key = row[:keys]
            run.append(row[keys:])
    if run:
        yield key, run


def _settle(ordered: DataFrame, block_rows: int) -> DataFrame:
    """Judges and edits each conversation that lies whole inside a range. Rows of the first and the last conversation of a
    range, and of conversations of over ``block_rows`` rows, come back open, with their place."""
    ids = {n: ordered.schema[n].dataType.simpleString() for n in ("conv_id", "turn")}
    names = ["conv_id", "turn", "role", "said", "row", "part", "at", "blank", "truncated", "fault", *EDIT]

    def run(batches: Iterator):
        import pyarrow as pa

        types = {"role": pa.string(), "said": pa.binary(), "row": pa.int64(), "part": pa.int32(), "at": pa.int64(), "blank": pa.bool_(),
                 "truncated": pa.bool_(), "fault": pa.int32(), **{n: pa.string() for n in EDIT}}
        out: list[tuple] = []
        run_: list[tuple] = []
        current, first, cut, at = None, True, False, 0

        def close(last: bool) -> None:
            if first or last or cut:
                out.extend((*r, OPEN, None, None, None, None) for r in run_)
            else:
                seen, judged = set(), []
                for r in run_:
                    judged.append((r[2][:1], BLANK if r[7] else DUPLICATE if r[3] in seen else TRUNCATED if r[8] else 0))
                    seen.add(r[3])
                _, audit, _ = cheapest_edits(judged)
                out.extend((*r, j[1], *e) for r, j, e in zip(run_, judged, edits_of(audit, judged)))
            run_.clear()

        for batch in batches:
            types.update({n: batch.schema.field(n).type for n in ("conv_id", "turn")})
            for conv, turn, role, said, row, part, blank, truncated in zip(*(c.to_pylist() for c in batch.columns)):
                if run_ and conv != current or cut and conv != current:
                    close(False)
                    first, cut = False, False
                elif len(run_) == block_rows:
                    cut = True
                    close(False)
                current = conv
                run_.append((conv, turn, role, said, row, part, at, blank, truncated))
                at += 1
            if len(out) >= 10_000:
                yield _table(out, names, types)
                out.clear()
        close(True)
        if out:
            yield _table(out, names, types)

    return ordered.select("conv_id", "turn", "role", "said", "row", "part", "blank", "truncated").mapInArrow(
        run, f"conv_id {ids['conv_id']}, turn {ids['turn']}, role string, said binary, row long, part int, at long, blank boolean, "
             "truncated boolean, fault int, before string, edit string, new_role string, after string")


def _block_costs(blocks: DataFrame) -> DataFrame:
    """``conv_id, part, block, costs``: the least cost from each state before a block to each state after it."""
    def run(batches: Iterator):
        import pyarrow as pa

        for batch_types, key, rows in _typed_groups(batches, 3):
            judged = [(initial, fault) for _, initial, fault in rows]
            to = [suffix_bounds(judged, [0 if q == out else NEVER for q in range(4)])[0] for out in range(4)]
            yield _table([(*key, [to[out][q] for q in range(4) for out in range(4)])], ["conv_id", "part", "block", "costs"],
                         {**batch_types, "costs": pa.list_(pa.int64())})

    return _by_block(blocks, ["initial", "fault"]).mapInArrow(
        run, f"conv_id {blocks.schema['conv_id'].dataType.simpleString()}, part int, block long, costs array<long>")


def _typed_groups(batches: Iterator, keys: int):
    """As ``_groups``, with the Arrow types of the columns."""
    types: dict = {}

    def noted():
        for batch in batches:
            types.update({f.name: f.type for f in batch.schema})
            yield batch

    for key, rows in _groups(noted(), keys):
        yield types, key, rows


def _by_block(df: DataFrame, rest: list[str]) -> DataFrame:
    keys = ["conv_id", "part", "block"]
    return df.select(*keys, "at", *rest).repartition(*keys).sortWithinPartitions(*keys, "at")


def _exits(costs: DataFrame) -> DataFrame:
    """``conv_id, part, block, exits``: what the blocks after this one cost, by state. One row a block."""
    def run(pdf):
        pdf = pdf.sort_values(["part", "block"], ascending=False)
        after, exits = _with_inserts([0, NEVER, NEVER, 0]), []
        for costs in pdf["costs"]:
            exits.append(after)
            after = [min(int(costs[4 * q + out]) + after[out] for out in range(4)) for q in range(4)]
            after = [min(c, NEVER) for c in after]
        return pdf.assign(exits=exits, last=[i == 0 for i in range(len(exits))])[["conv_id", "part", "block", "exits", "last"]]

    return costs.groupBy("conv_id").applyInPandas(
        run, f"conv_id {costs.schema['conv_id'].dataType.simpleString()}, part int, block long, exits array<long>, last boolean")


def _block_edits(blocks: DataFrame) -> DataFrame:
    """The cheapest edits of every block from each state before it: a row for each row and state."""
    def run(batches: Iterator):
        import pyarrow as pa

        names = ["conv_id", "part", "block", "at", "entry", "exit", *EDIT]
        for types, key, rows in _typed_groups(batches, 3):
            judged, exits, last = [r[1:3] for r in rows], rows[0][3], rows[0][4]
            out = []
            for entry in range(4):
                if found := cheapest_edits(judged, entry, None if last else exits):
                    out += [(*key, r[0], entry, found[2], *e) for r, e in zip(rows, edits_of(found[1], judged, entry))]
            yield _table(out, names, {**types, "entry": pa.int32(), "exit": pa.int32(), **{n: pa.string() for n in EDIT}})

    return _by_block(blocks, ["initial", "fault", "exits", "last"]).mapInArrow(
        run, f"conv_id {blocks.schema['conv_id'].dataType.simpleString()}, part int, block long, at long, entry int, exit int, "
             "before string, edit string, new_role string, after string")


def _entries(steps: DataFrame) -> DataFrame:
    """``conv_id, part, block, entry``: the state in which the cheapest edits reach each block. Four rows a block at most."""
    def run(pdf):
        state, chosen = START, []
        for _, steps_ in pdf.sort_values(["part", "block"]).groupby(["part", "block"], sort=False):
            row = steps_[steps_["entry"] == state].iloc[0]
            chosen.append(row)
            state = row["exit"]
        return type(pdf)(chosen)[["conv_id", "part", "block", "entry"]]

    return steps.groupBy("conv_id").applyInPandas(
        run, f"conv_id {steps.schema['conv_id'].dataType.simpleString()}, part int, block long, entry int")


def plan_repairs(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``conv_id, turn, role, said, row, fault`` and the edit of every row of ``conv_id, turn, role, text``:
    ``before`` and ``after`` (initials of rows to insert), ``edit`` (K, R, D) and ``new_role``.

    A conversation's rows go by turn, nulls first; rows of one turn by role and then by a digest of role and text, so
    copies stand together. A row without a visible character is blank, one whose role and text stood before it is a
    duplicate (both must go), one whose last visible character is none of ``.!?`` is truncated; the first fault counts.
    A role is told by its first character; one that has none, or another than s, u or a, cannot be kept.

    Rows without their texts are sorted into ranges. A conversation inside a range is edited where it stands. Those at
    a range's border, and any of over ``block_rows`` rows (a conversation may hold a third of the table), are cut into
    blocks: costs between the states of each block, carried from the last block back, tell every block what follows it,
    each block is then edited by the same search from every state, and the states are chained from the first on. Groups
    on one conversation see four numbers a block, so no task holds a long one.

    Null roles and texts count as one space, null ids are one conversation. Repeated rows are duplicates of each other.
    Texts of any length are read once for their digest. An empty table gives an empty plan. Other columns are ignored.
    """
    text = F.col("text")
    facts = _known(rows).select(
        "conv_id", "turn", "role", "said", F.monotonically_increasing_id().alias("row"),
        (F.btrim(text, F.lit(BLANKS)) == "").alias("blank"), (~F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    order = ["conv_id", "turn", "role", "said", "row"]
    ordered = facts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    settled = stage(_settle(ordered, block_rows), "conversations-settled")
    result = ["conv_id", "turn", "role", "said", "row", "fault", *EDIT]

    left = settled.where(F.col("fault") == OPEN)
    place = F.struct("part", "at")
    first = left.groupBy("said").agg(F.min(place).alias("__first"))
    fault = F.when(F.col("blank"), BLANK).when(place != F.col("__first"), DUPLICATE).when(F.col("truncated"), TRUNCATED).otherwise(0)
    blocks = stage(split_join(left, first, ["said"]).select(
        "conv_id", "turn", "role", "said", "row", "part", "at", F.floor(F.col("at") / block_rows).alias("block"),
        F.left("role", F.lit(1)).alias("initial"), fault.alias("fault")), "conversations-blocks")
    exits = _exits(_block_costs(blocks))
    edits = stage(_block_edits(match(blocks, exits, ["conv_id", "part", "block"])), "conversations-edits")
    chosen = _entries(edits.select("conv_id", "part", "block", "entry", "exit").distinct())
    edits = match(edits, chosen, ["conv_id", "part", "block", "entry"], "left_semi").select("conv_id", "part", "at", *EDIT)
    joined = match(blocks, edits, ["conv_id", "part", "at"])
    return settled.where(F.col("fault") != OPEN).select(*result).unionByName(joined.select(*result))


def _in_order(conversations: DataFrame, rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each conversation's edits and, after those of a row, its text. Texts are shuffled once."""
    nothing = F.lit(None)
    texts = _known(rows).select("conv_id", "turn", "role", "said", F.lit(1).alias("kind"), nothing.cast("long").alias("row"), "text",
                                nothing.cast("int").alias("fault"), *[nothing.cast("string").alias(n) for n in EDIT])
    edits = plan.select("conv_id", "turn", "role", "said", F.lit(0).alias("kind"), "row", nothing.cast("string").alias("text"), "fault", *EDIT)
    named = conversations.select("conv_id").distinct().select(
        "conv_id", *[nothing.cast(texts.schema[c].dataType).alias(c) for c in ("turn", "role", "said")], F.lit(-1).alias("kind"),
        *[nothing.cast(texts.schema[c].dataType).alias(c) for c in ("row", "text", "fault", *EDIT)])
    order = ["conv_id", "turn", "role", "said", "kind", "row"]
    return texts.unionByName(edits).unionByName(named).repartition("conv_id").sortWithinPartitions(*order)


class _Walk:
    """One conversation, row by row: the repaired rows as they become known, and what is told of the whole."""

    def __init__(self):
        self.counts, self.illegal, self.cost, self.audit = [0] * 4, 0, 0, []
        self.initial, self.turn, self.least, self.turns = None, None, None, 0
        self.waiting: deque = deque()

    def edit(self, turn, role: str, fault: int, before: str, edit: str, new_role: str | None, after: str) -> None:
        self.counts[fault] += 1
        self.illegal += self.initial is not None and self.initial + role[:1] not in LEGAL_PAIRS
        self.initial = role[:1]
        if turn is not None and turn != self.turn:
            self.least = turn if self.least is None else self.least
            self.turn, self.turns = turn, self.turns + 1
        self.audit.append("I" * len(before) + edit + "I" * len(after))
        self.cost += INSERT * len(before + after) + (DELETE if edit == "D" else REROLE * (edit == "R") + STAYS_TRUNCATED * (fault == TRUNCATED))
        inserted = {"u": "user", "a": "assistant"}
        self.waiting.extend([inserted[c], ""] for c in before)
        if edit != "D":
            self.waiting.append([new_role or role, None])
        self.waiting.extend([inserted[c], ""] for c in after)

    def text(self, text: str) -> None:
        row = next((w for w in self.waiting if w[1] is None), None)
        if row:
            row[1] = text

    def ready(self) -> Iterator[tuple[str, str]]:
        while self.waiting and self.waiting[0][1] is not None:
            yield tuple(self.waiting.popleft())

    @property
    def gaps(self) -> int:
        return 0 if self.turn is None else self.turn - self.least + 1 - self.turns


def _walk(batches: Iterator, begin, repaired, end) -> Iterator:
    """Drives a _Walk over sorted rows; ``begin(conv_id)``, ``repaired(role, text)`` and ``end(walk)`` see what it finds."""
    walk, current = None, None
    for batch in batches:
        for conv, turn, role, said, kind, row, text, fault, *edit in zip(*(c.to_pylist() for c in batch.columns)):
            if walk is None or conv != current:
                if walk is not None:
                    end(walk)
                walk, current = _Walk(), conv
                begin(conv)
            if kind == 0:
                walk.edit(turn, role, fault, *edit)
            elif kind == 1:
                walk.text(text)
            for got in walk.ready():
                repaired(*got)
        yield batch.schema
    if walk is not None:
        end(walk)
        yield None


def apply_repairs(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``conv_id, place, role, text``: the repaired conversations, places from 0. A conversation passes through one task in
    order, a batch of rows at a time."""
    def run(batches: Iterator):
        import pyarrow as pa

        out, types, now = [], {"place": pa.int64(), "role": pa.string(), "text": pa.string()}, {}
        for schema in _walk(batches, lambda conv: now.update(conv=conv, place=0),
                            lambda role, text: (out.append((now["conv"], now["place"], role, text)), now.update(place=now["place"] + 1)), lambda walk: None):
            types["conv_id"] = schema.field("conv_id").type if schema else types["conv_id"]
            yield _table(out, ["conv_id", "place", "role", "text"], types)
            out.clear()

    return _in_order(rows, rows, plan).mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, role string, text string")


def repair_report(conversations: DataFrame, rows: DataFrame, plan: DataFrame) -> DataFrame:
    """One row for every id of ``conversations``: faults of ``rows`` and what repairing them cost.

    ``gaps`` (missing turns), ``blank, duplicate, truncated, illegal`` (adjacent roles out of order), ``cost``, ``audit``
    (edits' initials in order) and ``repaired_sha256`` of the repaired lines ``role:text``. The digest takes lines in
    order, so a conversation passes through one task, a batch at a time; nothing of it is held but the audit.
    """
    def run(batches: Iterator):
        import pyarrow as pa

        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        out, types, now = [], {**{n: pa.int64() for n in names[1:7]}, "audit": pa.string(), "repaired_sha256": pa.string()}, {}

        def begin(conv):
            now.update(conv=conv, sha=hashlib.sha256(), lines=0)

        def repaired(role, text):
            now["sha"].update(f"{chr(10) if now['lines'] else ''}{role}:{text}".encode())
            now["lines"] += 1

        def end(walk):
            out.append((now["conv"], walk.gaps, *walk.counts[1:], walk.illegal, walk.cost, "".join(walk.audit), now["sha"].hexdigest()))

        for schema in _walk(batches, begin, repaired, end):
            types["conv_id"] = schema.field("conv_id").type if schema else types["conv_id"]
            yield _table(out, names, types)
            out.clear()

    return _in_order(conversations, rows, plan).mapInArrow(
        run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, "
             "cost long, audit string, repaired_sha256 string")
