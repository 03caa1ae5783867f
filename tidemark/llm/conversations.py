"""Repair of conversations by a generalised LR parse of their roles.

The grammar of roles is turned into LR tables. A parse walks over the rows of a conversation with a graph-structured
stack: every live top is a node with a link to the node below, nodes are shared, and equal tops are merged by the least
(cost, audit). Each row may be kept, given another role or deleted, and roles may be put in anywhere, each at a price.

Equal tops have taken the same rows, so audits of equal cost that meet there differ before either ends: what follows
cannot change which is the lesser, and merging loses no repair.

A large conversation is cut into blocks of turns. A block is parsed from every node that the grammar can reach, which
gives a table from node to node of (cost, audit); the tables are joined in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.base import prepare, query
from tidemark.llm.tables import written
from tidemark.scan import BLOCK, null_safe_left, with_blocks

#: Grammar of role initials: an optional system turn, then pairs of user and assistant; or nothing.
ROLES = {"T": ["", "P", "s P"], "P": ["u a", "P u a"]}
#: Roles that a row may be given and that may be put in, by their initial.
NAMES = {"u": "user", "a": "assistant"}
#: Prices. A truncated row that stays costs ``truncated`` more.
PRICES = {"K": 0, "R": 1, "D": 2, "I": 5, "truncated": 5}
#: Rows of a conversation from which on it is parsed in blocks.
ROWS_PER_BLOCK = 50_000
#: More nodes than this, and the grammar nests without end.
MOST_NODES = 1_000

FIGURES = "n long, blank long, duplicate long, truncated long, illegal long, first string, last string"
PATHS = "paths array<struct<entry: int, exit: int, cost: long, audit: string>>"


@dataclass(frozen=True)
class Tables:
    """LR tables: shifts and gotos by (state, symbol), reductions by (state, next terminal), states that accept."""

    moves: dict
    reductions: dict
    start: str


def lr_tables(grammar: dict[str, list[str]]) -> Tables:
    """Simple LR tables; the first rule is the start. Several reductions of one state are all kept."""
    start = next(iter(grammar))
    rules = [("", (start,))] + [(head, tuple(body.split())) for head, bodies in grammar.items() for body in bodies]

    def closure(items):
        items, todo = set(items), list(items)
        while todo:
            rule, dot = todo.pop()
            body = rules[rule][1]
            for i, (head, _) in enumerate(rules):
                if dot < len(body) and head == body[dot] and (i, 0) not in items:
                    items.add((i, 0))
                    todo.append((i, 0))
        return frozenset(items)

    empty = {head for head, body in rules if not body}
    first = {head: set() for head in grammar}
    follow = {head: set() for head in grammar} | {"": {"$"}}
    grown = True
    while grown:
        before = sum(map(len, [*first.values(), *follow.values(), empty]))
        for head, body in rules:
            if all(s in empty for s in body):
                empty.add(head)
            after = set(follow[head])
            for symbol in reversed(body):
                if symbol in grammar:
                    follow[symbol] |= after
                    after = first[symbol] | (after if symbol in empty else set())
                else:
                    after = {symbol}
            if head:
                for symbol in body:
                    first[head] |= first[symbol] if symbol in grammar else {symbol}
                    if symbol not in empty:
                        break
        grown = before != sum(map(len, [*first.values(), *follow.values(), empty]))
    states, moves, reductions = {closure([(0, 0)]): 0}, {}, {}
    todo = list(states)
    while todo:
        items = todo.pop()
        at = states[items]
        for symbol in sorted({rules[r][1][d] for r, d in items if d < len(rules[r][1])}):
            to = closure([(r, d + 1) for r, d in items if rules[r][1][d : d + 1] == (symbol,)])
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            moves[at, symbol] = states[to]
        for r, d in sorted(items):
            if d == len(rules[r][1]):
                for terminal in follow[rules[r][0]]:
                    reductions.setdefault((at, terminal), []).append(rules[r])
    return Tables(moves, reductions, start)


class Stack:
    """Nodes of the graph-structured stack, numbered as they are made; node 0 is the bottom."""

    def __init__(self, grammar: dict[str, list[str]]):
        self.tables = lr_tables(grammar)
        self.nodes: list[tuple[int, int]] = [(0, -1)]
        self.known = {(0, -1): 0}
        self.shifted: dict[tuple[int, str], tuple[int, ...]] = {}
        self.accepting: dict[int, bool] = {}

    def node(self, state: int, below: int) -> int:
        """The one node of this state on top of ``below``."""
        at = self.known.get((state, below))
        if at is None:
            if len(self.nodes) >= MOST_NODES:
                raise ValueError("the grammar of roles nests without end; use left recursion")
            at = self.known[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return at

    def reduced(self, top: int, terminal: str) -> set[int]:
        """Nodes that reductions before ``terminal`` lead to, ``top`` itself included."""
        found, todo = {top}, [top]
        while todo:
            node = todo.pop()
            for head, body in self.tables.reductions.get((self.nodes[node][0], terminal), ()):
                below = node
                for _ in body:
                    below = self.nodes[below][1]
                to = self.tables.moves.get((self.nodes[below][0], head))
                if to is not None and (made := self.node(to, below)) not in found:
                    found.add(made)
                    todo.append(made)
        return found

    def shift(self, top: int, terminal: str) -> tuple[int, ...]:
        """Tops after ``terminal``; none where the grammar has no such step."""
        got = self.shifted.get((top, terminal))
        if got is None:
            made = []
            for node in sorted(self.reduced(top, terminal)):
                to = self.tables.moves.get((self.nodes[node][0], terminal))
                if to is not None:
                    made.append(self.node(to, node))
            got = self.shifted[top, terminal] = tuple(made)
        return got

    def accepts(self, top: int) -> bool:
        if top not in self.accepting:
            done = self.tables.moves.get((0, self.tables.start))
            self.accepting[top] = any(self.nodes[n] == (done, 0) for n in self.reduced(top, "$"))
        return self.accepting[top]

    def reachable(self, terminals: str) -> list[int]:
        """All tops that some row of ``terminals`` leads to."""
        found, todo = {0}, [0]
        while todo:
            top = todo.pop()
            for terminal in terminals:
                for to in self.shift(top, terminal):
                    if to not in found:
                        found.add(to)
                        todo.append(to)
        return sorted(found)


class Audit:
    """An audit as a chain of edits that shares its beginning with others."""

    __slots__ = ("before", "edit", "length")

    def __init__(self, before: Audit | None, edit: str):
        self.before, self.edit = before, edit
        self.length = before.length + 1 if before else 1

    @staticmethod
    def less(a: Audit | None, b: Audit | None) -> bool:
        """Whether ``a`` comes first: their first difference is the last one met on the way back to what they share."""
        n_a, n_b = a.length if a else 0, b.length if b else 0
        first = n_a < n_b
        for _ in range(n_a - n_b):
            a = a.before
        for _ in range(n_b - n_a):
            b = b.before
        while a is not b:
            if a.edit != b.edit:
                first = a.edit < b.edit
            a, b = a.before, b.before
        return first

    @staticmethod
    def text(a: Audit | None) -> str:
        edits = []
        while a:
            edits.append(a.edit)
            a = a.before
        return "".join(reversed(edits))


class Repair:
    """Cheapest repairs of rows, fed one by one."""

    def __init__(self, grammar=ROLES, names=NAMES, prices=PRICES):
        self.stack, self.names, self.prices = Stack(grammar), names, prices
        terminals = {s for bodies in grammar.values() for body in bodies for s in body.split()} - set(grammar)
        self.entries = self.stack.reachable("".join(sorted(terminals)))
        if any(len([t for t in names if self.stack.shift(top, t)]) > 1 for top in self.entries):
            raise ValueError("where a role may be given or put in, the grammar must leave one choice")

    def sole(self, tops: tuple[int, ...]) -> str:
        """The role that may be given or put in at these tops."""
        return next(t for top in tops for t in self.names if self.stack.shift(top, t))

    def after(self, tops: tuple[int, ...], terminal: str) -> tuple[int, ...]:
        return tuple(to for top in tops for to in self.stack.shift(top, terminal))

    @staticmethod
    def offer(tops: dict, top: int, cost: int, before: Audit | None, edit: str) -> bool:
        """Merge a way to ``top``: the least (cost, audit) stays."""
        held = tops.get(top)
        if held is not None and held[0] < cost:
            return False
        made = Audit(before, edit)
        if held is not None and held[0] == cost and not Audit.less(made, held[1]):
            return False
        tops[top] = (cost, made)
        return True

    def inserted(self, tops: dict) -> dict:
        """``tops`` and what putting in roles leads to."""
        todo = list(tops)
        while todo:
            top = todo.pop()
            cost, audit = tops[top]
            for terminal in self.names:
                for to in self.stack.shift(top, terminal):
                    if self.offer(tops, to, cost + self.prices["I"], audit, "I"):
                        todo.append(to)
        return tops

    def row(self, tops: dict, initial: str, fault: str) -> dict:
        """Tops after a row."""
        made: dict = {}
        prices, drop_only = self.prices, fault in ("blank", "duplicate")
        more = prices["truncated"] if fault == "truncated" else 0
        for top, (cost, audit) in self.inserted(tops).items():
            self.offer(made, top, cost + prices["D"], audit, "D")
            if drop_only:
                continue
            for to in self.stack.shift(top, initial):
                self.offer(made, to, cost + prices["K"] + more, audit, "K")
            for terminal in self.names:
                if terminal != initial:
                    for to in self.stack.shift(top, terminal):
                        self.offer(made, to, cost + prices["R"] + more, audit, "R")
        return made

    def ending(self, tops: dict, last: bool) -> list[dict]:
        """Exits of a block; behind the last row roles may be put in once more."""
        tops = self.inserted(tops) if last else tops
        return [{"exit": t, "cost": c, "audit": Audit.text(a)} for t, (c, a) in tops.items()]

    def best(self, exits: list[dict]) -> tuple[int, str]:
        return min((e["cost"], e["audit"]) for e in exits if self.stack.accepts(e["exit"]))


def row_features(rows: DataFrame, text: str) -> DataFrame:
    """``_blank`` (no character but ASCII white space) and ``_ended`` (the last other character ends a sentence)."""
    return rows.withColumns(
        {"_blank": ~F.col(text).rlike(r"[^\x20\x09-\x0D]"), "_ended": F.col(text).rlike(r"[.!?][\x20\x09-\x0D]*\z")}
    )


ORDER = ("turn", "role", "text")


def in_order(rows: DataFrame) -> DataFrame:
    """Conversations, or their blocks, whole in one partition and in order; nulls come first."""
    keys = ["conv", BLOCK] if BLOCK in rows.columns else ["conv"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, *ORDER)


def parse_blocks(rows: DataFrame, settings: dict) -> DataFrame:
    """Figures and repair tables of each conversation or block.

    Rows come in order, so a task holds one conversation's roles and the hashes of its rows at a time, no texts.
    """
    blocked = BLOCK in rows.columns
    columns = ["conv", *([BLOCK, "_earlier"] if blocked else []), "role", "text", "_blank", "_ended"]
    kind, arrow = conv_kind(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, unit, state = Repair(**settings), None, None

        def closed():
            paths = [{"entry": e, **x} for e, tops in state["tops"].items() for x in repair.ending(tops, unit[1] is None)]
            return {"conv": unit[0], "block": unit[1], **state["figures"], "paths": paths}

        for batch in batches:
            data = batch.to_pydict()
            blocks = data.get(BLOCK) or [None] * batch.num_rows
            earlier = data.get("_earlier") or [None] * batch.num_rows
            out = []
            for conv, block, before, role, text, blank, ended in zip(data["conv"], blocks, earlier, data["role"], data["text"], data["_blank"], data["_ended"]):
                if unit != (conv, block):
                    if unit is not None:
                        out.append(closed())
                    unit = (conv, block)
                    # a part of a large conversation may be entered at any node
                    state = {"tops": {e: {e: (0, None)} for e in (repair.entries if block is not None else [0])}, "seen": set(), "figures": dict.fromkeys(("n", "blank", "duplicate", "truncated", "illegal"), 0) | {"first": None, "last": None}}
                figures = state["figures"]
                name = hashlib.md5(f"{role}\0{text}".encode()).digest()
                known = name in state["seen"] or bool(before)
                state["seen"].add(name)
                fault = "blank" if blank else "duplicate" if known else "" if ended else "truncated"
                initial = role[:1]
                figures["n"] += 1
                if fault:
                    figures[fault] += 1
                if figures["last"] is None:
                    figures["first"] = initial
                elif figures["last"] + initial not in ("su", "ua", "au"):
                    figures["illegal"] += 1
                figures["last"] = initial
                state["tops"] = {e: repair.row(tops, initial, fault) for e, tops in state["tops"].items()}
            yield from rows_of(out)
        if unit is not None:
            yield from rows_of([closed()])

    made = pa.schema(
        [pa.field("conv", arrow), pa.field("block", pa.int64()), *[pa.field(c, pa.int64()) for c in ("n", "blank", "duplicate", "truncated", "illegal")], pa.field("first", pa.string()), pa.field("last", pa.string()), pa.field("paths", pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))]
    )

    def rows_of(out):
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=made)

    return in_order(rows).select(*columns).mapInArrow(run, f"conv {kind}, block long, {FIGURES}, {PATHS}")


def conv_kind(rows: DataFrame) -> tuple[str, pa.DataType]:
    """Type of the conversations' key, in Spark's and Arrow's terms."""
    kind = rows.schema["conv"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def joined_blocks(parsed: DataFrame, settings: dict) -> DataFrame:
    """The cheapest repair of each conversation from the tables of its blocks, in order."""
    kind, arrow = conv_kind(parsed)
    schema = pa.schema([pa.field("conv", arrow), *[pa.field(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], pa.field("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, conv, sums, tops, last, blocked = Repair(**settings), (), None, None, None, False

        def closed():
            exits = [{"exit": t, "cost": c, "audit": a} for t, (c, a) in tops.items()]
            if blocked:
                # roles may still be put in behind the last block
                exits = repair.ending({t: (c, as_chain(a)) for t, (c, a) in tops.items()}, True)
            cost, audit = repair.best(exits)
            return {"conv": conv[0], **sums, "cost": cost, "audit": audit}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if conv != (row["conv"],):
                    if sums is not None:
                        out.append(closed())
                    conv, sums, last = (row["conv"],), dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), None
                    tops, blocked = {0: (0, "")}, row["block"] is not None
                for c in sums:
                    sums[c] += row[c]
                if last is not None and last + row["first"] not in ("su", "ua", "au"):
                    sums["illegal"] += 1
                last = row["last"]
                after: dict = {}
                for path in row["paths"]:
                    held = tops.get(path["entry"])
                    if held is not None:
                        way = (held[0] + path["cost"], held[1] + path["audit"])
                        after[path["exit"]] = min(way, after.get(path["exit"], way))
                tops = after
            yield from rows_of(out)
        if sums is not None:
            yield from rows_of([closed()])

    def rows_of(out):
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    ordered = parsed.repartition("conv").sortWithinPartitions("conv", "block").select("conv", "blank", "duplicate", "truncated", "illegal", "first", "last", "paths", "block")
    return ordered.mapInArrow(run, f"conv {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def as_chain(edits: str) -> Audit | None:
    chain = None
    for edit in edits:
        chain = Audit(chain, edit)
    return chain


def earlier_rows(rows: DataFrame) -> DataFrame:
    """``_earlier``: the row's role and text stand in an earlier block of its conversation."""
    named = rows.withColumn("_name", F.when(F.col(BLOCK).isNotNull(), F.md5(F.concat_ws("\0", "role", "text"))))
    first = named.where(F.col(BLOCK).isNotNull()).groupBy("conv", "_name").agg(F.min(BLOCK).alias("_from"))
    # one row per block and name, so a name that fills a conversation is no large key
    held = named.where(F.col(BLOCK).isNotNull()).select("conv", BLOCK, "_name").distinct()
    later = null_safe_left(held, first, ["conv", "_name"]).where(F.col("_from") < F.col(BLOCK)).select("conv", BLOCK, "_name", F.lit(True).alias("_earlier"))
    return null_safe_left(named, later, ["conv", BLOCK, "_name"]).drop("_name")


def repair(rows: DataFrame, rows_per_block: int = ROWS_PER_BLOCK, grammar=ROLES, names=NAMES, prices=PRICES) -> DataFrame:
    """Faults and cheapest repair of each conversation of ``rows`` (conv, turn, role, text).

    A row per conversation that has rows: conv, blank, duplicate, truncated (rows by their first fault), illegal
    (neighbours that the dialogue has not), cost, audit (edits in order: K keep, R give a role, D delete, I put in), the
    least audit where costs are equal. Null roles and texts are one blank, null turns come first, a null conv is a
    conversation; rows of one turn stand by role and text, so repeated rows are neighbours. Other columns are not
    read, an empty table gives an empty result. Rows of one single turn are not cut into blocks.
    """
    prepare(rows.sparkSession)
    settings = {"grammar": grammar, "names": names, "prices": prices}
    return joined_blocks(parse_blocks(blocked_rows(rows, rows_per_block), settings), settings)


def blocked_rows(rows: DataFrame, rows_per_block: int | None) -> DataFrame:
    plain = rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    plain = with_blocks(plain, ["conv"], "turn", rows_per_block)
    plain = row_features(plain, "text")
    return earlier_rows(plain) if BLOCK in plain.columns else plain


def repaired(rows: DataFrame, verdicts: DataFrame, grammar=ROLES, names=NAMES, prices=PRICES) -> DataFrame:
    """The turns of each conversation of ``verdicts`` after its edits: conv, place (from 0), role, text, edit.

    A conversation's audit is laid before its rows and both are read in one order, so a task holds an audit and a
    batch of rows. Deleted rows are left out, turns put in have an empty text.
    """
    kind, arrow = conv_kind(rows)
    plain = rows.select("conv", F.lit(1).alias("_at"), F.lit(None).cast("string").alias("audit"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    heads = verdicts.select("conv", F.lit(0).alias("_at"), "audit", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"))
    ordered = plain.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "_at", *ORDER).select("conv", "_at", "audit", "role", "text")
    schema = ["conv", "place", "role", "text", "edit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, conv, audit, at, place, tops = Repair(grammar, names, prices), None, "", 0, 0, (0,)

        def turn(initial, role, text, edit):
            nonlocal place, tops
            out.append((conv, place, role, text, edit))
            place, tops = place + 1, repair.after(tops, initial)

        def given(text, edit):
            initial = repair.sole(tops)
            turn(initial, names[initial], text, edit)

        def put_in():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                given("", "I")
                at += 1

        for batch in batches:
            out: list[tuple] = []
            for key, row, edits, role, text in zip(*batch.to_pydict().values()):
                if row == 0:
                    put_in()
                    conv, audit, at, place, tops = key, edits, 0, 0, (0,)
                    continue
                put_in()
                edit, at = audit[at], at + 1
                if edit == "K":
                    turn(role[:1], role, text, edit)
                elif edit == "R":
                    given(text, edit)
            yield made(out)
        out = []
        put_in()
        yield made(out)

    def made(out):
        columns = list(zip(*out)) or [()] * 5
        kinds = [arrow, pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], schema)

    return ordered.mapInArrow(run, f"conv {kind}, place long, role string, text string, edit string")


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of ``role:text`` lines of each conversation of ``repaired``, read in its order, a row at a time."""
    kind, arrow = conv_kind(turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            out = []
            for key, place, role, text in zip(*batch.to_pydict().values()):
                if place == 0:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = key, hashlib.sha256()
                digest.update(f"{'' if place == 0 else chr(10)}{role}:{text}".encode())
            yield made(out)
        if digest is not None:
            yield made([(conv, digest.hexdigest())])

    def made(out):
        columns = list(zip(*out)) or [(), ()]
        return pa.record_batch([pa.array(columns[0], arrow), pa.array(columns[1], pa.string())], ["conv", "repaired_sha256"])

    return turns.select("conv", "place", "role", "text").mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations with faults by crc32 of ``conv_id:turn`` on division by 20: 0 drops the row, 1 empties its
    text, 2 takes out ends of sentences, 3 repeats it, 4 makes it the user's. Nulls count as one blank."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.select(
        F.col("conv_id").alias("conv"), "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        (F.crc32(F.encode(name, "UTF-8")) % 20).alias("fault"),
    )
    rows = rows.where("fault != 0").withColumns(
        {
            "role": F.when(F.col("fault") == 4, "user").otherwise(F.col("role")),
            "text": F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
            "copy": F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))),
        }
    )
    return rows.select("conv", "turn", "role", "text")


def repair_damaged(conversations: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Damage, repair and digest of every conversation, those that have no rows left included."""
    rows = damaged(conversations)
    verdicts = written(repair(rows, rows_per_block))
    hashes = digests(repaired(rows, verdicts))
    turns = rows.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    out = conversations.select(F.col("conv_id").alias("conv")).distinct()
    for part in (verdicts, hashes, turns):
        out = null_safe_left(out, part, ["conv"])
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        F.col("conv").alias("conv_id"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


@query()
def op12_conversation_repair(spark, sf_dir):
    return repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
