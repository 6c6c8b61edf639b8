"""Structure repair of conversations by error-correcting Earley parsing.

A weighted grammar over the initials of roles, ``(s?(ua)+)?`` by default, says which
conversations are whole. A row is kept, given another role or deleted, and empty rows are
inserted, each at its cost; the cheapest edits win, ties go to the least audit, the string
of their initials. Items of the chart hold the least (cost, audit) that leads to them.

Rows are dealt by conversation and sorted on disk; a task reads them as a stream and holds
the chart of one conversation, which is one set of items, as all begin at the first row: audits
of two bytes a row and running digests of the repaired text, but no rows. Repeated rows are told by a window over the same partitioning,
so a conversation of any length needs no memory for those it has seen. A digest over a whole
conversation can't be taken in parts: each conversation is read by one task.

Defined cases: null ids make one conversation; null turns come first; a null role or text is
one space, so that such a text is blank; rows of equal turn are ordered by role, then text,
repeated rows are duplicates; an empty text is blank, a very long one is taken whole; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices_of, small_batches

WHITE, ENDS = r" \t\n\u000b\f\r", ".!?"


@dataclass(frozen=True)
class Grammar:
    """Productions, the first of the start symbol; a symbol without productions is the initial of a role.

    Symbols with productions stand first in a right side only (the grammar is left-linear), so
    that every item of the chart begins at the first row. Rows may be given, and inserted with,
    the roles in ``roles``.
    """

    productions: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("S", ()),
        ("S", ("B",)),
        ("B", ("P", "u", "a")),
        ("B", ("B", "u", "a")),
        ("P", ()),
        ("P", ("s",)),
    )
    roles: tuple[tuple[str, str], ...] = (("u", "user"), ("a", "assistant"))
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self):
        symbols = {symbol for symbol, _ in self.productions}
        if any(s in symbols for _, right in self.productions for s in right[1:]):
            raise ValueError("symbols with productions must stand first")
        if symbols & {s for s, _ in self.roles} or min(self.rerole, self.delete, self.insert) < 1:
            raise ValueError("roles have no productions, and edits cost 1 at least")


Item = tuple[int, int]  # a production and the place of the dot


class Value(NamedTuple):
    """The least cost and audit of an item, and the repaired text that goes with them.

    Audits are compared by ``rank`` and ``pending``: the edit of a row with the insertions before
    it is one word, and no such word begins another. So of two audits up to one row that differ,
    the order is that of their words up to the row before, then of the last word.
    """

    cost: int
    rank: int
    pending: str  # insertions after the last row
    added: str  # their roles' initials
    past: tuple | None  # words up to the last row: (what came before, edits, initials of repaired rows)
    digest: Any
    n: int

    def order(self) -> tuple[int, int, str]:
        return self.cost, self.rank, self.pending


class Chart:
    """Parses one conversation row by row: ``feed`` takes the rows in order, ``finish`` gives
    cost, audit, initials of the repaired rows and their digest for the cheapest repair."""

    def __init__(self, grammar: Grammar):
        self.grammar, self.roles, self.rows = grammar, dict(grammar.roles), 0
        self.productions: dict[str, list[int]] = {}
        self.waiting: dict[str, list[Item]] = {}
        for i, (symbol, right) in enumerate(grammar.productions):
            self.productions.setdefault(symbol, []).append(i)
            if right:
                self.waiting.setdefault(right[0], []).append((i, 1))
        self.start = grammar.productions[0][0]
        empty = Value(0, 0, "", "", None, hashlib.sha256(), 0)
        self.items = self._closed({(p, 0): empty for p in self.productions[self.start]})

    def _expected(self, item: Item) -> str | None:
        right = self.grammar.productions[item[0]][1]
        return right[item[1]] if item[1] < len(right) else None

    def _whole(self, item: Item) -> bool:
        return self._expected(item) is None and self.grammar.productions[item[0]][0] == self.start

    def _closed(self, items: dict[Item, Value]) -> dict[Item, Value]:
        """Predicts, completes and inserts until no item gets cheaper.

        Items carry the cost of the whole audit, so what completes a symbol goes on for all that
        wait for it. Predictions are made before the first row only, where they cost nothing.
        """
        agenda = list(items)

        def offer(item: Item, value: Value):
            old = items.get(item)
            if old is None or value.order() < old.order():
                items[item] = value
                agenda.append(item)

        while agenda:
            item = agenda.pop()
            value, symbol = items[item], self._expected(item)
            if symbol is None:
                for over in self.waiting.get(self.grammar.productions[item[0]][0], ()):
                    offer(over, value)
            elif symbol in self.productions:
                for p in self.productions[symbol]:
                    offer((p, 0), value)
            elif symbol in self.roles:
                offer((item[0], item[1] + 1), value._replace(cost=value.cost + self.grammar.insert, pending=value.pending + "I", added=value.added + symbol))
        return items

    def feed(self, role: str, text: str, must_delete: bool = False, truncated: bool = False) -> None:
        g, initial, late = self.grammar, role[:1], self.grammar.truncated if truncated else 0
        moved: dict[Item, tuple] = {}

        def offer(item: Item, cost: int, value: Value, edit: str, turn: tuple[str, str] | None):
            order = (value.cost + cost, value.rank, value.pending + edit)
            if item not in moved or order < moved[item][0]:
                moved[item] = (order, value, turn)

        for item, value in self.items.items():
            symbol = self._expected(item)
            if symbol in self.productions:
                continue  # what it predicts takes the row
            if symbol is not None and not must_delete:
                over = (item[0], item[1] + 1)
                if symbol == initial:
                    offer(over, late, value, "K", (initial, role))
                elif symbol in self.roles:
                    offer(over, g.rerole + late, value, "R", (symbol, self.roles[symbol]))
            if symbol is not None or self._whole(item):
                offer(item, g.delete, value, "D", None)
        ranks = {key: i for i, key in enumerate(sorted({order[1:] for order, *_ in moved.values()}))}
        texts: dict[int, tuple] = {}
        items = {}
        for item, (order, value, turn) in moved.items():
            rank = ranks[order[1:]]
            if rank not in texts:  # equal audits are equal repairs
                digest, n = self._written(value, turn and (turn[1], text))
                texts[rank] = (value.past, order[2], value.added + (turn[0] if turn else "")), digest, n
            items[item] = Value(order[0], rank, "", "", *texts[rank])
        self.rows += 1
        self.items = self._closed(items)
        if self.rows % 4096 == 0:
            self._shorten()

    def _written(self, value: Value, last: tuple[str, str] | None) -> tuple[Any, int]:
        turns = [(self.roles[s], "") for s in value.added] + ([last] if last else [])
        digest, n = value.digest.copy() if turns else value.digest, value.n
        for role, text in turns:
            digest.update((f"\n{role}:{text}" if n else f"{role}:{text}").encode())
            n += 1
        return digest, n

    @staticmethod
    def _joined(past: tuple | None) -> tuple[str, str]:
        edits, initials = [], []
        while past is not None:
            past, e, s = past
            edits.append(e)
            initials.append(s)
        return "".join(reversed(edits)), "".join(reversed(initials))

    def _shorten(self) -> None:
        """Chains of words become one word: two bytes a row."""
        short: dict[int, tuple] = {}
        for item, value in self.items.items():
            if id(value.past) not in short:
                short[id(value.past)] = value.past, (None, *self._joined(value.past))
            self.items[item] = value._replace(past=short[id(value.past)][1])

    def finish(self) -> tuple[int, str, str, str] | None:
        """None where the roles that may be inserted can't make any conversation whole."""
        whole = [v for item, v in self.items.items() if self._whole(item)]
        if not whole:
            return None
        best = min(whole, key=Value.order)
        edits, initials = self._joined(best.past)
        return best.cost, edits + best.pending, initials + best.added, self._written(best, None)[0].hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with planted faults, by the CRC-32 of ``conv_id:turn``: of twenty
    rows one is dropped (it stays, as ``gone``), one emptied, one left without marks at ends of
    sentences, one repeated and one given to the user. Nulls are one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_kind") == 0).alias("gone"), F.when(F.col("_kind") == 3, 2).otherwise(1).alias("_n"))
    return rows.select("conv_id", "turn", "role", "text", "gone", F.explode(F.sequence(F.lit(1), "_n")).alias("copy"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with their faults, dealt by conversation and sorted within; texts move once."""
    order = [F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    copy = F.col("copy") if "copy" in rows.columns else F.lit(1)
    spaced = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), gone.alias("gone"), copy.alias("copy"))
    rows = rows.repartition("conv_id").withColumn("_same", F.sha2(F.concat_ws("\0", "role", "text"), 256))
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "_same").orderBy(order[0], "copy")) > 1
    last = F.expr(f"right(trim(TRAILING '{WHITE}' FROM text), 1)")
    fault = F.when(last == "", "blank").when(seen, "duplicate").when(~last.isin(*ENDS), "truncated")
    return rows.select("conv_id", "turn", "role", "text", "gone", "copy", fault.alias("fault")).sortWithinPartitions("conv_id", *order)


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, initials string, repaired_sha256 string"


class _Conversation:
    def __init__(self, conv_id, grammar: Grammar, legal: frozenset[str]):
        self.conv_id, self.legal, self.chart = conv_id, legal, Chart(grammar)
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.least = self.most = self.initial = None
        self.turns = self.illegal = 0

    def take(self, turn, role, text, fault) -> None:
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in self.legal:
            self.illegal += 1
        self.initial = initial
        if fault:
            self.faults[fault] += 1
        self.chart.feed(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def row(self) -> dict:
        cost, audit, initials, digest = self.chart.finish() or (None,) * 4
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, **self.faults, "illegal": self.illegal, "cost": cost, "audit": audit, "initials": initials, "repaired_sha256": digest}


def audits(rows: DataFrame, grammar: Grammar | None = None, legal: tuple[str, ...] = ("su", "ua", "au")) -> DataFrame:
    """A row for each conversation: faults, cost and audit of the cheapest repair, and the digest of
    the repaired ``role:text`` rows. ``initials`` are those of the repaired rows' roles. Null cost, audit
    and digest where the grammar can't be met."""
    g, pairs = grammar or Grammar(), frozenset(legal)
    ordered = _ordered(rows)
    id_type = ordered.schema["conv_id"].dataType.simpleString()

    def stream(batches):
        now, out = None, []
        schema = None
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("initials", pa.string()), ("repaired_sha256", pa.string())])
            for part in slices_of(batch, 3, 4_000_000):
                for conv_id, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if now is None or conv_id != now.conv_id:
                        if now is not None:
                            out.append(now.row())
                        now = _Conversation(conv_id, g, pairs)
                    if not gone:
                        now.take(turn, role, text, fault)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([*out, now.row()], schema)

    return small_batches(ordered).select("conv_id", "turn", "role", "text", "gone", "fault").mapInArrow(stream, SUMMARY.replace("conv_id long", f"conv_id {id_type}"))


def repaired(rows: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text and the edit that made the row
    (K, R or I). The audit of a conversation is joined to its rows, which are streamed once more."""
    g = grammar or Grammar()
    found = audits(rows, g).select(F.col("conv_id").alias("_conv"), "audit", "initials")
    ordered = _ordered(rows).filter(~F.col("gone"))
    joined = ordered.join(found, F.col("conv_id").eqNullSafe(F.col("_conv"))).repartition("conv_id")
    joined = joined.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy")
    id_type = ordered.schema["conv_id"].dataType.simpleString()

    def stream(batches):
        conv, state, schema = object(), None, None
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
            out = []
            for part in slices_of(batch, 2, 4_000_000):
                for conv_id, role, text, audit, initials in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if state is None or conv_id != conv:
                        conv, state = conv_id, _Replay(audit, initials, g)
                    out += [{"conv_id": conv_id, "position": p, "role": r, "text": t, "edit": e} for p, r, t, e in state.row(role, text)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)
                out = []

    return joined.select("conv_id", "role", "text", "audit", "initials").mapInArrow(stream, f"conv_id {id_type}, position long, role string, text string, edit string")


class _Replay:
    """Applies an audit to the rows of a conversation, in order."""

    def __init__(self, audit: str | None, initials: str | None, grammar: Grammar):
        self.audit, self.initials, self.at, self.position, self.roles = audit or "", initials or "", 0, 0, dict(grammar.roles)
        self.last = len(self.audit.rstrip("I"))  # insertions after the last row come with it

    def row(self, role: str, text: str) -> list[tuple[int, str, str, str]]:
        out, taken = [], False
        while self.at < len(self.audit) and (not taken or self.at >= self.last):
            edit = self.audit[self.at]
            self.at, taken = self.at + 1, edit != "I"
            if edit != "D":
                out.append((self.position, role if edit == "K" else self.roles[self.initials[self.position]], "" if edit == "I" else text, edit))
                self.position += 1
        return out
