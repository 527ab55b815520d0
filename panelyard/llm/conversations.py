"""Conversation structure repair: cheapest edits that make roles alternate, by Four-Russians block tables (see ``repair.py``).

Rows are put in order by one range shuffle over (conversation, turn, role, text).  A conversation that lies inside one range is repaired
there, row by row as it streams past.  One that crosses a bound of ranges, or is large, leaves a piece in each range: its symbols, what its
rows were seen as, and its texts in chunks of bounded size.  For such pieces, three small steps follow: texts seen in an earlier piece become
duplicates; each piece gives its block steps for all cost vectors at once, and these compose to the vector at each piece's right bound; each
piece is traced from that vector for the four states it may be entered in.  A last pass streams the pieces of a conversation in order through a
hash, holding one piece's letters and one chunk of texts.  The digest of a whole conversation is a chain over its bytes, so one task has to see
them; it never holds them.  Equal rows are counted before the shuffle.

Defined cases: in ``conv_id:turn`` nulls read as one space, and so do a null role and a null text; null ids make one conversation; rows without turn
come first; rows of equal turn stand in the order of role and text, so repeated rows stand together; a conversation without rows after damage, or
with white space only, has an empty audit and the digest of no bytes; gaps beyond 64 bits are null; an empty table gives no rows; further columns are ignored.
A conversation's audit has a letter for each row, so it must fit a string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelyard.llm import repair
from panelyard.session import stored

WORD_SIGN = "[^\\x20\\x09-\\x0D]"
ENDED = "[.!?][\\x20\\x09-\\x0D]*\\z"
CLASS = {"s": 0, "u": 1, "a": 2}
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
CHUNK_BYTES = 1 << 22  # texts kept in memory before a conversation leaves pieces
BATCH_BYTES = 1 << 23
RESULT, PIECE, TEXTS = range(3)
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPORT = ", ".join(f"{c} BIGINT" for c in COUNTS) + ", audit STRING, repaired_sha256 STRING"


def damaged(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, blank, ended of every row; dropped ones have 0 copies, so that their conversation stays."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = table.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), F.pmod(F.crc32(key), F.lit(20)).alias("fate"))

    def fated(plain: Column, *cases: tuple[int, Column]) -> Column:
        out = F
        for fate, value in cases:
            out = out.when(F.col("fate") == fate, value)
        return out.otherwise(plain)

    rows = rows.select(
        "conv_id", fated(F.col("turn"), (0, F.lit(None).cast("bigint"))).alias("turn"), fated(F.col("role"), (0, F.lit("")), (4, F.lit("user"))).alias("role"),
        fated(F.col("text"), (0, F.lit("")), (1, F.lit("")), (2, F.translate("text", ".!?", ""))).alias("text"),
        fated(F.lit(1), (0, F.lit(0)), (3, F.lit(2))).cast("bigint").alias("copies"))
    return rows.withColumn("blank", ~F.col("text").rlike(WORD_SIGN)).withColumn("ended", F.col("text").rlike(ENDED))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one, with their copies added."""
    for batch in batches:
        if batch.num_rows:
            names = [n for n in batch.schema.names if n != "copies"]
            one = pa.Table.from_batches([batch]).group_by(names).aggregate([("copies", "sum")]).rename_columns({"copies_sum": "copies"})
            yield from one.select(batch.schema.names).combine_chunks().to_batches()


def symbols(initials: bytes, faults: bytes) -> bytes:
    return bytes(repair.GONE if f >= BLANK else i + 4 * (f == TRUNCATED) for i, f in zip(initials, faults))


def illegal(initials: bytes) -> int:
    """Neighbours other than su, ua and au."""
    if len(initials) < 2:
        return 0
    at = np.frombuffer(initials, np.uint8)
    pairs = at[:-1] * 4 + at[1:]
    return int(np.count_nonzero((pairs != 1) & (pairs != 6) & (pairs != 9)))


class Writer:
    """The repaired conversation as a running digest."""

    def __init__(self) -> None:
        self.digest, self.any, self.state = hashlib.sha256(), False, 0

    def say(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def insert(self) -> None:
        self.state = repair.GIVEN[self.state]
        self.say(repair.ROLE[self.state], "")

    def row(self, letter: str, initial: int, role: str, text: str) -> None:
        if letter == "K":
            self.state = repair.KEPT[self.state][initial]
            self.say(role, text)
        elif letter == "R":
            self.state = repair.GIVEN[self.state]
            self.say(repair.ROLE[self.state], text)

    def close(self) -> str:
        letters = repair.CLOSING[self.state]
        for _ in letters:
            self.insert()
        return letters


class Reader:
    """Reads letters beside the rows they belong to."""

    def __init__(self, letters: str, initials: bytes, writer: Writer) -> None:
        self.letters, self.initials, self.writer, self.at, self.row = letters, initials, writer, 0, 0

    def to(self, row: int) -> str:
        """The letter of ``row``, after all that stands before it."""
        while True:
            letter = self.letters[self.at]
            self.at += 1
            if letter == "I":
                self.writer.insert()
                continue
            self.row += 1
            if self.row > row:
                return letter

    def take(self, rows: list[int], roles: list[str], texts: list[str]) -> None:
        for row, role, text in zip(rows, roles, texts):
            self.writer.row(self.to(row), self.initials[row], role, text)

    def finish(self) -> None:
        for letter in self.letters[self.at:]:
            if letter == "I":
                self.writer.insert()


class Piece:
    """The rows of a conversation in one range, in order."""

    def __init__(self, conv, opened: bool) -> None:
        self.conv, self.opened, self.seq = conv, opened, 0
        self.initials, self.faults = bytearray(), bytearray()
        self.seen, self.keys = set(), []
        self.rows, self.roles, self.texts, self.size = [], [], [], 0
        self.turns, self.first, self.last = 0, None, None

    def add(self, turn, role: str, text: str, copies: int, blank: bool, ended: bool) -> None:
        if not copies:
            return
        at, initial = len(self.initials), CLASS.get(role[:1], 3)
        if turn is not None and (not self.turns or turn != self.last):
            self.first = turn if not self.turns else self.first
            self.turns, self.last = self.turns + 1, turn
        fault = BLANK
        if not blank:
            key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            fault = DUPLICATE if key in self.seen else FINE if ended else TRUNCATED
            if fault != DUPLICATE:
                self.seen.add(key)
                self.keys.append((at, key))
                self.rows.append(at)
                self.roles.append(role)
                self.texts.append(text)
                self.size += len(text)
        self.initials += bytes([initial]) * copies
        self.faults += bytes([fault]) + bytes([BLANK if blank else DUPLICATE]) * (copies - 1)

    def chunk(self, part: int) -> dict:
        out = {"kind": TEXTS, "conv_id": self.conv, "part": part, "seq": self.seq, "rows": self.rows, "roles": self.roles, "texts": self.texts}
        self.seq, self.size, self.opened = self.seq + 1, 0, True
        self.rows, self.roles, self.texts = [], [], []
        return out

    def piece(self, part: int) -> dict:
        return {"kind": PIECE, "conv_id": self.conv, "part": part, "seq": -1, "initials": bytes(self.initials), "faults": bytes(self.faults),
                "at": [a for a, _ in self.keys], "keys": [k for _, k in self.keys], "turns": self.turns, "first": self.first, "last": self.last}

    def result(self) -> dict:
        initials, faults = bytes(self.initials), bytes(self.faults)
        tables, own = repair.tables(), symbols(initials, faults)
        rights, cost = tables.bounds(own)
        letters, _ = tables.trace(own, rights)
        writer = Writer()
        reader = Reader(letters, initials, writer)
        reader.take(self.rows, self.roles, self.texts)
        reader.finish()
        closing = writer.close()
        return {"kind": RESULT, "conv_id": self.conv, "gaps": gap(self.first, self.last, self.turns), "blank": faults.count(BLANK),
                "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED), "illegal": illegal(initials),
                "cost": cost + tables.vectors[rights[0]][0], "audit": letters + closing, "repaired_sha256": writer.digest.hexdigest()}


def gap(first, last, turns: int) -> int | None:
    gaps = last - first + 1 - turns if turns else 0
    return gaps if gaps < 2**63 else None


def emitted(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 200 + len(row.get("initials") or b"") * 2 + 40 * len(row.get("keys") or ()) + sum(map(len, row.get("texts") or ()))
        if len(out) >= 2000 or size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def arrow(id_type: pa.DataType) -> pa.Schema:
    integers, strings = pa.list_(pa.int32()), pa.list_(pa.string())
    return pa.schema([
        ("kind", pa.int32()), ("conv_id", id_type), ("part", pa.int32()), ("seq", pa.int32()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()),
        ("repaired_sha256", pa.string()), ("initials", pa.binary()), ("faults", pa.binary()), ("at", integers), ("keys", pa.list_(pa.binary())),
        ("turns", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("rows", integers), ("roles", strings), ("texts", strings)])


def ranged_pass(ordered: DataFrame) -> DataFrame:
    """Results of the conversations inside one range; pieces and texts of the others."""
    spark_type = ordered.schema["conv_id"].dataType.simpleString()
    limit = CHUNK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            piece = None
            for batch in batches:
                for conv, turn, role, text, copies, blank, ended in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                    if piece is None or conv != piece.conv:
                        if piece is not None:
                            if piece.opened:
                                yield piece.piece(part)
                                yield piece.chunk(part)
                            else:
                                yield piece.result()
                        piece = Piece(conv, opened=piece is None)
                    piece.add(turn, role, text, copies, blank, ended)
                    if piece.size > limit:
                        yield piece.chunk(part)
            if piece is not None:  # the last one may go on in the next range
                yield piece.piece(part)
                yield piece.chunk(part)

        first = next(batches, None)
        if first is None:
            return

        def all_batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        yield from emitted(rows(all_batches()), arrow(first.schema.field("conv_id").type))

    fields = (f"kind INT, conv_id {spark_type}, part INT, seq INT, {REPORT}, initials BINARY, faults BINARY, at ARRAY<INT>, keys ARRAY<BINARY>, "
              "turns BIGINT, first BIGINT, last BIGINT, rows ARRAY<INT>, roles ARRAY<STRING>, texts ARRAY<STRING>")
    return ordered.mapInArrow(run, fields)


def with_late(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``late``: rows whose role and text an earlier piece of their conversation has shown."""
    shown = pieces.select("conv_id", "part", F.arrays_zip("at", "keys").alias("shown")).select("conv_id", "part", F.explode("shown").alias("s")).select(
        "conv_id", "part", F.col("s.at").alias("at"), F.col("s.keys").alias("key"))
    again = shown.groupBy("conv_id", "key").agg(F.min("part").alias("since"), F.max("part").alias("until")).where("since < until")
    again = again.select(F.col("conv_id").alias("of_conv"), F.col("key").alias("of_key"), "since")
    late = shown.join(again, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("key") == F.col("of_key"))).where("part > since")
    late = late.groupBy(F.col("conv_id").alias("of_conv"), F.col("part").alias("of_part")).agg(F.collect_list("at").alias("late"))
    return pieces.join(late, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("part") == F.col("of_part")), "left").drop("of_conv", "of_part")


def summaries(pieces: DataFrame) -> DataFrame:
    """Per piece: final faults, counts, its ends, and its step for every cost vector."""
    spark_type = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                faults = bytearray(row["faults"])
                for at in row["late"] or ():
                    faults[at] = DUPLICATE
                faults, initials = bytes(faults), row["initials"]
                to, cost = repair.tables().all_steps(symbols(initials, faults))
                out.append({"conv_id": row["conv_id"], "part": row["part"], "initials": initials, "faults": faults, "n": len(initials),
                            "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED), "illegal": illegal(initials),
                            "head": initials[0] if initials else -1, "tail": initials[-1] if initials else -1, "turns": row["turns"], "first": row["first"],
                            "last": row["last"], "to": to.tolist(), "step_cost": cost.tolist()})
            whole = pa.int64()
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("conv_id", batch.schema.field("conv_id").type), ("part", pa.int32()), ("initials", pa.binary()), ("faults", pa.binary()),
                *((c, whole) for c in ("n", "blank", "duplicate", "truncated", "illegal", "head", "tail", "turns", "first", "last")),
                ("to", pa.list_(whole)), ("step_cost", pa.list_(whole))]))

    counts = ", ".join(f"{c} BIGINT" for c in ("n", "blank", "duplicate", "truncated", "illegal", "head", "tail", "turns", "first", "last"))
    return pieces.select("conv_id", "part", "initials", "faults", "turns", "first", "last", "late").mapInArrow(
        run, f"conv_id {spark_type}, part INT, initials BINARY, faults BINARY, {counts}, to ARRAY<BIGINT>, step_cost ARRAY<BIGINT>")


def composed(steps: DataFrame) -> DataFrame:
    """Per piece the cost vector at its right bound; the counts of a conversation stand beside its first piece.

    A conversation has at most one piece in each range, so a group is no longer than the number of ranges.
    """
    spark_type = steps.schema["conv_id"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part", ignore_index=True)
        rights, vector, cost = [], 0, 0
        for to, step in zip(group["to"][::-1], group["step_cost"][::-1]):
            rights.append(vector)
            cost, vector = cost + int(step[vector]), int(to[vector])
        totals = {c: int(group[c].sum()) for c in ("blank", "duplicate", "truncated", "illegal")}
        tail, first, last, turns = -1, None, None, 0
        for r in group.itertuples():
            if r.n:
                totals["illegal"] += tail >= 0 and (tail, r.head) not in ((0, 1), (1, 2), (2, 1))
                tail = r.tail
            if r.turns:
                turns += r.turns - (last is not None and int(r.first) == last)
                first, last = int(r.first) if first is None else first, int(r.last)
        totals |= {"gaps": gap(first, last, turns), "cost": cost + repair.tables().vectors[vector][0]}
        out = pd.DataFrame({"conv_id": group["conv_id"], "part": group["part"], "right": rights[::-1]})
        for c in COUNTS:
            out[c] = pd.array([totals[c]] + [None] * (len(out) - 1), "Int64")
        return out

    light = steps.select("conv_id", "part", *(c for c in ("n", "blank", "duplicate", "truncated", "illegal", "head", "tail", "turns")),
                         F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), "to", "step_cost")
    return light.groupBy("conv_id").applyInPandas(run, f"conv_id {spark_type}, part INT, right INT, " + ", ".join(f"{c} BIGINT" for c in COUNTS))


def streamed(steps: DataFrame, rights: DataFrame, texts: DataFrame) -> DataFrame:
    """Results of the conversations in pieces: traced piece by piece, hashed chunk by chunk."""
    spark_type = steps.schema["conv_id"].dataType.simpleString()
    rights = rights.withColumnsRenamed({"conv_id": "of_conv", "part": "of_part"})
    known = [c for c in COUNTS if c in steps.columns]
    traced = steps.drop(*known).join(rights, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("part") == F.col("of_part")))
    traced = traced.select("conv_id", "part", F.lit(-1).alias("seq"), *COUNTS, "right", "initials", "faults")
    rows = traced.unionByName(texts.select("conv_id", "part", "seq", "rows", "roles", "texts"), allowMissingColumns=True)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            conv, totals, writer, reader, audit = None, None, None, None, []

            def done() -> dict:
                reader.finish()
                audit.append(writer.close())
                return totals | {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": writer.digest.hexdigest()}

            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in columns}
                    if row["seq"] >= 0:
                        reader.take(row["rows"], row["roles"], row["texts"])
                        continue
                    if writer is None or row["conv_id"] != conv:
                        if writer is not None:
                            yield done()
                        conv, writer, audit = row["conv_id"], Writer(), []
                        totals = {c: row[c] for c in COUNTS}
                    else:
                        reader.finish()
                    own = symbols(row["initials"], row["faults"])
                    bounds, _ = repair.tables().bounds(own, row["right"])
                    letters, _ = repair.tables().trace(own, bounds, writer.state)
                    audit.append(letters)
                    reader = Reader(letters, row["initials"], writer)
            if writer is not None:
                yield done()

        first = next(batches, None)
        if first is None:
            return

        def all_batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        schema = pa.schema([("conv_id", first.schema.field("conv_id").type), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        yield from emitted(results(all_batches()), schema)

    return rows.mapInArrow(run, f"conv_id {spark_type}, {REPORT}")


def repaired(table: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of ``table`` after damage."""
    rows = damaged(table)
    rows = rows.mapInArrow(counted, rows.schema)
    order = ["conv_id", "turn", "role"]
    ranged = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, F.substring("text", 1, 64), "text")
    first = stored(ranged_pass(ranged), "conversations")
    pieces = first.where(F.col("kind") == PIECE)
    steps = stored(summaries(with_late(pieces)), "pieces")
    open_ones = streamed(steps, composed(steps), first.where(F.col("kind") == TEXTS))
    report = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    return first.where(F.col("kind") == RESULT).select(*report).unionByName(open_ones.select(*report))
