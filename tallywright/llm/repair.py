"""Conversation structure repair: the cheapest edits that make the roles of a conversation `(s?(ua)+)?`.

Rows are dealt by conversation, sorted by turn inside each task and streamed through `mapInArrow`; the state of the dynamic program
travels from batch to batch. A row goes through twice. First the rows of a conversation pass from last to first, without their texts:
for each place in the pattern the program keeps what the rest costs at least, and one byte a row says which edit is best from each of
the four places. Then they pass from first to last with their texts: the bytes are read backwards, so the least edits come out in order
and the repaired rows go straight into the digest. Choosing from the end makes ties exact: from each place the alphabetically first
letter that still reaches the least cost is taken, which gives the least string of letters.

The bytes of a conversation of more than `HELD` rows go to a file in the shared folder, piece by piece, and are read back from its
end; the file is removed with the conversation. So a task holds no conversation, only a piece of bytes and the edits it returns.

Letters: D (delete, 2; the only choice for blank and duplicate rows), I (insert an empty user or assistant turn, 5), K (keep, 0), R (make
the row user or assistant, 1). A truncated row that stays costs 5 more.

Defined cases: null roles and texts are one space, as are null numbers where a row is named by them; rows with equal numbers stand in
the order of role, then text, null numbers first; rows without conv_id are one conversation, whose identifier is null; a conversation
that has no rows left is returned with nothing in it; repeated rows are rows, all but the first of them duplicates; an empty table gives
an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.common import by_arrow, shared_folder

DELETE, INSERT, KEEP, REROLE = range(4)  # in the order of their letters
LETTERS = "DIKR"
COST = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
CUT_OFF = 5
NEVER = 1 << 40
#: Places in the pattern: before everything, after s, after u, after a. A conversation may end in the first and in the last.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
WANTED = {START: ("user", AFTER_U), AFTER_S: ("user", AFTER_U), AFTER_U: ("assistant", AFTER_A), AFTER_A: ("user", AFTER_U)}
KEPT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
FINE, BLANK, DUPLICATE, TRUNCATED, GONE = range(5)
HELD = 1 << 20
RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def with_inserts(plain: list[int]) -> tuple[int, ...]:
    """Least costs from each place when turns may be inserted first. After going round once the cost has only grown."""
    u = min(plain[AFTER_U], COST[INSERT] + plain[AFTER_A])
    return min(plain[START], COST[INSERT] + u), min(plain[AFTER_S], COST[INSERT] + u), u, min(plain[AFTER_A], COST[INSERT] + plain[AFTER_U])


#: After the last row: nothing more is needed at START and AFTER_A, one insertion at AFTER_U, two at AFTER_S.
END = with_inserts([0, NEVER, NEVER, 0])
LAST = sum((INSERT if q in (AFTER_S, AFTER_U) else KEEP) << 2 * q for q in WANTED)


def step(role: str, fault: int, rest: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs before a row from those after it, and the best edit from each place, two bits a place."""
    options = []
    for q, (_, after) in WANTED.items():
        stay = NEVER if fault in (BLANK, DUPLICATE) else CUT_OFF * (fault == TRUNCATED)
        same = KEPT.get((q, role))
        options.append({DELETE: COST[DELETE] + rest[q], KEEP: NEVER if same is None else COST[KEEP] + stay + rest[same], REROLE: COST[REROLE] + stay + rest[after]})
    costs = with_inserts([min(o.values()) for o in options])
    best = 0
    for q, (_, after) in WANTED.items():
        options[q][INSERT] = COST[INSERT] + costs[after]
        best |= next(e for e in (DELETE, INSERT, KEEP, REROLE) if options[q][e] == costs[q]) << 2 * q
    return costs, best


class Steps:
    """`step`, remembered: only differences of costs matter, and these are few."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple[tuple[int, ...], int, int]] = {}

    def __call__(self, role: str, fault: int, rest: tuple[int, ...]) -> tuple[tuple[int, ...], int, int]:
        """Costs before the row less their minimum, the edits, and that minimum."""
        key = (role, fault, rest)
        if key not in self.known:
            costs, best = step(role, fault, rest)
            low = min(costs)
            self.known[key] = tuple(c - low for c in costs), best, low
        return self.known[key]


class Backward:
    """Bytes written in one direction and read in the other; what does not fit into `held` bytes lies in a file."""

    def __init__(self, folder: str, held: int) -> None:
        self.folder, self.held, self.bytes, self.file, self.parts = folder, held, bytearray(), None, 0

    def write(self, byte: int) -> None:
        self.bytes.append(byte)
        if len(self.bytes) == self.held:
            if self.file is None:
                self.system, at = fs.FileSystem.from_uri(self.folder)
                self.system.create_dir(at, recursive=True)
                self.file = f"{at}/steps-{uuid.uuid4().hex}"
                self.out = self.system.open_output_stream(self.file, compression=None)
            self.out.write(bytes(self.bytes))
            self.parts += 1
            self.bytes.clear()

    def turn(self) -> None:
        if self.file is not None:
            self.out.close()
            self.back = self.system.open_input_file(self.file)

    def read(self) -> int:
        if not self.bytes and self.parts:
            self.parts -= 1
            self.back.seek(self.parts * self.held)
            self.bytes += self.back.read(self.held)
        return self.bytes.pop()

    def close(self) -> None:
        if self.file is not None:
            self.back.close()
            self.system.delete_file(self.file)


class Conversation:
    """What is known of the conversation that is passing by."""

    def __init__(self, conv_id: int | None, steps: Steps, folder: str, held: int) -> None:
        self.conv_id, self.steps, self.edits = conv_id, steps, Backward(folder, held)
        self.costs, self.cost = END, 0
        self.place: int | None = None  # None as long as rows pass from last to first
        self.counts = [0] * 5
        self.turns, self.first, self.last, self.illegal, self.before = 0, None, None, 0, None
        self.audit, self.digest, self.lines = bytearray(), hashlib.sha256(), 0

    def back(self, role: str, fault: int) -> None:
        self.costs, best, low = self.steps(role, fault, self.costs)
        self.cost += low
        self.edits.write(best)

    def turn_round(self) -> None:
        self.cost += self.costs[START]
        self.edits.turn()
        self.place = START

    def line(self, text: str) -> None:
        self.digest.update(("\n" if self.lines else "").encode() + text.encode("utf-8", "surrogatepass"))
        self.lines += 1

    def apply(self, best: int, role: str | None, text: str | None) -> None:
        """The edits at one row (none: at the end): insertions first, then that of the row itself."""
        while True:
            edit = best >> 2 * self.place & 3
            if role is None and edit != INSERT:
                return
            self.audit += LETTERS[edit].encode()
            wanted, after = WANTED[self.place]
            if edit == INSERT:
                self.line(wanted + ":")
                self.place = after
                continue
            if edit == KEEP:
                self.line(f"{role}:{text}")
                self.place = KEPT[self.place, role[:1]]
            elif edit == REROLE:
                self.line(f"{wanted}:{text}")
                self.place = after
            return

    def forth(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.counts[fault] += 1
        if turn is not None and turn != self.last:
            self.turns, self.first, self.last = self.turns + 1, turn if self.first is None else self.first, turn
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        self.apply(self.edits.read(), role, text)

    def result(self) -> tuple:
        if self.place is None:
            self.turn_round()
        self.apply(LAST, None, None)
        self.edits.close()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest())


def with_faults(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) dealt by conversation, with role and text filled, `fault` and `at`, their place from 1.

    The windows run inside the conversation's own partition: rows are dealt once.
    """
    filled = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "gone")
    dealt = filled.repartition("conv_id")
    same = Window.partitionBy("conv_id", "gone", "role", F.sha2("text", 256)).orderBy("turn")
    in_order = Window.partitionBy("conv_id").orderBy("gone", F.col("turn").asc_nulls_first(), "role", "text")
    inked = F.rtrim(F.translate("text", "\t\n\u000b\f\r", "     "))
    fault = (F.when(F.col("gone"), GONE).when(inked == "", BLANK).when(F.col("nth") > 1, DUPLICATE)
             .when(~F.substring(inked, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE))
    return dealt.withColumn("nth", F.row_number().over(same)).withColumn("fault", fault).withColumn("at", F.row_number().over(in_order)).drop("nth")


def repaired(turns: DataFrame, held: int = HELD) -> DataFrame:
    """One row a conversation: its faults, the least cost, the edits and the digest of the repaired rows.

    `turns` has conv_id, turn, role, text and gone; a row with `gone` is no part of its conversation, but lets it be returned.
    """
    spark = turns.sparkSession
    folder = f"{shared_folder(spark)}/repair"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, now, done = Steps(), None, []

        def out() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], [f.split(" ")[0] for f in RESULT.split(", ")])
            done.clear()
            return batch

        for b in batches:
            for conv_id, forward, turn, role, text, fault in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = Conversation(conv_id, steps, folder, held)
                if fault == GONE:
                    continue
                if not forward:
                    now.back(role, fault)
                    continue
                if now.place is None:
                    now.turn_round()
                now.forth(turn, role, text, fault)
            if done:
                yield out()
        if now is not None:
            done.append(now.result())
            yield out()

    twice = with_faults(turns).withColumn("forward", F.explode(F.array(F.lit(False), F.lit(True))))
    slim = lambda c, other: F.when(F.col("forward"), F.col(c)).otherwise(other)
    rows = twice.select("conv_id", "forward", F.col("turn").cast("long").alias("turn"), slim("role", F.substring("role", 1, 1)).alias("role"), slim("text", F.lit(None)).alias("text"), "fault",
                        F.when(F.col("forward"), F.col("at")).otherwise(-F.col("at")).alias("place"))
    sorted_rows = rows.sortWithinPartitions("conv_id", "forward", "place").select("conv_id", "forward", "turn", "role", "text", "fault")
    return by_arrow(sorted_rows, run, RESULT)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults: by a checksum of `conv_id:turn`, rows are lost, emptied, cut, doubled or given to the user."""
    name: Column = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    filled = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return filled.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
