"""Structure repair against a plain search over all edits, and the cases of its docstring."""

import functools
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm import repair

SF = "/root/testdata/sf0.01"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def fault_of(rows, i):
    ink = re.findall(r"[^\x20\x09-\x0D]", rows[i][3])
    if not ink:
        return "blank"
    if rows[i][2:] in [r[2:] for r in rows[:i]]:
        return "duplicate"
    return None if ink[-1] in ".!?" else "truncated"


def search(rows):
    """(cost, edits, lines) of the least edits: tries every edit, with up to three insertions at a place."""
    faults = [fault_of(rows, i) for i in range(len(rows))]
    legal = lambda shape: re.fullmatch("s?(ua)*u?", shape) is not None

    @functools.cache
    def best(i, shape, inserted):
        shape = shape[-2:] if len(shape) > 2 else shape  # what may follow depends on the end only
        found = []
        if inserted < 3:
            for role in ("user", "assistant"):
                if legal(shape[-1:].replace("a", "") + role[0]) and not (shape == "" and role[0] == "a"):
                    c, e, t = best(i, shape + role[0], inserted + 1)
                    found.append((c + 5, "I" + e, (role + ":", *t)))
        if i == len(rows):
            if shape == "" or shape[-1] == "a":
                found.append((0, "", ()))
            return min(found, default=(10**9, "", ()))
        _, _, role, text = rows[i]
        c, e, t = best(i + 1, shape, 0)
        found.append((c + 2, "D" + e, t))
        if faults[i] in (None, "truncated"):
            for letter, cost, new in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                follows = {"": "su", "s": "u", "u": "a", "a": "u"}[shape[-1:]]
                if new[:1] and new[0] in follows:
                    c, e, t = best(i + 1, shape + new[0], 0)
                    found.append((c + cost + 5 * (faults[i] == "truncated"), letter + e, (f"{new}:{text}", *t)))
        return min(found)

    return best(0, "", 0), faults


def expected(original):
    out = {}
    kept = damage(original)
    for conv in {r[0] for r in original}:
        rows = sorted((r for r in kept if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        (cost, edits, lines), faults = search(rows)
        numbers = {r[1] for r in rows if r[1] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(frame):
    rows = frame.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(rows)
    assert result(repair.op13_repair(spark, SF)) == want
    assert {len(set(w[6])) for w in want.values()} >= {1, 2, 3}  # several kinds of edits together


SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                       T.StructField("gone", T.StringType()), T.StructField("Fault", T.StringType())])
ODD = [
    (None, None, None, None), (None, 1, "user", "Hi."), (1, None, "assistant", "A."), (1, None, "assistant", "A."), (1, 5, "user", None), (1, 9, "tool", "x"),
    (2, 0, "", ""), (2, 0, "system", "S."), (2, 2, "system", "S."), (3, 1, "user", "no end"), (3, 1, "assistant", "Also, no end"), (3, 1, "user", "An end!"),
    (4, 0, "system", "Only this."), (5, 0, "assistant", "😀?"), (5, 1, "assistant", "b. \n\t"), (5, 2, "assistant", "c."), (5, 2, "user", "c."), (6, 3, "umpire", "u."), (-7, 2, "user", "q?"),
]


@pytest.mark.parametrize("cut", [0, 1, 2, 3])
def test_odd_rows(spark, cut):
    rows = [r for i, r in enumerate(ODD) if cut == 0 or i % 4 != cut]
    frame = spark.createDataFrame([(*r, "g", "f") for r in rows], SCHEMA).repartition(3)
    assert result(repair.repaired(repair.damaged(frame))) == expected(rows)


def test_empty_table(spark):
    assert repair.repaired(repair.damaged(spark.createDataFrame([], SCHEMA))).collect() == []


def test_giant_conversation_spills_and_leaves_no_file(spark, tmp_path):
    """A conversation whose edits lie in a file gives what one in memory gives; the file is gone afterwards."""
    roles = ["user", "user", "assistant", "tool", "system", "assistant"]
    rows = [(c, i, roles[(i * i + c) % 6], f"text {i}{'.' if i % 5 else ''}", False) for c in (1, 2) for i in range(700)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone boolean")
    held = result(repair.repaired(frame))
    assert result(repair.repaired(frame, held=16)) == held
    left = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(repair.shared_folder(spark)).where(F.col("path").contains("/repair/steps-"))
    assert left.count() == 0


def test_every_row_lost(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a.", True), (1, 1, "user", "b.", True), (2, 0, "user", "c.", False)], "conv_id long, turn long, role string, text string, gone boolean")
    assert result(repair.repaired(frame))[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
