"""Repair of conversation structure by iterative-deepening A*.

Rows of a conversation are kept, given another role, deleted or preceded by inserted ones until their roles read
``(s?(ua)+)?``, at the least cost. The search goes depth first through the edits in ASCII order of their initials under a
growing cost bound; a table of failed states holds, for each place and role state, a lower bound of what is left to pay. The
first accepting path under the first bound that admits one is the answer: the cheapest, and of those the ASCII-least.

Conversations of up to ``WHOLE`` rows are searched whole, streamed from rows sorted by conversation. Longer ones are never
gathered: their rows are dealt by range to blocks of bounded size, each block is searched from every role state to every
other, a conversation's blocks are chained by these costs, and each block is searched once more towards what the chain says
is left to pay behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medtab.llm.common import cut, give_back

#: Rows up to which a conversation is searched whole, rows of a block of a longer one, and of a stretch that estimates add up.
WHOLE, BLOCK, STRETCH = 2048, 512, 16
#: Costs of the edits, and what a truncated row costs that is not deleted.
DELETE, INSERT, KEEP, REROLE, CUT_OFF = 2, 5, 0, 1, 5
#: What counts as blank, and what ends a whole text.
INK, ENDS = r"[^\x20\x09-\x0D]", ".!?"
_BLANKS = " \t\n\x0b\x0c\r"
#: Role states (start, after system, user, assistant), the role each expects next, and the state that role leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
EXPECTED, NEXT = ("user", "user", "assistant", "user"), (USER, USER, ASSISTANT, USER)
#: What ends in each state still have to insert.
OPEN_ENDS = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 40
#: Faults of a row: none, one that requires deletion, cut off.
SOUND, DOOMED, TRUNCATED = range(3)


def search(faults: list[int], initials: list[str], entry: int, tail: tuple[int, ...] | None = None) -> tuple[int, str, int] | None:
    """``(cost, audit, state at the end)`` of the cheapest edits of rows from state ``entry``, ASCII-least among equals.

    Without ``tail`` the rows end the conversation, in START or ASSISTANT, where needed after insertions. With it, nothing is
    inserted after the last row, and ``tail[state]`` is what is left to pay behind it (``NEVER``: no way on). None where no
    edits lead anywhere.
    """
    return _deepen(faults, initials, entry, tail, estimates(faults, initials, tail))


def estimates(faults: list[int], initials: list[str], tail: tuple[int, ...] | None = None) -> list[list[int]]:
    """For each row and state at most what is left to pay: stretches of ``STRETCH`` rows are searched by themselves, each entered
    and left in whatever states are cheapest, and their costs add up."""
    n = len(faults)
    ends = list(OPEN_ENDS if tail is None else tail)
    if n <= STRETCH:
        out = [[0] * 4 for _ in faults] + [ends]
        for i in range(n - 1, -1, -1):
            out[i] = [min(out[i + 1]) + (DELETE if faults[i] != SOUND else 0)] * 4
    else:
        out, behind = [ends], min(ends)
        for at in range((n - 1) // STRETCH * STRETCH, -1, -STRETCH):
            f, r = faults[at : at + STRETCH], initials[at : at + STRETCH]
            free = (0, 0, 0, 0)
            table = estimates(f, r, free)
            costs = [_deepen(f, r, entry, free, table)[0] for entry in range(4)]
            out = [[x + behind for x in row] for row in table[:-1]] + out
            behind += min(costs)
    # states from which no edits lead on have failed from the start
    alive = [x < NEVER for x in ends]
    for i in range(n - 1, -1, -1):
        ahead = [alive[s] or faults[i] != DOOMED and (alive[NEXT[s]] or s == START and initials[i] == "s" and alive[SYSTEM]) for s in range(4)]
        for _ in range(3):
            ahead = [ahead[s] or ahead[NEXT[s]] for s in range(4)]
        out[i] = [x if ok else NEVER for x, ok in zip(out[i], ahead, strict=True)]
        alive = ahead
    return out


def _deepen(faults: list[int], initials: list[str], entry: int, tail: tuple[int, ...] | None, failed: list[list[int]]) -> tuple[int, str, int] | None:
    """The search itself; ``failed[row][state]`` is raised to the least cost of any way on that a bound has shut out."""
    n = len(faults)

    def edits(i: int, state: int) -> list[tuple[str, int, int, int]]:
        out = []
        if i < n:
            out.append(("D", DELETE, i + 1, state))
        if i < n or tail is None:
            out.append(("I", INSERT, i, NEXT[state]))
        if i < n and faults[i] != DOOMED:
            more = CUT_OFF if faults[i] == TRUNCATED else 0
            if initials[i] == EXPECTED[state][0]:
                out.append(("K", KEEP + more, i + 1, NEXT[state]))
            elif initials[i] == "s" and state == START:
                out.append(("K", KEEP + more, i + 1, SYSTEM))
            out.append(("R", REROLE + more, i + 1, NEXT[state]))
        return out

    while (limit := failed[0][entry]) < NEVER:
        # a frame: row, state, what may still be spent, edits, the next of them, least cost of a way that was shut out
        stack = [[0, entry, limit, edits(0, entry), 0, NEVER]]
        while stack:
            i, state, left, ways, k, low = frame = stack[-1]
            if k == 0 and i == n and (state in (START, ASSISTANT) if tail is None else tail[state] <= left):
                return limit, "".join(f[3][f[4] - 1][0] for f in stack[:-1]), state
            if k == len(ways):
                failed[i][state] = max(failed[i][state], low)
                stack.pop()
                if stack:
                    above = stack[-1]
                    above[5] = min(above[5], above[3][above[4] - 1][1] + failed[i][state])
                continue
            frame[4] = k + 1
            _, cost, j, to = ways[k]
            if cost + failed[j][to] > left:
                frame[5] = min(low, cost + failed[j][to])
            else:
                stack.append([j, to, left - cost, edits(j, to), 0, NEVER])
    return None


def is_cut_off(text: str) -> bool:
    """Whether the last character that isn't blank ends no sentence."""
    end = text.rstrip(_BLANKS)
    return bool(end) and end[-1] not in ENDS


def repaired(roles: list[str], texts: list[str], audit: str, entry: int = START) -> list[str]:
    """The lines ``role:text`` that the edits of ``audit`` leave."""
    out, i, state = [], 0, entry
    for e in audit:
        if e == "D":
            i += 1
            continue
        if e == "I":
            out.append(f"{EXPECTED[state]}:")
            state = NEXT[state]
            continue
        if e == "K":
            out.append(f"{roles[i]}:{texts[i]}")
            state = SYSTEM if state == START and roles[i][:1] == "s" else NEXT[state]
        else:
            out.append(f"{EXPECTED[state]}:{texts[i]}")
            state = NEXT[state]
        i += 1
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, dropped)``: the rows after damage, the dropped ones too; nulls of role and text as one space."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).cast("int").alias("__d"))
    how = F.col("__d")
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(how == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(how == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (how == 0).alias("dropped"), times.alias("__copy")).drop("__copy")


_STATS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
_RESULT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def whole(conv_id: object, turns: list, roles: list[str], texts: list[str]) -> tuple:
    """The result row of one conversation whose rows after damage are given in order."""
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    seen: set[tuple[str, str]] = set()
    faults, counts = [], [0, 0, 0]
    for role, text in zip(roles, texts, strict=True):
        fault = SOUND
        if not text.strip(_BLANKS):
            fault, counts[0] = DOOMED, counts[0] + 1
        elif (role, text) in seen:
            fault, counts[1] = DOOMED, counts[1] + 1
        elif is_cut_off(text):
            fault, counts[2] = TRUNCATED, counts[2] + 1
        seen.add((role, text))
        faults.append(fault)
    initials = [r[:1] for r in roles]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit, _ = search(faults, initials, START)
    digest = hashlib.sha256("\n".join(repaired(roles, texts, audit)).encode("utf-8", "surrogatepass")).hexdigest()
    return (conv_id, gaps, *counts, illegal, cost, audit, digest)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation and turn to one row a conversation; one conversation is held at a time."""
    held, key, out, kind = [], None, [], pa.int64()
    names = ["conv_id", *_STATS, "cost", "audit", "repaired_sha256"]

    def close() -> None:
        rows = [r for r in held if not r[4]]
        out.append(whole(held[0][0], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]))

    def batch() -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    for b in batches:
        kind = b.schema.field("conv_id").type
        c = b.to_pydict()
        for own, *row in zip(c["__key"], c["conv_id"], c["turn"], c["role"], c["text"], c["dropped"], strict=True):
            if own != key and held:
                close()
                held = []
            key = own
            held.append(row)
        if len(out) >= 512:
            yield batch()
            out = []
    if held:
        close()
    if out:
        yield batch()
    give_back()


def _key() -> Column:
    """The conversation as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(" "))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def repair(conversations: DataFrame, most: int = WHOLE, block: int = BLOCK) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of every conversation after damage.

    Rows stand by turn, those without a turn first, and rows that share one by role and text. A null role or text is one
    space, so such a row has an illegal role or is blank. Rows without a conv_id are one conversation. A conversation of
    which damage leaves nothing has zeros, an empty audit and the hash of the empty string; an empty table gives an empty
    result. Rows that repeat are duplicates of the first. Very long texts are hashed whole. Further columns are ignored.

    Conversations of more than ``most`` rows go in blocks of ``block``. For those a single task sees one row a block (to chain
    them) and streams the repaired lines block by block (one hash over all of them cannot be shared out).
    """
    rows = damaged(conversations).withColumn("__key", _key())
    kind = dict(conversations.dtypes)["conv_id"]
    longs = cut(rows.groupBy("__key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("__key"), "long_conversations")
    if longs.isEmpty():
        return _short(rows, kind)
    return _short(rows.join(longs, "__key", "left_anti"), kind).unionByName(_long(rows.join(longs, "__key", "left_semi"), kind, block))


def _short(rows: DataFrame, kind: str) -> DataFrame:
    dealt = rows.repartition("__key").sortWithinPartitions("__key", *_order())
    return dealt.select("__key", "conv_id", "turn", "role", "text", "dropped").mapInArrow(_stream, _RESULT.format(kind))


def _costs(part: pd.DataFrame) -> pd.DataFrame:
    """Cost of a block from every state (in fours) to every state."""
    part = part.sort_values("at")
    faults, initials = part.fault.tolist(), part.initial.tolist()
    found = [search(faults, initials, entry, tuple(0 if s == to else NEVER for s in range(4))) for entry in range(4) for to in range(4)]
    return pd.DataFrame({"__key": part["__key"].iloc[:1], "block": part.block.iloc[:1], "costs": [[f[0] if f else NEVER for f in found]]})


def _left_to_pay(part: pd.DataFrame) -> pd.DataFrame:
    """For each block of a conversation, what is left to pay behind it in each state."""
    part = part.sort_values("block", ascending=False)
    behind, out = list(OPEN_ENDS), []
    for costs in part.costs:
        out.append(behind)
        behind = [int(min(min(costs[4 * e + t] + behind[t] for t in range(4)), NEVER)) for e in range(4)]
    return pd.DataFrame({"__key": part["__key"], "block": part.block, "behind": out})


def _answers(behind: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
    """A block's answers by the state it is entered in: the state it is left in, what it and all behind it cost, its audit."""
    part = part.sort_values("at")
    tail = tuple(int(x) for x in behind.behind.iloc[0])
    found = [search(part.fault.tolist(), part.initial.tolist(), entry, tail) or (NEVER, "", START) for entry in range(4)]
    return pd.DataFrame({"__key": part["__key"].iloc[:1].tolist(), "block": part.block.iloc[:1].tolist(), "costs": [[f[0] for f in found]], "leaves": [[f[2] for f in found]], "audits": [[f[1] for f in found]]})


def _entered(part: pd.DataFrame) -> pd.DataFrame:
    """The states in which the blocks of a conversation are entered and left, and the cost of all of them."""
    part = part.sort_values("block")
    state, entries, leaves = START, [], []
    for to in part.leaves:
        entries.append(state)
        state = int(to[state])
        leaves.append(state)
    return pd.DataFrame({"__key": part["__key"], "block": part.block, "entry": entries, "leave": leaves, "total": [int(part.costs.iloc[0][START])] * len(part)})


def _lines(taken: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
    """A block's repaired lines and its audit, in which each further copy of a row is deleted right behind it."""
    part, row = part.sort_values("at"), taken.iloc[0]
    lines = repaired(part.role.tolist(), part.text.tolist(), row.audit, int(row.entry))
    copies, i, audit = part.copies.tolist(), 0, []
    for e in row.audit:
        audit.append(e)
        if e != "I":
            audit.append("D" * (copies[i] - 1))
            i += 1
    return pd.DataFrame([(row["__key"], row.block, row.leave, row.total, "".join(audit), "\n".join(lines) if lines else None)], columns=["__key", "block", "leave", "total", "audit", "lines"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order to one row a conversation; the hash takes one block's lines at a time."""
    key, state, total, audit, digest, out = None, START, 0, [], None, []

    def add(lines: str) -> None:
        digest.update(lines.encode("utf-8", "surrogatepass") if digest.fresh else ("\n" + lines).encode("utf-8", "surrogatepass"))

    def close() -> None:
        nonlocal state
        while state in (SYSTEM, USER):
            add(f"{EXPECTED[state]}:")
            audit.append("I")
            state = NEXT[state]
        out.append((key, total, "".join(audit), digest.hexdigest()))

    for b in batches:
        c = b.to_pydict()
        for own, leave, cost, edits, lines in zip(c["__key"], c["leave"], c["total"], c["audit"], c["lines"], strict=True):
            if own != key:
                if key is not None:
                    close()
                key, total, audit, digest = own, cost, [], _Digest()
            audit.append(edits)
            if lines is not None:
                add(lines)
            state = leave
    if key is not None:
        close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], ["__key", "cost", "audit", "repaired_sha256"])


class _Digest:
    """A SHA-256 that knows whether it has taken anything yet."""

    def __init__(self) -> None:
        self.sha, self.fresh = hashlib.sha256(), True

    def update(self, data: bytes) -> None:
        self.sha.update(data)
        self.fresh = False

    def hexdigest(self) -> str:
        return self.sha.hexdigest()


def _long(rows: DataFrame, kind: str, block: int) -> DataFrame:
    """The same for long conversations, in blocks; equal rows of a turn travel as one with their number."""
    ids = rows.groupBy("__key").agg(F.first("conv_id", ignorenulls=True).alias("conv_id"))
    live = rows.where(~F.col("dropped")).groupBy("__key", "turn", "role", "text").agg(F.count("*").alias("copies"))
    # the first of equal texts by turn, found by a digest of role and text
    live = cut(live.withColumn("said", F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))), "live")
    first = live.groupBy("__key", "said").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    end = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$", 1)
    fault = F.when(~F.col("text").rlike(INK), "blank").when(~F.col("first.turn").eqNullSafe(F.col("turn")), "duplicate").when(~end.isin(*ENDS), "truncated").otherwise("")
    marked = live.join(first, ["__key", "said"]).select("__key", "turn", "role", "text", "copies", fault.alias("what"))
    # by range, so that the rows of one conversation go to many tasks; numbered as they are written
    placed = cut(marked.repartitionByRange(F.col("__key"), *_order()).sortWithinPartitions("__key", *_order()).withColumn("at", F.monotonically_increasing_id()), "placed")
    what = F.col("what")
    placed = placed.withColumns({"block": F.floor(F.col("at") / block), "initial": F.substring("role", 1, 1), "fault": F.when(what.isin("blank", "duplicate"), DOOMED).when(what == "truncated", TRUNCATED).otherwise(SOUND)})
    thin = placed.select("__key", "block", "at", "initial", "fault")
    costs = cut(thin.groupBy("__key", "block").applyInPandas(_costs, "__key string, block long, costs array<long>"), "costs")
    behind = costs.groupBy("__key").applyInPandas(_left_to_pay, "__key string, block long, behind array<long>")
    answers = cut(behind.groupBy("__key", "block").cogroup(thin.groupBy("__key", "block")).applyInPandas(_answers, "__key string, block long, costs array<long>, leaves array<int>, audits array<string>"), "answers")
    entered = answers.select("__key", "block", "costs", "leaves").groupBy("__key").applyInPandas(_entered, "__key string, block long, entry int, leave int, total long")
    taken = answers.select("__key", "block", "audits").join(entered, ["__key", "block"]).select("__key", "block", "entry", "leave", "total", F.col("audits")[F.col("entry")].alias("audit"))
    lines = taken.groupBy("__key", "block").cogroup(placed.select("__key", "block", "at", "role", "text", "copies").groupBy("__key", "block")).applyInPandas(_lines, "__key string, block long, leave int, total long, audit string, lines string")
    joined = lines.repartition("__key").sortWithinPartitions("__key", "block").select("__key", "leave", "total", "audit", "lines").mapInArrow(_joined, "__key string, cost long, audit string, repaired_sha256 string")
    # neighbours are looked up within a block; where blocks meet, the foot of one and the head of the next are
    n, before = F.col("copies"), F.lag("initial").over(Window.partitionBy("__key", "block").orderBy("at"))
    clash = lambda a, b: F.coalesce(~F.concat(a, b).isin("su", "ua", "au"), F.lit(False)).cast("long")
    counts = placed.withColumn("before", before).groupBy("__key", "block").agg(
        F.sum(F.when(what == "blank", n).otherwise(0)).alias("blank"), F.sum(F.when(what == "blank", 0).when(what == "duplicate", n).otherwise(n - 1)).alias("duplicate"), F.sum(F.when(what == "truncated", 1).otherwise(0)).alias("truncated"),
        F.sum(n - 1 + clash(F.col("before"), F.col("initial"))).alias("illegal"), F.sum((n - 1) * DELETE).alias("extra"), F.min_by("initial", "at").alias("head"), F.max_by("initial", "at").alias("foot"))
    seam = F.lag("foot").over(Window.partitionBy("__key").orderBy("block"))
    counts = counts.withColumn("illegal", F.col("illegal") + clash(seam, F.col("head"))).groupBy("__key").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "extra")))
    turns = placed.groupBy("__key", "turn").agg(F.lit(1)).groupBy("__key").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
    out = ids.join(counts, "__key", "left").join(turns, "__key", "left").join(joined, "__key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(F.col("conv_id").cast(kind).alias("conv_id"), *(zero(c).alias(c) for c in _STATS), (zero("cost") + zero("extra")).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
