"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, by secondary-sorted streaming.

Rows are repartitioned by conversation and sorted by turn; a streaming function carries the state of a dynamic program
across Arrow batches. The program runs over the automaton of `(s?(ua)+)?`, which has four states, so for each of them it
keeps the cheapest edits so far, how the edit strings of two states compare, and the running digest of the repaired text.
Costs are kept relative to the cheapest state, and states too dear ever to win are left out, so there are finitely many
situations: a step is looked up in a table that a worker fills as it meets them.

Backpointers are one number a row. A conversation of more than BLOCK rows hands on a block at a time: for each state at
the block's end, the state at its start and the edits between. Blocks are rows of the table written to the shared
folder; the states at their borders are then chained (four small numbers a block) and the chosen edits joined. So a
worker's memory holds one batch and one block, whatever a conversation's length.

A digest of a conversation is sequential by nature, so a conversation is streamed by one task; what a row needs to know
of far rows (was this said before?) comes from a grouped count, not from a set of all earlier rows.

Nulls and edge cases: conv_id may be null (those rows are one conversation); a null turn stands first and counts for no
gap; a null role or text is one blank; rows of equal turn are ordered by role and text, so repeated rows are adjacent
duplicates; a role without or with another initial can't be kept; texts are read whole; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import sized, written

#: Costs of edits, and what an undeleted truncated row adds.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: Blanks, ends of sentences, and the damage done by crc32 % 20.
BLANK, ENDS = " \t\n\x0b\x0c\r", ".!?"
DROP, EMPTY, UNMARK, REPEAT, TO_USER = range(5)
#: Rows of a conversation whose backpointers are held at once.
BLOCK = 1 << 16

#: States of `(s?(ua)+)?`: nothing yet, after s, after u, after a; what is kept or set leads from one to another.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FORCED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
ACCEPTED = (START, ASSISTANT)
#: Adjacent initials that need no repair.
LEGAL = {"su", "ua", "au"}

STREAMED = "conv_id string, block int, starts array<int>, edits array<string>, ending int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text as damaged, and `times`: how often the row stands there (0 where it is dropped)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    role, text = space("role"), space("text")
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == TO_USER, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == EMPTY, F.lit("")).when(kind == UNMARK, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.when(kind == DROP, 0).when(kind == REPEAT, 2).otherwise(1).alias("times"),
    )


class Situations:
    """The dynamic program's table. A situation: for each state the cost above the cheapest (None: out), and for each
    pair of states how their edit strings compare (-1, 1, or ('I', k): the second is the first and k insertions more)."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.known: list[tuple] = []
        self.steps: dict[tuple[int, str, bool, bool], int] = {}
        self.table: list[tuple[int, int, tuple]] = []  # next situation, cost of the cheapest, back: (state before, edits) of each state
        begin: list = [None] * 4
        begin[START] = (0, START, "")
        self.first = self._close(begin, {})

    @staticmethod
    def _short(x: str, y: str):
        if x == y:
            return 0
        if y.startswith(x):
            return ("I", len(y) - len(x))
        if x.startswith(y):
            return ("I", len(y) - len(x))
        return -1 if x < y else 1

    def _compare(self, order: dict, p: int, x: str, q: int, y: str):
        """How the string of state p and x compares with that of state q and y."""
        if p == q:
            return self._short(x, y)
        found = order[p, q]
        if isinstance(found, int):
            return found
        return self._short(x, "I" * found[1] + y) if found[1] > 0 else self._short("I" * -found[1] + x, y)

    def _close(self, best: list, order: dict) -> int:
        """Entry of the table for states reached as (cost, state before, edits), after insertions."""
        changed = True
        while changed:
            changed = False
            for state in range(4):
                if best[state] is not None:
                    cost, before, edits = best[state]
                    changed |= self._offer(best, order, FORCED[state], (cost + INSERT, before, edits + "I"))
        # from `a` all goes on as from the start, but that a leading s must be deleted; and as from s, but for the end
        if best[ASSISTANT]:
            for state, lead in ((START, DELETE), (SYSTEM, 0)):
                if best[state] and best[state][0] > best[ASSISTANT][0] + lead:
                    best[state] = None
        least = min(b[0] for b in best if b)
        compared = {(s, t): self._compare(order, *best[s][1:], *best[t][1:]) for s in range(4) for t in range(4) if s != t and best[s] and best[t]}
        situation = (tuple(b and b[0] - least for b in best), tuple(sorted(compared.items())))
        if situation not in self.number:
            self.number[situation] = len(self.known)
            self.known.append((situation[0], compared))
        self.table.append((self.number[situation], least, tuple(b and b[1:] for b in best)))
        return len(self.table) - 1

    def _offer(self, best: list, order: dict, state: int, new: tuple) -> bool:
        old = best[state]
        if old is None or new[0] < old[0] or new[0] == old[0] and new[1:] != old[1:] and self._compare(order, *new[1:], *old[1:]) == -1:
            best[state] = new
            return True
        return False

    def step(self, situation: int, initial: str, doomed: bool, truncated: bool) -> int:
        """Entry of the table for one row more: its role's initial, whether it must go, whether it is truncated."""
        key = (situation, initial, doomed, truncated)
        found = self.steps.get(key)
        if found is None:
            costs, order = self.known[situation]
            best: list = [None] * 4
            extra = TRUNCATED if truncated else 0
            for state, cost in enumerate(costs):
                if cost is not None:
                    self._offer(best, order, state, (cost + DELETE, state, "D"))
                    if not doomed:
                        if (state, initial) in KEPT:
                            self._offer(best, order, KEPT[state, initial], (cost + extra, state, "K"))
                        self._offer(best, order, FORCED[state], (cost + extra + REROLE, state, "R"))
            found = self.steps[key] = self._close(best, order)
        return found

    def ending(self, situation: int) -> int:
        """The accepted state with the cheapest edits, the ASCII-least of equals."""
        costs, order = self.known[situation]
        start, end = (costs[s] for s in ACCEPTED)
        if start is None or end is None:
            return START if end is None else ASSISTANT
        return START if start < end or start == end and order[ACCEPTED] == -1 else ASSISTANT

    def back(self, entries: array, state: int) -> tuple[int, str]:
        """The state before these rows and the edits since, for the state after them."""
        edits = []
        for entry in reversed(entries):
            state, some = self.table[entry][2][state]
            edits.append(some)
        return state, "".join(reversed(edits))


class Conversation:
    """One conversation as it is read."""

    def __init__(self, situations: Situations, conv: str | None, block: int):
        self.situations, self.conv, self.block = situations, conv, block
        entry = situations.first
        self.situation, self.cost, _ = situations.table[entry]
        self.entries, self.blocks = array("i", [entry]), 0
        self.digests: list = [None] * 4
        self._emit(entry, [hashlib.sha256(), None, None, None], "", "")
        self.last, self.initial = None, None
        self.lowest = self.highest = self.previous = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def _emit(self, entry: int, before: list, role: str, text: str) -> None:
        """The digest of each state's repaired text; a digest is copied before it goes on, so states may share one."""
        after: list = [None] * 4
        for state, way in enumerate(self.situations.table[entry][2]):
            if way is None:
                continue
            at, edits = way
            digest = before[at]
            for edit in edits:
                if edit != "D":
                    digest = digest.copy()
                    come = KEPT[at, role[:1]] if edit == "K" else FORCED[at]
                    said = f"{role if edit == 'K' else ROLE[come]}:{'' if edit == 'I' else text}"
                    digest.update((said if at == START else f"\n{said}").encode())
                    at = come
            after[state] = digest
        self.digests = after

    def add(self, turn: str | None, role: str, text: str, blank: bool, truncated: bool, said_before: bool) -> list | None:
        """Take one row; a full block of backpointers, if there is one."""
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        this = (turn, role, text)
        duplicate = not blank and (said_before or this == self.last)
        truncated = truncated and not blank and not duplicate
        self.last = this
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if turn is not None and turn != self.previous:
            number = int(turn)
            self.turns += 1
            self.lowest, self.highest, self.previous = number if self.lowest is None else self.lowest, number, turn
        entry = self.situations.step(self.situation, initial if initial in ("s", "u", "a") else "", blank or duplicate, truncated)
        self.situation, more, _ = self.situations.table[entry]
        self.cost += more
        self.entries.append(entry)
        self._emit(entry, self.digests, role, text)
        return self._flushed() if len(self.entries) >= self.block else None

    def _flushed(self) -> list:
        live = [self.situations.back(self.entries, s) if c is not None else (None, None) for s, c in enumerate(self.situations.known[self.situation][0])]
        self.blocks += 1
        self.entries = array("i")
        return [self.conv, self.blocks - 1, [x[0] for x in live], [x[1] for x in live], *[None] * 9]

    def ended(self) -> list[list]:
        """The conversation's row, behind its last block if it has blocks."""
        ending = self.situations.ending(self.situation)
        rows, audit = [], None
        if self.blocks:
            rows.append(self._flushed())
        else:
            audit = self.situations.back(self.entries, ending)[1]
        gaps = self.highest - self.lowest + 1 - self.turns if self.turns else 0
        cost = self.cost + self.situations.known[self.situation][0][ending]
        return [*rows, [self.conv, None, None, None, ending, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, self.digests[ending].hexdigest()]]


def repair(rows: DataFrame, times: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row per conversation: faults, cheapest edits, their cost, and the digest of the repaired rows.

    rows: conv_id, turn, role, text; times: a column that says how often a row stands there. Each row's first fault
    counts: blank, duplicate (said before by the same role), truncated. block: rows whose backpointers are held at once.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), (F.col(times) if times else F.lit(1)).cast("int").alias("times"))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = rows.withColumn("_said", said)
    # rows that say the same on several turns; on one turn they are adjacent
    again = rows.where("times > 0").groupBy("conv_id", "_said").agg(F.min("turn").alias("_first"), F.max("turn").alias("_last"), F.bool_or(F.col("turn").isNull()).alias("_unset"))
    again = written(again.where("_first < _last or _unset and _first is not null").select(F.col("conv_id").alias("_conv"), F.col("_said").alias("_again"), "_first", "_unset"))
    rows = rows.join(sized(again), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_said") == F.col("_again")), "left")
    end = F.rtrim(F.col("text"), F.lit(BLANK))
    judged = rows.select(
        "conv_id", "turn", F.col("turn").cast("string").alias("turn_text"), "role", "text", "times",
        (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(*ENDS)).alias("truncated"),
        F.coalesce(F.col("turn").isNotNull() & (F.col("_unset") | (F.col("turn") > F.col("_first"))), F.lit(False)).alias("said_before"),
    )
    ordered = judged.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").drop("turn")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        situations, now, out = Situations(), None, []

        def table() -> pd.DataFrame:
            done = pd.DataFrame(out, columns=NAMES).astype({c: "Int64" for c in WHOLE})
            out.clear()
            return done

        for batch in batches:
            for conv, turn, role, text, count, blank, truncated, said_before in zip(*(batch[c] for c in batch.columns), strict=True):
                conv, turn = (None if x is None or x != x else x for x in (conv, turn))  # pandas may give NaN for null
                if now is None or now.conv != conv:
                    if now:
                        out.extend(now.ended())
                    now = Conversation(situations, conv, block)
                for copy in range(count):
                    full = now.add(turn, role, text, blank, truncated, said_before or copy > 0)
                    if full:
                        out.append(full)
            yield table()
        if now:
            out.extend(now.ended())
        yield table()

    streamed = written(ordered.mapInPandas(stream, STREAMED))
    ends = streamed.where("block is null")
    joined = ends.where("audit is null").select(F.col("conv_id").alias("_conv"), "ending").join(chained(streamed).hint("merge"), F.col("_conv").eqNullSafe(F.col("conv_id"))).select("_conv", F.col("_audit"))
    whole = ends.join(joined.hint("merge"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return whole.select(F.col("conv_id").cast("long").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.coalesce("audit", "_audit").alias("audit"), "repaired_sha256")


NAMES = [x.split()[0] for x in STREAMED.split(", ")]
WHOLE = ["block", "ending", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def chained(streamed: DataFrame) -> DataFrame:
    """conv_id and edits of the conversations that were handed on in blocks. The states at the borders are found from the
    last block to the first; then each block gives the edits that lead to its state."""
    last = streamed.where("block is null and audit is null").select("conv_id", "ending")
    borders = streamed.where("block is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "starts")), asc=False).alias("_blocks"))
    step = lambda acc, b: F.struct(F.get(b["starts"], acc["state"]).alias("state"), F.concat(F.array(acc["state"]), acc["picks"]).alias("picks"))
    named = borders.withColumnRenamed("conv_id", "_c").join(last.hint("merge"), F.col("_c").eqNullSafe(F.col("conv_id")))
    picks = named.select("_c", F.aggregate("_blocks", F.struct(F.col("ending").alias("state"), F.array().cast("array<int>").alias("picks")), step)["picks"].alias("_picks"))
    picks = picks.select("_c", F.posexplode("_picks").alias("_block", "_pick"))
    blocks = streamed.where("block is not null").select("conv_id", "block", "edits")
    chosen = blocks.join(picks.hint("merge"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_block"))).select("conv_id", "block", F.get("edits", F.col("_pick")).alias("edits"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "edits"))), lambda x: x["edits"]), "")
    return chosen.groupBy("conv_id").agg(joined.alias("_audit"))
