"""Conversation repair against a search over all edit strings, and its edge cases."""

import hashlib
import re
import zlib
from functools import lru_cache

import pytest

from quirelake.llm.conversation_repair import damage, repair
from quirelake.llm.queries import op13_conversation_repair

LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")


def damaged(rows):
    """{conv: rows after damage, in order}; rows: (conv, turn, role, text)."""
    found = {}
    for conv, turn, role, text in rows:
        mine = found.setdefault(conv, [])
        said = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(said.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        mine += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in found.items()}


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        m = LAST.search(text)
        found.append("blank" if not m else "duplicate" if (role, text) in seen else "truncated" if m[1] not in ".!?" else "")
        seen.add((role, text))
    return found


def searched(rows):
    """The cheapest edits, ASCII-least of equals, by trying all of them from every place and roles so far."""
    kinds = faults(rows)

    def shape(said):  # what matters of the roles so far, or None if they can't be completed
        m = re.fullmatch("(s?)(?:ua)*(u?)", said)
        return None if not m else (said == "", said == "s", bool(m[2]))

    @lru_cache(None)
    def best(at, start, only_s, open_u, inserted):
        said = "" if start else "s" if only_s else "uau" if open_u else "ua"
        ways = [(0, "", ())] if at == len(rows) and re.fullmatch("(s?(ua)+)?", said) else []

        def go(cost, letter, role, nxt, ins):
            to = shape(said + role[:1]) if role is not None else (start, only_s, open_u)
            if to is not None:
                rest = best(nxt, *to, ins)
                if rest:
                    ways.append((cost + rest[0], letter + rest[1], ((role,) if role is not None else (None,)) + rest[2]))

        if inserted < 3:
            for role in ("user", "assistant"):
                go(3, "I", role, at, inserted + 1)
        if at < len(rows):
            extra = 3 if kinds[at] == "truncated" else 0
            go(4, "D", None, at + 1, 0)
            if kinds[at] not in ("blank", "duplicate"):
                if rows[at][1][:1] in ("s", "u", "a"):
                    go(extra, "K", rows[at][1], at + 1, 0)
                for role in ("user", "assistant"):
                    go(3 + extra, "R", role, at + 1, 0)
        return min(ways, key=lambda w: w[:2]) if ways else None

    return best(0, True, False, False, 0)


def expected(rows):
    found = {}
    for conv, mine in damaged(rows).items():
        cost, audit, roles = searched(tuple(mine))
        lines, at = [], 0
        for letter, role in zip(audit, roles, strict=True):
            if letter in "KR":
                lines.append(f"{role}:{mine[at][2]}")
            elif letter == "I":
                lines.append(f"{role}:")
            at += letter != "I"
        kinds, turns = faults(mine), {t for t, _, _ in mine if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        found[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, tied turns, repeated rows, odd roles, gaps, and many short conversations of all shapes."""
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (7, None, "user", "a."), (7, 3, "user", "a."), (7, 9, "", "b"), (7, 9, "assistant", "."), (8, 1, "tool", "x."), (8, 2, "useful", " "), (8, 2**40, "assistant", "é?\n\t")]
    roles = ["user", "assistant", "system", "tool", None, "user", "assistant"]
    texts = ["Yes.", "No", " \t", "", "Why? ", None, "One. Two", "Yes."]
    for conv in range(100, 420):
        mixed = zlib.crc32(str(conv).encode())
        for turn in range(conv % 9):
            mixed = zlib.crc32(str(mixed).encode())
            rows.append((conv, turn + mixed % 3, roles[mixed // 7 % 7], texts[mixed // 64 % 8] if mixed % 5 else f"{mixed}."))
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, block string, times int")


def test_repairs_equal_a_search_over_all_edits(odd):
    rows, df = odd
    assert got(repair(damage(df), times="times")) == expected(rows)


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_blocks_of_backpointers_give_the_same(odd, block):
    rows, df = odd
    assert got(repair(damage(df), times="times", block=block)) == expected(rows)


def test_given_conversations(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = op13_conversation_repair(spark, path)
    assert got(df) == expected(rows)
    assert dict(df.dtypes) == {"conv_id": "bigint", "audit": "string", "repaired_sha256": "string"} | dict.fromkeys(COLUMNS[:6], "bigint")


def test_long_conversation_and_empty_table(spark):
    long = [(1, i, ("user", "assistant")[i % 2] if i % 50 else "tool", f"{i}." if i % 7 else "same.") for i in range(3000)]
    df = spark.createDataFrame(long, "conv_id long, turn long, role string, text string")
    assert got(repair(damage(df), times="times", block=64)) == got(repair(damage(df), times="times"))
    assert repair(damage(df.limit(0)), times="times").count() == 0
