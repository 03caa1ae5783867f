import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import conversations as C

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damage_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def faults_by_hand(rows):
    seen, out = set(), []
    for role, text in rows:
        core = text.strip(SPACE)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest_by_hand(rows, faults):
    """Every audit with at most three roles put in, tried out one by one."""
    best = None
    for extra in range(4):
        for edits in itertools.product("DKR", repeat=len(rows)):
            if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(faults, edits)):
                continue
            cost = 5 * extra + sum({"D": 2, "K": 0, "R": 1}[e] + 5 * (f == "truncated" and e != "D") for e, f in zip(edits, faults))
            if best and cost > best[0]:
                continue
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), extra):
                audit, made = "", []
                for i in range(len(rows) + 1):
                    audit += "I" * places.count(i)
                    made += [None] * places.count(i)
                    if i < len(rows):
                        audit += edits[i]
                        made += [rows[i] if edits[i] == "K" else (None, rows[i][1])] if edits[i] != "D" else []
                head = 1 if made and made[0] and made[0][0] and made[0][0][0] == "s" else 0
                want = ["user" if (i - head) % 2 == 0 else "assistant" for i in range(len(made))]
                if (len(made) - head) % 2 or (head and len(made) == 1):
                    continue
                turns = []
                for i, m in enumerate(made):
                    role = (m and m[0]) or (want[i] if i >= head else None)
                    if i >= head and role[0] != want[i][0]:
                        break
                    turns.append(f"{role}:{m[1] if m else ''}")
                else:
                    if best is None or (cost, audit) < best[:2]:
                        best = (cost, audit, "\n".join(turns))
    return best


def by_hand(rows):
    held = defaultdict(list)
    for row in damage_by_hand(rows):
        held[row[0]].append(row)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(held[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = {r[1] for r in mine if r[1] is not None}
        pairs = [(r[2], r[3]) for r in mine]
        faults = faults_by_hand(pairs)
        cost, audit, text = cheapest_by_hand(pairs, faults)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def odd_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, 5)):
            at = rng.choice([turn, turn, turn, turn + 10, None])
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", None])
            rows.append((conv, at, role, rng.choice(["Yes.", "No!", "and", " \t", "", None, "Why?\n", "ä. ", "ok。"])))
    return rows


def test_conversations_by_brute_force(spark):
    rows = odd_rows(1, 40)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, block int")
    want = by_hand(rows)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    # in blocks of about one row the result is the same
    for rows_per_block in (C.ROWS_PER_BLOCK, 2):
        got = {r["conv_id"]: tuple(r[c] for c in names) for r in C.repair_damaged(table, rows_per_block).collect()}
        assert got == want
    assert C.repair_damaged(table.limit(0)).count() == 0


def test_long_conversation_in_blocks(spark):
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", f"t{i}.", f"t{i}", ""])) for i in range(3_000)]
    rows += [(2, 0, "user", "Hello."), (2, 1, "assistant", "Yes.")]
    table = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    whole = {r["conv"]: r for r in C.repair(table).collect()}
    parts = {r["conv"]: r for r in C.repair(table, rows_per_block=100).collect()}
    assert whole == parts and whole[2]["audit"] == "KK"
    turns = C.repaired(table, C.repair(table)).where("conv = 1").orderBy("place").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in turns))
    assert "".join(t["edit"] for t in turns) == whole[1]["audit"].replace("D", "")


def test_merging_keeps_the_least_audit():
    chain = C.as_chain("KK")
    assert C.Audit.less(C.Audit(chain, "D"), C.Audit(chain, "K")) and not C.Audit.less(C.Audit(chain, "K"), C.Audit(chain, "D"))
    for a, b in itertools.product(["", "K", "KD", "KKD", "DK", "KDI"], repeat=2):
        assert C.Audit.less(C.as_chain(a), C.as_chain(b)) == (a < b)


def test_grammar():
    stack = C.Stack(C.ROLES)

    def takes(word):
        tops = {0}
        for terminal in word:
            tops = {t for top in tops for t in stack.shift(top, terminal)}
        return any(map(stack.accepts, tops))

    for n in range(6):
        for word in map("".join, itertools.product("sua", repeat=n)):
            assert takes(word) == bool(re.fullmatch("(s?(ua)+)?", word)), word
    # an ambiguous grammar keeps several tops
    both = C.Stack({"T": ["A", "B", "T A"], "A": ["x"], "B": ["x", "x y"]})
    assert any(map(both.accepts, both.shift(0, "x")))
    with pytest.raises(ValueError):
        C.Stack({"T": ["x", "x T"]}).reachable("x")
