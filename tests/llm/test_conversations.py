"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest

from pairsieve.llm.conversations import repair_conversations
from pairsieve.llm.lattice import STATES, best_edits, chain, transfers, whole

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def plain_edits(rows):
    """(cost, letters, repaired) for rows of (role, text, must go, truncated): all edits, least by letters."""
    @lru_cache(None)
    def best(i, state, room):
        found = []
        if i == len(rows):
            if state in (0, 3):
                found.append((0, "", ()))
        else:
            role, text, gone, cut = rows[i]
            cost, letters, rest = best(i + 1, state, 2) or (None, None, None)
            if cost is not None:
                found.append((cost + 4, "D" + letters, rest))
            if not gone:
                for letter, fee, new in [("K", 0, role)] + [("R", 3, r) for r in ("user", "assistant")]:
                    to = STEP.get((state, new[:1]))
                    tail = best(i + 1, to, 2) if to is not None else None
                    if tail:
                        found.append((tail[0] + fee + 3 * cut, letter + tail[1], ((new, text), *tail[2])))
        if room:
            for new in ("user", "assistant"):
                to = STEP.get((state, new[:1]))
                tail = best(i, to, room - 1) if to is not None else None
                if tail:
                    found.append((tail[0] + 3, "I" + tail[1], ((new, ""), *tail[2])))
        return min(found, default=None)

    return best(0, 0, 2)


def plain(rows):
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        word = lambda v: " " if v is None else str(v)
        fate = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        kept += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        counts, seen, marked = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
        for _, role, text in kept:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        turns = [t for t, *_ in kept if t is not None]
        cost, audit, repaired = plain_edits(tuple(marked))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, digest)
    return out


def result(frame):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect()}


def conversations(seed, count, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "What is it?", "unfinished", "", "  \n", None, "end.\x0b ", "tail é", "?"]
    rows = []
    for conv in range(count):
        for i in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]) if rng.random() < 0.4 else ("user", "assistant")[i % 2]
            rows.append((conv, 2 * i + rng.randrange(2), role, rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}."))
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, kind int, conv string, copies int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", None) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("stretch,task_rows", [(256, 200_000), (3, 40)])
def test_against_all_edits(spark, stretch, task_rows):
    rows = conversations(1, 120, 9) + [(None, 4, "user", "A."), (None, 5, "assistant", "B."), (900, None, "system", "S."), (900, 1, "user", "U."), (900, 3, "assistant", "A.")]
    got = result(repair_conversations(frame(spark, rows), stretch=stretch, task_rows=task_rows))
    want = plain(rows)
    assert {c: g for c, g in got.items() if g != want[c]} == {} and got.keys() == want.keys()
    assert result(repair_conversations(frame(spark, rows).filter("conv_id < 0"))) == {}


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(4)
    rows = conversations(2, 20, 6)
    rows += [(7000, i, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{rng.random()}?"])) for i in range(900)]
    got = result(repair_conversations(frame(spark, rows), stretch=16, task_rows=100))
    assert got == plain(rows)


def test_repeated_rows(spark):
    rows = [(1, 3, "user", "Same."), (1, 3, "user", "Same."), (1, 3, "user", "Same."), (1, 4, "user", "Same."), (1, 5, "assistant", "Other.")]
    assert result(repair_conversations(frame(spark, rows))) == plain(rows)


def test_sample_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert result(repair_conversations(table)) == plain([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def spelled(code):
    role = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}.get(code.lower(), "tool")
    return role, "t", code == "D", code.isupper() and code != "D"


@pytest.mark.parametrize("length", range(5))
def test_lattice(length):
    for codes in product("suaxDUA", repeat=length):
        want = plain_edits(tuple(map(spelled, codes)))
        assert whole("".join(codes)) == want[:2]


@pytest.mark.parametrize("seed", range(3))
def test_stretches_chain(seed):
    rng = random.Random(seed)
    for _ in range(150):
        codes = "".join(rng.choice("uauasxDUA") for _ in range(rng.randint(1, 24)))
        cuts = sorted(rng.sample(range(1, len(codes)), min(len(codes) - 1, 3)))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        assert chain([transfers(p) for p in parts]) == whole(codes)
    assert best_edits("", 1, (2,), False) is None and [transfers("")[q][q] for q in range(STATES)] == [(0, "")] * STATES
