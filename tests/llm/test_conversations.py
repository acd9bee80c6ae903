"""Conversation repair against a search over all edits, and against SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from wellspark.llm import conversations as cv

LEGAL = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def cheapest(rows):
    """Least (cost, audit, lines) by trying every edit; rows are (role, text, fault)."""

    @lru_cache(maxsize=None)
    def best(i, before, inserted):
        found = []
        if i == len(rows) and before in ("", "a"):
            found.append((0, "", ()))
        if inserted < 3:
            role = "assistant" if before == "u" else "user"
            c, a, t = best(i, role[0], inserted + 1)
            found.append((c + 5, "I" + a, (f"{role}:", *t)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, t = best(i + 1, before, 0)
            found.append((c + 2, "D" + a, t))
            stays = 5 * (fault == 3)
            if fault not in (1, 2):
                if (before, role[:1]) in LEGAL:
                    c, a, t = best(i + 1, role[:1], 0)
                    found.append((c + stays, "K" + a, (f"{role}:{text}", *t)))
                new = "assistant" if before == "u" else "user"
                c, a, t = best(i + 1, new[0], 0)
                found.append((c + 1 + stays, "R" + a, (f"{new}:{text}", *t)))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def naive(rows):
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        kept.setdefault(conv, [])
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(what, text)
        kept[conv] += [(turn, "user" if what == 4 else role, text)] * {0: 0, 3: 2}.get(what, 1)
    out = []
    for conv, each in kept.items():
        each.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in each:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = [t for t, *_ in each if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(each, each[1:]))
        cost, audit, lines = cheapest(tuple((r, t, f) for (_, r, t), f in zip(each, faults)))
        out.append((conv, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def given(seed=3, convs=120):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(r.choice([0, 1, 2, 5, 9, 14])):
            role = r.choice(["system", "user", "user", "assistant", "assistant", "tool", None])
            text = r.choice(["Yes.", "No!", "cut off", "", " \t\n", None, "Same.", "x?\n", f"text {r.random()}.", "é 😀!"])
            rows += [(c, r.choice([t, t, t + 1, None]), role, text)] * r.choice([1, 1, 1, 2])
    return rows + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (-5, None, None, None), (900, 3, "user", "x" * 50_000 + "."), (900, 4, "assistant", "y.")]


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


NAMES = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 16), (8, 4)])
def test_repairs_equal_the_search_over_all_edits(spark, monkeypatch, sizes):
    monkeypatch.setattr(cv, "SPILL", sizes[0])
    monkeypatch.setattr(cv, "PAGE", sizes[1])
    rows = given()
    clash = table(spark, rows).withColumns({c: F.lit("clash") for c in ("key", "fault", "said", "page", "edits", "cost", "tag", "_what")})
    got = cv.audit(clash.repartition(5)).collect()
    assert sorted((tuple(r[n] for n in NAMES) for r in got), key=str) == naive(rows)


def test_empty_table(spark):
    assert cv.audit(table(spark, [])).count() == 0
    assert cv.Repairs(table(spark, [])).repaired.count() == 0


def test_repaired_turns_are_legal(spark):
    rows = [r for r in given(7) if r[0] is not None]
    turns = defaultdict(list)
    for r in cv.Repairs(table(spark, rows)).repaired.orderBy("conv_id", "position").collect():
        turns[r.conv_id].append(r)
    for each in turns.values():
        assert [r.position for r in each] == list(range(len(each)))
        assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in each))


def test_a_giant_conversation_spills_and_many_copies_are_one_row():
    search = cv.Search({})
    for _ in range(3):
        search.row("a", cv.NO_FAULT, 1)
        search.row("u", cv.NO_FAULT, 700_000)
    assert search.spool._rolled and search.n == 2_100_003 and search.cost() == 2 * 3 * 699_999
    edits = "".join(search.pages())
    assert edits == ("K" + "D" * 699_999 + "K") * 3
