"""Repair of conversations against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from hearsay.llm import turns

WHITE = " \t\n\x0b\x0c\r"
PATTERN = re.compile(r"(s?(ua)+)?\Z")


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """The least (cost, letters) by going through all rows and states from the end, whole strings compared."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    due = {0: "u", 1: "u", 2: "a", 3: "u"}
    best = {}
    for i in range(len(rows), -1, -1):
        for s in range(4):
            options = []
            if i == len(rows):
                options += [(0, "")] if s in (0, 3) else []
            else:
                must, more = faults[i] in ("blank", "duplicate"), 5 if faults[i] == "truncated" else 0
                options.append((2 + best[i + 1, s][0], "D" + best[i + 1, s][1]))
                if not must:
                    t = after.get((s, rows[i][0][:1]))
                    if t is not None:
                        options.append((more + best[i + 1, t][0], "K" + best[i + 1, t][1]))
                    t = after[s, due[s]]
                    options.append((1 + more + best[i + 1, t][0], "R" + best[i + 1, t][1]))
            best[i, s] = min(options, default=(10**9, ""))
        for _ in range(3):
            for s in range(4):
                cost, letters = best[i, after[s, due[s]]]
                best[i, s] = min(best[i, s], (cost + 5, "I" + letters))
    return best[0, 0]


def applied(rows, letters):
    out, i, state = [], 0, 0
    for e in letters:
        if e == "D":
            i += 1
            continue
        role = rows[i][0] if e == "K" else "assistant" if out and out[-1][0][0] == "u" else "user"
        out.append((role, "" if e == "I" else rows[i][1]))
        i += e != "I"
    assert i == len(rows) and PATTERN.match("".join(r[0] for r, _ in out))
    return out


def brute(conversations):
    groups = {}
    for conv, turn, role, text in conversations:
        own = groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(key.encode()) % 20
        if harm == 0:
            continue
        role = "user" if harm == 4 else role
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        own += [(turn, role, text)] * (2 if harm == 3 else 1)
    out = set()
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        rows = [(role, text) for _, role, text in own]
        known = [t for t, _, _ in own if t is not None]
        faults = faults_of(rows)
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
        cost, letters = cheapest(rows, faults)
        text = "\n".join(f"{r}:{t}" for r, t in applied(rows, letters))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.add((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest()))
    return out


def frame(spark, rows):
    rows = [(*r, 5, "x", b"p") for r in rows]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int, code string, audit binary")


def result(spark, rows):
    kept, plans = turns.repair(frame(spark, rows).repartition(4))
    return [tuple(r) for r in turns.digested(kept, plans).collect()]


def sample(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "User", "", " ", None, "ab"]
    texts = ["Hi.", "Yes!", "No", "so?", "", " \n", None, "end. \t", "cut", "ünïcode…", "two\nlines."]
    rows = []
    for conv in range(n):
        for t in range(rng.randint(1, 9)):
            turn = rng.choice([t, t, t, t, t + 3, None, -t])
            good = rng.random() < 0.5
            rows.append((conv, turn, ("user", "assistant")[t % 2] if good else rng.choice(roles), f"text {rng.random()}." if good else rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_search(spark, seed):
    rows = sample(seed, 250) + [(None, 0, "user", "a."), (None, None, None, None), (None, 1, "assistant", "b.")]
    rows += rows[:40]  # repeated rows
    got = result(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_every_short_conversation():
    """All rows of three kinds each up to length four, against all letters that a repair may have."""
    table = turns.tables()
    for n in range(5):
        for kinds in product(range(turns.KINDS), repeat=n):
            if n == 4 and hash(kinds) % 7:
                continue
            rows = [("suax"[(k - 1) // 2] if k else "u", "") for k in kinds]
            faults = ["blank" if not k else "truncated" if (k - 1) % 2 else "" for k in kinds]
            assert table.solve(turns.np.array(kinds, dtype=turns.np.int64)) == cheapest(rows, faults)


def test_long_conversations_cross_runs(spark, monkeypatch):
    monkeypatch.setattr(turns, "RUN_ROWS", 7)
    rows = [(9, t, r, text) for t, (_, _, r, text) in enumerate(sample(3, 300))]
    rows += [(10, t, "user", "the same.") for t in range(500)] + [(11, t, "ua"[t % 2], "x" * 3000 + f"{t}.") for t in range(300)]
    assert set(result(spark, rows)) == brute(rows)


def test_repaired_turns(spark):
    rows = [(1, 1, "user", "a."), (1, 2, "user", "b."), (2, 1, "assistant", "x.")]
    kept, plans = turns.repair(frame(spark, rows), damage=False)
    out = turns.repaired(kept, plans).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in out] == [(1, 0, "K", "user", "a."), (1, 1, "R", "assistant", "b.")]
    plan = {r.conv_id: (r.cost, r.audit) for r in plans.collect()}
    assert plan == {1: (1, "KR"), 2: (2, "D")}


def test_no_rows_and_all_dropped(spark):
    assert result(spark, []) == []
    gone = [(c, t, "user", "a.") for c in range(60) for t in range(2) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert gone and result(spark, gone) and set(result(spark, gone)) == {(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in gone}


def test_few_vectors_of_costs():
    table = turns.tables()
    assert table.vectors[0] == (0, 10, 5, 0) and len(table.vectors) < 64
    assert table.block.shape == (len(table.vectors), turns.KINDS**turns.BLOCK)
