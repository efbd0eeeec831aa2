"""Repair of conversations against a search over states with whole audits as values."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from corpusmill.llm import op11_conversations as op

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, output) of the cheapest repair, by states of the grammar."""
    seen, kinds = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACES)
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    best = {(0, ""): (0, "", ())}  # rows taken, last role's initial

    def better(key, value):
        if key not in best or value[:2] < best[key][:2]:
            best[key] = value
            return True
        return False

    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    for i in range(len(rows) + 1):
        grew = True
        while grew:  # inserts
            grew = False
            for (at, last), (cost, audit, out) in list(best.items()):
                if at == i:
                    for c in follows[last].replace("s", ""):
                        grew |= better((i, c), (cost + 3, audit + "I", (*out, ({"u": "user", "a": "assistant"}[c], ""))))
        if i == len(rows):
            break
        _, role, text = rows[i]
        for (at, last), (cost, audit, out) in list(best.items()):
            if at != i:
                continue
            better((i + 1, last), (cost + 4, audit + "D", out))
            if kinds[i] in ("blank", "duplicate"):
                continue
            late = 3 * (kinds[i] == "truncated")
            for c in follows[last]:
                if role[:1] == c:
                    better((i + 1, c), (cost + late, audit + "K", (*out, (role, text))))
                if c != "s":
                    better((i + 1, c), (cost + 3 + late, audit + "R", (*out, ({"u": "user", "a": "assistant"}[c], text))))
    cost, audit, out = min((best[len(rows), q] for q in ("", "a") if (len(rows), q) in best), key=lambda v: v[:2])
    return kinds, cost, audit, "\n".join(f"{r}:{t}" for r, t in out)


def told(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    kinds, cost, audit, out = cheapest(rows)
    numbers = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256(out.encode()).hexdigest())


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        out += [(conv, (turn, "user" if k == 4 else role, text))] * (2 if k == 3 else 1)
    return out


@pytest.fixture(scope="module")
def talks():
    rng, rows = random.Random(5), []
    for conv in range(150):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            role = "system" if turn == 0 and rng.random() < 0.5 else role
            rows.append((conv, turn, role, rng.choice(["hello there.", "well", "what? \n", "yes!", "ça va.", f"n {rng.random()}."])))
    rows += [(None, 0, "user", "q?"), (None, None, "assistant", "a."), (None, 1, None, None), (200, None, "user", "x."), (200, None, "user", "x."), (201, 5, "", "y."), (201, 5, "tool", "z"), (201, 9, "user", ""), (202, 0, "user", "w" * 200_000), (202, 1, "assistant", "v" * 200_000 + ".")]
    rows += [(203, t, rng.choice(["user", "assistant", "system", "other"]), rng.choice(["one.", "two", f"{t}.", f"{t}"])) for t in range(60)]
    return rows + rows[:3]


def test_repair_is_the_cheapest(spark, talks):
    wanted = {}
    for conv, *row in talks:
        wanted.setdefault(conv, []).append((row[0], row[1] if row[1] is not None else " ", row[2] if row[2] is not None else " "))
    df = spark.createDataFrame([(*r, "own") for r in talks], SCHEMA + ", conv string").repartition(3)
    for most in (op.MOST_ROWS, 4):  # streamed; split into blocks
        got = op.repair(df, texts=True, most_rows=most).collect()
        assert len(got) == len(wanted) and set(got[0].asDict()) == {"conv_id", "gaps", *op.COUNTS, "cost", "audit", "repaired_sha256", "repaired"}
        for r in got:
            assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == told(wanted[r.conv_id]), (most, r.conv_id)
            assert hashlib.sha256(r.repaired.encode()).hexdigest() == r.repaired_sha256


def test_blocks_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_BITS", 3)
    rng = random.Random(8)
    rows = [(1, t // 3, rng.choice(["user", "assistant", "system", "other"]), rng.choice(["one.", f"{t}.", f"{t}", ""])) for t in range(300)] + [(2, None, "user", "same.")] * 40
    got = {r.conv_id: r for r in op.repair(spark.createDataFrame(rows, SCHEMA), most_rows=20).collect()}
    for conv in (1, 2):
        r = got[conv]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == told([x[1:] for x in rows if x[0] == conv])


def test_registered_query(spark, talks, tmp_path):
    spark.createDataFrame([*talks, *((300 + k, t, "user", "only.") for k in range(40) for t in range(1))], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    every = {r[0] for r in talks} | {300 + k for k in range(40)}
    left = {}
    for conv, row in damage([*talks, *((300 + k, 0, "user", "only.") for k in range(40))]):
        left.setdefault(conv, []).append(row)
    got = op.op11_conversations(spark, str(tmp_path)).collect()
    assert {r.conv_id for r in got} == every and len(got) == len(every)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    for r in got:
        assert tuple(r)[1:] == (told(left[r.conv_id]) if r.conv_id in left else empty), r.conv_id
    assert any(c not in left for c in every)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert op.repair(none).count() == 0 and op.damaged(none).count() == 0
