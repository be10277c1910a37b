"""Conversation repair against a brute-force search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

from aerodeck.llm import repair

SPACES = " \t\n\x0b\x0c\r"


def brute(rows):
    """Per conversation, by uniform-cost search over whole strings of edits and a pattern for the roles."""
    sp = lambda x: " " if x is None else str(x)
    out = {}
    for conv in {r[0] for r in rows}:
        left = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text, d = sp(role), sp(text), zlib.crc32(f"{sp(c)}:{sp(turn)}".encode()) % 20
            if d == 0:
                continue
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            left += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns, seen, faults = [t for t, *_ in left if t is not None], set(), []
        for _, role, text in left:
            faults.append("blank" if not text.strip(SPACES) else "duplicate" if (role, text) in seen else "truncated" if text.strip(SPACES)[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, roles = cheapest([r[:1] for _, r, _ in left], faults)
        done, i, j = [], 0, 0
        for letter in audit:
            if letter != "I":
                _, role, text = left[i]
                i += 1
            if letter != "D":
                done.append((role if letter == "K" else {"u": "user", "a": "assistant"}[roles[j]]) + ":" + ("" if letter == "I" else text))
                j += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())
    return out


def cheapest(initials, faults):
    """(cost, audit, roles): strings of edits in order of cost and audit, as far as their roles can be completed."""
    agenda, met = [(0, "", "", 0)], set()
    while agenda:
        cost, audit, roles, i = heapq.heappop(agenda)
        if i == len(initials) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, roles
        if (i, roles[-1:], len(roles) == 0) in met:
            continue
        met.add((i, roles[-1:], len(roles) == 0))
        good = lambda r: re.fullmatch("s?(ua)*u?", r)
        for x in "ua":
            if good(roles + x):
                heapq.heappush(agenda, (cost + 2, audit + "I", roles + x, i))
        if i < len(initials):
            heapq.heappush(agenda, (cost + 3, audit + "D", roles, i + 1))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if initials[i] and good(roles + initials[i]):
                    heapq.heappush(agenda, (cost + more, audit + "K", roles + initials[i], i + 1))
                for x in "ua":
                    if good(roles + x):
                        heapq.heappush(agenda, (cost + 2 + more, audit + "R", roles + x, i + 1))
    raise AssertionError


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
KIND = "conv_id long, turn long, role string, text string"


def found(df, **more):
    got = repair.repair(df, **more).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got}


def sample(seed, sizes):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "Sys", "unknown"]
    texts = ["Hi there.", "Why?", "no end", "", " \n\t", None, "Yes! ", "a. b", " ", "Good　", "x.\x0b"]
    rows = []
    for conv, n in enumerate(sizes):
        usual = r.random()
        for t in range(n):
            role = ("user", "assistant")[t % 2] if r.random() < usual else r.choice(roles)
            rows.append((conv, t + r.choice([0, 0, 0, 3]) if r.random() < 0.97 else None, role, r.choice(texts) if r.random() < 0.4 else f"text {r.random()}."))
    return rows


def test_repair(spark):
    rows = sample(4, [0, *[random.Random(1).randrange(1, 12) for _ in range(250)], 40, 90])
    rows += [(None, t, r, x) for t, r, x in [(0, "user", "a."), (1, None, "b."), (None, "assistant", None)]]
    rows += [(900, 3, "user", "same.")] * 5 + [(901, None, None, None)] + [(902, 2**62, "user", "u."), (902, -5, "assistant", "a.")] + [(903, 0, "user", "word. " * 100_000)]
    df = spark.createDataFrame([(*x, 1, "z", 2) for x in rows], KIND + ", place long, audit string, rows int").repartition(5)
    want = brute(rows)
    got = found(df)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv


def test_parts_join_to_the_same_repair(spark):
    """Short parts and small folds, over several levels, give what one part gives."""
    rows = sample(8, [700, 3, 5, 300, 1])
    assert found(spark.createDataFrame(rows, KIND), part=7, fan=3) == brute(rows)


def test_empty_tables_and_dropped_conversations(spark):
    assert found(spark.createDataFrame([], KIND)) == {}
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert found(spark.createDataFrame([(conv, 0, "user", "x.")], KIND)) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_folds_agree_with_one_run():
    r = random.Random(3)
    for _ in range(200):
        rows = [(r.choice("suax"), r.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(r.randrange(1, 14))]
        whole = {(c["start"], c["end"]): (c["cost"], c["audit"]) for c in repair.repaired_part(rows, repair.STATES, False)}
        cuts = sorted({0, len(rows), *(r.randrange(1, len(rows) + 1) for _ in range(3))})
        parts = [repair.repaired_part(rows[a:b], repair.STATES, False) for a, b in zip(cuts, cuts[1:])]
        assert {(c["start"], c["end"]): (c["cost"], c["audit"]) for c in repair.folded(parts, repair.STATES)} == whole
