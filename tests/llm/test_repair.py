"""Conversation repair against an exhaustive search over edits."""

import collections
import hashlib
import heapq
import random
import re
import zlib

from pepspark.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, copies long, audit string, codes binary, `a.b` string"
DONE = re.compile(r"(s?(ua)+)?")
OPEN = re.compile(r"s?(ua)*u?")
WHITE = " \t\n\x0b\f\r"


def search(rows):
    """Least (cost, audit) and its lines; rows are (role, text, fault). Every prefix of edits is tried in (cost, audit) order."""
    heap, seen = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, said, lines = heapq.heappop(heap)
        if i == len(rows) and DONE.fullmatch(said):
            return cost, audit, lines
        if (i, said[:1] == "s", said[-1:]) in seen:
            continue
        seen.add((i, said[:1] == "s", said[-1:]))
        more = []
        for role in ("user", "assistant"):
            more.append((3, "I", i, role, ""))
        if i < len(rows):
            role, text, fault = rows[i]
            more.append((4, "D", i + 1, None, None))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                more.append((extra, "K", i + 1, role, text))
                more += [(3 + extra, "R", i + 1, other, text) for other in ("user", "assistant")]
        for price, edit, after, role, text in more:
            now = said if role is None else said + (role[:1] or "?")
            if OPEN.fullmatch(now):
                heapq.heappush(heap, (cost + price, audit + edit, after, now, lines if role is None else (*lines, f"{role}:{text}")))


def expect(rows, damage):
    found = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        kept = found[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 19
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, kept in found.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked, faults = set(), [], collections.Counter()
        for _, role, text in kept:
            body = text.strip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            marked.append((role, text, fault))
        turns = {t for t, _, _ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        cost, audit, lines = search(marked)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha))
    return sorted(out, key=str)


def repaired(spark, rows, damage=False, **more):
    df = spark.createDataFrame([(*r, 5, "x", b"y", "z") for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in repair.repair(df, damage, **more).collect()), key=str)


def conversations(seed, n):
    rng, rows = random.Random(seed), []
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "System", "assist"]
    texts = ["hi.", "why?", "go on", "same!", "", " \n", None, "é so.", "cut. \t", "."]
    for conv in range(n):
        for turn in range(rng.randrange(8)):
            rows += [(conv if conv else None, rng.choice([turn, turn, turn + 3, None]), rng.choice(roles), rng.choice(texts))] * rng.choice([1, 1, 1, 2])
    return rows


def test_repair_equals_search(spark):
    rows = conversations(1, 60)
    assert repaired(spark, rows) == expect(rows, False)
    assert repaired(spark, rows, damage=True) == expect(rows, True)


def test_cut_conversations(spark):
    """A conversation of a third of all rows, cut into many pieces, and one very long text."""
    rows = conversations(2, 30) + [(77, t, ("user", "assistant")[t % 2] if t % 7 else "tool", ["hot.", "more", f"t{t}."][t % 3]) for t in range(120)]
    rows += [(78, 0, "user", "x" * 300_000), (78, 1, "assistant", "y" * 300_000 + ".")]
    assert repaired(spark, rows, most=12) == expect(rows, False)


def test_empty_and_lost(spark):
    assert repaired(spark, []) == []
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert repaired(spark, [(lost, 1, "user", "a.")], damage=True) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_cheapest_repair_of_all_short_codes():
    kinds = [(r, f) for r in ("system", "user", "assistant", "tool") for f in ("", "truncated", "blank")]
    bits = {"": 0, "truncated": repair.CUT_OFF, "blank": repair.GONE}

    def check(rows):
        codes = bytes(repair.CLASS.get(r[0], repair.OTHER) | bits[f] for r, f in rows)
        assert repair.cheapest_repair(codes) == search([(r, "t", f) for r, f in rows])[:2]

    check([])
    for a in kinds:
        check([a])
        for b in kinds:
            check([a, b])
            for c in kinds:
                check([a, b, c])
    rng = random.Random(5)
    for _ in range(300):
        check(rng.choices(kinds, k=rng.randrange(4, 12)))


def test_work_grows_with_rows():
    codes = bytes(random.Random(7).choices([0, 1, 2, 3, 6, 7, 10, 11], k=200_000))
    cost, audit = repair.cheapest_repair(codes)
    assert cost == repair.suffix_bounds(codes)[0] and len(audit.replace("I", "")) == len(codes)
