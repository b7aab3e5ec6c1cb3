import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb

from weftline.llm import queries, turns

rng = random.Random(23)
WORD, GOOD = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"\A(s?(ua)+)?\Z")
TO = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(kinds):
    """(cost, audit) of rows (initial, must go, truncated) by plain recursion over all edits."""

    # insertions need their own layer, as they stay at a row
    table = {}
    for i in range(len(kinds), -1, -1):
        own = {}
        for said in ("", "s", "u", "a"):
            options = [(0, "")] if i == len(kinds) and said in ("", "a") else []
            if i < len(kinds):
                initial, gone, cut = kinds[i]
                c, x = table[i + 1, said]
                options.append((3 + c, "D" + x))
                if not gone:
                    if initial == TO[said] or said == "" and initial == "s":
                        c, x = table[i + 1, initial]
                        options.append((cut + c, "K" + x))
                    c, x = table[i + 1, TO[said]]
                    options.append((2 + cut + c, "R" + x))
            own[said] = min(options, default=(10**9, ""))
        for _ in range(3):
            own = {s: min(own[s], (2 + own[TO[s]][0], "I" + own[TO[s]][1])) for s in own}
        table |= {(i, s): v for s, v in own.items()}
    return table[0, ""]


def exhaustive(kinds, most=3):
    """Every string of edits, tried."""
    found = []
    for inserts in itertools.product(range(most), repeat=len(kinds) + 1):
        for edits in itertools.product("DKR", repeat=len(kinds)):
            audit, said, out, cost, ok = "", "", "", 0, True
            for i, n in enumerate(inserts):
                for _ in range(n):
                    said, audit, cost = TO.get(said, "u"), audit + "I", cost + 2
                    out += said
                if i < len(kinds):
                    initial, gone, cut = kinds[i]
                    e = edits[i]
                    audit += e
                    if e == "D":
                        cost += 3
                        continue
                    ok &= not gone
                    said = initial if e == "K" else TO.get(said, "u")
                    out, cost = out + said, cost + cut + 2 * (e == "R")
            if ok and GOOD.match(out):
                found.append((cost, audit))
    return min(found)


def test_the_plain_recursion_equals_every_string_of_edits():
    for _ in range(60):
        kinds = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 3))]
        assert exhaustive(kinds) == cheapest(kinds)


def test_automaton_equals_the_plain_recursion():
    own = turns.Automaton()
    for _ in range(3000):
        kinds = [(rng.choice("suaaux"), rng.random() < 0.1, rng.random() < 0.2) for _ in range(rng.randint(0, 14))]
        code = bytes(turns.MUST_GO if gone else "suax".index(x) + turns.CUT * cut for x, gone, cut in kinds)
        assert own.audit(code) == cheapest(kinds)
    assert len(own.vectors) < 60  # few states occur


def plain(rows):
    """The contract, read plainly."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        own = by[conv]
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        case = zlib.crc32(key.encode()) % 20
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        own += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, kinds, counts = set(), [], collections.Counter()
        for _, role, text in own:
            letters = WORD.findall(text)
            fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        whole = [t for t, *_ in own if t is not None]
        gaps = max(whole) - min(whole) + 1 - len(set(whole)) if whole else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = cheapest(tuple(kinds))
        lines, said, left = [], "", iter(own)
        for e in audit:
            row = next(left) if e != "I" else (None, "", "")
            if e == "D":
                continue
            said = row[1][:1] if e == "K" else TO[said]
            lines.append(f"{row[1] if e == 'K' else {'u': 'user', 'a': 'assistant'}[said]}:{row[2]}")
        assert GOOD.match("".join(x[0] for x in lines))
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def awkward():
    says = ["hello there.", "no end", "what?", "", " \t\n", None, "yes!  \n", "same.", "same.", "é漢.", "..."]
    rows = []
    for conv in range(120):
        for turn in range(rng.choice([0, 1, 2, 5, 9, 30])):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn // 2, -turn * 3]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(says)))
    rows += [(None, t, "user" if t % 2 else "assistant", f"text {t}.") for t in range(400)] + [(7, 3, "user", "long " * 300_000 + ".")] + [(9000 + i, i, "user", "alone.") for i in range(60)]
    rows += rows[:40]
    rng.shuffle(rows)
    return rows


def test_query_on_awkward_rows(spark, tmp_path):
    rows = awkward()
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, head int").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(repr(tuple(r[c] for c in NAMES)) for r in queries.QUERIES["op13_turns"](spark, str(tmp_path)).collect())
    assert got == sorted(map(repr, plain(rows)))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert sorted(map(repr, con.sql(f"select {', '.join(NAMES)} from ({queries.ORACLE_SQL['op13_turns']})").fetchall())) == got


def test_repaired_rows_read_well(spark):
    rows = [(1, 0, "system", "be kind."), (1, 1, "assistant", "hello."), (1, 2, "user", "hi"), (1, 3, "user", "hi"), (2, 0, "user", "only a question?"), (3, 0, "tool", " ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in turns.repaired(df).orderBy("conv_id", "place").collect()]
    for conv in (1, 2, 3):
        assert GOOD.match("".join(r[4][0] for r in got if r[0] == conv))
    assert [r[1:] for r in got if r[0] == 2] == [(0, "K", 0, "user", "only a question?"), (1, "I", None, "assistant", "")]
    audits = {r["conv_id"]: (r["cost"], r["audit"], r["duplicate"]) for r in turns.audits(df).collect()}
    assert audits[2] == (2, "KI", 0) and audits[3] == (3, "D", 0) and audits[1][2] == 1
