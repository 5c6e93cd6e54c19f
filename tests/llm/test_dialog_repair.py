"""Repair of conversations against a search over whole edit sequences."""

import hashlib
import random
import re
import zlib

import pytest

from docloom.llm import dialog_repair, queries

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit) of the cheapest edits, by trying every edit at every place; what may follow is remembered by place and roles so far."""
    faults = faults_of(rows)
    known = {}

    def legal_so_far(roles):
        return re.fullmatch(r"s|s?(ua)*u?", roles) is not None

    def tail(i, roles, inserted):
        """What may follow depends on the last letter of the roles alone."""
        key = (i, roles[-1:], inserted)
        if key not in known:
            options = [(0, "")] if i == len(rows) and (roles == "" or roles[-1] == "a") else []
            moves = []
            if inserted < 2:
                moves += [("I", 3, i, roles + x, inserted + 1) for x in "ua"]
            if i < len(rows):
                moves.append(("D", 4, i + 1, roles, 0))
                if faults[i] in ("", "truncated"):
                    more = 3 if faults[i] else 0
                    moves.append(("K", more, i + 1, roles + (rows[i][0][:1] or "-"), 0))
                    moves += [("R", 3 + more, i + 1, roles + x, 0) for x in "ua"]
            for letter, cost, at, after, n in moves:
                if after == roles or legal_so_far(after):
                    rest = tail(at, {"": "", "s": "s", "u": "u", "a": "ua"}[after[-1:]], n)
                    if rest is not None:
                        options.append((cost + rest[0], letter + rest[1]))
            known[key] = min(options, default=None)
        return known[key]

    return tail(0, "", 0)


def told(rows, audit):
    """The repaired text that an audit stands for, and whether its roles are legal."""
    out, at = [], 0
    for letter in audit:
        state = out[-1][0][:1] if out else ""
        due = "assistant" if state == "u" else "user"
        if letter == "I":
            out.append((due, ""))
            continue
        if letter in "KR":
            out.append((rows[at][0] if letter == "K" else due, rows[at][1]))
        at += 1
    assert at == len(rows) and LEGAL.fullmatch("".join(r[:1] for r, _ in out))
    return "\n".join(f"{r}:{t}" for r, t in out)


def check(got, rows):
    faults = faults_of(rows)
    cost, audit = cheapest(rows)
    assert (got.cost, got.audit) == (cost, audit), (rows, got, cost, audit)
    assert got.repaired_sha256 == hashlib.sha256(told(rows, audit).encode()).hexdigest()
    assert [got.blank, got.duplicate, got.truncated] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    initials = [r[:1] for r, _ in rows]
    assert got.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def made(rng, n):
    texts = ["One.", "Two!", "three", "", " ", "Four? ", "Five", "Six."]
    return [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), rng.choice(texts) + rng.choice(["", "", f"{rng.randrange(50)}."])) for _ in range(n)]


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_repairs_equal_a_search_over_all_edits_whatever_the_chunks(spark, bits):
    rng = random.Random(bits)
    talks = {i: made(rng, rng.randrange(1, 14)) for i in range(60)}
    talks[60] = [("system", f"All the same role {i}.") for i in range(40)]
    talks[61] = [("user", "Once.")] + [("user", "Once.")] * 50 + [("assistant", "Never mind.")]
    talks[62] = [("user", ""), ("user", " "), ("user", "What?"), ("user", ""), ("user", "")]
    rows = [(c, t, r, x) for c, talk in talks.items() for t, (r, x) in enumerate(talk)]
    rng.shuffle(rows)
    log = dialog_repair.repair(spark.createDataFrame(rows, SCHEMA), bits).persist()
    got = {r.conv_id: r for r in dialog_repair.audit(log).collect()}
    for c, talk in talks.items():
        check(got[c], talk)
    # the log itself holds the repaired rows
    for c in (0, 5, 61, 62):
        kept = [(r.new_role, r.text) for r in sorted(log.where(f"conv_id = {c}").collect(), key=lambda r: (r.place, r.step)) if r.edit != "D"]
        assert "\n".join(f"{a}:{b}" for a, b in kept) == told(talks[c], got[c].audit)
    log.unpersist()


def test_passes_rerun_only_chunks_whose_guess_was_wrong():
    """From any guessed vector the recursion comes to the true one, up to a constant, within a few ordinary rows."""
    ordinary = "".join(m for m, s in dialog_repair._MARKS.items() if s in (("u", ""), ("a", "")))
    true, _ = dialog_repair.backward(ordinary * 3, dialog_repair._END)
    for guess in [(0, 3, 3, 0), (2, 0, 0, 3), (3, 3, 0, 3), (5, 1, 0, 2)]:
        assert dialog_repair.backward(ordinary * 3, guess)[0] == true


def test_edges_of_repair(spark):
    rows = [(None, None, None, None), (None, None, "user", "Hi."), (1, None, "user", "A."), (1, 4, "assistant", "B."), (1, 2, None, "x"), (2, 7, "user", None), (3, 1, "user", "Long. " * 50_000)]
    rows += [(4, 1, "user", "Same."), (4, 1, "user", "Same."), (4, 1, "assistant", "Other.")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS place", "2 AS cost")
    got = {r.conv_id: r for r in dialog_repair.audit(dialog_repair.repair(frame)).collect()}
    check(got[None], [(" ", " "), ("user", "Hi.")])
    check(got[1], [("user", "A."), (" ", "x"), ("assistant", "B.")])
    check(got[2], [("user", " ")])
    check(got[3], [("user", "Long. " * 50_000)])
    check(got[4], [("assistant", "Other."), ("user", "Same."), ("user", "Same.")])
    empty = frame.where("false")
    assert dialog_repair.audit(dialog_repair.repair(empty)).count() == 0
    assert {r.conv_id: r.gaps for r in dialog_repair.gaps(frame).collect()} == {None: 0, 1: 1, 2: 0, 3: 0, 4: 0}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def test_query_over_all_conversations(spark, sf_dir):
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: r for r in queries.op11_conversation_repair(spark, sf_dir).collect()}
    assert set(got) == {r[0] for r in given}
    for conv, g in got.items():
        rows = sorted([r for r in damaged(given) if r[0] == conv], key=lambda r: r[1])
        if not rows:
            assert tuple(g)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
            continue
        check(g, [(r[2], r[3]) for r in rows])
        turns = [r[1] for r in rows]
        assert g.gaps == max(turns) - min(turns) + 1 - len(set(turns))
