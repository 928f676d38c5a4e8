"""Conversation repair: the edits against a shortest-path search over whole edit strings, chunks against whole conversations."""

import hashlib
import heapq
import random
import re

import pytest

from spanveil.llm import turn_repair

LEGAL = re.compile(r"(s?(ua)+)?\Z")
SHAPE = "conv_id long, turn long, role string, text string"


def brute(rows):
    """(cost, audit, lines) of the cheapest and then ASCII-least edits, by searching all edit strings in the order of cost."""
    judged, seen = [], set()
    for role, text in rows:
        blank, again = not text.strip(" \t\n\x0b\x0c\r"), (role, text) in seen
        seen.add((role, text))
        judged.append((role, text, blank or again, not blank and not again and text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?"))
    heap, found, limit = [(0, "", 0, ())], [], None
    while heap:
        cost, audit, i, lines = heapq.heappop(heap)
        if limit is not None and cost > limit:
            break
        initials = "".join(line[:1] for line in lines)
        if i == len(judged) and LEGAL.match(initials):
            found.append((audit, lines))
            limit = cost
            continue
        if not any(LEGAL.match(initials + more) for more in ("", "a", "ua", "uaua"[1:])):
            continue
        if len(lines) < len(judged) + 3:
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 3, audit + "I", i, (*lines, role + ":")))
        if i < len(judged):
            role, text, must, cut = judged[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, lines))
            if not must:
                heapq.heappush(heap, (cost + 3 * cut, audit + "K", i + 1, (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", i + 1, (*lines, f"{new}:{text}")))
    audit, lines = min(found)
    return limit, audit, lines


def test_edits_against_all_edit_strings(spark):
    draw = random.Random(5)
    convs = [[(draw.choice(["user", "assistant", "system", "tool", "user"]), draw.choice(["a.", "b.", "c", "d!", " ", "e?"])) for _ in range(draw.randint(1, 5))] for _ in range(60)]
    rows = [(c, t, role, text) for c, conv in enumerate(convs) for t, (role, text) in enumerate(conv)]
    for chunk in (2, 4096):
        got = {r["conv_id"]: r for r in turn_repair.repair(spark.createDataFrame(rows, SHAPE), chunk_rows=chunk).collect()}
        assert len(got) == len(convs)
        for c, conv in enumerate(convs):
            cost, audit, lines = brute(conv)
            assert (got[c]["cost"], got[c]["audit"]) == (cost, audit), conv
            assert got[c]["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("chunk", [1, 3, 7])
def test_chunks_give_what_whole_conversations_give(spark, chunk):
    draw = random.Random(chunk)
    rows = [(c, draw.choice([None, *range(0, 90, 2)]), draw.choice(["user", "assistant", "assistant", "system"]), draw.choice(["x.", "y", "", "z!", f"{draw.random()}."])) for c in (1, 2, None) for _ in range(70)]
    rows += [(4, t, "user", " ") for t in range(40)] + [(4, 99, "user", "end.")]
    df = spark.createDataFrame(rows, SHAPE)
    key = lambda r: str(r["conv_id"])
    assert sorted(turn_repair.repair(df, chunk_rows=chunk).collect(), key=key) == sorted(turn_repair.repair(df).collect(), key=key)


def test_vectors_meet_up_to_a_constant():
    codes = [random.Random(1).choice([1, 2, 3, 2 | 8, 4]) for _ in range(500)]
    ends = {turn_repair._END}
    for _ in range(5):
        ends |= {turn_repair.vectors(codes, e)[1] for e in ends}
    before = turn_repair.vectors(codes, turn_repair._END)
    for end in ends:
        assert turn_repair.rerun(codes, end, before) == turn_repair.vectors(codes, end)


def test_defined_results(spark):
    rows = [(1, 5, "user", "q?"), (1, 5, "user", "q?"), (1, 9, "assistant", None), (1, None, None, "t"), (None, 1, "user", "x."), (2, 1, "user", "gone")]
    df = spark.createDataFrame([(*r, r[0] != 2, 7) for r in rows], SHAPE + ", present boolean, digest int")
    got = {r["conv_id"]: r.asDict() for r in turn_repair.repair(df).collect()}
    assert set(got) == {1, 2, None}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[2] == {"conv_id": 2, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": empty}
    # The null turn comes first; the blank and the repeated row have to go.
    assert (got[1]["gaps"], got[1]["blank"], got[1]["duplicate"], got[1]["truncated"], got[1]["illegal"]) == (3, 1, 1, 1, 2)
    assert (got[1]["cost"], got[1]["audit"]) == (15, "DKDDI")
    assert turn_repair.repair(df.limit(0)).count() == 0


def test_gaps_beyond_a_long_are_null(spark):
    rows = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")]
    assert turn_repair.repair(spark.createDataFrame(rows, SHAPE)).first()["gaps"] is None


def test_damage(spark):
    rows = [(c, t, "assistant", "one. two!") for c in range(40) for t in range(5)]
    got = turn_repair.damage(spark.createDataFrame(rows, SHAPE)).collect()
    kinds = {(r["present"], r["role"], r["text"]) for r in got}
    assert kinds == {(True, "assistant", "one. two!"), (False, "assistant", "one. two!"), (True, "assistant", ""), (True, "assistant", "one two"), (True, "user", "one. two!")}
