"""Repair of conversations against plain search."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import groupby

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeprofile.llm import dialogue, queries

TEXTS = ["", " ", "\n\t", "Yes.", "no", "What?  ", "a b", "Done!\x0b", "x\ny.", " "]


def plain_damage(docs: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in docs:
        role, text = (" " if v is None else v for v in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def faults_of(messages: list[tuple]) -> list[str]:
    seen, out = set(), []
    for role, text in messages:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def plain_repair(messages: list[tuple]) -> tuple[int, str, list[tuple]]:
    """The least (cost, audit) by trying whatever may come next, from the last row on."""
    faults = faults_of(messages)
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    best = {"": (0, "", []), "a": (0, "", []), "u": (5, "I", [("assistant", "")])}
    best["s"] = (10, "II", [("user", ""), ("assistant", "")])
    for (role, text), fault in zip(reversed(messages), reversed(faults)):
        now = {}
        for s in after:
            options = [(2 + best[s][0], "D" + best[s][1], best[s][2])]
            if fault not in ("blank", "duplicate"):
                more, nxt = 5 * (fault == "truncated"), after[s]
                if role[:1] == nxt or (role[:1] == "s" and s == ""):
                    c, a, m = best[role[0]]
                    options.append((c + more, "K" + a, [(role, text), *m]))
                c, a, m = best[nxt]
                options.append((c + more + 1, "R" + a, [(name[nxt], text), *m]))
            now[s] = min(options, key=lambda o: o[:2])
        for _ in range(3):  # inserted rows, one before another
            for s, nxt in after.items():
                c, a, m = now[nxt]
                now[s] = min(now[s], (c + 5, "I" + a, [(name[nxt], ""), *m]), key=lambda o: o[:2])
        best = now
    return best[""]


def plain_report(original: list[tuple], damaged: list[tuple]) -> dict:
    out = {}
    for conv in {d[0] for d in original}:
        own = sorted((d for d in damaged if d[0] == conv), key=lambda d: (d[1] is not None, d[1] or 0, d[2], d[3]))
        messages = [d[2:] for d in own]
        faults = faults_of(messages)
        turns = {d[1] for d in own} - {None}
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(messages, messages[1:])]
        cost, audit, repaired = plain_repair(messages)
        code = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = {
            "conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "repaired_sha256": code,
        }
    return out


def code_of(messages: list[tuple]) -> bytes:
    number = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
    initial = {"s": 0, "u": 1, "a": 2}
    return bytes(initial.get(r[:1], 3) + 4 * number[f] for (r, _), f in zip(messages, faults_of(messages)))


MESSAGES = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "u"]), st.sampled_from(TEXTS)),
                    min_size=1, max_size=12)


@given(st.lists(MESSAGES, min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_blocks_against_plain_search(conversations):
    codes = [code_of(m) for m in conversations]
    audits, last = dialogue.solved(codes, dialogue.ENDS, np.zeros(len(codes), int))
    for m, code, audit, state in zip(conversations, codes, audits, last):
        audit += b"I" * int(dialogue.ENDS[state] // 5)
        assert (dialogue._cost(audit, np.frombuffer(code, np.uint8)), audit.decode()) == plain_repair(m)[:2]


@given(MESSAGES, st.integers(1, 11))
@settings(max_examples=200, deadline=None)
def test_costs_of_halves_add_up(messages, cut):
    code = code_of(messages)
    if cut < len(code):
        first, second = (dialogue.matrices([c])[0] for c in (code[:cut], code[cut:]))
        both = (first[:, :, None] + second[None]).min(axis=1)
        assert (np.minimum(both, dialogue.RESERVED) == dialogue.matrices([code])[0]).all()


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    docs = []
    for conv in [*range(40), None]:
        for turn in range(rng.choice([1, 2, 3, 8])):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            docs.append((conv, turn, "system" if turn == 0 and rng.random() < 0.4 else role, rng.choice(TEXTS) + str(rng.randrange(30)) + rng.choice(["", ".", "?"])))
    docs += [(50, t, ["user", "assistant"][t % 2], "Same words." if t % 3 else f"Line {t}.") for t in range(90)]
    docs += [(51, None, "user", "Hi."), (51, None, None, None), (51, 3, "assistant", None), (51, 3, "assistant", "Yes."),
             (52, 5, "system", "."), (53, 1, "", "x."), (54, 9, "user", "é" * 20_000 + "."), (55, None, "user", "Only.")]
    return docs


@pytest.mark.parametrize("block", [4, 4096])
def test_conversations(spark, monkeypatch, block):
    """Long conversations in many blocks have the results of whole ones."""
    monkeypatch.setattr(dialogue, "BLOCK", block)
    docs = corpus(block)
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(docs, schema).selectExpr("*", "1 as conv", "'x' as block", "2 as rank").repartition(4)
    got = {r["conv_id"]: r for r in rows(dialogue.report(df, dialogue.damaged(df)))}
    assert got == plain_report(docs, plain_damage(docs))


def test_edits_and_their_rows(spark):
    docs = [(1, 1, "assistant", "Hello."), (1, 2, "assistant", "Again."), (1, 3, "user", "cut off")]
    df = spark.createDataFrame(docs, "conv_id long, turn long, role string, text string")
    _, _, log = dialogue.repair(df)
    got = [(r["edit"], r["turn"], r["role"], r["text"]) for r in sorted(rows(log), key=lambda r: r["step"])]
    assert got == [("R", 1, "user", "Hello."), ("K", 2, "assistant", "Again."), ("D", 3, "user", "cut off")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert rows(dialogue.report(df, dialogue.damaged(df))) == []


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: r for r in rows(queries.op13_conversation_repair(spark, sf))}
    assert got == plain_report(docs, plain_damage(docs))


def test_least_paths_end_where_letters_do():
    letters = np.array([[1, 2], [9, 3], [1, 9], [0, 9]])
    targets = np.array([[1, 2], [0, 3], [3, 0], [3, 3]])
    words, last = dialogue.least_paths(letters, targets, np.array([0, 2, 3]))
    assert [[k for k, _ in groupby(w[w > 0].tolist())] for w in words] == [[1, 3], [1], []]
    assert last.tolist() == [3, 3, 3]
