from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib
from pathlib import Path

import pytest

from cohortry.llm.conversations import Endings, repaired
from cohortry.llm.queries import queries

FOLDER = "/root/testdata/sf0.01"
SPACE = " \t\n\x0b\x0c\r"


def space(value):
    return " " if value is None else str(value)


def damage(rows):
    """conv_id -> rows after damage, by turn; all conversations are there."""
    found = {}
    for conv, turn, role, text in rows:
        held = found.setdefault(conv, [])
        role, text = space(role), space(text)
        h = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        held += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return {c: sorted(held, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, held in found.items()}


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        found.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows, found):
    """Cost, audit and repaired rows by trying every edit at every place, whole audits compared."""
    legal = lambda out: re.fullmatch("(s?(ua)+)?", out)

    @functools.cache
    def best(k, state, inserts):
        # state: what the roles so far allow; only beginnings of legal orders are followed
        ways = []
        if k == len(rows) and legal(state):
            ways.append((0, "", ()))
        if inserts < 3:
            for name in ("user", "assistant"):
                if after(state, name[0]) is not None:
                    cost, audit, out = best(k, after(state, name[0]), inserts + 1)
                    ways.append((cost + 5, "I" + audit, ((name, ""), *out)))
        if k < len(rows):
            _, role, text = rows[k]
            cost, audit, out = best(k + 1, state, 0)
            ways.append((cost + 2, "D" + audit, out))
            if found[k] not in ("b", "d"):
                for letter, name, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if after(state, name[:1]) is not None:
                        cost, audit, out = best(k + 1, after(state, name[:1]), 0)
                        ways.append((cost + price + 5 * (found[k] == "t"), letter + audit, ((name, text), *out)))
        return min(ways, key=lambda w: w[:2]) if ways else (10**9, "", ())

    def after(state, initial):
        out = state + initial
        if not initial or not re.fullmatch("s|s?(ua)+u?|s?u", out):
            return None
        # what is behind the last pair does not matter any more
        return re.sub("^(s?)(ua)+(?=u)", r"\1ua", out) if len(out) > 4 else out

    return best(0, "", 0)


def brute(rows):
    out = []
    for conv, held in damage(rows).items():
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found = faults(held)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        cost, audit, kept = cheapest(tuple(held), tuple(found))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, found.count("b"), found.count("d"), found.count("t"), illegal, cost, audit, digest))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def run(spark, rows, **options):
    extra = "head string, lost string, ending string, audit string, blank string"
    table = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], f"conv_id long, turn long, role string, text string, {extra}").repartition(3)
    return sorted((tuple(r) for r in repaired(table, **options).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_equal_to_trying_every_edit(spark):
    draw, rows = random.Random(5), []
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "uncle"]
    texts = ["Yes.", "No!", "why? ", "cut off", "", " \t", None, "same.", "same.", "Ünï ...\n"]
    for conv in range(400):
        for turn in range(draw.randint(1, 7)):
            odd = draw.random()
            rows.append((conv, None if odd < 0.05 else turn if odd < 0.9 else turn - 1, draw.choice(roles), draw.choice(texts)))
    rows += [(None, None, None, None), (None, 3, "user", "Hm."), (-5, 9, "user", "Hm."), (-5, 9, "user", "Hm."), (1 << 40, -(1 << 40), "system", "x.")]
    assert run(spark, rows) == brute(rows)


def test_a_long_conversation_and_an_empty_table(spark):
    draw = random.Random(8)
    rows = [(1, t, draw.choice(["user", "assistant", "tool"]), draw.choice(["a.", "b", "", f"{t}."])) for t in range(20_000)]
    (got,) = run(spark, rows)
    held = damage(rows)[1]
    found = faults(held)
    assert got[2:5] == tuple(found.count(x) for x in "bdt")
    # the audit gives a legal order at the cost that is stated
    cost, k, out = 0, 0, []
    for edit in got[7]:
        if edit == "I":
            out.append("user" if not out or out[-1][0] != "u" else "assistant")
            cost += 5
            continue
        role, fault = held[k][1], found[k]
        k += 1
        cost += 2 if edit == "D" else (edit == "R") + 5 * (fault == "t")
        assert edit == "D" or fault not in ("b", "d")
        if edit in "KR":
            out.append(role if edit == "K" else "user" if not out or out[-1][0] != "u" else "assistant")
    assert k == len(held) and cost == got[6] and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in out))
    assert run(spark, []) == []


def test_shared_endings_are_computed_once():
    endings = Endings()
    # words read backwards, sorted: the first twenty rows of the ending are common
    words = sorted("ceg" * 7 + extra for extra in ("a", "ab", "ac", "ad", "z", "zz"))
    results = []
    for word in words:
        endings.move(word)
        results.append(endings.best())
    assert endings.made <= 1 + 21 + sum(len(w) - 21 for w in words)
    for word, result in zip(words, results):
        alone = Endings()
        alone.move(word)
        assert alone.best() == result


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")
def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(tuple(r) for r in queries()["op13_conversation_repair"](spark, FOLDER).collect())
    assert got == brute(rows)
