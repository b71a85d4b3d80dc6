"""Small odd tables: NULLs, empty and long texts, copies, repeated rows, and columns whose names the operators use."""

from __future__ import annotations

import random

SPACES = " \t\n\x0b\x0c\r"
CLASHING = "id doc version token node pos words first digest component size bucket tokens domain n signature block copies role kept left_ a b".split()
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak near the quiet river bank at night"
LINE = "This very same line of more than forty code points stands in many documents."


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def texts() -> list[tuple[int | None, str | None]]:
    draw = random.Random(4)
    near = BASE.split()
    rows: list[tuple[int | None, str | None]] = [
        (1, BASE), (2, BASE + " "), (3, BASE.upper()), (4, None), (5, ""), (6, SPACES), (7, "one"), (8, "one two"), (9, "One  two"),
        (10, "x" * 5000), (11, " ".join(draw.choice(near) for _ in range(6000))), (12, "Ünïcode ÀÉ straße 世界 <|endoftext|> it's 12"),
        (13, BASE), (13, BASE), (14, "tie tie tie"), (14, "another text of the same id"), (None, BASE), (None, None), (-3, BASE + "\n"), (1 << 40, "tie\ttie tie"),
    ]
    for i in range(100, 140):
        changed = list(near)
        changed[draw.randrange(len(near))] = f"word{i}"
        rows.append((i, " ".join(changed)))
    for i in range(200, 212):
        rows.append((i, f"{LINE}\nonly here {i}\n  {LINE.lower()}\t\n\nshort\nshort"))
    return rows


def documents(spark, rows=None):
    extra = ", ".join(f"{name} string" for name in CLASHING)
    rows = texts() if rows is None else rows
    whole = [(i, t, [None, "en", "de"][k % 3], [None, "src0", "src3", "src12", "src0"][k % 5], None if t is None else len(t), *["x"] * len(CLASHING)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(whole, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3)
