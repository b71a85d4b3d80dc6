"""Repair of conversations: the cheapest edits that give a legal order of roles, over an automaton of shared endings.

A conversation is a word over few signs, one per row: the role's initial and the row's fault. What the rows from some
place on cost depends on that ending and on the state of the role grammar only. So the distinct words are sorted from
their end: neighbours share the nodes of their common ending, and a task keeps no more than the path of the present
word. Each node holds, for each grammar state, the least cost to go and the first edit of the best ending, computed
once; nodes whose sign and whose relative costs agree are the same entry of a table of bounded size. Ranges are cut by
(word read backwards, conversation), so a word that a third of all conversations have is spread over tasks, each of
which computes it once.

1. Damaged rows are sorted within their conversation; one pass gives counts and the word.
2. The words are sorted from the end; the path of nodes gives cost and edits.
3. The edits meet the sorted rows once more and become the hash of the repaired conversation.

Passes 1 and 3 read a conversation's rows as a stream. A conversation, however long, takes one task there (a hash is
computed in order) and about 120 bytes of memory a row, not its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortry.llm.text import private, rows_by
from cohortry.session import written

SPACE = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
NEVER = 1 << 40
LONGEST = (1 << 63) - 1
ROLES = {"u": "user", "a": "assistant"}
#: Grammar (s?(ua)+)?: nothing yet, after s, after u, after a. Only the first and the last may be the end.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = ("u", "u", "a", "u")
#: Signs: initial and fault; those that must go need no initial.
FINE, CUT, GONE = 0, 1, 2
_SIGNS = {chr(97 + 2 * i + fault): (initial, fault) for i, initial in enumerate("suax") for fault in (FINE, CUT)} | {"z": ("x", GONE)}
_SIGN_OF = {sign: letter for letter, sign in _SIGNS.items()}

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", spoil: bool = True) -> DataFrame:
    """conv_id, turn, role, text, lost: rows after the damage that their hash asks for; lost rows stay, marked, without text.

    NULLs count as one space in roles, texts and the hash. Without ``spoil`` nothing is damaged.
    """
    rows = rows_by(conversations, (conv_id, "conv_id"), (turn, "turn"), (role, "role"), (text, "text"))
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), F.concat(space("conv_id"), F.lit(":"), space("turn")).alias("place"))
    if not spoil:
        return rows.select("conv_id", "turn", "role", "text", F.lit(False).alias("lost"))
    harm = F.crc32(F.col("place").cast("binary")) % 20
    text = F.when(harm <= 1, "").when(harm == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(harm == 4, ROLES["u"]).otherwise(F.col("role"))
    again = F.explode(F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (harm == 0).alias("lost"), again.alias("again")).drop("again")


def _sorted(rows: DataFrame, first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col(first), F.asc_nulls_first("turn"), "role", "text")


def _row_sign() -> tuple[Column, Column]:
    """Whether a text is blank, and whether it is cut off: its last character that is no space ends no sentence."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    return bare == "", ~F.substring(bare, -1, 1).isin(".", "!", "?")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one row per conversation: its counts and its word read backwards."""
    present: _Counted | None = None
    done: list[_Counted] = []
    kind = None

    def rows() -> pa.RecordBatch:
        out = [pa.array([c.conv_id for c in done], kind)]
        out += [pa.array([c.counts()[k] for c in done], pa.int64()) for k in range(5)]
        out.append(pa.array(["".join(reversed(c.word)) for c in done], pa.string()))
        done.clear()
        return pa.RecordBatch.from_arrays(out, ["conv_id", *COUNTS, "ending"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv_id, turn, initial, blank, cut, lost, digest in zip(*(c.to_pylist() for c in batch.columns)):
            if present is None or conv_id != present.conv_id:
                if present is not None:
                    done.append(present)
                    if len(done) >= 1000:
                        yield rows()
                present = _Counted(conv_id)
            if not lost:
                present.add(turn, initial, blank, cut, digest)
    if present is not None:
        done.append(present)
        yield rows()


class _Counted:
    """What one pass over a conversation's rows, sorted by turn, counts."""

    def __init__(self, conv_id):
        self.conv_id, self.word, self.seen, self.before = conv_id, [], set(), None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None

    def add(self, turn, initial: str, blank: bool, cut: bool, digest: bytes) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        again = digest in self.seen
        self.seen.add(digest)
        fault = GONE if blank or again else CUT if cut else FINE
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += fault == CUT
        self.word.append("z" if fault == GONE else _SIGN_OF[initial if initial in ("s", "u", "a") else "x", fault])

    def counts(self) -> tuple[int, ...]:
        gaps = min(LONGEST, self.last - self.first + 1 - self.turns) if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


@cache
def _node(sign: str, below: tuple[int, ...]) -> tuple[int, tuple[int, ...], str]:
    """A row before an ending: by how much the least cost rises, the costs of the four states above it, the first edits.

    ``below`` are the ending's costs above its least one, "" as sign stands for the end itself, "." for no edit. Of edits
    with the same cost the first in ASCII wins; as they differ in their letter, no further letters need to be compared.
    """
    ways: list[list[tuple[int, str]]] = []
    for state in range(4):
        if not sign:
            ways.append([(0, ".")] if state in (0, 3) else [])
            continue
        initial, fault = _SIGNS[sign]
        found = [(DELETE + below[state], "D")]
        if fault != GONE:
            more = TRUNCATED if fault == CUT else 0
            found.append((REROLE + more + below[NEXT[state, WANTED[state]]], "R"))
            if (state, initial) in NEXT:
                found.append((more + below[NEXT[state, initial]], "K"))
        ways.append(found)
    costs = [min((c for c, _ in w), default=NEVER) for w in ways]
    for _ in range(4):  # an insertion leads to another state, at most two in a row are of use
        costs = [min(c, INSERT + costs[NEXT[s, WANTED[s]]]) for s, c in enumerate(costs)]
    edits = "".join(min([*w, (INSERT + costs[NEXT[s, WANTED[s]]], "I")])[1] for s, w in enumerate(ways))
    least = min(costs)
    return least, tuple(c - least for c in costs), edits


class Endings:
    """The path of automaton nodes of the present word, from the end; a word read backwards extends a shared part of it."""

    def __init__(self):
        rise, costs, edits = _node("", (0, 0, 0, 0))
        self.word = ""
        self.path = [(rise, costs, edits)]
        self.made = 1

    def move(self, ending: str) -> None:
        shared = _common(self.word, ending)
        del self.path[shared + 1 :]
        for sign in ending[shared:]:
            total, costs, _ = self.path[-1]
            rise, costs, edits = _node(sign, costs)
            self.path.append((total + rise, costs, edits))
            self.made += 1
        self.word = ending

    def best(self) -> tuple[int, str]:
        """Least cost of the whole word, and its edits from the first row on."""
        total, costs, _ = self.path[-1]
        state, at, audit = 0, len(self.path) - 1, []
        cost = total + costs[0]
        while True:
            edit = self.path[at][2][state]
            if edit == ".":
                return cost, "".join(audit)
            audit.append(edit)
            if edit == "D":
                at -= 1
            else:
                initial = _SIGNS[self.word[at - 1]][0] if edit == "K" else WANTED[state]
                at -= edit != "I"
                state = NEXT[state, initial]


def _common(a: str, b: str) -> int:
    """How many letters two words begin with in common."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    endings, best = Endings(), (0, "")
    for batch in batches:
        costs, audits = [], []
        for ending in batch.column(batch.schema.get_field_index("ending")).to_pylist():
            if ending != endings.word:
                endings.move(ending)
                best = endings.best()
            costs.append(best[0])
            audits.append(best[1])
        kept = [batch.column(k) for k in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(costs, pa.int64()), pa.array(audits, pa.string())], [*batch.schema.names[:-1], "cost", "audit"])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's result first, then its rows in order; the rows become a hash as they pass."""
    names = ["conv_id", *COUNTS, "cost", "audit", "repaired_sha256"]
    kinds = None
    present: _Repair | None = None
    done: list[tuple] = []

    def rows() -> pa.RecordBatch:
        columns = list(zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*kinds, pa.string()])], names)

    for batch in batches:
        kinds = kinds or [batch.schema.field(n).type for n in names[:-1]]
        columns = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
        result = [columns[n] for n in names[:-1]]
        for k, (head, lost, role, text) in enumerate(zip(*(columns[n] for n in ("head", "lost", "role", "text")))):
            if head:
                if present is not None:
                    done.append(present.end())
                    if len(done) >= 1000:
                        yield rows()
                present = _Repair(tuple(c[k] for c in result))
            elif not lost:
                present.add(role, text)
    if present is not None:
        done.append(present.end())
        yield rows()


class _Repair:
    """Applies edits to rows as they come."""

    def __init__(self, result: tuple):
        self.result, self.audit, self.at, self.state = result, result[-1], 0, 0
        self.hash, self.any = hashlib.sha256(), False

    def _write(self, initial: str, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any, self.state = True, NEXT[self.state, initial]

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._write(WANTED[self.state], ROLES[WANTED[self.state]], "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._write(role[:1], role, text)
        elif edit == "R":
            self._write(WANTED[self.state], ROLES[WANTED[self.state]], text)

    def end(self) -> tuple:
        self._insert()
        return (*self.result, self.hash.hexdigest())


def repaired(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", spoil: bool = True) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation.

    Rows are damaged first if ``spoil``, then taken by turn (NULL first), role and text, so that equal rows are
    interchangeable and rows of one turn have a defined order. A NULL conv_id is a conversation of its own. A NULL role or
    text is one space; roles other than s..., u..., a... can only be given another role or deleted. Conversations without rows left have zeros, no
    audit and the hash of nothing. An empty table gives no rows. Extra columns are not looked at.
    """
    rows = damaged(conversations, conv_id, turn, role, text, spoil)
    kind = rows.schema["conv_id"].dataType.simpleString()
    blank, cut = _row_sign()
    digest = F.unhex(F.md5(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text").cast("binary")))
    signs = _sorted(rows, "turn").select("conv_id", F.col("turn").try_cast("long").alias("turn"), F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), cut.alias("cut"), "lost", digest.alias("digest"))
    counts = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS)
    words = written(signs.mapInArrow(_words, f"{counts}, ending string"), "conversation-words")
    # equal words lie together, but those of many conversations may be cut into several ranges
    ranges = words.repartitionByRange("ending", "conv_id").sortWithinPartitions("ending")
    audits = ranges.mapInArrow(_audited, f"{counts}, cost long, audit string")
    (head,) = private("head")
    both = audits.withColumn(head, F.lit(0)).unionByName(rows.withColumn(head, F.lit(1)), allowMissingColumns=True)
    ordered = _sorted(both, head).select("conv_id", *COUNTS, "cost", "audit", (F.col(head) == 0).alias("head"), "lost", "role", "text")
    return ordered.mapInArrow(_repaired, f"{counts}, cost long, audit string, repaired_sha256 string")
