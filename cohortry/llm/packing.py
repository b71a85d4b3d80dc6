"""Packing token pieces into fixed-length sequences by cutting-stock column generation.

1. Every text is tokenised once; a document is cut behind every ``capacity`` tokens, so that only its last piece is
   shorter, and the pieces (lengths and checksums, not tokens) are stored in the shared folder.
2. The histogram of piece lengths has at most ``capacity`` rows whatever the corpus. Lengths are rounded up to a few
   hundred classes, and a linear program over patterns (how many of each class fill a sequence) is solved by revised
   simplex, which starts from the patterns of a greedy best-subset-sum filling; an unbounded knapsack over the dual
   prices yields further patterns. Patterns are rounded down, and what is left is filled greedily.
3. Pieces are ranked within their class (in salted buckets, so that one hot length is many small windows), and the n-th
   piece of a class takes the n-th place that the patterns have for it.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohortry.llm.text import pieces, rows_by, slices, span_hashes, spans
from cohortry.llm.token_counts import NO_RANK, Merges, byte_names
from cohortry.session import written

BUCKET_ROWS = 20_000
MOST_WORDS = 1_000_000
RANKS = 1 << 48


FULL_STOP, COMMA, OPEN, BAR = b".,<|"


def _cut_marks(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with a mark behind a letter A-Z at their end become two: it is a token of its own wherever the letters are one."""
    last, other = letters[ends - 1], letters[np.maximum(ends - 2, 0)] | 32
    cut = (ends - starts > 1) & ((last == FULL_STOP) | (last == COMMA)) & (other >= 97) & (other <= 122)
    mark = (np.cumsum(1 + cut) - 1)[cut]
    starts, ends = np.repeat(starts, 1 + cut), np.repeat(ends, 1 + cut)
    starts[mark] = ends[mark] - 1
    ends[mark - 1] -= 1
    return starts, ends


class WordMerges(Merges):
    """Ids of words of small letters by rank-synchronous merging; the last letter of a word has a symbol of its own."""

    def __init__(self, definition: str):
        spec = json.loads(definition)["model"]
        ids, names, ending = spec["vocab"], byte_names(), spec["end_of_word_suffix"]
        self.symbol = np.array([ids[names[b]] for b in range(256)], np.int64)
        self.ending = np.array([ids[names[b] + ending] for b in range(256)], np.int64)
        self.width = max(ids.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
        self._index(np.array([ids[a] * self.width + ids[b] for a, b in pairs], np.int64))
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)

    def ids(self, letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, word by word, and how many each word has. ``letters`` are the bytes of all words, none of them empty."""
        symbols, of = self.symbol[letters], np.repeat(np.arange(len(sizes)), sizes)
        last = np.cumsum(sizes) - 1
        symbols[last] = self.ending[letters[last]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            rank = np.full(len(symbols), NO_RANK, np.int32)
            inner = np.flatnonzero(of[:-1] == of[1:])
            rank[inner] = self.rank(symbols[inner] * self.width + symbols[inner + 1])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(of))))
            live = least < NO_RANK
            done.append((of[~live], symbols[~live]))
            where = np.flatnonzero((rank == least) & live)
            # in a run of overlapping pairs (the same symbol again and again) every second one is merged
            follows = np.diff(where, prepend=-2) == 1
            if follows.any():
                begins = np.flatnonzero(~follows)
                run = np.arange(len(where)) - np.repeat(begins, np.diff(np.append(begins, len(where))))
                where = where[run % 2 == 0]
            symbols[where] = self.made[rank[where]]
            live[where + 1] = False
            symbols, of = symbols[live], of[live]
        of = np.concatenate([o for o, _ in done]) if done else np.zeros(0, np.int64)
        found = np.concatenate([x for _, x in done]) if done else np.zeros(0, np.int64)
        return found[np.argsort(of, kind="stable")].astype(np.uint32), np.bincount(of, minlength=len(sizes))


def _small_letters(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether ranges consist of a-z, A-Z and U+00DF to U+00FF but U+00F7: letters that lower-casing A-Z leaves as they are."""
    small = letters | 32
    good = (small >= 97) & (small <= 122) & (letters < 128)
    second = np.flatnonzero((letters[:-1] == 0xC3) & (letters[1:] >= 0x9F) & (letters[1:] <= 0xBF) & (letters[1:] != 0xB7))
    good[second] = good[second + 1] = True
    running = np.concatenate([[0], np.cumsum(good)])
    return running[ends] - running[starts] == ends - starts


class Encoder:
    """Ids of words by their 64-bit hashes, for the words met lately; new ones are merged together, or by the library.

    The vocabulary must lower-case, drop white space and cut letters from marks before anything else: then words can be
    encoded alone, whatever their case. Words with the beginning of a special string keep case and marks. The ids of all
    held words lie in one array; of more than ``most_words`` those not met since the last time are dropped.
    """

    def __init__(self, definition: str, most_words: int = MOST_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer, self.merges, self.most_words = Tokenizer.from_str(definition), WordMerges(definition), most_words
        self.words, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.first, self.size, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _library(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found: list[list[int]] = []
        for at in range(0, len(texts), 4096):
            part = [w.decode("utf-8", "replace") for w in texts[at : at + 4096]]
            found += [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def _learn(self, words: np.ndarray, ids: np.ndarray, size: np.ndarray, needed: np.ndarray) -> None:
        """Adds words with their ids; ``needed`` are places of held ones that must stay."""
        if len(self.words) + len(words) > self.most_words:
            self.met[needed] = True
            kept = np.flatnonzero(self.met)
            kept = kept if len(kept) + len(words) <= self.most_words else needed
            self.ids = self.ids[_ranges(self.first[kept], self.size[kept])]
            self.words, self.size = self.words[kept], self.size[kept]
            self.first, self.met = np.cumsum(self.size) - self.size, np.zeros(len(kept), bool)
        at = np.searchsorted(self.words, words)
        self.words, self.met = np.insert(self.words, at, words), np.insert(self.met, at, False)
        self.first = np.insert(self.first, at, len(self.ids) + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.ids = np.concatenate([self.ids, ids])

    def _places(self, words: np.ndarray) -> np.ndarray:
        """Where words lie among those held, -1: nowhere."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text by text, and how many each text has."""
        counts, flat = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint32)]
        for group in pieces(texts):
            buffer = b"\n".join(part for _, part in group) + b"\n"
            letters, starts, ends = spans(buffer)
            if not len(starts):
                continue
            opens = np.flatnonzero((letters[:-1] == OPEN) & (letters[1:] == BAR)) if b"<|" in buffer else np.zeros(0, np.int64)
            special = np.unique(np.searchsorted(starts, opens, "right") - 1)
            own = starts[special], ends[special]
            starts, ends = _cut_marks(letters, np.delete(starts, special), np.delete(ends, special))
            words = span_hashes(letters, starts, ends)
            if len(special):
                starts, ends = np.concatenate([starts, own[0]]), np.concatenate([ends, own[1]])
                apart = [blake2b(buffer[a:b], digest_size=8).digest() for a, b in zip(*own)]
                order = np.argsort(starts, kind="stable")
                words = np.concatenate([words, np.frombuffer(b"".join(apart), "<u8")])[order]
                special = np.flatnonzero(order >= len(order) - len(special))
                starts, ends = starts[order], ends[order]
            distinct, example, which = np.unique(words, return_index=True, return_inverse=True)
            new = np.flatnonzero(self._places(distinct) < 0)
            if len(new):
                at = example[new]
                plain = _small_letters(letters, starts[at], ends[at])
                for own, of_letters in ((new[plain], True), (new[~plain], False)):
                    if not len(own):
                        continue
                    begin, end = starts[example[own]], ends[example[own]]
                    if of_letters:
                        found = letters[_ranges(begin, end - begin)]
                        ids, size = self.merges.ids(np.where(found < 128, found | 32, found), end - begin)
                    else:
                        kept_case = np.isin(example[own], special).tolist()
                        ids, size = self._library([buffer[a:b] if k else buffer[a:b].lower() for a, b, k in zip(begin.tolist(), end.tolist(), kept_case)])
                    place = self._places(distinct)
                    self._learn(distinct[own], ids, size, place[place >= 0])
            place = self._places(distinct)
            self.met[place] = True
            place = place[which]
            size = self.size[place]
            flat.append(self.ids[_ranges(self.first[place], size)])
            owner = np.searchsorted(np.cumsum([len(part) + 1 for _, part in group]), starts, "right")
            np.add.at(counts, [i for i, _ in group], np.bincount(owner, size, len(group)).astype(np.int64))
        return np.concatenate(flat), counts


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


@cache
def _encoder(definition: str) -> Encoder:
    return Encoder(definition)


def token_pieces(documents: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: every document with its end token, cut behind each ``capacity`` tokens."""
    with open(vocabulary, encoding="utf-8") as file:
        definition = documents.sparkSession.sparkContext.broadcast(file.read())
    rows = rows_by(documents, (doc_id, "doc_id"), (text, "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition.value)
        for part, texts in slices(batches, "text"):
            ids, counts = encoder.encode(texts)
            ends = np.cumsum(counts)
            whole = memoryview(np.insert(ids, ends, end_id).astype("<u4").tobytes())
            total = counts + 1
            begin = ends + np.arange(len(ends)) - counts
            each = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), each)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)) * capacity
            length = np.minimum(total[row] - start, capacity)
            at = 4 * (begin[row] + start)
            crc = [zlib.crc32(whole[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total[row]))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return rows.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def class_step(length: int, capacity: int) -> int:
    """Lengths up to a thirty-second of the capacity are exact; longer ones are rounded up by 1 to 6 % at most."""
    step = 1
    while length > capacity // 32 * step and step < 8:
        step *= 2
    return step


def classes(capacity: int) -> np.ndarray:
    """The class (a length, not below its own) of every length from 0 to ``capacity``."""
    return np.array([min(capacity, -(-n // s) * s) for n in range(capacity + 1) for s in [class_step(n, capacity)]])


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each capacity, and the item that it takes last (-1: none). ``sizes`` ascend."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = int(np.searchsorted(sizes, c, "right"))
        if k:
            value = prices[:k] + best[c - sizes[:k]]
            i = int(value.argmax())
            if value[i] > best[c]:
                best[c], taken[c] = value[i], i
    return best, taken


def _traced(taken: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    pattern = np.zeros(len(sizes), np.int64)
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= sizes[taken[room]]
    return pattern


def column_generation(
    sizes: np.ndarray, demand: np.ndarray, capacity: int, known: np.ndarray, gap: float = 5e-4, rounds: int = 40
) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used (fractional) so that all demand is met exactly.

    Revised simplex over the known patterns and those that the knapsack adds. Stops when the sequences used are within one or
    ``gap`` of the pieces' volume, when the knapsack's value, which bounds what can still be gained, says the same, or
    after ``rounds`` pricings: any basis on the way is a valid plan.
    """
    volume = float(sizes @ demand) / capacity
    enough = max(volume * (1 + gap), volume + 1)
    m = len(sizes)
    patterns = np.diag(capacity // sizes)
    inverse = np.diag(1.0 / (capacity // sizes))
    used = inverse @ demand
    pool = known.astype(float)
    for _ in range(rounds):
        for _ in range(30 * m):
            prices = inverse.sum(axis=0)
            values = pool @ prices
            entering = int(values.argmax())
            if values[entering] <= 1 + 1e-7 or used.sum() <= enough:
                break
            way = inverse @ pool[entering]
            rows = np.flatnonzero(way > 1e-9)
            out = rows[np.argmin(used[rows] / way[rows])]
            step = max(0.0, used[out] / way[out])
            used = np.maximum(used - step * way, 0)
            used[out] = step
            row = inverse[out] / way[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
            patterns[out] = pool[entering]
        if used.sum() <= enough:
            break
        live = np.flatnonzero(prices > 1e-12)
        best, taken = knapsack(sizes[live], prices[live], capacity)
        if best[capacity] <= 1 + gap:
            break
        fresh = np.zeros((len(live) + 1, m))
        for i in range(len(live)):
            fresh[i, live] = _traced(taken, sizes[live], capacity - sizes[live[i]])
            fresh[i, live[i]] += 1
        fresh[-1, live] = _traced(taken, sizes[live], capacity)
        pool = np.unique(np.concatenate([pool, fresh[fresh @ prices > 1 + gap]]), axis=0)
    return patterns, used


def _best_fill(sizes: list[int], left: np.ndarray, room: int) -> np.ndarray:
    """Of what is left, the largest class and then the subset that fills the sequence best."""
    pattern = np.zeros(len(sizes), np.int64)
    first = int(np.flatnonzero(left)[-1])
    pattern[first] = 1
    room -= sizes[first]
    reach, steps = 1, []
    for i in reversed(range(len(sizes))):
        count, k = int(min(left[i] - pattern[i], room // sizes[i])), 1
        while count > 0 and not reach >> room & 1:
            k = min(k, count)
            steps.append((i, k, reach))
            reach |= reach << k * sizes[i]
            count -= k
            k *= 2
    at = (reach & ((1 << room + 1) - 1)).bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            pattern[i] += k
            at -= k * sizes[i]
    return pattern


def _filled(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns, each repeated while it lasts, until nothing is left."""
    plan, left = [], demand.copy()
    while left.any():
        pattern = _best_fill(sizes.tolist(), left, capacity)
        held = pattern > 0
        times = int((left[held] // pattern[held]).min())
        plan.append((pattern, times))
        left -= times * pattern
    return plan


def sequence_plan(counts: dict[int, int], capacity: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places for pieces: key (class * RANKS + rank of the first piece), first sequence, position; for any counts by class.

    The next ranks take the same position in the next sequences.
    """
    sizes = np.array(sorted(s for s, n in counts.items() if n and s < capacity), np.int64)
    demand = np.array([counts[s] for s in sizes], np.int64)
    plan: list[tuple[np.ndarray, int]] = []
    if len(sizes):
        known = np.array([pattern for pattern, _ in _filled(sizes, demand, capacity)])
        left = demand.copy()
        for pattern, used in zip(*column_generation(sizes, demand.astype(float), capacity, known)):
            held = pattern > 0
            times = min(int(used + 1e-6), int((left[held] // pattern[held]).min()))
            if times > 0:
                plan.append((pattern, times))
                left -= times * pattern
        plan += _filled(sizes, left, capacity)
    keys, sequences, positions = [], [], []
    rank, sequence = dict.fromkeys(sizes.tolist(), 0), 0
    for pattern, times in plan:
        position = 0
        for i in np.flatnonzero(pattern)[::-1]:
            size = int(sizes[i])
            for _ in range(int(pattern[i])):
                keys.append(size * RANKS + rank[size])
                sequences.append(sequence)
                positions.append(position)
                rank[size] += times
                position += 1
        sequence += times
    if counts.get(capacity):
        keys.append(capacity * RANKS)
        sequences.append(sequence)
        positions.append(0)
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return tuple(np.array(x, np.int64)[order] for x in (keys, sequences, positions))


def packed(documents: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    NULL and empty texts are one piece, the end token. Rows that repeat an id are documents of their own. Texts of any
    length are cut into as many full pieces as they need. An empty table gives no rows.
    """
    spark = documents.sparkSession
    pieces = written(token_pieces(documents, vocabulary, doc_id, text, capacity, end_id), "pieces")
    sizes = F.array(*(F.lit(int(x)) for x in classes(capacity)))
    pieces = pieces.withColumn("size", F.element_at(sizes, (F.col("length") + 1).cast("int")))
    histogram = pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sum(r.n for r in histogram)
    plan = spark.sparkContext.broadcast(sequence_plan({r["size"]: r.n for r in histogram}, capacity))

    buckets = -(-rows // BUCKET_ROWS) or 1
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    own = Window.partitionBy("size", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("own_rank", F.row_number().over(own) - 1)
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    first = first.select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    ranked = ranked.join(first, ["size", "bucket"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("size") * F.lit(RANKS) + F.col("first_rank") + F.col("own_rank")).alias("place")
    )
    kind = pieces.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "position"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequences, positions = plan.value
        for batch in batches:
            if batch.num_rows:
                key = batch.column(5).to_numpy()
                at = np.searchsorted(keys, key, "right") - 1
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequences[at] + key - keys[at]), pa.array(positions[at])], names)

    placed = ranked.mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, position long")
    earlier = Window.partitionBy("sequence_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")).drop("position")
