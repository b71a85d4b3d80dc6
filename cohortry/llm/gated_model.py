"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, whole-document scores.

Symbols are numbered by falling count; classes are runs of that order with about the same count each, so that a symbol's
probability costs one softmax over the classes and one over a class's symbols. The large classes of rare symbols are cut
into shelves, whose number and size grow with the root of the class: one softmax over its shelves and one over a shelf.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NAMES = ("inputs", "recurrent", "to_class", "class_bias", "to_shelf", "shelf_bias", "to_symbol", "symbol_bias")
SHELVED_FROM = 256
SHELF_ROWS = 1 << 13
#: So many logits are held at a time: they stay in a core's cache.
LOGITS = 1 << 15


def class_bounds(counts: np.ndarray, classes: int) -> np.ndarray:
    """First symbol of every class, and the end."""
    share = np.cumsum(counts) / counts.sum()
    cuts = np.searchsorted(share, np.arange(1, classes) / classes) + 1
    return np.unique(np.concatenate([[0], cuts, [len(counts)]]).clip(0, len(counts)))


def shelf_bounds(bounds: np.ndarray, least: int) -> np.ndarray:
    """First symbol of every shelf, and the end. Classes of fewer than ``least`` symbols are one shelf."""
    sizes = np.diff(bounds)
    step = np.where(sizes < least, sizes, np.ceil(np.sqrt(sizes) / 6).astype(np.int64))
    return np.concatenate([*(np.arange(a, a + n, d) for a, n, d in zip(bounds[:-1], sizes, step)), bounds[-1:]])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Uses up ``x``. Far below 0 the exponential is infinite, and the result 0: callers let that pass."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _softmax(logits: np.ndarray, bias: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of place ``at`` in every column and, if ``n`` is not 0, the gradient of the mean loss of n by logit. Uses up ``logits``.

    A column for each row of the text: maxima and sums then run along memory.
    """
    columns = np.arange(len(at))
    logits += bias[:, None]
    logits -= logits.max(axis=0)
    found = logits[at, columns]
    np.exp(logits, out=logits)
    total = logits.sum(axis=0)
    found -= np.log(total)
    if n:
        logits *= 1 / (total * np.float32(n))
        logits[at, columns] -= np.float32(1 / n)
    return logits, found


def _beside(weights: np.ndarray, column: np.ndarray | float) -> np.ndarray:
    found = np.empty((len(weights), weights.shape[1] + 1), np.float32)
    found[:, :-1], found[:, -1] = weights, column
    return found


def _columns(rows: int, n: int) -> np.ndarray:
    """Zeros; rows that lie a power of two apart would meet in few places of the cache."""
    return np.zeros((rows, n + 24), np.float32)[:, :n]


def _put(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``table[rows] = values``, a row as one item."""
    if table.ndim == 1:
        table[rows] = values
    elif len(rows):
        item = f"V{table.itemsize * table.shape[1]}"
        np.put(table.view(item)[:, 0], rows, np.ascontiguousarray(values, table.dtype).view(item)[:, 0])


def _order(keys: np.ndarray, most: int) -> np.ndarray:
    """What ``np.argsort`` finds for whole numbers below ``most``, equal ones in the order they come: by 16 bits at a time, which are not compared."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    for shift in range(16, most.bit_length(), 16):
        order = order[np.argsort((keys >> shift).astype(np.uint16)[order], kind="stable")]
    return order


def _sums(values: np.ndarray, edges: np.ndarray, few: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the runs of rows that begin at ``edges``, short runs first, and which run each is: quicker than ``np.add.reduceat`` for short runs."""
    sizes = np.diff(edges, append=len(values))
    # by falling size, so that those that go on come first; behind them the long ones
    order = _order(np.where(sizes > few, few, few - sizes), few + 1)
    begin, size = edges[order], sizes[order]
    short = np.bincount(np.minimum(size, few + 1), minlength=few + 2)[: few + 1]
    found = values.take(begin, axis=0)
    for k in range(1, few):
        if more := int(short[k + 1 :].sum()):
            found[:more] += values.take(begin[:more] + k, axis=0)
    for i in range(int(short.sum()), len(begin)):
        found[i] = values[begin[i] : begin[i] + size[i]].sum(axis=0)
    return found, order


def _products(left: np.ndarray, right: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the runs of rows that begin at ``edges`` the products left.T @ right, and which run each is: those of one length together."""
    sizes = np.diff(edges, append=len(left))
    order = np.argsort(sizes, kind="stable")
    begin, size = edges[order], sizes[order]
    found = np.empty((len(edges), left.shape[1], right.shape[1]), np.float32)
    cuts = np.append(np.flatnonzero(np.diff(size, prepend=-1)), len(size))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        rows = begin[a:b, None] + np.arange(size[a])
        if size[a] == 1:
            np.multiply(left.take(rows[:, 0], axis=0)[:, :, None], right.take(rows[:, 0], axis=0)[:, None, :], out=found[a:b])
        else:
            np.matmul(left.take(rows, axis=0).transpose(0, 2, 1), right.take(rows, axis=0), out=found[a:b])
    return found, order


@dataclass
class GatedModel:
    inputs: np.ndarray  # symbol x 3 width: what a symbol adds to update, reset and candidate
    recurrent: np.ndarray  # width x 3 width
    to_class: np.ndarray
    class_bias: np.ndarray
    to_shelf: np.ndarray  # shelf x width
    shelf_bias: np.ndarray
    to_symbol: np.ndarray  # symbol x width
    symbol_bias: np.ndarray
    bounds: np.ndarray
    shelves: np.ndarray

    def __post_init__(self) -> None:
        self.first_shelf = np.searchsorted(self.shelves, self.bounds)
        self.shelf_of = np.repeat(np.arange(len(self.shelves) - 1), np.diff(self.shelves))
        self.class_of = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        # the second level of all classes in one table: the symbols of classes of one shelf, then the shelves
        symbols, shelves = np.diff(self.bounds), np.diff(self.first_shelf)
        self.shelved = shelves > 1
        self.plain = np.flatnonzero(~self.shelved[self.class_of])
        self.choices = np.where(self.shelved, shelves, symbols)
        plain = np.where(self.shelved, 0, symbols)
        self.first_choice = np.where(self.shelved, len(self.plain) + self.first_shelf[:-1], np.cumsum(plain) - plain)

    @classmethod
    def new(cls, counts: np.ndarray, width: int = 24, classes: int = 64, seed: int = 0, shelved_from: int = SHELVED_FROM) -> GatedModel:
        """Weights that give every symbol the probability of its count."""
        draw, n = np.random.Generator(np.random.PCG64(seed)), len(counts)
        bounds = class_bounds(counts, classes)
        normal = lambda *shape: draw.normal(0, 0.1, shape).astype(np.float32)
        shelves = shelf_bounds(bounds, shelved_from)
        mass, held = np.add.reduceat(counts, bounds[:-1]), np.add.reduceat(counts, shelves[:-1])
        of_shelf = mass[np.searchsorted(bounds, shelves[:-1], "right") - 1]
        zeros = lambda *shape: np.zeros(shape, np.float32)
        return cls(
            normal(n, 3 * width), normal(width, 3 * width), zeros(width, len(bounds) - 1), np.log(mass / mass.sum()).astype(np.float32),
            zeros(len(held), width), np.log(held / of_shelf).astype(np.float32),
            zeros(n, width), np.log(counts / np.repeat(held, np.diff(shelves))).astype(np.float32), bounds, shelves,
        )

    @property
    def width(self) -> int:
        return self.recurrent.shape[0]

    def parameters(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in NAMES])

    def with_parameters(self, flat: np.ndarray) -> GatedModel:
        parts, at = [], 0
        for name in NAMES:
            old = getattr(self, name)
            parts.append(flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return GatedModel(*parts, self.bounds, self.shelves)

    def _advance(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step for states in columns; ``x``: what the symbols add, a row for each of 3 width."""
        w = self.width
        g = self.recurrent.T @ state
        gates = _sigmoid(x[: 2 * w] + g[: 2 * w])
        update, reset, mixed = gates[:w], gates[w:], g[2 * w :]
        candidate = reset * mixed
        candidate += x[2 * w :]
        np.tanh(candidate, out=candidate)
        after = state - candidate
        after *= update
        after += candidate
        return after, update, reset, candidate, mixed

    def step(self, symbols: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        with np.errstate(over="ignore"):
            return tuple(x.T for x in self._advance(self.inputs.take(symbols, axis=0).T, state.T))

    def log_probabilities(self, states: np.ndarray, symbols: np.ndarray, back: dict | None = None) -> np.ndarray:
        """Natural log probability of each symbol after its state. ``back`` receives the gradients of the mean loss."""
        n, w = len(symbols), self.width
        share = n if back is not None else 0
        order = _order(symbols, len(self.to_symbol))
        # in the order of symbols every shelf and class is a slice
        symbols, states, columns = symbols[order], _beside(states.take(order, axis=0), 1), _columns(w + 1, n)
        columns[:] = states.T
        own, shelf, first_choice = self.class_of[symbols], self.shelf_of[symbols], self.first_choice
        edges = np.searchsorted(own, np.arange(len(self.bounds)))
        to_class = _beside(self.to_class.T, self.class_bias)
        choices = np.concatenate([_beside(self.to_symbol.take(self.plain, axis=0), self.symbol_bias.take(self.plain)), _beside(self.to_shelf, self.shelf_bias)])
        shelved = self.shelved[own]
        choice = first_choice[own] + np.where(shelved, shelf - self.first_shelf[own], symbols - self.bounds[own])
        met = [c for c in np.flatnonzero(np.diff(edges)) if self.choices[c] > 1]
        levels = [(to_class, own, [(slice(0, n), slice(0, len(to_class)))]), (choices, choice, [(slice(edges[c], edges[c + 1]), slice(first_choice[c], first_choice[c] + self.choices[c])) for c in met])]
        found, slopes, by_states = np.zeros(n, np.float32), [], _columns(w, n) if share else None
        for table, places, parts in levels:
            more, slope, gradient = self._chosen(states, columns, table, places, parts, share)
            found += more
            if share:
                slopes.append(slope)
                by_states += gradient
        if back is not None:
            plain, (classes, chosen) = len(self.plain), slopes
            back["to_class"], back["class_bias"], back["states"] = classes[:, :w].T, classes[:, w], by_states.T.copy()
            back["to_shelf"], back["shelf_bias"] = chosen[plain:, :w], chosen[plain:, w]
            back["to_symbol"], back["symbol_bias"] = np.zeros_like(self.to_symbol), np.zeros_like(self.symbol_bias)
            back["to_symbol"][self.plain], back["symbol_bias"][self.plain] = chosen[:plain, :w], chosen[:plain, w]
        shelved = np.flatnonzero(shelved)
        # for gradients in one call, so that no shelf is met twice
        step = SHELF_ROWS if back is None else max(1, len(shelved))
        for at in range(0, len(shelved), step):
            self._within_shelves(states, symbols, shelf, shelved[at : at + step], found, back)
        result = np.empty_like(found)
        result[order] = found
        if back is not None:
            unsorted = np.empty_like(order)
            unsorted[order] = np.arange(n)
            back["states"] = back["states"].take(unsorted, axis=0)
        return result

    def _chosen(self, states: np.ndarray, columns: np.ndarray, table: np.ndarray, places: np.ndarray, parts: list[tuple[slice, slice]], n: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Log probability of row ``places`` of the table, where the states of each part choose among a slice of its rows; states in no part have 0.

        States, in rows and in columns, end in ones and the rows of the table in the bias. If ``n`` is not 0, also the gradients of the
        mean loss of n by table and by states. The logits are passed over for the exponential alone: totals and gradients
        are products with them, and the scale goes to the much narrower states.
        """
        ones, total, tops = np.ones(len(table), np.float32), np.zeros(len(places), np.float32), np.zeros(len(places), np.float32)
        if not n:
            cut = [(rows, span, max(1, LOGITS // (span.stop - span.start))) for rows, span in parts]
            parts = [(slice(a, min(a + step, rows.stop)), span) for rows, span, step in cut for a in range(rows.start, rows.stop, step)]
        high, wide = np.array([(rows.stop - rows.start, span.stop - span.start) for rows, span in parts], np.int64).reshape(-1, 2).T
        # for gradients the exponentials stay
        begin = np.cumsum(high * wide) - high * wide if n else np.zeros(len(high), np.int64)
        flat = np.empty(int((begin + high * wide).max(initial=0)), np.float32)
        held = [flat[a : a + k * m].reshape(k, m) for a, k, m in zip(begin.tolist(), wide.tolist(), high.tolist())]

        def fill(rows: slice, span: slice, logits: np.ndarray, top: np.ndarray | None = None) -> None:
            np.matmul(table[span], columns[:, rows], out=logits)
            if top is not None:
                logits -= np.max(logits, axis=0, out=top)
            np.exp(logits, out=logits)
            np.matmul(ones[: len(logits)], logits, out=total[rows])

        with np.errstate(over="ignore", invalid="ignore"):
            for (rows, span), logits in zip(parts, held):
                fill(rows, span, logits)
        outside = np.ones(len(places), bool)
        for rows, _ in parts:
            outside[rows] = False
        # once more, with maxima taken off, where exponentials left the range of floats
        usual = outside | (total > 1e-20) & (total < 1e30)
        if not usual.all():
            for (rows, span), logits in zip(parts, held):
                if not usual[rows].all():
                    fill(rows, span, logits, tops[rows])
        total[outside] = 1
        found = np.einsum("rw,rw->r", states, table.take(places, axis=0))
        found -= np.log(total) + tops
        found[outside] = 0
        if not n:
            return found, None, None
        inside = np.flatnonzero(~outside)
        first = np.array([span.start for _, span in parts], np.int64)
        at = np.arange(len(inside)) + np.repeat(begin - first * high - np.cumsum(high) + high, high) + places[inside] * np.repeat(high, high)
        flat[at] = flat.take(at) - total[inside]
        weights, by_states, gradient = np.ascontiguousarray(table[:, :-1].T), _columns(self.width, len(places)), np.zeros_like(table)
        share = 1 / (total * np.float32(n))
        scaled = (columns * share).T
        for (rows, span), logits in zip(parts, held):
            np.matmul(weights[:, span], logits, out=by_states[:, rows])
            np.matmul(logits, scaled[rows], out=gradient[span])
        by_states *= share
        return found, gradient, by_states

    def _within_shelves(self, states: np.ndarray, symbols: np.ndarray, shelf: np.ndarray, rows: np.ndarray, found: np.ndarray, back: dict | None) -> None:
        """Adds each row's symbol within its shelf; the rows come sorted by shelf."""
        own, whole = shelf[rows], states.take(rows, axis=0)
        held = whole[:, :-1]
        low, size = self.shelves[own], self.shelves[own + 1] - self.shelves[own]
        place = np.arange(size.max())
        beyond = place >= size[:, None]
        members = np.minimum(low[:, None] + place, len(self.to_symbol) - 1)
        weights = self.to_symbol.take(members, axis=0)
        logits = np.matmul(weights, held[:, :, None])[:, :, 0]
        logits += self.symbol_bias.take(members)
        logits[beyond] = -np.inf
        chances, more = _softmax(logits.T.copy(), np.zeros(1, np.float32), symbols[rows] - low, len(symbols) if back is not None else 0)
        found[rows] += more
        if back is None:
            return
        chances = chances.T.copy()
        _put(back["states"], rows, back["states"].take(rows, axis=0) + np.matmul(chances[:, None, :], weights)[:, 0])
        edges = np.flatnonzero(np.diff(own, prepend=-1))
        changes, run = _products(chances, whole, edges)
        kept, into = np.flatnonzero(~beyond[edges[run]]), members[edges[run]]
        changes, into = changes.reshape(-1, self.width + 1).take(kept, axis=0), into.ravel().take(kept)
        _put(back["to_symbol"], into, changes[:, :-1])
        back["symbol_bias"][into] = changes[:, -1]

    def document_scores(self, documents: list[np.ndarray], first: int, window: int = 32, rows: int = 1 << 16) -> np.ndarray:
        """Natural log probability of each whole document: symbols follow ``first``, and the state goes on from window to window."""
        sizes = np.array([len(d) for d in documents], np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = np.concatenate([documents[i] for i in order]) if len(order) else np.zeros(0, np.int64)
        starts, left = np.cumsum(sizes[order]) - sizes[order], sizes[order]
        scores = np.zeros(len(documents))
        state = np.zeros((self.width, len(documents)), np.float32)
        before = np.full(len(documents), first, flat.dtype)
        held: list[tuple[np.ndarray, np.ndarray, int]] = []
        kept = 0

        def done() -> None:
            nonlocal kept
            if held:
                found = self.log_probabilities(np.concatenate([s for s, _, _ in held]), np.concatenate([t for _, t, _ in held]))
                at = 0
                for _, t, live in held:
                    scores[:live] += found[at : at + live]
                    at += live
                held.clear()
                kept = 0

        live = len(documents)
        with np.errstate(over="ignore"):
            for t in range(int(sizes.max(initial=0))):
                while live and left[live - 1] <= t:
                    live -= 1
                x = np.ascontiguousarray(self.inputs.take(before[:live], axis=0).T)
                state = self._advance(x, state[:, :live])[0]
                before = flat.take(starts[:live])
                starts += 1
                held.append((state.T, before, live))
                kept += live
                if kept >= rows:
                    done()
        done()
        result = np.empty(len(documents))
        result[order] = scores
        return result


class Trainer:
    """Truncated backpropagation over lanes of symbols, with AdaGrad."""

    def __init__(self, model: GatedModel, rate: float = 0.1, lanes: int = 128, window: int = 16):
        self.model, self.rate, self.lanes, self.window = model, rate, lanes, window
        self.squares = {name: np.full_like(getattr(model, name), 1e-6) for name in NAMES}
        self.tokens = 0

    def _move(self, name: str, gradient: np.ndarray, rows: np.ndarray | None = None) -> None:
        held, weights, squares = self.squares[name], getattr(self.model, name), gradient * gradient
        if rows is None:
            held += squares
            np.sqrt(held, out=squares)
        else:
            squares += held.take(rows, axis=0)
            _put(held, rows, squares)
            np.sqrt(squares, out=squares)
        np.divide(gradient, squares, out=squares)
        squares *= self.rate
        if rows is None:
            weights -= squares
        else:
            _put(weights, rows, weights.take(rows, axis=0) - squares)

    def learn(self, documents: list[np.ndarray], first: int) -> None:
        """One pass. The documents are laid end to end and cut into lanes; the state is reset where a document begins.

        The last symbols that do not fill the lanes go on from the end of the last lane."""
        if not documents:
            return
        symbols = np.concatenate(documents)
        begins = np.zeros(len(symbols), bool)
        begins[np.cumsum([0] + [len(d) for d in documents[:-1]])] = True
        before = np.concatenate([[first], symbols[:-1]])
        before[begins] = first
        lanes = max(1, min(self.lanes, len(symbols) // self.window))
        steps = len(symbols) // lanes
        shaped = [x[: lanes * steps].reshape(lanes, steps).T for x in (before, symbols, begins)]
        state = np.zeros((lanes, self.model.width), np.float32)
        for at in range(0, steps, self.window):
            state = self._window(*(x[at : at + self.window] for x in shaped), state)
        if lanes * steps < len(symbols):
            self._window(*(x[lanes * steps :, None] for x in (before, symbols, begins)), state[-1:])
        self.tokens += len(symbols)

    def _window(self, before: np.ndarray, symbols: np.ndarray, begins: np.ndarray, state: np.ndarray) -> np.ndarray:
        model, w, (steps, lanes) = self.model, self.model.width, symbols.shape
        # every lane is a column; what a step leaves is a slice of these
        starts, states, updates, resets, candidates, mixed = np.empty((6, steps, w, lanes), np.float32)
        added = np.ascontiguousarray(model.inputs.take(before, axis=0).transpose(0, 2, 1))
        state, fresh = np.ascontiguousarray(state.T), begins.any(axis=1)
        with np.errstate(over="ignore"):
            for t in range(steps):
                starts[t] = np.where(begins[t], np.float32(0), state) if fresh[t] else state
                state, updates[t], resets[t], candidates[t], mixed[t] = model._advance(added[t], starts[t])
                states[t] = state
        back: dict[str, np.ndarray] = {}
        model.log_probabilities(states.transpose(0, 2, 1).reshape(-1, w), symbols.ravel(), back)
        out = np.ascontiguousarray(back.pop("states").reshape(steps, lanes, w).transpose(0, 2, 1))
        # by what the gradient of a state becomes that of candidate, update and reset
        to_candidate = (1 - updates) * (1 - candidates * candidates)
        to_update = (starts - candidates) * (updates * (1 - updates))
        to_reset = mixed * (resets * (1 - resets))
        inputs, mixed_in = np.empty((steps, 3 * w, lanes), np.float32), np.empty((steps, 3 * w, lanes), np.float32)
        following = np.zeros((w, lanes), np.float32)
        for t in reversed(range(steps)):
            d, gates = out[t], mixed_in[t]
            d += following
            d_candidate = np.multiply(d, to_candidate[t], out=inputs[t, 2 * w :])
            np.multiply(d, to_update[t], out=gates[:w])
            np.multiply(d_candidate, to_reset[t], out=gates[w : 2 * w])
            np.multiply(d_candidate, resets[t], out=gates[2 * w :])
            following = model.recurrent @ gates
            d *= updates[t]
            following += d
            if fresh[t]:
                following[:, begins[t]] = 0
        inputs[:, : 2 * w] = mixed_in[:, : 2 * w]
        recurrent = np.matmul(starts, mixed_in.transpose(0, 2, 1)).sum(axis=0)
        rows = before.ravel()
        order = _order(rows, len(model.inputs))
        edges = np.flatnonzero(np.diff(rows[order], prepend=-1))
        changes, run = _sums(inputs.transpose(0, 2, 1).reshape(-1, 3 * w).take(order, axis=0), edges)
        self._move("inputs", changes, rows[order[edges[run]]])
        self._move("recurrent", recurrent)
        for name in ("to_class", "class_bias", "to_shelf", "shelf_bias"):
            self._move(name, back[name])
        # where nothing was met, the gradient is 0
        own = np.flatnonzero(np.bincount(model.shelf_of[symbols.ravel()]))
        low, size = model.shelves[own], model.shelves[own + 1] - model.shelves[own]
        moved = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        for name in ("to_symbol", "symbol_bias"):
            self._move(name, back[name].take(moved, axis=0), moved)
        return state.T
