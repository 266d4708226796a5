"""A context-mixing range coder for blocks of token ids, in numpy across many blocks at once.

Each block is coded on its own from a fresh model. First, pairs of neighbours that occur `LEAST_PAIRS` times are joined to one
symbol each, so that there are fewer symbols than ids; the block's table names the ids that occur and the pairs. Three models predict a symbol: order-2 and order-1 from what has followed the last two symbols, or the last one, and order-0 from in how many contexts a
symbol has been. They are mixed: P1 = w1 * p1 + (1 - w1) * p0 and P2 = w2 * p2 + (1 - w2) * P1, with a weight for each of 24 degrees of
confidence in a context, learned as the block goes on from each model's share in the symbols that came. A symbol that the order-2
context has seen is coded with P2 at once; else an escape, and the same with P1 among those that the order-1 context has seen;
else p0. An order-2 context counts once it was seen `LEAST_SEEN` times.

A block is cut into up to `LANES` runs of symbols, each with a range coder of its own, that share the block's model. The model
is built anew from all runs' symbols whenever they are `GROWTH` times as many. Between two such points it is fixed, so that numpy codes one
position of all runs of many blocks in one step. Decoder and encoder build the same model by the same steps of exact
or IEEE arithmetic.
"""

from __future__ import annotations

import numpy as np

LANES, LEAST_RUN, FIRST, GROWTH = 256, 512, 4, 6
BITS = 16
WHOLE = 1 << BITS
SHIFT = 17  # of a symbol in a key: vocabularies go up to 2 ** 16
SYMBOL = (1 << SHIFT) - 1
DEGREES = 24
LEAST_SEEN = 4  # of an order-2 context
LEAST_PAIRS, MOST_SYMBOLS = 12, 1 << 14
U = np.uint64
LOW, TOP, WORD = U(2**32 - 1), U(2**32), U(16)


def shape_of(length: int) -> tuple[int, int]:
    """(runs, longest run) of a block."""
    runs = max(1, min(LANES, length // LEAST_RUN))
    return runs, -(-length // runs)


def turns(longest: int) -> list[tuple[int, int]]:
    """The stretches between two builds of the model."""
    ends = [0, FIRST]
    while ends[-1] < longest:
        ends.append(GROWTH * ends[-1])
    return [(a, min(b, longest)) for a, b in zip(ends, ends[1:], strict=False) if a < longest]


def starts_of(keys: np.ndarray) -> np.ndarray:
    """Where each stretch of equal keys begins."""
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.flatnonzero(new)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = starts_of(keys)
    return keys[first], np.diff(first, append=len(keys))


class Places:
    """Where keys stand in a sorted array: by a hash, and by bisection for those whose slot another key has taken."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, (8 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.slots[self.slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).view(np.int64)

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """-1 for keys that are not there."""
        at = self.slots.take(self.slot(wanted), mode="clip")
        if not len(self.keys):
            return at
        other = np.flatnonzero((self.keys.take(at, mode="clip") != wanted) & (at >= 0))
        key = wanted[other]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        at[other] = np.where(self.keys[found] == key, found, -1)
        return at


def confidence(n: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """0 to 23, of a context seen n times with so many different successors."""
    size = np.minimum(np.frexp(n.astype(np.float64))[1] - 1, 7)
    return size * 3 + np.where(kinds == 1, 0, np.where(2 * kinds <= n, 1, 2))


class Level:
    """The coded intervals of one order: for each context a row of its successors, and an escape that fills it up to WHOLE."""

    def __init__(self, first: np.ndarray, n: np.ndarray, weights: np.ndarray, lower: np.ndarray):
        """first: where each context's successors begin; n: their counts; lower: their probabilities from the orders below."""
        rows = np.arange(len(first))
        kinds = np.diff(first, append=len(n))
        row = np.repeat(rows, kinds)
        total = np.add.reduceat(n, first) if len(first) else n
        degree = confidence(total, kinds)
        w = (weights[:, 0] / weights[:, 1])[degree]
        own = (w / total)[row] * n
        self.p = own + (1 - w)[row] * lower
        size = (self.p * (WHOLE - 1 - kinds)[row]).astype(np.int32) + 1
        # Each row's escape stands behind its successors.
        self.at = np.arange(len(n)) + row
        self.first, self.escape = first + rows, first + kinds + rows
        self.size = np.empty(len(n) + len(first), np.int32)
        self.size[self.at] = size
        self.size[self.escape] = WHOLE - np.add.reduceat(size, first) if len(first) else size
        self.share = np.zeros(len(self.size))
        self.share[self.at] = own / self.p
        self.degree = np.repeat(degree, kinds + 1)
        self.kinds = kinds + 1


class Model:
    """The model of one block; symbols are 0 to n_symbols - 1, and n_symbols stands before each run.

    Its rows: first order 0, then order 1 and order 2 by their contexts. Of each entry of a row: the start and size of its interval, its
    symbol, -1 for an escape, and the row to ask next.
    """

    def __init__(self, n_symbols: int):
        self.n_symbols = n_symbols
        self.weights = np.ones((2 * DEGREES, 2))
        self.weights[:, 0] = np.repeat([0.6, 0.8], DEGREES)
        self.keys1 = None
        starts = np.arange(n_symbols + 1, dtype=np.int64) * WHOLE // n_symbols
        self.start, self.size = starts[:-1].astype(np.int32), np.diff(starts).astype(np.int32)
        self.symbol, self.next = np.arange(n_symbols, dtype=np.int32), np.zeros(n_symbols, np.int32)
        self.first, self.kinds = np.zeros(1, np.int64), np.array([n_symbols])

    def build(self, now: np.ndarray, last: np.ndarray, before: np.ndarray) -> None:
        """From the symbols so far, each with the last one and the one before that."""
        pair = (last << SHIFT) | now
        keys1, n1 = counted(pair)
        keys2, n2 = counted((before << 2 * SHIFT) | pair)
        places, self.keys1 = Places(keys1), keys1
        self.places1 = places
        link = places.of(keys2 & ((1 << 2 * SHIFT) - 1))
        symbol = keys1 & SYMBOL
        # Lower orders count in how many contexts a symbol was, as those are asked only when a context does not know it.
        kinds1, kinds0 = np.bincount(link, minlength=len(keys1)), np.bincount(symbol, minlength=self.n_symbols)
        first = starts_of(keys2 >> SHIFT)
        often = np.add.reduceat(n2, first) >= LEAST_SEEN
        kept = np.repeat(often, np.diff(first, append=len(keys2)))
        keys2, n2, link = keys2[kept], n2[kept], link[kept]
        self.places2 = Places(keys2)
        p0 = (kinds0 + 0.3) / (kinds0.sum() + 0.3 * self.n_symbols)
        size0 = (p0 * max(0, WHOLE - 1 - self.n_symbols)).astype(np.int32) + 1
        size0[-1] += WHOLE - size0.sum()
        first1, first2 = starts_of(keys1 >> SHIFT), starts_of(keys2 >> SHIFT)
        one = Level(first1, kinds1, self.weights[:DEGREES], p0[symbol])
        two = Level(first2, n2, self.weights[DEGREES:], one.p[link])
        base1, base2 = self.n_symbols, self.n_symbols + len(one.size)
        self.at1, self.at2 = one.at + base1, two.at + base2
        self.escape1 = np.full(self.n_symbols + 1, -1)
        context1 = keys1[first1] >> SHIFT
        self.escape1[context1] = one.escape + base1
        row1 = np.zeros(self.n_symbols + 1, np.int32)
        row1[context1] = np.arange(1, len(first1) + 1)
        # The row after a pair: that of its order-2 context, else that of its second symbol.
        pairs2 = keys2[first2] >> SHIFT
        own = places.of(pairs2)
        after1 = row1[symbol]
        after1[own[own >= 0]] = np.flatnonzero(own >= 0) + len(first1) + 1
        self.escape2 = np.full(len(keys1) + 1, -1)  # of a pair; the last is for no pair
        self.escape2[own[own >= 0]] = two.escape[own >= 0] + base2
        size = self.size = np.concatenate([size0, one.size, two.size])
        self.first = np.concatenate([[0], one.first + base1, two.first + base2])
        self.kinds = np.concatenate([[self.n_symbols], one.kinds, two.kinds])
        ends = np.cumsum(size, dtype=np.int64)
        self.start = ((ends - size) & (WHOLE - 1)).astype(np.int32)  # a row begins at its number times WHOLE
        self.symbol, self.next = np.full(len(size), -1, np.int32), np.zeros(len(size), np.int32)
        self.symbol[:base1], self.next[:base1] = np.arange(base1), row1[:-1]
        self.symbol[self.at1], self.next[self.at1] = symbol, after1
        self.symbol[self.at2], self.next[self.at2] = keys2 & SYMBOL, after1[link]
        self.next[two.escape + base2] = row1[pairs2 & SYMBOL]
        self.share = np.concatenate([one.share, two.share])
        self.degree = np.concatenate([one.degree, two.degree + DEGREES])

    def learn(self, taken: np.ndarray) -> None:
        """Moves the weights by how often each entry was taken."""
        taken = taken[self.n_symbols :]
        self.weights[:, 0] += np.bincount(self.degree, self.share * taken, 2 * DEGREES)
        self.weights[:, 1] += np.bincount(self.degree, taken, 2 * DEGREES)


def after(run: np.ndarray, start: int, at: int, end: int, back: int) -> np.ndarray:
    """The symbols `back` places before the positions at to end; `start` before a run."""
    out = np.full((len(run), end - at), start, np.int64)
    skip = max(0, back - at)
    out[:, skip:] = run[:, at + skip - back : end - back]
    return out


def entries_of(model: Model, run: np.ndarray, length: np.ndarray, at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(the entries that code the positions at to end of one run after another, their number in each run), and learns from them."""
    now = run[:, at:end]
    if model.keys1 is None:
        entries = now[:, :, None]
    else:
        last, before = after(run, model.n_symbols, at, end, 1), after(run, model.n_symbols, at, end, 2)
        key = (last << SHIFT) | now
        pair = model.places1.of(key.ravel()).reshape(now.shape)
        context = np.empty_like(pair)
        context[:, 1:] = pair[:, :-1]
        context[:, 0] = model.places1.of((before[:, 0] << SHIFT) | last[:, 0])
        two = model.escape2[context].ravel()
        asked = np.flatnonzero(two >= 0)
        found = model.places2.of(((before << 2 * SHIFT) | key).ravel()[asked])
        pair, known = pair.ravel(), found >= 0
        two[asked[known]] = model.at2[found[known]]
        one = model.escape1[last.ravel()]
        seen = np.flatnonzero(pair >= 0)
        one[seen] = model.at1[pair[seen]]
        none = np.where(pair >= 0, -1, now.ravel())
        one[asked[known]] = -1
        none[asked[known]] = -1
        entries = np.stack([two, one, none], 1).reshape(*now.shape, 3)
    used = entries >= 0
    for k in np.flatnonzero(length < end):
        used[k, max(0, length[k] - at) :] = False
    taken = entries[used]
    if model.keys1 is not None:
        model.learn(np.bincount(taken, minlength=len(model.size)))
    return taken, used.sum((1, 2))


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs as rows, their lengths)."""
    runs, longest = shape_of(len(x))
    padded = np.zeros(runs * longest, np.int64)
    padded[: len(x)] = x
    return padded.reshape(runs, longest), np.clip(len(x) - np.arange(runs) * longest, 0, longest)


def history(run: np.ndarray, length: np.ndarray, n_symbols: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = run[:, :end], after(run, n_symbols, 0, end, 1), after(run, n_symbols, 0, end, 2)
    if length.min() >= end:
        return tuple(p.ravel() for p in parts)
    live = np.arange(end)[None, :] < length[:, None]
    return tuple(p[live] for p in parts)


def joined(x: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """(the symbols once frequent pairs are symbols, these pairs): the first pair is symbol n_ids, and so on."""
    # A pair in 32 bits, if it fits.
    shift, kind = (15, np.int32) if n_ids < 1 << 15 else (SHIFT, np.int64)
    key = (x[:-1].astype(kind) << shift) | x[1:]
    if len(key) < LEAST_PAIRS:
        return x, np.empty((0, 2), np.int64)
    keys, n = counted(key)
    often = np.flatnonzero(n >= LEAST_PAIRS)
    room = max(0, MOST_SYMBOLS - n_ids)
    if len(often) > room:
        often = np.sort(often[np.argsort(-n[often], kind="stable")[:room]])
    keys = keys[often].astype(np.int64)
    pair = Places(keys).of(key.astype(np.int64))
    # Of pairs that overlap, every other one from the left.
    place = np.arange(len(pair), dtype=np.int32)
    gap = np.where(pair < 0, place, np.int32(-1))
    np.maximum.accumulate(gap, out=gap)
    first = np.flatnonzero((place - gap) & 1)
    kept = np.ones(len(x), bool)
    kept[first + 1] = False
    x = x.copy()
    x[first] = pair[first] + n_ids
    return x[kept], np.stack([keys >> shift, keys & ((1 << shift) - 1)], 1)


def table_of(alphabet: np.ndarray, pairs: np.ndarray, n: int) -> np.ndarray:
    """A block's table: the numbers of its symbols and of ids that occur, these ids, the first and the second ids of its pairs by their places among these."""
    return np.concatenate([[n, len(alphabet)], alphabet, pairs.T.ravel()]).astype(np.uint32)


def opened(table: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of symbols, the ids of all symbols in a row, where each begins and the last ends) of a block's table."""
    n, ids = int(table[0]), table[2 : 2 + table[1]]
    pairs = table[2 + len(ids) :].reshape(2, -1)
    ends = np.concatenate([np.arange(len(ids) + 1), len(ids) + 2 * np.arange(1, pairs.shape[1] + 1)])
    return n, np.concatenate([ids, ids[pairs.T.ravel()]]), ends


def encode(blocks: list[np.ndarray], vocab: int) -> list[tuple[np.ndarray, list[bytes]]]:
    """(the table, the code of each run) for each block."""
    tables, parts, runs = [], [], [0]
    for block in blocks:
        if len(block) and int(block.max()) >= min(vocab, WHOLE):
            raise ValueError("an id is not below the vocabulary's size")
        there = np.zeros(WHOLE, bool)
        there[block] = True
        alphabet = np.flatnonzero(there)
        x, pairs = joined((np.cumsum(there, dtype=np.int32) - np.int32(1))[block], len(alphabet))
        tables.append(table_of(alphabet, pairs, len(x)))
        run, length = runs_of(x)
        model = Model(max(1, len(alphabet) + len(pairs)))
        for at, end in turns(run.shape[1]):
            if at:
                model.build(*history(run, length, model.n_symbols, at))
            taken, number = entries_of(model, run, length, at, end)
            # Start and size in one number.
            interval = (model.start.astype(np.uint32) << 16) | (model.size - 1).astype(np.uint32)
            parts.append((runs[-1], number, interval.take(taken)))
        runs.append(runs[-1] + len(run))
    count = np.zeros(runs[-1], np.int64)
    for lane, number, _ in parts:
        count[lane : lane + len(number)] += number
    intervals = np.full((int(count.max(initial=0)), runs[-1]), WHOLE - 1, np.uint32)
    flat, done = intervals.reshape(-1), np.zeros(runs[-1], np.int64)
    for lane, number, packed in parts:
        mine = slice(lane, lane + len(number))
        place = np.arange(len(packed)) + np.repeat(done[mine] - (np.cumsum(number) - number), number)
        flat[place * runs[-1] + np.repeat(np.arange(lane, lane + len(number)), number)] = packed
        done[mine] += number
    code = coded(intervals)
    return [(t, code[i:j]) for t, i, j in zip(tables, runs[:-1], runs[1:], strict=True)]


def encode_ranges(lane: np.ndarray, start: np.ndarray, size: np.ndarray, lanes: int) -> list[bytes]:
    """Range codes of the lanes' intervals, whose order within a lane is kept."""
    order = np.argsort(lane, kind="stable")
    count = np.bincount(lane, minlength=lanes)
    place = np.arange(len(lane)) - np.repeat(np.cumsum(count) - count, count)
    intervals = np.full((int(count.max(initial=0)), lanes), WHOLE - 1, np.uint32)
    intervals[place, lane[order]] = (start[order] << 16) | (size[order] - 1)
    return coded(intervals)


def coded(intervals: np.ndarray) -> list[bytes]:
    """Range codes of columns of intervals, each its start in the upper 16 bits and its size less one in the lower."""
    steps, lanes = intervals.shape
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 48) - 1, np.uint64)
    out, used = np.zeros((lanes, steps + 2), np.uint16), np.zeros(lanes, np.int64)
    flat = out.reshape(-1)

    def emit(where: np.ndarray) -> None:
        # A number that has grown past 48 bits since its last word carries into the words already out.
        now, at = low.take(where), used.take(where)
        word = now >> U(32)
        flat[where * (steps + 2) + at] = word
        over = np.flatnonzero(word >> WORD)
        if len(over):
            lane, back = where[over], at[over] - 1
            while len(lane):
                out[lane, back] += np.uint16(1)
                more = out[lane, back] == 0
                lane, back = lane[more], back[more] - 1
        low[where] = (now & LOW) << WORD
        used[where] = at + 1

    for row in intervals:
        span >>= WORD
        low += span * (row >> np.uint32(16))
        span *= (row & np.uint32(WHOLE - 1)) + np.uint32(1)
        where = (span < TOP).nonzero()[0]
        emit(where)
        span[where] = span.take(where) << WORD
    # One word is enough to name a number within the last range, as zeros follow it.
    low += LOW
    emit(np.arange(lanes))
    return [out[i, : used[i]].astype("<u2").tobytes() for i in range(lanes)]


class Tables:
    """The rows of several models one after another, with cells that lead from a place in a row to the entry there.

    facts: of each entry its start and end in its row, its symbol, and the row to ask next, as `row` gives it: its first cell and the width
    of its cells.
    """

    def __init__(self, models: list[Model]):
        self.bases = np.cumsum([0, *(len(m.size) for m in models)])
        self.first_rows = np.cumsum([0, *(len(m.first) for m in models)])
        kinds = np.concatenate([m.kinds for m in models])
        bits = np.minimum(np.frexp(kinds * 2.0)[1], BITS)
        ends = np.cumsum(1 << bits)
        base, shift = ends - (1 << bits), BITS - bits
        kind = np.int32 if ends[-1] < 1 << 26 else np.int64
        self.row = ((base << 5) | shift).astype(kind)
        self.facts = np.empty((self.bases[-1], 4), kind)
        for m, i, j, r in zip(models, self.bases, self.bases[1:], self.first_rows, strict=False):
            part = self.facts[i:j]
            part[:, 0] = m.start
            part[:, 1] = m.start + m.size
            part[:, 2] = m.symbol
            part[:, 3] = self.row[m.next + r]
        # An entry's first cell is the first that begins at or after its start; where several have the same one, the last stands there.
        shift, start = np.repeat(shift, kinds), self.facts[:, 0]
        self.cell = np.zeros(ends[-1] + 1, np.int32)
        self.cell[np.repeat(base, kinds) + ((start + (1 << shift) - 1) >> shift)] = np.arange(len(start), dtype=np.int32)
        np.maximum.accumulate(self.cell, out=self.cell)

    def at(self, row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries at these places of these rows, and their facts."""
        entry = self.cell.take((row >> 5) + (value >> (row & 31)), mode="clip")
        facts = self.facts.take(entry, 0, mode="clip")
        on = (facts[:, 1] <= value).nonzero()[0]
        while len(on):
            further = entry.take(on) + 1
            entry[on] = further
            now = self.facts.take(further, 0, mode="clip")
            facts[on] = now
            on = on[now[:, 1] <= value.take(on)]
        return entry, facts


def decode(codes: list[list[bytes]], lengths: list[int], tables: list[np.ndarray]) -> list[np.ndarray]:
    """The blocks of which encode() gave these codes and tables."""
    known = [opened(t) for t in tables]
    models = [Model(max(1, len(ends) - 1)) for _, _, ends in known]
    shapes = [runs_of(np.zeros(n, np.int64)) for n, _, _ in known]
    first = np.cumsum([0, *(len(r) for r, _ in shapes)])
    lanes, longest = int(first[-1]), max((r.shape[1] for r, _ in shapes), default=0)
    length = np.concatenate([x for _, x in shapes] or [np.empty(0, np.int64)])
    flat_codes = [c for block in codes for c in block]
    width = max(map(len, flat_codes), default=0) // 2 + 4
    words = np.zeros((lanes, width), np.uint16)
    for i, c in enumerate(flat_codes):
        words[i, : len(c) // 2] = np.frombuffer(c, "<u2")
    # Numbers below 2 ** 48 and their quotients' whole parts are exact in doubles.
    all_code = words[:, :3].astype(np.float64) @ np.array([2.0**32, 2.0**16, 1.0])
    all_span, all_read = np.full(lanes, 2.0**48 - 1), np.arange(lanes) * width + 3
    words, last_word = words.reshape(-1), np.arange(1, lanes + 1) * width - 1
    symbols = np.zeros((longest, lanes), np.int32)

    for at, end in turns(longest):
        live = [k for k, (r, _) in enumerate(shapes) if r.shape[1] > at]
        lane = np.concatenate([np.arange(first[k], first[k + 1]) for k in live])
        if at:
            for k in live:
                mine = slice(first[k], first[k + 1])
                models[k].build(*history(symbols[:at, mine].T.astype(np.int64), length[mine], models[k].n_symbols, at))
        now = Tables([models[k] for k in live])
        row = np.empty(len(lane), now.row.dtype)
        done = 0
        for slot, k in enumerate(live):
            own = np.zeros(first[k + 1] - first[k], np.int32)
            if at:
                m, mine = models[k], slice(first[k], first[k + 1])
                pair = m.places1.of((symbols[at - 2, mine].astype(np.int64) << SHIFT) | symbols[at - 1, mine])
                own[pair >= 0] = m.next[m.at1[pair[pair >= 0]]]
            row[done : done + len(own)] = now.row[own + now.first_rows[slot]]
            done += len(own)
        code, span, read, last, own_length = all_code[lane], all_span[lane], all_read[lane], last_word[lane], length[lane]
        least, to = int(own_length.min()), slice(None) if len(lane) == lanes else lane
        events = []

        def ask(code: np.ndarray, span: np.ndarray, read: np.ndarray, last: np.ndarray, row: np.ndarray, now: Tables = now) -> tuple[np.ndarray, np.ndarray]:
            unit = np.floor(span * 2.0**-BITS)
            entry, facts = now.at(row, np.minimum(code / unit, WHOLE - 1).astype(np.int32))
            code -= unit * facts[:, 0]
            np.multiply(unit, facts[:, 1] - facts[:, 0], out=span)
            small = (span < 2.0**32).nonzero()[0]
            place = read.take(small)
            code[small] = code.take(small) * WHOLE + words.take(np.minimum(place, last.take(small)))
            read[small] = place + 1
            span[small] = span.take(small) * WHOLE
            return entry, facts

        for j in range(at, end):
            alive = own_length > j if j >= least else None
            entry, facts = ask(code, span, read, last, row)
            events.append(entry if alive is None else entry[alive])
            symbol, row = facts[:, 2], facts[:, 3]
            left = (symbol < 0).nonzero()[0]
            while len(left):
                state = code.take(left), span.take(left), read.take(left)
                entry, facts = ask(*state, last.take(left), row.take(left))
                code[left], span[left], read[left] = state
                symbol[left], row[left] = facts[:, 2], facts[:, 3]
                events.append(entry if alive is None else entry[alive[left]])
                left = left[facts[:, 2] < 0]
            symbols[j, to] = symbol
        all_code[lane], all_span[lane], all_read[lane] = code, span, read
        if at:
            taken = np.bincount(np.concatenate(events), minlength=now.bases[-1])
            for slot, k in enumerate(live):
                models[k].learn(taken[now.bases[slot] : now.bases[slot + 1]])
    out = []
    for (n, ids, ends), i, j, (run, _), size in zip(known, first[:-1], first[1:], shapes, lengths, strict=True):
        x = symbols[: run.shape[1], i:j].T.ravel()[:n]
        sizes = np.diff(ends)[x]
        to = np.cumsum(sizes)
        if n and to[-1] != size:
            raise ValueError("the decoded ids differ in number from those written")
        out.append(ids[np.arange(size) + np.repeat(ends[x] - (to - sizes), sizes)] if n else np.empty(0, np.uint32))
    return out
