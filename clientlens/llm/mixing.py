"""Adaptive context-mixing range coder for token ids, many blocks at a time.

Three orders predict the next id:

* order 0: the frequencies of the ids;
* order 1 and order 2: the id that most often followed the one or two ids
  before, with a confidence, the class of the share of times it did; or, after
  ids that the batch gives no prediction for, the id that last followed them
  here, with a confidence that rises with hits and halves with misses.

The predictions are mixed into one distribution: for every pair of confidences
each order has a share, which moves with every id towards the order that was
right. The mixture drives a range coder with 62 bits of state that gives out
words of 32 bits.

``alphabet_of`` learns the predictions and the first shares from the ids of a
batch of blocks: a ``Model``, which the reader needs again and ``pack`` makes
bytes of. Blocks are cut into STRIPS, each of which starts from the model and
learns shares and followers of its own with every id that is coded, so every
block can be decoded without the others. The strips of a batch are lanes of numpy arrays: step i
codes the i-th id of all strips.
All steps that decide an interval are on whole numbers, or on floats that hold
them exactly, so decoding repeats them exactly.
"""

from __future__ import annotations

import struct

import numpy as np

# Ids of a block, and the least number of blocks that are coded side by side, if there are so many.
BLOCK_IDS = 4096
LANES = 1024
# A block is coded in so many strips, each with a state of its own: with more lanes, a step costs an id less.
STRIPS = 4

TOTAL_BITS = 24
TOTAL = 1 << TOTAL_BITS
# The least of the distribution that order 0 keeps: every id stays possible.
FLOOR = 1 << 19
# Order 0 has 1 for each id, and shares out the rest of its 1 << bits by frequency; bits are enough for MOST_IDS.
_LEAST_BITS, _MOST_BITS = 16, 19
MOST_IDS = 1 << 17
# Frequencies are kept as eighths of their binary logarithm; 2 ** (k / 8) in units of 1 / 4096.
_EIGHTHS = np.array([4096, 4467, 4871, 5312, 5793, 6317, 6889, 7512], np.int64)
# Confidences: the class of a share of hits is the number of these it reaches. Class 0 is no prediction.
_CLASSES = np.array([.01, .02, .04, .07, .11, .16, .22, .3, .4, .5, .6, .7, .8, .9, .97])
_SHARE_BITS, _RATE = 16, 5
_MOVED = TOTAL - FLOOR
# A strip's own predictions: slots of each order, and bits of an entry: a tag of its context, the id, the confidence.
# Confidences of these are numbered on from the classes.
_OWN_SLOT_BITS, _OWN_TAG_AT, _CLASS0, _PAIRS = 8, 20, 16, 20
# The first shares of the strip's own predictions, by confidence.
_OWN_SHARES = np.array([.06, .25, .4, .5])
# An entry of order 1 is the next id and its confidence; one of order 2 also has a tag of its context, the middle bits
# of the context's hash, and its confidence stands where that of order 1 leaves off.
_ID_BITS, _ID_MASK = 18, (1 << 18) - 1
_TAG_AT = 8 + _ID_BITS
_TAG_MASK, _NO_ENTRY = np.int64(511 << _TAG_AT), np.int64(1 << _TAG_AT)
# Bits that an entry of order 2 must save, the slots of its table, and where the slot stands in the hash.
_ENTRY_GAIN, _LEAST_SLOT_BITS, _MOST_SLOT_BITS, _SLOT_AT = 32, 13, 17, 40
# Steps that are turned from rows of lanes to rows of steps at once, and ids that are looked up at once: few enough for the cache.
_STEPS, _AT_ONCE = 32, 1 << 13
_WINDOW, _LEAST = 62, 1 << 30
_LOW30, _MASK32 = np.int64(_LEAST - 1), np.int64((1 << 32) - 1)


def _planes(values: np.ndarray) -> bytes:
    """Low bytes first, then the next ones: easier to deflate."""
    return np.ascontiguousarray(values.astype("<u4").view("u1").reshape(-1, 4).T).tobytes()


class Model:
    """What predicts the ids 0 to ``size`` - 1 of a batch; ``size`` itself is the context of a strip's start."""

    def __init__(self, levels: np.ndarray, next1: np.ndarray, next2: np.ndarray, shares: np.ndarray):
        self.levels, self.next1, self.next2, self.shares = levels, next1, next2, shares
        self.size = len(levels)
        if self.size > MOST_IDS:
            raise ValueError("too many different ids")
        self.slot_mask = len(next2) - 1
        self.bits = min(max(self.size.bit_length() + 4, _LEAST_BITS), _MOST_BITS)
        weights = _EIGHTHS[levels & 7] << (levels >> 3).astype(np.int64) >> 4
        sums = np.concatenate([[0], np.cumsum(weights)])
        # Weights are counts times 256 and spare is below 2 ** 19, so 2 ** 35 ids would fit.
        spare = (1 << self.bits) - self.size
        sums = sums * spare // max(int(sums[-1]), 1) + np.arange(self.size + 1)
        self.starts, self.ends = sums[:-1].copy(), sums[1:].copy()
        self.ids = np.repeat(np.arange(self.size, dtype=np.uint16 if self.size <= 1 << 16 else np.int32), np.diff(sums))
    def predict(self, before1: np.ndarray, before2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next ids by order 1 and 2, and the number of the pair of their confidences."""
        entry1 = self.next1.take(before1, mode="clip")
        mixed = _hash(before1, before2)
        entry2 = self.next2.take(mixed >> _SLOT_AT & self.slot_mask, mode="clip")
        # Another context's tag leaves high bits, and the least of these has confidence 0.
        mixed &= _TAG_MASK
        entry2 = np.minimum(entry2 ^ mixed, _NO_ENTRY)
        return entry1 >> 4, entry2 >> 8, (entry2 & 240) + (entry1 & 15)

    def pack(self) -> bytes:
        used = np.flatnonzero(self.next2)
        return b"".join((struct.pack("<III", self.size, len(self.next2), len(used)), self.levels.tobytes(),
                         _planes(self.next1), np.packbits(self.next2 > 0).tobytes(),
                         _planes(self.next2[used] & _MASK32), (self.next2[used] >> 32).astype("u1").tobytes(),
                         self.shares.astype("<u2").tobytes()))

    @classmethod
    def unpack(cls, data: bytes) -> Model:
        size, slots, n_used = struct.unpack_from("<III", data)
        at = 12

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        def planes(n: int) -> np.ndarray:
            return np.ascontiguousarray(column("u1", 4 * n).reshape(4, n).T).view("<u4").ravel().astype(np.int64)

        levels, next1, next2 = column("u1", size), planes(size + 1), np.zeros(slots, np.int64)
        used = np.unpackbits(column("u1", slots + 7 >> 3), count=slots).astype(bool)
        next2[used] = planes(n_used) | column("u1", n_used).astype(np.int64) << 32
        return cls(levels, next1, next2, column("<u2", 512).reshape(2, 256))


class _Own:
    """The lanes' own entries of one order."""

    def __init__(self, lanes: int):
        self.entries = np.full(lanes << _OWN_SLOT_BITS, -1, np.int32)
        self.lane = np.arange(lanes, dtype=np.int64) << _OWN_SLOT_BITS

    def predict(self, lanes: np.ndarray, mixed: np.ndarray, ids: np.ndarray, classes: np.ndarray) -> None:
        """Put the predictions for the contexts with the hashes ``mixed``, of ``lanes``, into ``ids`` and ``classes``."""
        self.lanes, self.at = lanes, (mixed >> 43 & (1 << _OWN_SLOT_BITS) - 1) + self.lane.take(lanes, mode="clip")
        self.tag = ((mixed >> 52 & 0x7FF) << _OWN_TAG_AT).astype(np.int32)
        found = self.entries.take(self.at, mode="clip")
        self.held = np.flatnonzero((found ^ self.tag) >> _OWN_TAG_AT == 0)
        self.found, self.held_lanes = found.take(self.held, mode="clip"), lanes.take(self.held, mode="clip")
        ids[self.held_lanes] = self.found >> 2 & _ID_MASK
        classes[self.held_lanes] = (self.found & 3) + _CLASS0

    def learn(self, ids: np.ndarray, hits: np.ndarray) -> None:
        entries = (ids.take(self.lanes, mode="clip") << 2).astype(np.int32) + self.tag
        sure, hit = self.found & 3, hits.take(self.held_lanes, mode="clip")
        after = self.found - sure + np.where(hit, np.minimum(sure + 1, 3), sure >> 1)
        entries[self.held] = np.where(hit | (sure > 0), after, entries.take(self.held, mode="clip"))
        self.entries[self.at] = entries


class _Mixture:
    """What the lanes have learned: followers of their own, and the parts of orders 2 and 1 by the pair of their confidences."""

    def __init__(self, model: Model, lanes: int):
        # The shares of classes come from the model; without a class, the strip's own prediction has a fixed first share.
        first2, first1 = (np.zeros((_PAIRS, _PAIRS)) for _ in range(2))
        first2[:_CLASS0, :_CLASS0], first1[:_CLASS0, :_CLASS0] = (s.reshape(16, 16) / (1 << _SHARE_BITS) for s in model.shares)
        first2[_CLASS0:], first2[:_CLASS0, _CLASS0:] = _OWN_SHARES[:, None], first2[:_CLASS0, :1]
        first1[_CLASS0:] = first1[:1]
        first1[:, _CLASS0:] = _OWN_SHARES
        first1[_CLASS0:] *= 1 - first2[_CLASS0:]
        first1[:_CLASS0, _CLASS0:] *= 1 - first2[:_CLASS0, _CLASS0:]
        self.parts2, self.parts1 = (np.tile((f * _MOVED).astype(np.int32).ravel(), lanes) for f in (first2, first1))
        self.own1, self.own2 = _Own(lanes), _Own(lanes)
        self.lane = np.arange(lanes, dtype=np.int64) * (_PAIRS * _PAIRS)

    def predict(self, before1: np.ndarray, before2: np.ndarray, id1: np.ndarray, id2: np.ndarray,
                sure: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """The next ids by order 1 and 2 and the parts of TOTAL that orders 0, 1 and 2 get, for the first lanes.

        ``id1``, ``id2`` and ``sure`` are what the model says; the strips' own predictions are put into the ids.
        """
        class1, class2 = sure & 15, sure >> 4
        lanes1, lanes2 = np.flatnonzero(class1 == 0), np.flatnonzero(class2 == 0)
        self.own1.predict(lanes1, before1.take(lanes1, mode="clip") * 0x1E3779B97F4A7C15, id1, class1)
        self.own2.predict(lanes2, _hash(before1.take(lanes2, mode="clip"), before2.take(lanes2, mode="clip")), id2, class2)
        self.at = class2 * _PAIRS + class1 + self.lane[:len(sure)]
        self.part2, self.part1 = self.parts2.take(self.at, mode="clip"), self.parts1.take(self.at, mode="clip")
        self.id1, self.id2, self.says1, self.says2 = id1, id2, class1 > 0, class2 > 0
        weight2, weight1 = self.part2.astype(np.int64), self.part1.astype(np.int64)
        return id1, id2, (TOTAL - weight1 - weight2, weight1, weight2)

    def learn(self, ids: np.ndarray) -> None:
        """Move the parts just asked for towards the order that was right, and the strips' own followers to the ids."""
        hit1, hit2 = (self.id1 == ids) & self.says1, (self.id2 == ids) & self.says2
        self.own1.learn(ids, hit1)
        self.own2.learn(ids, hit2)
        self.parts2[self.at] = self.part2 + (hit2 * np.int32(_MOVED) - self.part2 >> _RATE)
        # A hit of both is order 2's.
        self.parts1[self.at] = self.part1 + ((hit1 & ~hit2) * np.int32(_MOVED) - self.part1 >> _RATE)


def _find(model: Model, value: np.ndarray, id1: np.ndarray, id2: np.ndarray, weights: tuple[np.ndarray, ...]) -> np.ndarray:
    """The ids whose intervals hold ``value``: what orders 2 and 1 add to an id lies before order 0's part of it."""
    weight0, weight1, weight2 = weights
    # Without a prediction the weight is 0, and nothing is taken off wherever it would be.
    over2 = model.starts.take(id2, mode="clip")
    over2 *= weight0
    over2 >>= model.bits
    over2 += weight1 * (id1 < id2)
    np.subtract(value, over2, out=over2)
    value = value - np.minimum(np.maximum(over2, 0, out=over2), weight2, out=over2)
    over1 = model.starts.take(id1, mode="clip")
    over1 *= weight0
    over1 >>= model.bits
    np.subtract(value, over1, out=over1)
    value -= np.minimum(np.maximum(over1, 0, out=over1), weight1, out=over1)
    # The largest sum whose share of weight0, cut to a whole number, is not above the value.
    target = (value + (1 - 2.0 ** -model.bits)) / (weight0 / (1 << model.bits))
    return model.ids.take(target.astype(np.int64), mode="clip").astype(np.int64)


def _interval(model: Model, ids: np.ndarray, id1: np.ndarray, id2: np.ndarray,
              weights: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Where the intervals of ids start in TOTAL, and their sizes."""
    weight0, weight1, weight2 = weights
    start = model.starts.take(ids, mode="clip")
    start *= weight0
    start >>= model.bits
    size = model.ends.take(ids, mode="clip")
    size *= weight0
    size >>= model.bits
    size -= start
    size += weight1 * (id1 == ids)
    size += weight2 * (id2 == ids)
    start += weight1 * (id1 < ids)
    start += weight2 * (id2 < ids)
    return start, size


def _hash(before1: np.ndarray, before2: np.ndarray) -> np.ndarray:
    return before2 * 0x5851F42D4C957F2D + before1 * 0x14057B7EF767814F


def _most_frequent(contexts: list[np.ndarray], numbers: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Different contexts (as one number) with their occurrences, the number that most often follows and how often it does."""
    base, kind = size + 1, np.uint32 if (size + 1) ** (len(contexts) + 1) < 1 << 32 else np.uint64
    key = np.empty(len(numbers), kind)
    for at in range(0, len(key), _AT_ONCE):
        part = key[at:at + _AT_ONCE]
        part[:] = contexts[0][at:at + _AT_ONCE]
        for column in (*contexts[1:], numbers):
            part *= kind(base)
            part += column[at:at + _AT_ONCE].astype(kind)
    key.sort()
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(starts, append=len(key))
    context, follower = np.divmod(key[starts], kind(base))
    firsts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    best = np.maximum.reduceat(counts << _ID_BITS | follower.astype(np.int64), firsts)
    return context[firsts].astype(np.int64), np.add.reduceat(counts, firsts), best & _ID_MASK, best >> _ID_BITS


def _learned(numbers: np.ndarray, counts: np.ndarray) -> Model:
    """The model of the numbers in their order."""
    size, n = len(counts), len(numbers)
    levels = np.minimum(np.rint(8 * np.log2(counts)), 255).astype(np.uint8)
    next1, next2 = np.zeros(size + 1, np.int64), np.zeros(1, np.int64)
    shares = np.zeros((2, 256), np.uint16)
    if n < 3:
        return Model(levels, next1, next2, shares)
    context, seen, follower, hits = _most_frequent([numbers[:-1]], numbers[1:], size)
    # What followed once is no prediction.
    rate1 = np.zeros(size + 1)
    rate1[context] = hits * (hits > 1) / (seen + 1)
    next1[context] = follower << 4
    next1 += np.searchsorted(_CLASSES, rate1, side="right")
    found = _most_frequent([numbers[:-2], numbers[1:-1]], numbers[2:], size)
    context, seen, follower, hits = (x[found[3] > 1] for x in found)
    before2, before1 = np.divmod(context, size + 1)
    rate = hits / (seen + 1)
    # What orders 0 and 1 would give the follower, and the bits saved by knowing its rate here.
    other = np.where(next1[before1] >> 4 == follower, rate1[before1], (1 - rate1[before1]) * counts[follower] / n)
    other = np.clip(other, 1 / n, 0.999)
    gain = hits * np.log2(rate / other) + (seen - hits) * np.log2((1 - rate) / (1 - other))
    chosen = np.flatnonzero((gain > _ENTRY_GAIN) & (rate >= _CLASSES[0]))
    if len(chosen):
        chosen = chosen[np.argsort(gain[chosen], kind="stable")]
        wide = max(1 << _LEAST_SLOT_BITS, 2 * len(chosen)) - 1
        next2 = np.zeros(1 << min(wide.bit_length(), _MOST_SLOT_BITS), np.int64)
        mixed, sure2 = _hash(before1[chosen], before2[chosen]), np.searchsorted(_CLASSES, rate[chosen], side="right")
        # Of the contexts of one slot, the last one stays.
        next2[mixed >> _SLOT_AT & len(next2) - 1] = mixed & _TAG_MASK | follower[chosen] << 8 | sure2 << 4
    plain = Model(levels, next1, next2, shares)
    tally = np.zeros(1024, np.int64)
    for at in range(2, n, _AT_ONCE):
        ids = numbers[at:at + _AT_ONCE].astype(np.int64)
        around = numbers[at - 2:at + len(ids) - 1].astype(np.int64)
        id1, id2, sure = plain.predict(around[1:], around[:-1])
        tally += np.bincount((sure << 2) + (id1 == ids) + 2 * (id2 == ids), minlength=1024)
    tally = tally.reshape(256, 4)
    # A hit of both is order 2's, if that says anything.
    pair, both = np.arange(256), tally[:, 3]
    right2 = np.where(pair >> 4, tally[:, 2] + both, 0)
    right1 = np.where(pair & 15, tally[:, 1] + np.where(pair >> 4, 0, both), 0)
    shares[:] = np.stack([right2, right1]) * ((1 << _SHARE_BITS) - 1) // (tally.sum(axis=1) + 1)
    return Model(levels, next1, next2, shares)


def alphabet_of(ids: np.ndarray) -> tuple[np.ndarray, Model, np.ndarray]:
    """The different ids in order, the model of all ids, and the numbers of ``ids`` among them."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    alphabet = np.flatnonzero(counts)
    if len(alphabet) > MOST_IDS:
        raise ValueError("too many different ids")
    numbers = np.zeros(len(counts), np.int32)
    numbers[alphabet] = np.arange(len(alphabet))
    numbers = np.concatenate([numbers[:0], *(numbers[ids[at:at + _AT_ONCE]] for at in range(0, len(ids), _AT_ONCE))])
    return alphabet.astype(np.uint32), _learned(numbers, counts[alphabet]), numbers


def encode_blocks(blocks: list[np.ndarray], model: Model) -> list[bytes]:
    """Code blocks of at most BLOCK_IDS numbers; each becomes the words of all strips but the last one, and the strips."""
    coded: list[bytes] = []
    for at, end in _batches(len(blocks)):
        strips = _encode([b[s:e] for b in blocks[at:end] for s, e in _strips(len(b))], model)
        for k in range(0, len(strips), STRIPS):
            words = np.array([len(x) // 4 for x in strips[k:k + STRIPS - 1]], "<u2")
            coded.append(b"".join((words.tobytes(), *strips[k:k + STRIPS])))
    return coded


def decode_blocks(coded: list[bytes], lengths: list[int], model: Model) -> list[np.ndarray]:
    """The numbers of coded blocks, given their lengths."""
    blocks: list[np.ndarray] = []
    for at, end in _batches(len(coded)):
        strips, sizes = [], []
        for block, length in zip(coded[at:end], lengths[at:end], strict=True):
            words = np.frombuffer(block, "<u2", STRIPS - 1).astype(np.int64)
            # Damaged numbers of words stay within the block; its checksum will tell.
            bounds = [*np.minimum(2 * len(words) + 4 * np.append(0, np.cumsum(words)), len(block)).tolist(), len(block)]
            strips += [block[s:e] for s, e in zip(bounds, bounds[1:])]
            sizes += [e - s for s, e in _strips(length)]
        found = _decode(strips, np.array(sizes, np.int64), model)
        blocks += [np.concatenate(found[k:k + STRIPS]) for k in range(0, len(found), STRIPS)]
    return blocks


def _strips(length: int) -> list[tuple[int, int]]:
    return [(length * k // STRIPS, length * (k + 1) // STRIPS) for k in range(STRIPS)]


def _batches(n: int) -> list[tuple[int, int]]:
    """Batches of LANES blocks or more, below twice as many, as even as can be: a step costs little less for few lanes."""
    parts = max(n // LANES, 1)
    return [(n * k // parts, n * (k + 1) // parts) for k in range(parts)] if n else []


def _by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes from long to short, and how many of them go on at each step."""
    order = np.argsort(-lengths, kind="stable")
    steps = np.arange(int(lengths.max(initial=0)))
    return order, np.searchsorted(-lengths[order], -steps, side="left")


def _encode(strips: list[np.ndarray], model: Model) -> list[bytes]:
    lengths = np.array([len(s) for s in strips], np.int64)
    order, active = _by_length(lengths)
    # Two that are no ids stand before each strip.
    rows = np.full((len(strips), len(active) + 2), model.size, np.int32)
    for lane, strip in enumerate(order):
        rows[lane, 2:lengths[strip] + 2] = strips[strip]
    low, width = np.zeros(len(strips), np.int64), np.full(len(strips), 1 << _WINDOW, np.int64)
    mixture = _Mixture(model, len(strips))
    lanes_out, words_out, done = [], [], 0
    for step, n in enumerate(active.tolist()):
        if step % _STEPS == 0:
            table = np.ascontiguousarray(rows[:, step:step + _STEPS + 2].T).astype(np.int64)
        if step == done:
            done = min(step + max(_AT_ONCE // n, 1), step - step % _STEPS + _STEPS, len(active))
            ids, before1, before2 = (table[step % _STEPS + k:done - step + step % _STEPS + k, :n].ravel() for k in (2, 1, 0))
            columns = [x.reshape(done - step, n) for x in (ids, before1, before2, *model.predict(before1, before2))]
            first = step
        ids, *predicted = (x[step - first, :n] for x in columns)
        start, size = _interval(model, ids, *mixture.predict(*predicted))
        mixture.learn(ids)
        if n < len(low):
            # Lanes that have ended: any value of their interval will do, the one with most zeros is taken.
            lanes_out.append(np.arange(n, len(low), dtype=np.uint16))
            words_out.append(low[n:] + _LOW30 >> 30)
            low, width = low[:n], width[:n]
        unit = width >> TOTAL_BITS
        low += unit * start
        np.multiply(unit, size, out=width)
        out = np.flatnonzero(width < _LEAST)
        if len(out):
            shifted = low[out]
            lanes_out.append(out.astype(np.uint16))
            words_out.append(shifted >> 30)
            low[out] = (shifted & _LOW30) << 32
            width[out] <<= 32
    lanes_out.append(np.arange(len(low), dtype=np.uint16))
    words_out.append(low + _LOW30 >> 30)
    lanes, words = np.concatenate(lanes_out), np.concatenate(words_out)
    words = words[np.argsort(lanes, kind="stable")]
    # A word of 33 bits carries into the one before, which is of the same lane: the first one has 32.
    while (carry := np.flatnonzero(words >> 32)).size:
        words[carry] &= (1 << 32) - 1
        words[carry - 1] += 1
    words = words.astype("<u4")
    ends = np.cumsum(np.bincount(lanes, minlength=len(strips)))
    coded: list[bytes] = [b""] * len(strips)
    for lane, strip in enumerate(order):
        coded[strip] = words[ends[lane - 1] if lane else 0:ends[lane]].tobytes()
    return coded


def _decode(coded: list[bytes], lengths: np.ndarray, model: Model) -> list[np.ndarray]:
    order, active = _by_length(lengths)
    # Zeros follow the words of each lane.
    joined = np.frombuffer(b"".join(coded[s] + bytes(8) for s in order), "<u4").astype(np.int64)
    ends = np.cumsum([len(coded[s]) // 4 + 2 for s in order], dtype=np.int64)
    at = np.concatenate([[0], ends[:-1]])
    code = joined[at] << 30 | joined[at + 1] >> 2
    # The state ends 2 bits before a word does, so it goes on by words from there.
    words = np.append((joined[:-1] & 3) << 30 | joined[1:] >> 2, 0)
    at += 1
    width = np.full(len(coded), 1 << _WINDOW, np.int64)
    before1 = before2 = np.full(len(coded), model.size, np.int64)
    rows = np.zeros((len(coded), len(active)), np.int32)
    table = np.zeros((_STEPS, len(coded)), np.int32)
    mixture = _Mixture(model, len(coded))
    for step, n in enumerate(active.tolist()):
        if n < len(code):
            code, width, at, before1, before2 = (x[:n] for x in (code, width, at, before1, before2))
        unit = width >> TOTAL_BITS
        value = np.minimum((code.view(np.uint64) // unit.view(np.uint64)).view(np.int64), TOTAL - 1)
        predicted = mixture.predict(before1, before2, *model.predict(before1, before2))
        ids = _find(model, value, *predicted)
        start, size = _interval(model, ids, *predicted)
        mixture.learn(ids)
        code -= unit * start
        np.multiply(unit, size, out=width)
        out = np.flatnonzero(width < _LEAST)
        if len(out):
            position = at[out]
            code[out] = code[out] << 32 | words.take(position, mode="clip")
            at[out] = position + 1
            width[out] <<= 32
        before2, before1 = before1, ids
        table[step % _STEPS, :n] = ids
        if step % _STEPS == _STEPS - 1 or step == len(active) - 1:
            done = step % _STEPS + 1
            rows[:, step + 1 - done:step + 1] = table[:done].T
    strips: list[np.ndarray] = [None] * len(coded)
    for lane, strip in enumerate(order):
        strips[strip] = rows[lane, :lengths[strip]]
    return strips
