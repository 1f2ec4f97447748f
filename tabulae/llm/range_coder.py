"""Adaptive context-mixing range coder for symbol sequences.

A section of symbols is cut into blocks of one length. Each block is coded by
itself, from models that start anew, so it can be decoded alone; numpy codes
the blocks of a section side by side, one symbol of each per step.

A step predicts the next symbol from the last two (order 2), the last (order 1)
and none (order 0). Orders 2 and 1 each propose the symbol that followed their
context before, with a confidence. For order 2's proposal the log-odds that the
three orders give it are mixed by weights that each block learns from its
errors; order 1's proposal, where it is another one, goes by the adaptive
probability of both confidences. The coder codes which proposal is right, or
none; then, by order 0, the symbol's group by adaptive frequencies of the block
and the symbol in it by the section's. All arithmetic is on integers, so every
machine decodes what another one wrote.
"""

from __future__ import annotations

import math

import numpy as np

# Blocks coded side by side, their least length, and symbols of a section, whose
# blocks all fit in the lanes.
LANES, MIN_BLOCK = 4096, 512
MAX_SECTION = LANES * 1536
# Bits of a proposal's confidence, of a decision's probability, and of the
# digits that the coder puts out; its range stays above 2^LOW.
TRUST, CHOICE, DIGIT, LOW = 3, 16, 12, 48
# Bits of a block's table of contexts of one symbol; that of two symbols has one more.
CONTEXT_BITS = 10
# Groups of order 0 and bits of their frequencies; a prior's total.
GROUPS, GROUP_BITS, PRIOR = 16, 15, 1 << 14
# Steps whose contexts are found at once where the symbols are known.
AHEAD = 16
# Learning: shift of probabilities and of group frequencies, step of weights.
RATE, GROUP_RATE, LEARN = 5, 6, 12
# What is left at least of a choice's 2^CHOICE for no proposal.
_LEAST = 16
_HASH = (0x9E3779B1, 0x85EBCA6B, 15)
_APART = np.array([0, 1 << TRUST], np.int32)
_ONE, _SURE = 1 << CHOICE, (1 << TRUST) - 1


def _tables():
    """Log-odds of 12-bit probabilities in 256ths, their inverse, and logarithms
    of counts in the same unit."""
    odds = [(i + 0.5) / (4095.5 - i) for i in range(4096)]
    stretch = np.array([round(256 * math.log(x)) for x in odds], np.int32)
    squash = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2048, 2048)], np.int32)
    return stretch, squash


_STRETCH, _SQUASH = _tables()
# A context's entry is its proposal and confidence. How the confidence changes
# by (right, confidence); a wrong proposal stays if it was above 1.
_CHANGE = np.array([(n >> 1) - n for n in range(_SURE + 1)] + [int(n < _SURE) for n in range(_SURE + 1)], np.int32)
# The bounds between the groups, a row each, in 16 bits: those up to the group
# coded move towards their number, those above towards as much below the top.
_INNER = np.arange(1, GROUPS, dtype=np.int16)[:, None]
_ABOVE = np.int16((1 << GROUP_BITS) - GROUPS)


def block_length(n: int) -> int:
    """Length of the blocks of a section of ``n`` symbols."""
    return max(1, min(n, MIN_BLOCK), -(-n // LANES))


def prior(counts: np.ndarray) -> np.ndarray:
    """A section's frequencies for order 0, at least 1 each."""
    return 1 + counts.astype(np.int64) * PRIOR // max(1, int(counts.sum()))


class _OrderZero:
    """What all blocks of a section share: symbols in groups of about equal
    frequency, their places in the group, and log-odds."""

    def __init__(self, own: np.ndarray):
        self.own, end = own, np.cumsum(own)
        begin = end - own
        total = int(end[-1])
        self.group = np.minimum(GROUPS - 1, begin * GROUPS // total)
        first = np.searchsorted(self.group, np.arange(GROUPS))
        self.start = np.append(begin, total)[first]  # an empty group has no frequency
        self.mass = np.append(self.start[1:], total) - self.start
        self.below = begin - self.start[self.group]
        self.at = np.repeat(np.arange(len(own)), own)  # symbol of each place
        self.odds = np.array([round(256 * math.log(x / (total + 1 - x))) for x in own.tolist()], np.int32)


class _Model:
    """Models of ``lanes`` blocks of ``length`` symbols. Arrays of two rows are
    for order 1 and order 2; places are 64 bits wide, as numpy takes them."""

    def __init__(self, lanes: int, length: int, zero: _OrderZero):
        self.zero, self.lanes = zero, lanes
        bits = min(CONTEXT_BITS, length.bit_length())
        self.mask = np.array([[(1 << bits) - 1], [(2 << bits) - 1]])
        lane = np.arange(lanes)
        self.base = np.stack([lane << bits, (lanes + 2 * lane) << bits])
        self.table = np.zeros(3 * lanes << bits, np.int32)
        self.at = self.base.copy()  # contexts of the last symbol, and of a hash of the last two
        self.before = np.zeros(lanes, np.int64)
        # Probabilities: by order 1's confidence (for order 2's proposal, where
        # order 1 agrees or not), by order 2's, by both (for order 1's proposal).
        n = np.arange(_SURE + 1)
        sure = ((n + 0.3) / (n + 1.3) * 65000).astype(np.int64)
        start = [sure, 65535 - sure, sure, np.repeat(sure, len(n)) // 2]
        self.p = np.tile(np.concatenate(start).astype(np.int32), lanes)
        self.rows = lane * sum(map(len, start)) + np.array([[0], [2], [3]]) * len(n)
        self.w = np.repeat(np.array([[20000], [26000], [6000]], np.int32), lanes, axis=1)
        self.s, self.right = np.zeros((2, 3, lanes), np.int32)
        self.f, self.case = np.zeros((2, 2, lanes), np.int32)
        self.from_hit = np.array([1, 1, 0])
        # Bounds of the groups by (bound, lane); the top needs the 16th bit.
        self.groups = np.repeat((np.arange(GROUPS + 1) << GROUP_BITS - 4).astype(np.uint16), lanes).reshape(GROUPS + 1, lanes)
        self.inner = self.groups[1:GROUPS].view(np.int16)
        self.move = np.zeros_like(self.inner)
        self.coded, self.moves = np.zeros((2, lanes), np.int16)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Frequencies out of 2^CHOICE of order 2's and order 1's proposal."""
        self.e = e = self.table.take(self.at)
        self.n = n = e & _SURE
        self.c = c = e >> TRUST
        self.apart = apart = c[0] != c[1]
        both = self.right  # free until the update
        both[:2] = n
        np.left_shift(n[1], TRUST, out=both[2])
        both[2] += n[0]
        both[0] += _APART.take(apart.view(np.int8))
        self.p_at = at = self.rows + both
        self.q = q = self.p.take(at)
        q, s, f = q >> 4, self.s, self.f
        _STRETCH.take(q[:2], out=s[:2], mode="clip")
        self.zero.odds.take(c[1], out=s[2], mode="clip")
        total = np.add.reduce(self.w * s, axis=0, dtype=np.int32, initial=2048 << 16)
        total >>= 16
        self.mixed = _SQUASH.take(total, mode="clip")
        np.left_shift(self.mixed, CHOICE - 12, out=f[0])
        f1 = np.subtract(_ONE - _LEAST, f[0], out=f[1])
        f1 *= q[2]
        f1 >>= 12
        f1 += 1
        f1 *= apart
        return tuple(f.astype(np.int64))

    def update(self, symbol: np.ndarray, hit: np.ndarray) -> None:
        """Learn from the symbols coded; ``hit``: which proposals they are."""
        right, case, apart = self.right, self.case, self.apart
        np.multiply(hit, 1 << TRUST, out=case, dtype=np.int32)
        case += self.n
        error = np.multiply(hit[1], LEARN << 12, dtype=np.int32)
        error -= self.mixed * LEARN
        step = self.s * error
        step += 0x8000
        step >>= 16
        self.w += step
        # Order 1's probability learns only where its own proposal was asked for.
        np.multiply(hit[self.from_hit], 65535, out=right, dtype=np.int32)
        right -= self.q
        right >>= RATE
        apart &= ~hit[1]
        right[2] *= apart
        right += self.q
        self.p[self.p_at] = right
        new = _CHANGE.take(case)
        new += self.e
        fresh = symbol << np.int32(TRUST)
        fresh |= np.int32(1)
        self.table[self.at] = np.where(case > 1, new, fresh)

    def follow(self, last: np.ndarray) -> None:
        """Contexts after the symbols ``last``."""
        self.at[0] = last
        both = self.at[0] * _HASH[0]
        both += self.before * _HASH[1]
        self.before[:] = last
        np.right_shift(both, _HASH[2], out=self.at[1])
        self.at &= self.mask
        self.at += self.base

    def contexts(self, grid: np.ndarray, first: int) -> np.ndarray:
        """Contexts of ``AHEAD`` rows of known symbols, from row ``first``."""
        last = np.zeros((min(AHEAD, len(grid) - first) + 1, self.lanes), np.int64)
        known = grid[max(0, first - 2):first - 1 + len(last) - 1]
        last[len(last) - len(known):] = known
        at = np.empty((len(last) - 1, 2, self.lanes), np.int64)
        at[:, 0] = last[1:]
        at[:, 1] = last[1:] * _HASH[0] + last[:-1] * _HASH[1] >> _HASH[2]
        at &= self.mask
        at += self.base
        return at

    def bounds(self, lanes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where ``group`` of each lane begins, how wide it is)."""
        at = group * self.lanes
        at += lanes
        flat = self.groups.reshape(-1)
        begin = flat.take(at).astype(np.int64)
        at += self.lanes
        return begin, flat.take(at) - begin

    def groups_at(self, lanes: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The group of each lane that holds ``value``."""
        self.coded[lanes] = value
        return (self.inner <= self.coded).view(np.int8).sum(axis=0, dtype=np.int8).take(lanes).astype(np.int64)

    def learn_group(self, lanes: np.ndarray, group: np.ndarray) -> None:
        """All lanes at once; those without a coded group do not move."""
        self.coded[lanes] = group
        self.moves[:] = 0
        self.moves[lanes] = -1
        move = np.subtract(self.coded, _INNER, out=self.move)
        move >>= 15
        move &= _ABOVE
        move += _INNER
        move -= self.inner
        move >>= GROUP_RATE
        move &= self.moves
        self.inner += move


def _pack(digits: np.ndarray) -> bytes:
    """Two digits of 12 bits in three bytes."""
    pairs = np.zeros(len(digits) + 1 & ~1, ">u4")
    pairs[:len(digits)] = digits
    return (pairs[0::2] << DIGIT | pairs[1::2]).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int16)
    out = np.empty((len(x), 2), np.int16)
    out[:, 0] = x[:, 0] << 4 | x[:, 1] >> 4
    out[:, 1] = (x[:, 1] & 15) << 8 | x[:, 2]
    return out.reshape(-1)


def encode(symbols: np.ndarray, own: np.ndarray, length: int) -> list[bytes]:
    """Each block of ``length`` symbols (the last is filled up with symbol 0)
    as bytes; ``own`` are the section's frequencies of the symbols."""
    lanes = -(-len(symbols) // length)
    grid = np.zeros(lanes * length, np.int32)
    grid[:len(symbols)] = symbols
    grid = np.ascontiguousarray(grid.reshape(lanes, length).T)
    zero = _OrderZero(own)
    model = _Model(lanes, length, zero)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << LOW + DIGIT, np.int64)
    width = 2 * length + 8 * AHEAD
    out, lane_at = np.zeros(lanes * width, np.int16), np.arange(lanes)
    place = lane_at * width
    mask = (1 << LOW) - 1

    for k in range(length):
        symbol = grid[k]
        if k % AHEAD == 0:
            contexts = model.contexts(grid, k)
            used = place - lane_at * width
            if used.max() + 6 * AHEAD > width:  # a symbol takes five digits at most
                out = np.concatenate([out.reshape(lanes, width), np.zeros((lanes, width), np.int16)], axis=1).reshape(-1)
                width *= 2
                place = lane_at * width + used
        model.at = contexts[k % AHEAD]
        f2, f1 = model.predict()
        hit = model.c == symbol
        by2 = hit[1]
        unit = span >> CHOICE
        lane = np.flatnonzero(~(hit[0] | by2))
        # Order 2's part comes first, then order 1's, then the rest.
        begin = f2 * ~by2
        span = np.where(by2, f2, f1)
        f1 += f2
        begin[lane] = rest = f1.take(lane)
        span[lane] = _ONE - rest
        begin *= unit
        low += begin
        span *= unit
        if len(lane):
            missed = symbol.take(lane)
            group = zero.group.take(missed)
            begin, part = model.bounds(lane, group)
            unit = span.take(lane) >> GROUP_BITS
            part *= unit
            part //= zero.mass.take(group)
            begin *= unit
            begin += part * zero.below.take(missed)
            begin += low.take(lane)
            low[lane] = begin
            span[lane] = part * zero.own.take(missed)
            model.learn_group(lane, group)
        at = np.flatnonzero(span < 1 << LOW)
        while len(at):
            x, to, part = low.take(at), place.take(at), span.take(at)
            out[to] = x >> LOW  # one more than a digit where it carries
            to += 1
            place[at] = to
            x &= mask
            x <<= DIGIT
            low[at] = x
            part <<= DIGIT
            span[at] = part
            at = at[part < 1 << LOW]
        model.update(symbol, hit)
    for _ in range((LOW + DIGIT) // DIGIT):  # all that is left of ``low``
        out[place] = low >> LOW
        low = (low & mask) << DIGIT
        place += 1
    over = np.flatnonzero(out >= 1 << DIGIT)
    while len(over):  # carries
        out[over] &= (1 << DIGIT) - 1
        over -= 1
        out[over] += 1
        over = over[out[over] >= 1 << DIGIT]
    out, used = out.reshape(lanes, width), place - lane_at * width
    return [_pack(out[i, :n]) for i, n in enumerate(used.tolist())]


def decode(blocks: list[bytes], own: np.ndarray, length: int) -> np.ndarray:
    """Symbols of the blocks, one row of ``length`` each. Damaged blocks are an
    error or give other symbols, which their reader's checksum shows."""
    lanes = len(blocks)
    first = (LOW + DIGIT) // DIGIT
    digits = np.append(_unpack(b"".join(blocks)), np.int16(0))
    # A block's digits end with all that is left of its encoder's ``low``, so
    # only a damaged one asks for more than it holds.
    end = np.cumsum([len(b) // 3 * 2 for b in blocks])
    place = np.append(0, end)[:lanes]
    zero = _OrderZero(own)
    model = _Model(lanes, length, zero)
    code = np.zeros(lanes, np.int64)
    for _ in range(first):
        code = code << DIGIT | digits[place]
        place = np.minimum(place + 1, end)
    span = np.full(lanes, 1 << LOW + DIGIT, np.int64)
    grid = np.zeros((length, lanes), np.int32)

    for k in range(length):
        f2, f1 = model.predict()
        rest = f2 + f1
        unit = span >> CHOICE
        to2, to1 = unit * f2, unit * rest
        by2 = code < to2
        lane = np.flatnonzero(code >= to1)
        span = np.where(by2, to2, to1 - to2)
        code -= to2 * ~by2
        symbol = np.where(by2, model.c[1], model.c[0])
        if len(lane):
            whole = unit.take(lane) * (_ONE - rest.take(lane))
            unit = whole >> GROUP_BITS
            rest = code.take(lane)
            rest -= (to1 - to2).take(lane)
            group = model.groups_at(lane, np.minimum(rest // unit, (1 << GROUP_BITS) - 1))
            begin, part = model.bounds(lane, group)
            mass = zero.mass.take(group)
            part *= unit
            part //= mass
            rest -= unit * begin
            mass -= 1
            missed = zero.at.take(zero.start.take(group) + np.minimum(rest // part, mass))
            rest -= part * zero.below.take(missed)
            code[lane] = rest
            span[lane] = part * zero.own.take(missed)
            model.learn_group(lane, group)
            symbol[lane] = missed
        at = np.flatnonzero(span < 1 << LOW)
        while len(at):
            to, part = place.take(at), span.take(at)
            if part.min() < 1:
                raise ValueError("damaged block")
            code[at] = code.take(at) << DIGIT | digits.take(to)
            to += 1
            place[at] = np.minimum(to, end.take(at), out=to)
            part <<= DIGIT
            span[at] = part
            at = at[part < 1 << LOW]
        model.update(symbol, model.c == symbol)
        model.follow(symbol)
        grid[k] = symbol
    return grid.T
