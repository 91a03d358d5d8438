"""An adaptive context-mixing range coder for token ids, run over many blocks at once.

A block is coded from nothing but its own ids and its group's table of id frequencies,
so all blocks of a group advance in lockstep, one NumPy lane each. Three predictions are
mixed for each whole id: order 0 is the group's distribution of ids; order 1 and order 2 are
the ids that followed the one and the two ids before, as this block has shown so far, and
know how often they were right of late. Weights of the mixture are learnt by each
lane for each pair of these confidences, and start afresh in each block. The mixture is
linear, so that an id's interval is a sum of three and the decoder finds the id without a
search. All arithmetic is on integers, so that coder and decoder agree on any machine.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"ACMR"
VERSION = 3
_HEAD = struct.Struct("<4sHHII")  # magic, version, unused, ids of a full block, groups
_GROUP = struct.Struct("<IIII")  # blocks, distinct ids, bytes of the table of ids, its crc32
_BLOCK = struct.Struct("<III")  # ids, bytes, crc32 of the ids as little-endian 32-bit numbers and of the bytes

#: Cells a lane has for each order (a power of two); a cell is an id's place (22 bits), 7 bits of its context's hash and 2 of confidence.
_CELLS = 8
#: Ids of a group, so that places fit a cell.
GROUP_IDS = 1 << 22
#: The most that the weights of orders 2 and 1 sum to, of 65536; what is left is order 0's.
_SURE = 64512
_RATE = 5
_FULL = np.uint64((1 << 48) - 1)
_SMALL = np.uint64(1 << 32)
_16, _32, _48 = np.uint64(16), np.uint64(32), np.uint64(48)
#: By whether a cell was right and how sure it was: what is added to it, or that it gives way to a new one.
_NEW = 9
_CHANGE = np.array([_NEW, _NEW, -1, -2, _NEW, 1, 1, 0], np.int32)


class _Order0:
    """The group's distinct ids and their cumulated frequencies, which sum to ``1 << bits`` and are all 1 or more."""

    def __init__(self, known: np.ndarray, counts: np.ndarray) -> None:
        n = len(known)
        self.known = known
        self.bits = max(16, (2 * n).bit_length())
        self.weight_bits = min(12, 30 - self.bits)
        upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        spare = (1 << self.bits) - n
        edges = np.arange(n + 1) + upto * spare // max(int(upto[-1]), 1)
        self.start = edges[:-1].astype(np.int32)
        self.share = np.diff(edges).astype(np.int32)

    def slots(self) -> np.ndarray:
        """The place of the id that each unit of frequency belongs to."""
        return np.repeat(np.arange(len(self.known), dtype=np.int32), self.share)


def _first_weights() -> np.ndarray:
    """Weights of order 2 and order 1 before a block has shown any, by whether they agree and by both confidences."""
    first = np.zeros((2, 2, 4, 4), np.int32)
    for c2 in range(4):
        for c1 in range(4):
            a, b = c2 / (c2 + 1), c1 / (c1 + 3)
            # Where both foretell one id, order 2 has all the weight.
            first[0, 1, c2, c1] = round(_SURE * max(a, b))
            first[:, 0, c2, c1] = round(_SURE * a), round(_SURE * (1 - a) * b)
    return first.reshape(2, 32)


class _Model:
    """The cells and weights of all lanes; the first row of each array is order 2's, the second order 1's."""

    def __init__(self, lanes: int, order0: _Order0) -> None:
        self.order0 = order0
        self.bits, self.down = order0.bits, 16 - order0.weight_bits
        self.whole = np.int32(1 << order0.weight_bits)
        self.cells = np.zeros(2 * lanes << _CELLS, np.int32)
        self.weights = np.repeat(_first_weights()[:, None], lanes, axis=1).ravel()
        place = np.arange(2 * lanes, dtype=np.int64).reshape(2, lanes)
        self.first, self.first32 = place << _CELLS, place << 5

    def predict(self, n: int, before: np.ndarray, older: np.ndarray) -> None:
        """Sets what both orders say of the next id of the first ``n`` lanes, and the three weights."""
        mixed = np.empty((2, n), np.uint32)
        one = (before[:n].view(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        two = ((older[:n].view(np.uint32) + np.uint32(1)) * np.uint32(0x7FEB352D) ^ one >> np.uint32(3)) * np.uint32(0x846CA68B)
        mixed[1] = one
        np.bitwise_xor(two, two >> np.uint32(15), out=mixed[0])
        self.at = self.first[:, :n] + (mixed >> np.uint32(32 - _CELLS))
        self.tag = (mixed >> np.uint32(12)).view(np.int32) & 127
        self.cell = self.cells.take(self.at)
        self.sure = (self.cell & 3) * ((self.cell >> 2 & 127) == self.tag)
        self.said = self.cell >> 9
        self.agree = self.said[0] == self.said[1]
        self.where = self.first32[:, :n] + ((self.agree * np.int32(4) + self.sure[0]) * np.int32(4) + self.sure[1])
        self.had = self.weights.take(self.where)
        weight = self.had >> self.down
        self.w0 = self.whole - weight[0] - weight[1]
        self.units = weight << self.bits

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the interval of each lane's id begins, and how wide it is, out of ``1 << (bits + weight_bits)``."""
        self.right = self.said == x
        before, own = self.units * (self.said < x), self.units * self.right
        start = self.w0 * self.order0.start.take(x) + before[0] + before[1]
        return start, self.w0 * self.order0.share.take(x) + own[0] + own[1]

    def find(self, place: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """The ids in whose intervals the places lie."""
        said, units = self.said, self.units
        start = self.w0 * self.order0.start.take(said)
        start += units[::-1] * (said[::-1] < said)
        end = start + self.w0 * self.order0.share.take(said)
        end += units
        # Where both say one id, order 1 has no weight, and order 2's interval is the whole.
        over = place >= end
        inside = (place >= start) > over
        past = units * over
        x = slots.take(((place - past[0] - past[1]) / self.w0).astype(np.int32), mode="clip")
        np.copyto(x, said[1], where=inside[1])
        np.copyto(x, said[0], where=inside[0])
        return x

    def learn(self, x: np.ndarray) -> None:
        """Takes in each lane's id, after ``interval(x)``."""
        aim = self.right * np.int32(_SURE)
        aim[1] *= ~self.agree
        aim -= self.had
        aim >>= _RATE
        aim += self.had
        self.weights[self.where] = aim
        state = self.right * np.int32(4) + self.sure
        new = (x << 9) + (self.tag << 2) + 1
        change = _CHANGE.take(state)
        self.cells[self.at] = np.where(change == _NEW, new, self.cell + change)


def _encode_lanes(blocks: list[np.ndarray], order0: _Order0) -> list[bytes]:
    """``blocks`` of places in the group's table, from the longest to the shortest."""
    lanes = len(blocks)
    lengths = np.array([len(b) for b in blocks])
    ids = np.zeros((lengths[0], lanes), np.int32)
    for i, b in enumerate(blocks):
        ids[: len(b), i] = b
    model = _Model(lanes, order0)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, _FULL)
    # A word holds 16 bits, and carries until the end. Word 0 is only there for the first carry.
    out = np.zeros((lanes, lengths[0] * 2 + 6), np.uint32)
    flat, row = out.reshape(-1), out.shape[1]
    at = np.arange(lanes) * row
    shift = np.uint64(order0.bits + order0.weight_bits)
    before = older = np.zeros(lanes, np.int32)

    def put(who: np.ndarray) -> None:
        had = low.take(who)
        place = at.take(who)
        flat[place] += (had >> _48).astype(np.uint32)
        place += 1
        flat[place] = (had >> _32 & np.uint64(0xFFFF)).astype(np.uint32)
        at[who] = place
        low[who] = (had & np.uint64(0xFFFFFFFF)) << _16

    for t in range(lengths[0]):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        x = ids[t, :n]
        model.predict(n, before, older)
        start, own = model.interval(x)
        unit = width[:n] >> shift
        low[:n] += unit * start.view(np.uint32)
        np.multiply(unit, own.view(np.uint32), out=width[:n])
        model.learn(x)
        who = np.flatnonzero(width[:n] < _SMALL)
        while len(who):
            put(who)
            narrow = width.take(who) << _16
            width[who] = narrow
            who = who[narrow < _SMALL]
        before, older = x, before
    for _ in range(3):
        put(np.arange(lanes))
    for k in range(row - 1, 0, -1):
        out[:, k - 1] += out[:, k] >> 16
    return [out[i, 1 : at[i] - i * row + 1].astype("<u2").tobytes() for i in range(lanes)]


def _decode_lanes(parts: list[bytes], lengths: np.ndarray, order0: _Order0) -> list[np.ndarray]:
    lanes = len(parts)
    row = max(len(p) for p in parts) // 2 + 8
    words = np.zeros((lanes, row), np.uint16)
    for i, p in enumerate(parts):
        words[i, : len(p) // 2] = np.frombuffer(p, "<u2")
    code = words[:, 0].astype(np.uint64) << _32 | words[:, 1].astype(np.uint64) << _16 | words[:, 2]
    flat, at = words.reshape(-1), np.arange(lanes) * row + 3
    ends = np.arange(1, lanes + 1) * row - 1
    model, slots = _Model(lanes, order0), order0.slots()
    width = np.full(lanes, _FULL)
    ids = np.zeros((lengths[0], lanes), np.int32)
    shift = np.uint64(order0.bits + order0.weight_bits)
    last = float((1 << int(shift)) - 1)
    before = older = np.zeros(lanes, np.int32)
    for t in range(lengths[0]):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        model.predict(n, before, older)
        unit = width[:n] >> shift
        # Numbers of 48 bits at most, whose quotients of 53 bits round down to the whole ones.
        x = model.find(np.minimum(code[:n] / unit, last).astype(np.int32), slots)
        start, own = model.interval(x)
        code[:n] -= unit * start.view(np.uint32)
        np.multiply(unit, own.view(np.uint32), out=width[:n])
        model.learn(x)
        who = np.flatnonzero(width[:n] < _SMALL)
        while len(who):
            place = at.take(who)
            # A damaged block may ask for more words than it has; its checksum tells.
            code[who] = code.take(who) << _16 | flat.take(np.minimum(place, ends.take(who)))
            at[who] = place + 1
            narrow = np.maximum(width.take(who), np.uint64(1)) << _16
            width[who] = narrow
            who = who[narrow < _SMALL]
        ids[t, :n] = x
        before, older = x, before
    return [order0.known[ids[: lengths[i], i]] for i in range(lanes)]


def _places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids, each id's place among them, and how often each is there."""
    if int(ids.max()) >> 22:
        known, places, counts = np.unique(ids, return_inverse=True, return_counts=True)
        return known, places.astype(np.int32), counts
    counts = np.bincount(ids)
    known = np.flatnonzero(counts)
    return known.astype(np.uint32), (np.cumsum(counts > 0, dtype=np.int32) - np.int32(1)).take(ids), counts[known]


def _check(ids: np.ndarray, coded: bytes) -> int:
    return zlib.crc32(coded, zlib.crc32(ids.astype("<u4").tobytes()))


def _encode_group(ids: np.ndarray, block_ids: int) -> bytes:
    known, places, counts = _places(ids)
    table = zlib.compress(np.concatenate([np.diff(known, prepend=known[:1]), counts.astype(np.uint32)]).astype("<u4").tobytes() + known[:1].astype("<u4").tobytes())
    blocks = [places[i : i + block_ids] for i in range(0, len(ids), block_ids)]
    with np.errstate(over="ignore"):
        coded = _encode_lanes(blocks, _Order0(known, counts))
    rows = b"".join(
        _BLOCK.pack(len(b), len(c), _check(ids[i * block_ids : i * block_ids + len(b)], c))
        for i, (b, c) in enumerate(zip(blocks, coded, strict=True))
    )
    return _GROUP.pack(len(blocks), len(known), len(table), zlib.crc32(table)) + table + rows + b"".join(coded)


def encode(ids: np.ndarray, block_ids: int = 1024) -> bytes:
    """The ids (unsigned 32-bit) as a header and groups: a table of ids, a table of blocks and the blocks."""
    ids = np.ascontiguousarray(ids, np.uint32)
    # Groups of one size: a small last one would have few lanes.
    block_ids = min(block_ids, GROUP_IDS // 2)
    parts = -(-len(ids) // (GROUP_IDS - block_ids))
    step = -(-len(ids) // max(parts, 1) // block_ids) * block_ids or block_ids
    groups = [_encode_group(ids[i : i + step], block_ids) for i in range(0, len(ids), step)]
    return _HEAD.pack(MAGIC, VERSION, 0, block_ids, len(groups)) + b"".join(groups)


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, size: int) -> bytes:
        self.at += size
        if self.at > len(self.data):
            raise ValueError("the file is cut short")
        return self.data[self.at - size : self.at]


def _decode_group(source: _Reader) -> np.ndarray:
    n, distinct, size, crc = _GROUP.unpack(source.take(_GROUP.size))
    table = source.take(size)
    if zlib.crc32(table) != crc:
        raise ValueError("a table of ids is damaged")
    numbers = np.frombuffer(zlib.decompress(table), "<u4")
    known = np.cumsum(numbers[:distinct], dtype=np.uint32) + numbers[-1]
    rows = [_BLOCK.unpack(source.take(_BLOCK.size)) for _ in range(n)]
    parts = [source.take(row[1]) for row in rows]
    with np.errstate(over="ignore"):
        blocks = _decode_lanes(parts, np.array([row[0] for row in rows]), _Order0(known, numbers[distinct:-1]))
    for i, (ids, part, (_, _, crc)) in enumerate(zip(blocks, parts, rows, strict=True)):
        if _check(ids, part) != crc:
            raise ValueError(f"block {i} is damaged")
    return np.concatenate(blocks)


def decode(data: bytes) -> np.ndarray:
    """What ``encode`` was given; a block or table whose checksum differs raises ValueError."""
    source = _Reader(data)
    magic, version, _, _, groups = _HEAD.unpack(source.take(_HEAD.size))
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a file of coded ids")
    out = [_decode_group(source) for _ in range(groups)]
    if source.at != len(data):
        raise ValueError("there is more in the file than its header says")
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
