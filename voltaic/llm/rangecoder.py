"""Adaptive context-mixing range coder for token ids, in numpy.

A block's ids are laid out in lanes, each with a range coder of its own; all lanes share one model and advance together.
The model predicts one id from the last two ids (order 2) and one from the last id (order 1), with confidences, and has a
distribution of all ids so far (order 0). How often the predictions of each confidence came true so far gives
the weights by which the three are mixed; the coder's interval is [order 2 | order 1 | order 0]. The model learns from all
lanes after each step and starts anew with each block, so blocks decode alone. Blocks carry a CRC-32.

A lane's state: ``low`` and ``range`` of 48 bits, words of 16 bits; carries go to the word before and are
propagated once, at the end.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block at most; together with the 65,536 ids that can be, they must stay under 2**22.
BLOCK = 1 << 21
LANES, STEPS = 4096, 256
#: Bits of a lane's interval, and of the order-0 part at least: 1/64 of the interval is always left to it, so every id can be coded.
_TOTAL, _ZERO = 28, 22
_LOW = (1 << 48) - 1
_LEAST = 1 << 32
_HEAD = struct.Struct("<4sIIIII")
_MAGIC = b"VCM2"
#: The order-0 distribution is renewed after these steps and then every 16th.
_RENEW = {1, 2, 3, 4, 6, 8, 12}


class _Model:
    def __init__(self, ids: int, lanes: int, decodes: bool = False) -> None:
        self.ids, self.decodes = ids, decodes
        self.first, self.first_sure = np.zeros(ids, np.int32), np.zeros(ids, np.int8)
        self.second, self.second_sure = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int8)
        self.one, self.two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.counts = np.ones(ids, np.int64)
        # By confidences and agreement of the two predictions: seen, order 2 right, order 1 right.
        self.seen, self.right2, self.right1 = np.full(32, 8, np.int64), np.ones(32, np.int64), np.ones(32, np.int64)
        self.sums = np.zeros(ids + 1, np.int64)
        self.step = 0
        self.renew()

    def renew(self) -> None:
        np.cumsum(self.counts, out=self.sums[1:])
        self.sums = (self.sums << _ZERO) // self.sums[-1]
        if self.decodes:  # the id at every 16th place
            self.places = np.repeat(np.arange(self.ids), np.diff(-(-self.sums // 16)))

    def find(self, place: np.ndarray) -> np.ndarray:
        """The ids whose order-0 intervals hold the places."""
        out = self.places[place >> 4]
        more = np.flatnonzero(self.sums[out + 1] <= place)
        while len(more):
            out[more] += 1
            more = more[self.sums[out[more] + 1] <= place[more]]
        return out

    def predict(self) -> None:
        """Predictions p2, p1 and the widths a, b of their intervals for every lane."""
        self.at2 = ((self.one * 0x9E3779B1 + self.two * 0x85EBCA6B) >> 9) & 0x3FFFF
        self.p2, self.s2 = self.second[self.at2], self.second_sure[self.at2]
        self.p1, self.s1 = self.first[self.one], self.first_sure[self.one]
        self.agree = self.p1 == self.p2
        self.context = self.s2 * 8 + self.s1 * 2 + self.agree
        # Both together were right less often than seen, so the rest stays over 1 << _ZERO.
        most = (1 << _TOTAL) - (1 << _ZERO)
        self.a = (most * self.right2 // self.seen)[self.context]
        self.b = (most * self.right1 // self.seen)[self.context]

    def update(self, x: np.ndarray) -> None:
        n = len(x)
        hit2, hit1 = self.p2[:n] == x, self.p1[:n] == x
        context = self.context[:n]
        self.seen += np.bincount(context, minlength=32)
        self.right2 += np.bincount(context[hit2], minlength=32)
        self.right1 += np.bincount(context[hit1 & ~self.agree[:n]], minlength=32)
        for at, pred, sure, hit, table, conf in ((self.at2[:n], self.p2[:n], self.s2[:n], hit2, self.second, self.second_sure), (self.one[:n], self.p1[:n], self.s1[:n], hit1, self.first, self.first_sure)):
            table[at] = np.where(hit | (sure > 0), pred, x)
            conf[at] = np.where(hit, np.minimum(sure + 1, 3), np.maximum(sure - 1, 0))
        np.add.at(self.counts, x, 1)
        self.step += 1
        if self.step in _RENEW or not self.step % 16:
            self.renew()
        self.two, self.one = self.one[:n], x


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // STEPS))
    return lanes, -(-n // lanes)


def encode_block(ids: np.ndarray, alphabet: int) -> bytes:
    """``ids``, all under ``alphabet``, as one block."""
    n = len(ids)
    assert n <= BLOCK and alphabet <= 1 << 16
    if not n:
        return _HEAD.pack(_MAGIC, 0, 0, alphabet, 0, 0)
    lanes, steps = _shape(n)
    # Lane k has ids[k * steps : (k + 1) * steps]; the last lanes may be shorter, so live lanes come first.
    padded = np.zeros(lanes * steps, np.int64)
    padded[:n] = ids
    grid = padded.reshape(lanes, steps)
    lengths = np.clip(n - np.arange(lanes) * steps, 0, steps)
    columns = np.ascontiguousarray(grid.T)
    model = _Model(alphabet, lanes)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    width = 3 * steps + 8
    out, put = np.zeros(lanes * width, np.int32), np.arange(lanes) * width + 1  # word 0 takes a carry out of nothing
    live_at = lanes - np.searchsorted(lengths[::-1], np.arange(steps), side="right")
    for k in range(steps):
        live = int(live_at[k])
        if live < len(model.one):
            model.one, model.two = model.one[:live], model.two[:live]
        x = columns[k, :live]
        model.predict()
        rest = (1 << _TOTAL) - model.a - model.b
        begin = (rest * model.sums[x]) >> _ZERO
        freq = ((rest * model.sums[x + 1]) >> _ZERO) - begin
        begin += model.a + model.b
        one = model.p1 == x
        begin, freq = np.where(one, model.a, begin), np.where(one, model.b, freq)
        two = model.p2 == x
        begin, freq = np.where(two, 0, begin), np.where(two, model.a, freq)
        lo, sp = low[:live], span[:live]
        r = sp >> _TOTAL
        lo += r * begin
        np.multiply(r, freq, out=sp)
        over = np.flatnonzero(lo > _LOW)
        if len(over):
            out[put[over] - 1] += 1
            lo[over] &= _LOW
        while len(few := np.flatnonzero(sp < _LEAST)):
            some = lo[few]
            out[put[few]] = some >> 32
            put[few] += 1
            lo[few] = (some & (_LEAST - 1)) << 16
            sp[few] <<= 16
        model.update(x)
    for shift in (32, 16, 0):
        out[put] = (low >> shift) & 0xFFFF
        put += 1
    words = out.reshape(lanes, width)
    sizes = put - np.arange(lanes) * width
    for k in range(int(sizes.max()) - 1, 0, -1):
        words[:, k - 1] += words[:, k] >> 16
    flat = (words & 0xFFFF).astype("<u2")
    keep = (np.arange(width) < sizes[:, None]) & (np.arange(width) > 0)
    body = (sizes - 1).astype("<u4").tobytes() + flat[keep].tobytes()
    return _HEAD.pack(_MAGIC, n, lanes, alphabet, len(body), zlib.crc32(body)) + body


def decode_block(raw: memoryview | bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block at ``at``, and where the next begins."""
    magic, n, lanes, alphabet, size, crc = _HEAD.unpack_from(raw, at)
    body = memoryview(raw)[at + _HEAD.size : at + _HEAD.size + size]
    if magic != _MAGIC or len(body) != size or zlib.crc32(body) != crc:
        raise ValueError(f"damaged block at byte {at}")
    end = at + _HEAD.size + size
    if not n:
        return np.zeros(0, np.int64), end
    steps = -(-n // lanes)
    sizes = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    words = np.append(np.frombuffer(body, "<u2", offset=4 * lanes).astype(np.int64), np.zeros(4, np.int64))
    get = np.cumsum(sizes) - sizes
    lengths = np.clip(n - np.arange(lanes) * steps, 0, steps)
    live_at = lanes - np.searchsorted(lengths[::-1], np.arange(steps), side="right")
    code = words[get] << 32 | words[get + 1] << 16 | words[get + 2]
    get += 3
    span = np.full(lanes, 1 << 48, np.int64)
    model = _Model(alphabet, lanes, decodes=True)
    columns = np.zeros((steps, lanes), np.int64)
    for k in range(steps):
        live = int(live_at[k])
        if live < len(model.one):
            model.one, model.two = model.one[:live], model.two[:live]
        model.predict()
        a, b = model.a, model.b
        ab = a + b
        rest = (1 << _TOTAL) - ab
        co, sp = code[:live], span[:live]
        r = sp >> _TOTAL
        value = np.minimum(co // r, (1 << _TOTAL) - 1)
        zero = np.flatnonzero(value >= ab)
        x = np.where(value < a, model.p2, model.p1).astype(np.int64)
        begin, freq = np.where(value < a, 0, a), np.where(value < a, a, b)
        scale = rest[zero]
        found = model.find((((value[zero] - ab[zero] + 1) << _ZERO) - 1) // scale)
        x[zero] = found
        start = (scale * model.sums[found]) >> _ZERO
        freq[zero] = ((scale * model.sums[found + 1]) >> _ZERO) - start
        begin[zero] = start + ab[zero]
        co -= r * begin
        np.multiply(r, freq, out=sp)
        while len(few := np.flatnonzero(sp < _LEAST)):
            co[few] = co[few] << 16 | words[get[few]]
            get[few] += 1
            sp[few] <<= 16
        columns[k, :live] = x
        model.update(x)
    return np.ascontiguousarray(columns.T).reshape(-1)[:n], end
