"""Adaptive context-mixing range coder for token ids.

A block is coded on its own: all models start anew and a checksum covers it. Its ids are split into lanes of
equal length that are coded in step, one id per lane at a time, so each step is a few array operations; lanes share the
models, which learn from all ids of a step once it is coded. The decoder repeats the same steps.

Predictions for the next id of a lane:

- order 2: the id that followed the last two ids before, with a confidence of 0 to 3;
- order 1: the same after the last id;
- order 0: adaptive frequencies of the ids that neither of these foresaw.

The mixer: confidences, and whether both agree, form a context with adaptive odds of "order 2 is right", "order 1
is right", "neither". A range coder with 48-bit intervals codes that choice, then, if neither, the id by order 0.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"IDB1"
#: Most lanes of a block, and least steps before another lane is opened.
LANES, LEAST_STEPS = 4096, 128
#: Largest block.
BLOCK_IDS = 1 << 22
HASH_BITS = 18
#: Sum of the odds in a mixing context.
ODDS = 1 << 16
#: What an id's count rises by, and where all counts are halved.
STEP, LIMIT = 32, 1 << 22
_HEADER = struct.Struct("<4sIIIII")
_U = np.uint64
_THREE = np.array([0, 3], np.int32)
_MISS = np.array([[2, 1], [0, 0]], np.int32).ravel()


#: Confidence after a hit (second row) or a miss (first).
_SURE = np.array([[0, 0, 1, 1], [1, 2, 3, 3]], np.int32).ravel()


def _revised(predicted: np.ndarray, sure: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Table entries after ``ids`` came: a prediction stays until its confidence is 0."""
    return np.where(sure > 0, predicted, ids) * 4 + _SURE[sure + 4 * (predicted == ids)]


class Models:
    """State that coder and decoder share, for ids below ``n_ids``."""

    def __init__(self, n_ids: int, lanes: int):
        self.n_ids = n_ids
        # predicted id * 4 + confidence
        self.follow2 = np.zeros(1 << HASH_BITS, np.int32)
        self.follow1 = np.zeros(n_ids, np.int32)
        self.before1 = np.zeros(lanes, np.int32)
        self.before2 = np.zeros(lanes, np.int32)
        self.counts = np.ones(n_ids, np.int64)
        self.upto = np.arange(n_ids + 1, dtype=np.int64)
        self.seen: list[np.ndarray] = []
        self.steps = 0
        self.choices = np.tile(np.array([2, 1, 1], np.int64), 32)
        self._odds()

    def _odds(self) -> None:
        c = self.choices.reshape(32, 3)
        share = 1 + c * (ODDS - 3) // c.sum(1, keepdims=True)
        share[:, 2] = ODDS - share[:, 0] - share[:, 1]
        starts = np.zeros_like(share)
        starts[:, 1:] = np.cumsum(share[:, :2], 1)
        self.starts, self.shares = starts.ravel().astype(_U), share.ravel().astype(_U)

    def predict(self) -> None:
        self.slot = ((self.before2.astype(np.uint32) * np.uint32(2654435761)) ^ (self.before1.astype(np.uint32) * np.uint32(2246822519))) >> np.uint32(32 - HASH_BITS)
        known2, known1 = self.follow2[self.slot], self.follow1[self.before1]
        self.p2, self.c2 = known2 >> 2, known2 & 3
        self.p1, self.c1 = known1 >> 2, known1 & 3
        self.context = 24 * self.c2 + 6 * self.c1 + _THREE[(self.p1 == self.p2).view(np.int8)]

    def learn(self, ids: np.ndarray, choice: np.ndarray, missed: np.ndarray) -> None:
        """``choice``: 0, 1 or 2 for each lane; ``missed``: the ids that neither prediction foresaw."""
        self.follow2[self.slot] = _revised(self.p2, self.c2, ids)
        self.follow1[self.before1] = _revised(self.p1, self.c1, ids)
        self.before2, self.before1 = self.before1, ids
        self.choices += np.bincount(self.context + choice, minlength=96)
        self.seen.append(missed)
        self.steps += 1
        if self.steps & 3 == 0 or self.steps < 4:
            self._odds()
        if self.steps & 31 == 0 or self.steps & (self.steps - 1) == 0:
            self.counts += STEP * np.bincount(np.concatenate(self.seen), minlength=self.n_ids)
            self.seen.clear()
            if self.counts.sum() > LIMIT:
                self.counts = (self.counts >> 1) | 1
            np.cumsum(self.counts, out=self.upto[1:])


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // LEAST_STEPS))
    steps = -(-n // lanes)
    return -(-n // steps) if n else 0, steps


def _lanes(ids: np.ndarray) -> np.ndarray:
    lanes, steps = _shape(len(ids))
    padded = np.zeros(lanes * steps, np.int32)
    padded[: len(ids)] = ids
    return np.ascontiguousarray(padded.reshape(lanes, steps).T)


class _Encoder:
    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, 1 << 48, _U)
        # a step takes at most 16 + 22 bits, so under 2.5 words; words of a place lie together, as lanes move on alike
        self.words = np.zeros((5 * steps // 2 + 8) * lanes, np.int32)
        self.lanes, self.at = lanes, np.arange(lanes)

    def _emit(self, lanes: np.ndarray) -> None:
        low = self.low[lanes]
        self.words[self.at[lanes]] = (low >> _U(32)).astype(np.int32)
        self.at[lanes] += self.lanes
        self.low[lanes] = (low & _U(0xFFFFFFFF)) << _U(16)
        self.range[lanes] <<= _U(16)

    def _renew(self) -> None:
        while len(short := np.flatnonzero(self.range < _U(1 << 32))):
            self._emit(short)

    def all(self, start: np.ndarray, share: np.ndarray) -> None:
        r = self.range >> _U(16)
        self.low += start * r
        self.range = share * r
        self._renew()

    def some(self, lanes: np.ndarray, start: np.ndarray, share: np.ndarray, total: int) -> None:
        r = self.range[lanes] // _U(total)
        self.low[lanes] += start * r
        self.range[lanes] = share * r
        self._renew()

    def streams(self) -> list[bytes]:
        everyone = np.arange(len(self.low))
        for _ in range(3):
            self._emit(everyone)
        words, ends = self.words.reshape(-1, self.lanes), self.at // self.lanes
        for k in range(int(ends.max()) - 1, 0, -1):  # a word over 16 bits carries into the one before
            words[k - 1] += words[k] >> 16
        words = np.ascontiguousarray((words & 0xFFFF).astype("<u2").T)
        return [words[i, : ends[i]].tobytes() for i in range(self.lanes)]


class _Decoder:
    def __init__(self, streams: list[bytes]):
        lanes = len(streams)
        longest = max(map(len, streams)) // 2 + 8
        words = np.zeros((lanes, longest), "<u2")
        for i, s in enumerate(streams):
            words[i, : len(s) // 2] = np.frombuffer(s, "<u2")
        self.words = words.T.ravel()
        self.lanes, self.at = lanes, np.arange(lanes)
        self.code, self.range = np.zeros(lanes, _U), np.full(lanes, 1 << 48, _U)
        for _ in range(3):
            self.code = (self.code << _U(16)) | self.words[self.at]
            self.at += lanes

    def _renew(self) -> None:
        while len(short := np.flatnonzero(self.range < _U(1 << 32))):
            self.code[short] = (self.code[short] << _U(16)) | self.words[self.at[short]]
            self.at[short] += self.lanes
            self.range[short] <<= _U(16)

    def value_all(self) -> np.ndarray:
        self.r = self.range >> _U(16)
        return self.code // self.r

    def take_all(self, start: np.ndarray, share: np.ndarray) -> None:
        self.code -= start * self.r
        self.range = share * self.r
        self._renew()

    def value_some(self, lanes: np.ndarray, total: int) -> np.ndarray:
        self.r = self.range[lanes] // _U(total)
        return np.minimum(self.code[lanes] // self.r, _U(total - 1))

    def take_some(self, lanes: np.ndarray, start: np.ndarray, share: np.ndarray) -> None:
        self.code[lanes] -= start * self.r
        self.range[lanes] = share * self.r
        self._renew()


def encode(ids: np.ndarray) -> bytes:
    """A block of at most ``BLOCK_IDS`` ids below 2**29."""
    n = len(ids)
    if n > BLOCK_IDS:
        raise ValueError("too many ids for a block")
    n_ids = int(ids.max()) + 1 if n else 0
    streams: list[bytes] = []
    if n:
        steps = _lanes(ids)
        models, coder = Models(n_ids, steps.shape[1]), _Encoder(steps.shape[1], steps.shape[0])
        for now in steps:
            models.predict()
            choice = _MISS[2 * (models.p2 == now).view(np.int8) + (models.p1 == now).view(np.int8)]
            key = models.context + choice
            coder.all(models.starts[key], models.shares[key])
            lanes = np.flatnonzero(choice == 2)
            missed = now[lanes]
            if len(lanes):
                start = models.upto[missed]
                coder.some(lanes, start.astype(_U), (models.upto[missed + 1] - start).astype(_U), int(models.upto[-1]))
            models.learn(now, choice, missed)
        streams = coder.streams()
    body = np.array([len(s) for s in streams], "<u4").tobytes() + b"".join(streams)
    raw = np.ascontiguousarray(ids, "<u4").tobytes()
    head = _HEADER.pack(MAGIC, n, n_ids, len(body), zlib.crc32(raw), zlib.crc32(body))
    return head + body + struct.pack("<I", zlib.crc32(head))


def block_size(data: memoryview) -> int:
    """Bytes of the block that ``data`` begins with."""
    return _HEADER.size + _HEADER.unpack_from(data)[3] + 4


def decode(data: memoryview | bytes) -> np.ndarray:
    """The ids of a block as unsigned 32-bit integers; ValueError if a checksum doesn't fit."""
    data = memoryview(data)
    if len(data) < _HEADER.size + 4 or bytes(data[:4]) != MAGIC:
        raise ValueError("not a block of ids")
    _, n, n_ids, length, ids_crc, body_crc = _HEADER.unpack_from(data)
    body = data[_HEADER.size : _HEADER.size + length]
    if struct.pack("<I", zlib.crc32(data[: _HEADER.size])) != bytes(data[_HEADER.size + length : _HEADER.size + length + 4]) or zlib.crc32(body) != body_crc:
        raise ValueError("a block's checksum doesn't fit")
    if not n:
        return np.zeros(0, "<u4")
    lanes, steps = _shape(n)
    ends = np.cumsum(np.frombuffer(body[: 4 * lanes], "<u4")) + 4 * lanes
    streams = [bytes(body[a:b]) for a, b in zip([4 * lanes, *ends[:-1]], ends, strict=True)]
    models, coder = Models(n_ids, lanes), _Decoder(streams)
    out = np.empty((steps, lanes), np.int32)
    for t in range(steps):
        models.predict()
        value = coder.value_all()
        first, second = models.shares[models.context], models.starts[models.context + 2]
        choice = (value >= first).view(np.int8) + (value >= second).view(np.int8)
        key = models.context + choice
        coder.take_all(models.starts[key], models.shares[key])
        now = np.where(choice == 0, models.p2, models.p1)
        lanes_ = np.flatnonzero(choice == 2)
        missed = now[:0]
        if len(lanes_):
            value = coder.value_some(lanes_, int(models.upto[-1])).astype(np.int64)
            missed = (np.searchsorted(models.upto, value, "right") - 1).astype(np.int32)
            start = models.upto[missed]
            coder.take_some(lanes_, start.astype(_U), (models.upto[missed + 1] - start).astype(_U))
            now[lanes_] = missed
        models.learn(now, choice, missed)
        out[t] = now
    ids = np.ascontiguousarray(out.T).ravel()[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != ids_crc:
        raise ValueError("decoded ids don't fit their checksum")
    return ids
