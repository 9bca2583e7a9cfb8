"""A cuckoo filter over 64-bit hashes, worked on whole arrays."""

from __future__ import annotations

import numpy as np

from sievework.llm.bytesets import mix

_SLOTS = 4


class CuckooFilter:
    """Approximate set with deletion: no false negatives, about 0.01 % false positives.

    A hash has a 16-bit print and two buckets of four slots.  Hashes that find no
    slot after many moves make the table double its size, which needs the hashes
    again, so ``insert`` raises OverflowError and the caller builds anew.
    """

    def __init__(self, buckets: int, slots: np.ndarray | None = None) -> None:
        self.buckets = buckets
        self.slots = np.zeros((buckets, _SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def sized_for(cls, n: int) -> CuckooFilter:
        return cls(1 << max(4, int(np.ceil(np.log2(max(1, n) / (0.6 * _SLOTS))))))

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        n = len(hashes)
        while True:
            made = cls.sized_for(n)
            try:
                made.insert(hashes)
                return made
            except OverflowError:
                n *= 2

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        slots = np.frombuffer(data, np.uint16).reshape(-1, _SLOTS).copy()
        return cls(len(slots), slots)

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def _prints(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = ((hashes >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        return prints, (mix(hashes) & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(prints.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def _place(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put prints into free slots of their bucket; True where one was left."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
        rank = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
        free = self.slots[b] == 0
        nth = np.cumsum(free, axis=1) - 1
        hit = free & (nth == rank[:, None])
        row, slot = np.nonzero(hit)
        self.slots[b[row], slot] = prints[order[row]]
        done = np.zeros(len(b), bool)
        done[order[row]] = True
        return done

    def insert(self, hashes: np.ndarray) -> None:
        prints, bucket = self._prints(hashes)
        done = self._place(prints, bucket)
        prints, bucket = prints[~done], self._other(bucket[~done], prints[~done])
        for turn in range(500):
            done = self._place(prints, bucket)
            prints, bucket = prints[~done], bucket[~done]
            if not len(prints):
                return
            one = np.unique(bucket, return_index=True)[1]  # one move in a bucket at a time
            slot = (prints[one].astype(np.int64) + turn) % _SLOTS
            out = self.slots[bucket[one], slot]
            self.slots[bucket[one], slot] = prints[one]
            prints[one] = out
            bucket[one] = self._other(bucket[one], out)
        raise OverflowError("the filter is full")

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, bucket = self._prints(hashes)
        near, far = self.slots[bucket], self.slots[self._other(bucket, prints)]
        return (near == prints[:, None]).any(axis=1) | (far == prints[:, None]).any(axis=1)

    def delete(self, hashes: np.ndarray) -> None:
        """Remove one copy of each hash's print; only hashes that were inserted may be given."""
        prints, bucket = self._prints(hashes)
        for b, p, o in zip(bucket, prints, self._other(bucket, prints)):
            for place in (b, o):
                at = np.flatnonzero(self.slots[place] == p)
                if len(at):
                    self.slots[place, at[0]] = 0
                    break
