"""Block-compressed files (gzip members that tell their own size) read in parts: each part starts at its first whole block, and a record belongs to the part in which the block of its first byte begins."""

from __future__ import annotations

import struct
import zlib
from collections import deque

#: Fixed values of the format: how a member with extra fields begins, the name of the field that holds its size, the largest member.
_MAGIC, _FIELD, _LARGEST = b"\x1f\x8b\x08\x04", b"BC", 1 << 16


def member_size(head: bytes) -> int | None:
    """The size of the member that ``head`` begins with, or None if it is none that tells it."""
    if len(head) < 18 or head[:4] != _MAGIC:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == _FIELD and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def is_blocked(stream) -> bool:
    stream.seek(0)
    return member_size(stream.read(_LARGEST)) is not None


def first_member(stream, start: int) -> int | None:
    """Where the first member at or after ``start`` begins: one that ends the file or is followed by another."""
    stream.seek(start)
    window = stream.read(2 * _LARGEST + 64)
    at = -1
    while (at := window.find(_MAGIC, at + 1)) >= 0:
        size = member_size(window[at : at + 512])
        if size:
            stream.seek(start + at + size)
            follows = stream.read(512)
            if not follows or member_size(follows):
                return start + at
    return None


class Blocked:
    """The decompressed bytes from the first member at or after ``start`` on, with the member that each of them is from."""

    def __init__(self, stream, start: int):
        self.stream, self.data, self.at = stream, bytearray(), 0
        self.starts: deque[tuple[int, int]] = deque()  # (place in data, where the member begins in the file)
        self.before = b"\n"  # the byte before the first one
        self.next = 0
        if start:
            self.next = first_member(stream, max(0, start - 2 * _LARGEST)) if start > 2 * _LARGEST else 0
            self.next = -1 if self.next is None else self.next
            while 0 <= self.next < start:
                self.before = bytes(self._member()[-1:]) or self.before

    def _member(self) -> bytes:
        self.stream.seek(self.next)
        head = self.stream.read(_LARGEST)
        size = member_size(head)
        if not head:
            self.next = -1
            return b""
        if size is None:
            raise ValueError("a block-compressed file is cut off or malformed")
        self.next += size
        start = 12 + struct.unpack_from("<H", head, 10)[0]
        return zlib.decompress(head[start : size - 8], -15)

    def more(self) -> bool:
        """Adds a member's bytes; whether there was one."""
        if self.next < 0:
            return False
        place, found = self.next, self._member()
        if self.next < 0:
            return False
        if found:
            self.starts.append((len(self.data), place))
            self.data += found
        return True

    def held(self, n: int) -> bool:
        """Whether there are ``n`` bytes from here on."""
        while len(self.data) - self.at < n:
            if not self.more():
                return False
        return True

    def member(self) -> int | None:
        """Where the member begins that the byte here is from; None at the end."""
        if self.at > 1 << 22:  # forget what has been read
            del self.data[: self.at]
            self.starts = deque((place - self.at, member) for place, member in self.starts)
            self.at = 0
        if not self.held(1):
            return None
        while len(self.starts) > 1 and self.starts[1][0] <= self.at:
            self.starts.popleft()
        return self.starts[0][1]

    def take(self, n: int) -> bytes:
        if not self.held(n):
            raise ValueError("a block-compressed file is cut off")
        out = bytes(self.data[self.at : self.at + n])
        self.at += n
        return out

    def line(self) -> bytes:
        """The rest of a line, with its end if it has one."""
        looked = self.at
        while (end := self.data.find(b"\n", looked)) < 0:
            looked = len(self.data)
            if not self.more():
                return self.take(len(self.data) - self.at)
        return self.take(end + 1 - self.at)
