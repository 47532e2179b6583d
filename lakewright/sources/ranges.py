"""Reading parts of a large file: blocks, a prefetched tail and growing read-ahead over a function that gives byte ranges."""

from __future__ import annotations

import io
from collections.abc import Callable

#: Bytes of a block, of the tail that is read first, and of the longest read-ahead; archives up to WHOLE are read at once.
BLOCK, TAIL, AHEAD, WHOLE = 256 << 10, 1 << 20, 4 << 20, 8 << 20


class RangeFile(io.RawIOBase):
    """A file of `size` bytes of which fetch(start, end) gives a part. What has been read stays, in blocks.

    The end, where an archive keeps its directory, comes first; reads that go on where the last one ended fetch twice as much each time.
    """

    def __init__(self, size: int, fetch: Callable[[int, int], bytes]):
        self.size, self._fetch, self.requests, self.at = size, fetch, 0, 0
        self.blocks: dict[int, bytes] = {}
        self._next, self._ahead = -1, BLOCK
        if size:
            self._get(max(0, size - TAIL) // BLOCK, -(-size // BLOCK))

    def _get(self, first: int, end: int) -> None:
        """Blocks first to end, in one request."""
        data = self._fetch(first * BLOCK, min(end * BLOCK, self.size))
        if len(data) != min(end * BLOCK, self.size) - first * BLOCK:
            raise OSError("a range came short")
        self.requests += 1
        for k in range(first, end):
            self.blocks[k] = data[(k - first) * BLOCK : (k - first + 1) * BLOCK]

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = max(0, offset + (0 if whence == io.SEEK_SET else self.at if whence == io.SEEK_CUR else self.size))
        return self.at

    def readinto(self, into) -> int:
        end = min(self.at + len(into), self.size)
        if end <= self.at:
            return 0
        first, last = self.at // BLOCK, -(-end // BLOCK)
        missing = [k for k in range(first, last) if k not in self.blocks]
        if missing:
            self._ahead = min(2 * self._ahead, AHEAD) if missing[0] == self._next else BLOCK
            stop = max(missing[-1] + 1, missing[0] + self._ahead // BLOCK)
            stop = min(stop, -(-self.size // BLOCK))
            while stop - 1 > missing[-1] and stop - 1 in self.blocks:  # not what is there already
                stop -= 1
            self._get(missing[0], stop)
            self._next = stop
        data = b"".join(self.blocks[k] for k in range(first, last))[self.at - first * BLOCK : end - first * BLOCK]
        into[: len(data)] = data
        self.at += len(data)
        return len(data)


def opened(uri: str):
    """(a file to read archives from, a function that closes it) of a path on any file system that Arrow knows; small ones are read whole."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    source = system.open_input_file(path)
    size = source.size()
    if size <= WHOLE:
        data = io.BytesIO(source.read_at(size, 0))
        source.close()
        return data, data.close
    return io.BufferedReader(RangeFile(size, lambda a, b: source.read_at(b - a, a)), BLOCK), source.close
