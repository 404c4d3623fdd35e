"""Random access to files by path or address: local ones, http(s) by range requests, and what pyarrow's file systems know."""

from __future__ import annotations

import io
import os
import urllib.parse
import urllib.request

#: Bytes of one range request at least.
BUFFER = 1 << 17


class HttpRange(io.RawIOBase):
    """A file behind http or https, read by range requests through a buffer. Certificates are verified."""

    def __init__(self, url: str, buffer: int = BUFFER, timeout: float = 60.0):
        self.url, self.buffer, self.timeout = url, buffer, timeout
        self.at, self.begin, self.data = 0, 0, b""
        self.size = self._size()

    def _ask(self, first: int, last: int):
        request = urllib.request.Request(self.url, headers={"Range": f"bytes={first}-{last}"})
        return urllib.request.urlopen(request, timeout=self.timeout)  # noqa: S310

    def _size(self) -> int:
        with self._ask(0, 0) as r:
            if r.status != 206:
                raise OSError(f"{self.url}: the server gives no ranges")
            return int(r.headers["Content-Range"].rpartition("/")[2])

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = os.SEEK_SET) -> int:
        self.at = max(0, offset + (self.at if whence == os.SEEK_CUR else self.size if whence == os.SEEK_END else 0))
        return self.at

    def read(self, size: int = -1) -> bytes:
        n = max(0, self.size - self.at if size is None or size < 0 else min(size, self.size - self.at))
        if not n:
            return b""
        if not self.begin <= self.at <= self.at + n <= self.begin + len(self.data):
            with self._ask(self.at, min(self.at + max(n, self.buffer), self.size) - 1) as r:
                self.begin, self.data = self.at, r.read()
            if len(self.data) < n:
                raise OSError(f"{self.url}: {len(self.data)} bytes instead of {n}")
        out = self.data[self.at - self.begin : self.at - self.begin + n]
        self.at += n
        return out

    def readinto(self, b) -> int:
        data = self.read(len(b))
        b[: len(data)] = data
        return len(data)


def local_path(path: str) -> str | None:
    """The path of a local file (plain or file:), None for any other address."""
    if path.startswith("file:"):
        return urllib.parse.unquote(urllib.parse.urlsplit(path).path)
    return None if "://" in path else path


def open_binary(path: str):
    """The file opened for reading at any place."""
    local = local_path(path)
    if local is not None:
        return open(local, "rb")
    if path.startswith(("http://", "https://")):
        return HttpRange(path)
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_input_file(at)


def file_size(path: str) -> int:
    local = local_path(path)
    if local is not None:
        return os.path.getsize(local)
    with open_binary(path) as f:
        return f.seek(0, os.SEEK_END) if isinstance(f, HttpRange) else f.size()


def exists(path: str) -> bool:
    local = local_path(path)
    if local is not None:
        return os.path.exists(local)
    try:
        open_binary(path).close()
    except OSError:
        return False
    return True
