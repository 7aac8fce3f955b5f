"""Ranged reads and whole writes in local folders, HTTP servers and the stores that pyarrow knows."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
import uuid

from pyarrow import fs as pafs


class HttpReader:
    """Ranges of an HTTP resource: blocks of 64 KiB, retries of passing faults, one version throughout.

    A server must answer ranges with 206, and a changed ETag is an error, as mixed versions decode to nonsense.
    """

    BLOCK, RETRIES, WAIT = 1 << 16, 4, 0.2

    def __init__(self, url: str, timeout: float = 30.0):
        self.url, self.timeout, self.blocks, self.requests = url, timeout, {}, 0
        self.tag = None
        data, total = self._get(0, self.BLOCK)
        self.size, self.blocks[0] = total, data

    def _get(self, start: int, end: int) -> tuple[bytes, int]:
        for attempt in range(self.RETRIES + 1):
            try:
                headers = {"Range": f"bytes={start}-{end - 1}"} | ({"If-Match": self.tag} if self.tag else {})
                self.requests += 1
                with urllib.request.urlopen(urllib.request.Request(self.url, headers=headers), timeout=self.timeout) as r:
                    if r.status != 206:
                        raise OSError(f"{self.url}: status {r.status} instead of 206, the server ignores ranges")
                    tag = r.headers.get("ETag")
                    if self.tag and tag and tag != self.tag:
                        raise OSError(f"{self.url} changed while it was read")
                    self.tag = self.tag or (tag if tag and not tag.startswith("W/") else None)
                    return r.read(), int(r.headers["Content-Range"].rpartition("/")[2])
            except urllib.error.HTTPError as e:
                if e.code not in (408, 429, 500, 502, 503, 504) or attempt == self.RETRIES:
                    raise OSError(f"{self.url}: status {e.code}") from e
            except (urllib.error.URLError, ConnectionError, TimeoutError) as e:
                if attempt == self.RETRIES:
                    raise OSError(f"{self.url}: {e}") from e
            time.sleep(self.WAIT * 2**attempt)
        raise AssertionError

    def __call__(self, offset: int, length: int) -> bytes:
        end = min(offset + length, self.size)
        if end <= offset:
            return b""
        a, b = offset // self.BLOCK, -(-end // self.BLOCK)
        k = a
        while k < b:  # one request for each run of missing blocks
            if k in self.blocks:
                k += 1
                continue
            z = k
            while z < b and z not in self.blocks:
                z += 1
            data, _ = self._get(k * self.BLOCK, min(z * self.BLOCK, self.size))
            for i in range(k, z):
                self.blocks[i] = data[(i - k) * self.BLOCK : (i - k + 1) * self.BLOCK]
            k = z
        out = b"".join(self.blocks[i] for i in range(a, b))
        if len(self.blocks) > 1024:
            self.blocks.clear()
        return out[offset - a * self.BLOCK : end - a * self.BLOCK]


class FileReader:
    """Ranges of a file."""

    def __init__(self, uri: str):
        store, path = pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()

    def __call__(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)


def reader(uri: str):
    """``read(offset, length)`` with ``size`` for a path, an http(s) URL or a pyarrow URI."""
    return HttpReader(uri) if uri.startswith(("http://", "https://")) else FileReader(uri)


def store_of(uri: str):
    """The file system and path of a URI or local path."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def put(uri: str, content: bytes) -> None:
    """Write a whole file under its final name only; tasks that run twice replace it by the same bytes."""
    store, path = store_of(uri)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as f:
        f.write(content)
    store.move(part, path)
