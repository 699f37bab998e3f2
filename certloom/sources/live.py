"""Live websocket feed as a Python streaming data source named ``certfeed``.

The reader reconnects for ever: an idle feed is dropped after a time-out, failures are waited out with a
doubling pause that is reset by a successful connection. Frames that are no JSON are dropped with a
warning. Frames of uncommitted batches stay in memory, so a retried batch reads the same rows.
"""

import json
import logging
import time
from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

log = logging.getLogger(__name__)

FIRST_PAUSE, LONGEST_PAUSE, IDLE_SECONDS = 1.0, 60.0, 45.0


class Backoff:
    """Pauses between connection attempts."""

    def __init__(self, first: float = FIRST_PAUSE, longest: float = LONGEST_PAUSE):
        self.first, self.longest = first, longest
        self.reset()

    def reset(self) -> None:
        self.pause = self.first

    def next(self) -> float:
        now, self.pause = self.pause, min(self.pause * 2, self.longest)
        return now


def _lost() -> tuple[type[BaseException], ...]:
    """What a feed that is closed, idle, refused or answered wrongly raises; the client library's own errors are none of Python's."""
    try:
        from websockets.exceptions import WebSocketException
    except ImportError:
        return (OSError, TimeoutError, EOFError)
    return (OSError, TimeoutError, EOFError, WebSocketException)


def _websocket(url: str, idle: float):
    """Connects with whichever client library is installed; returns a function that receives one text frame."""
    try:
        from websockets.sync.client import connect
    except ImportError as e:  # optional dependency
        raise RuntimeError("a live feed needs the package websockets") from e
    ws = connect(url, max_size=None)
    return lambda: ws.recv(timeout=idle)


class Feed:
    """Text frames of a feed, across reconnections. ``connect`` gives a receiving function; both may raise."""

    def __init__(self, url: str, idle: float = IDLE_SECONDS, connect: Callable = _websocket, sleep: Callable[[float], None] = time.sleep, lost: tuple[type[BaseException], ...] | None = None):
        self.url, self.idle, self.connect, self.sleep = url, idle, connect, sleep
        self.lost = _lost() if lost is None else lost
        self.backoff = Backoff()
        self.receive: Callable[[], str] | None = None

    def frames(self, most: int, seconds: float) -> Iterator[str]:
        """Up to ``most`` frames, or what comes within ``seconds``."""
        end, n = time.monotonic() + seconds, 0
        while n < most and time.monotonic() < end:
            try:
                if self.receive is None:
                    self.receive = self.connect(self.url, self.idle)
                    self.backoff.reset()
                frame = self.receive()
            except self.lost as e:
                pause = self.backoff.next()
                log.warning("feed lost (%s); next attempt in %.0f s", e, pause)
                self.receive = None
                self.sleep(pause)
                continue
            if _is_json(frame):
                n += 1
                yield frame
            else:
                log.warning("dropped a malformed frame")


def _is_json(frame: str) -> bool:
    try:
        json.loads(frame)
    except ValueError:
        return False
    return True


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.feed = Feed(options.get("url", "ws://127.0.0.1:8080/"), float(options.get("idle", IDLE_SECONDS)))
        self.most, self.seconds = int(options.get("frames", 10_000)), float(options.get("seconds", 1.0))
        self.held: deque[tuple[int, str]] = deque()

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at = start["frame"]
        new = list(self.feed.frames(self.most, self.seconds))
        self.held.extend(enumerate(new, at))
        return iter([(f,) for f in new]), {"frame": at + len(new)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(f,) for n, f in self.held if start["frame"] <= n < end["frame"]])

    def commit(self, end: dict) -> None:
        while self.held and self.held[0][0] < end["frame"]:
            self.held.popleft()


class CertFeed(DataSource):
    """``spark.dataSource.register(CertFeed)``, then ``readStream.format("certfeed").option("url", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "certfeed"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)
