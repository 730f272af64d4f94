"""Recorded frames as a Spark data source, for batches and streams.

A folder holds a folder for each session, and in it segments: files of JSON lines, in order of
their names. A segment is one connection: a task opens it (again after failures, with growing
pauses), numbers its frames and skips lines that are no frames. After `budget` such lines in a row
it ends with a row of error `decode_budget_exhausted`; one that cannot be opened is a row of error
`unreachable`.

A frame's index is its segment's place in the session, then its line in the segment. So it grows
through a session, is the same in batches, streams and after any restart, and segments are read
side by side. A stream's offset is the number of segments of each session and the last one's name;
a new segment whose name sorts before it is an error, for it would move the others.

    spark.dataSource.register(RecordedFrames)
    spark.read.format("recorded_frames").option("path", folder).load()

Options: path (any file system that Arrow opens), budget (3), attempts (3), base (0.5 s), most (30 s).
"""

from __future__ import annotations

import datetime
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "session_id string, segment string, frame_index long, frame_id string, event_time timestamp, width int, height int, source_ref string, error string"
#: Lines that a segment can have below the next one's index.
SPAN = 1 << 32


@dataclass
class Segment(InputPartition):
    session: str
    ordinal: int
    path: str


class Library:
    """The sessions and segments of a folder."""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("recorded_frames needs a path")
        self.path = options["path"].rstrip("/")

    def sessions(self) -> dict[str, list[str]]:
        """Paths of each session's segments in order; names that begin with a dot or underscore are left out."""
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        found: dict[str, list[str]] = {}
        for info in store.get_file_info(fs.FileSelector(top, recursive=True)):
            names = info.path[len(top) :].strip("/").split("/")
            if info.type == fs.FileType.File and len(names) == 2 and names[1][0] not in "._":
                found.setdefault(names[0], []).append(info.path)
        return {s: sorted(paths) for s, paths in found.items()}


def opened(path: str, top: str) -> Iterator[bytes]:
    """Lines of a segment."""
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(top if "://" in top else f"file://{top}")
    with store.open_input_stream(path) as f:
        rest = b""
        while block := f.read(1 << 20):
            *lines, rest = (rest + block).split(b"\n")
            yield from lines
        if rest:
            yield rest


def decoded(line: bytes) -> tuple | None:
    """frame_id, event_time, width, height, source_ref of a line; None if it is no frame."""
    try:
        r = json.loads(line)
        at = datetime.datetime.fromisoformat(r["event_time"])
        at = at.astimezone(datetime.timezone.utc) if at.tzinfo else at.replace(tzinfo=datetime.timezone.utc)
        return str(r["frame_id"]), at, r.get("width"), r.get("height"), r.get("source_ref")
    except (ValueError, KeyError, TypeError):
        return None


def frames_of(segment: Segment, options: dict, lines=opened, sleep=time.sleep) -> Iterator[tuple]:
    """Rows of a segment. A connection that fails is opened again and goes on behind the last line that was read; one that gave lines begins a new row of attempts."""
    budget, attempts = int(options.get("budget", 3)), int(options.get("attempts", 3))
    base, most = float(options.get("base", 0.5)), float(options.get("most", 30))
    name = segment.path.rsplit("/", 1)[-1]
    start, done, wrong, tries = segment.ordinal * SPAN, 0, 0, 0
    while True:
        try:
            for i, line in enumerate(lines(segment.path, Library(options).path)):
                if i < done:
                    continue
                done, tries = i + 1, 0
                if not line.strip():
                    continue
                frame = decoded(line)
                if frame is None:
                    wrong += 1
                    if wrong >= budget:
                        yield (segment.session, name, start + i, None, None, None, None, None, "decode_budget_exhausted")
                        return
                    continue
                wrong = 0
                yield (segment.session, name, start + i, *frame, None)
            return
        except OSError:
            tries += 1
            if tries >= attempts:
                yield (segment.session, name, start + done, None, None, None, None, None, "unreachable")
                return
            sleep(min(most, base * 2 ** (tries - 1)))


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.library = options, Library(options)

    def partitions(self) -> list[Segment]:
        return [Segment(s, i, p) for s, paths in self.library.sessions().items() for i, p in enumerate(paths)]

    def read(self, partition: Segment) -> Iterator[tuple]:
        yield from frames_of(partition, self.options) if partition.path else ()


class StreamReader(DataSourceStreamReader):
    """Offsets: session -> [number of segments, name of the last]."""

    def __init__(self, options: dict):
        self.options, self.library = options, Library(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {s: [len(paths), paths[-1].rsplit("/", 1)[-1]] for s, paths in self.library.sessions().items()}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        out, now = [], self.library.sessions()
        for s, (n, last) in end.items():
            paths, (old, before) = now.get(s, []), start.get(s, [0, ""])
            for count, name in ((old, before), (n, last)):
                if count and (len(paths) < count or paths[count - 1].rsplit("/", 1)[-1] != name):
                    raise ValueError(f"session {s}: segment {name} is not the {count}. any more")
            out += [Segment(s, i, paths[i]) for i in range(old, n)]
        return out

    def read(self, partition: Segment) -> Iterator[tuple]:
        yield from frames_of(partition, self.options)

    def commit(self, end: dict) -> None:
        pass


class RecordedFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))
