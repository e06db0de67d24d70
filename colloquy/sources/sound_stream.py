"""Stored sound as a stream of frames: a data source with offsets and a limit on what a batch admits.

``spark.dataSource.register(SoundFrames)``, then ``spark.readStream.format("sound_frames")`` (or ``read``)
with the options ``path`` (a folder of 16-bit WAV files, by any URI that Arrow's file systems know),
``seconds`` (of a frame, 30), ``rate`` (files of another are an error, 16000), ``limit`` (frames a batch, 64)
and, for a stream, ``progress`` (a folder on the same file system).

Files are taken in order of the time they were written and their names; an offset is the file and the frame
up to which all has been taken, so a batch that failed is read again as it was. A consumer that is slow gets
no more than ``limit`` frames at a time, whatever has gathered. Where the last planned batch ended is noted
in ``progress``, which tells a restarted reader from where to count the limit.

Each call of the engine for the latest offset moves on by one batch, so use a processing-time trigger; the
engine ends an available-now run after one batch of sources like this.
"""

from __future__ import annotations

import io
import json
import wave
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, start long, t0 double, signal array<float>"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Frames(InputPartition):
    """Frames ``first`` to before ``last`` of a file."""

    path: str
    first: int
    last: int


class _Folder:
    def __init__(self, options):
        self.uri = options["path"]
        self.seconds, self.rate, self.limit = float(options.get("seconds", 30)), int(options.get("rate", 16000)), int(options.get("limit", 64))
        self.size = round(self.seconds * self.rate)

    def files(self) -> list[tuple[int, str]]:
        from pyarrow import fs

        system, root = _filesystem(self.uri)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted((f.mtime_ns, f.path) for f in found if f.is_file and f.path.lower().endswith(".wav"))

    def open(self, path: str):
        system, _ = _filesystem(self.uri)
        sound = wave.open(io.BufferedReader(system.open_input_file(path)))
        if sound.getframerate() != self.rate or sound.getsampwidth() != 2:
            raise ValueError(f"{path}: {sound.getframerate()} Hz, {8 * sound.getsampwidth()} bits")
        return sound

    def count(self, path: str) -> int:
        with self.open(path) as sound:
            return -(-sound.getnframes() // self.size)

    def read(self, part: Frames):
        import numpy as np

        with self.open(part.path) as sound:
            sound.setpos(part.first * self.size)
            for k in range(part.first, part.last):
                x = np.frombuffer(sound.readframes(self.size), "<i2").reshape(-1, sound.getnchannels()).mean(1) / 32768
                yield part.path, k * self.size, k * self.seconds, x.astype(np.float32).tolist()


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.folder = _Folder(options)

    def partitions(self):
        step = self.folder.limit
        return [Frames(path, a, min(a + step, n)) for _, path in self.folder.files() for n in [self.folder.count(path)] for a in range(0, n, step)] or [Frames("", 0, 0)]

    def read(self, partition):
        return self.folder.read(partition) if partition.path else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.progress, self.at = _Folder(options), options["progress"], None

    def _note(self):
        system, root = _filesystem(self.progress)
        return system, f"{root.rstrip('/')}/planned.json"

    def initialOffset(self) -> dict:
        return {"written": 0, "path": "", "frames": 0}

    def _ahead(self, at: dict) -> list[tuple[int, str, int, int]]:
        """(written, path, frame to go on from, frames) of each file not yet taken as a whole."""
        out = []
        for written, path in self.folder.files():
            if (written, path) >= (at["written"], at["path"]):
                first = at["frames"] if (written, path) == (at["written"], at["path"]) else 0
                n = self.folder.count(path)
                out += [(written, path, first, n)] if first < n else []
        return out

    def latestOffset(self) -> dict:
        if self.at is None:
            system, note = self._note()
            try:
                with system.open_input_stream(note) as f:
                    self.at = json.loads(f.read())
            except FileNotFoundError:
                self.at = self.initialOffset()
        left = self.folder.limit
        for written, path, first, n in self._ahead(self.at):
            if not left:
                break
            taken = min(left, n - first)
            left, self.at = left - taken, {"written": written, "path": path, "frames": first + taken}
        return self.at

    def partitions(self, start: dict, end: dict):
        parts = []
        for written, path, first, n in self._ahead(start):
            if (written, path) > (end["written"], end["path"]):
                break
            last = end["frames"] if (written, path) == (end["written"], end["path"]) else n
            parts += [Frames(path, k, k + 1) for k in range(first, last)]
        if self.at is None or (self.at["written"], self.at["path"], self.at["frames"]) < (end["written"], end["path"], end["frames"]):
            self.at = end
        system, note = self._note()
        system.create_dir(note.rpartition("/")[0], recursive=True)
        with system.open_output_stream(note) as f:
            f.write(json.dumps(end).encode())
        return parts

    def read(self, partition):
        return self.folder.read(partition)

    def commit(self, end: dict) -> None:
        pass


class SoundFrames(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "sound_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)
