"""Log files that grow in place, as a stream: a Python data source with (file, byte) offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPLIT = 64 << 20  # bytes of a file that one task reads
LOOK = 1 << 16  # bytes looked at a time for the end of the last whole line


def line_splits(start: int, end: int, size: int) -> list[tuple[int, int]]:
    """Byte ranges of about ``size``; the lines that begin in a range belong to it."""
    return [(a, min(a + size, end)) for a in range(start, end, size)]


def growing_lines():
    """The data source ``growing_lines``: columns value (a line) and path.

    Options: ``path`` (a folder, searched to the bottom), ``names`` (file names, separated by commas),
    ``split`` (bytes a task reads).

    The offset holds, for each file, the byte behind its last line end. What follows it is an
    unfinished line and waits for its rest. A file whose offset went back was cut and is read from its
    start; one that went away loses its entry, so the offset is as long as the list of files there. A
    range of bytes is split over tasks. A file that was cut and has since grown beyond its old end
    cannot be told from one that grew.

    The classes are made here so that they travel to the workers with their code.
    """
    from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

    split_size, look, splits = SPLIT, LOOK, line_splits

    class Piece(InputPartition):
        def __init__(self, path: str, start: int, end: int, at_line: bool):
            self.path, self.start, self.end, self.at_line = path, start, end, at_line

    class Reader(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.root, self.names = options["path"], set(options["names"].split(","))
            self.size = int(options.get("split", split_size))

        def _store(self):
            import re

            from pyarrow import fs

            root = re.sub(r"^file:(?!//)", "file://", self.root)  # file:/x is how Hadoop writes file:///x
            return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)

        def _last_line_end(self, store, path: str, size: int) -> int:
            with store.open_input_file(path) as f:
                end = size
                while end > 0:
                    begin = max(0, end - look)
                    f.seek(begin)
                    at = f.read(end - begin).rfind(b"\n")
                    if at >= 0:
                        return begin + at + 1
                    end = begin
            return 0

        def initialOffset(self) -> dict:
            return {}

        def latestOffset(self) -> dict:
            from pyarrow import fs

            store, root = self._store()
            files = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
            return {f.path: self._last_line_end(store, f.path, f.size) for f in files if f.is_file and f.base_name in self.names}

        def partitions(self, start: dict, end: dict) -> list:
            out = []
            for path, upto in sorted(end.items()):
                begin = start.get(path, 0)
                begin = begin if begin <= upto else 0  # cut: from the start
                out += [Piece(path, a, b, a == begin) for a, b in splits(begin, upto, self.size)]
            return out

        def read(self, piece):
            import pyarrow as pa

            store, _ = self._store()
            with store.open_input_file(piece.path) as f:
                at = piece.start
                if not piece.at_line:
                    # the line that began in the range before is not ours
                    at -= 1
                f.seek(at)
                held, skip, lines, size = b"", not piece.at_line, [], 0
                done = False
                while not done:
                    block = f.read(1 << 20)
                    if not block:
                        break
                    rows = (held + block).split(b"\n")
                    held = rows.pop()
                    for row in rows:
                        begin, at = at, at + len(row) + 1
                        if skip:
                            skip = False
                            continue
                        if begin >= piece.end:
                            done = True
                            break
                        lines.append(row.removesuffix(b"\r").decode("utf-8", "replace"))
                        size += len(row)
                        if size > 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([piece.path] * len(lines), pa.string())], ["value", "path"])
                            lines, size = [], 0
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([piece.path] * len(lines), pa.string())], ["value", "path"])

    class GrowingLines(DataSource):
        @classmethod
        def name(cls) -> str:
            return "growing_lines"

        def schema(self) -> str:
            return "value string, path string"

        def streamReader(self, schema):
            return Reader(dict(self.options))

    return GrowingLines


def stream_growing_lines(spark: SparkSession, path: str, names: list[str], split: int = SPLIT) -> DataFrame:
    """Stream of the whole lines of files that grow below a folder; see :func:`growing_lines`."""
    spark.dataSource.register(growing_lines())
    return spark.readStream.format("growing_lines").option("path", path).option("names", ",".join(names)).option("split", str(split)).load()
