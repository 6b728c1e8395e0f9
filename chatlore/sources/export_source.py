"""Channel exports as a Spark data source (U1): ``<root>/<channel>/<day>.json``, each a JSON array of messages.

``spark.read.format("chat_export").option("path", root)`` gives ``(channel_id, day, body)``, one partition per channel
and day, so that a long history is read by many tasks.  A task decodes its file piece by piece and holds one message
and a piece of ``PIECE`` bytes, however long the day is; each message keeps its own JSON, so absent and null keys stay
distinct.  The options ``channels`` and ``days`` (JSON arrays of names; all by default) leave files of others unopened.

A file that isn't one array of objects in UTF-8 fails the read with its name; empty arrays, empty files and folders give no rows.
A day's file is found by the driver's listing, names only.  ``write_export`` writes the same layout.
"""

from __future__ import annotations

import codecs
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chatlore.functions.text import ts_order
from chatlore.sources.chat import export_tables

PIECE = 1 << 20
_SPACE = " \t\r\n"


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    path = path.rstrip("/")
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def objects(pieces: Iterator[str]) -> Iterator[str]:
    """The JSON text of each object of an array that comes in pieces."""
    pieces = itertools.chain(pieces, [None])       # None: no more
    held, at, depth, start, quoted, escaped = "", 0, 0, None, False, False
    opened = closed = comma = False
    for piece in pieces:
        if piece is None:
            break
        held = held[start:] if start is not None else ""
        at, start = len(held), 0 if start is not None else None
        held += piece
        while at < len(held):
            c = held[at]
            if start is not None:
                if quoted:
                    escaped, quoted = c == "\\" and not escaped, c != '"' or escaped
                elif c == '"':
                    quoted = True
                elif c in "{[":
                    depth += 1
                elif c in "}]":
                    depth -= 1
                    if depth == 0:
                        body, start = held[start:at + 1], None
                        json.loads(body)
                        yield body
                        comma = False
            elif c in _SPACE:
                pass
            elif c == "[" and not opened:
                opened = comma = True           # an object may follow
            elif c == "{" and opened and comma and not closed:
                start, depth = at, 1
            elif c == "," and opened and not comma and not closed:
                comma = True
            elif c == "]" and opened and not closed:
                closed = True
            else:
                raise ValueError(f"not an array of objects: {c!r}")
            at += 1
    if opened and not closed:
        raise ValueError("the array doesn't end")


@dataclass
class Day(InputPartition):
    channel: str
    day: str
    path: str


class ExportReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.channels, self.days = (None if options.get(k) is None else set(json.loads(options[k])) for k in ("channels", "days"))

    def partitions(self) -> list[Day]:
        files, root = _file_system(self.root)
        out = []
        for folder in files.get_file_info(pafs.FileSelector(root)):
            if folder.type != pafs.FileType.Directory or (self.channels is not None and folder.base_name not in self.channels):
                continue
            for day in files.get_file_info(pafs.FileSelector(folder.path)):
                name, _, kind = day.base_name.rpartition(".")
                if kind == "json" and (self.days is None or name in self.days):
                    out.append(Day(folder.base_name, name, day.path))
        return sorted(out, key=lambda d: (d.channel, d.day)) or [Day("", "", "")]

    def read(self, partition: Day) -> Iterator[tuple]:
        if not partition.path:
            return
        files, _ = _file_system(self.root)
        with files.open_input_stream(partition.path) as stream:
            pieces = codecs.iterdecode(iter(lambda: stream.read(PIECE), b""), "utf-8")
            try:
                for body in objects(pieces):
                    yield partition.channel, partition.day, body
            except ValueError as e:
                raise ValueError(f"{partition.path}: {e}") from e


class ChatExport(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chat_export"

    def schema(self) -> str:
        return "channel_id string, day string, body string"

    def reader(self, schema) -> ExportReader:
        return ExportReader(dict(self.options))


def read_export_days(spark: SparkSession, root: str, channels: list[str] | None = None,
                     days: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(messages, replies)`` of an export as ``chat.read_export`` gives them, read day by day."""
    spark.dataSource.register(ChatExport)
    source = spark.read.format("chat_export").option("path", root)
    for name, some in (("channels", channels), ("days", days)):
        if some is not None:
            source = source.option(name, json.dumps(some))
    return export_tables(source.load().select("channel_id", "body"))


def write_export(messages: DataFrame, root: str) -> None:
    """Write messages (with ``has_thread``) as an export by channel and day of ``ts``; a day is written by one task as it
    comes, a retried task writes the same file again.  Messages without a readable ``ts`` go to the day ``none``."""
    every = F.struct("ts", "user", "text", "subtype", "thread_ts")
    plain = F.struct("ts", "user", "text", "subtype")
    options = {"ignoreNullFields": "false"}
    day = F.coalesce(F.date_format(F.timestamp_seconds(ts_order("ts")), "yyyy-MM-dd"), F.lit("none"))
    rows = messages.select("channel_id", day.alias("day"), "ts", F.when(
        F.col("has_thread"), F.to_json(every, options)).otherwise(F.to_json(plain, options)).alias("body"))

    def write(some: Iterator[Row]) -> None:
        files, base = _file_system(root)
        for (channel, day), group in itertools.groupby(some, key=lambda r: (r.channel_id, r.day)):
            files.create_dir(f"{base}/{channel}", recursive=True)
            with files.open_output_stream(f"{base}/{channel}/{day}.json") as out:
                for k, r in enumerate(group):
                    out.write((("[" if k == 0 else ",\n") + r.body).encode())
                out.write(b"]")

    rows.repartition("channel_id", "day").sortWithinPartitions("channel_id", "day", "ts", "body").foreachPartition(write)
