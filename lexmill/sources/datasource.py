"""CoNLL-U and TEITOK as formats of spark.read and DataFrame.write.

    register(spark)
    tokens = spark.read.format("conllu").load("/corpus")
    conllu.documents(tokens).write.format("conllu").mode("append").save("/out")

Reading: the files under a path, which may be of any file system that Arrow knows, are dealt to partitions of about
`partitionBytes`, so a task opens few files or one; a file is read sentence by sentence and rows leave in
Arrow batches. Writing takes a document a row, (doc_id, text), into a file of its own. Tasks write into a staging folder; only when
all are done are the files moved to their names, and a task that is run again writes files of its own, so a lost
executor leaves neither halves nor doubles.
"""

from __future__ import annotations

import io
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from lexmill.sources import teitok

_CONLLU = [("doc_id", pa.string()), ("sent_no", pa.int32()), ("sent_id", pa.string()), ("newdoc", pa.string()), ("newpar", pa.string()), ("row_no", pa.int32()), ("id", pa.int32()), ("form", pa.string()), ("lemma", pa.string()), ("upos", pa.string()), ("xpos", pa.string()), ("feats", pa.string()), ("head", pa.int32()), ("deprel", pa.string()), ("deps", pa.string()), ("misc", pa.string()), ("space_after", pa.bool_()), ("mwt_start", pa.int32()), ("mwt_end", pa.int32()), ("mwt_form", pa.string())]
_TEITOK = [("doc_id", pa.string()), ("sent_no", pa.int32()), ("sent_id", pa.string()), ("tok_no", pa.int32()), ("tokid", pa.string()), *((f, pa.string()) for f in teitok.FIELDS[:7]), ("head", pa.int32()), ("deprel", pa.string()), ("parts", pa.list_(pa.string())), ("entity", pa.string()), ("space_after", pa.bool_())]
_SQL = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>"}
#: Rows of a batch that leaves the reader.
ROWS = 10_000


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"^[a-z][a-z0-9+.-]*:", path, re.IGNORECASE) else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    paths: list[str]


def dealt(sizes: list[tuple[str, int]], limit: int) -> list[list[str]]:
    """Paths in order, in groups of `limit` bytes at most or a single larger file."""
    groups, room = [], 0
    for path, size in sizes:
        if not groups or size > room:
            groups.append([])
            room = limit
        groups[-1].append(path)
        room -= size
    return groups


class _Reader(DataSourceReader):
    def __init__(self, options: dict, suffix: str, columns: list, rows) -> None:
        self.options, self.suffix, self.schema, self.rows = options, suffix, pa.schema(columns), rows

    def partitions(self) -> list[InputPartition]:
        where, path = _opened(self.options["path"])
        info = where.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix) and "/_" not in f.path[len(path) :])
        return [Files(group) for group in dealt(files, int(self.options.get("partitionbytes", 64 << 20)))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        where, _ = _opened(self.options["path"])
        batch = []
        for path in partition.paths:
            doc_id = posixpath.basename(path).removesuffix(self.suffix)
            with where.open_input_stream(path) as stream:
                for row in self.rows(doc_id, stream, self.options):
                    batch.append(row)
                    if len(batch) == ROWS:
                        yield self._table(batch)
                        batch = []
        if batch:
            yield self._table(batch)

    def _table(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.schema, strict=True)], schema=self.schema)


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, suffix: str, overwrite: bool) -> None:
        self.path, self.suffix, self.overwrite = options["path"], suffix, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        where, path = _opened(self.path)
        own = f"{path}/{self.staging}/{uuid.uuid4().hex}"
        where.create_dir(own)
        names = []
        for n, (doc_id, text, *_) in enumerate(rows):
            name = re.sub(r"[^\w.-]", "_", str(doc_id))
            if name in ("", ".", "..") or name.startswith("_"):
                name = f"x{name}"
            with where.open_output_stream(f"{own}/{n}") as out:
                out.write((text or "").encode())
            names.append((f"{own}/{n}", f"{name}{self.suffix}"))
        return Written(names)

    def commit(self, messages: list[Written]) -> None:
        where, path = _opened(self.path)
        done = [pair for m in messages if m for pair in m.names]
        twice = len(done) - len({name for _, name in done})
        if twice:
            self.abort(messages)
            raise ValueError(f"{twice} documents have the file name of another")
        if self.overwrite:
            old = [f.path for f in where.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.path.endswith(self.suffix)]
            for name in old:
                where.delete_file(name)
        for at, name in done:
            where.move(at, f"{path}/{name}")
        self._clear(where, path)

    def abort(self, messages: list[Written]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, where: fs.FileSystem, path: str) -> None:
        if where.get_file_info(f"{path}/{self.staging}").type == fs.FileType.Directory:
            where.delete_dir(f"{path}/{self.staging}")


_RANGE = re.compile(r"(\d+)-(\d+)$")


def _sentence(doc_id: str, number: int, rows: list[list[str]], sent_id: str | None, newdoc: str | None, newpar: str | None) -> Iterator[tuple]:
    form = lambda x: "_" if x == r"\_" else x
    ranges = [(int(m[1]), int(m[2]), form(r[1])) for r in rows if (m := _RANGE.match(r[0]))]
    for k, r in enumerate(r for r in rows if r[0].isdigit()):
        own = int(r[0])
        mwt = next((x for x in ranges if x[0] <= own <= x[1]), (None, None, None))
        head = 0 if r[6] == "_" else int(r[6]) if re.fullmatch(r"-?\d+", r[6]) else None
        yield (doc_id, number, sent_id, newdoc, newpar, k, own, form(r[1]), r[2], r[3], r[4], r[5], head, r[7], r[8], r[9], False if "SpaceAfter=No" in r[9].split("|") else None, *mwt)


def conllu_rows(doc_id: str, stream, options: dict) -> Iterator[tuple]:
    """The token rows of a file, one sentence in memory: those of sources.conllu.parsed."""
    number, rows, sent_id, newdoc, newpar, any_line = 0, [], None, None, None, False
    for line in io.TextIOWrapper(stream, encoding="utf-8", newline="\n"):
        line = line.rstrip("\r\n")
        if not line.strip(" \t"):
            if any_line:
                yield from _sentence(doc_id, number, rows, sent_id, newdoc, newpar)
                number += 1
            rows, sent_id, any_line = [], None, False
            continue
        any_line = True
        if line.startswith("#"):
            key, _, value = line[1:].partition("=")
            key, value = key.strip(), value.strip()
            if key == "sent_id":
                sent_id = sent_id or value or None
            elif key == "newdoc id":
                newdoc = value or newdoc
            elif key == "newpar id":
                newpar = value or newpar
            continue
        parts = line.split("\t")
        if len(parts) == 10 and re.fullmatch(r"\d+(-\d+)?", parts[0]):
            rows.append(parts)
    if any_line:
        yield from _sentence(doc_id, number, rows, sent_id, newdoc, newpar)


def teitok_rows(doc_id: str, stream, options: dict) -> Iterator[tuple]:
    """The token rows of a file, those of sources.teitok.parsed; options like `names.upos` = "upos,pos" give the attributes of a field."""
    names = {k.removeprefix("names."): tuple(v.split(",")) for k, v in options.items() if k.startswith("names.")}
    empty = {"lemma", "upos", "xpos", "feats", "reg", "expan", "deprel"}
    for record in teitok.tokens_of(stream.read().decode("utf-8", "replace"), names):
        yield (doc_id, *((record[c] if record[c] is not None or c not in empty else "_") for c, _ in _TEITOK[1:]))


def _format(kind: str, suffix: str, columns: list, rows) -> type[DataSource]:
    class Format(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return ", ".join(f"{c} {_SQL[t]}" for c, t in columns)

        def reader(self, schema) -> DataSourceReader:
            return _Reader({k.lower(): v for k, v in self.options.items()}, suffix, columns, rows)

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            if len(schema.fields) != 2:
                raise ValueError(f"{kind} is written from rows of two columns, an id and a text, not {schema.fieldNames()}")
            return _Writer({k.lower(): v for k, v in self.options.items()}, suffix, overwrite)

    return Format


Conllu = _format("conllu", ".conllu", _CONLLU, conllu_rows)
Teitok = _format("teitok", ".xml", _TEITOK, teitok_rows)


def register(spark: SparkSession) -> None:
    """Makes format("conllu") and format("teitok") known to a session."""
    for source in (Conllu, Teitok):
        spark.dataSource.register(source)
