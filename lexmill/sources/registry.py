"""Plug-in points: formats, annotators, language detectors and tasks by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from importlib import metadata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexmill.operators import language
from lexmill.sources import conllu, teitok

#: Tasks, their other names, those that run without being asked for, and those that every run has; fixed values.
TASKS = {
    "segment": ("segmentation", "sentence", "sent"), "tokenize": ("tokenization", "token"), "lemmatize": ("lemmatization", "lemma"), "tag": ("upos", "pos"), "xpos": (), "parse": ("parser", "depparse", "dependency"),
    "normalize": ("normalization", "norm", "reg"), "ner": ("entity", "entities", "name", "named"), "wsd": ("wsd-frame", "frame", "frames"), "gec": ("grammar", "grammatical", "error", "correction"),
    "topic": ("topics", "topic-model", "classification"), "langdetect": ("langid", "language-detection", "languageid"),
}
DEFAULT = ("segment", "tokenize", "lemmatize", "tag", "parse", "normalize", "ner")
MANDATORY = ("segment", "tokenize")


def task_names(names: list[str]) -> list[str]:
    """Canonical names of the tasks, the mandatory ones included; raises KeyError for an unknown one."""
    table = {alias: task for task, aliases in TASKS.items() for alias in (task, *aliases)}
    return sorted({*MANDATORY, *(table[n.lower()] for n in names)})


@dataclass
class Registry:
    """Named functions with aliases; names are case-insensitive."""

    kind: str
    entries: dict[str, Callable] = field(default_factory=dict)

    def add(self, f: Callable, *names: str) -> Callable:
        self.entries |= {n.lower(): f for n in names}
        return f

    def get(self, name: str) -> Callable:
        if name.lower() not in self.entries:
            raise KeyError(f"no {self.kind} named {name!r}; there are {', '.join(sorted(self.entries))}")
        return self.entries[name.lower()]


readers, writers, detectors, annotators = Registry("reader"), Registry("writer"), Registry("language detector"), Registry("annotator")
readers.add(conllu.parsed, "conllu", "conllu-ne")
readers.add(teitok.parsed, "teitok", "tei")
writers.add(conllu.documents, "conllu", "conllu-ne")
writers.add(teitok.documents, "teitok", "tei")
writers.add(conllu.json_documents, "json")
detectors.add(lambda docs, known: language.detected(language.scores(docs, known)), "trigram")


#: The group of entry points under which installed packages offer annotators: functions of a token table.
GROUP = "lexmill.annotators"


def discover(group: str = GROUP) -> list[str]:
    """Adds the annotators that installed packages offer and that are not known yet; their names. A package is only loaded for an annotator that is new."""
    new = [point for point in metadata.entry_points(group=group) if point.name.lower() not in annotators.entries]
    for point in new:
        annotators.add(point.load(), point.name)
    return sorted(point.name for point in new)


def annotate(rows: DataFrame, annotator: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    """Run an external annotator over Arrow batches of sentences: a model is loaded once per worker by the annotator."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(annotator, batches)

    return rows.mapInArrow(run, schema)
