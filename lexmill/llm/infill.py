"""Fill-in-middle: a document's lines are cut into prefix, middle and suffix, and put into an order that a model can learn to fill.

Cuts and form come from a digest of the document's own id, so any task, at any time, makes the same of a row.
The output is rebuilt into the text as a check of each row.

Defined cases: null text counts as empty; an empty text, and one that holds a mark, stays plain; a null doc_id is
digested as the empty string; repeated rows come out alike, each for itself; an empty table gives an empty result;
all columns come through, and the new ones get underscores in front where their names are taken. A row is
worked on alone: texts of any length that fit a row, in time in proportion to it.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import unused

LINES = r"[^\n]*\n|[^\n]+"
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


@dataclass(frozen=True)
class Rule:
    """rate: per cent of documents that are cut; spm: per cent of those with the suffix first. Marks begin with a character they hold once."""

    rate: int = 100
    spm: int = 50
    seed: int = 7
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = LINES

    def __post_init__(self) -> None:
        for mark in (self.prefix, self.suffix, self.middle):
            if not mark or mark.count(mark[0]) != 1:
                raise ValueError(f"{mark!r} can run into the text before it")
        if len({self.prefix[0], self.suffix[0], self.middle[0]}) != 1 or len({self.prefix, self.suffix, self.middle}) != 3:
            raise ValueError("the marks must differ and begin with one character")

    def draws(self, doc_id: str) -> list[int]:
        digest = hashlib.sha256(f"{self.seed}:{doc_id}".encode()).digest()
        return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """Where the units end, behind a 0; eight bytes a unit, whatever it holds."""
    ends = array("q", (0,))
    ends.extend(m.end() for m in unit.finditer(text))
    return ends


def cut(text: str, doc_id: str, rule: Rule, unit: regex.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """n units, form, characters of the prefix and of the middle, output."""
    ends = unit_ends(text, unit)
    n = len(ends) - 1
    a, b, kept, order = rule.draws(doc_id)
    if not text or kept % 100 >= rule.rate or any(mark in text for mark in (rule.prefix, rule.suffix, rule.middle)):
        return n, "plain", None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    first, second = ends[low], ends[high] if high < n else len(text)
    before, between, after = text[:first], text[first:second], text[second:]
    if order % 100 < rule.spm:
        return n, "spm", first, second - first, f"{rule.suffix}{after}{rule.prefix}{before}{rule.middle}{between}"
    return n, "psm", first, second - first, f"{rule.prefix}{before}{rule.suffix}{after}{rule.middle}{between}"


def restored(output: str, form: str, rule: Rule) -> str:
    """The text that an output was made of. A text that is cut holds no mark, so each mark is where it stands first."""
    if form == "plain":
        return output
    one, two = (rule.prefix, rule.suffix) if form == "psm" else (rule.suffix, rule.prefix)
    head, _, middle = output.partition(rule.middle)
    head, _, second = head.removeprefix(one).partition(two)
    before, after = (head, second) if form == "psm" else (second, head)
    return before + middle + after


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """docs(doc_id, text, ...) with n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256."""
    rule = rule or Rule()

    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        unit = regex.compile(rule.unit)
        names = [f.split()[0] for f in FIELDS.split(", ")]
        for ids, texts in batches:
            rows = []
            for doc_id, text in zip(ids, texts, strict=True):
                n, form, first, length, output = cut(text, doc_id, rule, unit)
                rows.append((n, form, first, length, output, _sha256(output), _sha256(restored(output, form, rule))))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    fill = F.pandas_udf(made, FIELDS)
    doc_id, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text"))
    own = unused("filled", docs.columns)
    rows = docs.withColumn(own, fill(doc_id, text))
    names = {f.split()[0]: unused(f.split()[0], docs.columns) for f in FIELDS.split(", ")}
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(own).getField(c).alias(name) for c, name in names.items()))
