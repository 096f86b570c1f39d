"""Tuning a tagger's settings on annotated tokens: coordinate descent over counts.

All values of a parameter are tried together. Settings that share their candidates are decoded in one pass: a batch
of sentences meets every setting while it is in memory, and leaves two numbers for each, tokens right and steps tried. Only
those sums come to the driver. Parameters of the ending step need candidates of their own, made once each.

Instead of seconds, which a cluster doesn't give twice, speed is tokens per step tried: a step is one way from a candidate
of one token to one of the next. A setting is better by the rules of its mode: accuracy (then speed, then the smaller value),
speed (as long as accuracy is not under the first setting's), or 0.7 accuracy + 0.3 speed relative to the first setting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import tagging, training
from lexmill.operators.model import SETTINGS, Model
from lexmill.operators.tokens import SENTENCE
from lexmill.sources.shared import park

#: Values that are tried, in this order; fixed values.
SPACE = {"transitionfactor": [0.8, 1.0, 1.2], "transitionsmooth": [0.0, 0.001, 0.01], "endlen": [4, 5, 6, 7], "endretry": [1, 2, 3], "prob_epsilon": [1e-12, 1e-10, 1e-8], "case_prob_min": [1e-4, 1e-3, 1e-2], "ending_decay_base": [3.0, 5.0, 7.0]}
#: Differences that count, and the most settings that are tried; fixed values.
ACCURACY, SPEED, MOST = 1e-4, 1e-3, 200
#: Settings that change a lattice.
_LATTICE = ("endlen", "endretry", "ending_decay_base")


@dataclass(frozen=True)
class Score:
    right: int
    total: int
    steps: int

    @property
    def accuracy(self) -> float:
        return self.right / self.total if self.total else 0.0

    @property
    def speed(self) -> float:
        return self.total / self.steps if self.steps else 0.0


class Bench:
    """Annotated tokens(SENTENCE, tok_no, form, tag column) and the counts of a model; keeps the choices of each lattice, and every score."""

    def __init__(self, model: Model, gold: DataFrame) -> None:
        self.model, self.gold = model, gold
        self.pairs = tagging.tag_pairs(model.transitions)
        self.forms = park(gold.select("form").distinct(), "tuning-forms")
        self._sentences: dict[tuple, DataFrame] = {}
        self._scores: dict[tuple, Score] = {}

    def sentences(self, settings: dict) -> DataFrame:
        key = tuple(settings[name] for name in _LATTICE)
        if key not in self._sentences:
            m, (length, retries, decay) = self.model, key
            endings = training.endings(m.vocab, m.tag, length)
            candidates = park(tagging.lattice(self.forms, m.vocab, endings, m.types, m.tag, length=length, retries=retries, decay=decay), "tuning-candidates")
            tokens = self.gold.select(*SENTENCE, "tok_no", "form", F.col(m.tag).alias("gold"))
            self._sentences[key] = tagging.meeting(tokens, park(tagging.choices_of(candidates, m.cases), "tuning-choices"), also=("gold",))
        return self._sentences[key]

    def scores(self, tried: list[dict]) -> list[Score]:
        """The score of each setting; those of one lattice in one pass."""
        key = lambda x: tuple(x[name] for name in SETTINGS)
        new: dict[tuple, list[dict]] = {}
        for x in tried:
            own = new.setdefault(tuple(x[name] for name in _LATTICE), [])
            if key(x) not in self._scores and x not in own:
                own.append(x)
        for group in filter(None, new.values()):
            for x, score in zip(group, self._decoded(group), strict=True):
                self._scores[key(x)] = score
        return [self._scores[key(x)] for x in tried]

    def _decoded(self, group: list[dict]) -> list[Score]:
        shared = self.gold.sparkSession.sparkContext.broadcast([tagging.Paths(self.pairs, x["transitionfactor"], x["transitionsmooth"], x["prob_epsilon"], x["case_prob_min"]) for x in group])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for own in tagging.met_choices(batches):
                gold = own.tokens.field("gold")
                inner = np.ones(len(own.choices), dtype=bool)
                ends = np.cumsum(own.lengths)
                inner[np.minimum(ends - own.lengths, len(inner) - 1)[own.lengths > 0]] = False
                steps = int((own.choices[1:] * own.choices[:-1])[inner[1:]].sum())
                right = [pc.sum(pc.equal(own.best(paths).field("tag"), gold)).as_py() or 0 for paths in shared.value]
                n = len(right)
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(right, pa.int64()), pa.array([len(own.choices)] * n, pa.int64()), pa.array([steps] * n, pa.int64())], names=["k", "right", "total", "steps"])

        sums = self.sentences(group[0]).mapInArrow(run, "k int, right long, total long, steps long").groupBy("k").agg(*(F.sum(c).alias(c) for c in ("right", "total", "steps")))
        found = {r.k: Score(r["right"], r["total"], r["steps"]) for r in sums.collect()}  # a row a setting
        return [found.get(k, Score(0, 0, 0)) for k in range(len(group))]


def _smaller(name: str, value, current) -> bool:
    """Of settings that do equally well the one with shorter endings, or with a switch off."""
    if isinstance(value, bool):
        return not value and current is True
    return name == "endlen" and value < current


def better(mode: str, name: str, value, score: Score, current, best: Score, first: Score) -> bool:
    near = abs(score.accuracy - best.accuracy) <= ACCURACY
    level = abs(score.speed - best.speed) <= SPEED
    if mode == "accuracy":
        return score.accuracy > best.accuracy + ACCURACY or (near and (score.speed > best.speed + SPEED or (level and _smaller(name, value, current))))
    if mode == "speed":
        return score.accuracy + ACCURACY >= first.accuracy and (score.speed > best.speed + SPEED or (level and (score.accuracy > best.accuracy + ACCURACY or (near and _smaller(name, value, current)))))
    if mode != "balanced":
        raise ValueError(f"no such mode: {mode}")
    weighed = lambda s: 0.7 * s.accuracy + 0.3 * s.speed / (first.speed or 1.0)
    ahead = weighed(score) - weighed(best)
    return ahead > ACCURACY or (abs(ahead) <= ACCURACY and (score.accuracy > best.accuracy + ACCURACY or (near and _smaller(name, value, current))))


def tuned(model: Model, gold: DataFrame, mode: str = "accuracy", space: dict[str, list] | None = None, most: int = MOST) -> tuple[dict, list[dict]]:
    """The best settings found and what was tried: one parameter after the other, each kept at its best value. The length of endings never falls."""
    bench, settings, history = Bench(model, gold), dict(model.settings), []
    first = best = bench.scores([settings])[0]
    history.append({"param": "baseline", "value": None, "accuracy": first.accuracy, "speed": first.speed})
    for name, values in (space or SPACE).items():
        current = settings[name]
        tried = [v for v in dict.fromkeys(values) if v != current and not (name == "endlen" and v < current)][: most - len(history)]
        for value, score in zip(tried, bench.scores([settings | {name: v} for v in tried]), strict=True):
            history.append({"param": name, "value": value, "accuracy": score.accuracy, "speed": score.speed})
            if better(mode, name, value, score, settings[name], best, first):
                settings, best = settings | {name: value}, score
    return settings, history
