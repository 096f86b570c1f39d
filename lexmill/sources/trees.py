"""Dependency trees as SVG or as LaTeX, one drawing per sentence."""

from __future__ import annotations

from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators.tokens import SENTENCE

STEP, RISE, BASE = 90, 24, 20


def arc_heights(heads: list[int]) -> list[int]:
    """Height of the arc of each token (0: none): one more than the highest arc under it. heads count from 1, 0 is the root."""
    spans = sorted((abs(h - 1 - k), k) for k, h in enumerate(heads) if 0 < h <= len(heads) and h - 1 != k)
    out = [0] * len(heads)
    for width, k in spans:
        low, high = sorted((k, heads[k] - 1))
        under = [out[j] for w, j in spans if w < width and out[j] and low <= min(j, heads[j] - 1) and max(j, heads[j] - 1) <= high]
        out[k] = max(under, default=0) + 1
    return out


def svg(forms: list[str], tags: list[str], heads: list[int], rels: list[str]) -> str:
    heights = arc_heights(heads)
    floor = BASE + RISE * (max(heights, default=0) + 1)
    x = lambda k: STEP // 2 + STEP * k
    parts = []
    for k, (form, tag) in enumerate(zip(forms, tags, strict=True)):
        parts.append(f'<text x="{x(k)}" y="{floor + 18}" text-anchor="middle">{escape(form)}</text><text x="{x(k)}" y="{floor + 36}" text-anchor="middle" font-size="10">{escape(tag)}</text>')
        if heights[k]:
            top, a, b = floor - RISE * heights[k], x(heads[k] - 1), x(k)
            parts.append(f'<path d="M{a},{floor} C{a},{top} {b},{top} {b},{floor}" fill="none" stroke="black"/><text x="{(a + b) // 2}" y="{top}" text-anchor="middle" font-size="10">{escape(rels[k])}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{STEP * len(forms)}" height="{floor + 44}">{"".join(parts)}</svg>'


#: Characters that LaTeX gives a meaning; fixed values.
_LATEX = str.maketrans({c: f"\\{c}" for c in "&%$#_{}"} | {"~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"})


def latex(forms: list[str], tags: list[str], heads: list[int], rels: list[str]) -> str:
    """A tikz-dependency environment."""
    row = lambda xs: " \\& ".join(x.translate(_LATEX) for x in xs) + " \\\\"
    edges = [f"\\deproot{{{k + 1}}}{{{r.translate(_LATEX)}}}" if h == 0 else f"\\depedge{{{h}}}{{{k + 1}}}{{{r.translate(_LATEX)}}}" for k, (h, r) in enumerate(zip(heads, rels, strict=True))]
    return "\n".join(["\\begin{dependency}", "\\begin{deptext}", row(forms), row(tags), "\\end{deptext}", *edges, "\\end{dependency}"])


DRAWINGS = {"svg": svg, "latex": latex}


def drawn(tokens: DataFrame, kind: str = "svg") -> DataFrame:
    """tokens(SENTENCE, tok_no, form, upos, head, deprel) -> SENTENCE, drawing."""
    draw = DRAWINGS[kind]

    @F.arrow_udf(T.StringType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array([draw([t["form"] for t in ts], [t["upos"] or "_" for t in ts], [t["head"] or 0 for t in ts], [t["deprel"] or "_" for t in ts]) for ts in column.to_pylist()], pa.string())

    rows = tokens.groupBy(*SENTENCE).agg(F.array_sort(F.collect_list(F.struct("tok_no", "form", "upos", F.col("head").cast("int").alias("head"), "deprel"))).alias("ts"))
    return rows.select(*SENTENCE, run(F.col("ts")).alias("drawing"))
