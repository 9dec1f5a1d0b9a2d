"""Results: JSON, Markdown tables, CSV, arrays, and frames ready to be drawn."""

from __future__ import annotations

from html import escape
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import is_small


def to_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def to_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


#: Rows that the driver takes as arrays, and that a chart shows, at most.
LARGEST, DRAWN = 1_000_000, 10_000


def _few(df: DataFrame, most: int | None = None) -> DataFrame:
    most = LARGEST if most is None else most
    if not is_small(df, most):
        raise ValueError(f"more than {most} rows; add them up first")
    return df


def to_numpy(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, ...]:
    """Columns of a frame, on the driver: an error if it has more than LARGEST rows."""
    frame = _few(df.select(*columns)).toPandas()
    return tuple(frame[c].to_numpy() for c in columns)


def markdown(df: DataFrame, order: str, digits: int = 4) -> DataFrame:
    """One row, one column ``markdown``: the rows of a summary as a table."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.format_string(f"%.{digits}f", c) if kinds[c] in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |"))
    lines = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return df.agg(F.concat(F.lit(head + "\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("markdown"))


_INK = ("#35618f", "#c2702e", "#4f8a4b", "#8f3b5e", "#6b6b6b")


def svg(df: DataFrame, key: str, values: list[str], path: str, kind: str = "bars", title: str = "", width: int = 720, height: int = 420) -> str:
    """Draws a small frame, a row for each key in its order, as bars, lines or points, and writes it; gives the picture as text.

    Points take the first value as x and the second as y. Values from 0 to the greatest fill the height.
    """
    if kind not in ("bars", "lines", "points"):
        raise ValueError(f"unknown kind {kind!r}; one of bars, lines, points")
    rows = df.select(F.col(key).cast("string").alias("key"), *[F.col(v).cast("double").alias(v) for v in values])
    rows = _few(rows, DRAWN).orderBy(key).collect()
    left, top, wide, high = 60, 40, width - 90, height - 100
    name = lambda text: escape(str(text), quote=True)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="12">', f'<text x="{left}" y="22" font-size="15">{name(title)}</text>']
    ys = values[1:2] if kind == "points" else values
    most = max([r[v] for r in rows for v in ys if r[v] is not None], default=0.0) or 1.0
    y = lambda v: top + high - max(0.0, v) / most * high
    for i in range(5):
        out.append(f'<line x1="{left}" x2="{left + wide}" y1="{y(most * i / 4):.1f}" y2="{y(most * i / 4):.1f}" stroke="#ddd"/><text x="{left - 6}" y="{y(most * i / 4) + 4:.1f}" text-anchor="end">{most * i / 4:.3g}</text>')
    if kind == "points":
        far = max([r[values[0]] for r in rows if r[values[0]] is not None], default=0.0) or 1.0
        for r in rows:
            if r[values[0]] is not None and r[values[1]] is not None:
                x = left + max(0.0, r[values[0]]) / far * wide
                out.append(f'<circle cx="{x:.1f}" cy="{y(r[values[1]]):.1f}" r="5" fill="{_INK[0]}"/><text x="{x + 7:.1f}" y="{y(r[values[1]]) - 5:.1f}">{name(r["key"])}</text>')
        out.append(f'<text x="{left + wide / 2}" y="{height - 30}" text-anchor="middle">{name(values[0])}</text>')
    else:
        step = wide / max(1, len(rows))
        for i, r in enumerate(rows):
            out.append(f'<text x="{left + (i + 0.5) * step:.1f}" y="{top + high + 16}" text-anchor="middle">{name(r["key"])}</text>')
            for j, v in enumerate(values if kind == "bars" else ()):
                if r[v] is not None:
                    out.append(f'<rect x="{left + (i + 0.1 + 0.8 * j / len(values)) * step:.1f}" y="{y(r[v]):.1f}" width="{0.8 * step / len(values):.1f}" height="{top + high - y(r[v]):.1f}" fill="{_INK[j % len(_INK)]}"/>')
        for j, v in enumerate(values):
            if kind == "lines":
                points = " ".join(f"{left + (i + 0.5) * step:.1f},{y(r[v]):.1f}" for i, r in enumerate(rows) if r[v] is not None)
                out.append(f'<polyline points="{points}" fill="none" stroke="{_INK[j % len(_INK)]}" stroke-width="2"/>')
            out.append(f'<text x="{left + 130 * j}" y="{height - 30}" fill="{_INK[j % len(_INK)]}">{name(v)}</text>')
    text = "\n".join([*out, "</svg>"])
    Path(path).write_text(text)
    return text


def chart_rows(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """key, measure, value: what a chart of a summary is drawn from."""
    return df.select(key, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(key, values, "measure", "value")
