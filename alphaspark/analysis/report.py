"""HTML reports, drawn as inline SVG from tables of one row a date."""

from __future__ import annotations

import html
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.axes import AXES, Axes
from .ic import ICAnalysis, ICResult, forward_returns
from .layered import LayeredBacktest

_COLOURS = ("#1b6ca8", "#c8553d", "#588157", "#8d6a9f", "#d4a017", "#3d5a80", "#999999")


def moving_average(values: Sequence[float | None], n: int = 20) -> list[float | None]:
    """Over up to ``n`` values that aren't missing."""
    out: list[float | None] = []
    for i in range(len(values)):
        own = [v for v in values[max(0, i - n + 1) : i + 1] if v is not None]
        out.append(sum(own) / len(own) if own else None)
    return out


def histogram(values: Sequence[float | None], bins: int = 20) -> list[tuple[float, int]]:
    own = sorted(v for v in values if v is not None)
    if not own:
        return []
    low, width = own[0], (own[-1] - own[0]) / bins or 1.0
    counts = [0] * bins
    for v in own:
        counts[min(bins - 1, int((v - low) / width))] += 1
    return [(low + (i + 0.5) * width, c) for i, c in enumerate(counts)]


def line_chart(series: dict[str, Sequence[float | None]], title: str, width: int = 720, height: int = 240) -> str:
    there = [v for s in series.values() for v in s if v is not None]
    low, high = (min(there), max(there)) if there else (0.0, 1.0)
    span = high - low or 1.0
    out = [f'<svg viewBox="0 0 {width} {height + 30}" role="img"><title>{html.escape(title)}</title>']
    for k, (name, values) in enumerate(series.items()):
        step, colour = width / max(1, len(values) - 1), _COLOURS[k % len(_COLOURS)]
        points = " ".join(f"{i * step:.1f},{height - (v - low) / span * height:.1f}" for i, v in enumerate(values) if v is not None)
        out.append(f'<polyline fill="none" stroke="{colour}" points="{points}"/><text x="{10 + 90 * k}" y="{height + 20}" fill="{colour}">{html.escape(name)}</text>')
    return "".join([*out, "</svg>"])


def bar_chart(bars: Sequence[tuple[str, float]], title: str, width: int = 720, height: int = 200) -> str:
    most = max([abs(v) for _, v in bars], default=1.0) or 1.0
    step = width / max(1, len(bars))
    out = [f'<svg viewBox="0 0 {width} {height + 30}" role="img"><title>{html.escape(title)}</title>']
    for i, (name, v) in enumerate(bars):
        size = abs(v) / most * height / 2
        top = height / 2 - size if v >= 0 else height / 2
        out.append(f'<rect x="{i * step + 2:.1f}" y="{top:.1f}" width="{max(1, step - 4):.1f}" height="{size:.1f}" fill="{_COLOURS[0] if v >= 0 else _COLOURS[1]}"/><text x="{i * step + 2:.1f}" y="{height + 20}">{html.escape(name)}</text>')
    return "".join([*out, "</svg>"])


@dataclass
class FactorReport:
    """``panel``: bars with date, symbol and price; ``factor``: (date, symbol, value).  The first period is the main one."""

    panel: DataFrame
    factor: DataFrame
    name: str = "factor"
    periods: Sequence[int] = (1, 5, 10)
    n_quantiles: int = 5
    price: str = "close"
    axes: Axes = AXES

    def run(self) -> dict:
        """Figures of every period's IC, and the main period's quantiles, collected: one row a date at most."""
        keys = [self.axes.date, self.axes.symbol]
        ahead = forward_returns(self.panel.select(*keys, self.price), self.periods, self.price, self.axes)
        ics: dict[int, ICResult] = {p: ICAnalysis(self.factor, ahead.select(*keys, f"ret_{p}"), self.axes).run() for p in self.periods}
        value = next(c for c in self.factor.columns if c not in keys)
        joined = self.factor.select(*keys, F.col(value).alias("factor")).join(ahead.select(*keys, F.col(f"ret_{self.periods[0]}").alias("ret")), keys)
        layers = LayeredBacktest(joined, self.n_quantiles, axes=self.axes)
        cumulative = layers.cumulative().orderBy(self.axes.date).collect()
        names = [f"Q{i}" for i in range(1, self.n_quantiles + 1)]
        means = layers.quantile_returns().agg(*[F.avg(c).alias(c) for c in names]).first()
        return {
            "name": self.name,
            "ic": {p: r.row() for p, r in ics.items()},
            "ic_series": [r["ic"] for r in ics[self.periods[0]].ic_series.collect()],
            "cumulative": {c: [r[c] for r in cumulative] for c in [*names, "long_short"]},
            "quantile_means": [(c, means[c] or 0.0) for c in names],
            "layered": layers.stats_row(),
        }

    def section(self) -> str:
        """The report's tables and charts."""
        r = self.run()
        number = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
        rows = "".join(f"<tr><td>{p}</td>" + "".join(f"<td>{number(v)}</td>" for v in ic.values()) + "</tr>" for p, ic in r["ic"].items())
        heads = "".join(f"<th>{html.escape(k)}</th>" for k in next(iter(r["ic"].values())))
        layered = "".join(f"<tr><td>{html.escape(k)}</td><td>{number(v)}</td></tr>" for k, v in r["layered"].items())
        charts = [
            line_chart({"IC": r["ic_series"], "mean of 20": moving_average(r["ic_series"])}, "IC"),
            bar_chart([(f"{x:.2f}", float(c)) for x, c in histogram(r["ic_series"])], "Distribution of the IC"),
            line_chart(r["cumulative"], "Cumulative returns"),
            bar_chart(r["quantile_means"], "Mean return by quantile"),
        ]
        return f"<h1>Factor report: {html.escape(self.name)}</h1><table><tr><th>period</th>{heads}</tr>{rows}</table><table>{layered}</table>{''.join(charts)}"

    def to_html(self, path: str | None = None) -> str:
        return reports_html([self], path)


def reports_html(reports: Sequence[FactorReport], path: str | None = None) -> str:
    """One page of several factors' reports."""
    title = f"Factor report: {html.escape(', '.join(r.name for r in reports))}"
    out = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title}</title></head><body>{''.join(r.section() for r in reports)}</body></html>"
    if path:
        Path(path).write_text(out, encoding="utf-8")
    return out
