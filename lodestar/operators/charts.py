"""Charts of coherence as SVG text: rows are systems by depths or categories, few whatever the data."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

WIDTH, HEIGHT, EDGE = 900, 480, 60
COLOURS = ["#1b6ca8", "#c8553d", "#3a7d44", "#7b4fa3", "#b8860b", "#2a9d8f", "#8d5524", "#555555"]


def _frame(title: str, body: list[str], names: list[str]) -> str:
    legend = [
        f'<rect x="{WIDTH - 150}" y="{EDGE + 18 * k}" width="10" height="10" fill="{COLOURS[k % len(COLOURS)]}"/>'
        f'<text x="{WIDTH - 134}" y="{EDGE + 10 + 18 * k}" font-size="12">{escape(n)}</text>' for k, n in enumerate(names)
    ]
    scale = [
        f'<text x="{EDGE - 8}" y="{_y(v) + 4:.1f}" font-size="11" text-anchor="end">{v}</text>' for v in range(0, 101, 20)
    ]
    scale += [
        f'<line x1="{EDGE}" x2="{WIDTH - 170}" y1="{_y(v):.1f}" y2="{_y(v):.1f}" stroke="#ddd"/>' for v in range(0, 101, 20)
    ]
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif">'
    return "\n".join(
        [
            head, f'<text x="{WIDTH / 2}" y="28" font-size="16" text-anchor="middle">{escape(title)}</text>', *scale,
            *body, *legend, "</svg>",
        ]
    )


def _y(value: float) -> float:
    return HEIGHT - EDGE - value / 100 * (HEIGHT - 2 * EDGE)


def by_depth(means: DataFrame, title: str = "Coherence by depth") -> str:
    """Lines of ``coherence.by_depth``, one a system."""
    rows = means.orderBy("tested_entry", "depth").collect()
    names, deepest = sorted({r.tested_entry for r in rows}), max((r.depth for r in rows), default=1) or 1
    x = lambda d: EDGE + d / deepest * (WIDTH - 230)
    body = [
        f'<text x="{x(d):.1f}" y="{HEIGHT - EDGE + 18}" font-size="11" text-anchor="middle">{d}</text>' for d in range(deepest + 1)
    ]
    for k, name in enumerate(names):
        points = " ".join(f"{x(r.depth):.2f},{_y(r.coherence):.2f}" for r in rows if r.tested_entry == name)
        body.append(f'<polyline points="{points}" fill="none" stroke="{COLOURS[k % len(COLOURS)]}" stroke-width="2"/>')
    return _frame(title, body, names)


def by_category(means: DataFrame, title: str = "Coherence by category") -> str:
    """Groups of bars of ``coherence.by_category``, one group a category, one bar a system."""
    rows = {(r.sentence_cat, r.tested_entry): r.coherence for r in means.collect()}
    groups, names = sorted({c for c, _ in rows}), sorted({e for _, e in rows})
    step = (WIDTH - 230) / max(1, len(groups))
    bar = step * 0.8 / max(1, len(names))
    body = []
    for g, c in enumerate(groups):
        body.append(
            f'<text x="{EDGE + (g + 0.5) * step:.1f}" y="{HEIGHT - EDGE + 18}" font-size="11" text-anchor="middle">{escape(c)}</text>'
        )
        for k, e in enumerate(names):
            v = rows.get((c, e), 0.0)
            x, height = EDGE + g * step + step * 0.1 + k * bar, HEIGHT - EDGE - _y(v)
            body.append(
                f'<rect x="{x:.1f}" y="{_y(v):.1f}" width="{bar:.1f}" height="{height:.1f}" fill="{COLOURS[k % len(COLOURS)]}"/>'
            )
    return _frame(title, body, names)
