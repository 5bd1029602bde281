"""Results as text. Only here do rows come to the driver, and only as many as are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS = 20


def cell(value: object) -> str:
    return "" if value is None else f"{value:g}" if isinstance(value, float) else str(value)


def table(df: DataFrame, rows: int = ROWS) -> tuple[str, int]:
    """(text, rows in all): columns of fixed width if all rows are shown, else markdown of the first ones."""
    shown = df.take(rows + 1)
    if len(shown) <= rows:
        return fixed(df.columns, shown), len(shown)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v).replace("|", "\\|") for v in r) + " |" for r in shown[:rows]]
    total = df.count()
    return "\n".join([*lines, f"... and {total - rows} more rows"]), total


def fixed(names: list[str], rows: list) -> str:
    """Each column as wide as its widest text, two blanks between."""
    lines = [names, *[[cell(v) for v in r] for r in rows]]
    widths = [max(map(len, texts)) for texts in zip(*lines)]
    head, *body = ["  ".join(t.ljust(w) for t, w in zip(line, widths)).rstrip() for line in lines]
    return "\n".join([head, "-" * (sum(widths) + 2 * max(0, len(widths) - 1)), *body])


def matches(df: DataFrame, target: str | None = None, id_column: str | None = None, id_value: str | None = None, rows: int = ROWS) -> tuple[str, int]:
    """(text, rows in all) of rows looked up: one as its wanted value or as a list of its values, several one below the other."""
    shown = df.take(rows + 1)
    told = f"{id_column} {id_value}" if id_column and id_value else ""
    if not shown:
        return f"Nothing is known of {told}." if told else "No rows match.", 0
    listed = ["\n".join(f"- {c}: {cell(v)}" for c, v in zip(df.columns, r)) for r in shown[:rows]]
    if len(shown) == 1:
        return (f"{target} for {told}: {cell(shown[0][target])}" if target else listed[0]), 1
    total = len(shown) if len(shown) <= rows else df.count()
    parts = [f"Found {total} matches" + (f" for {told or target}:" if told or target else ":")]
    parts += [f"Match {i}:\n{text}" for i, text in enumerate(listed, 1)]
    return "\n\n".join(parts + ([f"... and {total - rows} more"] if total > rows else [])), total


def scalar(value: object) -> str:
    return "nothing" if value is None else f"{value:.2f}" if isinstance(value, float) else str(value)


def analysis(parts: dict) -> tuple[str, int]:
    """A report of profile.analyze."""
    n = parts["count"].head()[0]
    if not n:
        return "No rows match.", 0
    lines = [f"Analysis of {n} rows"]
    for r in parts["statistics"].collect():  # a row a column
        lines.append(f"{r.column}: minimum {scalar(r.low)}, maximum {scalar(r.high)}, mean {scalar(r['mean'])}, median {scalar(r['median'])}, standard deviation {scalar(r['std'])}")
    for name, rows in parts["outliers"].items():
        count = rows.count()
        if count:
            lines.append(f"{name}: {count} outliers, such as " + ", ".join(cell(r[name]) for r in rows.take(5)))
    if parts["distributions"] is not None:
        for r in parts["distributions"].orderBy("column", "place").collect():  # ten rows a column, five columns
            lines.append(f"{r.column} = {r.value}: {r.n} ({100 * r.n / n:.1f} %)")
    return "\n".join(lines), n


def card(profile: DataFrame, tops: DataFrame | None, example: DataFrame) -> str:
    """Rows, columns, and a line for each column; for models and for help."""
    rows = profile.orderBy("position").collect()
    top: dict[str, list[str]] = {}
    for r in tops.orderBy("column", "place").collect() if tops is not None else []:
        top.setdefault(r.column, []).append(r.value)
    lines = [f"Rows: {rows[0].n_rows if rows else 0}", f"Columns: {len(rows)}"]
    for r in rows:
        about = f"from {cell(r.low)} to {cell(r.high)}" if r.kind == "numeric" and r.low is not None else "such as " + ", ".join(top.get(r.column, []))
        lines.append(f"- {r.column} ({r.kind}, {r.n_distinct} distinct): {about}")
    first = example.head()
    if first is not None:
        lines.append("Example: " + ", ".join(f"{c}: {cell(v)}" for c, v in first.asDict().items()))
    return "\n".join(lines)


def suggestions(profile: DataFrame, tops: DataFrame | None, dates: list[str] | None = None) -> list[str]:
    """Questions that this table can answer."""
    rows = profile.orderBy("position").collect()
    top: dict[str, list[str]] = {}
    for r in tops.orderBy("column", "place").collect() if tops is not None else []:
        top.setdefault(r.column, []).append(r.value)
    dates = dates or []
    groups = [r.column for r in rows if r.kind == "text" and 1 < r.n_distinct <= 15 and r.column not in dates][:3]
    numbers = [r.column for r in rows if r.kind == "numeric"][:3]
    out = ["How many records are there?", "Show statistics"]
    out += [f"Show records where {c} is {v}" for c in groups for v in top.get(c, [])[:2]]
    for c in numbers:
        out += [f"What is the average {c}?", f"What is the maximum {c}?"]
    out += [f"What is the maximum {c}?" for c in dates[:2]]
    out += [f"Average {n} by {g}" for g in groups[:1] for n in numbers[:2]]
    return out
