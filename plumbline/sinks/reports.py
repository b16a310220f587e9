"""Reports and gates: JSON, CSV by section, a managed block in a text, a fix plan, and the gate on a score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv_sections(sections: dict[str, DataFrame], root: str) -> None:
    """One folder of CSV files with a header for each section; nested columns are written as JSON."""
    for name, rows in sections.items():
        flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in rows.schema.fields]
        # quotes are doubled, as other readers of CSV expect
        rows.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{root.rstrip('/')}/{name}")


def managed_block(existing: str, body: str, name: str = "plumbline") -> str:
    """``existing`` with ``body`` between its markers, in place of what stands there, else at the end; running it again changes nothing."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    block = f"{start}\n{body}\n{end}"
    head, opened, rest = existing.partition(start)
    _, closed, tail = rest.partition(end)
    if opened and closed:
        return head + block + tail
    gap = "" if not existing or existing.endswith("\n\n") else "\n" if existing.endswith("\n") else "\n\n"
    return f"{existing}{gap}{block}\n"


def fix_plan(findings: DataFrame, order: list, most: int = 30) -> str:
    """Markdown of the first ``most`` findings (analyzer, severity, path, line, message); only these come to the driver."""
    rows = findings.orderBy(*order).limit(most).collect()
    if not rows:
        return "No findings.\n"
    parts = [f"## {n}. {r['message']}\n\n- {r['analyzer']}, {r['severity']}\n- {r['path']}:{r['line']}\n" for n, r in enumerate(rows, 1)]
    return f"# Fix plan: {len(rows)} findings, greatest effect first\n\n" + "\n".join(parts)


def exit_code(scores: DataFrame, fail_below: float | None, score: str = "composite") -> int:
    """1 if the lowest score is below the limit, else 0; no limit or no score fails nothing."""
    low = None if fail_below is None else scores.agg(F.min(score)).first()[0]
    return int(low is not None and low < fail_below)
