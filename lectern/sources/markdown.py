"""Tables as Markdown."""

from __future__ import annotations


def table(rows: list[list[str]]) -> str:
    """A line of cells between bars for each row that has any; a rule follows the first row unless that one is empty."""
    lines = [f"| {' | '.join(cells)} |" for cells in rows if cells]
    if rows and rows[0]:
        lines.insert(1, f"| {' | '.join('---' for _ in rows[0])} |")
    return "\n".join(lines)
