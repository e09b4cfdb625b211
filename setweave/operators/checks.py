"""Reports that must hold: counts of violations that raise."""

from pyspark.sql import DataFrame


def violations(report: DataFrame, zero: list[str]) -> dict[str, int]:
    """Of a report of few rows, the columns in `zero` that are not 0 in some row (a null is a violation), with their sums."""
    out: dict[str, int] = {}
    for r in report.select(*zero).limit(10_001).collect():
        for c in zero:
            if r[c] is None or r[c] != 0:
                out[c] = out.get(c, 0) + (r[c] or 0)
    return out


def valid(report: DataFrame, zero: list[str]) -> DataFrame:
    """report, or ValueError with all columns in `zero` that are not 0, and their sums."""
    found = violations(report, zero)
    if found:
        raise ValueError("the report does not hold: " + ", ".join(f"{c} {n}" for c, n in sorted(found.items())))
    return report
