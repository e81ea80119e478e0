"""What the tests share."""

SF = "/root/testdata/sf0.001"


def same_rows(spark_rows, columns, names, rows) -> bool:
    """Order-free equality of a Spark result and another engine's, columns by name."""
    cell = lambda v: str(round(v, 6)) if isinstance(v, float) else str(v)
    cols = sorted(columns)
    assert cols == sorted(names), (cols, sorted(names))
    at = [names.index(c) for c in cols]
    return sorted(tuple(cell(r[c]) for c in cols) for r in spark_rows) == sorted(tuple(cell(r[i]) for i in at) for r in rows)
