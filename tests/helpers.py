"""Small helpers for the tests."""


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
