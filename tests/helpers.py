"""Small helpers shared by the tests."""

import datetime as dt


def ts(text):
    return dt.datetime.fromisoformat(text)


def rows(df, *keys):
    """Rows as dictionaries, sorted by the given columns."""
    found = [r.asDict() for r in df.collect()]
    return sorted(found, key=lambda r: tuple((r[k] is None, r[k]) for k in keys))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted_plan(df):
    """Node details are not cut short here."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
