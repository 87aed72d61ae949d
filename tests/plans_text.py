"""Plan text for assertions."""

import contextlib
import io


def plan_of(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def exchanges(df):
    """Shuffles in the physical plan."""
    return plan_of(df, "simple").count("Exchange hashpartitioning") + plan_of(df, "simple").count("Exchange SinglePartition")
