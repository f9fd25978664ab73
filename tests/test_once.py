"""What queries read twice is computed once: later steps read what was written, not the steps before it."""

from epiframe.operators import metrics
from epiframe.plans.queries import QUERIES
from epiframe.sources import members


def files_of(monkeypatch, module, name, f):
    """Files under the first argument of each call of a function."""
    seen, own = [], getattr(module, name)

    def noted(df, *args, **more):
        seen.append(df.inputFiles())
        return own(df, *args, **more)

    monkeypatch.setattr(module, name, noted)
    f()
    return seen


def test_metrics_of_stored_predictions(spark, sf, monkeypatch):
    (seen,) = files_of(monkeypatch, metrics, "document", lambda: QUERIES["stored_predictions"](spark, sf))
    assert not any("/lineitem" in f or "/part." in f for f in seen)  # neither joined nor numbered again


def test_windows_of_three_shares(spark, sf, monkeypatch):
    seen = files_of(monkeypatch, members, "media_places", lambda: QUERIES["late_media_bytes"](spark, sf))
    assert len(seen) == 3 and all(files and all("/all-windows-" in f for f in files) for files in seen)
