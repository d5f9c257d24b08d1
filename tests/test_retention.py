"""What decides in ``retention`` whether a share is kept."""

from oracle import SF

from gaugeworks.operators import stats
from gaugeworks.plans import analysis, registry  # noqa: F401


def test_retention_takes_the_bound_of_10_000_resamples(spark, monkeypatch):
    seen = []

    def with_retention(robust, intervals, real=stats.with_retention):
        seen.append({r["model_label"]: r["ci_low"] for r in intervals.collect()})
        return real(robust, intervals)

    monkeypatch.setattr(stats, "with_retention", with_retention)
    assert registry.QUERIES["retention"](spark, SF).count() > 0
    want = {r["model_label"]: r["ci_low"] for r in registry.QUERIES["pcg64_bootstrap_ci"](spark, SF).where("condition = 'clean'").collect()}
    assert {m: round(x, 9) for m, x in seen[0].items()} == want
