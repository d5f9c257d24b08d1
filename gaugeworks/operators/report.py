"""The report: sections collected from DataFrames, and their rendering. Sections are as long as there are models and conditions."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame

from gaugeworks.operators import stats

DASH = "\N{EM DASH}"


def sections(rows: DataFrame, primary: tuple[str, str] | None = None, baseline: str = "clean", degraded: str = "corrupt", n_boot: int = 10_000) -> dict[str, list[dict]]:
    """All sections that the rows allow: comparisons and ranking with more than one model, grounding with its three conditions, robustness with its two."""
    rows = rows.persist()
    try:
        found = stats.named(rows).select("model_label", "condition").distinct().collect()
        models, conditions = {r[0] for r in found}, {r[1] for r in found}
        keys = ["model_label", "condition"]
        per_row = rows.withColumn("value", stats.flag("correct").cast("double"))
        interval = stats.bootstrap(stats.named(per_row).select(*keys, "seq", "value"), keys, ["value"], "seq", n_boot=n_boot).select(*keys, "ci_low", "ci_high")
        frames = {
            "accuracy": stats.accuracy(rows, *keys).join(stats.chance(rows, *keys), keys, "left").join(interval, keys, "left"),
            "categories": stats.by_category(rows),
            "extraction": stats.extraction(rows, *keys),
            "tokens": stats.tokens(rows, *keys),
            "cost": stats.cost(rows, *keys),
            "efficiency": stats.efficiency(rows),
            "provenance": stats.provenance(rows),
            "warnings": stats.warnings(rows, primary),
        }
        if len(models) > 1:
            frames["comparisons"] = stats.comparisons(rows, primary)
        if {"clean", "blind_tags", "blind_notags"} <= conditions:
            frames["grounding"] = stats.grounding(rows).join(stats.grounding_interval(rows, n_boot), "model_label", "left")
        if {baseline, degraded} <= conditions:
            base = interval.where(f"condition = '{baseline}'").select("model_label", "ci_low")
            robust = stats.with_retention(stats.robustness(rows, baseline, degraded), base)
            frames["robustness"] = robust.join(stats.robustness_interval(rows, baseline, degraded, n_boot), "model_label", "left")
            if len(models) > 1:
                frames["ranking"] = stats.ranking(rows, baseline, degraded)
                frames["inversions"] = stats.inversions(rows, baseline, degraded)
        found = {name: [r.asDict(True) for r in df.collect()] for name, df in frames.items()}
        found["robustness"] = [r for r in found.get("robustness", []) if r["n_shared"]]
        return {name: sorted(rows, key=ORDER_OF.get(name, by_names)) for name, rows in found.items() if name in ALWAYS or rows}
    finally:
        rows.unpersist()


def by_names(r: dict) -> tuple:
    """Rows in the order of what they are about: their texts, from left to right."""
    return tuple(str(v) for v in r.values() if isinstance(v, str))


#: Sections in an order of their own: the largest differences first, the most accurate first.
ORDER_OF = {
    "comparisons": lambda r: (-abs(r["delta"]), by_names(r)),
    "efficiency": lambda r: (r["condition"], -(r["accuracy"] or 0), by_names(r)),
}
ALWAYS = {"accuracy", "categories", "extraction", "tokens", "cost", "efficiency", "provenance", "warnings"}


def pct(x: float | None) -> str:
    return DASH if undefined(x) else f"{100 * x:.1f}%"


def usd(x: float | None) -> str:
    return DASH if undefined(x) else f"${x:.6f}"


def pval(x: float | None) -> str:
    return DASH if undefined(x) else "<0.0001" if x < 0.0001 else f"{x:.4f}"


def undefined(x: object) -> bool:
    return x is None or isinstance(x, float) and not math.isfinite(x)


def ci(low: float | None, high: float | None) -> str:
    return DASH if undefined(low) or undefined(high) else f"[{pct(low)}, {pct(high)}]"


def styled(name: str) -> Callable[[object], str]:
    """How a column is shown, by its name."""
    if name.startswith("p_") or name == "p_value":
        return pval
    if name.endswith("usd") or name.startswith("usd") or "_usd" in name:
        return usd
    if any(x in name for x in ("accuracy", "rate", "chance", "delta", "retention", "ci_", "gap", "effect", "frac")) and "token" not in name:
        return lambda v: pct(v) if isinstance(v, float) or v is None else str(v)
    return shown


def shown(value: object, places: int = 3) -> str:
    """A cell: a dash for what is undefined, never a zero."""
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return DASH
    return f"{value:.{places}f}" if isinstance(value, float) else str(value)


def table(rows: list[dict]) -> str:
    if not rows:
        return "none"
    heads = list(rows[0])
    lines = ["| " + " | ".join(heads) + " |", "|" + "---|" * len(heads)]
    return "\n".join(lines + ["| " + " | ".join(styled(h)(r[h]).replace("|", "\\|") for h in heads) + " |" for r in rows])


ORDER = ["warnings", "accuracy", "grounding", "comparisons", "efficiency", "robustness", "ranking", "inversions", "cost", "tokens", "categories", "extraction", "provenance"]


def markdown(report: dict[str, list[dict]]) -> str:
    """Warnings first, then a table for each section. Robustness without a named corruption is only said to be there."""
    parts = []
    for name in (n for n in ORDER if n in report):
        rows = report[name]
        if name == "robustness" and not any(r.get("corruption") for r in rows):
            parts.append(f"## {name}\n\nno corruption is named on the degraded rows")
        else:
            parts.append(f"## {name}\n\n{table(rows)}")
    return "\n\n".join(parts) + "\n"


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, default=str)
