"""Commands: inspect, probe, cohort, plan, pilot, score, export-public, analyze."""

from __future__ import annotations

import argparse
import hashlib
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import cohort, collect, export, report
from gaugeworks.sources import annotations, records


def session() -> SparkSession:
    return SparkSession.builder.appName("gaugeworks").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def pool(spark: SparkSession, path: str, min_total: int, per_template: int, seed: int, templates: list[str] | None = None):
    items = annotations.read(spark, path)
    specs = cohort.discover(items, min_total=min_total)
    return cohort.balanced(items, specs.where(F.col("template_id").isin(templates)) if templates else specs, seed, per_template)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gaugeworks")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple):
        s = sub.add_parser(name)
        for flag, kw in options:
            s.add_argument(flag, **kw)

    source = ("--source", {"required": True})
    out = ("--out", {"required": True})
    choice = (("--min-total", {"type": int, "default": 5000}), ("--per-template", {"type": int, "default": 0}), ("--seed", {"type": int, "default": 0}), ("--templates", {"nargs": "*"}))
    some = (("--limit", {"type": int, "default": 0}), ("--sample", {"type": int, "default": 0}))
    add("inspect", source)
    add("probe", source)
    add("cohort", source, out, *choice, ("--benchmark", {"required": True}), ("--date", {"required": True}), ("--per-cell", {"type": int, "default": 5}))
    add("plan", source, ("--cohort", {"required": True}), ("--cache", {"required": True}), ("--condition", {"required": True}), ("--model", {"required": True}), ("--decode", {"default": "{}"}), ("--served-by", {"default": ""}), ("--quantization", {"default": "unknown"}), ("--corruption", {"default": ""}), ("--severity", {"type": int, "default": 0}), out, *choice, *some)
    add("pilot", ("--scored", {"required": True, "nargs": "+"}), ("--usd-per-call", {"type": float, "default": 0}), ("--budget", {"type": float, "default": 5}), ("--models", {"type": int, "default": 1}), ("--conditions", {"type": int, "default": 4}), ("--halfwidth", {"type": float, "default": 0.04}))
    add("score", source, ("--cohort", {}), ("--cache", {"required": True}), out, *choice)
    add("export-public", ("--scored", {"required": True, "nargs": "+"}), out)
    add("analyze", ("--scored", {"required": True, "nargs": "+"}), out, ("--primary", {"nargs": 2}), ("--baseline", {"default": "clean"}), ("--degraded", {"default": "corrupt"}), ("--n-boot", {"type": int, "default": 10_000}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> object:
    a = parser().parse_args(argv)
    spark = spark or session()
    result: object = None
    if a.command == "inspect":
        result = annotations.drops(annotations.questions(annotations.read(spark, a.source))).first().asDict()
    elif a.command == "probe":
        items = annotations.read(spark, a.source)
        result = {"counts": [r.asDict() for r in annotations.probe_counts(items).collect()], "examples": [r.asDict() for r in annotations.examples(items).collect()]}
    elif a.command == "cohort":
        digest = hashlib.sha256(Path(a.source).read_bytes()).hexdigest()
        selection = {"convert_seed": a.seed, "n_per_template": a.per_template}
        result = cohort.freeze(pool(spark, a.source, a.min_total, a.per_template, a.seed, a.templates), a.benchmark, "converted", {"filename": Path(a.source).name, "sha256": digest}, selection, a.date, a.per_cell)
        Path(a.out).write_text(json.dumps(result, indent=2))
    elif a.command in ("plan", "score"):
        questions = pool(spark, a.source, a.min_total, a.per_template, a.seed, a.templates)
        if a.cohort:
            manifest = json.loads(Path(a.cohort).read_text())
            if (bad := cohort.drift(manifest, convert_seed=a.seed, n_per_template=a.per_template)):
                raise cohort.CohortError("; ".join(bad))
            if getattr(a, "sample", 0) or getattr(a, "limit", 0):
                raise cohort.CohortError("a frozen cohort is neither sampled nor limited")
            questions = cohort.reselect(questions, manifest, hashlib.sha256(Path(a.source).read_bytes()).hexdigest())
        elif a.command == "plan":
            questions = collect.limited(collect.sampled(questions, a.sample, a.seed), a.limit)
        cache = records.read_cache(spark, a.cache) if Path(a.cache).exists() else spark.createDataFrame([], records.RESPONSE)
        if a.command == "plan":
            planned = collect.plan(collect.prompts(questions, a.condition), cache, a.model, a.decode, served_by=a.served_by, quantization=a.quantization, corruption=a.corruption, severity=a.severity)
            planned.write.mode("overwrite").option("ignoreNullFields", "false").json(a.out)
        else:
            records.write_scored(records.score(cache.join(questions.select("question_id"), "question_id", "left_semi"), questions), a.out)
    elif a.command == "pilot":
        result = collect.pilot(records.read_scored(spark, *a.scored)).first().asDict() | collect.sizing(a.usd_per_call, a.budget, a.models, a.conditions, a.halfwidth)
    elif a.command == "export-public":
        result = export.write(records.read_scored(spark, *a.scored), a.out)
    else:
        result = report.sections(records.read_scored(spark, *a.scored), tuple(a.primary) if a.primary else None, a.baseline, a.degraded, a.n_boot)
        Path(a.out).write_text(report.to_json(result))
        Path(a.out).with_suffix(".md").write_text(report.markdown(result))
    if result is not None and a.command != "analyze":
        print(json.dumps(result, indent=2, default=str))
    return result


if __name__ == "__main__":
    main()
