"""Templates with closed answer sets, balanced samples of them, and frozen cohorts."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions import hashing, text


#: Fixed value: the source that question ids are made of.
SOURCE = "drivelm_conv"


class CohortError(ValueError):
    """A cohort that isn't what it says."""


def discover(items: DataFrame, min_total: int = 5000, max_options: int = 6, max_majority_share: float = 0.75, max_answer_chars: int = 60) -> DataFrame:
    """Templates of items(category, question, answer) whose answers are a small closed set: template_id, options (most frequent first, then by text), counts, n_total, capacity.

    All of a template's answers have to be usable, or a wrong option might be a right answer.
    """
    rows = items.select("category", text.template(F.col("question")).alias("template"), text.answer(F.col("answer")).alias("answer")).where("template <> '' and answer <> ''")
    # a template with many answers is no candidate: only as many as decide it are gathered
    answers = rows.groupBy("category", "template", "answer").agg(F.count(F.lit(1)).alias("c")).withColumn("ok", text.usable(F.col("answer"), max_answer_chars))
    heads = answers.groupBy("category", "template").agg(F.min("ok").alias("ok"), F.count(F.lit(1)).alias("k"), F.sum("c").alias("n_total"), F.max("c").alias("most"), F.min("c").alias("least"))
    heads = heads.where(F.col("ok") & F.col("k").between(2, max_options) & (F.col("n_total") >= min_total) & (F.col("most") / F.col("n_total") <= max_majority_share))
    listed = answers.join(heads.drop("ok"), ["category", "template"]).groupBy("category", "template", "k", "n_total", "most", "least").agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), F.col("answer").alias("a")))).alias("o"))
    return listed.select(
        hashing.template_id(F.col("category"), F.col("template")).alias("template_id"), "category", "template", F.transform("o", lambda o: o["a"]).alias("options"),
        F.transform("o", lambda o: -o["c"]).alias("counts"), "n_total", F.col("k").alias("n_options"), (F.col("most") / F.col("n_total")).alias("majority_share"), (F.col("least") * F.col("k")).alias("capacity"),
    )


def balanced(items: DataFrame, specs: DataFrame, seed: int = 0, per_template: int = 0) -> DataFrame:
    """Items of the templates with as many of each answer, and each answer's place counterbalanced.

    items(scene_id, frame_id, idx, category, question, answer). Where a class has more rows than are taken, its rows come in the order of a
    hash of seed, template, answer and place; else in that of their place. The rank in that order sets the place of the
    right option, rank % k. Only content decides, so neither partitions nor their order matter.
    """
    rows = items.withColumn("template", text.template(F.col("question"))).withColumn("gold_text", text.answer(F.col("answer")))
    of = rows.join(specs.select("category", "template", "template_id", "options", "n_options"), ["category", "template"]).where(F.array_contains("options", F.col("gold_text")))
    place = [F.col("scene_id").cast("string"), F.col("frame_id").cast("string"), F.col("idx").cast("int")]
    parts = F.to_json(F.array(F.col("template_id"), F.col("gold_text")))
    where = F.concat(F.lit("["), F.to_json(F.array(place[0])).substr(F.lit(2), F.length(F.to_json(F.array(place[0]))) - 2), F.lit(","), F.to_json(F.array(place[1])).substr(F.lit(2), F.length(F.to_json(F.array(place[1]))) - 2), F.lit(","), place[2].cast("string"), F.lit("]"))
    key = hashing.sha256(F.concat(F.lit(f"[{seed},"), parts.substr(F.lit(2), F.length(parts) - 2), F.lit(","), where, F.lit("]")))
    sizes = of.groupBy("template_id", "n_options", "gold_text").agg(F.count(F.lit(1)).alias("class_n"))
    least = sizes.groupBy("template_id", "n_options").agg(F.min("class_n").alias("m"), F.count(F.lit(1)).alias("k")).where("k = n_options")
    take = F.least("m", F.lit(per_template) / F.col("n_options")).cast("long") if per_template else F.col("m")
    taken = sizes.join(least.select("template_id", take.alias("take")), "template_id").where("take >= 1").select("template_id", "gold_text", "class_n", "take")
    ordered = of.join(taken, ["template_id", "gold_text"]).withColumn("o", F.when(F.col("take") < F.col("class_n"), key))
    w = Window.partitionBy("template_id", "gold_text").orderBy("o", *place)
    chosen = ordered.withColumn("rank", F.row_number().over(w) - 1).where("rank < take")
    texts = text.counterbalanced(F.col("options"), F.col("gold_text"), F.col("rank"))
    return chosen.select(
        hashing.question_id(F.lit(SOURCE), place[0], place[1], F.col("category"), F.col("idx")).alias("question_id"), place[0].alias("scene_id"), place[1].alias("frame_id"), "category",
        text.strip(text.collapse(F.col("question"))).alias("stem"), text.option_letters(F.size("options")).alias("letters"), texts.alias("option_texts"),
        F.char((F.col("rank") % F.size("options") + 65).cast("long")).alias("gold_letter"), "template_id", "gold_text", "rank",
    )


def audit(questions: DataFrame) -> DataFrame:
    """Counts of a cohort by template, class, letter, and class and letter, in one pass: (check_group, template_id, gold_text, gold_letter, n)."""
    q = questions.select("category", "template_id", "gold_text", "gold_letter")
    sets = q.groupingSets([["category"], ["template_id"], ["gold_letter"], ["template_id", "gold_text"], ["template_id", "gold_text", "gold_letter"]], "category", "template_id", "gold_text", "gold_letter").agg(F.count(F.lit(1)).alias("n"), F.grouping_id("category", "template_id", "gold_text", "gold_letter").alias("g"))
    names = {7: "category", 11: "template", 14: "letter", 9: "class", 8: "joint"}
    label = F.create_map(*[x for k, v in names.items() for x in (F.lit(k).cast("long"), F.lit(v))])[F.col("g").cast("long")]
    return sets.select(label.alias("check_group"), "category", "template_id", "gold_text", "gold_letter", "n")


def unbalanced(audited: DataFrame) -> DataFrame:
    """Checks whose cells differ: templates, letters, and within a template its classes and its cells of class and letter. Absent cells don't count."""
    own = F.when(F.col("check_group").isin("class", "joint"), F.col("template_id")).otherwise("")
    cells = audited.where("check_group <> 'category'").groupBy("check_group", own.alias("within")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    return cells.where("least <> most")


def repeat_subset(questions: DataFrame, per_cell: int) -> DataFrame:
    """The first ids of each cell of template, class and letter, with ``short`` where a cell has too few."""
    cell = Window.partitionBy("template_id", "gold_text", "gold_letter")
    ranked = questions.select("template_id", "gold_text", "gold_letter", "question_id").withColumn("r", F.row_number().over(cell.orderBy("question_id"))).withColumn("short", F.count(F.lit(1)).over(cell) < per_cell)
    return ranked.where(F.col("r") <= per_cell).drop("r")


def conversion_stats(questions: DataFrame) -> DataFrame:
    """Questions made, by template, by template and answer, and by template and place of the right answer."""
    sets = [("template_id",), ("template_id", "gold_text"), ("template_id", "gold_letter")]
    grouped = questions.groupingSets([[F.col(c) for c in x] for x in sets], "template_id", "gold_text", "gold_letter").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("template_id", "gold_text", "gold_letter", "n")


def drift(manifest: dict, **given: object) -> list[str]:
    """What a command says of the selection that the manifest says otherwise; None is not said."""
    return [f"{k}: {v!r} is not {manifest['selection'].get(k)!r} of the cohort" for k, v in given.items() if v is not None and manifest["selection"].get(k) != v]


def reselect(questions: DataFrame, manifest: dict, source_sha256: str | None = None) -> DataFrame:
    """``select``, after a check of the source's hash and before one of the audit: a pool that has changed raises."""
    if source_sha256 is not None and source_sha256 != manifest["source"]["sha256"]:
        raise CohortError("the source file is not the one that the cohort was made of")
    chosen = select(questions, manifest)
    told = [r.asDict() for r in audit(chosen).orderBy("check_group", "category", "template_id", "gold_text", "gold_letter").collect()]
    if told != manifest["audit"]["counts"]:
        raise CohortError("the audit of the selected questions differs from the cohort's")
    return chosen


def duplicates(questions: DataFrame) -> DataFrame:
    return questions.groupBy("question_id").count().where("count > 1").select("question_id")


def identity(benchmark: str, adapter: str, source_sha256: str, selection: dict, question_ids: list[str]) -> str:
    """The hash of what makes a cohort what it is."""
    what = {"benchmark": benchmark, "adapter": adapter, "source_sha256": source_sha256, "selection": selection, "question_ids": question_ids}
    return hashlib.sha256(json.dumps(what, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def freeze(questions: DataFrame, benchmark: str, adapter: str, source: dict, selection: dict, created_on: str, per_cell: int) -> dict:
    """A manifest of a balanced cohort; raises if ids repeat, cells differ or the repeat subset is short. A cohort is small: its ids come to the driver."""
    if (twice := [r[0] for r in duplicates(questions).limit(5).collect()]):
        raise CohortError(f"question ids repeat: {twice}")
    counted = audit(questions)
    if (bad := unbalanced(counted).collect()):
        raise CohortError(f"cohort is not exactly balanced: {[r.asDict() for r in bad]}")
    subset = repeat_subset(questions, per_cell).orderBy("template_id", "gold_text", "gold_letter", "question_id").collect()
    if any(r["short"] for r in subset):
        raise CohortError("a cell has too few questions for the repeat subset")
    ids = [r[0] for r in questions.select("question_id").orderBy("question_id").collect()]
    return {
        "schema": 1,
        "cohort_id": identity(benchmark, adapter, source["sha256"], selection, ids),
        "created_on": created_on,
        "benchmark": benchmark,
        "adapter": adapter,
        "source": source,
        "selection": selection,
        "audit": {"n_questions": len(ids), "counts": [r.asDict() for r in counted.orderBy("check_group", "category", "template_id", "gold_text", "gold_letter").collect()]},
        "question_ids": ids,
        "repeat_subset": {"per_joint_cell": per_cell, "n_questions": len(subset), "question_ids": [r["question_id"] for r in subset]},
    }


def checked(manifest: dict) -> dict:
    """A manifest, if its schema, its ids and its hash are right."""
    if manifest.get("schema") != 1:
        raise CohortError(f"unknown cohort schema {manifest.get('schema')!r}")
    ids = manifest["question_ids"]
    if len(set(ids)) != len(ids):
        raise CohortError("question ids repeat")
    if identity(manifest["benchmark"], manifest["adapter"], manifest["source"]["sha256"], manifest["selection"], ids) != manifest["cohort_id"]:
        raise CohortError("cohort hash does not match its content")
    return manifest


def select(questions: DataFrame, manifest: dict) -> DataFrame:
    """The questions of a manifest, with their place in it as ``pos``; raises if one is missing."""
    spark = questions.sparkSession
    wanted = spark.createDataFrame([(i, q) for i, q in enumerate(checked(manifest)["question_ids"])], "pos long, question_id string")
    if (missing := [r[0] for r in wanted.join(questions, "question_id", "left_anti").select("question_id").limit(5).collect()]):
        raise CohortError(f"questions are missing: {missing}")
    return questions.join(wanted, "question_id").orderBy("pos")


def summary(questions: DataFrame, *keys: str) -> DataFrame:
    """Count and expected chance of questions by keys."""
    return questions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(1 / F.size("letters")).alias("expected_chance"))


def expected_chance(questions: DataFrame) -> Column | float:
    """Mean of 1 / options; 0.0 for no questions."""
    return float(questions.agg(F.coalesce(F.avg(1 / F.size("letters")), F.lit(0.0))).first()[0])
