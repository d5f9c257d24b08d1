"""Nested question annotations as rows, and probes of their surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import hashing, text
from gaugeworks.schemas import ANNOTATIONS


def read(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id, frame_id, category, idx, question, answer, image_paths) of each item of a nested JSON file, map keys as ids."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", ANNOTATIONS).alias("scenes"))
    frames = docs.select(F.explode("scenes").alias("scene_id", "scene")).select("scene_id", F.explode("scene.key_frames").alias("frame_id", "frame"))
    groups = frames.select("scene_id", "frame_id", F.col("frame.image_paths").alias("image_paths"), F.explode("frame.QA").alias("category", "items"))
    return groups.select("scene_id", "frame_id", "category", "image_paths", F.posexplode("items").alias("idx", "item")).select("scene_id", "frame_id", "category", "idx", F.col("item.Q").alias("question"), F.col("item.A").alias("answer"), "image_paths")


def questions(items: DataFrame) -> DataFrame:
    """Items with their split question and gold letter; those that are no multiple choice have no letters."""
    s = items.withColumn("s", text.split_question(F.coalesce("question", F.lit(""))))
    full = s.select("*", F.col("s.stem").alias("stem"), F.col("s.letters").alias("letters"), F.col("s.option_texts").alias("option_texts")).drop("s")
    return full.withColumns({"gold_letter": text.gold_letter(F.coalesce("answer", F.lit("")), F.col("letters"), F.col("option_texts")), "question_id": hashing.question_id(F.lit("drivelm"), F.col("scene_id"), F.col("frame_id"), F.col("category"), F.col("idx"))})


def kept(split: DataFrame) -> DataFrame:
    return split.where((F.size("letters") >= 2) & F.col("gold_letter").isNotNull())


def drops(split: DataFrame) -> DataFrame:
    """How many items there were, and why some were dropped."""
    choice = F.size("letters") >= 2
    return split.agg(
        F.count(F.lit(1)).alias("total_qa"),
        F.count_if(choice & F.col("gold_letter").isNotNull()).alias("kept"),
        F.count_if(~choice).alias("not_multiple_choice"),
        F.count_if(choice & F.col("gold_letter").isNull()).alias("unresolvable_gold"),
        F.round(F.count_if(choice) / F.nullif(F.count(F.lit(1)), F.lit(0)), 4).alias("mcq_share"),
    )


def probe_counts(items: DataFrame) -> DataFrame:
    """(category, pattern, n): items whose question, or gold answer, has each surface pattern."""
    tests = [F.struct(F.lit(k).alias("pattern"), F.col("question").rlike(p).alias("hit")) for k, p in text.PATTERNS.items()]
    tests += [F.struct(F.lit(k).alias("pattern"), F.col("answer").rlike(p).alias("hit")) for k, p in text.GOLD_PATTERNS.items()]
    return items.select("category", F.inline(F.array(*tests))).groupBy("category", "pattern").agg(F.count_if("hit").alias("n"))


def examples(items: DataFrame, n: int = 3, most: int = 420) -> DataFrame:
    """The first ``n`` items of each category, cut to ``most`` characters."""
    from pyspark.sql import Window

    w = Window.partitionBy("category").orderBy("scene_id", "frame_id", "idx")
    return items.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("category", F.substring("question", 1, most).alias("question"), F.substring("answer", 1, 200).alias("answer"))


#: Fixed families of made-up questions.
FAMILIES = [
    ("perception", "What is the status of the {} ahead?", ["Moving", "Stopped", "Back up", "Absent"]),
    ("prediction", "Will the {} change lanes?", ["Yes", "No"]),
    ("planning", "What should the vehicle do near the {}?", ["Brake", "Accelerate", "Change lane"]),
    ("behavior", "How does the vehicle treat the {}?", ["Yields", "Ignores", "Avoids", "Dodges"]),
]
PLACES = ["car", "truck", "bus", "bicycle", "pedestrian", "cone", "barrier", "sign"]
CAMERAS = ["CAM_FRONT", "CAM_FRONT_LEFT", "CAM_FRONT_RIGHT", "CAM_BACK", "CAM_BACK_LEFT", "CAM_BACK_RIGHT"]


def fixture(spark: SparkSession, n: int = 400, seed: int = 1234) -> DataFrame:
    """Made-up questions, family by i % 4 and scene by i // 8; places and gold letters come from a hash of seed and i."""
    i = F.col("id")
    draw = lambda k, salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), i), F.lit(k))
    family = F.element_at(F.array(*[F.struct(F.lit(c).alias("category"), F.lit(s).alias("stem"), F.array(*[F.lit(o) for o in o]).alias("options")) for c, s, o in FAMILIES]), (i % 4 + 1).cast("int"))
    rows = spark.range(n).withColumn("f", family).withColumn("k", F.size("f.options"))
    place = F.element_at(F.array(*[F.lit(p) for p in PLACES]), (draw(8, 1) + 1).cast("int"))
    return rows.select(
        hashing.question_id(F.lit("fixture"), F.lit(seed), i).alias("question_id"), F.concat(F.lit("scene"), (i / 8).cast("long")).alias("scene_id"), F.concat(F.lit("frame"), i).alias("frame_id"), F.col("f.category").alias("category"),
        F.replace("f.stem", F.lit("{}"), place).alias("stem"), text.option_letters(F.col("k")).alias("letters"), F.col("f.options").alias("option_texts"), F.char((65 + F.pmod(F.xxhash64(F.lit(seed), F.lit(2), i), F.col("k"))).cast("long")).alias("gold_letter"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in CAMERAS]), F.array(*[F.concat(F.lit(c + "/"), i, F.lit(".jpg")) for c in CAMERAS])).alias("image_paths"),
    )
