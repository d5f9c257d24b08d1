"""Public rows: an allowlist of fields, checked before anything is written."""

from __future__ import annotations

import hashlib
import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.schemas import PUBLIC

#: The name of the public schema, for those who read the lines; a parameter, as other makers' rows have another.
SCHEMA, VERSION = "evaluation.public-result", 1
# What fields have to look like, and what private text looks like.
OPAQUE, HASH, SHA, LETTER, DATE = "^[0-9a-f]{16,64}$", "^[0-9a-f]{64}$", "^[0-9a-f]{7,40}$", "^[A-Z]$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
CONDITIONS, STATUSES = ["clean", "blind_tags", "blind_notags", "corrupt"], ["success", "terminal_error"]
PRIVATE = ["/users/", "/home/", "../", "./data/", "./results/", "file://", "data:image/", "bearer ", "api_key", "api-key"]
REQUIRED = ["question_id", "model_label", "condition", "status", "cohort_id", "prompt_hash", "git_sha", "extraction_method"]
SHAPES = {"question_id": OPAQUE, "cohort_id": HASH, "prompt_hash": HASH, "git_sha": SHA, "gold_letter": LETTER, "predicted_letter": LETTER, "price_quoted_on": DATE}
MEASURED = ["n_options", "prompt_tokens", "completion_tokens", "reasoning_tokens", "latency_ms", "usd_per_1m_input", "usd_per_1m_output", "seed", "temperature", "max_tokens", "corruption_severity"]


class ExportError(ValueError):
    """A row that is unsafe or incomplete."""


def cost(tokens: Column, rate: Column) -> Column:
    return tokens * rate / 1_000_000


def errors(columns: dict[str, Column]) -> Column:
    """Names of the fields of a row that may not leave, in the order of the schema."""
    found = []
    for f in PUBLIC:
        if f.name in ("schema", "schema_version") or f.name not in columns:
            continue
        c, kind = columns[f.name], f.dataType.simpleString()
        bad = F.lit(False)
        if kind == "string":
            t = F.coalesce(c, F.lit(""))
            bad = (F.char_length(t) > 200) | t.rlike(r"[\x00-\x1f]") | F.arrays_overlap(F.array(F.lit(True)), F.array(*[F.contains(F.lower(t), F.lit(m)) for m in PRIVATE]))
            if f.name in REQUIRED:
                bad = bad | (t == "")
            if f.name in SHAPES:
                bad = bad | ((t != "") & ~t.rlike(SHAPES[f.name]))
            if f.name == "condition":
                bad = bad | ~t.isin(CONDITIONS)
            if f.name == "status":
                bad = bad | ~t.isin(STATUSES)
        elif kind == "boolean":
            bad = c.isNull()
        elif f.name in MEASURED:
            bad = F.coalesce((c < 0) | F.isnan(c.cast("double")) | (c.cast("double") == float("inf")), F.lit(False))
        found.append(F.when(bad, F.lit(f.name)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def public(rows: DataFrame, keep: list[str] | None = None, schema: str = SCHEMA) -> DataFrame:
    """The public fields of scored rows, in order, with ``errors``; columns that rows lack are null. Nothing else passes, but for ``keep``."""
    have = set(rows.columns)
    col = {f.name: (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType) for f in PUBLIC}
    col |= {"schema": F.lit(schema), "schema_version": F.lit(VERSION)}
    col["input_cost_usd"] = cost(col["prompt_tokens"], col["usd_per_1m_input"])
    col["output_cost_usd"] = cost(col["completion_tokens"], col["usd_per_1m_output"])
    col["total_cost_usd"] = col["input_cost_usd"] + col["output_cost_usd"]
    present = {n: c for n, c in col.items() if n in have}
    return rows.select(*[F.col(k) for k in keep or []], *[col[f.name].alias(f.name) for f in PUBLIC], errors(present).alias("errors"))


def lines(rows: DataFrame, schema: str = SCHEMA) -> DataFrame:
    """One canonical JSON line for each public row, sorted; raises if a row isn't safe."""
    checked = public(rows, schema=schema)
    if (bad := checked.where(F.size("errors") > 0).select("question_id", "errors").limit(5).collect()):
        raise ExportError(f"rows are unsafe or incomplete: {[r.asDict() for r in bad]}")
    return checked.select(F.to_json(F.struct(*sorted(f.name for f in PUBLIC)), {"ignoreNullFields": "false"}).alias("line")).orderBy("line")


def write(rows: DataFrame, path: str, schema: str = SCHEMA) -> dict:
    """Writes the lines to one file, whole or not at all, whatever the partitions, and returns its receipt. The file streams through the driver."""
    digest, n = hashlib.sha256(), 0
    handle, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "wb") as f:
            for r in lines(rows, schema).toLocalIterator():
                data = (r["line"] + "\n").encode()
                f.write(data)
                digest.update(data)
                n += 1
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise
    return {"schema": schema, "schema_version": VERSION, "n_rows": n, "sha256": digest.hexdigest()}
