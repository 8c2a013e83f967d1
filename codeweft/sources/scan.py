"""Source trees, snippets, run files and other documents as tables."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from codeweft import schemas
from codeweft.core import cut, numbered
from codeweft.functions.text import SKIP_DIRS, in_skipped_folder, language_of
from codeweft.operators.extraction import SUPPORTED


@pandas_udf(StringType())
def decode_utf8(raw: pd.Series) -> pd.Series:
    """UTF-8 with the replacement character for what isn't."""
    return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))


def scan(spark: SparkSession, root: str, skip: list[str] = SKIP_DIRS) -> DataFrame:
    """files(file_path, language, content, file_ord) below a folder, or of one file.

    Paths are relative to the folder; those in skipped folders and of unknown languages are left out before anything is
    read; file_ord follows the path's parts. A missing path raises FileNotFoundError. A file that can't be read is left out, and
    Spark logs it.
    """
    local = "://" not in root
    if local and not Path(root).exists():
        raise FileNotFoundError(root)
    base = Path(root).resolve().as_uri() if local else root.rstrip("/")
    single = local and Path(root).is_file()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(base)
    full = F.regexp_replace("path", "^file:/+", "file:///")
    rel = F.element_at(F.split(full, "/"), -1) if single else F.expr(f"substring(regexp_replace(path, '^file:/+', 'file:///'), {len(base) + 2})")
    f = raw.select(rel.alias("file_path"), F.col("content").alias("raw"))
    f = f.where(~in_skipped_folder("file_path", skip)).withColumn("language", language_of("file_path")).where(F.col("language").isin(*SUPPORTED))
    order = numbered(f.select("file_path", F.split("file_path", "/").alias("parts")), ["parts"], "file_ord").select("file_path", (F.col("file_ord") + 1).alias("file_ord"))
    return f.select("file_path", "language", decode_utf8("raw").alias("content")).join(order, "file_path")


def snippet(spark: SparkSession, code: str, language: str) -> DataFrame:
    """One file '<snippet>'; an unknown language gives no rows."""
    rows = [("<snippet>", language, code, 1)] if language in SUPPORTED else []
    return spark.createDataFrame(rows, "file_path string, language string, content string, file_ord int")


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """findings(run_id, finding_ord, ...) of run documents, in file order."""
    doc = spark.read.schema(schemas.RUN).option("multiLine", True).json(paths)
    return doc.select("run_id", F.posexplode("findings").alias("finding_ord", "f")).select("run_id", "finding_ord", "f.*")


def read_run_ids(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(run_id) of run documents, also of those without findings."""
    return spark.read.schema(schemas.RUN).option("multiLine", True).json(paths).select("run_id").distinct()


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """truth rows; `vulnerable` false and dataset the file's stem where missing; function_name and file are required."""
    doc = spark.read.schema(schemas.GROUND_TRUTH).option("multiLine", True).json(path)
    t = doc.select(F.coalesce("dataset", F.lit(Path(path).stem)).alias("dataset"), F.posexplode("functions").alias("gt_ord", "f")).select("dataset", "gt_ord", "f.*").withColumn("vulnerable", F.coalesce("vulnerable", F.lit(False)))
    if t.where("function_name is null or file is null").take(1):
        raise KeyError("function_name and file are required in every entry")
    return t


def read_call_graph(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a call-graph document keyed by node id; a missing or corrupt one gives no rows."""
    if "://" not in path and not Path(path).is_file():
        return spark.createDataFrame([], schemas.NODE)
    texts = "map<string,string>"  # values as they are written
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", texts).alias("d"))
    entries = doc.select(F.explode(F.when(F.map_contains_key("d", "nodes"), F.from_json(F.col("d")["nodes"], texts)).otherwise(F.col("d"))).alias("id", "j"))
    return entries.where(F.col("j").startswith("{")).select("id", F.from_json("j", schemas.NODE).alias("n")).select("id", *[f"n.{f.name}" for f in schemas.NODE.fields if f.name != "id"])


@dataclass(frozen=True)
class Config:
    model: str = "o4-mini"
    max_function_lines: int = 200
    skip_dirs: tuple[str, ...] = tuple(SKIP_DIRS)
    max_steps: int = 5
    output_dir: str = "results"
    extra: dict = field(default_factory=dict)


def load_config(path: str | None) -> Config:
    """Settings from YAML with a default for each; a missing file gives the defaults."""
    if not path or not Path(path).exists():
        return Config()
    import yaml

    d = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    llm, ing, agent, out = (d.get(k) or {} for k in ("llm", "ingestion", "agent", "output"))
    c = Config()
    return Config(llm.get("model", c.model), ing.get("max_function_lines", c.max_function_lines), tuple(ing.get("skip_dirs", c.skip_dirs)), agent.get("max_steps", c.max_steps), out.get("output_dir", c.output_dir), d)


def load_env(path: str | None = ".env") -> dict[str, str]:
    """Settings of a `.env` file (NAME=value lines, `export`, quotes and # comments) put into the environment where it lacks them; their names and values.

    A missing file gives none. Values stay in the driver's environment and are never logged.
    """
    try:
        text = Path(path).read_text(encoding="utf-8") if path else ""
    except (OSError, UnicodeDecodeError):
        return {}
    own = {}
    for m in re.finditer(r"(?m)^[ \t]*(?:export[ \t]+)?([A-Za-z_]\w*)[ \t]*=[ \t]*(?:\"((?:[^\"\\]|\\.)*)\"|'([^']*)'|([^\n#]*?))[ \t]*(?:#[^\n]*)?$", text):
        own[m[1]] = re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), m[2]) if m[2] is not None else m[3] if m[3] is not None else m[4]
    for name, value in own.items():
        os.environ.setdefault(name, value)
    return own


def secret(name: str) -> str | None:
    """A secret from the environment; empty counts as missing."""
    return os.environ.get(name) or None


class EdgeCache:
    """Resolved edges as a Parquet table; a missing or unreadable one starts empty. Writes are batches, not whole rewrites."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        try:
            t = self.spark.read.schema(schemas.EDGE_CACHE).parquet(self.path)
            t.take(1)
            return t
        except Exception:  # noqa: BLE001
            return self.spark.createDataFrame([], schemas.EDGE_CACHE)

    def add(self, rows: DataFrame) -> None:
        rows.join(self.table().select("key"), "key", "left_anti").select(*[f.name for f in schemas.EDGE_CACHE.fields]).write.mode("append").parquet(self.path)

    def _replace(self, rows: DataFrame) -> None:
        kept = cut(rows)  # read and written path are the same
        kept.write.mode("overwrite").parquet(self.path)

    def delete(self, keys: list[str]) -> None:
        gone = self.spark.createDataFrame([(k,) for k in keys], "key string")
        self._replace(self.table().join(gone, "key", "left_anti"))

    def clear(self) -> None:
        self._replace(self.table().limit(0))

    def stats(self) -> dict:
        r = self.table().agg(F.count("*").alias("total"), F.count_if(F.col("target").isNotNull()).alias("resolved")).first()
        return {"total": r.total, "resolved": r.resolved, "external": r.total - r.resolved}
