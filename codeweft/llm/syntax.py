"""Source files that do not parse (problem 4).

Code is read as tokens of its language and parsed with derivatives (`codeweft.parsing`). `language` is taken in any spelling; texts in other
languages are not judged. A text standing alone may be a statement, declarations, or in JavaScript an expression. Null
and empty texts are not judged; blank ones and mere comments are valid. Each verdict depends on the text alone, so
repeated rows agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.parsing.validity import LANGUAGES, check

_ALIASES = {"py": "python", "python3": "python", "js": "javascript", "node": "javascript", "ecmascript": "javascript", "jsx": "javascript", "mjs": "javascript", "c++": "cpp", "cxx": "cpp", "cc": "cpp", "h": "c"}


def normal_language(c: Column) -> Column:
    """Lower case, trimmed, common aliases folded."""
    low = F.lower(F.trim(c))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in _ALIASES.items() for x in kv])[low], low)


def verdicts(df: DataFrame) -> DataFrame:
    """Rows (kind, record_id, repo, file_path, language, text) -> (kind, record_id, repo, file_path, language, verdict, place, line_no); verdict is null for a valid text."""
    src = df.where(F.col("language").isin(*LANGUAGES)).where("text is not null and text <> ''").select("kind", "record_id", "repo", "file_path", "language", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            what, place, line = [], [], []
            for lang, text in zip(batch.column(4).to_pylist(), batch.column(5), strict=True):
                text = text.as_py()
                got = check(text, lang)
                what.append(got and got[0])
                place.append(got and got[1])
                line.append(got and text.count("\n", 0, got[1]) + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(what, pa.string()), pa.array(place, pa.int64()), pa.array(line, pa.int64())], names=["kind", "record_id", "repo", "file_path", "language", "verdict", "place", "line_no"])

    return src.mapInArrow(run, "kind string, record_id bigint, repo string, file_path string, language string, verdict string, place bigint, line_no bigint")


def file_languages(samples: DataFrame) -> DataFrame:
    """(file_path, language): the most frequent language of a file's rows, of several the first by name."""
    n = samples.select("file_path", "repo", normal_language(F.col("language")).alias("language")).where("file_path is not null and language is not null").groupBy("file_path", "language").agg(F.count("*").alias("n"), F.min("repo").alias("repo"))
    return n.groupBy("file_path").agg(F.min(F.struct(-F.col("n"), "language", "repo")).alias("m")).select("file_path", "m.language", "m.repo")


def records(samples: DataFrame, patches: DataFrame) -> DataFrame:
    """(kind, record_id, repo, file_path, language, text) of samples' `code` and patches' `patched_code`.

    A patch has the language of its file's rows; one of a file without rows has none and is not judged.
    """
    s = samples.select(F.lit("sample").alias("kind"), F.col("sample_id").alias("record_id"), "repo", "file_path", normal_language(F.col("language")).alias("language"), F.col("code").alias("text"))
    p = patches.where("patched_code is not null and patched_code <> ''").select("patch_id", "file_path", "patched_code").join(file_languages(samples), "file_path", "left")
    return s.unionByName(p.select(F.lit("patch").alias("kind"), F.col("patch_id").alias("record_id"), "repo", "file_path", "language", F.col("patched_code").alias("text")))


def rates(checked: DataFrame) -> DataFrame:
    """(repo, language, n_texts, n_invalid, rate) over distinct records."""
    one = checked.select("kind", "record_id", "repo", "language", F.col("verdict").isNotNull().alias("bad")).distinct()
    return one.groupBy("repo", "language").agg(F.count("*").alias("n_texts"), F.count_if("bad").alias("n_invalid")).withColumn("rate", F.col("n_invalid") / F.col("n_texts"))


def by_file(checked: DataFrame) -> DataFrame:
    """(repo, file_path, language, n_texts, n_invalid) over distinct records with a path."""
    one = checked.where("file_path is not null").select("kind", "record_id", "repo", "file_path", "language", F.col("verdict").isNotNull().alias("bad")).distinct()
    return one.groupBy("repo", "file_path", "language").agg(F.count("*").alias("n_texts"), F.count_if("bad").alias("n_invalid"))
