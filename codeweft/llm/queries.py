"""Queries of problems 2 to 9."""

from pyspark.sql import functions as F

from codeweft.core import load
from codeweft.llm import neardup, packing, provenance, secrets, sentences, splitting, syntax, tokens

CONTAINER = 2048


def _code(spark, sf_dir, *cols):
    return load(spark, sf_dir, "code_samples").select(*cols)


def p2_found(spark, sf_dir):
    return provenance.found(_code(spark, sf_dir, "file_path", "repo", "raw_content"))


def p2_files(spark, sf_dir):
    """Every file with its grammar features and its kinds (generated, minified, copied, data_only, hand_written)."""
    return provenance.judged(_code(spark, sf_dir, "file_path", "repo", "raw_content"))


def p3_found(spark, sf_dir):
    return secrets.places(_code(spark, sf_dir, "file_path", "raw_content", "code"))


def p3_redacted(spark, sf_dir):
    """sample_id, code and raw_content without credential values; a row for each row of the table."""
    return secrets.redacted(_code(spark, sf_dir, "sample_id", "code", "raw_content"), "sample_id", ["code", "raw_content"])


def _checked(spark, sf_dir):
    samples = _code(spark, sf_dir, "sample_id", "repo", "file_path", "language", "code")
    return syntax.verdicts(syntax.records(samples, load(spark, sf_dir, "patches").select("patch_id", "file_path", "patched_code")))


def p4_found(spark, sf_dir):
    return _checked(spark, sf_dir).where("verdict is not null").select("kind", "record_id").distinct()


def p4_places(spark, sf_dir):
    """kind, record_id, repo, file_path, language, verdict ('token' or 'cut off'), place and line of the token at fault."""
    return _checked(spark, sf_dir).where("verdict is not null").distinct()


def p4_files(spark, sf_dir):
    """repo, file_path, language, n_texts, n_invalid: the flags per file."""
    return syntax.by_file(_checked(spark, sf_dir))


def p4_rates(spark, sf_dir):
    """repo, language, n_texts, n_invalid, rate."""
    return syntax.rates(_checked(spark, sf_dir))


def p5_found(spark, sf_dir):
    return neardup.found_pairs(*neardup.similar(_code(spark, sf_dir, "sample_id", "code")))


def p5_groups(spark, sf_dir):
    """sample_id, class_id (equal sets), group_id (linked classes), n_links."""
    return neardup.groups(*neardup.similar(_code(spark, sf_dir, "sample_id", "code"))).withColumnRenamed("id", "sample_id")


def p6_pieces(spark, sf_dir):
    """kind (the column), key (sample_id of `code`, file_path of `raw_content`), piece_no, start_pos, end_pos, text."""
    return splitting.split(_code(spark, sf_dir, "sample_id", "file_path", "code", "raw_content"), {"code": "sample_id", "raw_content": "file_path"})


def p7_ids(spark, sf_dir):
    return tokens.encode(load(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_containers(spark, sf_dir):
    """doc_id, piece, start, size, bin_id: the container of each document (of each piece of one over the capacity)."""
    return packing.pack(tokens.count_tokens(load(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "n_tokens", CONTAINER)


def p8_fill(spark, sf_dir):
    """Containers, tokens and the share of space in use."""
    b = p8_containers(spark, sf_dir).groupBy("bin_id").agg(F.sum("size").alias("fill"))
    return b.agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"), (F.sum("fill") / (F.count("*") * CONTAINER)).alias("used"))


def p9_found(spark, sf_dir):
    return sentences.units(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "end_pos").distinct()


def p9_sentences(spark, sf_dir):
    """doc_id, sent_no, end_pos, sentence."""
    return sentences.units(load(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "p2_found": p2_found, "p2_files": p2_files, "p3_found": p3_found, "p3_redacted": p3_redacted, "p4_found": p4_found, "p4_places": p4_places, "p4_files": p4_files, "p4_rates": p4_rates, "p5_found": p5_found, "p5_groups": p5_groups, "p6_pieces": p6_pieces,
    "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p9_sentences": p9_sentences,
}

_TRIPLES = """
s AS (SELECT DISTINCT sample_id, regexp_extract_all(code, '[A-Za-z0-9_]+') AS t FROM code_samples WHERE code IS NOT NULL),
g AS (SELECT sample_id, list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i+1] || ' ' || t[i+2])) AS g FROM s WHERE len(t) >= 40),
e AS (SELECT sample_id, len(g) AS n, unnest(g) AS w FROM g)"""

ORACLE = {
    "p5_found": f"""
WITH {_TRIPLES}
SELECT a.sample_id AS sample_a, b.sample_id AS sample_b
FROM e a JOIN e b ON a.w = b.w AND a.sample_id < b.sample_id
GROUP BY a.sample_id, b.sample_id, a.n, b.n HAVING 2 * count(*) >= a.n + b.n - count(*)""",
}
