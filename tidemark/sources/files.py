"""Files as documents: read with Spark's readers, cut into line windows, ready to be appended as facts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fixed as K
from tidemark.functions.text import doc_fingerprint, split_lines_by_words
from tidemark.runtime import ship_package

# What is read by default, what counts as code, and folders that are passed over.
EXTENSIONS = "py ts js tsx jsx rs go cpp c h hpp java cs rb php swift kt sh bash sql md json yaml yml toml html css txt csv tsv log rst transcript"
CODE = "py ts js tsx jsx rs go cpp c h hpp java cs rb php swift kt sh bash sql html css"
SKIPPED = (".git", "node_modules", "__pycache__", ".venv", "venv", "env", ".idea", ".vscode", "dist", "build", "target", ".next", ".nuxt", "coverage", ".pytest_cache")


def read_directory(spark: SparkSession, path: str, extensions: list[str] | None = None, skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """``(path, base, ext, text)`` of the text files under a folder, of any store that Spark reads.

    Hidden and skipped folders and files with a NUL byte are left out.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/")
    inner = F.expr(f"substring(path, locate('{root}', path) + {len(root)})")
    folders = F.slice(F.split(inner, "/"), 1, F.greatest(F.size(F.split(inner, "/")) - 1, F.lit(0)))
    wanted = [e.lstrip(".").lower() for e in extensions or EXTENSIONS.split()]
    rows = found.withColumn("base", F.element_at(F.split("path", "/"), -1)).withColumn("ext", F.lower(F.regexp_extract("base", r"\.([^.]+)$", 1)))
    rows = rows.where(F.col("ext").isin(wanted) & ~F.exists(folders, lambda f: f.isin(list(skip)) | (f.startswith(".") & (f != ""))))
    text = F.try_validate_utf8("content")
    return rows.withColumn("text", text).where(F.col("text").isNotNull() & ~F.col("text").contains("\u0000")).select("path", "base", "ext", "text")


def file_chunks(files: DataFrame, lines: int = K.WINDOW_LINES, overlap: int = K.WINDOW_OVERLAP, metadata=None) -> DataFrame:
    """``(doc_id, text, source, metadata columns)``: line windows of each file, none over the word cap, formatting kept.

    ``metadata`` may be a function ``(text, start, end) -> dict`` called for each chunk. A window that
    is cut further keeps its first line number for every piece.
    """
    ship_package(files.sparkSession)
    digest = F.substring(F.md5(F.col("path").cast("binary")), 1, 10)
    rows = files.withColumn("digest", digest).withColumn("parent_sha256", doc_fingerprint(F.col("text")))
    schema = "path string, base string, ext string, digest string, parent_sha256 string, start_line int, end_line int, text string, extra map<string,string>"

    def cut(parts):
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                body = r.text.splitlines()
                for at in range(0, len(body), max(1, lines - overlap)):
                    for run in split_lines_by_words(body[at : at + lines]):
                        text = "\n".join(run)
                        if text.strip():
                            end = min(at + len(run), len(body))
                            extra = {str(k): str(v) for k, v in (metadata(text, at + 1, end) or {}).items()} if metadata else {}
                            out.append((r.path, r.base, r.ext, r.digest, r.parent_sha256, at + 1, end, text, extra))
            yield pd.DataFrame(out, columns=["path", "base", "ext", "digest", "parent_sha256", "start_line", "end_line", "text", "extra"])

    chunks = rows.select("path", "base", "ext", "digest", "parent_sha256", "text").mapInPandas(cut, schema)
    span = F.concat(F.lit(":"), "start_line", F.lit("-"), "end_line")
    own = F.create_map(
        F.lit("parent_id"), F.concat(F.lit("doc_"), "digest"), F.lit("parent_sha256"), F.col("parent_sha256"), F.lit("file_path"), F.col("path"), F.lit("filename"), F.col("base"),
        F.lit("start_line"), F.col("start_line").cast("string"), F.lit("end_line"), F.col("end_line").cast("string"), F.lit("is_code"), F.col("ext").isin(CODE.split()).cast("string"),
    )
    extra = F.map_filter("extra", lambda k, _: ~F.map_contains_key(own, k))
    return chunks.select(F.concat("base", F.lit("@"), "digest", span).alias("doc_id"), "text", F.concat("base", span).alias("source"), F.to_json(F.map_concat(extra, own)).alias("metadata"), "start_line", "end_line")
