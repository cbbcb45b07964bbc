"""Sources and sinks: source trees, graphs, change sets, configuration."""

from __future__ import annotations

import os
import subprocess
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_regex
from ..schema import EDGES, ENTITIES, CodeGraph, migrate

#: File extensions by language (fixed values).
LANGUAGES = {
    "python": ["py", "pyi"], "rust": ["rs"], "typescript": ["ts", "tsx"], "javascript": ["js", "jsx", "mjs", "cjs"], "go": ["go"], "java": ["java"],
    "c": ["c", "h"], "cpp": ["cpp", "cc", "cxx", "hpp", "hh", "hxx"], "csharp": ["cs"], "php": ["php"], "ruby": ["rb"], "kotlin": ["kt", "kts"],
    "swift": ["swift"], "scala": ["scala", "sc"], "bash": ["sh", "bash"],
}


def language_of(path) -> F.Column:
    """The language of a path by its extension, else null."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for lang, some in LANGUAGES.items():
        out = F.when(ext.isin(some), F.lit(lang)).otherwise(out)
    return out


def ignore_regex(line: str) -> str | None:
    """A regular expression over relative paths for one line of an ignore file."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    folder, rooted = line.endswith("/"), "/" in line.rstrip("/")
    body = glob_regex(line.strip("/").replace("**/", "\0"))
    if body is None:
        return None
    inner = body[len("(?s)^") : -1].replace(".*", "[^/]*").replace("\0", "(?:.*/)?").replace("\\\x00", "(?:.*/)?")
    return ("^" if rooted else "(?:^|.*/)") + inner + ("/.*$" if folder else "(?:/.*)?$")


def ignored(path: F.Column, lines: list[str]) -> F.Column:
    """Whether the lines of an ignore file leave a path out: the last that fits decides, ``!`` takes back."""
    out = F.lit(False)
    for line in lines:
        back = line.strip().startswith("!")
        regex = ignore_regex(line.strip().removeprefix("!"))
        if regex:
            out = F.when(path.rlike(regex), F.lit(not back)).otherwise(out)
    return out


def read_small(spark: SparkSession, path: str) -> str | None:
    """A small file's text at the driver, None if it isn't there; hidden files too, which readers skip."""
    if not exists(spark, path):
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def scan(spark: SparkSession, root: str, languages: list[str] | None = None, include: list[str] = (), exclude: list[str] = (), ignore: list[str] = (), ignore_files: list[str] = (".gitignore",)) -> DataFrame:
    """(path, language, content, size, mtime, content_hash) of a tree's source files, by Spark's own
    reader: hidden files, ignored ones and other languages are left out before they are read whole.
    The lines of the root's ``ignore_files`` come before those of ``ignore``."""
    lines = [x for name in ignore_files for x in (read_small(spark, f"{root.rstrip('/')}/{name}") or "").splitlines()] + list(ignore)
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    base = root.rstrip("/").removeprefix("file://")
    # The reader gives paths as URIs: percent signs escape bytes, a plus is itself.
    whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    whole = F.regexp_replace(whole, "^[a-z]+:/*(?=/)", "")
    path = F.when(F.startswith(whole, F.lit(base + "/")), F.substring(whole, len(base) + 2, 1 << 20)).otherwise(whole)
    rows = rows.select(path.alias("path"), F.col("value").alias("content"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("mtime"))
    rows = rows.withColumn("language", language_of(F.col("path"))).filter(F.col("language").isNotNull() & ~F.col("path").rlike(r"(^|/)\."))
    if languages:
        rows = rows.filter(F.col("language").isin(languages))
    for g in include:
        rows = rows.filter(F.col("path").rlike(glob_regex(g)))
    for g in filter(None, map(glob_regex, exclude)):
        rows = rows.filter(~F.col("path").rlike(g))
    rows = rows.filter(~ignored(F.col("path"), lines))
    return rows.select("path", "language", "content", "size", "mtime", F.sha2("content", 256).alias("content_hash"))


def detect_languages(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "language")


def save(graph: CodeGraph, path: str, version: str) -> str:
    """Writes a version beside the earlier ones, which are the backups; returns its folder."""
    folder = f"{path.rstrip('/')}/{version}"
    graph.entities.sortWithinPartitions("id").write.option("compression", "zstd").parquet(f"{folder}/entities")
    if graph.references is not None:
        graph.references.write.option("compression", "zstd").parquet(f"{folder}/references")
    graph.edges.sortWithinPartitions("source", "target", "kind").write.option("compression", "zstd").parquet(f"{folder}/edges")
    return folder


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load(spark: SparkSession, folder: str) -> CodeGraph:
    """A saved graph with forward slashes in ids and paths; missing columns are an error."""
    entities, edges = spark.read.parquet(f"{folder}/entities"), spark.read.parquet(f"{folder}/edges")
    for df, ddl in ((entities, ENTITIES), (edges, EDGES)):
        missing = {f.split()[0] for f in ddl.replace(", parameters", "").split(", ") if ":" not in f} - set(df.columns)
        if missing:
            raise ValueError(f"columns missing in {folder}: {sorted(missing)}")
    references = migrate(spark.read.parquet(f"{folder}/references"), ["source", "file"]) if exists(spark, f"{folder}/references") else None
    return CodeGraph(migrate(entities, ["id", "file"]), migrate(edges, ["source", "target"]), references)


def load_json(spark: SparkSession, path: str) -> CodeGraph:
    """A graph from a JSON document with maps of entities and a list of edges."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", f"entities map<string, struct<{','.join(_json_fields(ENTITIES))}>>, edges array<struct<source:string,target:string,kind:string>>").alias("j"))
    entities = parsed.select(F.explode("j.entities").alias("key", "e")).select(F.col("key").alias("id"), "e.*").drop("id_")
    return CodeGraph(entities, parsed.select(F.explode("j.edges").alias("e")).select("e.*"))


def _json_fields(ddl: str) -> list[str]:
    from pyspark.sql import types as T

    return [f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl) if f.name != "id"]


def save_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("entity_id", "feature_ord", "vector", "fingerprint").write.parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Saved vectors (entity_id, feature_ord, vector, fingerprint); other columns are an error."""
    out = spark.read.parquet(path)
    if out.columns != ["entity_id", "feature_ord", "vector", "fingerprint"]:
        raise ValueError(f"not a store of vectors: {path}")
    return out


def save_queue(pending: DataFrame, path: str) -> None:
    """Writes the entities that wait for a place (id, features), instead of an earlier queue."""
    pending.select("id", "features").write.mode("overwrite").parquet(path)


def load_queue(spark: SparkSession, path: str) -> DataFrame:
    """A saved queue, empty where none was saved."""
    if not exists(spark, f"{path}/_SUCCESS"):
        return spark.createDataFrame([], "id string, features array<string>")
    return spark.read.parquet(path)


def git_changes(spark: SparkSession, repository: str, base: str, head: str | None = "HEAD") -> DataFrame:
    """(op, path, from_path) between two commits, or with head None between a commit and the working tree,
    whose untracked files are additions.  Names come as they are, whatever characters they have."""

    def git(*args: str) -> list[str]:
        out = subprocess.run(["git", "-C", repository, *args], capture_output=True, check=True).stdout
        return out.decode("utf-8", "replace").split("\0")[:-1]

    names = {"A": "added", "M": "modified", "D": "deleted", "T": "modified"}
    rows, parts = [], iter(git("diff", "--name-status", "-M", "-z", base, *([head] if head else [])))
    for op in parts:
        if op[0] in "RC":
            old, new = next(parts), next(parts)
            rows.append(("renamed", new, old) if op[0] == "R" else ("added", new, None))
        else:
            rows.append((names.get(op[0], "modified"), next(parts), None))
    if not head:
        rows += [("added", p, None) for p in git("ls-files", "--others", "--exclude-standard", "-z")]
    return spark.createDataFrame(rows, "op string, path string, from_path string")


@dataclass(frozen=True)
class Config:
    """Settings; environment variables ``CODEATLAS_<NAME>`` win over given values."""

    batch_size: int = 50
    batch_tokens: int = 8000
    drift_ignore: float = 0.3
    drift_auto: float = 0.7
    search_limit: int = 10

    @staticmethod
    def read(values: dict | None = None) -> Config:
        own = replace(Config(), **(values or {}))
        for f in fields(Config):
            text = os.environ.get(f"CODEATLAS_{f.name.upper()}")
            if text is not None:
                own = replace(own, **{f.name: type(getattr(own, f.name))(text)})
        if own.drift_ignore >= own.drift_auto:
            raise ValueError("drift_ignore must be under drift_auto")
        return own
