"""Sources of the engine: file scans, frontmatter, journals, measurements and feedback, each with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text suffixes, and versions of run journals that can be replayed.
MARKDOWN, REPLAYABLE = ("md", "markdown", "txt"), ("2.0", "2.1", "2.2", "2.3")


def scan_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """path (relative), hash, mtime, size_bytes, file_type, is_binary of files below root; folders that begin with a dot or are excluded by name are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", f"^.*?{root.rstrip('/').removeprefix('file://')}/", "")
    rows = files.select(path.alias("path"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size_bytes"), F.instr(F.decode(F.substring("content", 1, 4096), "ISO-8859-1"), "\0").alias("_nul"))
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    rows = rows.where(~F.exists(folders, lambda x: x.startswith(".") | x.isin(*excluded, "")))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    if suffixes:
        rows = rows.where(suffix.isin(*suffixes))
    binary = F.col("_nul") > 0
    kind = F.when(binary, "binary").when(suffix.isin(*MARKDOWN), "markdown").otherwise("unknown")
    return rows.select("path", "hash", "mtime", "size_bytes", kind.alias("file_type"), binary.alias("is_binary"))


def frontmatter(text) -> tuple:
    """The block between the fences at the start of a text, and the body after it; a text without one is all body."""
    pattern = r"(?s)\A---\n(.*?)\n---\n(.*)\z"
    found = text.rlike(pattern)
    return F.when(found, F.regexp_extract(text, pattern, 1)), F.when(found, F.regexp_extract(text, pattern, 2)).otherwise(text)


def frontmatter_fields(block, names: list[str]):
    """The scalar fields of a block by name (plain or quoted YAML scalars on one line)."""
    return F.struct(*[F.nullif(F.regexp_extract(block, rf"""(?m)^{n}:[ \t]*["']?(.*?)["']?[ \t]*$""", 1), F.lit("")).alias(n) for n in names])


def journals(spark: SparkSession, folder: str) -> DataFrame:
    """Run journals with the reason for which a run is not replayed (null: it is), in replay order."""
    schema = "schema_version string, run_id string, started_at string, success boolean, dry_run boolean, replayable_payload boolean, event_type string, payload string"
    runs = spark.read.schema(schema).option("multiLine", "true").json(folder)
    replayable = F.coalesce("replayable_payload", "success", F.lit(False))
    reason = F.when(~F.col("schema_version").isin(*REPLAYABLE), "unsupported_version").when(F.coalesce("dry_run", F.lit(False)), "dry_run").when(~replayable, "not_replayable").when(F.col("payload").isNull(), "payload_missing")
    return runs.withColumn("skip_reason", reason).withColumn("sort_key", F.coalesce("started_at", "run_id"))


def measurements(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Call records of a run folder (one JSON file each), and one row with how many files are malformed."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(folder)
    v = files.select(F.try_parse_json("value").alias("v"))
    get = lambda n, t: F.try_variant_get("v", f"$.{n}", t).alias(n)
    sidecar = F.try_variant_get("v", "$.source_id", "string").isNotNull() & F.try_variant_get("v", "$.raw_response", "string").isNotNull()
    rows = v.where(F.col("v").isNotNull() & sidecar).select(get("source_id", "string"), get("model", "string"), get("provider", "string"), get("final_status", "string"), F.coalesce(F.try_variant_get("v", "$.attempts", "int"), F.lit(1)).alias("attempts"), get("total_input_tokens", "long"), get("total_output_tokens", "long"), get("total_latency_ms", "long"))
    return rows.where("coalesce(final_status, '') <> 'enrich_skipped'"), v.agg(F.count_if(F.col("v").isNull()).alias("malformed"))


def feedback(spark: SparkSession, folder: str, batch_id: str | None = None) -> DataFrame:
    events = spark.read.schema("ts string, batch_id string, target_type string, target_id string, action string").json(folder)
    return events if batch_id is None else events.where(F.col("batch_id") == batch_id)


def export_graph(entity: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neutral nodes (id, type, label) and edges (source, target, kind); self-loops are left out and an entity's type is its page type."""
    nodes = entity.select(F.col("slug").alias("id"), F.coalesce("page_type", F.lit("Entity")).alias("type"), F.coalesce("title", "slug").alias("label"))
    edges = links.where("src <> dst").select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("LINKS_TO").alias("kind"))
    return nodes, edges
