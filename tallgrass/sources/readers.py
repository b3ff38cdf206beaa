"""Files of postings, profiles, records and snapshots as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POSTING = (
    "title string, job_url string, apply_url string, company string, location_text string, employment_type string, duration string, compensation_text string, posted_date string, "
    "summary string, responsibilities array<string>, required_skills array<string>, preferred_skills array<string>, job_reference string, job_id string"
)
POSTING_FIELDS = ", ".join(x.strip().replace(" ", ":", 1) for x in POSTING.split(","))
PROFILE = "resume_id string, source_file_name string, sha256 string, headline string, summary string, total_experience_years double, current_title string, current_company string, primary_skills array<string>, secondary_skills array<string>"
RESUME_FILES = (".pdf", ".docx", ".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]+$", "")


def is_job_file(path: Column, blocked: tuple[str, ...] = ("matches", "profiles", "logs")) -> Column:
    """JSON files outside blocked folders that are no summaries and no match exports."""
    name = F.lower(F.regexp_extract(path, r"([^/]+)$", 1))
    folders = F.slice(F.split(F.lower(path), "/"), 1, F.size(F.split(path, "/")) - 1)
    return name.endswith(".json") & ~F.exists(folders, lambda f: f.isin(*blocked) | f.startswith("matching")) & ~name.contains("_summary") & ~name.rlike(r"match(es)?\.json$")


def target_of(stem: Column, targets: list[str]) -> Column:
    """The longest known target that a file's name begins with; else the name without its run's stamp."""
    bare = F.regexp_replace(stem, r"_\d{8}T\d{6}Z$", "")
    out = bare
    for t in sorted(targets, key=len):  # longer ones are tried first, as they wrap the shorter
        out = F.when((stem == t) | stem.startswith(f"{t}_"), F.lit(t)).otherwise(out)
    return out


def run_of(stem: Column) -> Column:
    return F.nullif(F.regexp_extract(stem, r"_(\d{8}T\d{6}Z)$", 1), F.lit(""))


def read_jobs(spark: SparkSession, path: str, targets: list[str], latest_only: bool = True) -> DataFrame:
    """Postings of JSON arrays below a folder, with target, run and file; broken files give nothing.

    With ``latest_only`` files that carry a run's stamp are left out.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("wholetext", "true").text(path)
    return jobs_in(files.select("value", F.col("_metadata.file_path").alias("file")), targets, latest_only)


def jobs_in(files: DataFrame, targets: list[str], latest_only: bool = True) -> DataFrame:
    """As ``read_jobs``, of texts (value, file) that are there."""
    items = F.from_json("value", f"array<struct<{POSTING_FIELDS}>>")
    rows = files.select("file", F.explode(items).alias("job")).select("job.*", "file")
    rows = rows.where(is_job_file(F.col("file"))).withColumn("stem", file_stem(F.col("file")))
    rows = rows.withColumn("target", target_of(F.col("stem"), targets)).withColumn("run_id", run_of(F.col("stem")))
    if latest_only:
        rows = rows.where("run_id is null")
    return rows.where(F.col("target").isin(*targets)).drop("stem")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Parsed profiles (*_profile.json) that have an id and a hash."""
    rows = spark.read.schema(PROFILE).option("recursiveFileLookup", "true").option("multiLine", "true").option("pathGlobFilter", "*_profile.json").json(path)
    return profiles_in(rows)


def profiles_in(rows: DataFrame) -> DataFrame:
    return rows.where("coalesce(resume_id, '') <> '' and coalesce(sha256, '') <> ''")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that are broken or no objects are dropped."""
    lines = spark.read.text(path).where(F.trim("value").startswith("{"))
    parsed = lines.select(F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r is not null and r._bad is null").select("r.*").drop("_bad")


def read_resumes(spark: SparkSession, path: str, most_bytes: int = 10 << 20, known: DataFrame | None = None) -> DataFrame:
    """(path, sha256, content) of résumé files that aren't empty or too large, but for those whose hash is known."""
    return resumes_in(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), most_bytes, known)


def resumes_in(files: DataFrame, most_bytes: int = 10 << 20, known: DataFrame | None = None) -> DataFrame:
    """As ``read_resumes``, of files (path, content, length) that are there."""
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rows = files.where(kind.isin(*RESUME_FILES) & F.col("length").between(1, most_bytes)).select("path", F.sha2("content", 256).alias("sha256"), "content")
    return rows if known is None else rows.join(known.select("sha256"), "sha256", "left_anti")


def snapshot_rows(lines: DataFrame, column: str, names: list[str], kinds: list[str]) -> DataFrame:
    """Comma-separated lines as columns; a line with another number of fields is dropped."""
    parts = lines.select(F.transform(F.split(column, ","), lambda x: F.trim(x)).alias("p")).where(F.size("p") == len(names))
    return parts.select(*[F.col("p")[i].try_cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))])


def overlaid(*layers: dict) -> dict:
    """Settings of site, profile and override: later layers win, nested ones key by key."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = overlaid(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def chosen_targets(asked: list[str] | None, registered: list[str]) -> list[str]:
    """All registered ones for nothing, 'all', '*' or '__all__'; an unknown one is an error."""
    if not asked or {"all", "*", "__all__"} & {a.strip().lower() for a in asked}:
        return list(registered)
    if unknown := [a for a in asked if a not in registered]:
        raise ValueError(f"unknown targets: {', '.join(unknown)}")
    return list(dict.fromkeys(asked))
