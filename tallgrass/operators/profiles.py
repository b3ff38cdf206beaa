"""Candidate profiles: state, edits and what they break, texts after an edit, skills that matching reads, onboarding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skills import words_apart
from ..functions.text import brief, unique_by_lower
from .lifecycle import upsert

# Fields that nobody edits, those that can be edited, what some may hold, and lengths of texts and lists.
LOCKED = ("full_name", "name", "email", "candidate_id", "resume_id", "sha256", "source_file_name")
MATCHING_FIELDS = ("location", "current_title", "current_company", "total_experience_years", "skills", "domains", "target_roles", "preferred_locations", "remote_preference", "employment_type", "seniority_level")
OTHER_FIELDS = ("phone", "linkedin_url", "github_url", "portfolio_url", "notice_period", "expected_compensation", "summary")
TEXT_LENGTHS = {"phone": 40, "location": 160, "current_title": 160, "current_company": 160, "remote_preference": 40, "employment_type": 80, "seniority_level": 80, "linkedin_url": 500, "github_url": 500, "portfolio_url": 500, "notice_period": 80, "expected_compensation": 120, "summary": 2000}
LIST_LENGTHS = {"skills": 120, "domains": 40, "target_roles": 30, "preferred_locations": 40}
REMOTE_CHOICES = ("remote", "hybrid", "onsite", "no_preference")
PHONE = r"^[+0-9][0-9\s().-]{6,24}$"
WEB_URL = r"(?i)^https?://[^\s]+$"
BUSY_UPLOADS = ("queued", "processing", "profile_extracting")
MATCHER_TERMS = (
    "python", "java", "scala", "sql", "spark", "pyspark", "databricks", "snowflake", "redshift", "aws", "azure", "gcp", "airflow", "kafka", "hadoop", "hive", "glue", "emr", "s3", "lambda", "terraform", "docker",
    "kubernetes", "fastapi", "pytorch", "tensorflow", "scikit-learn", "xgboost", "lightgbm", "mlflow", "langchain", "rag", "llm", "nlp", "opencv", "mongodb", "postgresql", "mysql", "oracle", "qdrant", "pinecone", "faiss",
)
MATCHER_SYNONYMS = {"pyspark": "spark", "apache spark": "spark", "amazon web services": "aws", "machine learning": "ml", "retrieval augmented generation": "rag"}


def state(linked: Column, has_tower: Column, upload_status: Column, profile_state: Column, onboarding: Column) -> Column:
    """(state, action) of a user's profile: the first rule that holds."""
    upload, own = F.lower(F.coalesce(upload_status, F.lit(""))), F.lower(F.coalesce(profile_state, F.lit("")))
    said = lambda s, a: F.struct(F.lit(s).alias("state"), F.lit(a).alias("action"))
    return (
        F.when(~F.coalesce(linked, F.lit(False)), said("blocked", "contact_support")).when(~F.coalesce(has_tower, F.lit(False)), said("conflict", "contact_support"))
        .when(upload.isin(*BUSY_UPLOADS) | (own == "processing"), said("processing", "wait_for_resume_processing")).when(upload == "failed", said("incomplete", "retry_resume_upload"))
        .when(F.coalesce(onboarding, F.lit(False)) | (own == "incomplete"), said("incomplete", "complete_profile")).otherwise(said("ready", "show_profile"))
    )


def cleaned(c: Column, most: int = 300) -> Column:
    """White space collapsed, cut to ``most`` characters; null for nothing."""
    return F.left(F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")), F.lit(most))


def normal_list(raw: Column, most: int = 80, most_chars: int = 80) -> Column:
    """A list from a text: parts between commas, semicolons and line ends, cleaned, the first of each but for case, at most ``most``."""
    items = F.transform(F.split(F.coalesce(raw, F.lit("")), r"[,\n;]+"), lambda x: cleaned(x, most_chars))
    return F.slice(unique_by_lower(F.filter(items, lambda x: x.isNotNull())), 1, most)


def experience(raw: Column) -> Column:
    """Years from 0 to 60 with one digit; null for other values."""
    n = raw.try_cast("double")
    return F.when(n.between(0, 60), F.bround(n, 1))


def patch_errors(patch: Column, full_name: Column, email: Column) -> Column:
    """What a patch (a map of texts by field) breaks, in the order of the rules; an empty list if it may be applied.

    Name and e-mail may be sent back as they are; other locked fields may not be there at all, nor fields that nobody knows.
    """
    has, value = lambda k: F.coalesce(F.map_contains_key(patch, k), F.lit(False)), lambda k: cleaned(F.element_at(patch, k), TEXT_LENGTHS.get(k, 300))
    differs = lambda new, old: F.coalesce(F.lower(new) != F.lower(cleaned(old)), F.lit(False))
    keys = F.array_sort(F.map_keys(patch))
    locked = F.filter(keys, lambda k: k.isin(*[f for f in LOCKED if f not in ("full_name", "name", "email")]))
    unknown = F.filter(keys, lambda k: ~k.isin(*LOCKED, *MATCHING_FIELDS, *OTHER_FIELDS))
    # the full name as it came, blank or not, goes before the other one
    name = cleaned(F.coalesce(F.nullif(F.element_at(patch, "full_name"), F.lit("")), F.element_at(patch, "name")), 300)
    years = F.element_at(patch, "total_experience_years")
    filled = has("total_experience_years") & (F.coalesce(years, F.lit("")) != "")
    url = lambda k: F.when(~value(k).rlike(WEB_URL), F.concat(F.lit(k), F.lit(" is no web address")))
    rules = [
        F.when(differs(name, full_name), "name is locked"), F.when(differs(value("email"), email), "email is locked"),
        F.when(F.size(locked) > 0, F.concat(F.lit("locked: "), F.array_join(locked, ", "))), F.when(~value("phone").rlike(PHONE), "phone is invalid"),
        F.when(filled & years.try_cast("double").isNull(), "experience is no number"), F.when(filled & ~years.try_cast("double").between(0, 60), "experience is not 0 to 60"),
        F.when(~value("remote_preference").isin(*REMOTE_CHOICES), "remote_preference is unknown"), *map(url, ("linkedin_url", "github_url", "portfolio_url")),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(unknown, ", "))),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def patched(patch: Column) -> dict[str, Column]:
    """A patch's normalised values by field; null where the patch has no such field, or clears it."""
    texts = {k: cleaned(F.element_at(patch, k), n) for k, n in TEXT_LENGTHS.items()}
    lists = {k: F.when(F.map_contains_key(patch, k), normal_list(F.element_at(patch, k), n)) for k, n in LIST_LENGTHS.items()}
    return texts | lists | {"total_experience_years": experience(F.element_at(patch, "total_experience_years"))}


def effective_texts(rows: DataFrame) -> DataFrame:
    """Adds identity_text, skills_text and embedding_text of profiles whose edits are laid over them.

    rows: full_name, current_title, current_company, location, total_experience_years, remote_preference, preferred_locations, target_roles,
    skills, domains, summary, experience_text, education_text.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    join = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", ")
    after = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))
    parts = [text("full_name"), text("current_title"), text("current_company"), text("location"), F.concat(F.lit("Total experience: "), F.col("total_experience_years").cast("string"), F.lit(" years"))]
    parts += [after("Remote preference: ", text("remote_preference")), after("Preferred locations: ", join("preferred_locations")), after("Target roles: ", join("target_roles"))]
    filled = lambda items: F.filter(F.array(*items), lambda x: F.coalesce(x, F.lit("")) != "")
    out = rows.withColumns({"identity_text": F.trim(F.array_join(filled(parts), "\n")), "skills_text": F.trim(F.concat(F.lit("Skills: "), join("skills"), F.lit("\nDomains: "), join("domains")))})
    return out.withColumn("embedding_text", F.trim(F.array_join(filled([F.col("identity_text"), text("summary"), F.col("skills_text"), text("experience_text"), text("education_text")]), "\n\n")))


def resume_email(parsed: Column, login: Column) -> Column:
    """(accepted, email): a résumé's e-mail must be the verified login's, which stands where it has none."""
    p, own = F.lower(F.trim(F.coalesce(parsed, F.lit("")))), F.lower(F.trim(login))
    return F.struct(((p == "") | (p == own)).alias("accepted"), own.alias("email"))


def onboarded(towers: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Towers with an empty one, to be completed, for each user without any; towers that are there stay as they are.

    towers: candidate_id, email, profile_state, onboarding_required, superseded_by, created_at; users: candidate_id, email.
    """
    shells = users.select("candidate_id", F.lower("email").alias("email"), F.lit("incomplete").alias("profile_state"), F.lit(True).alias("onboarding_required"), F.lit(None).cast("string").alias("superseded_by"), now.alias("created_at"))
    return upsert(towers, shells, ["candidate_id"], once=tuple(c for c in towers.columns if c != "candidate_id"))


def superseded(towers: DataFrame, replaced: DataFrame) -> DataFrame:
    """Shells that another tower has replaced (candidate_id, by) say by which, and need no onboarding any more."""
    j = towers.join(replaced.select("candidate_id", F.col("by").cast("string").alias("by")), "candidate_id", "left")
    done = F.col("by").isNotNull()
    new = {"profile_state": F.lit("superseded"), "onboarding_required": F.lit(False), "superseded_by": F.col("by")}
    return j.select(*[F.when(done, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in towers.columns])


def matcher_skill(c: Column) -> Column:
    """A skill as matching compares it: lower case, without marks around it, synonyms as one."""
    low = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^[.,:;()\[\]{}]+|[.,:;()\[\]{}]+$", ""), r"\s+", " ")
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in MATCHER_SYNONYMS.items() for x in pair]), low), low)


def matcher_skills(lists: list[Column], record: Column) -> Column:
    """The set of skills of a record, sorted: those it lists, and the known terms in the whole of its JSON text."""
    named = F.create_map(*[F.lit(x) for t in MATCHER_TERMS for x in (t, MATCHER_SYNONYMS.get(t, t))])
    empty = F.array().cast("array<string>")
    mined = F.transform(F.array_intersect(F.array(*map(F.lit, MATCHER_TERMS)), F.coalesce(words_apart(F.lower(record)), empty)), lambda t: named[t])
    every = F.concat(*[F.transform(F.coalesce(x, empty), matcher_skill) for x in lists], mined)
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != ""))))


def as_text(c: Column) -> Column:
    """A value as text; null for nothing but white space."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def number_in(c: Column) -> Column:
    """The first number of a text, null without any."""
    return F.nullif(F.regexp_extract(c, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def comma_list(c: Column) -> Column:
    """The filled parts of a text between commas."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def candidate_brief(rows: DataFrame) -> DataFrame:
    """What a scorer sees of a candidate: texts cut to their lengths, lists as they are."""
    cut = {"identity_text": 1200, "skills_text": 1800, "experience_text": 2500, "education_text": 1000}
    own = ("candidate_id", "resume_id", "full_name", "headline", "current_title", "current_company", "total_experience_years", "skills", "domains", "location")
    return rows.select(*[c for c in own if c in rows.columns], *[brief(F.col(c), n).alias(c) for c, n in cut.items() if c in rows.columns])


def by_verified_email(emails: DataFrame, towers: DataFrame, resumes: DataFrame) -> DataFrame:
    """(email, candidate_id) of towers with a verified e-mail themselves or through their résumé's contact, each once.

    emails: email, verified; towers: candidate_id, resume_id, email; resumes: resume_id, contact_email.
    """
    key = lambda c: F.lower(F.trim(F.col(c))).alias("email")
    wanted = emails.where("verified").select(key("email")).where("email <> ''").distinct()
    direct = towers.select(key("email"), "candidate_id")
    through = resumes.select(key("contact_email"), "resume_id").join(towers.select("resume_id", "candidate_id"), "resume_id").select("email", "candidate_id")
    return direct.unionByName(through).where("candidate_id is not null").join(wanted, "email", "left_semi").distinct()


def unqueued(asked: DataFrame, requests: DataFrame) -> DataFrame:
    """Inputs (candidate_id, input_hash) that no queued or running request already has, each once."""
    open_ = requests.where(F.col("status").isin("queued", "running")).select("candidate_id", "input_hash")
    return asked.select("candidate_id", "input_hash").distinct().join(open_, ["candidate_id", "input_hash"], "left_anti")
