"""Tower records: the texts of jobs and candidates that are embedded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import skills as sk
from ..functions.text import compact, once, string_list


def labelled(label: str, value: Column) -> Column:
    """'label: value', null for a null or empty value."""
    return once(value.cast("string"), lambda v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{label}: "), v)))


def listed(label: str, items: Column, joiner: str = ", ") -> Column:
    return labelled(label, F.array_join(string_list(items), joiner))


def paragraphs(*parts: Column) -> Column:
    """Filled parts with their white space collapsed, one a line."""
    filled = F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.trim(p) != ""))
    return F.array_join(F.transform(filled, lambda p: F.array_join(F.filter(F.split(p, r"\s+"), lambda w: w != ""), " ")), "\n")


def job_tower(jobs: DataFrame) -> DataFrame:
    """Five texts of each job: title, requirements, responsibilities, compensation, and all of them."""
    title = paragraphs(*[labelled(n, F.col(c)) for n, c in (("Title", "title"), ("Company", "company"), ("Location", "location_text"), ("Employment type", "employment_type"), ("Duration", "duration"))])
    needs = paragraphs(listed("Required skills", F.col("required_skills")), listed("Preferred skills", F.col("preferred_skills")), labelled("Summary", F.col("summary")))
    duties = F.coalesce(listed("Responsibilities", F.col("responsibilities"), " "), F.lit(""))
    pay = F.coalesce(labelled("Compensation", F.col("compensation_text")), F.lit(""))
    made = jobs.select(F.concat(F.lit("jobtw_"), F.col("job_id").cast("string")).alias("job_tower_id"), "job_id", title.alias("title_text"), needs.alias("requirements_text"), duties.alias("responsibilities_text"), pay.alias("compensation_text"))
    # blocks keep their lines inside the whole: each is one part, as a line of its own
    return made.withColumn("embedding_text", paragraphs(*[F.col(c) for c in ("title_text", "requirements_text", "responsibilities_text", "compensation_text")]))


def candidate_tower(profiles: DataFrame) -> DataFrame:
    """Texts of each profile: identity, skills, experience, education, and all of them.

    profiles: sha256, full_name, headline, current_title, current_company, location, total_experience_years, summary, skills, domains, certifications,
    experience array<struct<title,company,responsibilities>>, education array<struct<degree,field_of_study,institution>>.
    """
    years = F.col("total_experience_years")
    identity = paragraphs(*map(F.col, ("full_name", "headline", "current_title", "current_company", "location")), F.when(years.isNotNull(), F.concat(F.lit("Total experience: "), years.cast("string"), F.lit(" years"))))
    own = sk.profile_skills([F.col("skills"), F.col("certifications")], F.concat_ws(" ", "summary", "headline", "current_title"))
    skill_text = paragraphs(listed("Skills", own), listed("Domains", F.col("domains")), listed("Certifications", F.col("certifications")))
    job = lambda e: paragraphs(e.title, e.company, listed("Responsibilities", e.responsibilities, " "))
    school = lambda e: paragraphs(e.degree, e.field_of_study, e.institution)
    lines = lambda c, f: F.array_join(F.filter(F.transform(F.coalesce(F.col(c), F.array()), lambda e: F.regexp_replace(f(e), "\n", " ")), lambda x: x != ""), "\n")
    made = profiles.select(
        F.concat(F.lit("cand_"), F.left("sha256", F.lit(24))).alias("candidate_id"), identity.alias("identity_text"), skill_text.alias("skills_text"),
        lines("experience", job).alias("experience_text"), lines("education", school).alias("education_text"), F.col("summary").alias("about"), own.alias("skills"),
    )
    return made.withColumn("embedding_text", paragraphs(*[F.col(c) for c in ("identity_text", "about", "skills_text", "experience_text", "education_text")])).drop("about")


def parsed_tower(profiles: DataFrame) -> DataFrame:
    """As candidate_tower, from a parsed profile: labels always there, fields of an item between bars, domains inferred if empty."""
    join = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    domains = F.when(F.size(F.coalesce("domains", F.array().cast("array<string>"))) > 0, F.array_join("domains", ", ")).otherwise(F.array_join(sk.domains(F.concat_ws(" ", "current_title", "headline", "summary", F.array_join("skills", ", "))), ", "))
    skill_text = compact(F.concat(F.lit("Skills: "), join("skills"), F.lit("\nDomains: "), domains, F.lit("\nCertifications: "), join("certifications")))
    item = lambda e: compact(F.concat_ws(" | ", F.coalesce(e.title, F.lit("")), F.coalesce(e.company, F.lit("")), F.concat(F.lit("Responsibilities: "), F.array_join(F.coalesce(e.responsibilities, F.array().cast("array<string>")), " "))))
    jobs = compact(F.array_join(F.transform(F.coalesce(F.col("experience"), F.array()), item), "\n"))
    identity = compact(F.concat_ws("\n", text("full_name"), text("headline"), text("current_title"), text("current_company"), text("location")))
    made = profiles.select(F.concat(F.lit("cand_"), F.left("sha256", F.lit(24))).alias("candidate_id"), identity.alias("identity_text"), skill_text.alias("skills_text"), jobs.alias("experience_text"), F.coalesce("summary", F.lit("")).alias("about"))
    return made.withColumn("embedding_text", compact(F.concat_ws("\n\n", "identity_text", "about", "skills_text", "experience_text"))).drop("about")
