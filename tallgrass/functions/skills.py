"""Skill lists as columns: canonical names, terms found in text, domains."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import keep_first, once, unique_by_lower

# Labels and word endings that aren't skills, display names, terms looked for in free text.
LABELS = (
    "programming language", "programming languages", "framework", "frameworks", "framework and tools", "frameworks and tools", "tools",
    "tools and platforms", "generative ai technologies", "gen ai technologies", "vector databases", "nosql and sql databases",
    "sql and nosql databases", "deployment platform", "deployment platforms", "ci/cd", "cicd", "ai/ml techniques",
    "machine learning techniques", "databases", "cloud platforms", "cloud platform", "data engineering tools", "analytics tools",
    "development tools",
)
FRAGMENTS = (
    " category", " categories", " technologies", " techniques", " platform", " platforms", " language", " languages", " framework",
    " frameworks", " tools", " databases",
)
ALIASES = {
    "py spark": "PySpark", "pyspark": "PySpark", "spark": "Spark", "apache spark": "Spark", "python": "Python", "java": "Java",
    "javascript": "JavaScript", "typescript": "TypeScript", "sql": "SQL", "nosql": "NoSQL", "aws": "AWS", "azure": "Azure", "gcp": "GCP",
    "llm": "LLM", "rag": "RAG", "nlp": "NLP", "opencv": "OpenCV", "fastapi": "FastAPI", "mlflow": "MLflow", "pytorch": "PyTorch",
    "tensorflow": "TensorFlow", "scikit-learn": "scikit-learn", "sklearn": "scikit-learn", "xgboost": "XGBoost", "lightgbm": "LightGBM",
    "mongodb": "MongoDB", "postgresql": "PostgreSQL", "postgres": "PostgreSQL", "qdrant": "Qdrant", "pinecone": "Pinecone", "faiss": "FAISS",
    "langchain": "LangChain", "langgraph": "LangGraph", "kubernetes": "Kubernetes", "docker": "Docker", "bentoml": "BentoML",
    "zenml": "ZenML", "airflow": "Airflow", "kafka": "Kafka", "databricks": "Databricks", "snowflake": "Snowflake",
}
KNOWN = (
    "python", "java", "javascript", "typescript", "sql", "nosql", "scala", "r", "spark", "apache spark", "pyspark", "databricks", "snowflake",
    "redshift", "aws", "azure", "gcp", "s3", "lambda", "glue", "emr", "airflow", "kafka", "hadoop", "hive", "dbt", "docker", "kubernetes",
    "terraform", "jenkins", "github actions", "ci/cd", "fastapi", "django", "flask", "react", "angular", "node.js", "spring boot", "pytorch",
    "tensorflow", "scikit-learn", "sklearn", "xgboost", "lightgbm", "mlflow", "zenml", "bentoml", "opencv", "nlp", "llm", "rag", "langchain",
    "langgraph", "mongodb", "postgresql", "postgres", "mysql", "oracle", "qdrant", "pinecone", "faiss", "power bi", "tableau", "excel", "jira",
    "confluence",
)
DOMAINS = (
    ("Generative AI/RAG", ("rag", "langchain", "llm", "genai", "openai", "prompt engineering", "bedrock")),
    ("Data Science", ("data scientist", "data science", "machine learning", "pytorch", "tensorflow", "scikit", "opencv", "pyspark", "mlflow", "model")),
    ("MLOps", ("mlflow", "dvc", "bentoml", "zenml", "docker", "kubernetes", "github actions", "jenkins", "terraform", "torch-serve")),
    ("Cloud AI", ("aws", "azure", "azure ai", "aws bedrock", "hugging face", "cloud")),
    ("Banking/Financial Services", ("bank", "banking", "sbi", "sbi-card", "bank of baroda", "fraud", "financial")),
    ("Full Stack Web Development", ("react", "next.js", "node", "express", "fastapi", "mongodb", "frontend", "backend")),
    ("Frontend Engineering", ("react", "next.js", "javascript", "typescript", "tailwind", "frontend")),
    ("Backend Engineering", ("fastapi", "node", "express", "api", "mongodb", "mysql", "backend")),
)


def skill_key(c: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(F.trim(c), r"\s+", " ")), F.lit(" .,:;()[]{}"))


def canonical_skill(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """A skill's display name; null for labels, fragments of up to five words, blanks and over 80 characters."""
    names = ALIASES if aliases is None else aliases

    def named(text: Column, key: Column) -> Column:
        fragment = F.lit(False)
        for f in FRAGMENTS:
            fragment = fragment | F.concat(F.lit(" "), key).contains(f)
        noise = (key == "") | key.isin(*LABELS) | (fragment & (F.size(F.split(key, " ")) <= 5) & ~key.isin(*KNOWN)) | (F.length(text) > 80)
        shown = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key), text) if names else text
        return F.when(~noise, shown)

    return once(F.trim(F.regexp_replace(F.trim(c), r"\s+", " "), F.lit(" -•\t\n\r")), lambda text: once(skill_key(text), lambda key: named(text, key)))


def unique_skills(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Canonical skills, the first of each key, in order."""
    shown = F.filter(F.transform(c, lambda x: canonical_skill(x, aliases)), lambda x: x.isNotNull())
    return keep_first(shown, skill_key)


def words_apart(text: Column) -> Column:
    """The runs of [a-z0-9+#.-] in a lower-cased text; a term of such characters stands by itself where it is one of them."""
    return F.regexp_extract_all(text, F.lit("[a-z0-9+#.-]+"), 0)


def terms_in(text: Column, vocabulary: tuple[str, ...] = KNOWN) -> Column:
    """Terms that stand in a text by themselves, longest first (ties by name).

    Terms of one word are looked up in the set of the text's words, all at once; only the few of several words are searched for.
    """
    flat = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^a-zA-Z0-9+#./-]+", " "), F.lit(" "))
    ordered = sorted(vocabulary, key=lambda t: (-len(t), t))
    several = [t for t in ordered if not re.fullmatch(r"[a-z0-9+#.-]+", t)]
    inside = lambda t: rf"(?<![a-zA-Z0-9+#.-])\Q{t}\E(?![a-zA-Z0-9+#.-])"
    found = lambda x: F.concat(words_apart(x), *([F.array(*[F.when(x.contains(t) & x.rlike(inside(t)), F.lit(t)) for t in several])] if several else []))
    # the flat text is made once, as the only item of a list
    return F.transform(F.array(flat), lambda x: F.array_intersect(F.array(*map(F.lit, ordered)), found(x)))[0]


def domains(text: Column, rules=DOMAINS) -> Column:
    low = F.lower(text)
    found = []
    for name, keywords in rules:
        hit = F.lit(False)
        for k in keywords:
            hit = hit | low.contains(k)
        found.append(F.when(hit, F.lit(name)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def profile_skills(explicit: list[Column], free_text: Column) -> Column:
    """Declared skills first, then those mined from text; labels never."""
    listed = F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in explicit]))
    return unique_by_lower(F.concat(unique_skills(listed), unique_skills(terms_in(free_text))))
