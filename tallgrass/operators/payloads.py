"""Payloads that a model extracted: aliases, unwrapping, the best of several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DateType, DecimalType, MapType, StructType, TimestampNTZType, TimestampType

from ..functions.scoring import completeness
from .lifecycle import latest

# Other names of fields, in the order they are tried.
DATE_ALIASES = (
    "posted_date", "posted_at", "postedAt", "postedDate", "date_posted", "datePosted", "published_at", "publishedAt", "published_date", "publishedDate", "posting_date", "postingDate", "posted",
)
ALIASES = {"title": ("title",), "job_url": ("job_url",), "location_text": ("location_text", "location"), "employment_type": ("employment_type", "employmentType"), "apply_url": ("apply_url", "applyUrl"), "posted_date": DATE_ALIASES, "summary": ("summary",)}
LISTS = ("responsibilities", "required_skills", "preferred_skills")


def field(payload: Column, name: str) -> Column:
    """A field under any of its names; a list field as a list, from a list or one text."""
    if name in LISTS:
        raw = F.get_json_object(payload, f"$.{name}")
        return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull() & ~raw.startswith("{"), F.array(raw)).otherwise(F.array().cast("array<string>"))
    return F.coalesce(*[F.get_json_object(payload, f"$.{a}") for a in ALIASES[name]])


def _within(payload: Column, names: tuple[str, ...], fits) -> Column:
    """What is under the first of some names and fits, else the payload; each path is read once."""
    return F.element_at(F.transform(F.array(payload), lambda p: F.coalesce(F.try_element_at(F.filter(F.array(*[F.get_json_object(p, f"$.{k}") for k in names]), fits), F.lit(1)), p)), 1)


def candidates(payload: Column) -> Column:
    """The objects in a payload: of a wrapper 'job', 'item', 'record' or 'data', of a list under their plurals, of a list, or itself."""
    inner = _within(payload, ("job", "item", "record", "data"), lambda x: x.startswith("{"))
    many = _within(inner, ("jobs", "items", "records", "data"), lambda x: x.startswith("[") & (x != "[]"))
    none = F.array().cast("array<string>")
    listed = lambda m: F.transform(F.from_json(m, "array<map<string,string>>"), lambda x: F.to_json(x))
    return F.element_at(F.transform(F.array(many), lambda m: F.when(F.ltrim(m).startswith("["), F.coalesce(listed(m), none)).when(F.ltrim(m).startswith("{"), F.array(m)).otherwise(none)), 1)


def best(rows: DataFrame, key: str, payload: str, url: str) -> DataFrame:
    """The most complete object of each row's payload under its usual field names, the first of equals; rows without any are dropped."""
    each = rows.select(key, url, F.posexplode(candidates(F.col(payload))).alias("at", "p"))
    names = [*ALIASES, *LISTS]
    fields = each.select(key, "at", *[(F.coalesce(field(F.col("p"), n), F.col(url)) if n == "job_url" else field(F.col("p"), n)).alias(n) for n in names])
    filled = {n: (F.size(n) > 0) if n in LISTS else F.coalesce(F.col(n), F.lit("")) != "" for n in names}
    return latest(fields.withColumn("score", completeness(filled)), [key], F.desc("score"), F.col("at")).drop("at")


def valid(rows: DataFrame) -> DataFrame:
    return rows.where("coalesce(title, '') <> '' and coalesce(job_url, '') <> ''")


# --- against a schema -----------------------------------------------------------------------

#: A posting: text or nothing, and lists of texts that may be absent.
POSTING = {
    **dict.fromkeys(("title", "job_url", "apply_url", "company", "location_text", "employment_type", "duration", "compensation_text", "posted_date", "summary"), "text?"),
    **dict.fromkeys(("responsibilities", "required_skills", "preferred_skills"), ["text"]),
    "job_reference": "text?",
}
_KINDS = {"text": ("STRING",), "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "bool": ("BOOLEAN",)}
_DDL = {"text": "string", "number": "double", "bool": "boolean"}


def checked(payload: Column, schema: dict) -> Column:
    """A JSON text against a schema: a struct of value (typed, null if anything is wrong) and fault (the path of the first fault in the schema's order, ``$`` for what is no object, null if none).

    A schema maps fields to ``text``, ``number`` or ``bool`` (with ? may be null or absent), to [kind] for a list (absent: empty; null: a fault), or to another schema for an object that must be there. Types are taken
    as they are: a number is no text. Fields beyond the schema are ignored. The payload is parsed once, into a variant.
    """

    def of(v: Column) -> Column:
        object_ = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
        value, faults = _walk(v, schema, "$")
        fault = F.when(~object_, "$").otherwise(F.coalesce(*faults, F.lit(None).cast("string")))
        return F.struct(F.when(fault.isNull(), value).alias("value"), fault.alias("fault"))

    return F.transform(F.array(F.try_parse_json(payload)), of)[0]


def _walk(v: Column, schema: dict, path: str) -> tuple[Column, list[Column]]:
    values, faults = [], []
    for name, kind in schema.items():
        at = f"{path}.{name}"
        raw = F.try_variant_get(v, at, "variant")
        type_ = F.coalesce(F.schema_of_variant(raw), F.lit("ABSENT"))
        if isinstance(kind, dict):
            value, more = _walk(v, kind, at)
            faults.append(F.when(~type_.startswith("OBJECT"), at).otherwise(F.coalesce(*more, F.lit(None).cast("string"))))
            values.append(value.alias(name))
        elif isinstance(kind, list):
            items = F.try_variant_get(v, at, "array<variant>")
            wrong = _wrong_items(items, kind[0])
            faults.append(F.when(type_ == "ABSENT", F.lit(None)).when(~type_.startswith("ARRAY"), at).when(F.size(wrong) > 0, F.concat(F.lit(f"{at}["), F.element_at(wrong, 1).cast("string"), F.lit("]"))))
            listed = F.try_variant_get(v, at, f"array<{_DDL[kind[0]]}>")
            values.append(F.coalesce(listed, F.array().cast(f"array<{_DDL[kind[0]]}>")).alias(name))
        else:
            plain = kind.rstrip("?")
            blank = type_.isin("ABSENT", "VOID") if kind.endswith("?") else F.lit(False)
            faults.append(F.when(~blank & ~_is(type_, plain), at))
            values.append(F.try_variant_get(v, at, _DDL[plain]).alias(name))
    return F.struct(*values), faults


def _wrong_items(items: Column, kind: str) -> Column:
    """The places of items that aren't of a kind."""
    return F.filter(F.transform(items, lambda x, i: F.when(~_is(F.coalesce(F.schema_of_variant(x), F.lit("VOID")), kind), i)), lambda i: i.isNotNull())


def _is(type_: Column, kind: str) -> Column:
    out = F.lit(False)
    for t in _KINDS[kind]:
        out = out | type_.startswith(t)
    return out


def plain_data(c: Column, kind: DataType) -> Column:
    """Nested values as JSON text can hold them, at any depth: dates as yyyy-MM-dd, times in UTC to the microsecond with Z, binary as base 64, decimals as doubles, keys of maps as text. Structs, lists and nulls stay."""
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[plain_data(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: plain_data(x, kind.elementType))
    if isinstance(kind, MapType):
        keys, values = F.transform(F.map_keys(c), lambda k: plain_data(k, kind.keyType).cast("string")), F.transform(F.map_values(c), lambda x: plain_data(x, kind.valueType))
        return F.map_from_arrays(keys, values)
    if isinstance(kind, DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    if isinstance(kind, BinaryType):
        return F.base64(c)
    if isinstance(kind, DecimalType):
        return c.cast("double")
    return c


def plain_json(df: DataFrame, *columns: str) -> Column:
    """Columns of ``df`` as one JSON object with nulls, its fields in the order of their names, as those of all objects in it."""
    names = sorted(columns)
    whole = F.struct(*[plain_data(F.col(n), df.schema[n].dataType).alias(n) for n in names])
    return F.to_json(F.to_variant_object(whole))
