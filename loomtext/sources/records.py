"""Records of several types in one JSON column, told apart by a name in `_class`: written, read into VARIANT columns, and checked.

Fields that a record lacks take its type's defaults; those that are required are an error, as are offsets that are not in order. Unknown
types are read as the base type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = "Chunk"
# The types of records, and their fields beyond the base type's.
TYPES = {
    BASE: (),
    "ProseChunk": ("math_placeholders", "term_placeholders", "protected_text", "domain_hint"),
    "StructuralChunk": ("raw_content",),
}
KINDS = {"ProseChunk": "prose", "StructuralChunk": "structural"}
FIELDS = {
    "id": "string", "text": "string", "chunk_type": "string", "start_pos": "bigint", "end_pos": "bigint", "metadata": "map<string,string>",
    "math_placeholders": "map<string,string>", "term_placeholders": "map<string,string>", "protected_text": "string", "domain_hint": "string", "raw_content": "string",
}
REQUIRED = ("id", "text", "chunk_type", "start_pos", "end_pos")


def encoded(record: Column) -> Column:
    """A record as JSON with its `_class`. The column is a struct of record_class and FIELDS; fields of other types are left out."""
    name = F.coalesce(record["record_class"], F.lit(BASE))
    own = {f: t for t, fields in TYPES.items() for f in fields}
    parts = [F.when(name == own[f], record[f]).otherwise(F.lit(None)).alias(f) if f in own else record[f].alias(f) for f in FIELDS]
    return F.to_json(F.struct(*parts, name.alias("_class")))


def problem(record: Column) -> Column:
    """Why a decoded record is none, or null."""
    start, end = record["start_pos"], record["end_pos"]
    missing = F.array_join(F.filter(F.array(*[F.when(record[f].isNull(), F.lit(f)) for f in REQUIRED]), lambda x: x.isNotNull()), ", ")
    return (
        F.when(missing != "", F.concat(F.lit("missing: "), missing))
        .when(~record["chunk_type"].isin("prose", "structural"), F.concat(F.lit("unknown chunk_type: "), record["chunk_type"]))
        .when(start < 0, F.format_string("start_pos %d is negative", start))
        .when(end < start, F.format_string("end_pos %d lies before start_pos %d", end, start))
    )


def read(json: Column) -> Column:
    """A struct of record_class and FIELDS from a JSON text, with the type's defaults. What is no JSON object is a record without fields."""
    value = F.try_parse_json(json)
    get = lambda path, kind: F.try_variant_get(value, f"$.{path}", kind)
    named = F.coalesce(get("_class", "string"), F.lit(BASE))
    name = F.when(named.isin(*TYPES), named).otherwise(F.lit(BASE))
    none = F.create_map().cast("map<string,string>")
    default = {"metadata": none, "math_placeholders": none, "term_placeholders": none, "protected_text": get("text", "string"), "domain_hint": F.lit(""), "raw_content": get("text", "string")}
    columns = []
    for f, kind in FIELDS.items():
        found = F.coalesce(get(f, kind), default[f]) if f in default else get(f, kind)
        owner = next((t for t, fields in TYPES.items() if f in fields), None)
        if f == "chunk_type":  # set by the type where it has one
            found = F.when(name == "ProseChunk", KINDS["ProseChunk"]).when(name == "StructuralChunk", KINDS["StructuralChunk"]).otherwise(found)
        columns.append((found if owner is None else F.when(name == owner, found)).alias(f))
    return F.struct(name.alias("record_class"), *columns)


def decoded(df: DataFrame, json: str, into: str = "record", strict: bool = True) -> DataFrame:
    """Adds the record in a JSON column; a bad one is an error if strict, else `<into>_problem` tells what is wrong and the record is null."""
    df = df.withColumn("_record", read(F.col(json)))
    why = problem(F.col("_record"))
    if strict:
        return df.withColumn(into, F.when(why.isNull(), F.col("_record")).otherwise(F.raise_error(F.concat(F.lit("bad record, "), why)))).drop("_record")
    return df.withColumn(f"{into}_problem", why).withColumn(into, F.when(why.isNull(), F.col("_record"))).drop("_record")
