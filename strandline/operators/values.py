"""Values inside JSON texts and results: recursive walks, shrinking to a budget, the source of a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A JSON string with its escapes; keys are strings with a colon behind them.
_STRING = r'"(?:[^"\\]|\\.)*"'
#: Levels that a walk goes down before it asks whether there are more.
DEPTH = 8


def json_leaves(df: DataFrame, text: str) -> DataFrame:
    """A row for each leaf at any depth of the JSON texts of a column: the columns of ``df`` with path (``$.a[0].b``), name (the
    nearest key above, null if there is none), kind (string, number, boolean or null) and value (as text, null for null).

    Texts are parsed once into variants, which are then exploded level by level: leaves pass through, containers give their
    children, so a level adds no join and no shuffle. How deep it goes is read off the data, ``DEPTH`` levels at a time. Empty
    containers, null texts and texts that are no JSON, or have a key twice in one object, give no rows. Columns of ``df`` with
    the names of the results are replaced.
    """
    made = ("path", "name", "kind", "value")
    own = df.withColumns({"_v": F.try_parse_json(text), "_path": F.lit("$"), "_name": F.lit(None).cast("string")}).where("_v is not null").drop(*[c for c in made if c != text])
    kind = F.schema_of_variant("_v")
    while True:
        for _ in range(DEPTH):
            columns = [c for c in own.columns if not c.startswith("_")]
            step = own.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()).toDF("_pos", "_key", "_child"))
            part = F.when(F.col("_key").isNotNull(), F.concat(F.lit("."), F.col("_key"))).when(F.col("_pos").isNotNull(), F.concat(F.lit("["), F.col("_pos"), F.lit("]"))).otherwise("")
            inside = F.col("_pos").isNotNull()
            own = step.select(*columns, F.when(inside, F.col("_child")).otherwise(F.col("_v")).alias("_v"), F.concat("_path", part).alias("_path"), F.coalesce("_key", "_name").alias("_name"))
        if own.where((kind.startswith("OBJECT<") & (kind != "OBJECT<>")) | (kind.startswith("ARRAY<") & (F.col("_v").cast("string") != "[]"))).isEmpty():
            break
    name = F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    leaves = own.where(~kind.startswith("OBJECT<") & ~kind.startswith("ARRAY<"))
    return leaves.select(*[c for c in leaves.columns if not c.startswith("_") and c not in made], F.col("_path").alias("path"), F.col("_name").alias("name"), name.alias("kind"), F.col("_v").cast("string").alias("value"))


def json_strings(text: Column) -> Column:
    """Array of the string values at any depth of a JSON text, unescaped, in order; keys are none of them. Whole strings are
    matched from the front, so that what stands inside one is never taken for another, and those with a colon behind go."""
    found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(rf"({_STRING})(\s*:)?"), F.lit(k)).alias(c) for k, c in ((1, "s"), (2, "colon"))])
    quoted = F.filter(found, lambda x: x["colon"] == "")
    return F.transform(quoted, lambda x: F.from_json(F.concat(F.lit('{"v":'), x["s"], F.lit("}")), "v string")["v"])


def json_numbers(text: Column) -> Column:
    """Array of the distinct numbers at any depth of a JSON text, sorted; booleans and digits inside strings are none."""
    bare = F.regexp_replace(text, _STRING, '""')
    found = F.regexp_extract_all(bare, F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("double"))))


def shrunk(df: DataFrame, result: str, keep: list[str], bulky: dict[str, str], budget: int) -> DataFrame:
    """``df`` with shrunk: the struct column ``result`` as JSON within a budget of characters.

    Bulky arrays are replaced by a text that counts them. What is then too long keeps the fields of ``keep``, whole, and the
    rest as the first half budget of its own JSON, under ``_truncated_fields``.
    """
    fields = df.schema[result].dataType.fieldNames()

    def value(f: str) -> Column:
        c = F.col(f"{result}.{f}")
        return F.when(c.isNotNull(), F.concat(F.lit("<"), F.size(c).cast("string"), F.lit(f" {bulky[f]}>"))).alias(f) if f in bulky else c.alias(f)

    whole = F.to_json(F.struct(*[value(f) for f in fields]))
    rest = F.to_json(F.struct(*[value(f) for f in fields if f not in keep]))
    cut = F.to_json(F.struct(*[value(f) for f in fields if f in keep], F.substring(rest, 1, budget // 2).alias("_truncated_fields")))
    return df.withColumn("shrunk", F.when(F.char_length(whole) <= budget, whole).otherwise(cut))


def number_source(number: Column, question: Column, prose: Column, values: Column) -> Column:
    """Where an unsupported number may come from, the first that fits: question, a text that a tool returned, the sum, the
    difference, the ratio or the percentage of two values, else none."""
    shown = F.regexp_replace(number.cast("decimal(38,6)").cast("string"), r"\.?0+$", "")
    word = F.concat(F.lit(r"(?<![\d.])"), F.replace(shown, F.lit("."), F.lit(r"\.")), F.lit(r"(?![\d]|\.\d)"))
    near = lambda x: F.abs(x - number) <= 0.011
    pair = lambda f: F.exists(values, lambda a: F.exists(values, lambda b: near(f(a, b))))
    return (
        F.when(F.coalesce(F.regexp_like(question, word), F.lit(False)), "question")
        .when(F.coalesce(F.regexp_like(prose, word), F.lit(False)), "returned text")
        .when(pair(lambda a, b: a + b), "sum")
        .when(pair(lambda a, b: a - b), "difference")
        .when(pair(lambda a, b: F.when(b != 0, a / b)), "ratio")
        .when(pair(lambda a, b: F.when(b != 0, 100 * a / b)), "percentage")
        .otherwise("none")
    )
