"""Seed tasks of three kinds in one shape: kind, id, text, language, origin, destination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _place(blob: Column, member: str) -> Column:
    get = lambda path, kind="string": F.try_variant_get(blob, f"$.{member}{path}", kind)
    pair = F.concat_ws(",", get(".lat"), F.coalesce(get(".lon"), get(".lng")))
    both = get(".lat").isNotNull() & F.coalesce(get(".lon"), get(".lng")).isNotNull()
    plain = F.when(F.schema_of_variant(F.try_variant_get(blob, f"$.{member}", "variant")) == "STRING", get(""))
    return F.coalesce(F.nullif(get(".address"), F.lit("")), F.nullif(get(".name"), F.lit("")), F.when(both, pair), F.nullif(plain, F.lit("")))


def seed_text(text: Column) -> Column:
    """Plain text as it is; of a JSON object with an origin and a destination "route from X to Y"; else null.

    Doubled quotes are repaired; the object may hold both under "arguments"."""
    t = F.trim(F.coalesce(text, F.lit("")))
    blob = F.try_parse_json(F.replace(t, F.lit('""'), F.lit('"')))
    o = F.coalesce(_place(blob, "arguments.origin"), _place(blob, "origin"))
    d = F.coalesce(_place(blob, "arguments.destination"), _place(blob, "destination"))
    return F.when(t.startswith("{"), F.when(o.isNotNull() & d.isNotNull(), F.concat(F.lit("route from "), o, F.lit(" to "), d))).otherwise(t)


def seeds(instructions: DataFrame, dialogues: DataFrame, scenarios: DataFrame) -> DataFrame:
    """instructions(line, text, language, origin, destination), dialogues(dialogue_id, first_driver_turn, language), scenarios(line, body, language)."""
    lang = F.coalesce("language", F.lit("en"))
    a = instructions.select(F.lit("instruction").alias("kind"), F.concat(F.lit("instr-"), "line").alias("id"), seed_text(F.col("text")).alias("text"), lang.alias("language"), "origin", "destination")
    b = dialogues.select(F.lit("dialogue").alias("kind"), F.concat(F.lit("dlg-"), "dialogue_id").alias("id"), F.col("first_driver_turn").alias("text"), lang.alias("language"))
    c = scenarios.select(F.lit("scenario").alias("kind"), F.concat(F.lit("scen-"), "line").alias("id"), F.col("body").alias("text"), lang.alias("language"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True).where("text is not null and text <> ''")
