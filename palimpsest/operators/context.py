"""The context that a model is given: ordered sections under a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T

BUDGET = 1500
MANDATORY = ("caution", "fact", "graph", "world")


def section(title: str, body: Column) -> Column:
    return F.concat(F.lit(title + "\n"), body)


def _listed(rows: DataFrame, most: int, title: str, name: str, order: list[Column], line: Column) -> DataFrame:
    """query_id and a section of at most so many lines."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("_n") <= most).withColumn("_line", F.concat(F.lit("  - "), line))
    return ranked.groupBy("query_id").agg(section(title, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda s: s["_line"]), "\n")).alias(name))


def uncovered(memories: DataFrame, summary: Column) -> DataFrame:
    """Memories that are no boilerplate and that the summary does not tell already."""
    return memories.where(~T.is_boilerplate(F.col("content")) & ~T.is_covered(F.col("content"), summary))


def important(memories: DataFrame, most: int = 3) -> DataFrame:
    return _listed(memories, most, "[IMPORTANT -- known facts about this user]", "important", [F.col("rank")], F.col("content"))


def relevant(memories: DataFrame, most: int = 5) -> DataFrame:
    return _listed(memories, most, "[Relevant memories from previous conversations]", "relevant", [F.col("rank")], F.concat(F.lit("["), T.percent(F.col("confidence")), F.lit(" confidence] "), F.col("content")))


def scored(memories: DataFrame, most: int = 3) -> DataFrame:
    """Lines with the share of the score, for contexts that rank by activation."""
    return _listed(memories, most, "[Relevant memories]", "scored", [F.desc("final_score"), F.col("id")], F.concat(F.lit("["), T.percent(F.col("final_score")), F.lit("] "), F.col("content")))


def web(results: DataFrame, most: int = 3) -> DataFrame:
    domain = F.coalesce(F.expr("try_parse_url(url, 'HOST')"), F.col("source"))
    return _listed(results, most, "[WEB SEARCH — recent information from the internet]", "web", [F.col("rank")], F.concat(F.lit('"'), F.col("title"), F.lit('" ('), domain, F.lit("): "), F.col("snippet")))


def budgeted(sections: DataFrame, budget: int = BUDGET) -> DataFrame:
    """query_id, kept, used_tokens: the sections (query_id, pos, name, text) that fit.

    Mandatory ones always stay; of the others each is taken in order if it still
    fits, and one that is too long does not stop those behind it.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", "name", "text", T.tokens_estimate(F.col("text")).alias("cost"))))
    rows = sections.where("text IS NOT NULL").groupBy("query_id").agg(ordered.alias("parts"))
    must = F.filter("parts", lambda p: p["name"].isin(*MANDATORY))
    start = F.struct(F.aggregate(must, F.lit(0), lambda a, p: a + p["cost"]).alias("used"), F.transform(must, lambda p: p["text"]).alias("kept"))
    more = F.filter("parts", lambda p: ~p["name"].isin(*MANDATORY))
    fits = lambda a, p: a["used"] + p["cost"] <= budget
    folded = F.aggregate(more, start, lambda a, p: F.struct(F.when(fits(a, p), a["used"] + p["cost"]).otherwise(a["used"]).alias("used"), F.when(fits(a, p), F.concat(a["kept"], F.array(p["text"]))).otherwise(a["kept"]).alias("kept")))
    return rows.withColumn("_f", folded).select("query_id", F.col("_f.kept").alias("kept"), F.col("_f.used").alias("used_tokens"))


def built(sections: DataFrame, budget: int = BUDGET) -> DataFrame:
    """query_id, context, used_tokens."""
    rows = budgeted(sections, budget)
    return rows.select("query_id", F.concat(F.lit("<memory_context>\n"), F.array_join("kept", "\n\n"), F.lit("\n</memory_context>")).alias("context"), "used_tokens")


def entity_context(queries: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """query_id, context: what is known of the entities that a query (query_id, query) names, the newest entity first."""
    from palimpsest.operators import inference as I
    from palimpsest.operators import retrieval as R
    from palimpsest.sources.tables import checkpointed

    # read twice, found once
    hits = checkpointed(R.mentions(queries.select(F.col("query_id").alias("text_id"), F.col("query").alias("text")), entities, 2)).hint("merge")
    told = I.described(entities, relations, hits.select("id")).join(entities.select("id", "seq"), "id")
    rows = hits.join(told, "id").groupBy(F.col("text_id").alias("query_id")).agg(F.reverse(F.array_sort(F.collect_list(F.struct("seq", "id", "description")))).alias("d"))
    return rows.select("query_id", F.array_join(F.transform("d", lambda x: x["description"]), " ").alias("context"))
