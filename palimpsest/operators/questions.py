"""Questions and answers made from the graph, their vocabulary and encoding, and symbolic answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import graph as G
from palimpsest.operators import inference as I

PAD, LENGTH = 0, 128
#: Predicates that are counted even where there is none.
COUNTED = ["brother", "sister", "son", "daughter"]
MODES = ("single_hop", "boolean", "count", "multi_hop", "inverse")


def _spoken(p: Column) -> Column:
    return F.replace(p, F.lit("_"), F.lit(" "))


def generated(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """mode, question, answer made from explicit relations."""
    rows = G.named(G.explicit(relations), entities).where("subject <> '?' AND object <> '?'")
    p = _spoken(F.col("predicate"))
    single = rows.select(F.lit("single_hop").alias("mode"), F.concat(F.lit("who is "), F.col("subject"), F.lit("'s "), p, F.lit("?")).alias("question"), F.col("object").alias("answer"))
    ask = lambda s, o: F.concat(F.lit("is "), o, F.lit(" "), s, F.lit("'s "), p, F.lit("?"))
    yes = rows.select(F.lit("boolean").alias("mode"), ask(F.col("subject"), F.col("object")).alias("question"), F.lit("yes").alias("answer"))
    # a wrong end: the object of the next relation with the predicate
    other = F.lead("object").over(Window.partitionBy("predicate").orderBy("seq"))
    no = rows.withColumn("_other", other).where("_other IS NOT NULL AND _other <> object AND _other <> subject").select(F.lit("boolean").alias("mode"), ask(F.col("subject"), F.col("_other")).alias("question"), F.lit("no").alias("answer"))
    truths = yes.select("question")
    counts = rows.groupBy("subject_id", "subject", "predicate").agg(F.count("*").alias("n"))
    count = counts.select(F.lit("count").alias("mode"), F.concat(F.lit("how many "), p, F.lit("s does "), F.col("subject"), F.lit(" have?")).alias("question"), F.col("n").cast("string").alias("answer"))
    a, b = rows.select("subject", F.col("predicate").alias("p1"), F.col("object_id").alias("mid")), rows.select(F.col("subject_id").alias("mid"), F.col("predicate").alias("p2"), "object")
    hop = a.join(b, "mid").where("subject <> object").select(F.lit("multi_hop").alias("mode"), F.concat(F.lit("who is "), F.col("subject"), F.lit("'s "), _spoken(F.col("p1")), F.lit("'s "), _spoken(F.col("p2")), F.lit("?")).alias("question"), F.col("object").alias("answer"))
    none = rows.select("subject_id", "subject").distinct().withColumn("predicate", F.explode(T.literal_array(COUNTED))).join(counts.select("subject_id", "predicate"), ["subject_id", "predicate"], "left_anti")
    zero = none.select(F.lit("count").alias("mode"), F.concat(F.lit("how many "), p, F.lit("s does "), F.col("subject"), F.lit(" have?")).alias("question"), F.lit("0").alias("answer"))
    inverse = rows.select(F.lit("inverse").alias("mode"), F.concat(F.lit("whose "), p, F.lit(" is "), F.col("object"), F.lit("?")).alias("question"), F.col("subject").alias("answer"))
    return single.unionByName(yes).unionByName(no.join(truths, "question", "left_anti").select("mode", "question", "answer")).unionByName(count).unionByName(zero).unionByName(hop).unionByName(inverse)


def counted(relations: DataFrame) -> DataFrame:
    """subject_id, predicate, n: how many of a kind; no upper bound."""
    return relations.groupBy("subject_id", "predicate").agg(F.count("*").alias("n"))


def training_pairs(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """kind, question, answer for tuning a model: relations, inferences, denials of absent ones, and what is known of each subject."""
    rows = G.named(relations, entities).where(I.has_template(F.col("predicate")))
    fact = I.sentence(F.col("predicate"), F.col("subject"), F.col("object"))
    ask = F.concat(F.lit("What do you know about "), F.col("subject"), F.lit(" and "), F.col("object"), F.lit("?"))
    told = rows.select(F.when(F.col("is_inferred"), "inference").otherwise("relation").alias("kind"), ask.alias("question"), F.concat(fact, F.lit(".")).alias("answer"))
    people = G.named(G.explicit(relations), entities).select("subject_id", "subject").distinct()
    kinds = rows.sparkSession.createDataFrame([(p,) for p in ("wife", "husband", "brother", "sister")], "predicate string")
    absent = people.join(F.broadcast(kinds)).join(relations.select("subject_id", "predicate"), ["subject_id", "predicate"], "left_anti")
    denial = absent.select(F.lit("negation").alias("kind"), F.concat(F.lit("Who is "), F.col("subject"), F.lit("'s "), F.col("predicate"), F.lit("?")).alias("question"), F.concat(F.lit("I don't know of a "), F.col("predicate"), F.lit(" of "), F.col("subject"), F.lit(".")).alias("answer"))
    world = I.world(entities, relations, people.select(F.col("subject_id").alias("id"))).join(people.select(F.col("subject_id").alias("id"), "subject"), "id")
    summary = world.select(F.lit("summary").alias("kind"), F.concat(F.lit("What do you know about "), F.col("subject"), F.lit("?")).alias("question"), F.concat(F.lit("Based on what I remember: "), "summary").alias("answer"))
    return told.unionByName(denial).unionByName(summary)


def vocabulary(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """token, kind, token_id: names in order of seq, then predicates in order of the alphabet; 0 pads."""
    names = entities.groupBy(F.col("name").alias("token")).agg(F.min("seq").alias("at")).select(F.lit(0).alias("part"), "at", "token", F.lit("entity").alias("kind"))
    predicates = relations.select(F.col("predicate").alias("token")).distinct().select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("at"), "token", F.lit("predicate").alias("kind"))
    # numbered in two steps, so that no task has to number all: the rank inside a block, and the blocks before it
    rows = names.unionByName(predicates).withColumn("block", F.concat_ws(":", "part", F.floor(F.col("at") / 4096)))
    sizes = rows.groupBy("part", F.floor(F.col("at") / 4096).alias("b"), "block").agg(F.count("*").alias("n"))
    before = sizes.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("part", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("block", "first")
    place = F.row_number().over(Window.partitionBy("block").orderBy("at", "token"))
    return rows.withColumn("_n", place).join(before, "block").select("token", "kind", (F.col("first") + F.col("_n")).cast("long").alias("token_id"))


def encoded(texts: DataFrame, vocabulary: DataFrame, length: int = LENGTH) -> DataFrame:
    """text_id, ids: token numbers, 0 for unknown ones, cut or filled to a length."""
    rows = texts.select("text_id", F.posexplode_outer(T.question_tokens(F.col("text"))).alias("pos", "token"))
    known = vocabulary.select(F.lower("token").alias("token"), "token_id").groupBy("token").agg(F.min("token_id").alias("token_id"))
    ids = rows.join(known, "token", "left").groupBy("text_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("token_id", F.lit(0)).alias("i")))), lambda s: s["i"]).alias("ids"))
    return ids.select("text_id", F.slice(F.concat("ids", F.array_repeat(F.lit(PAD).cast("long"), length)), 1, length).alias("ids"))


def oversampled(rows: DataFrame, label: str) -> DataFrame:
    """Each label as often as the most frequent one, its rows repeated in turn."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    most = counts.agg(F.max("_n").alias("_most"))
    place = F.row_number().over(Window.partitionBy(label).orderBy("id")) - 1
    times = F.floor(F.col("_most") / F.col("_n")) + F.when(F.col("_place") < F.col("_most") % F.col("_n"), 1).otherwise(0)
    return rows.withColumn("_place", place).join(counts, label).join(F.broadcast(most)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).drop("_n", "_most", "_place")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """label, n, weight: rarer classes weigh more, so that all weigh the same together."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"), F.count("*").alias("_k"))
    return counts.join(F.broadcast(total)).select(label, "n", F.round(F.col("_all") / (F.col("_k") * F.col("n")), 6).alias("weight"))


def answers(questions: DataFrame, entities: DataFrame, relations: DataFrame, most: int = 3) -> DataFrame:
    """question_id, answer, rank: symbolic answers to (question_id, subject_id, predicate, mode): candidates by confidence, a count, or yes and no."""
    rows = questions.join(relations.select("subject_id", "predicate", "object_id", "confidence", "seq"), ["subject_id", "predicate"], "left")
    rows = rows.join(entities.select(F.col("id").alias("object_id"), F.col("name").alias("object")), "object_id", "left")
    ranked = rows.where("mode = 'single_hop' AND object IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("confidence"), "seq"))).where(F.col("rank") <= most).select("question_id", F.col("object").alias("answer"), "rank")
    count = rows.where("mode = 'count'").groupBy("question_id").agg(F.count("object_id").cast("string").alias("answer")).withColumn("rank", F.lit(1))
    yes = rows.where("mode = 'boolean'").groupBy("question_id").agg(F.when(F.count("object_id") > 0, "yes").otherwise("no").alias("answer")).withColumn("rank", F.lit(1))
    return ranked.unionByName(count).unionByName(yes)

