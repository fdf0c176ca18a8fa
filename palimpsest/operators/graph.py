"""Operators on the knowledge graph: look-ups, clean-up, merging, statistics, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest import lexicon as L
from palimpsest.functions import text as T
from palimpsest.functions import vector as V

SAME_NAME = 0.75
RELATION = ["subject_id", "predicate", "object_id"]


# look-ups


def by_name(entities: DataFrame, names: DataFrame) -> DataFrame:
    """The first entity of each name (column name), whatever its case."""
    wanted = names.select(F.lower("name").alias("_low")).distinct()
    rows = entities.withColumn("_low", F.lower("name")).join(wanted, "_low")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("_low").orderBy("seq"))).where("_n = 1").drop("_n", "_low")


def touching(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations with one of the entities (id) at either end, each once."""
    ends = relations.select("*", F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("_end"))
    return ends.join(ids.select(F.col("id").alias("_end")).distinct(), "_end", "left_semi").drop("_end").dropDuplicates(["id"])


def explicit(relations: DataFrame) -> DataFrame:
    return relations.where("NOT is_inferred")


def degrees(relations: DataFrame) -> DataFrame:
    """id, degree: ends of relations at an entity."""
    return relations.select(F.explode(F.array("subject_id", "object_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def named(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with the names of their ends; an end without an entity is "?"."""
    names = entities.select("id", "name")
    rows = relations.join(names.select(F.col("id").alias("subject_id"), F.col("name").alias("subject")), "subject_id", "left").join(names.select(F.col("id").alias("object_id"), F.col("name").alias("object")), "object_id", "left")
    return rows.withColumns({"subject": F.coalesce("subject", F.lit("?")), "object": F.coalesce("object", F.lit("?"))})


def primary_user(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """The person with the most explicit relations of their own: id, relation_count."""
    rows = explicit(relations).join(entities.where("entity_type = 'person'").select(F.col("id").alias("subject_id")), "subject_id", "left_semi")
    return rows.groupBy(F.col("subject_id").alias("id")).agg(F.count("*").alias("relation_count")).orderBy(F.desc("relation_count"), "id").limit(1)


def stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    counts = relations.agg(F.count_if(~F.col("is_inferred")).alias("explicit_relations"), F.count_if("is_inferred").alias("inferred_relations"))
    return entities.agg(F.count("*").alias("entities")).join(counts)


def network(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Nodes with their degree and links with their names, in one table: kind, key, label, weight."""
    nodes = entities.join(degrees(relations), "id", "left").select(F.lit("node").alias("kind"), F.col("id").cast("string").alias("key"), F.col("name").alias("label"), F.coalesce("degree", F.lit(0)).cast("double").alias("weight"))
    links = named(relations, entities).select(F.lit("link").alias("kind"), F.concat_ws(">", "subject", "object").alias("key"), F.col("predicate").alias("label"), F.col("confidence").alias("weight"))
    return nodes.unionByName(links)


def newest(entities: DataFrame) -> DataFrame:
    """All entities, the newest first."""
    return entities.orderBy(F.desc("seq"), F.desc("id"))


def for_prompt(entities: DataFrame, relations: DataFrame, names: int = 30, facts: int = 40) -> DataFrame:
    """part, pos, line: what a model is told of a graph: the first names by the alphabet and the first explicit relations.

    An end that is not among the names is told by its id.
    """
    first = entities.orderBy("name", "id").limit(names)
    e = first.select(F.lit(0).alias("part"), (F.row_number().over(Window.orderBy("name", "id")) - 1).alias("pos"), F.concat("name", F.lit(" ("), "entity_type", F.lit(")")).alias("line"))
    some = explicit(relations).orderBy("seq").limit(facts)
    told = first.select("id", "name")
    some = some.join(told.select(F.col("id").alias("subject_id"), F.col("name").alias("s")), "subject_id", "left").join(told.select(F.col("id").alias("object_id"), F.col("name").alias("o")), "object_id", "left")
    line = F.concat(F.coalesce("s", F.col("subject_id").cast("string")), F.lit(" --"), "predicate", F.lit("--> "), F.coalesce("o", F.col("object_id").cast("string")))
    r = some.select(F.lit(1).alias("part"), (F.row_number().over(Window.orderBy("seq")) - 1).alias("pos"), line.alias("line"))
    return e.unionByName(r)


def corrections_since(corrections: DataFrame, since: Column) -> DataFrame:
    """One row: how many corrections (created_at) are younger than a moment."""
    return corrections.where(F.col("created_at") > since).agg(F.count("*").alias("corrections"))


def corrections_in_order(corrections: DataFrame) -> DataFrame:
    return corrections.select("sentence", "subject_name", "predicate", "object_name", "is_positive", "created_at", "seq").orderBy("created_at", "seq").drop("created_at", "seq")


# inserts and deletes


def inserted(relations: DataFrame, new: DataFrame) -> DataFrame:
    """Relations with new ones, but not those that are there already with the same ends, predicate and kind."""
    key = [*RELATION, "is_inferred"]
    fresh = new.join(relations.select(*key), key, "left_anti")
    first = F.row_number().over(Window.partitionBy(*key).orderBy("seq"))
    return relations.unionByName(fresh.withColumn("_n", first).where("_n = 1").select(*relations.columns))


def without_inferred(relations: DataFrame) -> DataFrame:
    return explicit(relations)


def without_entities(entities: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations without the entities (id) and all that touches them."""
    ids = gone.select("id").distinct()
    left = relations.join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_anti").join(ids.withColumnRenamed("id", "object_id"), "object_id", "left_anti")
    return entities.join(ids, "id", "left_anti"), left.select(*relations.columns)


def without_between(relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Without any relation between the pairs (a, b), in either direction."""
    keys = pairs.select(F.least("a", "b").alias("_low"), F.greatest("a", "b").alias("_high")).distinct()
    rows = relations.withColumns({"_low": F.least("subject_id", "object_id"), "_high": F.greatest("subject_id", "object_id")})
    return rows.join(keys, ["_low", "_high"], "left_anti").select(*relations.columns)


def repointed(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ends moved from old to new; what then says the same twice, or links an entity with itself, goes."""
    m = mapping.select("old", "new")
    rows = relations.join(m.select(F.col("old").alias("subject_id"), F.col("new").alias("_s")), "subject_id", "left").join(m.select(F.col("old").alias("object_id"), F.col("new").alias("_o")), "object_id", "left")
    rows = rows.withColumns({"subject_id": F.coalesce("_s", "subject_id"), "object_id": F.coalesce("_o", "object_id")}).where("subject_id <> object_id")
    return distinct_triples(rows.select(*relations.columns))


def distinct_triples(relations: DataFrame) -> DataFrame:
    """Of each triple the first row."""
    first = F.row_number().over(Window.partitionBy(*RELATION).orderBy("seq"))
    return relations.withColumn("_n", first).where("_n = 1").drop("_n")


def strongest_triples(relations: DataFrame) -> DataFrame:
    """Of each triple the row with the highest confidence, the first on ties."""
    best = F.row_number().over(Window.partitionBy(*RELATION).orderBy(F.desc("confidence"), "seq"))
    return relations.withColumn("_n", best).where("_n = 1").drop("_n")


# clean-up


def junk(entities: DataFrame) -> DataFrame:
    return entities.where(T.is_junk_name(F.col("name")))


def garbage(entities: DataFrame) -> DataFrame:
    return entities.where(T.any_pattern(F.col("name"), L.GARBAGE_NAMES))


def predicate_names(entities: DataFrame) -> DataFrame:
    """Entities that are named like a predicate or an alias of one: id, predicate."""
    plain = F.replace(F.lower(F.trim("name")), F.lit(" "), F.lit("_"))
    p = F.coalesce(F.element_at(T.literal_map(L.RELATION_ALIASES), F.lower(F.trim("name"))), plain)
    return entities.withColumn("predicate", p).where(F.col("predicate").isin(*L.VALID_PREDICATES) & ~((F.col("entity_type") == "animal") & F.col("predicate").isin("pet", "dog", "cat")))


def healed(entities: DataFrame, relations: DataFrame, user_id: Column) -> tuple[DataFrame, DataFrame]:
    """Without junk; an entity named like a predicate is what the user has under that predicate, else it goes."""
    entities, relations = without_entities(entities, relations, junk(entities))
    generic = predicate_names(entities).select("id", "predicate")
    known = explicit(relations).where(F.col("subject_id") == user_id).join(generic.select(F.col("id").alias("object_id")), "object_id", "left_anti")
    known = known.withColumn("_n", F.row_number().over(Window.partitionBy("predicate").orderBy("seq"))).where("_n = 1").select("predicate", F.col("object_id").alias("new"))
    mapping = generic.join(known, "predicate").select(F.col("id").alias("old"), "new")
    return without_entities(entities, repointed(relations, mapping), generic)


def normalised(relations: DataFrame) -> DataFrame:
    """Canonical predicates; a spelling goes if the canonical relation is there."""
    p = F.coalesce(F.element_at(T.literal_map(L.PREDICATE_CLEANUP), F.lower("predicate")), F.col("predicate"))
    rows = relations.withColumn("_variant", p != F.col("predicate")).withColumn("predicate", p)
    first = F.row_number().over(Window.partitionBy(*RELATION, "is_inferred").orderBy("_variant", "seq"))
    return rows.withColumn("_n", first).where("_n = 1").select(*relations.columns)


def without_contradictions(relations: DataFrame, pairs: tuple[tuple[str, str], ...] = (("wife", "husband"),)) -> DataFrame:
    """Of two predicates that exclude each other on the same ends, the second goes."""
    wrong = reduce(lambda a, b: a.unionByName(b), [relations.where(F.col("predicate") == a).select("subject_id", "object_id", F.lit(b).alias("predicate")) for a, b in pairs])
    return relations.join(wrong.distinct(), ["subject_id", "object_id", "predicate"], "left_anti").select(*relations.columns)


def spouses_directed(relations: DataFrame) -> DataFrame:
    """Marriages one way each: of mirrored rows with the same predicate the first stays, and the reverse of wife is husband."""
    pair = F.col("predicate").isin("wife", "husband")
    marriages = relations.where(pair).withColumns({"_low": F.least("subject_id", "object_id"), "_high": F.greatest("subject_id", "object_id")})
    first = marriages.withColumn("_n", F.row_number().over(Window.partitionBy("_low", "_high").orderBy("seq"))).where("_n = 1").select(*relations.columns)
    back = first.withColumns({"subject_id": F.col("object_id"), "object_id": F.col("subject_id"), "predicate": F.when(F.col("predicate") == "wife", "husband").otherwise("wife")})
    return relations.where(~pair).unionByName(first).unionByName(back)


def without_dangling(relations: DataFrame, entities: DataFrame) -> DataFrame:
    ids = entities.select("id")
    return relations.join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi").join(ids.withColumnRenamed("id", "object_id"), "object_id", "left_semi").select(*relations.columns)


def orphans(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities without relations."""
    return entities.join(degrees(relations), "id", "left_anti")


def cleaned(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Garbage names, spellings, contradictions, marriages, dangling ends, in this order."""
    entities, relations = without_entities(entities, relations, garbage(entities))
    return entities, without_dangling(spouses_directed(without_contradictions(normalised(relations))), entities)


# merging


def case_duplicates(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """old, new: names that differ in case only; the entity with the most relations stays, the newest on ties."""
    rows = entities.join(degrees(relations), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    order = Window.partitionBy(F.lower("name")).orderBy(F.desc("degree"), F.desc("seq"))
    rows = rows.withColumns({"_n": F.row_number().over(order), "new": F.first("id").over(order)})
    return rows.where("_n > 1").select(F.col("id").alias("old"), "new")


def merged(entities: DataFrame, relations: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities without the old ones, relations moved to the new ones; chains of merges end at their last."""
    settled = settled_mapping(mapping)
    return entities.join(settled.select(F.col("old").alias("id")), "id", "left_anti"), repointed(relations, settled)


def settled_mapping(mapping: DataFrame, rounds: int = 60) -> DataFrame:
    """old, new with chains (a to b, b to c) followed to their ends: each round doubles the length that is followed.

    Rounds go on while an end is itself merged, each written once; a circle of merges fails.
    """
    from palimpsest.sources.tables import checkpointed

    now = checkpointed(mapping.select("old", "new").where("old <> new").distinct())
    for _ in range(rounds):
        step = now.select(F.col("old").alias("new"), F.col("new").alias("_next"))
        if not now.join(step, "new", "left_semi").limit(1).count():
            return now
        now = checkpointed(now.join(step, "new", "left").select("old", F.coalesce("_next", "new").alias("new")))
    raise RuntimeError("a chain of merges does not end")


def similar_names(entities: DataFrame, least: float = SAME_NAME) -> DataFrame:
    """a, b, similarity: pairs of entities of a type whose names overlap so far in letter pairs.

    Names that are that similar share a letter pair among the first few in any order,
    so pairs are found by an equi-join on these, not by comparing all.  The order puts
    pairs of letters that few names have first, so a stem that all names share brings
    nobody together.  Lengths that forbid the similarity are left out of the join, and a
    pair is compared in one place only: under the first letter pair that both offer.
    Where entities have a column ``seeks``, only pairs with one that does are found.
    """
    low = F.lower(F.trim("name"))
    grams = T.bigrams(low)
    seeks = F.col("seeks") if "seeks" in entities.columns else F.lit(True).alias("seeks")
    rows = entities.where(F.length(low) > 0).select("id", low.alias("name"), "entity_type", seeks, grams.alias("grams"), F.size(grams).alias("size"))
    each = rows.select("id", "entity_type", F.explode("grams").alias("gram"))
    # grams are many more than the names that Spark estimates them by: no broadcast
    often = each.groupBy("entity_type", "gram").agg(F.count("*").alias("often")).hint("merge")
    ranked = each.join(often, ["entity_type", "gram"]).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "gram"))), lambda g: g["gram"]).alias("ranked")).hint("merge")
    # 2c / (x + y) >= t needs c >= t / (2 - t) * x: the others may be missing
    need = F.ceil(F.lit(least / (2 - least)) * F.col("size") - 1e-9)
    rows = rows.join(ranked, "id").withColumn("offered", F.slice("ranked", F.lit(1), (F.col("size") - need + 1).cast("int"))).drop("ranked")
    a, b = (rows.select(*[F.col(c).alias(f"{c}_{x}") for c in ("id", "name", "grams", "size", "offered", "seeks")], "entity_type", F.explode("offered").alias("gram")) for x in "ab")
    a = a.where("seeks_a")
    fits = ((F.col("id_a") < F.col("id_b")) | ~F.col("seeks_b")) & (least * (F.col("size_a") + F.col("size_b")) <= 2 * F.least("size_a", "size_b") + 1e-9)
    first = F.get(F.array_intersect("offered_a", "offered_b"), F.lit(0)) == F.col("gram")
    pairs = a.join(b.hint("merge"), ["entity_type", "gram"]).where(fits & first)
    dice = F.when(F.col("name_a") == F.col("name_b"), 1.0).otherwise(2.0 * F.size(F.array_intersect("grams_a", "grams_b")) / (F.col("size_a") + F.col("size_b")))
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), F.round(dice, 6).alias("similarity"), "entity_type").where(F.col("similarity") >= least)


def same_parents(relations: DataFrame, predicates: tuple[str, ...] = ("father", "mother")) -> DataFrame:
    """a, b: two objects of the same subject and predicate."""
    rows = relations.where(F.col("predicate").isin(*predicates)).select("subject_id", "predicate", F.col("object_id").alias("a"))
    return rows.join(rows.withColumnRenamed("a", "b"), ["subject_id", "predicate"]).where("a < b").select("a", "b").distinct()


def signatures(relations: DataFrame) -> DataFrame:
    """id, signature: an entity's predicates with their direction."""
    ends = relations.select(F.col("subject_id").alias("id"), F.concat("predicate", F.lit("_out")).alias("s")).unionByName(relations.select(F.col("object_id").alias("id"), F.concat("predicate", F.lit("_in")).alias("s")))
    return ends.groupBy("id").agg(F.array_sort(F.collect_set("s")).alias("signature"))


def signature_jaccard(a: str, b: str) -> Column:
    return F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 6)


def similar_signatures(relations: DataFrame, least: float = 0.5) -> DataFrame:
    """signature_a, signature_b, entities_a, entities_b, jaccard of all distinct signatures that overlap so far.

    Entities with the same signature are counted, not paired; ``signatures`` says
    who they are.
    """
    kinds = signatures(relations).groupBy("signature").agg(F.count("*").alias("entities"))
    a, b = (kinds.select(F.col("signature").alias(f"signature_{x}"), F.col("entities").alias(f"entities_{x}"), F.explode("signature").alias("s")) for x in "ab")
    pairs = a.join(b, "s").where("signature_a <= signature_b").select("signature_a", "signature_b", "entities_a", "entities_b").distinct()
    return pairs.withColumn("jaccard", signature_jaccard("signature_a", "signature_b")).where(F.col("jaccard") >= least)


def pets_merged(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A pet that is only called by its kind becomes the named pet of the same owner and kind."""
    pets = relations.where(F.col("predicate").isin(*L.ANIMAL_PREDICATES)).join(entities.select(F.col("id").alias("object_id"), F.lower("name").alias("_name")), "object_id")
    generic = pets.where(F.col("_name").isin(*L.ANIMAL_PREDICATES)).select("subject_id", F.col("_name").alias("kind"), F.col("object_id").alias("old"))
    real = pets.where(~F.col("_name").isin(*L.ANIMAL_PREDICATES)).withColumn("_n", F.row_number().over(Window.partitionBy("subject_id", "predicate").orderBy("seq"))).where("_n = 1")
    mapping = generic.join(real.select("subject_id", F.col("predicate").alias("kind"), F.col("object_id").alias("new")), ["subject_id", "kind"]).select("old", "new")
    return merged(entities, relations, mapping)


# components


def components(entities: DataFrame, relations: DataFrame, rounds: int = 200) -> DataFrame:
    """id, component: the least id that relations reach; entities without relations are their own.

    Rounds of joins on the edges until nothing changes, each cut off by a checkpoint
    (the folder is ``spark.checkpoint.dir``).  Every round halves the distance to
    the least node by following the component of the component.
    """
    from palimpsest.sources.tables import checkpointed

    edges = relations.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b")).where("a <> b")
    edges = checkpointed(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = checkpointed(entities.select("id").unionByName(edges.select(F.col("a").alias("id"))).distinct().withColumn("component", F.col("id")))
    for _ in range(rounds):
        near = edges.join(now.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("_near"))
        step = now.join(near, "id", "left").select("id", F.col("component").alias("_before"), F.least("component", "_near").alias("component"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("_jump"))
        step = checkpointed(step.join(jump, "component", "left").select("id", "_before", F.least("component", "_jump").alias("component")))
        changed = step.where("component <> _before").limit(1).count()
        now = step.select("id", "component")
        if not changed:
            return now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def connectivity(components: DataFrame) -> DataFrame:
    """One row: component_count, sizes (descending), fully_connected."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("times"))
    return sizes.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("component_count"), F.reverse(F.array_sort(F.collect_list(F.struct(F.col("n").alias("size"), "times")))).alias("sizes")).withColumn("fully_connected", F.col("component_count") <= 1)


def bridges(components: DataFrame, degree: DataFrame, shared: DataFrame, similar: DataFrame) -> DataFrame:
    """One edge from every smaller component to the largest: a, b, confidence, kind.

    A pair that a memory mentions together (shared: a, b) comes first, then the
    most similar pair above a half (similar: a, b, sim), then the hub of each side.
    """
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    main = sizes.orderBy(F.desc("n"), "component").limit(1).select(F.col("component").alias("main"))
    rows = components.join(main).withColumn("in_main", F.col("component") == F.col("main"))
    side = rows.select("id", "component", "in_main")
    small = side.where("NOT in_main")

    def crossing(pairs: DataFrame) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), *[c for c in pairs.columns if c not in ("a", "b")]))
        return both.join(small.select(F.col("id").alias("a"), "component"), "a").join(side.where("in_main").select(F.col("id").alias("b")), "b", "left_semi")

    one = crossing(shared.select("a", "b")).select("component", "a", "b", F.lit(0.6).alias("confidence"), F.lit("shared").alias("kind"), F.lit(1).alias("p"), F.lit(0.0).alias("s"))
    two = crossing(similar.select("a", "b", "sim")).where("sim > 0.5").select("component", "a", "b", F.round(0.8 * F.col("sim"), 6).alias("confidence"), F.lit("similar").alias("kind"), F.lit(2).alias("p"), (-F.col("sim")).alias("s"))
    known = side.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    hub = known.where("in_main").orderBy(F.desc("degree"), "id").limit(1).select(F.col("id").alias("b"))
    hubs = known.where("NOT in_main").groupBy("component").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("a"))
    three = hubs.join(hub).select("component", "a", "b", F.lit(0.4).alias("confidence"), F.lit("hub").alias("kind"), F.lit(3).alias("p"), F.lit(0.0).alias("s"))
    every = one.unionByName(two).unionByName(three)
    best = F.row_number().over(Window.partitionBy("component").orderBy("p", "s", "a", "b"))
    return every.withColumn("_n", best).where("_n = 1").select("a", "b", F.lit("related_to").alias("predicate"), "confidence", "kind")


def bridge_candidates(components: DataFrame, vectors: DataFrame, hubs: int = 20) -> DataFrame:
    """a, b, sim: of each entity outside the largest component the most similar among its first ``hubs`` entities.

    The hubs are a fixed number, so this is a look-up and not a join of all with all.
    """
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    main = sizes.orderBy(F.desc("n"), "component").limit(1).select(F.col("component").alias("main"))
    rows = components.join(vectors.select("id", "embedding"), "id").join(F.broadcast(main))
    own = rows.where("component = main").orderBy("id").limit(hubs).select(F.col("id").alias("b"), F.col("embedding").alias("vb"))
    pairs = rows.where("component <> main").select(F.col("id").alias("a"), F.col("embedding").alias("va")).join(F.broadcast(own))
    sim = F.round(V.cosine(F.col("va"), F.col("vb")), 6)
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return pairs.select("a", "b", sim.alias("sim")).withColumn("_n", best).where("_n = 1").drop("_n")
