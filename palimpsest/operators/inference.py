"""Deduction on the knowledge graph, and what it says in words.

Rules are small tables that Spark broadcasts by size; every rule is an equi-join
of the relations with themselves, so a subject's relations meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest import lexicon as L
from palimpsest.functions import text as T
from palimpsest.operators import graph as G

GATE = 0.8
CAP = 20
FACTORS = {"in_law": 0.9, "co_parent": 0.85, "reverse_in_law": 0.85, "multi_hop": 0.8}
_OUT = ["subject_id", "predicate", "object_id", "confidence", "stage"]


def rule_table(df: DataFrame, rules: dict[tuple[str, str], str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(a, b, c) for (a, b), c in rules.items()], "p1 string, p2 string, result string")


def gated(entities: DataFrame, relations: DataFrame, gate: float | None = GATE) -> DataFrame:
    """Explicit relations between proper names, certain enough to reason from."""
    proper = entities.where(~T.is_junk_name(F.col("name"))).select("id")
    rows = G.without_dangling(G.explicit(relations), proper)
    return rows if gate is None else rows.where(F.col("confidence") >= gate)


def _two(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = ["subject_id", "predicate", "object_id", "confidence", "seq"]
    return tuple(relations.select(*[F.col(c).alias(f"{c}_{i}") for c in names]) for i in (1, 2))  # type: ignore[return-value]


def _told(rows: DataFrame, s: str, o: str, stage: str, extra: list[str] = []) -> DataFrame:  # noqa: B006
    factor = F.lit(FACTORS[stage])
    return rows.select(F.col(s).alias("subject_id"), F.col("result").alias("predicate"), F.col(o).alias("object_id"), F.round(F.least("confidence_1", "confidence_2") * factor, 6).alias("confidence"), F.lit(stage).alias("stage"), "seq_1", "seq_2", *extra)


def _first(rows: DataFrame) -> DataFrame:
    """Of each triple what the first pair of relations says."""
    n = F.row_number().over(Window.partitionBy(*G.RELATION).orderBy("seq_1", "seq_2"))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def by_subject(relations: DataFrame, rules: dict[tuple[str, str], str], stage: str) -> DataFrame:
    """Two relations of one subject: (first object, rule, second object)."""
    a, b = _two(relations)
    pairs = a.join(b, F.col("subject_id_1") == F.col("subject_id_2")).where("object_id_1 <> object_id_2")
    pairs = pairs.join(F.broadcast(rule_table(relations, rules)), (F.col("predicate_1") == F.col("p1")) & (F.col("predicate_2") == F.col("p2")))
    return _first(_told(pairs, "object_id_1", "object_id_2", stage))


def in_laws(relations: DataFrame) -> DataFrame:
    return by_subject(relations, L.IN_LAW_RULES, "in_law")


def reverse_in_laws(relations: DataFrame) -> DataFrame:
    return by_subject(relations, L.REVERSE_IN_LAW_RULES, "reverse_in_law")


def co_parents(relations: DataFrame, existing: DataFrame) -> DataFrame:
    """A subject's father and mother are married, unless something else is known between the two."""
    rows = by_subject(relations, {("father", "mother"): "married_to"}, "co_parent")
    known = existing.select(F.least("subject_id", "object_id").alias("_low"), F.greatest("subject_id", "object_id").alias("_high")).distinct()
    rows = rows.withColumns({"_low": F.least("subject_id", "object_id"), "_high": F.greatest("subject_id", "object_id")})
    return rows.join(known, ["_low", "_high"], "left_anti").drop("_low", "_high")


def _own(relations: DataFrame) -> list[str]:
    """The key that keeps users apart; a table without it is one user's."""
    return ["user_id"] if "user_id" in relations.columns else []


def _capped(rows: DataFrame, cap: int | None, own: list[str]) -> DataFrame:
    """The first ``cap`` triples of each user."""
    order = ["start", "seq_1", "seq_2", "object_id", "subject_id", "predicate"]
    if cap is None or not own:
        return rows if cap is None else rows.orderBy(*order[:4]).limit(cap)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*own).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def multi_hops(relations: DataFrame, cap: int | None = CAP) -> DataFrame:
    """A to B to C: (C, rule, A); the first ``cap`` of a user (user_id, if there), in order of A's first relation and the two hops."""
    own = _own(relations)
    start = F.min("seq").over(Window.partitionBy("subject_id"))
    a, b = _two(relations)
    a = a.join(relations.withColumn("start", start).select(F.col("subject_id").alias("subject_id_1"), "start", *own).distinct(), "subject_id_1")
    pairs = a.join(b, F.col("object_id_1") == F.col("subject_id_2")).where("object_id_2 <> subject_id_1")
    pairs = pairs.join(F.broadcast(rule_table(relations, L.MULTI_HOP_RULES)), (F.col("predicate_1") == F.col("p1")) & (F.col("predicate_2") == F.col("p2")))
    rows = _first(_told(pairs, "object_id_2", "subject_id_1", "multi_hop", ["start", *own]))
    return _capped(rows, cap, own)


STAGES = ("in_law", "co_parent", "reverse_in_law", "multi_hop")


def _all_pairs(base: DataFrame) -> DataFrame:
    """What the three rule families on one subject's relations say, each triple once a stage; one join for all rules."""
    families = {"in_law": L.IN_LAW_RULES, "co_parent": {("father", "mother"): "married_to"}, "reverse_in_law": L.REVERSE_IN_LAW_RULES}
    rules = [(a, b, c, stage, FACTORS[stage]) for stage, family in families.items() for (a, b), c in family.items()]
    rules = base.sparkSession.createDataFrame(rules, "p1 string, p2 string, predicate string, stage string, factor double")
    a, b = _two(base)
    pairs = a.join(b, F.col("subject_id_1") == F.col("subject_id_2")).where("object_id_1 <> object_id_2")
    pairs = pairs.join(F.broadcast(rules), (F.col("predicate_1") == F.col("p1")) & (F.col("predicate_2") == F.col("p2")))
    confidence = F.round(F.least("confidence_1", "confidence_2") * F.col("factor"), 6).alias("confidence")
    return pairs.select(F.col("object_id_1").alias("subject_id"), "predicate", F.col("object_id_2").alias("object_id"), confidence, "stage", "seq_1", "seq_2")


def full(entities: DataFrame, relations: DataFrame, gate: float | None = GATE, cap: int | None = CAP) -> DataFrame:
    """All that one pass of the four rules adds: subject_id, predicate, object_id, confidence, stage.

    Rules fire on the gated explicit relations only; whether a triple is new is asked
    of all explicit relations and of what earlier rules have added.  There is no
    fixpoint.  ``cap`` bounds the multi-hop triples of each user_id, if relations have it.

    The gated relations are written once.  All rules' triples and the explicit relations
    then meet by their two ends: a triple stays in its first stage, and a marriage only
    if nothing explicit and no in-law is known between the two.
    """
    from palimpsest.sources.tables import checkpointed

    own = _own(relations)
    base = checkpointed(gated(entities, relations, gate).select("subject_id", "predicate", "object_id", "confidence", "seq", *own))
    extra = {"start": "long", **{c: dict(relations.dtypes)[c] for c in own}}
    none = [F.lit(None).cast(t).alias(c) for c, t in extra.items()]
    hops = multi_hops(base, None).select(*_OUT, "seq_1", "seq_2", *extra)
    pairs = _all_pairs(base).select(*_OUT, "seq_1", "seq_2", *none)
    explicit = G.explicit(relations).select(*G.RELATION, F.lit(0.0).alias("confidence"), F.lit("explicit").alias("stage"), F.lit(0).cast("long").alias("seq_1"), F.lit(0).cast("long").alias("seq_2"), *none)
    rows = pairs.unionByName(hops).unionByName(explicit)
    ends = [F.least("subject_id", "object_id"), F.greatest("subject_id", "object_id")]
    rows = rows.withColumns({"_low": ends[0], "_high": ends[1], "_stage": F.array_position(F.array(*[F.lit(x) for x in ("explicit", *STAGES)]), F.col("stage"))})
    between = Window.partitionBy("_low", "_high")
    same = Window.partitionBy("_low", "_high", *G.RELATION).orderBy("_stage", "seq_1", "seq_2")
    rows = rows.withColumn("_known", F.min("_stage").over(between)).where("stage <> 'co_parent' OR _known > 2")
    rows = rows.withColumn("_n", F.row_number().over(same)).where("_n = 1 AND stage <> 'explicit'")
    if cap is not None:
        # the cap counts only what multi-hop rules add
        order = ["start", "seq_1", "seq_2", "object_id", "subject_id", "predicate"]
        if own:
            nth = F.row_number().over(Window.partitionBy(*own, "stage").orderBy(*order))
            rows = rows.withColumn("_n", nth).where((F.col("stage") != "multi_hop") | (F.col("_n") <= cap))
        else:
            hop = rows.where("stage = 'multi_hop'").orderBy(*order[:4]).limit(cap)
            return rows.where("stage <> 'multi_hop'").select(*_OUT).unionByName(hop.select(*_OUT))
    return rows.select(*_OUT)


def of_user(relations: DataFrame, user_id: Column) -> DataFrame:
    """The in-law rules on the user's own relations, whatever their confidence."""
    return in_laws(G.explicit(relations).where(F.col("subject_id") == user_id))


def with_inferred(relations: DataFrame, inferred: DataFrame) -> DataFrame:
    """Relations and what was inferred from them, numbered after them."""
    new = inferred.withColumns({"is_inferred": F.lit(True), "id": -F.abs(F.xxhash64(*G.RELATION)), "seq": F.lit(1 << 62)})
    return relations.unionByName(new.select(*[F.col(c).cast(t).alias(c) for c, t in relations.dtypes]))


# words


def sentence(predicate: Column, subject: Column, object: Column) -> Column:
    """A relation as a sentence; without a template the ends are related."""
    template = F.coalesce(F.element_at(T.literal_map(L.RELATION_TEMPLATES), predicate), F.lit(L.DEFAULT_TEMPLATE))
    return F.replace(F.replace(template, F.lit("{subject}"), subject), F.lit("{object}"), object)


def has_template(predicate: Column) -> Column:
    return F.array_contains(T.literal_array(L.RELATION_TEMPLATES), predicate)


def _joined(name: str, order: list[str], separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(name).alias("_text")))), lambda s: s["_text"]), separator)


def described(entities: DataFrame, relations: DataFrame, ids: DataFrame) -> DataFrame:
    """id, description: what is known of each entity (id), in order of the relations."""
    ends = relations.withColumn("id_of", F.explode(F.array_distinct(F.array("subject_id", "object_id")))).join(ids.select(F.col("id").alias("id_of")).distinct(), "id_of", "left_semi")
    rows = G.named(ends, entities).where(has_template(F.col("predicate")))
    text = F.concat(sentence(F.col("predicate"), F.col("subject"), F.col("object")), F.when(F.col("is_inferred"), " (inferred)").otherwise(""))
    return rows.withColumn("_d", text).groupBy(F.col("id_of").alias("id")).agg(F.concat(_joined("_d", ["seq", "subject_id", "predicate", "object_id"], "; "), F.lit(".")).alias("description"))


def between(entities: DataFrame, relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, description, confidence of the relations between two entities in either direction."""
    keys = pairs.select("a", "b", F.least("a", "b").alias("_low"), F.greatest("a", "b").alias("_high"))
    rows = relations.withColumns({"_low": F.least("subject_id", "object_id"), "_high": F.greatest("subject_id", "object_id")}).join(keys, ["_low", "_high"])
    rows = G.named(rows, entities)
    return rows.select("a", "b", sentence(F.col("predicate"), F.col("subject"), F.col("object")).alias("description"), "confidence")


def world(entities: DataFrame, relations: DataFrame, users: DataFrame) -> DataFrame:
    """id, summary: a user's (id) own relations in four groups, each family member with what was inferred of them."""
    rows = G.named(relations.join(users.select(F.col("id").alias("subject_id")).distinct(), "subject_id", "left_semi"), entities)
    inferred = G.named(relations.where("is_inferred"), entities).where(has_template(F.col("predicate")))
    extras = inferred.withColumn("_d", sentence(F.col("predicate"), F.col("subject"), F.col("object"))).groupBy(F.col("subject_id").alias("object_id")).agg(_joined("_d", ["seq", "predicate", "object_id"], "; ").alias("extras"))
    p, name = F.col("predicate"), F.col("object")
    family = p.isin("father", "mother", "wife", "husband", "brother", "sister", "son", "daughter", "partner")
    work, place = p.isin("works_at", "role", "colleague", "manages", "boss", "manager"), p.isin("lives_in", "based_in")
    rows = rows.join(extras, "object_id", "left")
    text = (
        F.when(family, F.concat(F.lit("Your "), p, F.lit(" is "), name, F.when(F.col("extras").isNotNull(), F.concat(F.lit(" ("), F.col("extras"), F.lit(")"))).otherwise("")))
        .when(p == "role", F.concat(F.lit("You are a "), name))
        .when(work, F.concat(F.lit("You "), F.replace(p, F.lit("_"), F.lit(" ")), F.lit(" "), name))
        .when(place, F.concat(F.lit("You live in "), name))
        .otherwise(F.concat(F.lit("Your "), p, F.lit(": "), name))
    )
    group = F.when(family, 1).when(work, 2).when(place, 3).otherwise(4)
    return rows.withColumns({"_t": text, "_g": group}).groupBy(F.col("subject_id").alias("id")).agg(F.concat(_joined("_t", ["_g", "seq", "predicate", "object_id"], ". "), F.lit(".")).alias("summary"))


def relevant(entities: DataFrame, relations: DataFrame, scores: DataFrame, k: int = 5, least: float = 0.3, most: int = 10) -> DataFrame:
    """query_id, context: triples around the entities nearest to a query.

    ``scores``: query_id, id, sim, in_query (the name stands in the query, which
    lifts the score).  Of equal triples the most certain stays; the best ten are told.
    """
    sim = F.when(F.col("in_query"), F.greatest("sim", F.lit(0.95))).otherwise(F.col("sim"))
    proper = entities.where(~T.is_junk_name(F.col("name"))).select("id")
    top = scores.join(proper, "id", "left_semi").withColumn("sim", sim)
    top = top.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))).where((F.col("_n") <= k) & (F.col("sim") > least))
    ends = G.strongest_triples(relations).withColumn("id_of", F.explode(F.array_distinct(F.array("subject_id", "object_id"))))
    rows = G.named(ends.join(top.select("query_id", F.col("id").alias("id_of")), "id_of").dropDuplicates(["query_id", *G.RELATION]), entities)
    plain = F.concat_ws(" ", "subject", F.replace("predicate", F.lit("_"), F.lit(" ")), "object")
    text = F.when(has_template(F.col("predicate")), sentence(F.col("predicate"), F.col("subject"), F.col("object"))).otherwise(plain)
    text = F.concat(text, F.when(F.col("is_inferred"), F.concat(F.lit(" (inferred, "), T.percent(F.col("confidence")), F.lit(")"))).otherwise(""))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), "seq", "subject_id", "predicate", "object_id"))
    return rows.withColumns({"_d": text, "_n": place}).where(F.col("_n") <= most).groupBy("query_id").agg(F.concat(_joined("_d", ["_n"], "; "), F.lit(".")).alias("context"))


# questions

_NAME = r"(\w+)"
_RELATION = [rf"who\s+is\s+{_NAME}\s+to\s+(?:my\s+)?{_NAME}", rf"how\s+is\s+{_NAME}\s+related\s+to\s+{_NAME}", rf"what\s+is\s+{_NAME}\s+to\s+(?:my\s+)?{_NAME}", rf"relationship\s+between\s+{_NAME}\s+and\s+{_NAME}"]
_FACT = rf"(?:what(?:'s)?|who)\s+(?:is\s+)?my\s+{_NAME}(?:'s\s+name)?"
_HOPS = rf"my\s+{_NAME}(?:'s|s)\s+{_NAME}"
_ENTITY = [rf"(?:who|what)\s+is\s+{_NAME}", rf"tell\s+me\s+about\s+{_NAME}"]


def _any_group(q: Column, patterns: list[str], group: int) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(q, p, group), F.lit("")) for p in patterns])


def answered(questions: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """question_id, answer, confidence, step of questions (question_id, user_id, question) that the graph answers.

    Steps in order: a relation between two names, a fact of the user, two hops, an
    entity; the first that has an answer wins.  The question is lower-cased first.
    """
    q = F.lower(F.trim("question"))
    asked = questions.select(
        "question_id",
        "user_id",
        _any_group(q, _RELATION, 1).alias("r1"),
        _any_group(q, _RELATION, 2).alias("r2"),
        F.nullif(F.regexp_extract(q, _FACT, 1), F.lit("")).alias("fact"),
        F.nullif(F.regexp_extract(q, _HOPS, 1), F.lit("")).alias("h1"),
        F.nullif(F.regexp_extract(q, _HOPS, 2), F.lit("")).alias("h2"),
        _any_group(q, _ENTITY, 1).alias("name"),
    )
    by_low = entities.withColumn("_low", F.lower("name")).withColumn("_n", F.row_number().over(Window.partitionBy("_low").orderBy("seq"))).where("_n = 1").select("_low", F.col("id").alias("_id"))
    own = G.named(relations, entities)

    # 1: the second name may be a predicate of the user
    first_of = own.withColumn("_n", F.row_number().over(Window.partitionBy("subject_id", "predicate").orderBy("seq"))).where("_n = 1").select(F.col("subject_id").alias("user_id"), F.col("predicate").alias("r2"), F.lower("object").alias("_ref"))
    one = asked.where("r1 IS NOT NULL").join(first_of, ["user_id", "r2"], "left").withColumn("r2", F.coalesce("_ref", "r2"))
    one = one.join(by_low.withColumnsRenamed({"_low": "r1", "_id": "a"}), "r1").join(by_low.withColumnsRenamed({"_low": "r2", "_id": "b"}), "r2").select("question_id", "a", "b")
    pairs = own.withColumns({"_low": F.least("subject_id", "object_id"), "_high": F.greatest("subject_id", "object_id")}).join(one.select("question_id", F.least("a", "b").alias("_low"), F.greatest("a", "b").alias("_high")), ["_low", "_high"])
    pairs = pairs.withColumn("_d", sentence(F.col("predicate"), F.col("subject"), F.col("object")))
    step1 = pairs.groupBy("question_id").agg(_joined("_d", ["seq", "subject_id", "predicate"], " and ").alias("answer"), F.max("confidence").alias("confidence")).withColumn("step", F.lit(1))

    # 2
    facts = asked.where("fact IS NOT NULL").join(own.withColumnsRenamed({"subject_id": "user_id", "predicate": "fact"}).select("user_id", "fact", "object", "seq", "object_id"), ["user_id", "fact"])
    step2 = facts.groupBy("question_id", "fact").agg(_joined("object", ["seq", "object_id"], ", ").alias("_n")).select("question_id", F.concat(F.lit("Your "), F.col("fact"), F.lit(" is "), F.col("_n"), F.lit(".")).alias("answer"), F.lit(1.0).alias("confidence"), F.lit(2).alias("step"))

    # 3
    hop = asked.where("h1 IS NOT NULL").join(relations.select(F.col("subject_id").alias("user_id"), F.col("predicate").alias("h1"), F.col("object_id").alias("mid"), F.col("seq").alias("seq_1")), ["user_id", "h1"])
    spouse = F.col("h2").isin("wife", "husband") & F.col("predicate").isin(*L.SPOUSES)
    second = hop.join(own.select(F.col("subject_id").alias("mid"), "predicate", "object", "object_id", F.col("seq").alias("seq_2")), "mid").where((F.col("predicate") == F.col("h2")) | spouse).where("object_id <> user_id")
    first_mid = second.withColumn("_m", F.min(F.struct("seq_1", "mid")).over(Window.partitionBy("question_id"))).where("_m.mid = mid")
    step3 = first_mid.groupBy("question_id", "h1", "h2").agg(_joined("object", ["seq_2", "object_id"], ", ").alias("_n")).select("question_id", F.concat(F.lit("Your "), F.col("h1"), F.lit("'s "), F.col("h2"), F.lit(" is "), F.col("_n"), F.lit(".")).alias("answer"), F.lit(0.9).alias("confidence"), F.lit(3).alias("step"))

    # 4
    about = asked.where(F.col("name").isNotNull() & ~F.col("name").isin("the", "a", "this", "that", "your", "my", "it")).join(by_low.withColumnsRenamed({"_low": "name", "_id": "id"}), "name").select("question_id", "id")
    step4 = about.join(described(entities, relations, about), "id").select("question_id", F.col("description").alias("answer"), F.lit(0.9).alias("confidence"), F.lit(4).alias("step"))
    every = step1.unionByName(step2).unionByName(step3).unionByName(step4)
    return every.withColumn("_n", F.row_number().over(Window.partitionBy("question_id").orderBy("step"))).where("_n = 1").drop("_n")


def gate_answers(answers: DataFrame, least: float = GATE) -> DataFrame:
    """Answers certain enough to be told as a fact: strictly above the gate."""
    return answers.where(F.col("confidence") > least)
