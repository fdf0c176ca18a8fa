"""Queries on the knowledge graph: look-ups, clean-up, inference, components, words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import lexicon as L
from palimpsest.functions import text as T
from palimpsest.operators import graph as G
from palimpsest.operators import inference as I
from palimpsest.operators import questions as Q
from palimpsest.plans.registry import query
from palimpsest.sources import adapters as A
from palimpsest.sources import tables as ST

Spark, DF = SparkSession, DataFrame
GR = "WITH " + A.GRAPH + " "
REL = ["subject_id", "predicate", "object_id", "confidence"]


def graph(spark: Spark, sf: str) -> tuple[DF, DF]:
    return A.entities(spark, sf), A.relations(spark, sf)


@query(GR + ", names AS (SELECT upper(c_name) AS name FROM customer WHERE c_custkey % 7 = 1) SELECT e.id, e.name FROM entities e WHERE lower(e.name) IN (SELECT lower(name) FROM names)", "fil_6_by_name")
def fil_6(spark: Spark, sf: str) -> DF:
    names = A.table(spark, sf, "customer").where("c_custkey % 7 = 1").select(F.upper("c_name").alias("name"))
    return G.by_name(A.entities(spark, sf), names).select("id", "name")


@query(GR + "SELECT id, subject_id, predicate, object_id FROM relations WHERE subject_id % 40 = 8 OR object_id % 40 = 8", "fil_7_touching")
def fil_7(spark: Spark, sf: str) -> DF:
    e, r = graph(spark, sf)
    return G.touching(r, e.where("id % 40 = 8").select("id")).select("id", "subject_id", "predicate", "object_id")


@query(GR + "SELECT e.id, count(*) AS degree FROM (SELECT subject_id AS id FROM relations UNION ALL SELECT object_id FROM relations) e GROUP BY e.id", "agg_6_degree")
def agg_6(spark: Spark, sf: str) -> DF:
    return G.degrees(A.relations(spark, sf))


@query(GR + "SELECT r.id, coalesce(s.name, '?') AS subject, predicate, coalesce(o.name, '?') AS object FROM relations r LEFT JOIN entities s ON s.id = subject_id LEFT JOIN entities o ON o.id = object_id", "prj_3_named_relations")
def prj_3(spark: Spark, sf: str) -> DF:
    e, r = graph(spark, sf)
    return G.named(r, e).select("id", "subject", "predicate", "object")


@query(GR + "SELECT subject_id AS id, count(*) AS relation_count FROM relations WHERE NOT is_inferred GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", "jn_1_primary_user")
def jn_1(spark: Spark, sf: str) -> DF:
    return G.primary_user(*graph(spark, sf))


_RULES = {name: ", ".join(f"('{a}', '{b}', '{c}')" for (a, b), c in rules.items()) for name, rules in (("in_law", L.IN_LAW_RULES), ("reverse", L.REVERSE_IN_LAW_RULES), ("hop", L.MULTI_HOP_RULES))}
_FULL = (
    A.GRAPH + ", base AS (SELECT * FROM relations WHERE confidence >= 0.8), "
    f"in_law_rules AS (SELECT * FROM (VALUES {_RULES['in_law']}) AS t(p1, p2, res)), reverse_rules AS (SELECT * FROM (VALUES {_RULES['reverse']}) AS t(p1, p2, res)), hop_rules AS (SELECT * FROM (VALUES {_RULES['hop']}) AS t(p1, p2, res)), "
    "in_laws AS (SELECT a.object_id AS subject_id, res AS predicate, b.object_id AS object_id, round(least(a.confidence, b.confidence) * 0.9::DOUBLE, 6) AS confidence, 'in_law' AS stage FROM base a JOIN base b ON a.subject_id = b.subject_id AND a.object_id <> b.object_id JOIN in_law_rules ON p1 = a.predicate AND p2 = b.predicate "
    "QUALIFY row_number() OVER (PARTITION BY a.object_id, res, b.object_id ORDER BY a.seq, b.seq) = 1), "
    "s1 AS (SELECT * FROM in_laws n WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.subject_id = n.subject_id AND r.predicate = n.predicate AND r.object_id = n.object_id)), k1 AS (SELECT subject_id, predicate, object_id FROM relations UNION ALL SELECT subject_id, predicate, object_id FROM s1), "
    "parents AS (SELECT a.object_id AS subject_id, 'married_to' AS predicate, b.object_id AS object_id, round(least(a.confidence, b.confidence) * 0.85::DOUBLE, 6) AS confidence, 'co_parent' AS stage FROM base a JOIN base b ON a.subject_id = b.subject_id AND a.object_id <> b.object_id WHERE a.predicate = 'father' AND b.predicate = 'mother' "
    "QUALIFY row_number() OVER (PARTITION BY a.object_id, b.object_id ORDER BY a.seq, b.seq) = 1), "
    "s2 AS (SELECT * FROM parents n WHERE NOT EXISTS (SELECT 1 FROM k1 r WHERE (r.subject_id = n.subject_id AND r.object_id = n.object_id) OR (r.subject_id = n.object_id AND r.object_id = n.subject_id))), k2 AS (SELECT * FROM k1 UNION ALL SELECT subject_id, predicate, object_id FROM s2), "
    "reverse AS (SELECT a.object_id AS subject_id, res AS predicate, b.object_id AS object_id, round(least(a.confidence, b.confidence) * 0.85::DOUBLE, 6) AS confidence, 'reverse_in_law' AS stage FROM base a JOIN base b ON a.subject_id = b.subject_id AND a.object_id <> b.object_id JOIN reverse_rules ON p1 = a.predicate AND p2 = b.predicate "
    "QUALIFY row_number() OVER (PARTITION BY a.object_id, res, b.object_id ORDER BY a.seq, b.seq) = 1), "
    "s3 AS (SELECT * FROM reverse n WHERE NOT EXISTS (SELECT 1 FROM k2 r WHERE r.subject_id = n.subject_id AND r.predicate = n.predicate AND r.object_id = n.object_id)), k3 AS (SELECT * FROM k2 UNION ALL SELECT subject_id, predicate, object_id FROM s3), "
    "starts AS (SELECT subject_id, min(seq) AS start FROM base GROUP BY subject_id), "
    "hops AS (SELECT b.object_id AS subject_id, res AS predicate, a.subject_id AS object_id, round(least(a.confidence, b.confidence) * 0.8::DOUBLE, 6) AS confidence, 'multi_hop' AS stage, start, a.seq AS q1, b.seq AS q2 FROM base a JOIN base b ON a.object_id = b.subject_id AND b.object_id <> a.subject_id JOIN hop_rules ON p1 = a.predicate AND p2 = b.predicate JOIN starts s ON s.subject_id = a.subject_id "
    "QUALIFY row_number() OVER (PARTITION BY b.object_id, res, a.subject_id ORDER BY a.seq, b.seq) = 1), "
    "hop_new AS (SELECT * FROM hops n WHERE NOT EXISTS (SELECT 1 FROM k3 r WHERE r.subject_id = n.subject_id AND r.predicate = n.predicate AND r.object_id = n.object_id)), "
    "s4 AS (SELECT subject_id, predicate, object_id, confidence, stage FROM hop_new ORDER BY start, q1, q2, object_id LIMIT 20), "
    "inferred AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4)"
)

#: The same with the cap on multi-hop triples for each chain of families.
_FULL_BY_USER = _FULL.replace("FROM hop_new ORDER BY start, q1, q2, object_id LIMIT 20", "FROM hop_new QUALIFY row_number() OVER (PARTITION BY object_id // 24 ORDER BY start, q1, q2, object_id, subject_id, predicate) <= 20")


def gated(spark: Spark, sf: str) -> DF:
    return I.gated(*graph(spark, sf))


@query(f"WITH {_FULL} SELECT subject_id, predicate, object_id, confidence FROM in_laws", "jn_4_in_laws")
def jn_4(spark: Spark, sf: str) -> DF:
    return I.in_laws(gated(spark, sf)).select(*REL)


@query(f"WITH {_FULL} SELECT subject_id, predicate, object_id, confidence FROM parents p WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE (r.subject_id = p.subject_id AND r.object_id = p.object_id) OR (r.subject_id = p.object_id AND r.object_id = p.subject_id))", "jn_5_co_parents")
def jn_5(spark: Spark, sf: str) -> DF:
    return I.co_parents(gated(spark, sf), A.relations(spark, sf)).select(*REL)


@query(f"WITH {_FULL} SELECT subject_id, predicate, object_id, confidence FROM reverse", "jn_6_reverse_in_laws")
def jn_6(spark: Spark, sf: str) -> DF:
    return I.reverse_in_laws(gated(spark, sf)).select(*REL)


@query(f"WITH {_FULL} SELECT subject_id, predicate, object_id, confidence FROM hops", "jn_7_multi_hop")
def jn_7(spark: Spark, sf: str) -> DF:
    return I.multi_hops(gated(spark, sf), None).select(*REL)


def by_user(spark: Spark, sf: str) -> tuple[DF, DF]:
    """The graph with a chain of families as a user's."""
    e, r = graph(spark, sf)
    return e, r.withColumn("user_id", A.chain("subject_id").cast("string"))


@query(f"WITH {_FULL_BY_USER} SELECT subject_id, predicate, object_id, confidence, stage FROM inferred", "gr_4_full_inference")
def gr_4_by_user(spark: Spark, sf: str) -> DF:
    return I.full(*by_user(spark, sf))


@query(GR + f", rules AS (SELECT * FROM (VALUES {_RULES['in_law']}) AS t(p1, p2, res)) SELECT a.object_id AS subject_id, res AS predicate, b.object_id AS object_id, round(least(a.confidence, b.confidence) * 0.9::DOUBLE, 6) AS confidence FROM relations a JOIN relations b ON a.subject_id = b.subject_id AND a.object_id <> b.object_id JOIN rules ON p1 = a.predicate AND p2 = b.predicate WHERE a.subject_id = 8", "jn_9_user_rules")
def jn_9(spark: Spark, sf: str) -> DF:
    return I.of_user(A.relations(spark, sf), F.lit(8)).select(*REL)


@query(f"WITH {_FULL_BY_USER}, every AS (SELECT is_inferred FROM relations UNION ALL SELECT true FROM inferred) SELECT (SELECT count(*) FROM entities) AS entities, count(*) FILTER (NOT is_inferred) AS explicit_relations, count(*) FILTER (is_inferred) AS inferred_relations FROM every", "agg_2_graph_stats")
def agg_2_by_user(spark: Spark, sf: str) -> DF:
    e, r = graph(spark, sf)
    return G.stats(e, I.with_inferred(r, I.full(*by_user(spark, sf))))


@query(GR + "SELECT id, subject_id, predicate, object_id FROM relations WHERE subject_id % 24 <> 8 AND object_id % 24 <> 8", "dml_9_delete_entities")
def dml_9(spark: Spark, sf: str) -> DF:
    e, r = graph(spark, sf)
    return G.without_entities(e, r, e.where("id % 24 = 8"))[1].select("id", "subject_id", "predicate", "object_id")


_MOVED = "moved AS (SELECT id, CASE WHEN subject_id % 8 = 2 THEN subject_id - 1 ELSE subject_id END AS subject_id, predicate, CASE WHEN object_id % 8 = 2 THEN object_id - 1 ELSE object_id END AS object_id, seq FROM relations)"


@query(GR + f", {_MOVED} SELECT id, subject_id, predicate, object_id FROM moved WHERE subject_id <> object_id QUALIFY row_number() OVER (PARTITION BY subject_id, predicate, object_id ORDER BY seq) = 1", "dml_10_repoint")
def dml_10(spark: Spark, sf: str) -> DF:
    e, r = graph(spark, sf)
    mapping = e.where("id % 8 = 2").select(F.col("id").alias("old"), (F.col("id") - 1).alias("new"))
    return G.repointed(r, mapping).select("id", "subject_id", "predicate", "object_id")


@query(GR + ", new AS (SELECT id + 100000000 AS id, subject_id, predicate, object_id + (id % 2) AS object_id FROM relations) SELECT id, subject_id, predicate, object_id FROM relations UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.subject_id = n.subject_id AND r.predicate = n.predicate AND r.object_id = n.object_id)", "dml_11_jn_8_insert_absent")
def dml_11(spark: Spark, sf: str) -> DF:
    r = A.relations(spark, sf)
    new = r.withColumn("object_id", F.col("object_id") + F.col("id") % 2).withColumn("id", F.col("id") + 100000000)
    return G.inserted(r, new).select("id", "subject_id", "predicate", "object_id")


@query(GR + "SELECT id FROM relations WHERE NOT (least(subject_id, object_id) % 32 = 0 AND greatest(subject_id, object_id) - least(subject_id, object_id) = 3)", "dml_12_delete_between")
def dml_12(spark: Spark, sf: str) -> DF:
    e, r = graph(spark, sf)
    pairs = e.where("id % 32 = 0").select((F.col("id") + 3).alias("a"), F.col("id").alias("b"))
    return G.without_between(r, pairs).select("id")


#: A small graph with all that clean-up looks for.
MESSY_ENTITIES = [(1, "Ann", "person"), (2, "ann", "person"), (3, "Bob", "person"), (4, "your father", "person"), (5, "wifes", "person"), (6, "Carl", "person"), (7, "Dora", "person"), (8, "Dog", "animal"), (9, "Rex", "animal"), (10, "father", "person"), (11, "none", "person"), (12, "If Bob", "person"), (13, "3 days ago", "person"), (14, "Lone", "person"), (15, "Annie's", "person"), (16, "mother", "person")]
MESSY_RELATIONS = [
    (1, 1, "wife", 3, 1.0), (2, 1, "husband", 3, 0.9), (3, 3, "husband", 1, 1.0), (4, 2, "sister", 7, 0.8), (5, 1, "father-in-law", 6, 1.0), (6, 1, "father_in_law_of", 6, 0.7), (7, 4, "friend", 1, 1.0), (8, 1, "dog", 8, 1.0),
    (9, 1, "dog", 9, 1.0), (10, 1, "friend", 99, 1.0), (11, 1, "father", 6, 1.0), (12, 7, "friend", 10, 1.0), (13, 1, "friend", 7, 0.5), (14, 1, "friend", 7, 0.9), (15, 11, "friend", 3, 1.0),
]
_ME = A.GRAPH.replace("entities AS", "whole_e AS").replace("relations AS", "whole_r AS") + ", entities AS (SELECT id::BIGINT AS id, name, entity_type, id::BIGINT AS seq FROM (VALUES " + ", ".join("({}, '{}', '{}')".format(i, n.replace("'", "''"), t) for i, n, t in MESSY_ENTITIES) + ") AS t(id, name, entity_type) UNION ALL SELECT id + 1000, name, entity_type, seq + 1000 FROM whole_e)"
_MR = "relations AS (SELECT id::BIGINT AS id, subject_id::BIGINT AS subject_id, predicate, object_id::BIGINT AS object_id, confidence::DOUBLE AS confidence, false AS is_inferred, id::BIGINT AS seq FROM (VALUES " + ", ".join(f"({i}, {s}, '{p}', {o}, {c})" for i, s, p, o, c in MESSY_RELATIONS) + ") AS t(id, subject_id, predicate, object_id, confidence) UNION ALL SELECT id + 1000, subject_id + 1000, predicate, object_id + 1000, confidence, is_inferred, seq + 1000 FROM whole_r)"
MESSY = f"WITH {_ME}, {_MR} "


def messy(spark: Spark, sf: str) -> tuple[DF, DF]:
    """The small graph beside the whole one, whose ids are moved out of the way."""
    e = spark.createDataFrame(MESSY_ENTITIES, "id long, name string, entity_type string").withColumn("seq", F.col("id"))
    r = spark.createDataFrame(MESSY_RELATIONS, "id long, subject_id long, predicate string, object_id long, confidence double").withColumn("is_inferred", F.lit(False)).withColumn("seq", F.col("id"))
    more_e, more_r = graph(spark, sf)
    more_e = more_e.withColumns({c: F.col(c) + 1000 for c in ("id", "seq")})
    more_r = more_r.withColumns({c: F.col(c) + 1000 for c in ("id", "subject_id", "object_id", "seq")})
    return e.unionByName(more_e), r.unionByName(more_r)


#: Fixed values of the SQL, apart from the engine's own.
_JUNK_WORDS = (
    "? actually ai also and anyone anything assistant based bot but default everyone everything he her here him his however i if it just me my n/a no none nor nothing now null "
    "ok or our really she so someone something sure their them then there therefore they today tomorrow topic undefined unknown us we well well-being yes yesterday yet you "
    "your"
).split() + ["", "feeding schedule", "feeding schedule care", "the user"]
#: First words of junk.
_JUNK_FIRST = (
    "and but hello hey hi if no nor not ok or please so thank thanks yes yet"
).split()
#: Names that are refused.
_INVALID_WORDS = (
    "? a about absolutely acknowledged actually advice after ai all already also although always am an and another answer any anyone anything apologies apparently appreciate "
    "are ask asked asking asks assistant at aunt bad based based-in based_in be became because become becomes becoming been before began begin beginning begins being big boss "
    "bot bro brother brother-in-law brother_in_law but by call called calling calls came can care cat certainly child classmate colleague come comes coming concerning "
    "condition confirmed context correct could cousin currently dad daughter daughter-in-law daughter_in_law default definitely details diagnosed-with diagnosed_with did do "
    "doctor does dog doing done each else employee even every everyone everything exactly example examples father father-in-law father_in_law feeding feel feeling feels felt "
    "few finally find finding finds first following for found friend from furthermore gave get gets getting give given gives giving glad go goes going gone good got "
    "grandfather grandmother great had happy has has-condition has_condition have having he hear heard hearing hears hello help her here hers herself hey hi him himself his "
    "hobby home hospital how however husband i if important in indeed information interested-in interested_in into is is-a is_a issue it its itself just keep keeping keeps "
    "kept key knew know knowing known knows last least leave leaves leaving left less let lets letting live lived lives lives-in lives_in living look looked looking looks ma "
    "made make makes making manager many married-to married_to may maybe me mean meaning means meant meanwhile mention mentioned might mine mom more moreover most mother "
    "mother-in-law mother_in_law move moved moves moving much mum must my myself n/a named need needed needing needs neighbor never new next no nobody none nor not note noted "
    "nothing now null of off office often oh ok okay old on only or other our ours ourselves out pa parent partner perhaps pet play played playing plays please point points "
    "probably problem put puts putting question ran really recall recently regarding related remember right role run running runs said saw say saying says schedule school "
    "second see seeing seen sees shall she should show showed showing shown shows sibling since sis sister sister-in-law sister_in_law small so some someone something "
    "sometimes son son-in-law son_in_law sorry specifically specified step-father step-mother step_father step_mother stepfather stepmother still studies summary sure take "
    "taken takes taking tell telling tells thank thanks that the their theirs them themselves then there therefore these they think thinking thinks third this those though "
    "thought to today told tomorrow took tried tries try trying uncle undefined understood unknown unless until up us use used user uses using usually very want wanted wanting "
    "wants was we well well-being went were what when where whether which while who whom whose why wife will with work worked working works works-at works_at would yes "
    "yesterday yet you your yours yourself"
).split() + ["", "based in", "brother in law", "daughter in law", "diagnosed with", "father in law", "has condition", "interested in", "is a", "lives in", "married to", "mother in law", "no one", "sister in law", "son in law", "step father", "step mother", "the user", "works at"]
#: First words that no name has.
_STARTERS = (
    "actually also and because but did do does for furthermore hello hey hi how however if just moreover no nor not ok okay or please really since so thank thanks then "
    "therefore what when where which while who why yes yet"
).split()
#: Second words that no name has.
_FRAGMENTS = (
    "did does gets goes had has have is lives makes says takes was were works"
).split()


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_BARE = r"trim(regexp_replace(CASE WHEN name LIKE '%''s' THEN left(name, length(name) - 2) ELSE name END, '\s*\([^)]*\)\s*$', ''))"
_JUNK = f"(lower({_BARE}) IN ({_in(_JUNK_WORDS)}) OR length({_BARE}) < 2 OR regexp_matches({_BARE}, '^[\\d\\s.,:/-]+$') OR regexp_matches({_BARE}, '(?i)^\\d+\\s+(days?|weeks?|months?|years?|hours?|minutes?)\\s+ago$') OR (contains({_BARE}, ' ') AND lower(string_split({_BARE}, ' ')[1]) IN ({_in(_JUNK_FIRST)})))"


@query(f"{MESSY}, every AS (SELECT id::BIGINT AS id, name FROM entities UNION ALL SELECT p_partkey + 100, p_name FROM part) SELECT id, name FROM every WHERE {_JUNK}", "fil_14_junk_names")
def fil_14(spark: Spark, sf: str) -> DF:
    every = messy(spark, sf)[0].select(F.col("id").cast("long").alias("id"), "name").unionByName(A.table(spark, sf, "part").select((F.col("p_partkey") + 100).alias("id"), F.col("p_name").alias("name")))
    return G.junk(every)


_VALID = (
    f"NOT (length({_BARE}) < 2 OR lower({_BARE}) IN ({_in(_INVALID_WORDS)}) OR regexp_matches({_BARE}, '^[\\d\\s.,:/-]+$') OR contains({_BARE}, '''s ') OR len(string_split({_BARE}, ' ')) > 3 OR regexp_matches(lower({_BARE}), '^(the|a|an|my|our|your) ') "
    f"OR (contains({_BARE}, ' ') AND (lower(string_split({_BARE}, ' ')[1]) IN ({_in(_STARTERS)}) OR lower(string_split({_BARE}, ' ')[2]) IN ({_in(_FRAGMENTS)}))))"
)


@query(f"{MESSY}, every AS (SELECT id::BIGINT AS id, name FROM entities UNION ALL SELECT p_partkey + 100, p_name FROM part UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier) SELECT id, {_VALID} AS valid FROM every", "fil_15_valid_names")
def fil_15(spark: Spark, sf: str) -> DF:
    every = messy(spark, sf)[0].select(F.col("id").cast("long").alias("id"), "name")
    every = every.unionByName(A.table(spark, sf, "part").select((F.col("p_partkey") + 100).alias("id"), F.col("p_name").alias("name"))).unionByName(A.table(spark, sf, "supplier").select((F.col("s_suppkey") + 1000000).alias("id"), F.col("s_name").alias("name")))
    return every.select("id", T.is_valid_name(F.col("name")).alias("valid"))


@query(MESSY + r"SELECT id, name FROM entities WHERE regexp_matches(lower(name), '^your\s+|^my\s+|^the\s+|^wifes?$|^husbands?$|^you$|^me$|^user$|^concept$|''s\s+\w+$')", "fil_16_garbage_names")
def fil_16(spark: Spark, sf: str) -> DF:
    return G.garbage(messy(spark, sf)[0]).select("id", "name")


@query(MESSY + ", n AS (SELECT *, CASE lower(predicate) WHEN 'father-in-law' THEN 'father_in_law_of' WHEN 'mother-in-law' THEN 'mother_in_law_of' ELSE predicate END AS p FROM relations) SELECT id, subject_id, p AS predicate, object_id FROM n QUALIFY row_number() OVER (PARTITION BY subject_id, p, object_id ORDER BY p <> predicate, seq) = 1", "dml_15_normalise")
def dml_15(spark: Spark, sf: str) -> DF:
    return G.normalised(messy(spark, sf)[1]).select("id", "subject_id", "predicate", "object_id")


@query(MESSY + "SELECT id FROM relations r WHERE NOT (predicate = 'husband' AND EXISTS (SELECT 1 FROM relations w WHERE w.predicate = 'wife' AND w.subject_id = r.subject_id AND w.object_id = r.object_id))", "jn_3_contradictions")
def jn_3(spark: Spark, sf: str) -> DF:
    return G.without_contradictions(messy(spark, sf)[1]).select("id")


@query(MESSY + ", m AS (SELECT * FROM relations WHERE predicate IN ('wife', 'husband') QUALIFY row_number() OVER (PARTITION BY least(subject_id, object_id), greatest(subject_id, object_id) ORDER BY seq) = 1) SELECT subject_id, predicate, object_id FROM relations WHERE predicate NOT IN ('wife', 'husband') UNION ALL SELECT subject_id, predicate, object_id FROM m UNION ALL SELECT object_id, CASE predicate WHEN 'wife' THEN 'husband' ELSE 'wife' END, subject_id FROM m", "dml_16_spouses")
def dml_16(spark: Spark, sf: str) -> DF:
    return G.spouses_directed(messy(spark, sf)[1]).select("subject_id", "predicate", "object_id")


@query(MESSY + "SELECT id FROM relations WHERE subject_id IN (SELECT id FROM entities) AND object_id IN (SELECT id FROM entities)", "jn_21_dangling")
def jn_21(spark: Spark, sf: str) -> DF:
    e, r = messy(spark, sf)
    return G.without_dangling(r, e).select("id")


@query(MESSY + "SELECT id, name FROM entities WHERE id NOT IN (SELECT subject_id FROM relations UNION SELECT object_id FROM relations)", "jn_22_orphans")
def jn_22(spark: Spark, sf: str) -> DF:
    e, r = messy(spark, sf)
    return G.orphans(e, r).select("id", "name")


@query(MESSY + "SELECT subject_id, predicate, object_id, max(confidence) AS confidence FROM relations GROUP BY ALL", "agg_10_strongest_triples")
def agg_10(spark: Spark, sf: str) -> DF:
    return G.strongest_triples(messy(spark, sf)[1]).select(*REL)


@query(MESSY + "SELECT subject_id, predicate, object_id, min(id) AS id FROM relations GROUP BY ALL", "agg_11_distinct_triples")
def agg_11(spark: Spark, sf: str) -> DF:
    return G.distinct_triples(messy(spark, sf)[1]).select("subject_id", "predicate", "object_id", "id")


@query(MESSY + ", d AS (SELECT id, count(*) AS n FROM (SELECT subject_id AS id FROM relations UNION ALL SELECT object_id FROM relations) GROUP BY id), r AS (SELECT e.id, lower(name) AS low, row_number() OVER w AS n, first_value(e.id) OVER w AS new FROM entities e LEFT JOIN d ON d.id = e.id WINDOW w AS (PARTITION BY lower(name) ORDER BY coalesce(d.n, 0) DESC, seq DESC)) SELECT id AS old, new FROM r WHERE n > 1", "dml_18_case_duplicates")
def dml_18(spark: Spark, sf: str) -> DF:
    return G.case_duplicates(*messy(spark, sf))


@query(MESSY + ", pets AS (SELECT subject_id, predicate, object_id, r.seq, lower(e.name) AS low FROM relations r JOIN entities e ON e.id = object_id WHERE predicate IN ('pet', 'dog', 'cat')), gone AS (SELECT g.object_id AS id FROM pets g JOIN pets n ON n.subject_id = g.subject_id AND n.predicate = g.low AND n.low NOT IN ('pet', 'dog', 'cat') WHERE g.low IN ('pet', 'dog', 'cat')) SELECT id, name FROM entities WHERE id NOT IN (SELECT id FROM gone)", "dml_24_jn_2_pets")
def dml_24(spark: Spark, sf: str) -> DF:
    return G.pets_merged(*messy(spark, sf))[0].select("id", "name")


_DICE = "bigrams AS (SELECT id, name, entity_type, lower(name) AS low, list_distinct(list_transform(range(1, length(name)), lambda i: substr(lower(name), i, 2))) AS b FROM people)"


@query("WITH people AS (SELECT s_suppkey AS id, replace(s_name, 'Supplier#', 'S ') AS name, 'company' AS entity_type FROM supplier), " + _DICE + " SELECT x.id AS a, y.id AS b, round(CASE WHEN x.low = y.low THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(x.b, y.b)) / (len(x.b) + len(y.b)) END, 6) AS similarity FROM bigrams x JOIN bigrams y ON x.id < y.id WHERE round(2.0::DOUBLE * len(list_intersect(x.b, y.b)) / (len(x.b) + len(y.b)), 6) >= 0.9", "fn_4_similar_names")
def fn_4(spark: Spark, sf: str) -> DF:
    people = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.replace("s_name", F.lit("Supplier#"), F.lit("S ")).alias("name"), F.lit("company").alias("entity_type"))
    return G.similar_names(people, 0.9).select("a", "b", "similarity")


@query(GR + "SELECT DISTINCT a.object_id AS a, b.object_id AS b FROM relations a JOIN relations b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.object_id < b.object_id WHERE a.predicate IN ('father', 'mother')", "jn_18_same_parents")
def jn_18(spark: Spark, sf: str) -> DF:
    return G.same_parents(A.relations(spark, sf))


@query(
    GR + ", s AS (SELECT id, list_sort(list(DISTINCT s)) AS sig FROM (SELECT subject_id AS id, predicate || '_out' AS s FROM relations UNION ALL SELECT object_id, predicate || '_in' FROM relations) GROUP BY id), k AS (SELECT sig, count(*) AS n FROM s GROUP BY sig) "
    "SELECT array_to_string(a.sig, ',') AS signature_a, array_to_string(b.sig, ',') AS signature_b, a.n AS entities_a, b.n AS entities_b, round(len(list_intersect(a.sig, b.sig))::DOUBLE / len(list_distinct(a.sig || b.sig)), 6) AS jaccard FROM k a JOIN k b ON a.sig <= b.sig WHERE len(list_intersect(a.sig, b.sig))::DOUBLE / len(list_distinct(a.sig || b.sig)) >= 0.5",
    "jn_17_similar_signatures",
)
def jn_17(spark: Spark, sf: str) -> DF:
    rows = G.similar_signatures(A.relations(spark, sf))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("signature_a", "signature_b")})


_COMPONENTS = "both_ways AS (SELECT subject_id AS a, object_id AS b FROM relations UNION SELECT object_id, subject_id FROM relations), reach AS (SELECT id AS node, id AS root FROM entities UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node WHERE r.root <= e.b), parts AS (SELECT node AS id, min(root) AS component FROM reach GROUP BY node)"
_CR = "WITH RECURSIVE " + A.GRAPH + ", " + _COMPONENTS


@query(f"{_CR} SELECT id, component FROM parts", "gr_1_components")
def gr_1(spark: Spark, sf: str) -> DF:
    return G.components(*graph(spark, sf))


@query(f"{_CR}, s AS (SELECT component, count(*) AS n FROM parts GROUP BY component), t AS (SELECT n, count(*) AS times FROM s GROUP BY n) SELECT sum(times)::BIGINT AS component_count, string_agg(n::VARCHAR || 'x' || times::VARCHAR, ',' ORDER BY n DESC) AS sizes, sum(times) <= 1 AS fully_connected FROM t", "agg_15_connectivity")
def agg_15(spark: Spark, sf: str) -> DF:
    rows = G.connectivity(G.components(*graph(spark, sf)))
    return rows.withColumn("sizes", F.array_join(F.transform("sizes", lambda s: F.concat(s["size"].cast("string"), F.lit("x"), s["times"].cast("string"))), ","))


@query(f"{_CR}, d AS (SELECT id, count(*) AS degree FROM (SELECT subject_id AS id FROM relations UNION ALL SELECT object_id FROM relations) GROUP BY id), main AS (SELECT component AS m FROM parts GROUP BY component ORDER BY count(*) DESC, component LIMIT 1), k AS (SELECT p.id, component, coalesce(degree, 0) AS degree, component = m AS in_main FROM parts p CROSS JOIN main LEFT JOIN d ON d.id = p.id), "
       "hub AS (SELECT id AS b FROM k WHERE in_main ORDER BY degree DESC, id LIMIT 1) SELECT id AS a, b, 'related_to' AS predicate, 0.4::DOUBLE AS confidence, 'hub' AS kind FROM k, hub WHERE NOT in_main QUALIFY row_number() OVER (PARTITION BY component ORDER BY degree DESC, id) = 1", "gr_2_bridges")
def gr_2(spark: Spark, sf: str) -> DF:
    e, r = graph(spark, sf)
    none = spark.createDataFrame([], "a long, b long, sim double")
    return G.bridges(G.components(e, r), G.degrees(r), none.drop("sim"), none)


@query(GR + ", d AS (SELECT id, count(*) AS degree FROM (SELECT subject_id AS id FROM relations UNION ALL SELECT object_id FROM relations) GROUP BY id) SELECT 'node' AS kind, e.id::VARCHAR AS key, name AS label, coalesce(degree, 0)::DOUBLE AS weight FROM entities e LEFT JOIN d ON d.id = e.id UNION ALL SELECT 'link', s.name || '>' || o.name, predicate, confidence FROM relations JOIN entities s ON s.id = subject_id JOIN entities o ON o.id = object_id", "gr_24_network")
def gr_24(spark: Spark, sf: str) -> DF:
    e, r = graph(spark, sf)
    ids = e.select("id")
    return G.network(e, G.without_dangling(r, ids))


@query(MESSY + "SELECT id::INT AS id, name FROM entities WHERE id NOT IN (10, 11, 12, 13, 16)", "gr_3_heal")
def gr_3(spark: Spark, sf: str) -> DF:
    return G.healed(*messy(spark, sf), F.lit(1))[0].select("id", "name")


def _case(column: str, subject: str, object: str) -> str:
    whens = " ".join("WHEN '{}' THEN replace(replace('{}', '{{subject}}', {}), '{{object}}', {})".format(p, t.replace("'", "''"), subject, object) for p, t in L.RELATION_TEMPLATES.items())
    return f"CASE {column} {whens} ELSE {subject} || ' is related to ' || {object} END"


@query(GR + f", n AS (SELECT r.id, coalesce(s.name, '?') AS s, predicate, coalesce(o.name, '?') AS o FROM relations r LEFT JOIN entities s ON s.id = subject_id LEFT JOIN entities o ON o.id = object_id) SELECT id, {_case('predicate', 's', 'o')} AS sentence FROM n", "prj_4_sentences")
def prj_4(spark: Spark, sf: str) -> DF:
    e, r = graph(spark, sf)
    return G.named(r, e).select("id", I.sentence(F.col("predicate"), F.col("subject"), F.col("object")).alias("sentence"))


_SAID = f"told AS (SELECT r.seq, r.subject_id, r.predicate, r.object_id, r.is_inferred, r.confidence, s.name AS s, o.name AS o, {_case('r.predicate', 's.name', 'o.name')} AS d FROM relations r JOIN entities s ON s.id = subject_id JOIN entities o ON o.id = object_id WHERE r.predicate <> 'father_in_law')"


@query(GR + f", {_SAID} SELECT id, string_agg(d, '; ' ORDER BY seq) || '.' AS description FROM (SELECT subject_id AS id, seq, d FROM told UNION ALL SELECT object_id, seq, d FROM told WHERE object_id <> subject_id) WHERE id % 8 = 1 GROUP BY id", "ctx_6_describe")
def ctx_6(spark: Spark, sf: str) -> DF:
    e, r = graph(spark, sf)
    proper = G.without_dangling(r, e)
    return I.described(e, proper, e.where("id % 8 = 1").select("id"))


_WORLD = ("n AS (SELECT subject_id AS id, relations.seq, predicate, coalesce(o.name, '?') AS o FROM relations LEFT JOIN entities o ON o.id = object_id), t AS (SELECT id, seq, CASE WHEN predicate IN ('father', 'mother', 'wife', 'sister') THEN 1 ELSE 4 END AS g, CASE WHEN predicate IN ('father', 'mother', 'wife', 'sister') THEN 'Your ' || predicate || ' is ' || o ELSE 'Your ' || predicate || ': ' || o END AS d FROM n), world AS (SELECT id, string_agg(d, '. ' ORDER BY g, seq) || '.' AS summary FROM t GROUP BY id)")


@query(GR + f", {_WORLD} SELECT id, summary FROM world WHERE id % 8 = 0", "ctx_5_world_summary")
def ctx_5(spark: Spark, sf: str) -> DF:
    e, r = graph(spark, sf)
    return I.world(e, r, e.where("id % 8 = 0").select("id"))


@query(GR + f", {_SAID} SELECT least(subject_id, object_id) AS a, greatest(subject_id, object_id) AS b, d AS description, confidence FROM told WHERE least(subject_id, object_id) % 16 = 0 AND greatest(subject_id, object_id) - least(subject_id, object_id) = 2", "jn_11_between")
def jn_11(spark: Spark, sf: str) -> DF:
    e, r = graph(spark, sf)
    return I.between(e, G.without_dangling(r, e), e.where("id % 16 = 0").select(F.col("id").alias("a"), (F.col("id") + 2).alias("b")))


_SCORES = "scores AS (SELECT q.id % 3 AS query_id, q.id, 0.2::DOUBLE + (q.id % 7) / 10.0::DOUBLE AS sim, q.id % 11 = 0 AS in_query FROM entities q WHERE q.id < 4000)"


_ALL_SCORES = "scores AS (SELECT q.id % 3 AS query_id, q.id, 0.2::DOUBLE + (q.id % 7) / 10.0::DOUBLE AS sim, q.id % 11 = 0 AS in_query FROM entities q)"


@query(
    GR + f", {_ALL_SCORES}, lifted AS (SELECT query_id, id, CASE WHEN in_query THEN greatest(sim, 0.95::DOUBLE) ELSE sim END AS sim FROM scores), top AS (SELECT * FROM lifted QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) <= 5), "
    f"n AS (SELECT DISTINCT t.query_id, r.*, coalesce(s.name, '?') AS s, coalesce(o.name, '?') AS o FROM relations r JOIN top t ON t.sim > 0.3 AND t.id IN (r.subject_id, r.object_id) LEFT JOIN entities s ON s.id = subject_id LEFT JOIN entities o ON o.id = object_id), "
    f"d AS (SELECT query_id, CASE WHEN predicate = 'father_in_law' THEN s || ' father in law ' || o ELSE {_case('predicate', 's', 'o')} END AS d, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, seq, subject_id) AS k FROM n) SELECT query_id, string_agg(d, '; ' ORDER BY k) || '.' AS context FROM d WHERE k <= 10 GROUP BY query_id",
    "ctx_9_top_7_relevant_triples",
)
def ctx_9_all(spark: Spark, sf: str) -> DF:
    e, r = graph(spark, sf)
    scores = e.select((F.col("id") % 3).alias("query_id"), "id", (0.2 + (F.col("id") % 7) / 10.0).alias("sim"), (F.col("id") % 11 == 0).alias("in_query"))
    return I.relevant(e, r, scores)


#: Questions about the messy graph's first entity.
QUESTIONS = [(1, "What's my father's name?"), (2, "Who is my sister's husband"), (3, "who is Bob to Ann"), (4, "tell me about carl"), (5, "who is my uncle"), (6, "How is Carl related to Ann?"), (7, "Who is Bob to my friend"), (8, "what time is it")]


@query(None, "ctx_7_8_questions")
def ctx_7(spark: Spark, sf: str) -> DF:
    e, r = messy(spark, sf)
    asked = spark.createDataFrame(QUESTIONS, "question_id long, question string").withColumn("user_id", F.lit(1).cast("long"))
    users = e.where("id >= 1000 AND id % 8 = 0").select((F.col("id") * 10).alias("base"), F.col("id").alias("user_id"))
    some = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(q).alias("question")) for i, q in enumerate(("who is my wife", "What is my father's name?", "show my father's mother", "who is my uncle"))])).alias("q")
    more = users.select("base", "user_id", some).select((F.col("base") + F.col("q.i")).alias("question_id"), "q.question", "user_id")
    return I.answered(asked.unionByName(more), e, r)


@query(GR + "SELECT id, answer FROM (SELECT a.subject_id AS id, string_agg(o.name, ', ' ORDER BY b.seq) AS answer FROM relations a JOIN relations b ON b.subject_id = a.object_id AND b.predicate = 'father' JOIN entities o ON o.id = b.object_id WHERE a.predicate = 'father' GROUP BY 1)", "jn_10_two_hops")
def jn_10(spark: Spark, sf: str) -> DF:
    e, r = graph(spark, sf)
    users = r.where("predicate = 'father'").select(F.col("subject_id").alias("user_id")).distinct()
    asked = users.select(F.col("user_id").alias("question_id"), "user_id", F.lit("show my father's father please").alias("question"))
    rows = I.answered(asked, e, r).where("step = 3")
    return rows.select(F.col("question_id").alias("id"), F.regexp_extract("answer", r"^Your father's father is (.*)\.$", 1).alias("answer"))


_ASKED = (
    ", n AS (SELECT r.*, s.name AS s, o.name AS o, replace(predicate, '_', ' ') AS p FROM relations r JOIN entities s ON s.id = subject_id JOIN entities o ON o.id = object_id), "
    "yes AS (SELECT 'boolean' AS mode, 'is ' || o || ' ' || s || '''s ' || p || '?' AS question, 'yes' AS answer FROM n), other AS (SELECT *, lead(o) OVER (PARTITION BY predicate ORDER BY seq) AS x FROM n), "
    "no AS (SELECT 'boolean' AS mode, 'is ' || x || ' ' || s || '''s ' || p || '?' AS question, 'no' AS answer FROM other WHERE x IS NOT NULL AND x <> o AND x <> s), "
    "counts AS (SELECT subject_id, s, predicate, p, count(*) AS c FROM n GROUP BY ALL), kinds AS (SELECT unnest(['brother', 'sister', 'son', 'daughter']) AS k), "
    "asked AS (SELECT 'single_hop' AS mode, 'who is ' || s || '''s ' || p || '?' AS question, o AS answer FROM n UNION ALL SELECT 'inverse', 'whose ' || p || ' is ' || o || '?', s FROM n UNION ALL SELECT * FROM yes UNION ALL SELECT * FROM no WHERE question NOT IN (SELECT question FROM yes) "
    "UNION ALL SELECT 'count', 'how many ' || p || 's does ' || s || ' have?', c::VARCHAR FROM counts UNION ALL SELECT 'count', 'how many ' || k || 's does ' || s || ' have?', '0' FROM (SELECT DISTINCT subject_id, s FROM n) u, kinds WHERE NOT EXISTS (SELECT 1 FROM counts c WHERE c.subject_id = u.subject_id AND c.predicate = k) "
    "UNION ALL SELECT 'multi_hop', 'who is ' || a.s || '''s ' || a.p || '''s ' || b.p || '?', b.o FROM n a JOIN n b ON b.subject_id = a.object_id WHERE a.s <> b.o)"
)


@query(GR + _ASKED + " SELECT mode, question, answer FROM asked", "qa_1_questions")
def qa_1(spark: Spark, sf: str) -> DF:
    e, r = graph(spark, sf)
    return Q.generated(e, G.without_dangling(r, e))


@query(GR + "SELECT subject_id, predicate, count(*) AS n FROM relations GROUP BY ALL", "agg_17_counts")
def agg_17(spark: Spark, sf: str) -> DF:
    return Q.counted(A.relations(spark, sf))


@query(
    GR + f", {_SAID}, {_WORLD}, people AS (SELECT DISTINCT subject_id, s.name AS s FROM relations JOIN entities s ON s.id = subject_id), kinds AS (SELECT unnest(['wife', 'husband', 'brother', 'sister']) AS p) "
    "SELECT 'negation' AS kind, 'Who is ' || s || '''s ' || p || '?' AS question, 'I don''t know of a ' || p || ' of ' || s || '.' AS answer FROM people, kinds WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.subject_id = people.subject_id AND r.predicate = p) "
    "UNION ALL SELECT CASE WHEN is_inferred THEN 'inference' ELSE 'relation' END, 'What do you know about ' || s || ' and ' || o || '?', d || '.' FROM told UNION ALL SELECT 'summary', 'What do you know about ' || s || '?', 'Based on what I remember: ' || summary FROM people JOIN world ON world.id = subject_id",
    "qa_2_training_pairs",
)
def qa_2(spark: Spark, sf: str) -> DF:
    e, r = graph(spark, sf)
    return Q.training_pairs(e, G.without_dangling(r, e))


@query("WITH " + A.GRAPH + ", pairs AS (SELECT 'whose ' || replace(predicate, '_', ' ') || ' is ' || o.name || '?' AS question, s.name AS answer FROM relations JOIN entities s ON s.id = subject_id JOIN entities o ON o.id = object_id) SELECT '{\"messages\":[{\"role\":\"user\",\"content\":\"' || question || '\"},{\"role\":\"assistant\",\"content\":\"' || answer || '\"}]}' AS value FROM pairs", "snk_2_training_lines")
def snk_2(spark: Spark, sf: str) -> DF:
    e, r = graph(spark, sf)
    pairs = Q.generated(e, G.without_dangling(r, e)).where("mode = 'inverse'")
    return ST.training_lines(pairs)


@query(GR + ", t AS (SELECT 0 AS part, min(seq) AS place, name AS token, 'entity' AS kind FROM entities GROUP BY name UNION ALL SELECT DISTINCT 1, 0, predicate, 'predicate' FROM relations) SELECT token, kind, row_number() OVER (ORDER BY part, place, token) AS token_id FROM t", "qa_3_vocabulary")
def qa_3(spark: Spark, sf: str) -> DF:
    return Q.vocabulary(*graph(spark, sf))


@query("WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), m AS (SELECT max(n) AS most FROM n) SELECT label, most AS n FROM n, m", "qa_5_oversampled")
def qa_5(spark: Spark, sf: str) -> DF:
    return Q.oversampled(A.vectors(spark, sf).select("id", "label"), "label").groupBy("label").agg(F.count("*").alias("n"))


@query("WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n)::DOUBLE, 6) AS weight FROM n", "agg_19_class_weights")
def agg_19(spark: Spark, sf: str) -> DF:
    return Q.class_weights(A.vectors(spark, sf), "label")


@query("WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, least(n, 40) AS n FROM n", "con_5_balanced")
def con_5(spark: Spark, sf: str) -> DF:
    rows = A.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    return ST.balanced(rows, "lang", 40).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' END AS label FROM documents WHERE length(text) BETWEEN 5 AND 200 AND lang IN ('en', 'fr')", "con_4_labelled_texts")
def con_4(spark: Spark, sf: str) -> DF:
    rows = A.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))
    return ST.labelled_texts(rows, {"en": "english", "fr": "french"}).select("id", "label")
