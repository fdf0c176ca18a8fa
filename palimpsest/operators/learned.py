"""Learned parts: graph embeddings, attention over the memory graph, text classifiers.

Graphs are per user and small next to the table of users, so a user's graph is one
numpy group; texts are classified by Spark's own pipeline.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from palimpsest import lexicon as L
from palimpsest.functions import text as T
from palimpsest.functions import vector as V
from palimpsest.operators import memory as M
from palimpsest.operators import propagation as P
from palimpsest.shipping import ship
from palimpsest.sources.tables import checkpointed

DIM, MARGIN, RATE, EPOCHS, CORRUPTED = 32, 1.0, 0.01, 200, 5
LEAST_TRIPLES, PER_RELATION, NEAR = 15, 3, 2.0


def numbered(values: DataFrame, column: str, blocks: int = 64) -> DataFrame:
    """The distinct values in order with ``n`` from 0.

    Values are range-partitioned and numbered inside their partition; only the sizes
    of the partitions meet in one task.
    """
    rows = values.select(column).distinct().repartitionByRange(blocks, column).withColumn("_b", F.spark_partition_id())
    rows = checkpointed(rows)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_b", "_first")
    place = F.row_number().over(Window.partitionBy("_b").orderBy(column)) - 1
    return rows.withColumn("_p", place).join(F.broadcast(first), "_b").select(column, (F.col("_first") + F.col("_p")).cast("int").alias("n"))


def index(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """s, p, o: dense numbers of the ends and predicates of explicit relations, by id and by the alphabet; user_id goes along."""
    rows = relations.where("NOT is_inferred")
    ids = entities.join(rows.select(F.explode(F.array("subject_id", "object_id")).alias("id")).distinct(), "id", "left_semi").select("id")
    e, p = numbered(ids, "id"), numbered(rows, "predicate", 1)
    return rows.join(e.select(F.col("id").alias("subject_id"), F.col("n").alias("s")), "subject_id").join(e.select(F.col("id").alias("object_id"), F.col("n").alias("o")), "object_id").join(p.select("predicate", F.col("n").alias("p")), "predicate").select(*_own(relations), "s", "p", "o")


def _own(rows: DataFrame) -> list[str]:
    """The key that keeps users apart, if the table has more than one."""
    return ["user_id"] if "user_id" in rows.columns else []


def corrupted(triples: DataFrame, entities: DataFrame, times: int = CORRUPTED) -> DataFrame:
    """s, p, o that are not told: one end replaced by another entity, chosen by a hash."""
    n = entities.count()
    drawn = triples.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("x", F.pmod(F.xxhash64("s", "p", "o", "k"), F.lit(max(1, n))))
    rows = drawn.select(F.when(F.col("k") % 2 == 0, F.col("x")).otherwise(F.col("s")).cast("long").alias("s"), "p", F.when(F.col("k") % 2 == 1, F.col("x")).otherwise(F.col("o")).cast("long").alias("o"))
    return rows.where("s <> o").join(triples.select("s", "p", "o"), ["s", "p", "o"], "left_anti").distinct()


def transe(s: np.ndarray, p: np.ndarray, o: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of entities (on the unit sphere) and predicates, by margin loss against corrupted triples and Adam."""
    r = np.random.default_rng(seed)
    e, q = r.normal(0, 0.5, (max(s.max(), o.max()) + 1, dim)), r.normal(0, 0.5, (p.max() + 1, dim))
    params = [e, q]
    one, two = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    for step in range(1, epochs + 1):
        swap = r.integers(0, len(e), (CORRUPTED, len(s)))
        head = r.random((CORRUPTED, len(s))) < 0.5
        ns, no = np.where(head, swap, s).ravel(), np.where(head, o, swap).ravel()
        ps, pp, po = (np.tile(x, CORRUPTED) for x in (s, p, o))
        d1, d2 = e[ps] + q[pp] - e[po], e[ns] + q[pp] - e[no]
        l1, l2 = np.linalg.norm(d1, axis=1) + 1e-9, np.linalg.norm(d2, axis=1) + 1e-9
        on = ((MARGIN + l1 - l2) > 0)[:, None] / len(ps)
        g1, g2 = on * d1 / l1[:, None], on * d2 / l2[:, None]
        grads = [np.zeros_like(e), np.zeros_like(q)]
        for g, a, b in ((g1, ps, po), (-g2, ns, no)):
            np.add.at(grads[0], a, g)
            np.add.at(grads[0], b, -g)
            np.add.at(grads[1], pp, g)
        for x, g, m, v in zip(params, grads, one, two, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        e /= np.linalg.norm(e, axis=1, keepdims=True)
    return e, q


def embedded(triples: DataFrame, epochs: int = EPOCHS, blocks: int = 64) -> DataFrame:
    """user_id, kind (entity or predicate), n, vector for each user's triples (user_id, s, p, o).

    Triples are few bytes and long work, so the number of tasks is not left to their size.
    """

    ship(triples.sparkSession)

    def train(part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in "spo"])
        s, p, o = (part[c].to_numpy().astype(np.int64) for c in "spo")
        names, codes = np.unique(np.concatenate([s, o]), return_inverse=True)
        kinds, pc = np.unique(p, return_inverse=True)
        e, q = transe(codes[: len(s)], pc, codes[len(s) :], epochs=epochs)
        rows = [("entity", int(n), v) for n, v in zip(names, e, strict=True)] + [("predicate", int(n), v) for n, v in zip(kinds, q, strict=True)]
        return pa.table({"user_id": [part["user_id"][0].as_py()] * len(rows), "kind": [r[0] for r in rows], "n": [r[1] for r in rows], "vector": pa.array([r[2].tolist() for r in rows], pa.list_(pa.float64()))})

    return triples.repartition(blocks, "user_id").groupBy("user_id").applyInArrow(train, "user_id string, kind string, n long, vector array<double>")


def distance(h: Column, r: Column, t: Column) -> Column:
    return V.norm(F.zip_with(F.zip_with(h, r, lambda a, b: a + b), t, lambda a, b: a - b))


def tails(heads: DataFrame, vectors: DataFrame, k: int = PER_RELATION) -> DataFrame:
    """s, p, o, distance, rank: the nearest ends for pairs (s, p); ``vectors``: kind, n, vector.

    With a user_id in ``heads`` and ``vectors`` the ends are those of the same user.
    """
    own = _own(heads)
    e = vectors.where("kind = 'entity'")
    rows = heads.join(e.select(*own, F.col("n").alias("s"), F.col("vector").alias("vs")), [*own, "s"]).join(vectors.where("kind = 'predicate'").select(*own, F.col("n").alias("p"), F.col("vector").alias("vp")), [*own, "p"])
    rows = rows.join(e.select(*own, F.col("n").alias("o"), F.col("vector").alias("vo")), own or None).where("s <> o").withColumn("distance", F.round(distance(F.col("vs"), F.col("vp"), F.col("vo")), 6))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*own, "s", "p").orderBy("distance", "o"))).where(F.col("rank") <= k).select(*own, "s", "p", "o", "distance", "rank")


def predicates_between(pairs: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """s, o, p, distance, rank: the predicates nearest to what leads from s to o, for pairs (s, o); predicates are few."""
    own = _own(pairs)
    e, q = vectors.where("kind = 'entity'"), vectors.where("kind = 'predicate'")
    rows = pairs.join(e.select(*own, F.col("n").alias("s"), F.col("vector").alias("vs")), [*own, "s"]).join(e.select(*own, F.col("n").alias("o"), F.col("vector").alias("vo")), [*own, "o"])
    rows = rows.join(q.select(*own, F.col("n").alias("p"), F.col("vector").alias("vp")), own or None).withColumn("distance", F.round(distance(F.col("vs"), F.col("vp"), F.col("vo")), 6))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*own, "s", "o").orderBy("distance", "p"))).where(F.col("rank") <= k).select(*own, "s", "o", "p", "distance", "rank")


def predicted(triples: DataFrame, vectors: DataFrame, accept: str = "near", k: int = PER_RELATION) -> DataFrame:
    """s, p, o, confidence of new links; ``accept`` near takes those within the limit, far those beyond it.

    Graphs with few triples give none.  With a user_id each user is a graph.
    """
    own = _own(triples)
    near = F.col("distance") <= NEAR if accept == "near" else F.col("distance") > NEAR
    enough = triples.groupBy(*own).agg((F.count("*") >= LEAST_TRIPLES).alias("_ok")).where("_ok")
    rows = tails(triples.select(*own, "s", "p").distinct(), vectors, k).where(near).join(triples, [*own, "s", "p", "o"], "left_anti")
    d = F.col("distance") / 3.0
    confidence = F.least(F.lit(0.65), F.greatest(F.lit(0.3), 1.0 - d if accept == "near" else d))
    rows = rows.join(enough, own) if own else rows.join(F.broadcast(enough))
    return rows.select(*own, "s", "p", "o", F.round(confidence, 6).alias("confidence"))


def learned_links(triples: DataFrame, k: int = PER_RELATION, block_rows: int = 1 << 14) -> DataFrame:
    """user_id, s, p, o, confidence: ``predicted`` of ``embedded`` for triples (user_id, s, p, o), without a table of vectors.

    Users are dealt into blocks of about so many triples; each user is trained and
    searched where its triples are.
    """
    ship(triples.sparkSession)
    rows = triples.where("user_id IS NOT NULL").select(F.col("user_id").cast("string").alias("user_id"), *[F.col(c).cast("long").alias(c) for c in "spo"])
    blocks = max(1, -(-rows.count() // block_rows))
    return rows.groupBy(F.pmod(F.xxhash64("user_id"), F.lit(blocks))).applyInArrow(lambda part: _links_of(part, k), "user_id string, s long, p long, o long, confidence double")


def _links_of(part: pa.Table, k: int = PER_RELATION) -> pa.Table:
    """The links of a block of users; graphs that differ in their numbers only are trained once, as training starts from one seed."""
    part = part.sort_by([(c, "ascending") for c in ("user_id", "s", "p", "o")])
    users = part["user_id"].combine_chunks().dictionary_encode()
    users = users.chunk(0) if isinstance(users, pa.ChunkedArray) else users
    codes = users.indices.to_numpy()
    s, p, o = (part[c].to_numpy() for c in "spo")
    ends = [0, *(np.flatnonzero(np.diff(codes)) + 1), len(codes)]
    known: dict[tuple, tuple] = {}
    out: list[list] = [[], [], [], [], []]
    for a, b in zip(ends, ends[1:]):
        if b - a < LEAST_TRIPLES:
            continue
        names, own = np.unique(np.concatenate([s[a:b], o[a:b]]), return_inverse=True)
        kinds, pc = np.unique(p[a:b], return_inverse=True)
        key = own.tobytes(), pc.tobytes()
        if key not in known:
            if len(known) >= 4096:
                known.clear()
            known[key] = _near_links(own[: b - a], pc, own[b - a :], k)
        links = known[key]
        if len(links[0]):
            for x, values in zip(out, (np.full(len(links[0]), codes[a]), names[links[0]], kinds[links[1]], names[links[2]], links[3]), strict=True):
                x.append(values)
    none = np.zeros(0, np.int64)
    u, *rest = (np.concatenate(x) if x else none for x in out)
    return pa.table({"user_id": users.dictionary.take(pa.array(u)), **{c: pa.array(x, pa.int64()) for c, x in zip("spo", rest)}, "confidence": pa.array(rest[3], pa.float64())})


def _near_links(s: np.ndarray, p: np.ndarray, o: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """s, p, o, confidence: of each told pair (s, p) the nearest ends within the limit that are not told."""
    e, q = transe(s, p, o)
    told = set(zip(s.tolist(), p.tolist(), o.tolist(), strict=True))
    found = []
    for x, y in sorted({t[:2] for t in told}):
        d = np.floor(np.sqrt(((e[x] + q[y] - e) ** 2).sum(1)) * 1e6 + 0.5) / 1e6
        d[x] = np.inf
        found += [(x, y, z, round(min(0.65, max(0.3, 1 - d[z] / 3)), 6)) for z in np.argsort(d, kind="stable")[:k].tolist() if d[z] <= NEAR and (x, y, z) not in told]
    one, two, three, sure = zip(*found, strict=True) if found else ((), (), (), ())
    return np.array(one, int), np.array(two, int), np.array(three, int), np.array(sure, float)


def typed(links: DataFrame, types: DataFrame, allowed: DataFrame) -> DataFrame:
    """Links (s, p, o) whose end has a type (n, entity_type) that the predicate allows (p, entity_type)."""
    return links.join(types.withColumnsRenamed({"n": "o"}), "o").join(allowed, ["p", "entity_type"], "left_semi").select(*links.columns)


def reciprocal_rank(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"))


def quality_label(content: Column, priority: Column) -> Column:
    """0 noise, 1 normal, 2 priority."""
    noise = M.is_noise(content) | M.is_meta(content)
    return F.when(noise, 0).when(priority, 2).otherwise(1)


def activation_label() -> Column:
    noise = M.is_noise(F.col("content")) | M.is_meta(F.col("content"))
    own = F.col("confidence") * 0.3 + 0.2 / (1.0 + F.col("session_count") * 0.1) + P.popularity(F.col("access_count")) * 0.2 + F.when(F.col("is_priority"), 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), F.when(F.col("is_suppressed"), 0.02).when(noise, 0.05).otherwise(own))


def merge_labels(memories: DataFrame, band: int = 50, same: float = 0.92) -> DataFrame:
    """a, b, label: pairs of memories near each other in order that are (1) or are not (0) the same.

    Only rows less than ``band`` apart are compared: a join on blocks of that width
    and their neighbours, not on all pairs.
    """
    rows = memories.where("embedding IS NOT NULL").select("id", "embedding", "seq").withColumn("block", F.floor(F.col("seq") / band))
    left = rows.select(F.col("id").alias("a"), F.col("embedding").alias("va"), F.col("seq").alias("sa"), F.explode(F.array("block", F.col("block") + 1)).alias("block"))
    pairs = left.join(rows.select(F.col("id").alias("b"), F.col("embedding").alias("vb"), F.col("seq").alias("sb"), "block"), "block").where(f"sb > sa AND sb - sa < {band}")
    sim = F.round(V.cosine(F.col("va"), F.col("vb")), 6)
    told = pairs.select("a", "b", sim.alias("sim")).where(f"sim > {same} OR (sim > 0.3 AND sim < 0.7)").distinct()
    return told.select("a", "b", (F.col("sim") > same).cast("int").alias("label"))


def attention(memories: DataFrame, threshold: float = P.NEIGHBOUR, k: int = P.NEIGHBOURS) -> DataFrame:
    """src, dst, attention: a softmax of the similarities over each memory's neighbours and itself."""
    links = P.nearest(memories, threshold, k)
    own = memories.where("embedding IS NOT NULL").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    rows = links.unionByName(own).withColumn("_e", F.exp("w"))
    return rows.select("src", "dst", F.round(F.col("_e") / F.sum("_e").over(Window.partitionBy("src")), 6).alias("attention"))


def attended(memories: DataFrame, values: DataFrame, links: DataFrame) -> DataFrame:
    """id, value: the attention-weighted mean of the neighbours' values (id, value)."""
    return links.join(values.select(F.col("id").alias("dst"), "value"), "dst").groupBy(F.col("src").alias("id")).agg(F.round(F.sum(F.col("attention") * F.col("value")), 6).alias("value"))


def blended(activations: DataFrame, relevance: DataFrame) -> DataFrame:
    """id, activation: six tenths of the activation, four of the relevance to a query."""
    return activations.join(relevance, "id", "left").select("id", F.round(0.6 * F.col("activation") + 0.4 * F.coalesce("relevance", F.lit(0.0)), 6).alias("activation"))


def classifier(features: int = 1 << 12, iterations: int = 30, weights: str | None = None):
    """A text classifier (columns text, label): hashed words and multinomial logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer, StringIndexer

    model = LogisticRegression(featuresCol="unit", labelCol="target", maxIter=iterations, regParam=0.01)
    if weights:
        model = model.setWeightCol(weights)
    return Pipeline(stages=[RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"\W+"), HashingTF(inputCol="tokens", outputCol="counts", numFeatures=features), Normalizer(inputCol="counts", outputCol="unit"), StringIndexer(inputCol="label", outputCol="target", handleInvalid="skip"), model])


#: What a message is about, with the phrases that tell it, and how it is styled.
INTENTS = {"correction": L.CORRECTION, "enthusiasm": L.ENTHUSIASM, "personal_info": L.PERSONAL_INFO, "denial": L.DENIAL, "frustration": L.FRUSTRATION, "contradiction": L.CONTRADICTION}
STYLES = {"casual": L.CASUAL, "formal": L.FORMAL, "follow_up": L.FOLLOW_UP, "simple": L.SIMPLIFY, "detailed": L.DETAIL}
NEUTRAL = ["the weather is fine today", "what time is it", "we had lunch at noon", "the train leaves at nine", "open the window", "the river is high", "how far is the town", "it rained all night", "the book is on the table", "they play music"]


def bootstrap(spark: SparkSession, classes: dict[str, list[str]] | None = None) -> DataFrame:
    """text, label: a small training set out of the phrases of each class in a few frames, and neutral messages."""
    classes = INTENTS if classes is None else classes
    frames = ["{}", "well {}", "{} and so on", "hm, {} you know"]
    rows = [(f.format(p.strip()), label) for label, phrases in classes.items() for p in phrases for f in frames]
    return spark.createDataFrame([*rows, *((f.format(t), "neutral") for t in NEUTRAL for f in frames)], "text string, label string")


def intents(texts: DataFrame, training: DataFrame) -> DataFrame:
    """The columns of texts but the text, with intent and intent_confidence of a classifier fitted to (text, label)."""
    from pyspark.ml.functions import vector_to_array

    model = classifier().fit(training)
    words, counts, unit, labels, judge = model.stages
    names, rows = labels.labels, texts.fillna({"text": ""})
    for stage in (words, counts, unit, judge):
        rows = stage.transform(rows)
    sure = F.array_max(vector_to_array("probability"))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("prediction").cast("int") + 1)
    return rows.select(*[c for c in texts.columns if c != "text"], label.alias("intent"), F.round(sure, 6).alias("intent_confidence"))


def class_counts(training: DataFrame) -> DataFrame:
    return training.groupBy("label").agg(F.count("*").alias("n"))


def term_vectors(texts: DataFrame, size: int = 512) -> DataFrame:
    """id, embedding: hashed term frequencies at unit length, the vectors of an engine without a model."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    rows = RegexTokenizer(inputCol="text", outputCol="_t", pattern=r"\W+").transform(texts.fillna({"text": ""}))
    rows = Normalizer(inputCol="_c", outputCol="_u").transform(HashingTF(inputCol="_t", outputCol="_c", numFeatures=size).transform(rows))
    return rows.select("id", vector_to_array("_u", "float32").alias("embedding"))


def embedded_once(texts: DataFrame, embed) -> DataFrame:
    """text, embedding: each distinct text goes to the callable once."""
    ship(texts.sparkSession)

    @F.pandas_udf("array<float>")
    def call(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else [float(x) for x in embed(t)])

    return texts.join(texts.select("text").distinct().withColumn("embedding", call("text")), "text", "left")


def token_vectors(texts: DataFrame, embed) -> DataFrame:
    """id, pos, token, embedding of every word of texts (id, text); each distinct word goes to the callable once."""
    tokens = texts.select("id", F.posexplode(T.words(F.col("text"))).alias("pos", "text"))
    return tokens.join(embedded_once(tokens.select("text").distinct(), embed), "text").select("id", "pos", F.col("text").alias("token"), "embedding")


def pooled(tokens: DataFrame) -> DataFrame:
    """id, embedding: the mean of the vectors (id, pos, vector, mask) of tokens that count."""
    rows = tokens.where("mask").select("id", F.posexplode(V.as_double(F.col("vector"))).alias("d", "x"))
    return rows.groupBy("id", "d").agg(F.avg("x").alias("x")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: F.round(s["x"], 6)).alias("embedding"))


def spans_of_tags(tags: DataFrame) -> DataFrame:
    """text_id, start, words: runs that begin with B and go on with I, from (text_id, pos, token, tag)."""
    begins = F.sum((F.col("tag") == "B").cast("int")).over(Window.partitionBy("text_id").orderBy("pos"))
    outside = F.sum((F.col("tag") == "O").cast("int")).over(Window.partitionBy("text_id").orderBy("pos"))
    rows = tags.withColumns({"_b": begins, "_o": outside}).where("tag <> 'O'")
    runs = rows.groupBy("text_id", "_b", "_o").agg(F.min("pos").alias("start"), F.min_by("tag", "pos").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda t: t["token"]).alias("t"))
    return runs.where("first = 'B'").select("text_id", "start", F.array_join("t", " ").alias("words"))


def templated(templates: DataFrame, words: DataFrame) -> DataFrame:
    """text, label: every template with every word of its slot; both tables are word lists."""
    return templates.join(words, "slot").select(F.replace("template", F.lit("{}"), F.col("word")).alias("text"), "label")


# attention over a user's graph, in numpy

LAYERS, HEADS, WIDTH = 3, 4, 128


def gat_new(inputs: int, layers: int = LAYERS, heads: int = HEADS, width: int = WIDTH, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters of a graph attention network: a projection, its layers, and three ends (activation, quality, relevance)."""
    r = np.random.default_rng(seed)
    p = {"in": r.normal(0, (2 / (inputs + width)) ** 0.5, (inputs, width))}
    for k in range(layers):
        p |= {f"w{k}": r.normal(0, (1 / width) ** 0.5, (heads, width, width // heads)), f"s{k}": r.normal(0, 0.2, (heads, width // heads)), f"t{k}": r.normal(0, 0.2, (heads, width // heads)), f"g{k}": np.ones(width), f"b{k}": np.zeros(width)}
    return p | {"activation": r.normal(0, 0.1, width), "quality": r.normal(0, 0.1, (width, 3)), "relevance": r.normal(0, 0.1, width)}


def _gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh((2 / np.pi) ** 0.5 * (x + 0.044715 * x**3)))


def gat_forward(p: dict[str, np.ndarray], x: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """States of a graph's nodes: in each layer a node attends to its neighbours (edges src to dst) and itself, head by head.

    Attention is a softmax of leaky sums over the edges that end in a node; the heads side by
    side go through GELU, are added to what was there, and normalised.
    """
    n = len(x)
    src, dst = np.concatenate([src, np.arange(n)]), np.concatenate([dst, np.arange(n)])
    h = x @ p["in"]
    for k in range(sum(name[0] == "w" for name in p)):
        w = np.einsum("nd,hde->nhe", h, p[f"w{k}"])
        e = (w * p[f"s{k}"]).sum(2)[src] + (w * p[f"t{k}"]).sum(2)[dst]
        e = np.where(e > 0, e, 0.2 * e)
        most = np.full((n, e.shape[1]), -np.inf)
        np.maximum.at(most, dst, e)
        e = np.exp(e - most[dst])
        total = np.zeros((n, e.shape[1]))
        np.add.at(total, dst, e)
        out = np.zeros_like(w)
        np.add.at(out, dst, (e / total[dst])[:, :, None] * w[src])
        h = h + _gelu(out.reshape(n, -1))
        h = (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + 1e-5) * p[f"g{k}"] + p[f"b{k}"]
    return h


def gat_heads(p: dict[str, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Activation (0 to 1), probabilities of the three qualities, and relevance (0 to 1) of nodes."""
    q = h @ p["quality"]
    q = np.exp(q - q.max(1, keepdims=True))
    return 1 / (1 + np.exp(-(h @ p["activation"]))), q / q.sum(1, keepdims=True), 1 / (1 + np.exp(-(h @ p["relevance"])))


def gat_train(p: dict[str, np.ndarray], h: np.ndarray, activation: np.ndarray, quality: np.ndarray, epochs: int = 200, rate: float = 0.1) -> dict[str, np.ndarray]:
    """Parameters with the ends for activation and quality fitted to labels by gradient descent over nodes' states; layers stay."""
    p = {k: v.copy() for k, v in p.items()}
    told = np.eye(3)[quality]
    for _ in range(epochs):
        a, q, _ = gat_heads(p, h)
        p["activation"] -= rate * h.T @ (a - activation) / max(1, len(h))
        p["quality"] -= rate * h.T @ (q - told) / max(1, len(h))
    return p


def graph_states(nodes: DataFrame, edges: DataFrame, p: dict[str, np.ndarray]) -> DataFrame:
    """user_id, id, activation, quality (0 to 2), relevance of each user's graph: nodes (user_id, id, vector), edges (user_id, src, dst).

    A user's graph is one group; edges whose ends are no nodes are left out.
    """
    spark = nodes.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(p)
    kind = dict(nodes.dtypes)["id"]
    schema = f"user_id string, id {kind}, activation double, quality int, relevance double"
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def run(own: pa.Table, links: pa.Table) -> pa.Table:
        if not len(own):
            return empty
        own = own.sort_by("id")
        ids = own["id"].to_pylist()
        at = {i: k for k, i in enumerate(ids)}
        pairs = [(at[s], at[d]) for s, d in zip(links["src"].to_pylist(), links["dst"].to_pylist(), strict=True) if s in at and d in at]
        src, dst = (np.array([x[k] for x in pairs], int) for k in (0, 1))
        x = np.array(own["vector"].to_pylist(), float).reshape(len(ids), -1)
        a, q, r = gat_heads(held.value, gat_forward(held.value, x, src, dst))
        return pa.table({"user_id": own["user_id"], "id": own["id"], "activation": np.round(a, 6), "quality": pa.array(q.argmax(1), pa.int32()), "relevance": np.round(r, 6)})

    return nodes.select("user_id", "id", "vector").groupBy("user_id").cogroup(edges.select("user_id", "src", "dst").groupBy("user_id")).applyInArrow(run, schema)


def attended_tokens(x: np.ndarray, mask: np.ndarray, q: np.ndarray, k: np.ndarray, v: np.ndarray, heads: int = 4) -> np.ndarray:
    """Self-attention over the tokens (texts, tokens, width) that count: the states that heads of a text encoder read."""
    n, t, d = x.shape
    a, b, c = ((x @ m).reshape(n, t, heads, -1).transpose(0, 2, 1, 3) for m in (q, k, v))
    e = a @ b.transpose(0, 1, 3, 2) / a.shape[3] ** 0.5
    e = np.where(mask[:, None, None, :], e, -1e9)
    e = np.exp(e - e.max(3, keepdims=True))
    e /= e.sum(3, keepdims=True)
    return x + (e @ c).transpose(0, 2, 1, 3).reshape(n, t, -1)


def tagged(states: np.ndarray, weights: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The tag of each token (0 outside, 1 begins, 2 goes on) by a linear end; what doesn't count is outside."""
    return np.where(mask, (states @ weights).argmax(2), 0)


def pair_scores(states: np.ndarray, mask: np.ndarray, one: np.ndarray, two: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Probabilities of relations between two spans of each text, from the means of the spans' and the text's states."""
    mean = lambda m: (states * m[:, :, None]).sum(1) / np.maximum(1, m.sum(1))[:, None]
    z = np.concatenate([mean(one), mean(two), mean(mask)], 1) @ weights
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)
