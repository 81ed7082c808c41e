"""Vectors, seeds and story clustering."""

from pyspark.sql import functions as F

from storyloom.functions.vectors import cosine_similarity
from storyloom.operators import cluster, summarize
from storyloom.operators.matching import vector_frame
from storyloom.plans import derived as d
from storyloom.plans.registry import query

A = "TIMESTAMP '2025-07-15 14:30:00'"
T = d.VECTOR_THRESHOLD
BLOCK = 64  # vectors of a block where the path for large tables is forced


@query(
    "pending_embedding",
    f"""SELECT id, summary FROM articles WHERE publish_date >= {A} - INTERVAL 35 DAY AND summary_embedding IS NULL
        AND summary IS NOT NULL AND summary <> 'summary unavailable'""",
)
def _(spark, sf):
    rows = cluster.pending_embedding(d.articles(spark, sf, vectors=True), d.ARTICLE_NOW, batch=None)
    return rows.select("id", "summary")


@query(
    "embed_batch",
    f"""SELECT id, publish_date FROM articles WHERE publish_date >= {A} - INTERVAL 35 DAY
        AND summary_embedding IS NULL AND summary IS NOT NULL AND summary <> 'summary unavailable'
        ORDER BY publish_date DESC NULLS FIRST, id LIMIT 200""",
)
def _(spark, sf):
    rows = cluster.pending_embedding(d.articles(spark, sf, vectors=True), d.ARTICLE_NOW, batch=cluster.EMBED_BATCH_SIZE)
    return rows.select("id", "publish_date")


@query(
    "embed_pending",
    f"""SELECT id, slot, weight FROM (SELECT id, h % 64 AS slot,
          sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS weight
        FROM (SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM (SELECT id,
            unnest(list_filter(regexp_split_to_array(lower(summary), '\\s+'), lambda x: x <> '')) AS w FROM articles
          WHERE publish_date >= {A} - INTERVAL 35 DAY AND summary_embedding IS NULL AND summary IS NOT NULL
            AND summary <> 'summary unavailable')) GROUP BY 1, 2) WHERE weight <> 0""",
)
def _(spark, sf):
    pending = cluster.pending_embedding(d.articles(spark, sf, vectors=True), d.ARTICLE_NOW, batch=None)
    vectors = summarize.embed_rows(pending).select("id", F.posexplode("summary_embedding").alias("slot", "weight"))
    return vectors.filter("weight <> 0").select(
        "id", F.col("slot").cast("long").alias("slot"), F.col("weight").cast("double").alias("weight")
    )


@query(
    "unclustered",
    f"""SELECT id, publish_date FROM articles WHERE publish_date >= {A} - INTERVAL 35 DAY
        AND story_cluster_id IS NULL AND summary_embedding IS NOT NULL""",
)
def _(spark, sf):
    rows = cluster.unclustered(d.articles(spark, sf, vectors=True), d.ARTICLE_NOW)
    return rows.select("id", "publish_date")


@query(
    "seeds",
    f"""SELECT id, publish_date FROM articles WHERE publish_date >= {A} - INTERVAL 35 DAY
        AND story_cluster_id = id""",
)
def _(spark, sf):
    return cluster.seeds(d.articles(spark, sf), d.ARTICLE_NOW).select("id", "publish_date")


FIRST_OF_LABEL = "SELECT min(vec_id) AS seed_id FROM embeddings GROUP BY label"


@query(
    "cosine_similarity",
    f"""SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], s.embedding::DOUBLE[]), 9) AS similarity
        FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) s
        USING (label)""",
)
def _(spark, sf):
    emb = d.base(spark, sf, "embeddings")
    firsts = emb.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    sim = cosine_similarity(F.col("embedding"), F.col("first"))
    return emb.join(firsts, "label").select("vec_id", F.round(sim, 9).alias("similarity"))


def _known(spark, sf):
    """The first vector of each label, as seeds of earlier runs."""
    emb = d.base(spark, sf, "embeddings")
    firsts = emb.groupBy("label").agg(F.min("vec_id").alias("vec_id"), F.min_by("embedding", "vec_id").alias("embedding"))
    return vector_frame(firsts, "vec_id", "embedding")


def _vectors(spark, sf):
    return vector_frame(d.base(spark, sf, "embeddings"), "vec_id", "embedding", F.col("vec_id"))


SEED_MATCH_SQL = f"""SELECT e.vec_id, arg_max(s.vec_id, (sim, -s.vec_id)) AS seed_id,
    round(max(sim), 9) AS similarity FROM
    (SELECT e.vec_id, s.vec_id AS sid, list_cosine_similarity(e.embedding::DOUBLE[], s.embedding::DOUBLE[]) AS sim
     FROM embeddings e, embeddings s WHERE s.vec_id IN ({FIRST_OF_LABEL})) e JOIN embeddings s ON s.vec_id = e.sid
    WHERE sim >= {T} GROUP BY 1"""


@query("seed_match", SEED_MATCH_SQL)
def _(spark, sf):
    found = cluster.assign_to_seeds(_vectors(spark, sf), _known(spark, sf), T)
    return found.select(F.col("id").alias("vec_id"), "seed_id", F.round("similarity", 9).alias("similarity"))


@query("seed_match_blocked", SEED_MATCH_SQL)
def _(spark, sf):
    found = cluster.assign_to_seeds(_vectors(spark, sf), _known(spark, sf), T, block_rows=BLOCK)
    return found.select(F.col("id").alias("vec_id"), "seed_id", F.round("similarity", 9).alias("similarity"))


@query(
    "best_seed",
    f"SELECT seed_id, count(*) AS won, max(similarity) AS nearest FROM ({SEED_MATCH_SQL}) GROUP BY 1",
)
def _(spark, sf):
    found = cluster.assign_to_seeds(_vectors(spark, sf), _known(spark, sf), T)
    return found.groupBy("seed_id").agg(
        F.count(F.lit(1)).alias("won"), F.round(F.max("similarity"), 9).alias("nearest")
    )


@query(
    "assign_to_seeds",
    f"""SELECT vec_id, seed_id FROM embeddings LEFT JOIN ({SEED_MATCH_SQL}) USING (vec_id)""",
)
def _(spark, sf):
    vectors = _vectors(spark, sf)
    found = cluster.assign_to_seeds(vectors, _known(spark, sf), T)
    return vectors.select("id").join(found, "id", "left").select(F.col("id").alias("vec_id"), "seed_id")


def leader_sql(source: str) -> str:
    """Sequential leader clustering of ``source`` (rn = place in the order, id, v)."""
    return f"""WITH RECURSIVE e AS MATERIALIZED ({source}),
        edges AS MATERIALIZED (SELECT a.rn AS arn, b.rn AS brn, list_cosine_similarity(a.v, b.v) AS sim
          FROM e a JOIN e b ON a.rn > b.rn WHERE list_cosine_similarity(a.v, b.v) >= {T}),
        nb AS MATERIALIZED (SELECT e.rn, coalesce(list(brn) FILTER (WHERE brn IS NOT NULL), []) AS nbr
          FROM e LEFT JOIN edges ON e.rn = arn GROUP BY e.rn),
        w(rn, seeds) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
          SELECT nb.rn, CASE WHEN list_has_any(w.seeds, nb.nbr) THEN w.seeds ELSE list_append(w.seeds, nb.rn) END
          FROM w JOIN nb ON nb.rn = w.rn + 1),
        fin AS (SELECT unnest(seeds) AS srn FROM w WHERE rn = (SELECT max(rn) FROM w)),
        best AS (SELECT arn, max(sim) AS top FROM edges JOIN fin ON brn = srn
          WHERE arn NOT IN (SELECT srn FROM fin) GROUP BY arn),
        pick AS (SELECT arn, min(s.id) AS seed FROM best JOIN edges USING (arn) JOIN fin ON brn = srn
          JOIN e s ON s.rn = brn WHERE sim = top GROUP BY arn)
        SELECT e.id, coalesce(seed, e.id) AS story_cluster_id FROM e LEFT JOIN pick ON pick.arn = e.rn"""


LEADER_SQL = leader_sql(
    "SELECT row_number() OVER (ORDER BY vec_id) AS rn, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings"
)


@query("leader_cluster", LEADER_SQL)
def _(spark, sf):
    return cluster.leader_cluster(_vectors(spark, sf), T)


@query("leader_cluster_blocked", LEADER_SQL)
def _(spark, sf):
    # Small blocks: vectors meet in cells and shells, as they do on tables too large to ship.
    return cluster.leader_cluster(_vectors(spark, sf), T, block_rows=BLOCK)


def _cycle_articles(spark, sf):
    """Clusters are synthetic in ``articles``: keep the seeds among them, leave the rest to be clustered."""
    arts = d.articles(spark, sf, vectors=True).filter(F.col("summary_embedding").isNotNull())
    return arts.withColumn(
        "story_cluster_id", F.when(F.col("story_cluster_id") == F.col("id"), F.col("story_cluster_id"))
    )


CYCLE_SQL = f"""WITH RECURSIVE c AS MATERIALIZED (SELECT id, publish_date, story_cluster_id = id AS known,
    summary_embedding::DOUBLE[] AS v FROM articles WHERE summary_embedding IS NOT NULL
      AND publish_date >= {A} - INTERVAL 400 DAY), """ + leader_sql(
    "SELECT row_number() OVER (ORDER BY coalesce(known, false) DESC, publish_date, id) AS rn, id, v, "
    "coalesce(known, false) AS known FROM c"
).removeprefix("WITH RECURSIVE ").replace(
    # A stored seed stays one whatever lies near it.
    "CASE WHEN list_has_any(w.seeds, nb.nbr) THEN",
    "CASE WHEN list_has_any(w.seeds, nb.nbr) AND nb.rn NOT IN (SELECT rn FROM e WHERE known) THEN",
) + " WHERE NOT known"


@query("cluster_cycle", CYCLE_SQL)
def _(spark, sf):
    # The long window takes in most dated vectors, so that seeds and members both occur.
    return cluster.cluster_cycle(_cycle_articles(spark, sf), d.ARTICLE_NOW, window_days=400, threshold=T)
