"""Queries: branch scores, object scores, ranks, review tables, learning rows, validation figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import scalars
from orrery.operators import review, scoring
from orrery.plans.statistics import read

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_U = "(o_orderkey * {0} % 101) / 100.0"
_VALUES = {"moisture": 7, "vegetation": 13, "brightness": 17, "thermal": 19, "sar": 23, "morphology": 29, "persistence": 31, "post_rain": 37, "geology": 41, "canopy_structure": 43, "canopy_moisture": 47, "dem": 53, "cluster_adjacency": 59, "object_integrity": 61, "cropland_signal": 67, "forest_signal": 71}


def evidence(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    value = {n: (F.col("o_orderkey") * k % 101) / 100.0 for n, k in _VALUES.items()}
    branch = F.element_at(F.array(*[F.lit(b) for b in ("cropland", "forest", "mixed", "unknown")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return rows.select("o_orderkey", branch.alias("branch"), ((F.col("o_custkey") % 5) / 20.0).alias("penalty"), *[c.alias(n) for n, c in value.items()])


_EVIDENCE = "e AS (SELECT o_orderkey, ['cropland', 'forest', 'mixed', 'unknown'][o_orderkey % 4 + 1] AS branch, (o_custkey % 5)::DOUBLE / 20::DOUBLE AS penalty, " + ", ".join(f"(o_orderkey * {k} % 101)::DOUBLE / 100::DOUBLE AS {n}" for n, k in _VALUES.items()) + " FROM orders)"


def _weighted(weights):
    return "least(1.0, greatest(0.0, " + " + ".join(f"{w}::DOUBLE * {n}" for n, w in weights.items()) + " - penalty))"


@query(f"WITH {_EVIDENCE} SELECT o_orderkey, round({_weighted(scoring.CROPLAND)}, 9) AS score FROM e")
def cropland_score(spark, sf_dir):
    rows = evidence(spark, sf_dir)
    return rows.select("o_orderkey", F.round(scoring.cropland_score({n: F.col(n) for n in _VALUES}, F.col("penalty")), 9).alias("score"))


@query(f"WITH {_EVIDENCE} SELECT o_orderkey, round({_weighted(scoring.FOREST)}, 9) AS score FROM e")
def forest_score(spark, sf_dir):
    rows = evidence(spark, sf_dir)
    return rows.select("o_orderkey", F.round(scoring.forest_score({n: F.col(n) for n in _VALUES}, F.col("penalty")), 9).alias("score"))


@query(f"WITH {_EVIDENCE} SELECT o_orderkey, round({_weighted(scoring.MIXED)}, 9) AS score FROM e")
def mixed_score(spark, sf_dir):
    rows = evidence(spark, sf_dir)
    return rows.select("o_orderkey", F.round(scoring.mixed_score({n: F.col(n) for n in _VALUES}, F.col("penalty")), 9).alias("score"))


@query(
    f"WITH {_EVIDENCE}, s AS (SELECT o_orderkey, branch, CASE branch WHEN 'cropland' THEN {_weighted(scoring.CROPLAND)} WHEN 'forest' THEN {_weighted(scoring.FOREST)} WHEN 'mixed' THEN {_weighted(scoring.MIXED)} ELSE {_weighted(scoring.UNKNOWN)} END AS s FROM e) "
    "SELECT o_orderkey, branch, round(s, 9) AS score, CASE WHEN round(s, 9) >= 0.75 THEN 'A' WHEN round(s, 9) >= 0.55 THEN 'B' WHEN round(s, 9) >= 0.35 THEN 'C' ELSE 'D' END AS class FROM s"
)
def branch_dispatch_score(spark, sf_dir):
    rows = evidence(spark, sf_dir)
    score = F.round(scoring.branch_score(F.col("branch"), {n: F.col(n) for n in _VALUES}, F.col("penalty")), 9)
    return rows.select("o_orderkey", "branch", score.alias("score"), scoring.priority_class(score).alias("class"))


def candidates(spark, sf_dir):
    """Objects made from orders: every column by a rule of its key."""
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    names = F.array(*[F.lit(n) for n in ("NDMI", "NDVI", "BSI", "LST", "VV", "post_rain_drying_NDMI")])
    kinds = F.array(*[F.lit(n) for n in ("dynamic_only", "static_dynamic", "static_only", "")])
    flags = F.filter(F.array(F.when(k % 11 == 0, F.lit("too_large")), F.when(k % 7 == 0, F.lit("too_small")), F.when(k % 13 == 0, F.lit("elongated"))), lambda x: x.isNotNull())
    feature = F.slice(names, (k % 4 + 1).cast("int"), (k % 3 + 1).cast("int"))
    return rows.select(
        "o_orderkey", F.concat(F.lit("cand-"), F.lpad(k.cast("string"), 8, "0")).alias("candidate_id"), F.element_at(kinds, (k % 4 + 1).cast("int")).alias("evidence_class"),
        F.when(k % 5 < 3, "cropland").when(k % 5 == 3, "forest").otherwise("mixed").alias("landcover_branch"), F.when(k % 4 != 0, (k % 97) / 96.0).alias("static_score"),
        ((k % 89) / 88.0).alias("circularity"), (1 + (k % 53) / 10.0).alias("elongation"), F.map_from_arrays(feature, F.transform(feature, lambda n: ((k * F.length(n) % 61) / 15.0))).alias("per_feature_max"),
        ((k % 43) / 10.0).alias("max_anomaly"), (k % 4).cast("int").alias("repeated_seasons"), (F.col("o_custkey") % 4 / 10.0).alias("false_positive_penalty"),
        F.when(k % 9 == 0, F.array(F.lit("road_risk"))).otherwise(F.array().cast("array<string>")).alias("false_positive_flags"), feature.alias("source_feature_names"), flags.alias("dynamic_object_flags"), (k % 40).cast("int").alias("support_pixel_count"),
        F.when(k % 3 == 0, F.concat(F.lit("field-"), (k % 17).cast("string"))).otherwise("").alias("field_id"),
        F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.concat(F.lit(2020) + i, F.lit("-06-01"))).alias("anomalous_dates"),
    )


_CANDIDATES = """
c AS (SELECT o_orderkey AS k, o_custkey, 'cand-' || lpad(o_orderkey::VARCHAR, 8, '0') AS candidate_id, ['dynamic_only', 'static_dynamic', 'static_only', ''][o_orderkey % 4 + 1] AS ec,
  CASE WHEN o_orderkey % 5 < 3 THEN 'cropland' WHEN o_orderkey % 5 = 3 THEN 'forest' ELSE 'mixed' END AS branch, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 97)::DOUBLE / 96::DOUBLE ELSE 0.0::DOUBLE END AS st,
  (o_orderkey % 89)::DOUBLE / 88::DOUBLE AS circ, 1 + (o_orderkey % 53)::DOUBLE / 10::DOUBLE AS elong, (['NDMI', 'NDVI', 'BSI', 'LST', 'VV', 'post_rain_drying_NDMI'])[o_orderkey % 4 + 1 : o_orderkey % 4 + o_orderkey % 3 + 1] AS feats,
  o_orderkey % 4 AS seasons, (o_custkey % 4)::DOUBLE / 10::DOUBLE AS penalty, o_orderkey % 40 AS px FROM orders),
f AS (SELECT k, unnest(feats) AS n FROM c),
v AS (SELECT k, CASE n WHEN 'NDMI' THEN 'moisture' WHEN 'NDVI' THEN 'vegetation' WHEN 'BSI' THEN 'brightness' WHEN 'LST' THEN 'thermal' WHEN 'VV' THEN 'sar' ELSE 'post_rain' END AS comp, least(1.0::DOUBLE, (k * length(n) % 61)::DOUBLE / 15::DOUBLE / 3::DOUBLE) AS x FROM f),
w AS (SELECT k, max(x) AS top, coalesce(max(x) FILTER (comp = 'moisture'), 0) AS mo, coalesce(max(x) FILTER (comp = 'vegetation'), 0) AS ve, coalesce(max(x) FILTER (comp = 'brightness'), 0) AS br, coalesce(max(x) FILTER (comp = 'thermal'), 0) AS te,
  coalesce(max(x) FILTER (comp = 'sar'), 0) AS sa, coalesce(max(x) FILTER (comp = 'post_rain'), 0) AS po FROM v GROUP BY k),
m AS (SELECT c.*, w.* EXCLUDE k, CASE WHEN ec = '' THEN 'dynamic_only' ELSE ec END AS e2,
  CASE WHEN st > 0 THEN st ELSE least(1.0::DOUBLE, 0.7::DOUBLE * circ + 0.3::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (4 - elong) / 3))) END AS morph, least(1.0::DOUBLE, CASE WHEN seasons > 0 THEN seasons::DOUBLE ELSE (k % 3 + 1)::DOUBLE END / 2) AS pers FROM c JOIN w USING (k)),
d AS (SELECT *, CASE WHEN e2 = 'static_only' THEN 0.0 WHEN branch = 'cropland' THEN least(1.0::DOUBLE, 0.2::DOUBLE * mo + 0.15::DOUBLE * ve + 0.15::DOUBLE * br + 0.1::DOUBLE * te + 0.1::DOUBLE * sa + 0.1::DOUBLE * morph + 0.1::DOUBLE * pers + 0.05::DOUBLE * po) ELSE top END AS dyn FROM m),
b AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE e2 WHEN 'static_only' THEN least(st, 0.7::DOUBLE) WHEN 'static_dynamic' THEN 0.55::DOUBLE * dyn + 0.45::DOUBLE * st ELSE 0.85::DOUBLE * dyn + 0.15::DOUBLE * morph END - penalty)) AS raw,
  (k % 9 <> 0 AND len(feats) >= 3 AND seasons >= 2) AS strong FROM d),
p1 AS (SELECT *, CASE WHEN k % 11 = 0 THEN least(raw, 0.549999) ELSE raw END AS s1 FROM b),
p2 AS (SELECT *, CASE WHEN NOT strong AND (k % 7 = 0 OR k % 13 = 0) THEN least(s1, 0.349999) ELSE s1 END AS s2 FROM p1),
o AS (SELECT *, round(CASE WHEN NOT strong AND px > 0 AND px <= 12 THEN least(s2, 0.549999) ELSE s2 END, 9) AS score FROM p2)
"""


def scored(spark, sf_dir):
    out = scoring.score_objects(candidates(spark, sf_dir))
    return out.withColumn("object_score", F.round("object_score", 9)).withColumn("priority_class", scoring.priority_class(F.col("object_score")))


@query(
    f"WITH {_CANDIDATES} SELECT candidate_id, round(st, 9) AS static_score, round(dyn, 9) AS dynamic_score, score AS object_score, CASE WHEN score >= 0.75 THEN 'A' WHEN score >= 0.55 THEN 'B' WHEN score >= 0.35 THEN 'C' ELSE 'D' END AS priority_class, "
    "CASE WHEN e2 = 'static_dynamic' THEN branch || ' dynamic anomaly with static morphology' WHEN e2 = 'static_only' THEN 'static morphology' WHEN dyn > st THEN branch || ' dynamic anomaly' ELSE replace(e2, '_', ' ') END AS dominant_evidence, "
    "array_to_string(list_sort(list_filter([CASE WHEN e2 = 'static_only' THEN 'missing_dynamic_evidence' END, CASE branch WHEN 'forest' THEN 'missing_forest_branch_scoring' WHEN 'mixed' THEN 'missing_mixed_branch_scoring' END], lambda x: x IS NOT NULL)), '|') AS missing FROM o"
)
def object_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("candidate_id", F.round("static_score", 9).alias("static_score"), F.round("dynamic_score", 9).alias("dynamic_score"), "object_score", "priority_class", "dominant_evidence", F.array_join("missing_data_flags", "|").alias("missing"))


@query(f"WITH {_CANDIDATES} SELECT candidate_id, score AS object_score, row_number() OVER (ORDER BY score DESC, candidate_id)::INT AS rank FROM o")
def priority_rank(spark, sf_dir):
    return review.ranked(scored(spark, sf_dir).select("candidate_id", "object_score"))


@query(f"WITH {_CANDIDATES} SELECT candidate_id, score AS object_score, row_number() OVER (ORDER BY score DESC, candidate_id)::INT AS rank FROM o ORDER BY 3 LIMIT 30")
def top_review(spark, sf_dir):
    """The first 30 for review."""
    return review.ranked(scored(spark, sf_dir).select("candidate_id", "object_score"), top=30)


@query(
    f"WITH {_CANDIDATES}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, candidate_id)::INT AS rank FROM o) SELECT rank, candidate_id, CASE WHEN score >= 0.75 THEN 'A' WHEN score >= 0.55 THEN 'B' WHEN score >= 0.35 THEN 'C' ELSE 'D' END AS priority_class, score AS object_score, "
    "px::INT AS support_pixel_count, seasons::DOUBLE AS persistence, '[' || array_to_string(list_transform(list_sort(feats), lambda x: '\"' || x || '\"'), ',') || ']' AS source_feature_names, CASE WHEN rank <= 30 THEN 'passports/' || candidate_id || '.md' ELSE '' END AS passport_path, "
    "CASE WHEN list_contains(feats, 'NDMI') THEN round((k * 4 % 61)::DOUBLE / 15::DOUBLE, 6) END AS moisture_anomaly FROM r"
)
def score_table(spark, sf_dir):
    rows = review.score_rows(scored(spark, sf_dir), passports=30)
    return rows.select("rank", "candidate_id", "priority_class", "object_score", "support_pixel_count", "persistence", "source_feature_names", "passport_path", F.round("moisture_anomaly", 6).alias("moisture_anomaly"))


@query(f"WITH {_CANDIDATES}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, candidate_id) AS rank FROM o) SELECT candidate_id, rank::VARCHAR AS rank, ec AS evidence_class, px::VARCHAR AS support_pixel_count, '' AS expert_label, '' AS reviewer_notes FROM r")
def labeling_table(spark, sf_dir):
    return review.labeling_rows(review.score_rows(scored(spark, sf_dir))).select("candidate_id", "rank", "evidence_class", "support_pixel_count", "expert_label", "reviewer_notes")


@query(f"WITH {_CANDIDATES}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, candidate_id) AS rank FROM o) SELECT rank::VARCHAR AS rank, candidate_id, px::VARCHAR AS support_pixel_count, CASE WHEN k % 3 = 0 THEN 'field-' || k % 17 ELSE '' END AS field_id FROM r")
def object_feature_table(spark, sf_dir):
    return review.feature_rows(review.score_rows(scored(spark, sf_dir))).select("rank", "candidate_id", "support_pixel_count", "field_id")


@query(
    f"WITH {_CANDIDATES}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, candidate_id) AS rank, CASE WHEN e2 = 'static_dynamic' THEN branch || ' dynamic anomaly with static morphology' WHEN e2 = 'static_only' THEN 'static morphology' WHEN dyn > st THEN branch || ' dynamic anomaly' ELSE replace(e2, '_', ' ') END AS dom FROM o) "
    "SELECT candidate_id, array_to_string(list_filter([CASE WHEN penalty > 0 THEN 'false_positive_penalty=' || (o_custkey % 4 / 10.0)::VARCHAR END, CASE WHEN k % 9 = 0 THEN 'flags=road_risk' END], lambda x: x IS NOT NULL), '; ') AS false_positive_evidence, "
    "array_to_string(list_sort(list_filter([CASE WHEN e2 = 'static_only' THEN 'missing_dynamic_evidence' END, CASE branch WHEN 'forest' THEN 'missing_forest_branch_scoring' WHEN 'mixed' THEN 'missing_mixed_branch_scoring' END], lambda x: x IS NOT NULL)), '|') AS missing_context, dom AS dominant_evidence FROM r"
)
def rank_explanations(spark, sf_dir):
    got = review.explanations(review.score_rows(scored(spark, sf_dir)))
    return got.select("candidate_id", "false_positive_evidence", "missing_context", "dominant_evidence")


@query(f"WITH {_CANDIDATES} SELECT candidate_id, (2020 + unnest(range(k % 3 + 1)))::VARCHAR || '-06-01' AS date, score AS object_score FROM o")
def time_series_export(spark, sf_dir):
    return review.time_series(scored(spark, sf_dir)).select("candidate_id", "date", "object_score")


def _labels(spark, sf_dir):
    """Review labels from the documents' labels: two rows for some ids, the last one counts."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", "toxic")
    first = rows.select(F.col("doc_id").cast("string").alias("candidate_id"), F.lit(1).alias("ordinal"), F.lit("Uncertain").alias("expert_label"), F.lit("").alias("false_positive_reason"))
    label = F.when(F.col("toxic") == 1, "hard-negative").when(F.col("quality") == 1, " Positive ").otherwise("")
    second = rows.where("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("candidate_id"), F.lit(2).alias("ordinal"), label.alias("expert_label"), F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("false_positive_reason"))
    return first.unionByName(second)


def _ranked_documents(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("candidate_id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("field_id"), (F.col("n_chars") % 1000 / 1000.0).alias("object_score"))
    return review.ranked(rows)


_LABELLED = (
    "l AS (SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN 'uncertain' WHEN toxic = 1 THEN 'hard_negative' WHEN quality = 1 THEN 'positive' ELSE '' END AS label FROM documents d JOIN labels USING (doc_id)), "
    "r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars % 1000 / 1000.0 DESC, doc_id::VARCHAR) AS rank, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS field_id FROM documents)"
)


@query(
    f"WITH {_LABELLED} SELECT r.doc_id::VARCHAR AS candidate_id, CASE WHEN coalesce(label, '') = '' THEN 'unlabeled' ELSE label END AS model_label, "
    "CASE coalesce(label, '') WHEN '' THEN 'unlabeled_pool' WHEN 'positive' THEN 'positive_seed' WHEN 'hard_negative' THEN 'hard_negative_control' ELSE 'exclude' END AS pu_role, CASE WHEN label = 'uncertain' THEN 'no' ELSE 'yes' END AS use_for_training, "
    "CASE WHEN field_id <> '' THEN 'field:' || field_id ELSE 'object:' || r.doc_id END AS split_group, CASE WHEN coalesce(label, '') = '' THEN 'detector_export' ELSE 'expert' END AS label_source FROM r LEFT JOIN l ON r.doc_id = l.doc_id"
)
def learning_dataset(spark, sf_dir):
    got = review.learning_rows(_ranked_documents(spark, sf_dir), _labels(spark, sf_dir))
    return got.select("candidate_id", "model_label", "pu_role", "use_for_training", "split_group", "label_source")


@query(
    f"WITH {_LABELLED}, t AS (SELECT r.doc_id, label FROM r LEFT JOIN l ON r.doc_id = l.doc_id WHERE rank <= 100) SELECT 100 AS top_n, round(count(*) FILTER (label = 'positive')::DOUBLE / (count(*) FILTER (label IN ('positive', 'hard_negative'))), 6) AS precision, "
    "count(*) FILTER (label = 'positive') AS positive_count, count(*) FILTER (label = 'hard_negative') AS negative_count FROM t"
)
def precision_at_n(spark, sf_dir):
    """Among the first 100."""
    return review.precision_at(_ranked_documents(spark, sf_dir), _labels(spark, sf_dir), 100).withColumn("precision", F.round("precision", 6))


@query(f"WITH {_CANDIDATES} SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN k % 11 = 0 THEN 'too_large' END, CASE WHEN k % 7 = 0 THEN 'too_small' END, CASE WHEN k % 13 = 0 THEN 'elongated' END], lambda x: x IS NOT NULL)) AS flag FROM o) GROUP BY flag")
def flag_histogram(spark, sf_dir):
    return review.flag_histogram(candidates(spark, sf_dir), "dynamic_object_flags")


@query(f"WITH {_CANDIDATES} SELECT round(avg(len(feats)), 6) AS mean_source_feature_count, max(len(feats))::INT AS max_source_feature_count, count(*) FILTER (len(feats) >= 2) AS candidates_with_2plus, round((count(*) FILTER (len(feats) >= 2))::DOUBLE / count(*), 6) AS share_with_2plus FROM c")
def multi_sensor_agreement(spark, sf_dir):
    got = review.agreement(candidates(spark, sf_dir), "source_feature_names")
    return got.select(F.round("mean_source_feature_count", 6).alias("mean_source_feature_count"), "max_source_feature_count", "candidates_with_2plus", F.round("share_with_2plus", 6).alias("share_with_2plus"))


@query("SELECT round(avg(v), 6) AS mean_repeated_seasons, max(v) AS max_repeated_seasons, count(*) FILTER (v >= 2) AS persistent_candidates FROM (SELECT CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 4)::DOUBLE END AS v FROM orders)")
def persistence_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 6 == 0, "n/a").otherwise((F.col("o_orderkey") % 4).cast("string")).alias("persistence"))
    return review.persistence(rows, "persistence").withColumn("mean_repeated_seasons", F.round("mean_repeated_seasons", 6))


@query(f"WITH {_CANDIDATES} SELECT count(*) FILTER (e2 = 'static_only' OR branch IN ('forest', 'mixed')) AS affected_candidates FROM o")
def missing_data_summary(spark, sf_dir):
    return review.missing_data(scored(spark, sf_dir), "missing_data_flags")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def anti_joins(spark, sf_dir):
    """Unmatched rows: orders without a large line."""
    large = read(spark, sf_dir, "lineitem").where("l_quantity > 30").select("l_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey").join(large, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("SELECT p_partkey, regexp_replace(lower(regexp_replace(p_name || ' / ' || p_brand, '[^A-Za-z0-9._-]+', '_', 'g')), '^[._-]+|[._-]+$', '', 'g') AS safe, CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE rtrim(printf('%.6f', p_retailprice), '0') END AS price FROM part")
def text_rules(spark, sf_dir):
    """Safe id parts and plain numbers."""
    rows = read(spark, sf_dir, "part")
    return rows.select("p_partkey", scalars.safe_part(F.concat("p_name", F.lit(" / "), "p_brand")).alias("safe"), scalars.plain_number(F.col("p_retailprice")).alias("price"))


@query(
    "SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN 'post_rain' WHEN 1 THEN 'moisture' WHEN 2 THEN 'vegetation' WHEN 3 THEN 'vegetation' WHEN 4 THEN 'brightness' WHEN 5 THEN 'thermal' WHEN 6 THEN 'sar' WHEN 7 THEN 'geology' END AS component FROM part"
)
def feature_components(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in ("post_rain_drying_NDMI", "ndmi_2024", "NDVI", "red-edge", "Bare_Soil", "LST", "VV_VH_ratio", "geology_fault", "slope")])
    rows = read(spark, sf_dir, "part").select("p_partkey", F.element_at(names, (F.col("p_size") % 9 + 1).cast("int")).alias("name"))
    return rows.select("p_partkey", scalars.feature_component(F.col("name")).alias("component"))
