"""The registered queries again, as ANSI SQL for an independent engine.

A forest has no SQL form. Where the result of one is stated here, the fixture makes it
provable: its label is a step function of one feature, so a forest of depth 2 or more
repeats the label, and one of depth 1 can only split above 35.
"""

from __future__ import annotations

KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber"

SEPARABLE = f"""
SELECT {KEY}, l_extendedprice, l_quantity, l_discount, l_tax,
       CASE WHEN l_quantity <= 10 THEN 3 WHEN l_quantity <= 35 THEN 5 ELSE 7 END AS quality
FROM lineitem
"""

RULE = """
SELECT CAST(l_linenumber AS INTEGER) AS label,
       CAST((l_orderkey + l_suppkey) % 7 + 1 AS INTEGER) AS prediction
FROM lineitem
"""


def bucket(salt: str, key: str, k: int = 5) -> str:
    digits = f"substr(md5(concat_ws('-', '{salt}', {key})), 1, 8)"
    return f"CAST(CAST('0x' || {digits} AS BIGINT) % {k} AS INTEGER)"


def class_scores(source: str, group: str = "") -> str:
    """CTEs ``c`` (counts) and ``s`` (support, precision, recall, f1 per class present) for
    a query that yields label and prediction, within the group column if one is named."""
    g = f"{group}, " if group else ""
    same = f"p.{group} = l.{group} AND " if group else ""
    return f"""
c AS (SELECT {g}label, prediction, count(*) AS n FROM ({source}) GROUP BY ALL),
l AS (SELECT {g}label, sum(n) AS support, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS hits
      FROM c GROUP BY ALL),
p AS (SELECT {g}prediction, sum(n) AS claimed FROM c GROUP BY ALL),
r AS (SELECT l.*, coalesce(CAST(hits AS DOUBLE) / claimed, 0) AS prec, CAST(hits AS DOUBLE) / support AS rec
      FROM l LEFT JOIN p ON {same}p.prediction = l.label),
s AS (SELECT *, CASE WHEN prec + rec = 0 THEN 0 ELSE 2 * prec * rec / (prec + rec) END AS f1 FROM r)
"""


F1 = "sum(support * f1) / sum(support)"

# What a forest predicts on the fixture, by depth.
DEPTH_1 = "CASE WHEN l_quantity <= 35 THEN 5 ELSE 7 END"
BY_DEPTH = f"""
SELECT f.fold, d.max_depth, f.quality AS label,
       CASE WHEN d.max_depth = 1 THEN {DEPTH_1} ELSE f.quality END AS prediction
FROM (SELECT *, {bucket("inner", KEY)} AS fold FROM ({SEPARABLE})) f, (VALUES {{depths}}) d(max_depth)
"""


def by_fold_and_depth(depths: str) -> str:
    source = BY_DEPTH.format(depths=depths).replace("f.fold, d.max_depth", "f.fold * 100 + d.max_depth AS cell")
    scores = class_scores(source, "cell")
    return f"WITH {scores}, cells AS (SELECT cell // 100 AS fold, cell % 100 AS max_depth, {F1} AS f1 FROM s GROUP BY cell)"


GRID = f"""
{by_fold_and_depth("(1), (3)")},
m AS (SELECT max_depth, avg(f1) AS mean_f1, stddev_pop(f1) AS std_f1 FROM cells GROUP BY max_depth),
g AS (SELECT num_trees, CAST(max_depth AS INTEGER) AS max_depth, mean_f1, std_f1,
             row_number() OVER (ORDER BY round(mean_f1, 9) DESC, num_trees, max_depth) AS place
      FROM m, (VALUES (3), (5)) t(num_trees))
SELECT num_trees, max_depth, round(mean_f1, 6) AS mean_f1, round(std_f1, 6) AS std_f1, place = 1 AS is_best
FROM g"""

ORACLES: dict[str, str] = {
    "scan_delimited": """
        SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, p_brand, p_type,
               CAST(p_size AS INTEGER) AS p_size, p_retailprice
        FROM part""",
    "scan_with_schema": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "scan_column_orders": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
    "inferred_types": """
        SELECT count(*) AS n_rows,
               CASE WHEN max(o_orderkey) > 2147483647 THEN 'bigint' ELSE 'int' END AS o_orderkey,
               CASE WHEN max(o_custkey) > 2147483647 THEN 'bigint' ELSE 'int' END AS o_custkey, 'string' AS o_orderstatus,
               'double' AS o_totalprice, 'timestamp' AS o_orderdate, 'string' AS o_orderpriority
        FROM orders""",
    "staged_rows": """
        SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus,
               o_totalprice, o_orderdate, o_orderpriority
        FROM orders""",
    "rejected_rows": """
        WITH l AS (
          SELECT o_orderkey % 10 AS digit, CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS c, o_orderstatus AS s
          FROM orders)
        SELECT CASE digit WHEN 0 THEN concat_ws(';', k, c) WHEN 1 THEN concat_ws(';', k, c, s, 'more')
                          ELSE concat_ws(';', k, 'none', s) END AS line,
               CASE digit WHEN 0 THEN 'short' WHEN 1 THEN 'long' ELSE 'value' END AS reason,
               (SELECT count(*) FROM l WHERE digit > 2) AS n_rows, (SELECT count(*) FROM l WHERE digit < 3) AS n_rejected
        FROM l WHERE digit < 3""",
    "clean_columns": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
    "feature_columns": f"SELECT l_quantity, l_discount, l_tax, quality FROM ({SEPARABLE})",
    "assemble_vector": f"SELECT l_quantity AS f0, l_discount AS f1, l_tax AS f2, quality FROM ({SEPARABLE})",
    "label_distribution": """
        SELECT 'quality' AS source, quality AS label, count(*) AS n FROM labels GROUP BY quality
        UNION ALL
        SELECT 'cluster', label, count(*) FROM embeddings GROUP BY label""",
    "label_profile": f"""
        WITH v AS (
          SELECT 'good' AS candidate, CAST(quality AS DOUBLE) AS label FROM ({SEPARABLE})
          UNION ALL SELECT 'price', l_extendedprice - 50000 FROM lineitem
          UNION ALL SELECT 'gaps', CASE WHEN l_tax > 0 THEN l_quantity * 3 END FROM lineitem)
        SELECT candidate, count(*) AS n_rows,
               count(*) FILTER (label IS NULL) AS n_null,
               count(*) FILTER (label < 0 OR label >= 100) AS n_out_of_range,
               count(*) FILTER (label >= 0 AND label < 100 AND label <> floor(label)) AS n_fractional,
               max(label) AS highest
        FROM v GROUP BY candidate""",
    "fold_counts": f"""
        SELECT {bucket("outer", KEY)} AS fold, count(*) AS n FROM lineitem GROUP BY 1""",
    "fold_split_counts": f"""
        WITH f AS (SELECT {bucket("outer", KEY)} AS fold, quality FROM ({SEPARABLE})),
             k AS (SELECT CAST(range AS INTEGER) AS split FROM range(5))
        SELECT split, 'held_out' AS side, quality, count(*) AS n FROM f JOIN k ON fold = split GROUP BY ALL
        UNION ALL
        SELECT split, 'train', quality, count(*) FROM f JOIN k ON fold <> split GROUP BY ALL""",
    "confusion": f"SELECT label, prediction, count(*) AS n FROM ({RULE}) GROUP BY label, prediction",
    "per_class_scores": f"""
        WITH {class_scores(RULE)}
        SELECT label AS class, CAST(support AS BIGINT) AS support, round(prec, 6) AS precision,
               round(rec, 6) AS recall, round(f1, 6) AS f1
        FROM s""",
    "weighted_f1": f"WITH {class_scores(RULE)} SELECT round({F1}, 6) AS f1 FROM s",
    "accuracy": f"""
        SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({RULE})""",
    "forest_predict": f"SELECT {KEY}, quality AS prediction FROM ({SEPARABLE})",
    "forest_vote": f"""
        WITH c AS (
          SELECT l_quantity > 35 AS above_35, count(*) AS n, count(*) FILTER (quality = 3) AS n3,
                 count(*) FILTER (quality = 5) AS n5, count(*) FILTER (quality = 7) AS n7
          FROM ({SEPARABLE}) GROUP BY 1)
        SELECT above_35, n, round(n3 / n, 6) AS share_3, round(n5 / n, 6) AS share_5, round(n7 / n, 6) AS share_7,
               round(n3 / n, 6) AS highest_share_3, round(n5 / n, 6) AS highest_share_5,
               round(n7 / n, 6) AS highest_share_7, round(3 * n5 / n, 6) AS votes_5, 3.0::DOUBLE AS vote_total
        FROM c""",
    "grid_search": GRID,
    "nested_search": GRID,
    "resumed_search": f"SELECT *, 20 AS n_parts FROM ({GRID})",
    "fold_scores": f"""
        {by_fold_and_depth("(1), (2)")}
        SELECT CAST(fold AS INTEGER) AS fold, CAST(max_depth AS INTEGER) AS max_depth, round(f1, 6) AS f1 FROM cells""",
    "training_metrics": f"""
        {by_fold_and_depth("(1), (3)")},
        m AS (SELECT max_depth, avg(f1) AS mean_f1, stddev_pop(f1) AS std_f1 FROM cells GROUP BY max_depth),
        g AS (SELECT num_trees, max_depth, mean_f1, std_f1,
                     row_number() OVER (ORDER BY round(mean_f1, 9) DESC, num_trees, max_depth) AS place
              FROM m, (VALUES (3), (5)) t(num_trees))
        SELECT 'cross-validation' AS dataset, CAST(NULL AS INTEGER) AS fold, num_trees,
               CAST(max_depth AS INTEGER) AS max_depth, round(mean_f1, 6) AS f1, round(std_f1, 6) AS std_f1,
               place = 1 AS is_best, true AS one_stamp
        FROM g
        UNION ALL
        SELECT 'fold', CAST(fold AS INTEGER), num_trees, CAST(max_depth AS INTEGER), round(f1, 6), NULL, NULL, true
        FROM cells, (VALUES (3), (5)) t(num_trees)""",
    "holdout_metrics": f"""
        SELECT count(*) AS n_rows, 1.0::DOUBLE AS f1, 1.0::DOUBLE AS accuracy
        FROM lineitem WHERE {bucket("outer", KEY)} = 0""",
    "model_round_trip": """
        SELECT loaded_from, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_differ
        FROM lineitem, (VALUES ('bare forest'), ('whole model')) m(loaded_from) GROUP BY loaded_from""",
    "metrics_sink": f"""
        WITH {class_scores(RULE)},
        a AS (SELECT CAST(sum(support) AS BIGINT) AS n_rows, round({F1}, 6) AS f1,
                     round(CAST(sum(hits) AS DOUBLE) / sum(support), 6) AS accuracy FROM s)
        SELECT run, a.*, true AS is_stamped FROM a, (VALUES ('first'), ('second')) r(run)""",
    "metrics_by_run": f"""
        WITH {class_scores(RULE)},
        a AS (SELECT CAST(sum(support) AS BIGINT) AS n_rows, round({F1}, 6) AS f1,
                     round(CAST(sum(hits) AS DOUBLE) / sum(support), 6) AS accuracy FROM s)
        SELECT run_id, a.* FROM a, (VALUES ('first'), ('second')) r(run_id)""",
    "prediction_sink": f"""
        SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_partkey AS BIGINT) AS l_partkey,
               CAST(l_suppkey AS BIGINT) AS l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, quality AS prediction,
               8 AS n_classes, count(*) OVER () AS n_rows, 1.0::DOUBLE AS f1, 1.0::DOUBLE AS accuracy
        FROM ({SEPARABLE})""",
    "document_features": rf"""
        SELECT doc_id, n_chars, n_words, n_distinct, round(n_distinct / greatest(1, n_words), 6) AS distinct_share,
               round(n_other / greatest(1, n_chars), 6) AS other_share, quality
        FROM (
          SELECT doc_id, n_chars, CAST(len(w) AS INTEGER) AS n_words, CAST(len(list_distinct(w)) AS INTEGER) AS n_distinct,
                 length(regexp_replace(text, '[A-Za-z0-9 ]', '', 'g')) AS n_other
          FROM (SELECT *, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM documents))
        JOIN labels USING (doc_id)""",
    "document_quality": f"""
        WITH d AS (SELECT quality AS label, {bucket("outer", "doc_id")} AS part FROM documents JOIN labels USING (doc_id)),
        u AS (SELECT label FROM d WHERE part <> 0 GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
        {class_scores("SELECT label, (SELECT label FROM u) AS prediction FROM d WHERE part = 0")}
        SELECT CAST(sum(support) AS BIGINT) AS n_rows, round({F1}, 6) AS majority_f1, true AS forest_is_better FROM s""",
    "train_and_score": f"""
        SELECT CASE WHEN part = 0 THEN 'test' ELSE 'validation' END AS dataset, count(*) AS n_rows,
               1.0::DOUBLE AS f1, 1.0::DOUBLE AS accuracy
        FROM (SELECT {bucket("outer", KEY)} AS part FROM lineitem) WHERE part < 2 GROUP BY part""",
}
