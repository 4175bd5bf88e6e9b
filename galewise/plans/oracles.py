"""The same results in SQL, for checking the registered queries with another engine."""

from __future__ import annotations

CTE: dict[str, str] = {
    "station_obs": """
  SELECT list_extract(['K2931','K2942','K2962'], CAST(user_id % 3 AS INT) + 1) AS StationNum,
         strftime(ts + INTERVAL 8 HOUR, '%y%m%d%H') AS ObservTimes,
         CAST(max(event_id * 37 % 360) AS INT) AS WindDirect10,
         CAST(max(event_id * 13 % 300) AS INT) AS WindVelocity10,
         CAST(max(floor(value * 10)) AS INT) AS ExMaxWindV
  FROM events GROUP BY 1, 2""",
    "forecast_file": """
  SELECT event_id, 'ecfine.I' || strftime(issue, '%Y%m%d%H') || '.' || lpad(CAST(lead AS VARCHAR), 3, '0')
         || '.F' || strftime(issue + to_hours(lead), '%Y%m%d%H') || '.nc' AS file_name
  FROM (SELECT event_id, date_trunc('hour', ts) - to_hours(CAST(hour(ts) % 12 AS INT)) AS issue,
               CAST(event_id % 81 * 3 AS INT) AS lead FROM events)""",
    "forecast_grid": """
  SELECT lpad(CAST(lead AS VARCHAR), 3, '0') AS gap, lead,
         'F' || strftime(issue + to_hours(lead), '%Y%m%d%H') AS F_time,
         cell // 30 AS variable_no, 242 + (cell % 30) // 5 AS lat_idx, 494 + cell % 5 AS lon_idx,
         CAST(embedding[cell % 64 + 1] AS DOUBLE) * 10 + 10 AS value
  FROM (SELECT TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((vec_id // 26) * 12 AS INT)) AS issue,
               CAST(vec_id % 26 * 3 AS INT) AS lead, embedding, unnest(range(0, 180)) AS cell
        FROM embeddings)""",
    "box": """
  SELECT gap, F_time, variable_no * 12 + (lat_idx - 243) * 3 + lon_idx - 495 AS pos, value
  FROM forecast_grid
  WHERE lead BETWEEN 3 AND 72 AND lat_idx BETWEEN 243 AND 246 AND lon_idx BETWEEN 495 AND 497""",
    "features": """
  SELECT gap, F_time, count(*) AS width, sum(value ORDER BY pos) AS total,
         max(CASE WHEN pos = 71 THEN value END) AS last_value
  FROM box GROUP BY gap, F_time""",
    "labels": """
  SELECT StationNum, 'F' || strftime(strptime(ObservTimes, '%y%m%d%H') - INTERVAL 8 HOUR, '%Y%m%d%H') AS F_time,
         ExMaxWindV * CAST(0.1 AS DOUBLE) AS ExMaxWindV
  FROM station_obs""",
    "last_label": """
  SELECT F_time, arg_max(ExMaxWindV, StationNum) AS label FROM labels GROUP BY F_time""",
    "neighbours": """
  SELECT item AS l, other AS r
  FROM (SELECT l_partkey AS item, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS other FROM lineitem)
  WHERE item <> other""",
    "sim_matrix": """
  SELECT l AS left_video_id, r AS right_video_id FROM neighbours
  UNION SELECT r, l FROM neighbours""",
    "context_index": """
  SELECT id AS left_video_id, row_number() OVER (ORDER BY CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 7) AS INT) % 1024, id) - 1 AS c_idx
  FROM (SELECT DISTINCT left_video_id AS id FROM sim_matrix)""",
    "target_index": """
  SELECT id AS video_id, row_number() OVER (ORDER BY CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 7) AS INT) % 1024, id) - 1 AS p_idx
  FROM (SELECT DISTINCT right_video_id AS id FROM sim_matrix)""",
    "nce": """
  SELECT s.left_video_id, c.c_idx, s.right_video_id AS p_right_video_id, p.p_idx
  FROM sim_matrix s JOIN context_index c USING (left_video_id)
  JOIN target_index p ON p.video_id = s.right_video_id""",
    "triples": """
  SELECT c_idx AS t, p_idx AS p,
         CAST('0x' || substr(md5(c_idx || ':' || p_idx || ':neg'), 1, 15) AS BIGINT) % (SELECT count(*) FROM target_index) AS n
  FROM nce""",
    "flags": """
  SELECT p_partkey AS course_id, p_size % 3 AS vip_status, p_size % 2 AS needbuy_status
  FROM part JOIN (SELECT l_partkey, l_suppkey % 4 AS client FROM lineitem
                  WHERE l_returnflag = 'R' AND l_suppkey % 2 = 1 GROUP BY ALL) AS offers ON l_partkey = p_partkey""",
    "flagged": """
  SELECT vec_id AS video_id, embedding,
         CAST(coalesce(vip_status, 0) AS BIGINT) AS vip_status,
         CAST(coalesce(needbuy_status, 0) AS BIGINT) AS needbuy_status
  FROM embeddings LEFT JOIN flags ON course_id = vec_id""",
    "published": "SELECT DISTINCT * FROM flagged",
    "history": """
  SELECT DISTINCT user_id, event_id * 7 % (SELECT count(*) FROM part) AS course_id FROM events""",
    "seeds": """
  SELECT user_id, course_id FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CAST('0x' || substr(md5(course_id || ':7'), 1, 7) AS INT), course_id) AS rn
    FROM history) WHERE rn <= 20""",
    "sort_sample": """
  SELECT event_id AS sample_id, value AS weight,
         CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS label,
         list_dot_product(CAST(q.embedding[1:32] AS DOUBLE[]), CAST(c.embedding[33:64] AS DOUBLE[])) * 4 AS logit
  FROM events JOIN embeddings q ON q.vec_id = event_id % (SELECT count(*) FROM embeddings)
  JOIN embeddings c ON c.vec_id = user_id % (SELECT count(*) FROM embeddings)""",
    "ranking": """
  SELECT label % 3 AS relevance, 'g_' || CAST(vec_id // 25 AS VARCHAR) AS "group",
         """
    + ", ".join(f"floor(CAST(embedding[{i}] AS DOUBLE) * 1000) AS f_{i}" for i in range(1, 9))
    + " FROM embeddings",
    "penguins": """
  SELECT vec_id AS row_id, list_extract(['adelie','chinstrap','gentoo'], label % 3 + 1) AS species,
         list_extract(['biscoe','dream','torgersen'], CAST(vec_id % 3 AS INT) + 1) AS island,
         floor(CAST(embedding[1] AS DOUBLE) * 1000) AS bill_length_mm,
         floor(CAST(embedding[2] AS DOUBLE) * 1000) AS bill_depth_mm,
         floor(CAST(embedding[3] AS DOUBLE) * 1000) AS flipper_length_mm,
         floor(CAST(embedding[4] AS DOUBLE) * 1000) AS body_mass_g,
         CASE WHEN vec_id % 17 <> 0 THEN list_extract(['female','male'], CAST(vec_id % 2 AS INT) + 1) END AS sex,
         CAST(vec_id % 3 + 2007 AS INT) AS year
  FROM embeddings""",
    "scored_ranking": """
  SELECT vec_id AS row_id, 'g_' || CAST(vec_id // 25 AS VARCHAR) AS "group", label % 3 AS relevance,
         floor(CAST(embedding[1] AS DOUBLE) * 1000) AS score
  FROM embeddings""",
    "predictions": """
  SELECT label % 2 AS label, CAST(embedding[2] AS DOUBLE) * 5 AS logit,
         CASE WHEN CAST(embedding[2] AS DOUBLE) > 0 THEN 1 ELSE 0 END AS prediction
  FROM embeddings""",
    "tree_nodes": """
  SELECT p_partkey AS tree_id, unnest([0, 1, 2, 3, 4]) AS node_id,
         unnest(['f1', 'f2', '0', '2', '1']) AS node, unnest(['split', 'split', 'leaf', 'leaf', 'leaf']) AS kind,
         unnest([1, 3, NULL, NULL, NULL]) AS pos, unnest([2, 4, NULL, NULL, NULL]) AS neg
  FROM part""",
}

NEEDS: dict[str, list[str]] = {
    "box": ["forecast_grid"], "features": ["box"], "labels": ["station_obs"], "last_label": ["labels"],
    "sim_matrix": ["neighbours"], "context_index": ["sim_matrix"],
    "target_index": ["sim_matrix"], "nce": ["context_index", "target_index"],
    "triples": ["nce"], "flagged": ["flags"], "published": ["flagged"], "seeds": ["history"],
}


def _with(body: str, *names: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({CTE[n].strip()})" for n in order)
    return (f"WITH {ctes} " if ctes else "") + body.strip()


def _sample(join: str, value: str = "l.label") -> str:
    """Samples with (or without) an earlier reading as the last input."""
    if not join:
        return _with(
            """SELECT f.gap, f.F_time, CAST(width AS INT) AS width, round(total, 4) AS input_sum,
                      round(last_value, 6) AS last_input, round(l.label, 6) AS label
               FROM features f JOIN last_label l USING (F_time)""",
            "features", "last_label",
        )
    return _with(
        f"""SELECT f.gap, f.F_time, CAST(width + 1 AS INT) AS width, round(total + e.label, 4) AS input_sum,
                   round(e.label, 6) AS last_input, round(l.label, 6) AS label
            FROM features f JOIN last_label l USING (F_time)
            JOIN last_label e ON e.F_time = 'F' || strftime(strptime(f.F_time, 'F%Y%m%d%H') - to_hours({join}), '%Y%m%d%H')""",
        "features", "last_label",
    )


_DOT32 = "list_dot_product(CAST({a}[1:32] AS DOUBLE[]), CAST({b}[33:64] AS DOUBLE[]))"
_LOGLOSS = "greatest({x}, 0) - ({x}) * {y} + ln(1 + exp(-abs({x})))"

ORACLES: dict[str, str] = {
    "src_forecast_names": _with(
        r"""SELECT event_id, file_name,
                   regexp_extract(file_name, '(ecfine)\.(.*)\.(\d+)\.(.*)\.(nc)', 2) AS init,
                   regexp_extract(file_name, '(ecfine)\.(.*)\.(\d+)\.(.*)\.(nc)', 3) AS gap,
                   regexp_extract(file_name, '(ecfine)\.(.*)\.(\d+)\.(.*)\.(nc)', 4) AS F_time
            FROM forecast_file""",
        "forecast_file",
    ),
    "src_station_union": _with("SELECT * FROM station_obs", "station_obs"),
    "src_csv_roundtrip": _with("SELECT * FROM penguins", "penguins"),
    "src_ranking_text": _with("SELECT * FROM ranking", "ranking"),
    "src_snapshot_roundtrip": _with(
        "SELECT F_time, StationNum, round(ExMaxWindV, 6) AS ExMaxWindV FROM labels", "labels"
    ),
    "src_catalog_sql": """
        WITH offers AS (SELECT l_partkey, l_suppkey % 4 AS permit_client FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 2 = 1 GROUP BY ALL)
        SELECT CAST(p_partkey AS VARCHAR) AS course_id, p_size % 3 AS vip_status, p_size % 2 AS needbuy_status, permit_client
        FROM part JOIN offers ON l_partkey = p_partkey""",
    "src_replaced_table": _with(
        "SELECT vip_status, needbuy_status, count(*) AS n FROM flags GROUP BY 1, 2", "flags"
    ),
    "src_report": """
        SELECT CAST((event_id % 24 + 1) * 3 AS INT) AS gap, CAST(user_id % 10 + 1 AS INT) AS exp, count(*) AS n,
               round(sqrt(avg(pow(value * CAST(0.9 AS DOUBLE) - value, 2))), 6) AS "K2962_rmse_calibration",
               round(sqrt(avg(pow(value + CAST(event_id % 7 AS DOUBLE) - 3.0 - value, 2))), 6) AS "K2962_rmse_ecf"
        FROM events WHERE value + CAST(event_id % 7 AS DOUBLE) - 3.0 > 0 GROUP BY 1, 2""",
    "src_dense_index": """SELECT vec_id, row_number() OVER (
        ORDER BY CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 7) AS INT) % 1024, vec_id) - 1 AS idx
        FROM embeddings""",
    "retention_victims": """
        WITH names AS (SELECT DISTINCT 'video_query_' || strftime(ts, '%Y%m%d') || '000000' AS name FROM events),
        ranked AS (SELECT name, row_number() OVER (ORDER BY name) AS up, row_number() OVER (ORDER BY name DESC) AS down FROM names)
        SELECT name FROM ranked WHERE up > 1 AND down > 3""",
    "forecast_lead_filter": _with(
        r"""SELECT event_id, gap, F_time FROM (
              SELECT event_id, regexp_extract(file_name, '(ecfine)\.(.*)\.(\d+)\.(.*)\.(nc)', 3) AS gap,
                     regexp_extract(file_name, '(ecfine)\.(.*)\.(\d+)\.(.*)\.(nc)', 4) AS F_time FROM forecast_file)
            WHERE CAST(gap AS INT) BETWEEN 3 AND 72""",
        "forecast_file",
    ),
    "rank_group_filter": _with(
        """SELECT f_1, f_2, f_3, f_4, f_5, f_6, f_7, f_8 FROM ranking WHERE "group" = 'g_5'""", "ranking"
    ),
    "prep_features": _with(
        "SELECT row_id, body_mass_g / 1000.0 AS body_mass_kg, bill_length_mm FROM penguins", "penguins"
    ),
    "catalog_flags": _with(
        """SELECT video_id, vip_status, needbuy_status,
                  round(list_dot_product(CAST(embedding[1:32] AS DOUBLE[]), CAST(range(1, 33) AS DOUBLE[])), 6) AS query_check,
                  round(list_dot_product(CAST(embedding[33:64] AS DOUBLE[]), CAST(range(1, 33) AS DOUBLE[])), 6) AS search_check
           FROM flagged""",
        "flagged",
    ),
    "knn_exact_filtered": _with(
        f"""SELECT query_id, video_id, score, rn FROM (
              SELECT query_id, video_id, score,
                     CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id) AS INT) AS rn
              FROM (SELECT q.video_id AS query_id, i.video_id,
                           round({_DOT32.format(a='q.embedding', b='i.embedding')}, 6) AS score
                    FROM published q, published i WHERE i.vip_status = 0 AND i.needbuy_status = 0))
            WHERE rn > 4 AND rn <= 1028""",
        "published",
    ),
    "itemcf_candidates": _with(
        """SELECT user_id, course_id, CAST(2.0 AS DOUBLE) AS score FROM (
             SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY course_id DESC) AS rn FROM (
               SELECT DISTINCT s.user_id, m.left_video_id AS course_id
               FROM seeds s JOIN sim_matrix m ON m.right_video_id = s.course_id
               JOIN part p ON p.p_partkey = m.left_video_id
               WHERE p.p_size % 3 = 2 AND p.p_size % 2 = 0)) WHERE rn <= 1024""",
        "seeds", "sim_matrix",
    ),
    "tower_join": _with(
        f"""SELECT c.left_video_id AS video_id,
                   round(list_dot_product(CAST(a.embedding[1:32] AS DOUBLE[]), CAST(b.embedding[33:64] AS DOUBLE[])), 6) AS ip
            FROM context_index c JOIN embeddings a ON a.vec_id = c.c_idx % (SELECT count(*) FROM embeddings)
            JOIN target_index p ON p.video_id = c.left_video_id
            JOIN embeddings b ON b.vec_id = p.p_idx % (SELECT count(*) FROM embeddings)""",
        "context_index", "target_index",
    ),
    "bias_fold": """SELECT vec_id, CAST(32 AS INT) AS width,
        round(list_dot_product(CAST(embedding[1:31] AS DOUBLE[]), CAST(embedding[33:63] AS DOUBLE[])) + CAST(embedding[32] AS DOUBLE), 6) AS ip
        FROM embeddings""",
    "dense_forward": """
        WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        x AS (SELECT vec_id, list_sum(e[1:64:4]) AS a, list_sum(e[2:64:4]) AS b, list_sum(e[3:64:4]) AS c, list_sum(e[4:64:4]) AS d FROM e),
        l1 AS (SELECT vec_id, greatest(0.5*a - b + 0.25*c + d + 0.1, 0) AS h0,
                      greatest(-0.25*a + 0.75*b + c - 0.5*d, 0) AS h1,
                      greatest(a + 0.5*b - 0.5*c + 0.25*d - 0.1, 0) AS h2 FROM x)
        SELECT vec_id, round(greatest(h0 + 0.5*h1 - 0.75*h2, 0), 6) AS y0,
               round(greatest(-h0 + 2*h1 + 1.5*h2, 0), 6) AS y1 FROM l1""",
    "forecast_features": _with(
        "SELECT gap, F_time, CAST(72 AS INT) AS width, CAST(pos AS INT) AS pos, value FROM box", "box"
    ),
    "station_labels": """
        SELECT F_time, CAST(row_number() OVER (PARTITION BY F_time ORDER BY StationNum, gust) - 1 AS INT) AS pos,
               StationNum, round(gust, 6) AS ExMaxWindV
        FROM (SELECT list_extract(['K2931','K2942','K2962','K2999'], CAST(user_id % 4 AS INT) + 1) AS StationNum,
                     'F' || strftime(ts, '%Y%m%d%H') AS F_time, floor(value * 10) * CAST(0.1 AS DOUBLE) AS gust FROM events)""",
    "wx_join_valid_time": _sample(""),
    "wx_join_lag_issue": _sample("CAST(f.gap AS INT)"),
    "wx_join_lag_1h": _sample("1"),
    "calib_rmse": """
        SELECT CAST((event_id % 24 + 1) * 3 AS INT) AS gap, CAST(user_id % 10 + 1 AS INT) AS exp,
               round(sqrt(avg(pow(value * CAST(0.9 AS DOUBLE) - value, 2))), 6) AS "K2962_rmse_calibration",
               round(sqrt(avg(pow(value + CAST(event_id % 7 AS DOUBLE) - 3.0 - value, 2))), 6) AS "K2962_rmse_ecf"
        FROM events WHERE value + CAST(event_id % 7 AS DOUBLE) - 3.0 > 0 GROUP BY 1, 2""",
    "calib_rows": _with(
        """SELECT CAST(f.gap AS INT) AS gap, CAST(exp AS INT) AS exp, count(*) AS n
           FROM features f JOIN last_label l USING (F_time)
           JOIN last_label e ON e.F_time = 'F' || strftime(strptime(f.F_time, 'F%Y%m%d%H') - to_hours(1), '%Y%m%d%H')
           CROSS JOIN (SELECT unnest(range(1, 11)) AS exp)
           WHERE CAST('0x' || substr(md5(f.gap || f.F_time || ':' || exp), 1, 7) AS INT) % 1000 < 200
           GROUP BY 1, 2""",
        "features", "last_label",
    ),
    "vocab_sizes": _with(
        """SELECT (SELECT max(c_idx) + 1 FROM nce) AS c_num,
                  (SELECT count(DISTINCT right_video_id) FROM sim_matrix) AS w_num""",
        "nce",
    ),
    "positives_per_context": _with(
        """SELECT c_idx, part, CAST(count(*) AS INT) AS n, string_agg(CAST(p_idx AS VARCHAR), ',' ORDER BY p_idx) AS positives
           FROM (SELECT c_idx, p_idx, CAST('0x' || substr(md5(CAST(p_idx AS VARCHAR)), 1, 7) AS INT)
                        % CAST(ceil(count(*) OVER (PARTITION BY c_idx) / 1024) AS INT) AS part FROM nce)
           GROUP BY c_idx, part""",
        "nce",
    ),
    "id_index_map": _with("SELECT DISTINCT left_video_id AS video_id, c_idx AS idx FROM nce", "nce"),
    "column_counts": _with(
        "SELECT unnest(['row_id','species','island','bill_length_mm','bill_depth_mm','flipper_length_mm','body_mass_g','sex','year']) AS column_name,"
        " unnest([count(row_id), count(species), count(island), count(bill_length_mm), count(bill_depth_mm), count(flipper_length_mm),"
        " count(body_mass_g), count(sex), count(year)]) AS non_null FROM penguins",
        "penguins",
    ),
    "label_encode": _with(
        "SELECT row_id, species, CAST(dense_rank() OVER (ORDER BY species) - 1 AS INT) AS label FROM penguins",
        "penguins",
    ),
    "seed_sample": _with("SELECT * FROM seeds", "seeds"),
    "split_counts": """
        SELECT CAST(exp AS INT) AS exp,
               CAST('0x' || substr(md5(event_id || ':' || exp), 1, 7) AS INT) % 1000 < 200 AS is_test, count(*) AS n
        FROM events CROSS JOIN (SELECT unnest(range(1, 11)) AS exp) GROUP BY 1, 2""",
    "minibatch_sizes": """
        SELECT CAST(epoch AS INT) AS epoch, CAST('0x' || substr(md5(event_id || ':' || epoch), 1, 7) AS INT) % 16 AS batch_id,
               count(*) AS n
        FROM events CROSS JOIN (SELECT unnest(range(1, 4)) AS epoch) GROUP BY 1, 2""",
    "rank_top100": _with(
        """SELECT "group", relevance, f_1, f_1 + f_2*2 + f_3*3 + f_4*4 + f_5*5 + f_6*6 + f_7*7 + f_8*8 AS prediction_score
           FROM ranking ORDER BY prediction_score DESC, "group", relevance, f_1, f_2, f_3, f_4, f_5, f_6, f_7, f_8 LIMIT 100""",
        "ranking",
    ),
    "fn_time": _with(
        """SELECT StationNum, ObservTimes, 'F' || strftime(utc, '%Y%m%d%H') AS F_time,
                  'F' || strftime(utc - INTERVAL 6 HOUR, '%Y%m%d%H') AS F_minus_6,
                  strftime(utc + INTERVAL 8 HOUR, '%Y%m%d%H%M') AS at_utc8, CAST(epoch(utc) AS BIGINT) AS epoch_s
           FROM (SELECT *, strptime(ObservTimes, '%y%m%d%H') - INTERVAL 8 HOUR AS utc FROM station_obs)""",
        "station_obs",
    ),
    "fn_strings": _with(
        """SELECT event_id, regexp_replace(split_part(file_name, '.', 1) || '_', '_$', '') AS kind,
                  split_part(file_name, '.', 2) || '.' || split_part(file_name, '.', 3) || '.' || split_part(file_name, '.', 4) AS middle,
                  lpad(CAST((event_id % 24 + 1) * 3 AS VARCHAR), 3, '0') AS lead_label, CAST(event_id AS VARCHAR) AS token
           FROM forecast_file""",
        "forecast_file",
    ),
    "fn_wind_uv": _with(
        """SELECT StationNum, ObservTimes,
                  round(-CAST(WindVelocity10 AS DOUBLE) * sin(radians(WindDirect10)) * CAST(0.1 AS DOUBLE), 6) AS u10,
                  round(-CAST(WindVelocity10 AS DOUBLE) * cos(radians(WindDirect10)) * CAST(0.1 AS DOUBLE), 6) AS v10
           FROM station_obs""",
        "station_obs",
    ),
    "fn_math": """SELECT vec_id, round(sqrt(abs(x)), 6) AS root, greatest(x, 0) AS relu, round(x / 255.0, 9) AS scaled
        FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)""",
    "fn_softmax": """
        WITH z AS (SELECT vec_id, unnest(range(0, len(embedding))) AS class, unnest(CAST(embedding AS DOUBLE[])) AS z,
                          CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)
        SELECT vec_id, CAST(class AS INT) AS class, round(exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id), 6) AS p,
               round(1 / (1 + exp(-x)), 6) AS sigmoid, round(ln(1 / (1 + exp(-x))), 6) AS log_sigmoid FROM z""",
    "fn_arrays": """SELECT vec_id, CAST(unnest(range(0, 6)) AS INT) AS pos,
        unnest(CAST([embedding[1], embedding[2], embedding[5], embedding[5], embedding[5], embedding[64]] AS DOUBLE[])) AS value
        FROM embeddings""",
    "fn_dot": f"SELECT vec_id, round({_DOT32.format(a='embedding', b='embedding')}, 6) AS ip FROM embeddings",
    "fn_endpoint_mean": """
        SELECT 'row' AS axis, vec_id AS key, CAST(0 AS INT) AS pos,
               round((CAST(embedding[1] AS DOUBLE) + CAST(embedding[64] AS DOUBLE)) * 0.5, 6) AS m FROM embeddings
        UNION ALL
        SELECT 'column', CAST(label AS BIGINT), CAST(i AS INT),
               round((CAST(a[i + 1] AS DOUBLE) + CAST(b[i + 1] AS DOUBLE)) * 0.5, 6)
        FROM (SELECT label, arg_min(embedding, vec_id) AS a, arg_max(embedding, vec_id) AS b FROM embeddings GROUP BY label),
             (SELECT unnest(range(0, 64)) AS i)""",
    "ndcg": _with(
        """, got AS (SELECT "group", sum((pow(2, relevance) - 1) / log2(rank + 1)) AS dcg FROM (
                SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY score DESC, row_id) AS rank FROM scored_ranking)
              WHERE rank <= 5 GROUP BY 1),
            best AS (SELECT "group", sum((pow(2, relevance) - 1) / log2(rank + 1)) AS ideal FROM (
                SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY relevance DESC, row_id) AS rank FROM scored_ranking)
              WHERE rank <= 5 GROUP BY 1)
           SELECT "group", round(dcg / ideal, 6) AS ndcg FROM got JOIN best USING ("group") WHERE ideal > 0""",
        "scored_ranking",
    ).replace(") , got", "), got"),
    "accuracy": _with(
        "SELECT round(avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM predictions",
        "predictions",
    ),
    "logloss": _with(
        f"SELECT round(avg({_LOGLOSS.format(x='logit', y='label')}), 6) AS logloss FROM predictions", "predictions"
    ),
    "mse_rmse": """SELECT round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse FROM (
        SELECT avg(pow(p_size * CAST(0.5 AS DOUBLE) + 2.0 - (p_size % 29 + 1), 2)) AS mse FROM part)""",
    "weighted_logloss": _with(
        """SELECT sample_id, round((1 - label) * logit + (1 + (weight - 1) * label)
                  * (ln(1 + exp(-abs(logit))) + greatest(-logit, 0)), 6) AS loss FROM sort_sample""",
        "sort_sample",
    ),
    "epoch_loss_report": _with(
        f"""SELECT CAST(epoch AS INT) AS epoch, round(avg(loss), 6) AS loss, count(*) AS batches FROM (
              SELECT epoch, CAST('0x' || substr(md5(sample_id || ':' || epoch), 1, 7) AS INT) % 16 AS b,
                     avg({_LOGLOSS.format(x='logit', y='label')}) AS loss
              FROM sort_sample CROSS JOIN (SELECT unnest(range(1, 4)) AS epoch) GROUP BY 1, 2) GROUP BY 1""",
        "sort_sample",
    ),
    "learning_curve": """
        WITH v AS (SELECT vec_id, label % 3 AS label, t, CASE WHEN embedding[t % 64 + 1] > 0 THEN label % 3 ELSE CAST((label + t) % 3 AS INT) END AS vote
                   FROM embeddings CROSS JOIN (SELECT unnest(range(0, 300)) AS t)),
        c AS (SELECT vec_id, label, t, sum(CASE WHEN vote = 0 THEN 1 ELSE 0 END) OVER w AS n0,
                     sum(CASE WHEN vote = 1 THEN 1 ELSE 0 END) OVER w AS n1, sum(CASE WHEN vote = 2 THEN 1 ELSE 0 END) OVER w AS n2
              FROM v WINDOW w AS (PARTITION BY vec_id ORDER BY t))
        SELECT CAST(t + 1 AS INT) AS trees,
               round(avg(CASE WHEN label = CASE WHEN n0 >= n1 AND n0 >= n2 THEN 0 WHEN n1 >= n2 THEN 1 ELSE 2 END THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
               round(avg(-ln(greatest((CASE label WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END)::DOUBLE / (t + 1), CAST(0.000001 AS DOUBLE)))), 6) AS logloss
        FROM c GROUP BY t""",
    "tree_score": """
        WITH x AS (SELECT vec_id AS row_id, CASE WHEN vec_id % 13 <> 0 THEN CAST(embedding[1] AS DOUBLE) * 10 END AS f1,
                          CASE vec_id % 4 WHEN 0 THEN 'cat' WHEN 1 THEN 'dog' WHEN 2 THEN 'bird' END AS f2 FROM embeddings),
        s AS (SELECT row_id, CASE WHEN coalesce(f1 >= 1.5, false) THEN CASE WHEN coalesce(f2 IN ('cat', 'dog'), false) THEN 2 ELSE 1 END ELSE 0 END AS leaf_idx FROM x)
        SELECT row_id, CAST(leaf_idx AS INT) AS leaf_idx,
               CAST(CASE leaf_idx WHEN 2 THEN 0.8 ELSE 0.1 END AS DOUBLE) AS p_red,
               CAST(CASE leaf_idx WHEN 1 THEN 0.8 ELSE 0.1 END AS DOUBLE) AS p_blue,
               CAST(CASE leaf_idx WHEN 0 THEN 0.8 ELSE 0.1 END AS DOUBLE) AS p_green FROM s""",
    "tree_inorder": "WITH RECURSIVE tree_nodes AS (" + CTE["tree_nodes"].strip() + """),
        walk AS (SELECT tree_id, node_id, '' AS p FROM tree_nodes WHERE node_id = 0
                 UNION ALL
                 SELECT n.tree_id, c.node_id, w.p || CASE WHEN c.node_id = n.neg THEN '0' ELSE '2' END
                 FROM walk w JOIN tree_nodes n ON n.tree_id = w.tree_id AND n.node_id = w.node_id
                 JOIN tree_nodes c ON c.tree_id = n.tree_id AND c.node_id IN (n.neg, n.pos))
        SELECT tree_id, p || '1' AS path, node FROM walk JOIN tree_nodes USING (tree_id, node_id) ORDER BY tree_id, path""",
    "tree_inorder_deep": """
        WITH line AS (SELECT o_custkey AS tree_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k,
                             count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
        SELECT tree_id, repeat('2', k) || '1' AS path, CAST(o_orderkey AS VARCHAR) AS node FROM line
        UNION ALL SELECT tree_id, repeat('2', k) || '01', CAST(k AS VARCHAR) FROM line
        UNION ALL SELECT tree_id, repeat('2', n) || '1', CAST(n AS VARCHAR) FROM line WHERE k = n - 1""",
    "tree_feature_use": _with(
        "SELECT node AS feature, count(*) AS uses FROM tree_nodes WHERE kind = 'split' GROUP BY 1", "tree_nodes"
    ),
}

_VEC = "SELECT id, CAST(embedding[{a}:{b}] AS DOUBLE[]) AS vec FROM ({ids}) JOIN embeddings ON vec_id = id % (SELECT count(*) FROM embeddings)"

ORACLES["bpr_step"] = (
    _with("", "triples")
    + ", w AS (SELECT t, p, n, count(*) AS weight FROM triples GROUP BY 1, 2, 3), u AS ("
    + _VEC.format(a=1, b=32, ids="SELECT DISTINCT t AS id FROM triples")
    + "), i AS ("
    + _VEC.format(a=33, b=64, ids="SELECT p AS id FROM triples UNION SELECT n FROM triples")
    + """), g AS (SELECT w.*, u.vec AS uv, pv.vec AS pv, nv.vec AS nv,
                   -weight / (1 + exp(list_dot_product(u.vec, pv.vec) - list_dot_product(u.vec, nv.vec))) AS g
            FROM w JOIN u ON u.id = t JOIN i pv ON pv.id = p JOIN i nv ON nv.id = n),
        parts AS (SELECT 'target' AS side, t AS id, unnest(range(0, 32)) AS pos, unnest(pv) AS a, unnest(nv) AS b, g FROM g
                  UNION ALL SELECT 'item', p, unnest(range(0, 32)), unnest(uv), 0, g FROM g
                  UNION ALL SELECT 'item', n, unnest(range(0, 32)), 0, unnest(uv), g FROM g),
        summed AS (SELECT side, id, pos, sum(g * (a - b)) AS grad FROM parts GROUP BY 1, 2, 3),
        start AS (SELECT 'target' AS side, * FROM u UNION ALL SELECT 'item', * FROM i)
        SELECT side, id, CAST(pos AS INT) AS pos, round(vec[pos + 1] - CAST(0.05 AS DOUBLE) * grad, 6) AS value
        FROM start JOIN summed USING (side, id)"""
)
ORACLES["loss_pos_neg"] = (
    _with("", "triples")
    + ", ids AS MATERIALIZED (SELECT t AS id FROM triples UNION SELECT p FROM triples UNION SELECT n FROM triples), u AS MATERIALIZED ("
    + _VEC.format(a=1, b=32, ids="SELECT id FROM ids")
    + "), i AS MATERIALIZED ("
    + _VEC.format(a=33, b=64, ids="SELECT id FROM ids")
    + f"""), x AS (SELECT t || '-' || p AS sample_id, list_dot_product(u.vec, pv.vec) AS pos_logit,
                   list_dot_product(u.vec, nv.vec) + list_dot_product(u.vec, tv.vec) AS neg_logit
            FROM triples JOIN u ON u.id = t JOIN i pv ON pv.id = p JOIN i nv ON nv.id = n JOIN i tv ON tv.id = t)
        SELECT sample_id, round(pos_logit, 6) AS pos_logit, round(neg_logit, 6) AS neg_logit,
               round({_LOGLOSS.format(x='pos_logit', y='1')}, 6) AS pos_loss,
               round({_LOGLOSS.format(x='neg_logit', y='0')}, 6) AS neg_loss FROM x"""
)
ORACLES["nce_loss"] = (
    _with("", "nce")
    + """, k AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM target_index),
        num AS (SELECT c_idx, count(*) AS num_true FROM nce GROUP BY 1),
        h AS ("""
    + _VEC.format(a=1, b=31, ids="SELECT c_idx AS id FROM num")
    + "), w AS ("
    + _VEC.format(a=33, b=64, ids="SELECT p_idx AS id FROM target_index")
    + """), drawn AS (SELECT id, count(*) AS times FROM (
                     SELECT CAST(floor(exp(CAST('0x' || substr(md5(s || ':5'), 1, 15) AS BIGINT) / pow(2, 60) * ln(n + 1))) - 1 AS BIGINT) AS id
                     FROM (SELECT unnest(range(0, 16384)) AS s), k) GROUP BY 1),
        pos AS (SELECT c_idx, num_true, list_dot_product(h.vec, w.vec[1:31]) + w.vec[32]
                       - ln((ln(p_idx + 2) - ln(p_idx + 1)) / ln(n + 1) * 16384) AS x
                FROM nce JOIN num USING (c_idx) JOIN h ON h.id = c_idx JOIN w ON w.id = p_idx, k),
        neg AS (SELECT h.id AS c_idx, times, list_dot_product(h.vec, w.vec[1:31]) + w.vec[32]
                       - ln((ln(w.id + 2) - ln(w.id + 1)) / ln(n + 1) * 16384) AS x
                FROM h, drawn JOIN w USING (id), k),
        losses AS (SELECT c_idx, greatest(x, 0) + ln(1 + exp(-abs(x))) - x / num_true AS loss FROM pos
                   UNION ALL SELECT c_idx, times * (greatest(x, 0) + ln(1 + exp(-abs(x)))) FROM neg)
        SELECT c_idx, round(sum(loss), 6) AS loss FROM losses GROUP BY 1"""
)
ORACLES["lambda_gradients"] = (
    _with("", "scored_ranking")
    + """, r AS (SELECT row_id, "group" AS g, relevance AS rel, score / 100 AS s,
                   row_number() OVER (PARTITION BY "group" ORDER BY score DESC, row_id) AS rk,
                   row_number() OVER (PARTITION BY "group" ORDER BY relevance DESC, row_id) AS best FROM scored_ranking),
        ideal AS (SELECT g, sum((pow(2, rel) - 1) / log2(best + 1)) AS idcg FROM r WHERE best <= 5 GROUP BY 1),
        pairs AS (SELECT a.row_id AS hi, b.row_id AS lo, 1 / (1 + exp(a.s - b.s)) AS rho,
                         abs(pow(2, a.rel) - pow(2, b.rel)) * abs(CASE WHEN a.rk <= 5 THEN 1 / log2(a.rk + 1) ELSE 0 END
                           - CASE WHEN b.rk <= 5 THEN 1 / log2(b.rk + 1) ELSE 0 END) / idcg AS change
                  FROM r a JOIN r b ON a.g = b.g AND a.rel > b.rel JOIN ideal ON ideal.g = a.g WHERE idcg > 0),
        both_ends AS (SELECT hi AS row_id, rho * change AS l, rho * (1 - rho) * change AS w FROM pairs
                 UNION ALL SELECT lo, -rho * change, rho * (1 - rho) * change FROM pairs
                 UNION ALL SELECT row_id, 0, 0 FROM r)
        SELECT row_id, round(sum(l), 6) AS lambda, round(sum(w), 6) AS weight FROM both_ends GROUP BY 1"""
)
# The block join, and an index probed in full, must give the rows of the exact search.
ORACLES["knn_exact_blocks"] = ORACLES["knn_exact_filtered"]
ORACLES["knn_ivf_full_probe"] = ORACLES["knn_exact_filtered"]
ORACLES["knn_ivf_probe"] = ORACLES["knn_exact_filtered"]
ORACLES["knn_ivf_grown"] = ORACLES["knn_exact_filtered"]
ORACLES["knn_ivf_towers"] = _with(
    f"""SELECT tower, query_id, video_id, score, rn FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY tower, query_id ORDER BY score DESC, video_id) AS INT) AS rn
          FROM (SELECT tower, q.video_id AS query_id, i.video_id, round(CASE tower
                           WHEN 'search' THEN {_DOT32.format(a='q.embedding', b='i.embedding')} ELSE {_DOT32.format(a='i.embedding', b='q.embedding')} END, 6) AS score
                FROM published q, published i, (SELECT unnest(['search', 'query']) AS tower) WHERE i.vip_status = 0 AND i.needbuy_status = 0))
        WHERE rn > 4 AND rn <= 1028""",
    "published",
)
ORACLES["tree_score_table"] = ORACLES["tree_score"]
ORACLES["permutation_importance"] = """
    WITH x AS (SELECT vec_id AS row_id, vec_id % 3 AS label, CASE WHEN vec_id % 13 <> 0 THEN CAST(embedding[1] AS DOUBLE) * 10 END AS f1,
                      CASE vec_id % 4 WHEN 0 THEN 'cat' WHEN 1 THEN 'dog' WHEN 2 THEN 'bird' END AS f2 FROM embeddings),
    placed AS (SELECT *, row_number() OVER (ORDER BY CAST('0x' || substr(md5(CAST(row_id AS VARCHAR)), 1, 7) AS INT) % 1024, row_id) AS place,
                      row_number() OVER (ORDER BY CAST('0x' || substr(md5(row_id || ':1'), 1, 7) AS INT) % 1024, row_id || ':1') AS drawn FROM x),
    dealt AS (SELECT a.row_id, a.label, a.f1, a.f2, b.f1 AS g1, b.f2 AS g2 FROM placed a JOIN placed b ON a.place = b.drawn),
    rows AS (SELECT '' AS feature, label, f1, f2 FROM dealt UNION ALL SELECT 'f1', label, g1, f2 FROM dealt UNION ALL SELECT 'f2', label, f1, g2 FROM dealt),
    hits AS (SELECT feature, avg(CASE WHEN label = CASE WHEN coalesce(f1 >= 1.5, false) THEN CASE WHEN coalesce(f2 IN ('cat', 'dog'), false) THEN 0 ELSE 1 END ELSE 2 END
                                 THEN 1.0 ELSE 0.0 END) AS accuracy FROM rows GROUP BY 1)
    SELECT feature, round(accuracy, 6) AS accuracy, round((SELECT accuracy FROM hits WHERE feature = '') - accuracy, 6) AS drop FROM hits WHERE feature <> ''"""
ORACLES["forecast_features_stored"] = ORACLES["forecast_features"]
ORACLES["publish_snapshot"] = _with(
    """SELECT tower, video_id, max(vip_status) AS vip_status, max(needbuy_status) AS needbuy_status, round(any_value(CASE tower
              WHEN 'query' THEN list_sum(CAST(embedding[1:32] AS DOUBLE[])) ELSE list_sum(CAST(embedding[33:64] AS DOUBLE[])) END), 5) AS total
       FROM flagged, (SELECT unnest(['query', 'search']) AS tower) GROUP BY tower, video_id""",
    "flagged",
)
