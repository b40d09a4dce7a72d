"""The star profiles and tracking rows in the SQL of the checking engine, written independently."""

PROFILES = """
lines AS (
  SELECT o_custkey AS ck, p_brand, p_type, p_name, l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
amounts AS (
  SELECT ck, 'languages' AS kind, p_brand AS skill, sum(l_quantity) AS qty FROM lines GROUP BY ALL
  UNION ALL SELECT ck, 'frameworks', p_type, sum(l_quantity) FROM lines GROUP BY ALL
  UNION ALL SELECT ck, 'technologies', p_name, sum(l_quantity) FROM lines GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY ck, kind ORDER BY qty DESC, skill) AS rn FROM amounts),
skills AS (
  SELECT ck,
    list(skill ORDER BY rn) FILTER (WHERE kind = 'languages' AND rn <= 3) AS lang_p,
    list(skill ORDER BY rn) FILTER (WHERE kind = 'languages' AND rn > 3) AS lang_a,
    list(skill ORDER BY rn) FILTER (WHERE kind = 'frameworks' AND rn <= 3) AS fw_p,
    list(skill ORDER BY rn) FILTER (WHERE kind = 'frameworks' AND rn > 3) AS fw_a,
    list(skill ORDER BY rn) FILTER (WHERE kind = 'technologies' AND rn <= 3) AS tech_p,
    list(skill ORDER BY rn) FILTER (WHERE kind = 'technologies' AND rn > 3) AS tech_a,
    list({'skill': CASE WHEN ck % 7 = 0 THEN skill ELSE lower(skill) END,
          'years': CASE WHEN rn = 1 AND ck % 9 = 0 THEN NULL ELSE qty / 12 END} ORDER BY rn)
      FILTER (WHERE kind = 'languages') AS entries
  FROM ranked GROUP BY ck),
jobs AS (
  SELECT o_custkey AS ck, year(o_orderdate) AS yr, o_orderstatus AS status, o_orderpriority AS priority,
    count(*) AS n, sum(o_totalprice::DECIMAL(18,2)) AS price, max(o_totalprice::DECIMAL(18,2)) AS top_price,
    min(o_orderkey) AS min_key, max(o_orderkey) AS max_key, min(o_orderdate) AS min_date, max(o_orderdate) AS max_date
  FROM orders GROUP BY ALL),
work AS (
  SELECT ck,
    list({'name': 'co-' || lower(status) || '-' || yr,
      'position': CASE WHEN priority <> '3-MEDIUM' THEN lower(priority) || ' engineer' END,
      'city': 'city ' || (min_key % 50),
      'country': CASE WHEN min_key % 7 <> 0 THEN 'country ' || (min_key % 5) END,
      'joined': lower(strftime(min_date, '%B %Y')), 'left': lower(strftime(max_date, '%B %Y')),
      'duration': price::DOUBLE / 100000,
      'size': CASE priority[1] WHEN '1' THEN '<50' WHEN '2' THEN '50-200' WHEN '3' THEN '200-500' WHEN '4' THEN '500-1000' ELSE '>1000' END,
      'type': CASE status WHEN 'F' THEN 'product' WHEN 'O' THEN 'service' ELSE 'startup' END,
      'faang': min_key % 13 = 0, 'raised': CASE WHEN max_key % 2 = 0 THEN 'yes' ELSE 'no' END, 'startup': status = 'P',
      'industry': CASE WHEN max_key % 11 <> 0 THEN 'sector ' || chr(97 + (min_key % 17)::INTEGER) END
    } ORDER BY yr, status, priority) AS experience,
    coalesce(list({'name': 'project ' || max_key, 'about': 'worth ' || trunc(top_price)::BIGINT, 'top': top_price} ORDER BY yr, status, priority)
      FILTER (WHERE top_price > 450000), []) AS projects,
    sum(price)::DOUBLE / 100000 AS ft,
    (sum(price) FILTER (WHERE status = 'P'))::DOUBLE / 100000 AS st,
    (sum(price) FILTER (WHERE status = 'P' AND yr < 1998))::DOUBLE / 100000 AS es,
    (sum(price) FILTER (WHERE status = 'F'))::DOUBLE / 100000 AS pr,
    (sum(price) FILTER (WHERE status = 'O'))::DOUBLE / 100000 AS se,
    sum(n)::BIGINT AS n,
    first(lower(priority) ORDER BY max_date DESC, max_key DESC) AS held
  FROM jobs GROUP BY ck),
studies AS (
  SELECT ck, status, sum(n)::BIGINT AS n, min(yr) AS y0, max(yr) AS y1,
    CASE status WHEN 'F' THEN 'masters' WHEN 'O' THEN 'bachelors' ELSE 'phd' END AS lvl,
    CASE status WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS pos
  FROM jobs GROUP BY ck, status),
edu AS (
  SELECT ck, list({'school': 'school ' || lower(status), 'degree': lvl || ' of orders', 'y0': y0, 'y1': y1, 'years': y1 - y0,
      'lvl': CASE WHEN n % 7 <> 0 THEN lvl END, 'cs': n % 2 = 0, 'ml': n % 3 = 0,
      'institute': ['iit', 'nit', 'iiit', 'bits', 'other'][n % 5 + 1]} ORDER BY pos) AS education
  FROM studies GROUP BY ck),
profiles AS (
  SELECT c_custkey AS k, lpad(lower(to_hex(c_custkey)), 24, '0') AS profile_id,
    lower(c_name) AS name, 'c' || c_custkey || '@example.com' AS email, (9000000000 + c_custkey)::VARCHAR AS mobile,
    lower(n_name) AS city, lower(r_name) AS country,
    lower(c_mktsegment) AS resume_type, lower(c_mktsegment) || ' specialist' AS title,
    c_custkey % 30 <> 7 AS has_skills,
    CASE WHEN c_custkey % 30 <> 7 THEN coalesce(lang_p, []) END AS lang_p, CASE WHEN c_custkey % 30 <> 7 THEN coalesce(lang_a, []) END AS lang_a,
    CASE WHEN c_custkey % 30 <> 7 THEN coalesce(fw_p, []) END AS fw_p, CASE WHEN c_custkey % 30 <> 7 THEN coalesce(fw_a, []) END AS fw_a,
    CASE WHEN c_custkey % 30 <> 7 THEN coalesce(tech_p, []) END AS tech_p, CASE WHEN c_custkey % 30 <> 7 THEN coalesce(tech_a, []) END AS tech_a,
    CASE WHEN c_custkey % 30 <> 7 THEN coalesce(entries, []) END AS entries,
    CASE WHEN c_custkey % 30 <> 7 THEN c_acctbal > 5000 END AS llm,
    CASE WHEN c_custkey % 30 <> 7 AND c_custkey % 10 <> 0 THEN c_custkey % 2 = 0 END AS gen_ai,
    CASE WHEN c_custkey % 20 = 0 THEN NULL WHEN c_custkey % 20 = 1 THEN [] ELSE coalesce(education, []) END AS education,
    experience,
    CASE WHEN c_custkey % 25 <> 4 THEN projects END AS projects,
    CASE WHEN c_custkey % 25 <> 3 THEN held END AS held, CASE WHEN c_custkey % 25 <> 3 THEN ft END AS ft,
    CASE WHEN c_custkey % 25 <> 3 THEN st END AS st, CASE WHEN c_custkey % 25 <> 3 THEN es END AS es,
    CASE WHEN c_custkey % 25 <> 3 THEN pr END AS pr, CASE WHEN c_custkey % 25 <> 3 THEN se END AS se,
    CASE WHEN c_custkey % 25 <> 3 THEN c_custkey % 2 = 0 END AS sum_gen_ai,
    'summary of ' || lower(c_name) AS overall
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN skills ON skills.ck = c_custkey LEFT JOIN work ON work.ck = c_custkey LEFT JOIN edu ON edu.ck = c_custkey)
"""

TRACKING = """
tracking AS (
  SELECT event_id::VARCHAR AS id, props AS file,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'in_progress' ELSE 'completed' END AS parsing_status,
    (event_id % 5)::INTEGER AS no_of_retries,
    CASE WHEN event_type = 'error' THEN '' ELSE lpad(lower(to_hex(user_id)), 24, '0') END AS parsed_data_id,
    CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS resume_category,
    ts - INTERVAL 1 HOUR AS created_at, ts AS modified_at
  FROM events)
"""
