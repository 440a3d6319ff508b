"""SQL for DuckDB, where the problem can be stated in it over whole tables."""

_W = "trim(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_KEYS = f"""
 keyed AS (
  SELECT row_id, name, url,
   array_to_string(list_sort(string_split({_W.format('name')}, ' ')), ' ') AS k1,
   {_W.format("string_split(coalesce(url, ''), '?')[1]")} AS k2,
   array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(CASE WHEN contains(coalesce(url, ''), '?') THEN substring(url, strpos(url, '?') + 1) ELSE '' END, '[&;]'),
     lambda p: {_W.format('p')}), lambda p: p <> '')), chr(2)) AS k3
  FROM lg_page_info)
"""

ORACLES = {
    "p5_found": f"""
WITH {_KEYS}, m AS (SELECT min(row_id) OVER (PARTITION BY k1, k2, k3) AS keep_id, row_id FROM keyed)
SELECT keep_id, row_id FROM m WHERE keep_id < row_id
""",
    "p5_records": f"""
WITH {_KEYS}, m AS (SELECT row_id, name, url, min(row_id) OVER (PARTITION BY k1, k2, k3) AS keep_id, count(*) OVER (PARTITION BY k1, k2, k3) AS n_copies FROM keyed)
SELECT row_id, name, url, n_copies FROM m WHERE keep_id = row_id
""",
}
