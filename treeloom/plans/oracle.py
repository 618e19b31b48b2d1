"""The registered queries restated as SQL, for checking results on another engine."""

from __future__ import annotations

from treeloom.operators import replies

# Derived views, the SQL form of treeloom.plans.fixtures.
INVENTORY = """
inventory AS (
  SELECT doc_id, 'corpus' AS repo,
    concat(source,'/',lang,'/mod_',cast(doc_id AS varchar),
      CASE doc_id % 6 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' WHEN 2 THEN '.jsx' WHEN 3 THEN '.py' WHEN 4 THEN '.css' ELSE '.html' END) AS relative_path,
    CASE doc_id % 6 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' WHEN 2 THEN '.jsx' WHEN 3 THEN '.py' WHEN 4 THEN '.css' ELSE '.html' END AS extension,
    source AS top, lang AS sub, n_chars AS size,
    timestamp '2024-01-01 00:00:00' + to_minutes(doc_id) AS last_modified
  FROM documents)"""

SRC = """
b AS (SELECT doc_id, cast(doc_id AS varchar) AS id, source, lang, text,
    concat(source,'/',lang,'/mod_',cast(doc_id AS varchar)) AS stem,
    CASE doc_id % 6 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' WHEN 2 THEN '.jsx' WHEN 3 THEN '.py' WHEN 4 THEN '.css' ELSE '.html' END AS ext
  FROM documents),
j AS (SELECT b.*, t1.stem AS s1, t2.stem AS s2 FROM b
  LEFT JOIN b t1 ON t1.doc_id = CASE WHEN b.doc_id < 60 THEN b.doc_id ELSE (b.doc_id * 7 + 3) % (b.doc_id - b.doc_id % 60) END
  LEFT JOIN b t2 ON t2.doc_id = (b.doc_id - b.doc_id % 60 + (b.doc_id % 60 + 6) % 60) % (SELECT count(*) FROM documents)),
src AS (SELECT doc_id, source AS top, lang AS sub, concat(stem, ext) AS relative_path, stem, ext AS extension,
  CASE WHEN ext IN ('.js','.ts','.jsx') THEN
    'import { a } from ''../../'||s1||''''||chr(10)||'const z = require(''../../'||s2||''')'||chr(10)||
    'import react from ''react'''||chr(10)||'let state'||(doc_id%5)||' = 0'||chr(10)||
    'export function f'||id||'(x) { if (x) { return fetch(''/api/'||(doc_id%9)||''') } }'||chr(10)||
    'async function load'||(doc_id%7)||'({a}, b) { // load '||lang||chr(10)||'  try { await z(a) } finally { b() } }'||chr(10)||
    'function go'||id||'(q) { /* walk '||source||' */'||chr(10)||'  const el = document.querySelector(''#n'||(doc_id%3)||''')'||chr(10)||
    '  q.map(p => { return p }) }'||chr(10)||
    'const h'||id||' = (e) => e + 1'||chr(10)||'el.addEventListener(''click'', go'||id||')'||chr(10)||'/*'||chr(10)||text||chr(10)||'*/'||chr(10)
  WHEN ext = '.py' THEN
    'import os'||chr(10)||'from pkg.m'||(doc_id%11)||' import g'||chr(10)||'class C'||id||'(Base):'||chr(10)||
    '    \"\"\"Doc '||lang||' '||id||'\"\"\"'||chr(10)||'    def run(self):'||chr(10)||'        # step '||(doc_id%4)||chr(10)||
    '        for i in self.items: pass'||chr(10)||'        self.n = 1'||chr(10)||'        return self.n'||chr(10)||
    '@app.route(''/r/'||(doc_id%20)||''', methods=[''POST''])'||chr(10)||'def handler():'||chr(10)||'    return jsonify({})'||chr(10)||
    CASE WHEN doc_id % 4 = 3 THEN 'def broken(:'||chr(10) ELSE '' END||'# '||replace(text, chr(10), chr(10)||'# ')||chr(10)
  WHEN ext = '.css' THEN
    '.card-'||(doc_id%13)||' { display: flex; padding: '||(doc_id%4)||'.5rem; color: #a'||(doc_id%10)||'b; }'||chr(10)||
    '.card-'||(doc_id%13)||' { background-color: rgb('||(doc_id%9)||', 0, 1); font-family: Font'||(doc_id%3)||', serif; }'||chr(10)||
    '.x'||id||' { left: 10rem; }'||chr(10)||'@media (max-width: 600px) { }'||chr(10)||'/*'||chr(10)||text||chr(10)||'*/'||chr(10)
  ELSE text END AS content FROM j)""".replace('\\"', '"')

SELECTION = """
selection AS (SELECT i.relative_path, i.doc_id FROM inventory i JOIN labels l ON i.doc_id = l.doc_id WHERE l.quality = 1)"""

RAW = """
raw AS (SELECT doc_id, n_chars * 1000 AS size, concat(
  CASE WHEN doc_id%8 IN (5,6) THEN 'shared/' WHEN doc_id%9=0 THEN '.git/' WHEN doc_id%9=1 THEN 'node_modules/'
    WHEN doc_id%9=2 THEN 'Build/' WHEN doc_id%9=3 THEN 'build/' WHEN doc_id%9=4 THEN '' ELSE source||'/'||lang||'/' END,
  CASE doc_id%8 WHEN 0 THEN '.env'||doc_id WHEN 1 THEN 'package-lock'||doc_id||'.json' WHEN 2 THEN 'Lock'||doc_id||'.YAML'
    WHEN 3 THEN 'yarn'||doc_id||'.lock' WHEN 4 THEN 'm'||doc_id||'/Makefile' WHEN 5 THEN 'a-b'||(doc_id//8)||'.py'
    WHEN 6 THEN 'a_b'||(doc_id//8)||'.py' ELSE 'x.'||doc_id||'.tar.GZ' END) AS relative_path FROM documents)"""

CALLS = """
calls AS (SELECT event_id, concat('model_', cast(user_id % 5 AS varchar)) AS model_name, event_type <> 'error' AS success,
  cast(value AS decimal(18,4)) AS response_time, cast(json_extract_string(props, '$.k') AS int) AS complexity, ts FROM events)"""

# Every folder of every file, the top as '.'.
FOLDERS = """
anc AS (SELECT relative_path, size, unnest(['.', top, top||'/'||sub]) AS directory FROM inventory)"""


def _with(*views: str) -> str:
    return "WITH " + ",".join(views) + "\n"


SQL: dict[str, str] = {}

# Inventory ---------------------------------------------------------------------------------------
SQL["extension_stats"] = _with(INVENTORY) + """
SELECT repo, extension, count(*) AS n_files, cast(sum(size) AS bigint) AS total_size FROM inventory GROUP BY ALL"""
SQL["top_extensions"] = _with(INVENTORY) + """
SELECT extension, count(*) AS n_files, cast(sum(size) AS bigint) AS total_size FROM inventory
GROUP BY extension ORDER BY n_files DESC, extension LIMIT 4"""
SQL["directory_rollup"] = _with(INVENTORY, FOLDERS) + """
SELECT directory, count(*) AS file_count, cast(sum(size) AS bigint) AS total_size FROM anc GROUP BY directory"""
SQL["corpus_totals"] = _with(RAW) + """
SELECT (SELECT count(DISTINCT translate(relative_path,'/.-','___')) FROM raw) AS total_files,
  (SELECT count(DISTINCT translate(d,'/.-','___')) FROM (
     SELECT '.' AS d UNION ALL
     SELECT list_aggregate(list_slice(string_split(relative_path,'/'),1,cast(k AS bigint)),'string_agg','/')
     FROM raw, range(1,5) t(k) WHERE k < len(string_split(relative_path,'/')))) AS total_dirs"""
SQL["id_collisions"] = _with(RAW) + """
SELECT translate(relative_path,'/.-','___') AS file_id, count(*) AS n_paths, min(relative_path) AS first_path, max(relative_path) AS last_path
FROM raw GROUP BY 1 HAVING count(*) > 1"""
SQL["latest_per_id"] = _with(RAW) + """
SELECT translate(relative_path,'/.-','___') AS file_id, max(relative_path) AS relative_path FROM raw GROUP BY 1"""
SQL["admissible_files"] = _with(RAW) + """
SELECT relative_path, size FROM raw WHERE size <= 10485760
  AND NOT starts_with(relative_path,'.git/') AND NOT starts_with(relative_path,'node_modules/') AND NOT starts_with(relative_path,'build/')
  AND doc_id%8 NOT IN (0, 1)"""
SQL["path_columns"] = _with(RAW) + """
SELECT relative_path, translate(relative_path,'/.-','___') AS file_id,
  string_split(relative_path,'/')[-1] AS name,
  CASE WHEN contains(relative_path,'/') THEN array_to_string(list_slice(string_split(relative_path,'/'),1,-2),'/') ELSE '.' END AS parent,
  CASE doc_id%8 WHEN 0 THEN '' WHEN 1 THEN '.json' WHEN 2 THEN '.yaml' WHEN 3 THEN '.lock' WHEN 4 THEN '' WHEN 5 THEN '.py' WHEN 6 THEN '.py' ELSE '.gz' END AS extension,
  CASE doc_id%8 WHEN 0 THEN 'text' WHEN 1 THEN 'json' WHEN 2 THEN 'yaml' WHEN 3 THEN 'text' WHEN 4 THEN 'makefile' WHEN 5 THEN 'python' WHEN 6 THEN 'python' ELSE 'text' END AS language
FROM raw"""
SQL["browser_ids"] = _with(RAW) + """
SELECT relative_path, replace(replace(relative_path,'/','_'),'.','_') AS file_id FROM raw"""
SQL["flat_listing"] = _with(INVENTORY) + """
SELECT translate(relative_path,'/.-','___') AS file_id, relative_path, extension, size FROM inventory"""
SQL["flatten_nested"] = SQL["flat_listing"]
SQL["selection_totals"] = _with(INVENTORY, SELECTION) + """
SELECT count(*) AS selected_files, cast(sum(size) AS bigint) AS selected_size FROM inventory WHERE doc_id IN (SELECT doc_id FROM selection)"""
SQL["selected_per_extension"] = _with(INVENTORY, SELECTION) + """
SELECT extension, count(*) FILTER (doc_id IN (SELECT doc_id FROM selection)) AS n_selected, count(*) AS n_files FROM inventory GROUP BY 1"""
SQL["selected_per_directory"] = _with(INVENTORY, SELECTION) + """
SELECT directory, count(*) FILTER (sel) AS n_selected, count(*) AS n_visible FROM (
  SELECT unnest(['.', top, top||'/'||sub]) AS directory, doc_id IN (SELECT doc_id FROM selection) AS sel
  FROM inventory WHERE extension IN ('.js','.py','.html')) GROUP BY 1"""
SQL["directory_states"] = _with(INVENTORY, SELECTION) + """
SELECT directory, CASE WHEN bool_and(sel) THEN 'selected' WHEN bool_or(sel) THEN 'indeterminate' ELSE 'none' END AS state FROM (
  SELECT unnest(['.', top, top||'/'||sub]) AS directory, doc_id IN (SELECT doc_id FROM selection) AS sel FROM inventory) GROUP BY 1"""
SQL["extension_filter"] = _with(INVENTORY) + """
SELECT relative_path, size FROM inventory WHERE extension IN ('.css','.html')"""
SQL["tree_keys"] = _with(RAW) + """
SELECT relative_path, array_to_string(list_transform(string_split(relative_path,'/'), lambda p, i:
  CASE WHEN i = len(string_split(relative_path,'/')) THEN '1' ELSE '0' END || lower(p) || chr(2) || p), chr(1)) AS sort_key FROM raw"""
SQL["preview"] = """
SELECT doc_id, CASE WHEN length(text) >= 5000 THEN substr(text,1,5000)||chr(10)||chr(10)||'... (truncated)' ELSE text END AS preview
FROM documents WHERE strlen(text) <= 1048576"""
SQL["expanded_directories"] = _with(INVENTORY) + """
SELECT DISTINCT unnest(['.', top, top||'/'||sub]) AS directory FROM inventory WHERE contains(relative_path,'mod_1')"""
SQL["selection_edits"] = _with(INVENTORY, SELECTION) + """
SELECT relative_path FROM (SELECT relative_path FROM selection UNION SELECT relative_path FROM inventory WHERE starts_with(relative_path,'src3/'))
EXCEPT SELECT relative_path FROM inventory WHERE starts_with(relative_path,'src3/en/')"""
SQL["selection_replace"] = _with(INVENTORY) + """
SELECT relative_path FROM inventory WHERE starts_with(relative_path,'src3/')"""
SQL["snapshot_roundtrip"] = _with(INVENTORY) + "SELECT doc_id, relative_path, size FROM inventory"
SQL["language_codes"] = """
SELECT lang, regexp_full_match(lang,'[a-z]{2}(-[A-Z]{2})?') AS valid, count(*) AS n_docs FROM documents GROUP BY ALL"""
SQL["validate_ids"] = _with(INVENTORY) + """
SELECT item_id AS request_id, position, file_id FROM (
  SELECT item_id, 1 AS position, 'nope_'||item_id AS file_id FROM benchmark
  UNION ALL SELECT b.item_id, p, translate(i.relative_path,'/.-','___') FROM benchmark b, range(2,4) t(p), inventory i WHERE i.doc_id = b.item_id)
WHERE file_id IN (SELECT translate(relative_path,'/.-','___') FROM inventory)"""
SQL["human_sizes"] = """
SELECT doc_id, CASE WHEN s < 1024 THEN cast(cast(s AS decimal(18,2)) AS varchar)||' B'
  WHEN s < 1048576 THEN format('{:.2f} KB', s/1024) WHEN s < 1073741824 THEN format('{:.2f} MB', s/1048576)
  WHEN s < 1099511627776 THEN format('{:.2f} GB', s/1073741824) ELSE format('{:.2f} TB', s/1099511627776) END AS shown,
  CASE WHEN b IS NULL THEN '0 B' ELSE format('{:.2f} GB', b/1073741824) END AS shown_in_browser
FROM (SELECT doc_id, n_chars * cast(power(32, doc_id % 7) AS bigint) AS s,
  CASE WHEN doc_id % 5 > 0 THEN n_chars * 1099511627776 END AS b FROM documents)"""

# Names and search --------------------------------------------------------------------------------
NAMES = """
names AS (SELECT item_id, unnest(['MOD_'||item_id, 'src'||(item_id%20)||'/en', 'nope_'||item_id, 'js', 'd_'||(item_id%9)||'.p']) AS name FROM benchmark)"""
SQL["bulk_select"] = _with(INVENTORY, NAMES) + """
SELECT relative_path, name FROM inventory JOIN (SELECT DISTINCT name FROM names) ON contains(lower(relative_path), lower(name))"""
SQL["bulk_not_found"] = _with(INVENTORY, NAMES) + """
SELECT DISTINCT name FROM names WHERE NOT EXISTS (SELECT 1 FROM inventory WHERE contains(lower(relative_path), lower(name)))"""
SQL["priority_select"] = _with(INVENTORY, NAMES) + """
SELECT name, relative_path FROM (SELECT name, relative_path,
  row_number() OVER (PARTITION BY name ORDER BY top, sub, string_split(relative_path,'/')[-1]) AS r
  FROM inventory JOIN (SELECT DISTINCT name FROM names) ON contains(relative_path, name)) WHERE r = 1"""
SQL["name_list_parse"] = """
SELECT item_id, trim(u.name) AS name FROM benchmark, unnest(regexp_split_to_array(text, '[' || chr(10) || ',]')) AS u(name) WHERE trim(u.name) <> ''"""
SCORE = """
  CASE WHEN name = q THEN 100.0 WHEN contains(name, q) THEN 50.0 WHEN contains(path, q) THEN 25.0 ELSE 0.0 END
  + CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, list_distinct(regexp_extract_all(path,'[\\pL\\pN_]+')))) / len(qw) * 20.0 ELSE 0.0 END
  + CASE WHEN starts_with(path, q) THEN 10.0 ELSE 0.0 END"""
SQL["search_topk"] = _with(INVENTORY) + f"""
SELECT relative_path, cast({SCORE} AS double) AS match_score FROM (
  SELECT relative_path, lower(relative_path) AS path, string_split(lower(relative_path),'/')[-1] AS name, 'mod_1.ts js' AS q, ['mod_1','ts','js'] AS qw FROM inventory)
WHERE contains(path,'mod_1') OR contains(path,'ts') OR contains(path,'js') OR contains(path, q)
ORDER BY match_score DESC, relative_path LIMIT 50"""
SQL["search_many"] = _with(INVENTORY, """
qs AS (SELECT item_id*4 + k AS query_id, [ 'mod_'||item_id||'.js', 'Src'||(item_id%20)||'/en', 'ts fr mod_'||(item_id*3), '/' ][k+1] AS query FROM benchmark, range(4) t(k))""") + f"""
SELECT query_id, position, relative_path, match_score FROM (
  SELECT query_id, relative_path, match_score, row_number() OVER (PARTITION BY query_id ORDER BY match_score DESC, relative_path) AS position FROM (
    SELECT query_id, relative_path, cast({SCORE} AS double) AS match_score FROM (
      SELECT query_id, relative_path, lower(relative_path) AS path, string_split(lower(relative_path),'/')[-1] AS name, lower(query) AS q,
        list_distinct(regexp_extract_all(lower(query),'[\\pL\\pN_]+')) AS qw FROM inventory, qs)
    WHERE contains(path, q) OR len(list_filter(qw, lambda w: contains(path, w))) > 0)) WHERE position <= 50"""
SQL["inverted_index"] = _with(INVENTORY) + """
SELECT DISTINCT translate(relative_path,'/.-','___') AS file_id, unnest(list_append(regexp_extract_all(string_split(lower(relative_path),'/')[-1],'\\w+'), lower(relative_path))) AS term
FROM inventory"""
SQL["term_counts"] = "SELECT term, count(*) AS n_files FROM (" + SQL["inverted_index"] + ") GROUP BY term"
SQL["missing_suggestions"] = _with(INVENTORY, """
miss AS (SELECT 'lost/'||CASE doc_id % 4 WHEN 0 THEN 'mod_'||doc_id||'.ts' WHEN 1 THEN 'mod_'||doc_id||'.html' WHEN 2 THEN 'd_'||doc_id||'.' ELSE 'old_mod_'||doc_id||'.py' END AS missing_path FROM documents
  UNION SELECT relative_path FROM inventory UNION SELECT 'q/zzz.rs')""", """
cand AS (SELECT missing_path, relative_path, CASE WHEN fname = mname THEN 0.8 ELSE 0.5 END AS confidence,
    row_number() OVER (PARTITION BY missing_path ORDER BY top, sub, fname) AS r
  FROM (SELECT missing_path, string_split(missing_path,'/')[-1] AS mname FROM miss WHERE missing_path NOT IN (SELECT relative_path FROM inventory)) m
  JOIN (SELECT relative_path, top, sub, string_split(relative_path,'/')[-1] AS fname FROM inventory) f ON contains(fname, mname) OR contains(mname, fname))""") + """
SELECT missing_path, suggested_path, cast(confidence AS double) AS confidence,
  CASE confidence WHEN 1.0 THEN 'Exact path match found' WHEN 0.8 THEN 'Filename matches: '||suggested_path WHEN 0.5 THEN 'Similar filename: '||suggested_path ELSE 'File not found' END AS reason
FROM (SELECT missing_path, CASE WHEN i.relative_path IS NOT NULL THEN missing_path ELSE c.relative_path END AS suggested_path,
    CASE WHEN i.relative_path IS NOT NULL THEN 1.0 ELSE coalesce(c.confidence, 0.0) END AS confidence
  FROM miss LEFT JOIN inventory i ON i.relative_path = missing_path LEFT JOIN cand c USING (missing_path) WHERE c.r = 1 OR c.r IS NULL)"""
SQL["highlight"] = """
SELECT doc_id, regexp_replace(text, '(?i)(la)', '<mark>\\1</mark>', 'g') AS marked FROM documents"""
SQL["escape_html"] = """
SELECT page_id, replace(replace(replace(replace(replace(html,'&','&amp;'),'<','&lt;'),'>','&gt;'),'"','&quot;'),'''','&#039;') AS escaped FROM pages"""

# Import graph ------------------------------------------------------------------------------------
IMPORTS = """
found AS (SELECT DISTINCT relative_path, top, sub, unnest(list_concat(regexp_extract_all(content, 'import\\s+.*?\\s+from\\s+[''"]([^''"]+)[''"]', 1),
    regexp_extract_all(content, 'require\\([''"]([^''"]+)[''"]\\)', 1))) AS imp FROM src WHERE extension IN ('.js','.ts','.jsx'))"""
EDGES = """
resolved AS (SELECT f.relative_path, f.imp, t.relative_path AS target FROM found f
  JOIN src t ON t.stem = replace(f.imp,'../../','') AND t.extension IN ('.js','.ts','.jsx') WHERE starts_with(f.imp,'.')),
edges AS (SELECT relative_path AS src, target AS dst FROM resolved WHERE relative_path <> target)"""
NODES = """
nodes AS (SELECT s.relative_path, s.top, s.sub, coalesce(o.n, 0) AS n_dependencies, coalesce(i.n, 0) AS n_dependents,
    s.extension AS file_type, string_split(s.relative_path,'/')[-1] AS label, i.n IS NULL AS is_entry_point, o.n IS NULL AS is_leaf
  FROM src s LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY 1) o ON o.src = s.relative_path
  LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY 1) i ON i.dst = s.relative_path)"""
GRAPH = (SRC, IMPORTS, EDGES)
CHOSEN = (INVENTORY, SELECTION)
SQL["file_imports"] = _with(SRC, IMPORTS) + """
SELECT relative_path, imp AS "import" FROM found WHERE imp LIKE '.%' OR imp LIKE '@%' OR contains(imp,'/')
UNION ALL SELECT relative_path, unnest(['os','pkg.m'||(doc_id%11)]) FROM src WHERE extension = '.py'"""
SQL["file_exports"] = _with(SRC) + """
SELECT relative_path, 'f'||doc_id AS "export" FROM src WHERE extension IN ('.js','.ts','.jsx')
UNION ALL SELECT DISTINCT relative_path, unnest(list_concat(regexp_extract_all(content,'(?m)^\\s*def\\s+(\\w+)',1), regexp_extract_all(content,'(?m)^\\s*class\\s+(\\w+)',1)))
FROM src WHERE extension = '.py'"""
SQL["import_edges"] = _with(*GRAPH) + "SELECT src, dst FROM edges"
SQL["selected_edges"] = _with(*CHOSEN, *GRAPH) + """
SELECT src, dst FROM edges WHERE src IN (SELECT relative_path FROM selection) AND dst IN (SELECT relative_path FROM selection)"""
SQL["missing_deps"] = _with(*CHOSEN, *GRAPH) + """
SELECT relative_path AS required_by, imp AS missing_import, target AS suggested_file, cast(1.0 AS double) AS confidence, 'Exact path match found' AS reason
FROM resolved WHERE relative_path IN (SELECT relative_path FROM selection) AND target NOT IN (SELECT relative_path FROM selection)"""
SQL["graph_degrees"] = _with(*GRAPH, NODES) + """
SELECT relative_path, n_dependencies, n_dependents, file_type, label, is_entry_point, is_leaf FROM nodes"""
SQL["graph_metrics"] = _with(*GRAPH, NODES) + """
SELECT count(*) AS total_files, count(*) FILTER (is_entry_point) AS entry_points, count(*) FILTER (is_leaf) AS leaf_nodes,
  round(avg(n_dependencies), 2) AS average_dependencies, max(n_dependencies) AS max_dependencies,
  (SELECT relative_path FROM nodes ORDER BY n_dependents DESC, top, sub, label LIMIT 1) AS most_dependent_file,
  max(n_dependents) AS dependent_count, round(sum(n_dependencies) / (count(*) * (count(*) - 1)) * 100, 2) AS coupling_score FROM nodes"""
SQL["completeness"] = _with(*CHOSEN, *GRAPH) + """
SELECT s AS n_selected, m AS n_missing, round(s / (s + m) * 100, 2) AS completeness_score,
  CASE WHEN round(s / (s + m) * 100, 2) >= 90 THEN 'high' WHEN round(s / (s + m) * 100, 2) >= 70 THEN 'medium' ELSE 'low' END AS band
FROM (SELECT (SELECT count(*) FROM selection) AS s, (SELECT count(*) FROM resolved WHERE relative_path IN (SELECT relative_path FROM selection)
  AND target NOT IN (SELECT relative_path FROM selection)) AS m)"""
SQL["graph_roles"] = _with(*GRAPH, NODES) + "SELECT relative_path FROM nodes WHERE is_leaf"
SQL["graph_role_edges"] = _with(*GRAPH) + """
SELECT src, dst FROM edges WHERE src IN (SELECT dst FROM edges)"""
SQL["graph_search"] = _with(*GRAPH, NODES) + "SELECT relative_path, label FROM nodes WHERE relative_path ILIKE '%FR/mod\\_1%' ESCAPE '\\'"
SQL["graph_neighbourhood"] = _with(*CHOSEN, *GRAPH) + """
SELECT DISTINCT relative_path AS node, src, dst FROM edges JOIN selection ON relative_path = src OR relative_path = dst"""
SQL["neighbour_labels"] = _with(*GRAPH) + """
SELECT node, side, array_to_string(list_slice(list(label ORDER BY label, other), 1, 5), ',') AS labels, greatest(count(*) - 5, 0) AS n_more FROM (
  SELECT node, side, other, string_split(other,'/')[-1] AS label FROM (
    SELECT src AS node, 'dependencies' AS side, dst AS other FROM edges UNION ALL SELECT dst, 'dependents', src FROM edges)) GROUP BY node, side"""
SQL["graph_export"] = _with(*GRAPH) + """
SELECT translate(src,'/.-','___') AS source, translate(dst,'/.-','___') AS target FROM edges"""
SQL["graph_export_nodes"] = _with(*GRAPH, NODES) + """
SELECT translate(relative_path,'/.-','___') AS id, label, relative_path AS path, file_type AS type, is_entry_point, is_leaf,
  n_dependencies AS dependency_count, n_dependents AS dependent_count FROM nodes"""
SQL["report_roundtrip"] = _with(*CHOSEN, *GRAPH) + """
SELECT 'edge' AS kind, src AS source, dst AS target FROM edges WHERE src IN (SELECT relative_path FROM selection) AND dst IN (SELECT relative_path FROM selection)
UNION ALL SELECT 'missing', relative_path, target FROM resolved WHERE relative_path IN (SELECT relative_path FROM selection) AND target NOT IN (SELECT relative_path FROM selection)"""
SQL["dependency_report"] = _with(*CHOSEN, *GRAPH) + """
SELECT relative_path, (SELECT count(*) FROM edges WHERE src = s.relative_path AND dst IN (SELECT relative_path FROM selection)) AS n_dependencies,
  (SELECT count(*) FROM edges WHERE dst = s.relative_path AND src IN (SELECT relative_path FROM selection)) AS n_dependents,
  (SELECT count(*) FROM resolved r WHERE r.relative_path = s.relative_path AND target NOT IN (SELECT relative_path FROM selection)) AS n_missing FROM selection s"""
_SEED = "(SELECT relative_path FROM src WHERE doc_id = 0)"
SQL["reachability"] = "WITH RECURSIVE " + ",".join(GRAPH) + f""",
ahead AS (SELECT {_SEED} AS node UNION SELECT dst FROM ahead JOIN edges ON src = node),
behind AS (SELECT {_SEED} AS node UNION SELECT src FROM behind JOIN edges ON dst = node)
SELECT node, 'forward' AS direction FROM ahead UNION ALL SELECT node, 'backward' FROM behind"""
SQL["dependency_closure"] = "WITH RECURSIVE " + ",".join((*CHOSEN, *GRAPH)) + """,
grown AS (SELECT relative_path FROM selection UNION SELECT dst FROM grown JOIN edges ON src = relative_path)
SELECT relative_path FROM grown"""
CYCLES = """
e AS (SELECT DISTINCT src, dst FROM edges),
walk AS (SELECT src AS root, dst AS last, [src, dst] AS path FROM e WHERE dst > src
  UNION ALL SELECT root, dst, list_append(path, dst) FROM walk JOIN e ON src = last WHERE dst > root AND NOT list_contains(path, dst)),
cyc AS (SELECT path FROM walk JOIN e ON src = last AND dst = root)"""
SQL["import_cycles"] = "WITH RECURSIVE " + ",".join((*GRAPH, CYCLES)) + " SELECT array_to_string(path,' ') AS cycle FROM cyc"
SQL["cycle_paths"] = "WITH RECURSIVE " + ",".join((*GRAPH, CYCLES)) + """
SELECT path[1] AS "first", cast(k - 1 AS int) AS position, path[k] AS member, string_split(path[k],'/')[-1] AS label
FROM (SELECT path, unnest(range(1, len(path) + 1)) AS k FROM cyc)"""
SQL["hierarchy"] = "WITH RECURSIVE " + ",".join((*CHOSEN, *GRAPH)) + """,
e AS (SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT relative_path FROM selection) AND dst IN (SELECT relative_path FROM selection)),
walk AS (SELECT [relative_path] AS path, relative_path AS node, 0 AS depth, false AS repeated FROM selection
    WHERE relative_path NOT IN (SELECT dst FROM e)
  UNION ALL SELECT list_append(path, dst), dst, depth + 1, list_contains(path, dst) FROM walk JOIN e ON src = node WHERE NOT repeated)
SELECT array_to_string(path,' ') AS path, node, depth, repeated FROM walk"""

# Structure ---------------------------------------------------------------------------------------
# Scripts of the derived view have four functions of known shape; the second one's text ends at
# the brace that closes its destructured parameter.
SQL["js_functions"] = _with(SRC) + r"""
SELECT relative_path, name, type, purpose, api_calls, dom_interactions, flow, lines FROM (
  SELECT relative_path, 'f'||doc_id AS name, 'sync' AS type, 'Processing logic' AS purpose, '/api/'||(doc_id%9) AS api_calls, '' AS dom_interactions,
    'conditional → async_call → return' AS flow, 1 AS lines FROM src WHERE extension IN ('.js','.jsx')
  UNION ALL SELECT relative_path, 'load'||(doc_id%7), 'async', 'Processing logic', '', '', 'simple_execution', 1 FROM src WHERE extension IN ('.js','.jsx')
  UNION ALL SELECT relative_path, 'go'||doc_id, 'sync', 'walk '||top, '', '#n'||(doc_id%3), 'iteration → return', 3 FROM src WHERE extension IN ('.js','.jsx')
  UNION ALL SELECT relative_path, 'h'||doc_id, 'arrow', 'Arrow function', NULL, NULL, NULL, 1 FROM src WHERE extension IN ('.js','.jsx'))"""
SQL["js_event_handlers"] = _with(SRC) + r"""
SELECT relative_path, 0 AS position, regexp_extract(content, '(\w+)\.addEventListener', 1)||'→'||regexp_extract(content, 'addEventListener\(''(\w+)''', 1) AS handler
FROM src WHERE extension IN ('.js','.jsx')"""
SQL["js_globals"] = _with(SRC) + r"""
SELECT DISTINCT relative_path, unnest(regexp_extract_all(split_part(content,'function',1), '\b(?:let|const)\s+(\w+)', 1)) AS name FROM src WHERE extension IN ('.js','.jsx')"""
SQL["css_components"] = _with(SRC, r"""
rules AS (SELECT relative_path, unnest(regexp_extract_all(content,'\.([a-zA-Z0-9_-]+)\s*\{([^}]+)\}',1)) AS class_name,
    unnest(regexp_extract_all(content,'\.([a-zA-Z0-9_-]+)\s*\{([^}]+)\}',2)) AS props,
    unnest(range(len(regexp_extract_all(content,'\.([a-zA-Z0-9_-]+)\s*\{([^}]+)\}',1)))) AS seq FROM src WHERE extension = '.css')""") + r"""
SELECT relative_path, class_name, arg_max(display, seq) AS display, arg_max(background, seq) AS background, arg_max(spacing, seq) AS spacing FROM (
  SELECT relative_path, class_name, seq, nullif(trim(regexp_extract(props,'display:\s*([^;]+)',1)),'') AS display,
    nullif(trim(regexp_extract(props,'background[^:]*:\s*([^;]+)',1)),'') AS background,
    CASE WHEN contains(props,'padding') OR contains(props,'margin') THEN 'custom' END AS spacing,
    max(seq) OVER (PARTITION BY relative_path, class_name) AS last_seq
  FROM rules WHERE contains(props,'display:') OR contains(props,'background') OR contains(props,'padding') OR contains(props,'margin')) WHERE seq = last_seq
GROUP BY relative_path, class_name"""
SQL["css_tokens"] = _with(SRC) + r"""
SELECT relative_path, array_to_string(list_sort(list_distinct(regexp_extract_all(content,'#[0-9a-fA-F]{3,6}|rgba?\([^)]+\)'))),' ') AS colors,
  'rem-based ('||list_min(regexp_extract_all(content,'\d+(?:\.\d+)?rem'))||' to '||list_max(regexp_extract_all(content,'\d+(?:\.\d+)?rem'))||')' AS spacing,
  trim(regexp_extract(content,'font-family:\s*([^;]+)',1)) AS typography FROM src WHERE extension = '.css'"""
SQL["css_media"] = _with(SRC) + r"""
SELECT relative_path, 0 AS position, regexp_extract(content,'@media\s*([^{]+)',1) AS media_query FROM src WHERE extension = '.css'"""
SQL["py_classes"] = _with(SRC) + r"""
SELECT relative_path, regexp_extract(content,'class\s+(\w+)',1) AS class_name, array_to_string(list_sort(list_distinct(regexp_extract_all(split_part(content, chr(10)||'@app',1),'self\.(\w+)\s*=',1))),',') AS attributes
FROM src WHERE extension = '.py'"""
SQL["py_methods"] = _with(SRC, r"""
m AS (SELECT relative_path, regexp_extract(content,'class\s+(\w+)',1) AS class_name, split_part(substr(content, strpos(content,'def run')), chr(10)||'@app', 1) AS body FROM src WHERE extension = '.py')""") + r"""
SELECT relative_path, class_name, 'run' AS method, trim(regexp_extract(body,'#\s*(.+)',1)) AS purpose,
  concat_ws(' + ', CASE WHEN regexp_matches(body,'\b(for|while)\b') THEN 'loop' END, CASE WHEN regexp_matches(body,'\bif\b') THEN 'conditional' END,
    CASE WHEN regexp_matches(body,'\breturn\b') THEN 'return' END) AS logic, cast(len(string_split(body, chr(10))) AS int) AS lines FROM m"""
SQL["py_routes"] = _with(SRC) + r"""
SELECT relative_path, regexp_extract(content,'@app\.route\(''([^'']+)''',1) AS route, 'POST' AS method, 'simple_execution' AS flow, 'Unknown' AS returns FROM src WHERE extension = '.py'"""
SQL["py_imports"] = _with(SRC) + r"""
SELECT relative_path, unnest([0, 1]) AS position, unnest(['os'||chr(10)||'from pkg', 'g'||chr(10)||'class C'||doc_id]) AS "import" FROM src WHERE extension = '.py'"""
SQL["html_tags"] = r"""
SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html,'<([\pL\pN_]+)',1)) AS tag FROM pages) GROUP BY ALL"""
SQL["html_links"] = r"""
SELECT page_id, unnest(['script','style']) AS kind, unnest(['/s'||page_id||'.js', url]) AS target FROM pages"""
SQL["generic_summary"] = _with(SRC) + r"""
SELECT relative_path, 'typescript' AS type, len(string_split(content, chr(10))) AS total_lines, length(content) AS size FROM src WHERE extension = '.ts'"""
SQL["structure_complexity"] = _with(SRC) + r"""
SELECT relative_path, CASE extension WHEN '.py' THEN 2 ELSE 4 END AS complexity_score FROM src WHERE extension IN ('.js','.jsx','.py')"""
SQL["structure_summaries"] = _with(SRC) + r"""
SELECT relative_path, CASE extension WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'jsx' WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.css' THEN 'css' ELSE 'html' END AS language,
  length(content) AS n_chars, CASE extension WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.css' THEN 'css' ELSE 'html' END AS type,
  len(string_split(content, chr(10))) AS total_lines, CASE WHEN extension = '.py' THEN 2 WHEN extension IN ('.js','.jsx') THEN 4 END AS complexity_score,
  CASE WHEN extension = '.ts' THEN length(content) END AS size FROM src"""

# Bundles and archives ----------------------------------------------------------------------------
REQUESTS = r"""
requests AS (SELECT top AS bundle_id, doc_id + 1 AS position, CASE WHEN doc_id % 10 = 9 THEN 'gone/'||doc_id ELSE relative_path END AS relative_path FROM inventory)"""
SECTIONS = r"""
sections AS (SELECT r.bundle_id, r.position, s.relative_path, s.extension, s.content, concat(
    chr(10), '## ', s.relative_path, chr(10), chr(10), '**File Size:** ', CASE WHEN strlen(s.content) < 1024 THEN format('{:.2f} B', cast(strlen(s.content) AS double)) ELSE format('{:.2f} KB', strlen(s.content)/1024) END, '  ', chr(10),
    '**Last Modified:** ', strftime(timestamp '2024-01-01 00:00:00' + to_minutes(s.doc_id), '%Y-%m-%d %H:%M:%S'), '  ', chr(10), chr(10),
    repeat(chr(96),3), CASE s.extension WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'jsx' WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.css' THEN 'css' ELSE 'html' END, chr(10),
    s.content, chr(10), repeat(chr(96),3), chr(10), chr(10), '---') AS text FROM requests r JOIN src s ON s.relative_path = r.relative_path),
toc AS (SELECT bundle_id, position, position||'. ['||r.relative_path||'](#'||translate(r.relative_path,'/.-','___')||')' AS text
  FROM requests r WHERE r.relative_path IN (SELECT relative_path FROM inventory))"""
SQL["bundle_sections"] = _with(INVENTORY, SRC, REQUESTS, SECTIONS) + "SELECT bundle_id, position, relative_path, text FROM sections"
SQL["bundle_contents"] = _with(INVENTORY, SRC, REQUESTS, SECTIONS) + "SELECT bundle_id, position, text FROM toc"


_HEAD = (
    "'# Aggregated Source Code'||chr(10)||chr(10)||'**Generated at:** 2024-01-01 00:00:00'||chr(10)||'**Root Directory:** `corpus`'||chr(10)"
    "||'**Total Files:** '||n||chr(10)||'**Compression Type:** {mode}'||chr(10)||chr(10)||'## Table of Contents'||chr(10)"
)
# Whole documents of the bundles, joined in order.
WHOLE = f"""
whole AS (SELECT bundle_id, n AS file_count, concat({_HEAD.format(mode='none')}, chr(10)||t, chr(10)||chr(10)||'---'||chr(10), chr(10)||s) AS md FROM
  (SELECT bundle_id, count(*) AS n FROM requests GROUP BY 1)
  LEFT JOIN (SELECT bundle_id, string_agg(text, chr(10) ORDER BY position) AS t FROM toc GROUP BY 1) USING (bundle_id)
  LEFT JOIN (SELECT bundle_id, string_agg(text, chr(10) ORDER BY position) AS s FROM sections GROUP BY 1) USING (bundle_id))"""
SQL["bundle_manifest"] = _with(INVENTORY, SRC, REQUESTS, SECTIONS, WHOLE) + """
SELECT bundle_id, 'source_code_none_20240101_000000.md' AS filename, length(md) AS size, file_count, 'none' AS compression_type FROM whole"""
SQL["semantic_metadata"] = f"""
WITH f AS (SELECT source AS bundle_id, doc_id, concat(source,'/doc_',cast(doc_id AS varchar),'.txt') AS path, text FROM documents),
docs AS (SELECT bundle_id, doc_id||'. ['||path||'](#'||translate(path,'/.-','___')||')' AS toc, concat(chr(10), '## ', path, chr(10), chr(10), '**File Size:** ',
    CASE WHEN strlen(text) < 1024 THEN format('{{:.2f}} B', cast(strlen(text) AS double)) ELSE format('{{:.2f}} KB', strlen(text)/1024) END, '  ', chr(10),
    '**Last Modified:** ', strftime(timestamp '2024-01-01 00:00:00' + to_minutes(doc_id), '%Y-%m-%d %H:%M:%S'), '  ', chr(10), chr(10),
    repeat(chr(96),3), 'text', chr(10), text, chr(10), repeat(chr(96),3), chr(10), chr(10), '---') AS section,
    '{{"file":"'||path||'","type":"text","total_lines":'||len(string_split(text,chr(10)))||',"size":'||length(text)||',"summary":"Generic text file"}}' AS summary FROM f),
g AS (SELECT bundle_id, count(*) AS n, string_agg(toc, chr(10)) AS t, string_agg(section, chr(10)) AS s, 2 + length(string_agg(summary, ',')) AS c FROM docs GROUP BY 1)
SELECT bundle_id, o AS original_size, c AS compressed_size, n AS files_count, round(c / o * 100, 2) AS compression_ratio, 'semantic_lossy' AS compression_type
FROM (SELECT *, length(concat({_HEAD.format(mode='semantic')}, chr(10), t, chr(10)||chr(10)||'---'||chr(10), chr(10), s)) AS o FROM g)"""
SUMMARISED = """
f AS (SELECT source AS bundle_id, doc_id AS position, concat(source,'/doc_',cast(doc_id AS varchar),'.txt') AS path, text AS content FROM documents),
summed AS (SELECT bundle_id, position, content,
  '{"file":"'||path||'","type":"text","total_lines":'||len(string_split(content,chr(10)))||',"size":'||length(content)||',"summary":"Generic text file"}' AS text FROM f)"""
SQL["bundle_semantic"] = _with(SUMMARISED) + "SELECT bundle_id, position, text FROM summed"
SQL["bundle_hybrid"] = _with(SUMMARISED) + """
SELECT bundle_id, position, text AS structure, left(sha256(content), 16) AS hash, concat('original_', left(sha256(content), 16), '.md') AS filename,
  content AS original_content FROM summed"""
SQL["bundle_manifest_semantic"] = _with(SUMMARISED) + """
SELECT bundle_id, 'source_code_semantic_20240101_000000.json' AS filename, cast(sum(length(text)) + count(*) + 1 AS bigint) AS size, count(*) AS file_count,
  'semantic' AS compression_type FROM summed GROUP BY bundle_id"""
SQL["bundle_files_markdown"] = f"""
WITH docs AS (SELECT source||'_'||doc_id // 1000 AS bundle_id, doc_id, concat(source,'/doc_',cast(doc_id AS varchar),'.txt') AS path, text FROM documents),
parts AS (SELECT bundle_id, doc_id, doc_id||'. ['||path||'](#'||translate(path,'/.-','___')||')' AS toc, concat(chr(10), '## ', path, chr(10), chr(10), '**File Size:** ',
    CASE WHEN strlen(text) < 1024 THEN format('{{:.2f}} B', cast(strlen(text) AS double)) ELSE format('{{:.2f}} KB', strlen(text)/1024) END, '  ', chr(10),
    '**Last Modified:** ', strftime(timestamp '2024-01-01 00:00:00' + to_minutes(doc_id), '%Y-%m-%d %H:%M:%S'), '  ', chr(10), chr(10),
    repeat(chr(96),3), 'text', chr(10), text, chr(10), repeat(chr(96),3), chr(10), chr(10), '---') AS section FROM docs),
g AS (SELECT bundle_id, count(*) AS n, string_agg(toc, chr(10) ORDER BY doc_id) AS t, string_agg(section, chr(10) ORDER BY doc_id) AS s FROM parts GROUP BY 1),
whole AS (SELECT bundle_id, concat({_HEAD.format(mode='none')}, chr(10), t, chr(10)||chr(10)||'---'||chr(10), chr(10), s) AS md FROM g)
SELECT bundle_id, length(md) AS size, sha256(md) AS sha256 FROM whole"""
SQL["bundle_files_json"] = _with(SUMMARISED) + """
SELECT bundle_id||'_'||position // 1000 AS bundle_id, text AS structure, left(sha256(content), 16) AS hash,
  concat('original_', left(sha256(content), 16), '.md') AS filename, content AS original_content FROM summed"""
SQL["bundle_manifest_hybrid"] = """
SELECT source AS bundle_id, 'source_code_hybrid_20240101_000000.json' AS filename, count(*) AS file_count, 'hybrid' AS compression_type FROM documents GROUP BY 1"""
SQL["bundle_parse"] = """
SELECT doc_id, 0 AS position, 'a/'||doc_id||'.js' AS file, 'javascript' AS language, 'let x = '||doc_id AS code FROM documents
UNION ALL SELECT doc_id, 2, 'b '||doc_id||'.md', 'md', text FROM documents"""
SQL["bundle_one_file"] = "SELECT doc_id, text AS code FROM documents"
SQL["bundle_invalid"] = """
SELECT doc_id, 'Invalid markdown format' AS error, length(text) AS original_size FROM documents WHERE doc_id % 2 = 1"""
SQL["content_hash_dedup"] = """
SELECT DISTINCT substr(sha256(text),1,16) AS hash, 'original_'||substr(sha256(text),1,16)||'.md' AS filename, substr(sha256(text),1,2) AS prefix, text AS content FROM documents"""
SQL["content_store_add"] = """
SELECT DISTINCT substr(sha256(text),1,16) AS hash, length(text) AS n_chars FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en')"""
SQL["archive_roundtrip"] = "SELECT doc_id, text AS content, substr(sha256(text),1,16) AS hash FROM documents"
HYBRID = """
h AS (SELECT doc_id, lang, length(text) AS original_size, length('{"lang":"'||lang||'"}') AS compressed_size, text FROM documents)"""
SQL["hybrid_records"] = _with(HYBRID) + """
SELECT doc_id, substr(sha256(text),1,16) AS hash, 'original_'||substr(sha256(text),1,16)||'.md' AS filename, original_size, compressed_size,
  CASE WHEN original_size > 0 THEN round(compressed_size / original_size * 100, 2) ELSE 0.0 END AS compression_ratio, 'hybrid' AS compression_type FROM h"""
SQL["archive_restore"] = """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text WHEN doc_id % 4 = 3 THEN NULL WHEN kept OR doc_id % 8 < 4 THEN text END AS content,
  CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 3 THEN 'Cannot decompress semantic compression' WHEN (kept OR doc_id % 8 < 4) AND text <> '' THEN NULL ELSE 'Original file not found' END AS error
FROM (SELECT doc_id, text, text IN (SELECT text FROM documents WHERE lang = 'en') AS kept FROM documents)"""
SQL["size_reduction"] = _with(HYBRID) + """
SELECT lang, o AS original_size, c AS compressed_size, round(c / o * 100, 2) AS compression_ratio, o - c AS saved,
  CASE WHEN o - c < 1024 THEN format('{:.2f} B', cast(o - c AS double)) WHEN o - c < 1048576 THEN format('{:.2f} KB', (o - c)/1024) ELSE format('{:.2f} MB', (o - c)/1048576) END AS saved_shown
FROM (SELECT lang, cast(sum(original_size) AS bigint) AS o, cast(sum(compressed_size) AS bigint) AS c FROM h GROUP BY lang)"""
SQL["retention"] = _with(INVENTORY) + """
SELECT relative_path, last_modified < timestamp '2024-01-01 06:00:00' AS expired FROM inventory"""
SQL["retention_kept"] = _with(INVENTORY) + """
SELECT relative_path, size FROM inventory WHERE last_modified >= timestamp '2024-01-01 06:00:00'"""
SQL["store_retention"] = """
SELECT DISTINCT left(sha256(text), 16) AS hash, concat('original_', left(sha256(text), 16), '.md') AS filename, length(text) AS n_chars
FROM documents WHERE timestamp '2024-01-01 00:00:00' + to_minutes(doc_id) >= timestamp '2024-01-01 01:00:00'"""
SQL["source_tree"] = _with(INVENTORY) + r"""
SELECT 'corpus' AS repo, relative_path, string_split(relative_path, '/')[-1] AS name, strlen(text) AS size,
  sha256(regexp_replace(text, '\r\n?', chr(10), 'g')) AS sha256 FROM inventory JOIN documents USING (doc_id)"""
SQL["source_tree_filtered"] = _with(INVENTORY) + """
SELECT relative_path, strlen(text) AS size, strlen(text) AS n_bytes FROM inventory JOIN documents USING (doc_id)
WHERE extension NOT IN ('.py', '.html') AND strlen(text) > 500"""
SQL["source_tree_folders"] = """
SELECT '.' AS directory, 'corpus' AS name UNION SELECT source, source FROM documents UNION SELECT concat(source,'/',lang), lang FROM documents"""
SQL["encoding_audit"] = """
SELECT CASE doc_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16' ELSE 'unknown' END AS encoding, count(*) AS n_files FROM documents GROUP BY 1"""
SQL["decoded_content"] = """
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN text||chr(65533)||' ' ELSE text END AS content FROM documents"""

# Checks ------------------------------------------------------------------------------------------


def _count(column: str, char: str) -> str:
    return f"(length({column}) - length(replace({column},'{char}','')))"


def _mismatch(column: str, kinds) -> str:
    whens = " ".join(
        f"WHEN {_count(column, o)} <> {_count(column, c)} THEN 'Mismatched {n}: '||{_count(column, o)}||' vs '||{_count(column, c)}"
        for n, o, c in kinds
    )
    return f"CASE {whens} ELSE 'Syntax appears valid' END"


_KINDS = [("braces", "{", "}"), ("parentheses", "(", ")"), ("brackets", "[", "]")]
SQL["bracket_balance"] = f"""
SELECT page_id, message = 'Syntax appears valid' AS valid, message FROM (SELECT page_id, {_mismatch('html', _KINDS)} AS message FROM pages)"""
SQL["style_balance"] = _with(SRC) + f"""
SELECT relative_path, message = 'Syntax appears valid' AS valid, message FROM (
  SELECT relative_path, {_mismatch('c', _KINDS[:1])} AS message FROM (SELECT relative_path, regexp_replace(content,'(?s)/\\*.*?\\*/','','g')||CASE WHEN doc_id % 3 = 0 THEN '{{' ELSE '' END AS c FROM src))"""
SQL["python_syntax"] = _with(SRC) + "SELECT relative_path, doc_id % 4 <> 3 AS valid FROM src WHERE extension = '.py'"
SQL["required_paths"] = _with(INVENTORY, REQUESTS) + """
SELECT relative_path, relative_path IN (SELECT relative_path FROM inventory) AS found FROM requests"""
RULES = """
rules AS (SELECT relative_path, unnest(['import','la','/api/'||(position%5)]) AS element FROM requests),
absent AS (SELECT r.relative_path, CASE WHEN s.content IS NULL THEN 'File not found' ELSE element END AS missing
  FROM rules r LEFT JOIN src s USING (relative_path) WHERE s.content IS NULL OR NOT contains(s.content, element))"""
SQL["absent_elements"] = _with(INVENTORY, SRC, REQUESTS, RULES) + "SELECT relative_path, missing FROM absent"
SQL["element_status"] = _with(INVENTORY, SRC, REQUESTS, RULES) + """
SELECT relative_path, count(DISTINCT missing) AS n_missing, count(DISTINCT missing) = 0 AS valid
FROM (SELECT DISTINCT relative_path FROM requests) LEFT JOIN absent USING (relative_path) GROUP BY 1"""
SQL["diagram_blocks"] = """
SELECT doc_id, 0 AS block, 'graph TD'||chr(10)||'  a'||doc_id||' --> b' AS diagram FROM documents UNION ALL SELECT doc_id, 1, 'pie' FROM documents"""
SQL["diagram_to_lines"] = """
SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"""
DIAGRAMS = r"""
dl AS (SELECT source AS diagram_id, doc_id AS line_no, trim(CASE (doc_id * 7 + doc_id // 20) % 12
    WHEN 0 THEN 'subgraph S_'||doc_id WHEN 1 THEN '  n'||(doc_id%40)||'['||lang||']' WHEN 2 THEN 'n'||doc_id||'(r) --> n'||(doc_id+1)
    WHEN 3 THEN 'end' WHEN 4 THEN 'n'||(doc_id%40)||' --> x.'||doc_id||' label' WHEN 5 THEN 'classDef c'||doc_id||' fill:#f9f,stroke:#12,bare,stroke-width:x2,'
    WHEN 6 THEN 'classDef a fill:red classDef b' WHEN 7 THEN 'n'||doc_id||'-->n1' WHEN 8 THEN '%% note '||doc_id
    WHEN 9 THEN 'n'||(doc_id%40)||'_'||(doc_id%3)||'{open[}' WHEN 10 THEN 'subgraph bad name'||doc_id ELSE 'pie --> graph '||doc_id END) AS line,
  (doc_id * 7 + doc_id // 20) % 12 AS k FROM documents),
defs AS (SELECT diagram_id, line_no, regexp_extract(line,'^([a-zA-Z_][a-zA-Z0-9_]*)[\[({]',1) AS node FROM dl WHERE k IN (1,2,9)),
firsts AS (SELECT diagram_id, node, min(line_no) AS first_line FROM defs GROUP BY ALL),
dup AS (SELECT d.diagram_id, d.line_no, d.node FROM defs d JOIN firsts f ON f.diagram_id = d.diagram_id AND f.node = d.node AND d.line_no > f.first_line),
blocks AS (SELECT diagram_id, line_no, CASE WHEN k = 3 THEN -1 ELSE 1 END AS delta FROM dl WHERE k IN (0,3,10)),
fwd AS (SELECT *, sum(delta) OVER (PARTITION BY diagram_id ORDER BY line_no) AS s FROM blocks),
fwd2 AS (SELECT *, coalesce(min(s) OVER (PARTITION BY diagram_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM fwd),
ends AS (SELECT diagram_id, line_no FROM fwd2 WHERE delta = -1 AND s < least(low, 0)),
bwd AS (SELECT *, sum(-delta) OVER (PARTITION BY diagram_id ORDER BY line_no DESC) AS s FROM blocks),
bwd2 AS (SELECT *, coalesce(min(s) OVER (PARTITION BY diagram_id ORDER BY line_no DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM bwd),
opens AS (SELECT diagram_id, line_no FROM bwd2 WHERE delta = 1 AND s < least(low, 0)),
arrow AS (SELECT diagram_id, line_no, 'source' AS side, CASE k WHEN 2 THEN 'n'||line_no||'(r)' WHEN 4 THEN 'n'||(line_no%40) ELSE 'n'||line_no END AS name FROM dl WHERE k IN (2,4,7)
  UNION ALL SELECT diagram_id, line_no, 'target', 'x.'||line_no FROM dl WHERE k = 4),
undef AS (SELECT a.diagram_id, a.line_no, side, name,
    coalesce((SELECT array_to_string(list_slice(list(node ORDER BY first_line), 1, 5), ', ')||CASE WHEN count(*) > 5 THEN '...' ELSE '' END
      FROM firsts f WHERE f.diagram_id = a.diagram_id AND f.first_line <= a.line_no), '') AS available
  FROM arrow a WHERE NOT EXISTS (SELECT 1 FROM firsts f WHERE f.diagram_id = a.diagram_id AND f.first_line <= a.line_no
    AND (f.node = a.name OR (starts_with(f.node, a.name||'_') AND regexp_full_match(substr(f.node, length(a.name) + 2), '\d+')))))"""
SQL["diagram_strict_lint"] = _with(DIAGRAMS) + """
SELECT diagram_id, line_no, problem FROM (SELECT diagram_id, line_no, unnest(CASE k
  WHEN 5 THEN ['classDef statement ends with trailing comma','classDef properties end with trailing comma']
  WHEN 6 THEN ['Multiple classDef statements on same line - need line breaks'] WHEN 7 THEN ['Arrow syntax needs spaces around operators']
  WHEN 9 THEN ['Unclosed square brackets'] ELSE [] END) AS problem FROM dl)"""
SQL["diagram_duplicate_nodes"] = _with(DIAGRAMS) + "SELECT diagram_id, line_no, node FROM dup"
SQL["diagram_unmatched_ends"] = _with(DIAGRAMS) + "SELECT diagram_id, line_no FROM ends"
SQL["diagram_unclosed_blocks"] = _with(DIAGRAMS) + "SELECT diagram_id, line_no FROM opens"
SQL["diagram_undefined_ends"] = _with(DIAGRAMS) + "SELECT diagram_id, line_no, side, name, available FROM undef"
SQL["diagram_detailed_lint"] = _with(DIAGRAMS) + """
SELECT diagram_id, line_no, 'Duplicate node ID '''||node||'''' AS problem FROM dup
UNION ALL SELECT diagram_id, line_no, '''end'' without matching ''subgraph''' FROM ends
UNION ALL SELECT diagram_id, line_no, 'Unclosed subgraph' FROM opens
UNION ALL SELECT diagram_id, line_no, 'Undefined '||side||' node '''||name||'''. Available nodes: '||available FROM undef
UNION ALL SELECT diagram_id, line_no, 'Subgraph name contains invalid characters' FROM dl WHERE k = 10
UNION ALL SELECT diagram_id, line_no, 'Graph direction might be unclear' FROM dl WHERE k = 11
UNION ALL SELECT diagram_id, line_no, 'Unmatched brackets' FROM dl WHERE k = 9
UNION ALL SELECT diagram_id, line_no, unnest(['classDef statement has trailing comma - remove the comma at the end', '  Current:  '||line,
  '  Fix:      '||line[:-2], 'Suggested complete fix:', '  Fixed:    '||line[:-2], 'Invalid color format in ''stroke:#12'' - use hex (#ff0000) or named colors (red)',
  'Incomplete property ''bare'' in classDef - missing value after colon', 'Invalid stroke-width format - should be ''stroke-width:2px'' or ''stroke-width:2''']) FROM dl WHERE k = 5"""
SQL["diagram_statistics"] = r"""
SELECT doc_id, n AS n_nodes, c AS n_connections, CASE WHEN n > 20 THEN 'High' WHEN n > 10 THEN 'Medium' ELSE 'Low' END AS complexity FROM (
  SELECT doc_id, len(regexp_extract_all(text,'(\w+)\[|[^\]]+\]|\w+')) AS n, len(regexp_extract_all(text,'-->|--|<-|\.\.')) AS c FROM documents)"""

# Call statistics ---------------------------------------------------------------------------------
STATS = """
stats AS (SELECT model_name, count(*) FILTER (success) AS success_count, cast(sum(response_time) FILTER (success) AS double) AS total_response_time,
    max(ts) FILTER (success) AS last_success, count(*) FILTER (NOT success) AS failure_count, cast(sum(response_time) FILTER (success) AS double) / count(*) FILTER (success) AS avg_response_time,
    count(*) FILTER (NOT success) / count(*) AS failure_rate FROM calls GROUP BY 1)"""
SQL["model_stats"] = _with(CALLS, STATS) + """
SELECT model_name, success_count, total_response_time, epoch_us(last_success) AS last_success, failure_count, avg_response_time, failure_rate FROM stats"""
SQL["degraded_models"] = _with(CALLS, STATS) + """
SELECT model_name, (success_count + failure_count > 5 AND failure_rate > 0.2) OR (success_count >= 3 AND avg_response_time > 20.2) AS degraded FROM stats"""
SQL["recent_scores"] = _with(CALLS) + """
SELECT model_name, string_agg(cast(complexity AS varchar), ',' ORDER BY ts, event_id) AS scores FROM (
  SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY ts DESC, event_id DESC) AS r FROM calls WHERE success) WHERE r <= 20 GROUP BY 1"""
SQL["running_mean"] = _with(CALLS) + """
SELECT event_id, model_name, count(*) OVER w AS success_count, cast(sum(response_time) OVER w AS double) / count(*) OVER w AS avg_response_time
FROM calls WHERE success WINDOW w AS (PARTITION BY model_name ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""
ROUTING = """
routing(task, subtask, rank, model) AS (VALUES ('documentation','architecture',0,'model_3'),('documentation','architecture',1,'model_0'),('documentation','architecture',2,'model_1'),
  ('documentation','readme',0,'model_4'),('documentation','readme',2,'model_2'),('documentation','',0,'model_0'),('documentation','',1,'model_1'),
  ('analysis','dependency',0,'model_9'),('analysis','dependency',1,'model_8'),('analysis','',0,'model_2')),
best AS (SELECT task, subtask, model FROM (SELECT r.*, row_number() OVER (PARTITION BY task, subtask
    ORDER BY CASE WHEN success_count >= 2 THEN 0 ELSE 1 END, CASE WHEN success_count >= 2 THEN avg_response_time END, CASE WHEN success_count >= 2 THEN failure_rate END, rank) AS n
  FROM routing r LEFT JOIN stats s ON s.model_name = r.model) WHERE n = 1)"""
SQL["best_models"] = _with(CALLS, STATS, ROUTING) + "SELECT task, subtask, model FROM best"
SQL["model_routing"] = _with(CALLS, STATS, ROUTING) + """
SELECT event_id, coalesce(x.model, g.model, 'model_default') AS model FROM (
  SELECT event_id, ['documentation','analysis','other'][event_id % 3 + 1] AS task, ['architecture','readme','dependency','strange'][event_id % 4 + 1] AS subtask FROM events) e
LEFT JOIN best x ON x.task = e.task AND x.subtask = e.subtask LEFT JOIN best g ON g.task = e.task AND g.subtask = ''"""
SQL["stream_model_stats"] = _with(CALLS) + """
SELECT epoch_us(date_trunc('day', ts)) AS window_start, model_name, count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success) AS failure_count,
  coalesce(cast(sum(response_time) FILTER (success) AS double) / count(*) FILTER (success), 0) AS avg_response_time FROM calls GROUP BY date_trunc('day', ts), model_name"""
SQL["stream_recent_scores"] = SQL["recent_scores"]

# Replies and prompts -----------------------------------------------------------------------------
SQL["reply_parse"] = """
SELECT conv_id*100+turn AS reply_id, CASE conv_id % 5 WHEN 0 THEN 2 ELSE 0 END AS n_files,
  CASE conv_id % 5 WHEN 0 THEN text WHEN 1 THEN text WHEN 4 THEN '' ELSE 'Failed to parse AI response' END AS reasoning,
  cast(CASE conv_id % 5 WHEN 0 THEN 0.8 WHEN 1 THEN 0.5 WHEN 4 THEN 0.25 ELSE 0.0 END AS double) AS confidence FROM conversations"""
SQL["reply_validate"] = _with(INVENTORY) + """
SELECT conv_id*100+turn AS request_id, 0 AS position, 'src0_en_mod_'||conv_id||'_js' AS file_id FROM conversations
WHERE conv_id % 5 = 0 AND 'src0_en_mod_'||conv_id||'_js' IN (SELECT translate(relative_path,'/.-','___') FROM inventory)"""
SQL["reply_confidence_bands"] = """
SELECT conv_id*100+turn AS reply_id, 0 AS position, CASE WHEN conv_id % 10 > 8 THEN 'high' WHEN conv_id % 10 > 5 THEN 'medium' ELSE 'low' END AS band FROM conversations WHERE conv_id % 5 = 0
UNION ALL SELECT conv_id*100+turn, 1, 'low' FROM conversations WHERE conv_id % 5 = 0"""
SQL["prompt_chunks"] = _with(INVENTORY) + """
SELECT top||'/'||sub AS folder, translate(relative_path,'/.-','___') AS id, relative_path, extension, size FROM inventory"""


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


PACKED = """
facts AS (SELECT relative_path, concat('{"id":"', translate(relative_path,'/.-','___'), '","relative_path":"', relative_path, '","extension":"', extension, '","size":', size, '}') AS fact FROM inventory),
starts AS (SELECT *, sum(length(fact) + 1) OVER (ORDER BY relative_path ROWS UNBOUNDED PRECEDING) - length(fact) - 1 AS s,
  greatest(2000 - 2 - max(length(fact) + 1) OVER (), 1) AS w FROM facts),
chunks AS (SELECT dense_rank() OVER (ORDER BY stretch) - 1 AS chunk, n_files, files_json FROM
  (SELECT s // w AS stretch, count(*) AS n_files, '['||string_agg(fact, ',' ORDER BY relative_path)||']' AS files_json FROM starts GROUP BY 1))"""
SQL["prompt_packs"] = _with(INVENTORY, PACKED) + "SELECT chunk, n_files, length(files_json) AS n_chars, files_json FROM chunks"
SQL["prompts"] = _with(INVENTORY, PACKED) + f"""
SELECT conv_id*100+turn AS query_id, concat({_quoted(replies.OPENING)}, text, {_quoted(replies.STRUCTURE)}) AS opening,
  (SELECT count(*) FROM chunks) AS n_chunks, (SELECT sum(n_files)::bigint FROM chunks) AS n_files FROM conversations WHERE role = 'user'"""
