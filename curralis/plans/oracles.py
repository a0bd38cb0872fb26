"""DuckDB SQL for the registered queries, written on its own terms (recursive tables, windows) over the projected graph."""

from __future__ import annotations

from curralis.operators.navigation import STOP_WORDS
from curralis.plans.dirty import BATCH_EDGES_SQL, BATCH_NODES_SQL, RAW_EDGES_SQL, RAW_NODES_SQL
from curralis.schema import CLASSES, EDGE_TYPES, PAIRS
from curralis.sources.star import TABLES, with_graph

_names = {n: n for n in (*TABLES, "nodes", "edges")}
_LEVELS = "('KnowledgeArea', 'KnowledgeUnit', 'Topic', 'Concept')"
_TOP = "('KnowledgeElement', 'Course', 'LearningResource', 'ResourceType')"
_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


def _closure(name: str, seeds: str, kind: str, depth: int = 10, back: bool = False) -> str:
    """, name(root, node, depth): everything within depth steps, the least number of steps."""
    a, b = ("target", "source") if back else ("source", "target")
    return f""", {name}_(root, node, depth) AS ({seeds} UNION SELECT r.root, e.{b}, r.depth + 1 FROM {name}_ r JOIN edges e ON e.{a} = r.node AND e.type = '{kind}' WHERE r.depth < {depth}),
    {name} AS (SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM {name}_ GROUP BY root, node)"""


def _all(*labels: str) -> str:
    return f"SELECT key, key, 0 FROM nodes WHERE label IN ({', '.join(repr(x) for x in labels)})"


_PRE = _closure("pre", _all("Concept"), "HAS_PREREQUISITE")
_ELEMENTS = ("KnowledgeArea", "KnowledgeUnit", "Topic", "Concept")
_COURSE = """, found AS (
  SELECT key AS root, key FROM nodes WHERE label = 'Course'
  UNION SELECT source, target FROM edges WHERE type IN ('TEACHES_CONCEPT', 'REQUIRES_CONCEPT')
  UNION SELECT r.source, t.source FROM edges r JOIN edges t ON t.target = r.target WHERE r.type = 'REQUIRES_CONCEPT' AND t.type = 'TEACHES_CONCEPT' AND t.source <> r.source)"""
_TAIL = """, tail AS (
  SELECT DISTINCT f.root, e.type, e.source, e.target, e.provenance FROM found f JOIN edges e ON e.source = f.key
  WHERE e.type = 'WAS_DERIVED_FROM' OR e.type IN ('TEACHES_CONCEPT', 'REQUIRES_CONCEPT') AND EXISTS (SELECT 1 FROM found g WHERE g.root = f.root AND g.key = e.target))"""
_SIDES = """, sides AS (SELECT source AS node, target AS other, 0 AS direction, type FROM edges WHERE type <> 'WAS_DERIVED_FROM' AND source <> target
  UNION ALL SELECT target, source, 1, type FROM edges WHERE type <> 'WAS_DERIVED_FROM' AND source <> target),
direct AS (SELECT root, key, direction, type, CAST(row_number() OVER (PARTITION BY root ORDER BY direction, type, name_es NULLS LAST, key) AS INTEGER) AS rank
  FROM (SELECT s.node AS root, s.other AS key, min(direction) AS direction, min(type) AS type FROM sides s GROUP BY ALL) g JOIN (SELECT key, name_es FROM nodes) n USING (key) QUALIFY rank <= 25),
second AS (SELECT root, via, key FROM (
  SELECT d.root, d.key AS via, s.other AS key, min(s.direction) AS direction, min(s.type) AS type FROM direct d JOIN sides s ON s.node = d.key
  WHERE s.other <> d.root AND NOT EXISTS (SELECT 1 FROM direct x WHERE x.root = d.root AND x.key = s.other) GROUP BY ALL) g JOIN (SELECT key, name_es FROM nodes) n USING (key)
  QUALIFY row_number() OVER (PARTITION BY root, via ORDER BY direction, type, name_es NULLS LAST, key) <= 5)"""


def _path(label: str, grain: str) -> str:
    lifted = {
        "topic": "SELECT o.root, e.target AS key, o.depth FROM outside o JOIN edges e ON e.source = o.node AND e.type = 'PART_OF' JOIN nodes n ON n.key = e.target AND n.label = 'Topic'",
        "course": "SELECT o.root, e.source AS key, o.depth FROM outside o JOIN edges e ON e.target = o.node AND e.type = 'TEACHES_CONCEPT'",
        "area": "SELECT o.root, w.node AS key, CASE WHEN n.label = 'KnowledgeArea' THEN o.depth END AS depth FROM outside o JOIN wholes w ON w.root = o.node AND w.depth > 0 JOIN nodes n ON n.key = w.node",
    }[grain]
    return with_graph(
        _closure("parts", _all(label), "PART_OF", 3, back=True) + _closure("wholes", _all(*_ELEMENTS), "PART_OF", 3) + f""",
        inside AS (SELECT p.root, p.node FROM parts p JOIN nodes n ON n.key = p.node WHERE n.label = 'Concept'
                   UNION SELECT n.key, e.target FROM nodes n JOIN edges e ON e.source = n.key AND e.type = 'TEACHES_CONCEPT' WHERE n.label = '{label}')"""
        + _closure("reach", "SELECT root, node, 0 FROM inside", "HAS_PREREQUISITE") + f""",
        outside AS (SELECT root, node, depth FROM reach r WHERE depth > 0 AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.root = r.root AND i.node = r.node)),
        lifted AS ({lifted}),
        frontier AS (SELECT DISTINCT i.root, i.node FROM inside i JOIN edges e ON e.source = i.node AND e.type = 'HAS_PREREQUISITE' JOIN outside o ON o.root = i.root AND o.node = e.target),
        within AS (SELECT DISTINCT f.root, w.node FROM frontier f JOIN wholes w ON w.root = f.node AND w.depth > 0 JOIN parts p ON p.root = f.root AND p.node = w.node),
        every AS (SELECT key AS root, key, 0 AS depth FROM nodes WHERE label = '{label}' UNION ALL SELECT root, node, 0 FROM frontier UNION ALL SELECT root, node, 0 FROM within
                  UNION ALL SELECT root, node, depth FROM outside UNION ALL SELECT root, key, depth FROM lifted),
        path AS (SELECT root, key, CAST(min(depth) AS INTEGER) AS depth FROM every GROUP BY root, key) """
    )


_RAW = f""", flat AS (SELECT * REPLACE (string_split(labels, ' ') AS labels), coalesce(key, id) AS name FROM ({RAW_NODES_SQL.format(**_names)})),
raw AS (SELECT e.*, a.name AS a, b.name AS b, a.labels AS la, b.labels AS lb, a.layer AS ya, b.layer AS yb, '(' || a.name || ')-[:' || e.type || ']->(' || b.name || ')' AS fact
        FROM ({RAW_EDGES_SQL.format(**_names)}) e JOIN flat a ON a.id = e.src JOIN flat b ON b.id = e.dst)"""
_has = lambda label, of="labels": f"list_contains({of}, '{label}')"
_in = lambda names, of="labels": f"len(list_intersect({of}, [{', '.join(repr(x) for x in names)}]))"
_l4, _t4 = ("KnowledgeArea", "KnowledgeUnit", "Topic", "Concept"), ("KnowledgeElement", "Course", "LearningResource", "ResourceType")
_all8 = ("KnowledgeElement", *CLASSES)
_types = ", ".join(repr(t) for t in EDGE_TYPES)
_PAIRS = f"(VALUES {_values(PAIRS)}) AS p(type, s, t)"


def _cycle(kind: str) -> str:
    return f"SELECT DISTINCT f.name || ' is on a {kind} cycle' AS element FROM loop_{kind} c JOIN flat f ON f.id = c.a WHERE c.a = c.b"


_LOOPS = "".join(f", loop_{k}(a, b) AS (SELECT src, dst FROM raw WHERE type = '{k}' UNION SELECT l.a, r.dst FROM loop_{k} l JOIN raw r ON r.src = l.b AND r.type = '{k}')" for k in ("HAS_PREREQUISITE", "SPECIALIZES"))
_RULES = {
    "RI-01": "SELECT id || ' has no key' AS element FROM flat WHERE key IS NULL UNION ALL SELECT key || ' is the key of ' || count(*) || ' nodes' FROM flat WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1",
    "RI-02": f"SELECT name || ' has labels ' || array_to_string(labels, ' ') AS element FROM flat WHERE {_in(_all8)} = 0 OR len(list_filter(labels, lambda x: x NOT IN ({', '.join(repr(x) for x in _all8)}))) > 0 OR {_in(_l4)} > 0 AND NOT {_has('KnowledgeElement')}",
    "RI-03": f"SELECT name || ' has labels ' || array_to_string(labels, ' ') AS element FROM flat WHERE {_in(_t4)} <> 1 OR {_has('KnowledgeElement')} AND {_in(_l4)} <> 1",
    "RI-04": f"SELECT fact AS element FROM raw WHERE type NOT IN ({_types})",
    "RI-05": f"SELECT fact || ' joins ' || array_to_string(la, ' ') || ' to ' || array_to_string(lb, ' ') AS element FROM raw r WHERE type IN ({_types}) AND NOT EXISTS (SELECT 1 FROM {_PAIRS} WHERE p.type = r.type AND list_contains(r.la, p.s) AND list_contains(r.lb, p.t))",
    "RI-06": "SELECT any_value(fact) || ' appears ' || count(*) || ' times' AS element FROM raw GROUP BY src, dst, type HAVING count(*) > 1",
    "RI-07": f"SELECT any_value(a) || ' is part of ' || count(DISTINCT dst) || ' areas' AS element FROM raw WHERE type = 'PART_OF' AND {_has('KnowledgeUnit', 'la')} AND {_has('KnowledgeArea', 'lb')} GROUP BY src HAVING count(DISTINCT dst) > 1",
    "RI-08": " UNION ALL ".join(f"SELECT name || ' ({c}) is not part of any {p}' AS element FROM flat f WHERE {_has(c)} AND NOT EXISTS (SELECT 1 FROM raw r WHERE r.src = f.id AND r.type = 'PART_OF' AND {_has(p, 'r.lb')})" for c, p in (("Concept", "Topic"), ("Topic", "KnowledgeUnit"), ("KnowledgeUnit", "KnowledgeArea"))),
    "RI-09": f"""SELECT name || ' has undeclared properties' || CASE WHEN color IS NOT NULL THEN ' color' ELSE '' END || CASE WHEN locator IS NOT NULL AND NOT {_has('LearningResource')} THEN ' resourceLocator' ELSE '' END AS element
                FROM flat WHERE color IS NOT NULL OR locator IS NOT NULL AND NOT {_has('LearningResource')}
                UNION ALL SELECT fact || ' has undeclared properties' || CASE WHEN provenance IS NOT NULL AND ya IS DISTINCT FROM 'institutional' THEN ' provenance' ELSE '' END || CASE WHEN weight IS NOT NULL THEN ' weight' ELSE '' END
                FROM raw WHERE weight IS NOT NULL OR provenance IS NOT NULL AND ya IS DISTINCT FROM 'institutional'""",
    "RI-10": f"SELECT name || ' has locator ' || locator AS element FROM flat WHERE {_has('LearningResource')} AND locator IS NOT NULL AND NOT (locator_kind = 'string' AND regexp_full_match(locator, '(?i)https?://[^\\s/?#]+([/?#]\\S*)?'))",
    "RM-01": "SELECT name || ' has layer ' || coalesce(layer, '<none>') AS element FROM flat WHERE coalesce(layer, '') NOT IN ('reference', 'institutional')",
    "RM-02": "SELECT fact AS element FROM raw WHERE ya = 'reference' AND yb = 'institutional'",
    "RM-03": f"SELECT name || ' does not derive from any LearningResource' AS element FROM flat f WHERE layer = 'institutional' AND {_in(('Topic', 'Concept', 'Course'))} > 0 AND NOT EXISTS (SELECT 1 FROM raw r WHERE r.src = f.id AND r.type = 'WAS_DERIVED_FROM' AND {_has('LearningResource', 'r.lb')}) UNION ALL SELECT fact || ' has no provenance' FROM raw WHERE ya = 'institutional' AND provenance IS NULL",
    "RM-04": _cycle("HAS_PREREQUISITE") + " UNION ALL " + _cycle("SPECIALIZES"),
    "RM-05": f"SELECT name || ' has no locator' AS element FROM flat WHERE {_has('LearningResource')} AND locator IS NULL",
}
_BATCH = f", bn AS ({BATCH_NODES_SQL.format(**_names)}), be AS ({BATCH_EDGES_SQL.format(**_names)})"
_BFACT = "'(' || e.source || ')-[:' || e.type || ']->(' || e.target || ')'"
_LABELS = ", labels AS (SELECT key, label FROM nodes UNION ALL SELECT key, label FROM bn WHERE key NOT IN (SELECT key FROM nodes)), layers AS (SELECT key, layer FROM nodes UNION ALL SELECT key, 'institutional' FROM bn WHERE key NOT IN (SELECT key FROM nodes))"
_FRESH = ", fresh AS (SELECT DISTINCT ON (key) key, label, 'institutional' AS layer, name_es FROM bn WHERE key NOT IN (SELECT key FROM nodes))"
_ADDED = """, wanted AS (SELECT DISTINCT type, source, target FROM be UNION SELECT 'WAS_DERIVED_FROM', key, 'R0' FROM fresh WHERE label IN ('Topic', 'Concept', 'Course')),
both_ AS (SELECT key, layer FROM nodes UNION ALL SELECT key, layer FROM fresh),
added AS (SELECT w.type, w.source, w.target, 'R0' AS provenance FROM wanted w WHERE w.source IN (SELECT key FROM both_ WHERE layer = 'institutional') AND w.target IN (SELECT key FROM both_)
          AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.type = w.type AND e.source = w.source AND e.target = w.target))"""
_FOLD = "replace(strip_accents(lower({})), '’', '''')"
_TOKEN = "'[\\pL\\pN]+(?:[._''][\\pL\\pN]+)*'"


def _norm(x: str) -> str:
    """Two passes over kept signs, as RE2 has no look-behind; then every word's singular."""
    text = f"strip_accents(lower({x}))"
    kept = f"regexp_replace({text}, '(\\pL)([+#]+)([^\\pL+#]|$)', '\\1\\2' || chr(57344) || '\\3', 'g')"
    plus = kept
    for _ in range(6):  # protect a run sign by sign, from its end
        plus = f"regexp_replace({plus}, '\\+' || chr(57344), chr(57344) || chr(57345), 'g')"
        plus = f"regexp_replace({plus}, '#' || chr(57344), chr(57344) || chr(57346), 'g')"
    clean = f"regexp_replace(replace({plus}, chr(57344), ''), '[^\\pL\\pN' || chr(57345) || chr(57346) || ']', ' ', 'g')"
    clean = f"replace(replace({clean}, chr(57345), '+'), chr(57346), '#')"
    stem = "regexp_replace(w, 's$', '')"
    short = f"CASE WHEN length({stem}) > 2 AND {stem} LIKE '%e' AND substr({stem}, -2, 1) NOT IN ('a','e','i','o','u') THEN {stem}[:-2] ELSE {stem} END"
    single = f"CASE WHEN w IN ('https','ips','ids','ftps','smtps','imaps','ldaps','pop3s','bus') THEN w WHEN {short} LIKE '%z' THEN ({short})[:-2] || 'c' ELSE {short} END"
    return f"array_to_string(list_filter(list_transform(string_split_regex({clean}, ' +'), lambda w: {single}), lambda w: w <> ''), ' ')"


_EVENTS = "(SELECT user_id AS run_id, event_id AS ordinal, CASE event_type WHEN 'view' THEN 'pending' WHEN 'signup' THEN 'running' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'failed' END AS state FROM events)"
_SCORED = """(SELECT lang, count(*) FILTER (n_chars > 400 AND quality = 1) AS hits, count(*) FILTER (n_chars > 400 AND quality IS NOT NULL) AS proposed,
  count(*) FILTER (n_chars > 400 AND quality = 1) AS recovered, count(*) FILTER (quality = 1) AS mandatory FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang)"""
_RATIOS = """p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1
  FROM (SELECT *, CASE WHEN proposed <> 0 THEN hits / proposed END AS p, CASE WHEN mandatory <> 0 THEN recovered / mandatory END AS r FROM"""
_GOLD = "(SELECT p_brand AS syllabus, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS entry_id, 'G' || p_partkey % 500 AS global_id, CASE WHEN p_size % 3 = 0 THEN 'aceptable' ELSE 'obligatoria' END AS level, p_name, p_type FROM part)"

ORACLES = {
    "nav_concept_prerequisites": with_graph(_PRE + " SELECT root, node AS key, depth FROM pre"),
    "nav_course_prerequisites": with_graph(_COURSE + " SELECT * FROM found"),
    "nav_location": with_graph(_closure("up", _all(*_ELEMENTS), "PART_OF", 3) + _closure("down", _all(*_ELEMENTS), "PART_OF", 3, back=True) + " SELECT root, node AS key, depth, CASE WHEN depth = 0 THEN 'self' ELSE 'up' END AS direction FROM up UNION ALL SELECT root, node, depth, 'down' FROM down WHERE depth > 0"),
    "nav_resources": with_graph(
        _closure("parts", _all(*_ELEMENTS, "Course"), "PART_OF", 3, back=True) + _closure("wholes", _all(*_ELEMENTS), "PART_OF", 3) + """,
        covered AS (SELECT root, node FROM parts WHERE depth > 0 AND node IN (SELECT target FROM edges WHERE type = 'IS_ABOUT')),
        between_ AS (SELECT DISTINCT c.root, w.node FROM covered c JOIN wholes w ON w.root = c.node AND w.depth > 0 JOIN parts p ON p.root = c.root AND p.node = w.node AND p.depth > 0
                     WHERE NOT EXISTS (SELECT 1 FROM covered x WHERE x.root = c.root AND x.node = w.node)),
        subjects AS (SELECT key AS root, key AS node FROM nodes WHERE label IN ('KnowledgeArea', 'KnowledgeUnit', 'Topic', 'Concept', 'Course') UNION SELECT root, node FROM covered),
        resources AS (SELECT DISTINCT s.root, e.source AS node FROM subjects s JOIN edges e ON e.type = 'IS_ABOUT' AND e.target = s.node)
        SELECT key AS root, key, 'element' AS role FROM nodes WHERE label IN ('KnowledgeArea', 'KnowledgeUnit', 'Topic', 'Concept', 'Course')
        UNION ALL SELECT root, node, 'covered' FROM covered UNION ALL SELECT root, node, 'between' FROM between_ UNION ALL SELECT root, node, 'resource' FROM resources
        UNION ALL SELECT DISTINCT r.root, e.target, 'type' FROM resources r JOIN edges e ON e.type = 'HAS_RESOURCE_TYPE' AND e.source = r.node"""),
    "nav_path_topic": _path("Topic", "topic") + "SELECT * FROM path",
    "nav_path_area": _path("KnowledgeUnit", "area") + "SELECT * FROM path",
    "nav_path_course": _path("Course", "course") + "SELECT * FROM path",
    "nav_specializations": with_graph(_closure("f", _all("Concept"), "SPECIALIZES") + _closure("b", _all("Concept"), "SPECIALIZES", back=True) + " SELECT root, node AS key, min(depth) AS depth FROM (SELECT * FROM f UNION ALL SELECT * FROM b) GROUP BY root, node"),
    "nav_detail_direct": with_graph(_SIDES + " SELECT * FROM direct"),
    "nav_detail_second": with_graph(_SIDES + " SELECT * FROM second"),
    "nav_more_neighbors": with_graph(_SIDES + """, shown AS (SELECT key AS root, key FROM nodes UNION SELECT root, key FROM direct UNION SELECT root, key FROM second)
        SELECT s.root, s.key, EXISTS (SELECT 1 FROM sides x WHERE x.node = s.key AND NOT EXISTS (SELECT 1 FROM shown y WHERE y.root = s.root AND y.key = x.other)) AS more_neighbors FROM shown s"""),
    "nav_overview": with_graph(_closure("parts", _all("KnowledgeArea"), "PART_OF", 3, back=True) + """
        SELECT 0 AS part, CAST(row_number() OVER (ORDER BY a.name_es, a.key) AS INTEGER) AS place, a.key, a.name_es, count(*) FILTER (n.label = 'KnowledgeUnit') AS units, count(*) FILTER (n.label = 'Topic') AS topics, count(*) FILTER (n.label = 'Concept') AS concepts
        FROM nodes a LEFT JOIN parts p ON p.root = a.key AND p.depth > 0 LEFT JOIN nodes n ON n.key = p.node WHERE a.label = 'KnowledgeArea' GROUP BY a.key, a.name_es
        UNION ALL SELECT 1, CAST(row_number() OVER (ORDER BY course_code, key) AS INTEGER), key, name_es, NULL, NULL, NULL FROM nodes WHERE label = 'Course'"""),
    "nav_search": with_graph(f""", asked AS (SELECT DISTINCT substr(split_part(p_name, ' ', 1), 1, 3) AS query FROM part UNION ALL SELECT unnest(['the Supplier', 'reg WID', '', 'zz top'])),
        stop AS (SELECT unnest([{', '.join(repr(w) for w in STOP_WORDS)}]) AS word),
        terms AS (SELECT DISTINCT query, word, word IN (SELECT word FROM stop) AS optional FROM (SELECT query, unnest(regexp_extract_all({_FOLD.format('query')}, {_TOKEN})) AS word FROM asked)),
        needed AS (SELECT query, count(*) FILTER (NOT optional) AS needed FROM terms GROUP BY query),
        idx AS (SELECT DISTINCT key, field, unnest(regexp_extract_all({_FOLD.format('t')}, {_TOKEN})) AS token FROM (
            SELECT key, 'es' AS field, name_es AS t FROM nodes WHERE label IN ('KnowledgeArea','KnowledgeUnit','Topic','Concept','Course') UNION ALL SELECT key, 'en', name_en FROM nodes WHERE label IN ('KnowledgeArea','KnowledgeUnit','Topic','Concept','Course')
            UNION ALL SELECT key, 'code', course_code FROM nodes WHERE label = 'Course')),
        scored AS (SELECT t.query, i.key, CAST(count(DISTINCT (t.word, i.field)) AS DOUBLE) AS score, count(DISTINCT t.word) FILTER (NOT t.optional) AS met FROM terms t JOIN idx i ON starts_with(i.token, t.word) AND i.token NOT IN (SELECT word FROM stop) GROUP BY t.query, i.key)
        SELECT query, key, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS INTEGER) AS rank FROM scored JOIN needed USING (query) WHERE met = needed QUALIFY rank <= 20"""),
    "closure_all_roots": with_graph(_PRE + " SELECT depth, count(*) AS pairs FROM pre GROUP BY depth"),
    "closure_partonomy": with_graph(_closure("d", _all("KnowledgeArea"), "PART_OF", 3, back=True) + " SELECT * FROM d"),
    "edge_tail": with_graph(_COURSE + _TAIL + " SELECT * FROM tail"),
    "tail_sources": with_graph(_COURSE + _TAIL + " SELECT DISTINCT root, key FROM (SELECT root, provenance AS key FROM tail UNION SELECT root, target FROM tail WHERE type = 'WAS_DERIVED_FROM') WHERE key IN (SELECT key FROM nodes WHERE label = 'LearningResource')"),
    "element_counts": with_graph(f" SELECT 'label' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'label', 'KnowledgeElement', count(*) FROM nodes WHERE label IN {_LEVELS} UNION ALL SELECT 'type', type, count(*) FROM edges GROUP BY type"),
    **{f"audit_{rule.lower().replace('-', '')}": with_graph(_RAW + _LOOPS * (rule == "RM-04") + " " + sql) for rule, sql in _RULES.items()},
    "audit_report": with_graph(_RAW + _LOOPS + ", rules(rule) AS (VALUES " + _values([(r,) for r in _RULES]) + "), found AS (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, element FROM ({sql})" for r, sql in _RULES.items())
        + ") SELECT rule, count(element) AS violations, coalesce(array_to_string(list_slice(list_sort(list(element) FILTER (element IS NOT NULL)), 1, 20), '; '), '') AS sample FROM rules LEFT JOIN found USING (rule) GROUP BY rule"),
    "audit_of_projection": "SELECT unnest([" + ", ".join(repr(r) for r in _RULES) + "]) AS rule, CAST(0 AS BIGINT) AS violations",
    "validate_ri05": with_graph(_BATCH + _LABELS + f""", j AS (SELECT {_BFACT} AS fact, e.type, s.label AS sl, t.label AS tl FROM be e LEFT JOIN labels s ON s.key = e.source LEFT JOIN labels t ON t.key = e.target)
        SELECT fact, type || ' is not a declared edge type' AS message FROM j WHERE type NOT IN ({_types})
        UNION ALL SELECT fact, 'the source node does not exist' FROM j WHERE type IN ({_types}) AND sl IS NULL UNION ALL SELECT fact, 'the target node does not exist' FROM j WHERE type IN ({_types}) AND tl IS NULL
        UNION ALL SELECT fact, sl || ' -> ' || tl || ' is not admitted for ' || type FROM j WHERE type IN ({_types}) AND sl IS NOT NULL AND tl IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_PAIRS} WHERE p.type = j.type AND p.s = sl AND p.t = tl)"""),
    "validate_ri08": with_graph(_BATCH + _LABELS + """ SELECT key AS fact, 'new ' || label || ' has no PART_OF edge to a ' || parent AS message FROM (SELECT key, label, CASE label WHEN 'Concept' THEN 'Topic' WHEN 'Topic' THEN 'KnowledgeUnit' WHEN 'KnowledgeUnit' THEN 'KnowledgeArea' END AS parent FROM bn WHERE key NOT IN (SELECT key FROM nodes)) n
        WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM be e JOIN labels l ON l.key = e.target WHERE e.type = 'PART_OF' AND e.source = n.key AND l.label = n.parent)"""),
    "validate_ri10": with_graph(_BATCH + " SELECT key AS fact, 'locator ''' || locator || ''' is not an absolute http or https URI' AS message FROM bn WHERE locator IS NOT NULL AND NOT regexp_full_match(locator, '(?i)https?://[^\\s/?#]+([/?#]\\S*)?')"),
    "validate_rm02": with_graph(_BATCH + _LABELS + f" SELECT {_BFACT} AS fact, 'edge from a reference node to an institutional node' AS message FROM be e JOIN layers s ON s.key = e.source JOIN layers t ON t.key = e.target WHERE s.layer = 'reference' AND t.layer = 'institutional'"),
    "validate_rm04": with_graph(" SELECT 'x' AS fact, 'x' AS message WHERE false"),
    "validate_rm05": with_graph(_BATCH + " SELECT key AS fact, 'learning resource without locator' AS message FROM bn WHERE label = 'LearningResource' AND locator IS NULL"),
    "merge_nodes_new": with_graph(_BATCH + _FRESH + " SELECT * FROM fresh"),
    "merge_edges_new": with_graph(_BATCH + _FRESH + _ADDED + " SELECT * FROM added"),
    "derive_provenance": with_graph(_BATCH + _FRESH + " SELECT 'WAS_DERIVED_FROM' AS type, key AS source, 'R0' AS target FROM fresh WHERE label IN ('Topic', 'Concept', 'Course')"),
    "merge_missing": with_graph(_BATCH + _FRESH + _ADDED + " SELECT type, source, target FROM be EXCEPT SELECT type, source, target FROM edges EXCEPT SELECT type, source, target FROM added"),
    "snapshot_nodes": with_graph(" SELECT n.key, n.label, n.layer, n.name_es, n.name_en, CASE WHEN n.label = 'KnowledgeUnit' THEN (SELECT min(e.target) FROM edges e JOIN nodes a ON a.key = e.target AND a.label = 'KnowledgeArea' WHERE e.type = 'PART_OF' AND e.source = n.key) END AS area FROM nodes n"),
    "snapshot_edges": with_graph(" SELECT type, source, target FROM edges WHERE type IN ('HAS_PREREQUISITE', 'SPECIALIZES') UNION ALL SELECT type, source, target FROM edges WHERE type = 'PART_OF' AND source IN (SELECT key FROM nodes WHERE label IN ('Topic', 'Concept'))"),
    "snapshot_reference": with_graph(" SELECT type, source, target FROM edges WHERE source IN (SELECT key FROM nodes WHERE layer = 'reference') AND target IN (SELECT key FROM nodes WHERE layer = 'reference')"),
    "snapshot_before": with_graph(" SELECT key, label FROM nodes"),
    "fold_text": f"SELECT doc_id, md5({_FOLD.format('text')}) AS folded FROM documents",
    "normalize_labels": f"SELECT doc_id, md5({_norm('text')}) AS norm FROM documents UNION ALL SELECT -p_partkey - 1, md5({_norm('p_name')}) FROM part",
    "tokenize_words": f"SELECT doc_id, md5(array_to_string(regexp_extract_all({_FOLD.format('text')}, {_TOKEN}), ' ')) AS words FROM documents",
    "vocabulary_refs": with_graph(""" SELECT CASE label WHEN 'KnowledgeUnit' THEN 'K' WHEN 'Topic' THEN 'T' ELSE 'C' END || '-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS ref, key
        FROM (SELECT key, label, row_number() OVER (PARTITION BY label ORDER BY name_es NULLS LAST, key) AS n FROM nodes WHERE label IN ('KnowledgeUnit', 'Topic', 'Concept'))"""),
    "run_latest_state": f"SELECT run_id, arg_max(state, ordinal) AS state, max(ordinal) AS ordinal FROM {_EVENTS} GROUP BY run_id",
    "run_transition_violations": f"""SELECT run_id, ordinal, previous, state FROM (SELECT *, lag(state) OVER (PARTITION BY run_id ORDER BY ordinal) AS previous FROM {_EVENTS})
        WHERE NOT (previous IS NULL AND state = 'pending' OR coalesce(previous, '') = 'pending' AND state = 'running' OR coalesce(previous, '') = 'running' AND state IN ('completed', 'rejected', 'failed'))""",
    "run_oldest_pending": f"SELECT run_id FROM (SELECT min(run_id) AS run_id FROM (SELECT run_id, arg_max(state, ordinal) AS state FROM {_EVENTS} GROUP BY run_id) WHERE state = 'pending') WHERE run_id IS NOT NULL",
    "run_counts": f"SELECT state, count(*) AS n FROM (SELECT run_id, arg_max(state, ordinal) AS state FROM {_EVENTS} GROUP BY run_id) GROUP BY state",
    "audit_gate": "SELECT CASE WHEN event_type = 'error' THEN 'closed: audit not completed' WHEN floor(value) > 0 THEN 'closed: violations' ELSE 'open' END AS gate FROM events ORDER BY event_id DESC LIMIT 1",
    "replay_plan": f"SELECT c_custkey AS run_id, CASE WHEN state IS NULL THEN 'orphan' WHEN state = 'failed' THEN 'skip' ELSE 'write' END AS action FROM customer LEFT JOIN (SELECT run_id, arg_max(state, ordinal) AS state FROM {_EVENTS} GROUP BY run_id) ON run_id = c_custkey",
    "eval_precision_recall": f"SELECT lang, hits, proposed, recovered, mandatory, {_RATIOS} {_SCORED})",
    "eval_totals": f"SELECT split, CAST(hits AS BIGINT) AS hits, CAST(proposed AS BIGINT) AS proposed, CAST(recovered AS BIGINT) AS recovered, CAST(mandatory AS BIGINT) AS mandatory, {_RATIOS} (SELECT split, sum(hits) AS hits, sum(proposed) AS proposed, sum(recovered) AS recovered, sum(mandatory) AS mandatory FROM (SELECT *, unnest(['all', CASE WHEN lang = 'en' THEN 'tuning' ELSE 'held_out' END]) AS split FROM {_SCORED}) GROUP BY split))",
    "eval_fusion": """WITH m AS (SELECT DISTINCT l_suppkey AS node, l_partkey AS g FROM lineitem), s AS (SELECT count(*) AS n FROM m GROUP BY g HAVING count(*) > 1), w AS (SELECT count(*) AS n FROM m GROUP BY node HAVING count(*) > 1)
        SELECT (SELECT count(*) FROM s) AS split_notions, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM s) AS surplus, (SELECT count(*) FROM w) AS wrong_nodes""",
    "eval_attempts": """WITH f AS (SELECT CAST(o_custkey AS VARCHAR) AS syllabus, min(o_orderkey) AS run_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
        SELECT syllabus, run_id, (SELECT count(*) FROM orders o WHERE CAST(o.o_custkey AS VARCHAR) = syllabus AND o_orderstatus <> 'F' AND o_orderkey < run_id) + 1 AS attempts FROM f""",
    "eval_mandatory_notions": f"SELECT syllabus, global_id, min(entry_id) AS entry_id FROM {_GOLD} WHERE level = 'obligatoria' GROUP BY syllabus, global_id",
    "eval_gold_names": f"SELECT DISTINCT global_id, name FROM (SELECT global_id, {_norm('p_name')} AS name FROM {_GOLD} UNION SELECT global_id, {_norm('p_type')} FROM {_GOLD}) WHERE name <> ''",
    "eval_case_numbers": "SELECT p_brand AS syllabus, 'CP-' || lpad(CAST(row_number() OVER (ORDER BY min(p_partkey)) AS VARCHAR), 2, '0') AS \"case\" FROM part GROUP BY p_brand",
    "review_agreement": f"""WITH a AS (SELECT DISTINCT p_brand AS syllabus, {_norm('p_name')} AS n FROM part WHERE p_size % 2 = 0), b AS (SELECT DISTINCT p_brand AS syllabus, {_norm('p_name')} AS n FROM part WHERE p_partkey % 3 = 0)
        SELECT syllabus, count(*) FILTER (x AND y) AS "both", count(*) FILTER (x AND y IS NULL) AS only_one, count(*) FILTER (y AND x IS NULL) AS only_two, count(*) FILTER (x AND y) / count(*) AS share
        FROM (SELECT syllabus, n, true AS x FROM a) FULL JOIN (SELECT syllabus, n, true AS y FROM b) USING (syllabus, n) GROUP BY syllabus""",
    "scc_members": with_graph(_RAW + _LOOPS + " SELECT l.a AS node, max(r.a) AS component FROM loop_HAS_PREREQUISITE l JOIN loop_HAS_PREREQUISITE r ON r.a = l.b AND r.b = l.a GROUP BY l.a"),
    "connected_notions": """WITH RECURSIVE rows_ AS (SELECT p_partkey AS row_no, p_name || ' ' || p_size AS a, p_type || ' ' || p_brand || ' ' || p_size AS b FROM part),
        names AS (SELECT row_no, 'x' || lower(replace(a, '#', ' ')) AS name FROM rows_ UNION SELECT row_no, 'x' || lower(replace(b, '#', ' ')) FROM rows_), firsts AS (SELECT name, min(row_no) AS f FROM names GROUP BY name),
        pairs AS (SELECT DISTINCT row_no AS a, f AS b FROM names JOIN firsts USING (name)), both_ AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
        reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON e.a = r.b), comp AS (SELECT a AS row_no, min(b) AS c FROM reach GROUP BY a)
        SELECT row_no, 'G-' || lpad(CAST(dense_rank() OVER (ORDER BY c) AS VARCHAR), 4, '0') AS global_id FROM comp""",
    "nearest_rank_p95": """SELECT *, median_ms < 1000 AND p95_ms < 1000 AS passes FROM (SELECT event_type AS pattern, count(*) AS executions, median(ms) AS median_ms, quantile_disc(ms, 0.95) AS p95_ms, max(ms) AS max_ms
        FROM (SELECT event_type, CAST(floor(value * 10) AS BIGINT) AS ms FROM events) GROUP BY event_type)""",
    "learning_order": with_graph(_closure("parts", _all("Topic"), "PART_OF", 3, back=True) + """, inside AS (SELECT root, node FROM parts WHERE depth > 0),
        inner_ AS (SELECT i.root, e.source, e.target FROM inside i JOIN edges e ON e.source = i.node AND e.type = 'HAS_PREREQUISITE' JOIN inside j ON j.root = i.root AND j.node = e.target),
        walk(root, node, step) AS (SELECT root, node, 1 FROM inside UNION SELECT w.root, e.source, w.step + 1 FROM walk w JOIN inner_ e ON e.root = w.root AND e.target = w.node)
        SELECT root, node AS key, CAST(max(step) AS INTEGER) AS step FROM walk GROUP BY root, node"""),
    "location_chains": with_graph(""", up(root, top, chain) AS (SELECT source, target, target FROM edges WHERE type = 'PART_OF' UNION ALL SELECT u.root, e.target, e.target || ' > ' || u.chain FROM up u JOIN edges e ON e.source = u.top AND e.type = 'PART_OF')
        SELECT root, chain FROM up WHERE top NOT IN (SELECT source FROM edges WHERE type = 'PART_OF')"""),
    "prerequisites_by_depth": with_graph(_PRE + """ SELECT p.root, p.node AS key, p.depth, arg_min(e.source, CASE WHEN e.source = p.root THEN '0' ELSE '1' END || e.source) AS via FROM pre p JOIN edges e ON e.type = 'HAS_PREREQUISITE' AND e.target = p.node
        JOIN pre q ON q.root = p.root AND q.node = e.source AND q.depth = p.depth - 1 WHERE p.depth > 0 GROUP BY p.root, p.node, p.depth"""),
    "previous_courses": with_graph(" SELECT r.source AS root, t.source AS course, string_agg(DISTINCT r.target, ',' ORDER BY r.target) AS evidence FROM edges r JOIN edges t ON t.target = r.target AND t.type = 'TEACHES_CONCEPT' AND t.source <> r.source WHERE r.type = 'REQUIRES_CONCEPT' GROUP BY r.source, t.source"),
    "path_stops": _path("Topic", "topic") + "SELECT root, p.key, depth, CAST(row_number() OVER (PARTITION BY root ORDER BY depth DESC, n.name_es NULLS LAST, p.key) AS INTEGER) AS place FROM path p JOIN nodes n ON n.key = p.key AND n.label = 'Topic' WHERE depth > 0",
    "documents_of_edges": with_graph(" SELECT type, source, target, coalesce(provenance, (SELECT min(d.target) FROM edges d WHERE d.type = 'WAS_DERIVED_FROM' AND d.source = e.source)) AS document FROM edges e WHERE type <> 'WAS_DERIVED_FROM'"),
    "concepts_under": with_graph(_closure("down", _all("KnowledgeArea", "KnowledgeUnit", "Topic"), "PART_OF", 3, back=True) + " SELECT n.key, n.label, count(*) FILTER (d.depth = 1) AS children, count(*) FILTER (c.label = 'Concept') AS concepts FROM nodes n JOIN down d ON d.root = n.key JOIN nodes c ON c.key = d.node WHERE n.label IN ('KnowledgeArea', 'KnowledgeUnit', 'Topic') GROUP BY n.key, n.label"),
    "neighbour_clusters": with_graph(" SELECT key, type, direction, count(*) AS n, count(*) > 14 AS clustered FROM (SELECT source AS key, type, 'out' AS direction FROM edges WHERE type <> 'WAS_DERIVED_FROM' UNION ALL SELECT target, type, 'in' FROM edges WHERE type <> 'WAS_DERIVED_FROM') GROUP BY ALL"),
    "count_by_class": with_graph(_closure("up", _all(*_ELEMENTS), "PART_OF", 3) + _closure("down", _all(*_ELEMENTS), "PART_OF", 3, back=True) + " SELECT root, label, count(*) AS n FROM (SELECT root, node FROM up UNION SELECT root, node FROM down) f JOIN nodes n ON n.key = f.node GROUP BY root, label"),
    "contains_target": _path("KnowledgeUnit", "area") + ", x AS (SELECT root, p.key FROM path p JOIN nodes n ON n.key = p.key AND n.label = 'KnowledgeArea' WHERE depth > 0) SELECT root, key, EXISTS (SELECT 1 FROM wholes w WHERE w.root = x.root AND w.node = x.key AND w.depth > 0) AS contains FROM x",
    "resources_of": "SELECT r.root, r.key, r.kind, string_agg(DISTINCT e.target, ',' ORDER BY e.target) AS parts FROM (SELECT root, key, (SELECT min(k.target) FROM kinds k WHERE k.source = key) AS kind FROM res WHERE role = 'resource') r JOIN abouts e ON e.source = r.key JOIN res s ON s.root = r.root AND s.key = e.target AND s.role IN ('element', 'covered') GROUP BY r.root, r.key, r.kind",
}
ORACLES["resources_of"] = f"WITH res AS ({ORACLES['nav_resources']}), kinds AS ({with_graph(' SELECT source, target FROM edges WHERE type = ' + repr('HAS_RESOURCE_TYPE'))}), abouts AS ({with_graph(' SELECT source, target FROM edges WHERE type = ' + repr('IS_ABOUT'))}) " + ORACLES["resources_of"]
_HASH = "sha1('\\x6b\\xa7\\xb8\\x11\\x9d\\xad\\x11\\xd1\\x80\\xb4\\x00\\xc0\\x4f\\xd4\\x30\\xc8'::BLOB || encode('Concept|' || norm))"
ORACLES["link_mentions"] = with_graph(f""", known AS (SELECT norm, arg_min(key, (rank, key)) AS key FROM (SELECT key, 0 AS rank, {_norm('name_es')} AS norm FROM nodes WHERE label = 'Concept' UNION ALL SELECT key, 1, {_norm('name_en')} FROM nodes WHERE label = 'Concept') WHERE norm <> '' GROUP BY norm),
    m AS (SELECT name, {_norm('name')} AS norm FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN upper(p_name) || 's' WHEN 1 THEN 'new-' || p_name ELSE p_name END AS name FROM part)),
    h AS (SELECT m.name, m.norm, k.key, {_HASH.replace('norm)', 'm.norm)')} AS x FROM m LEFT JOIN known k ON k.norm = m.norm)
    SELECT name, norm, key IS NULL AS minted, coalesce(key, x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' || substr('89ab', CAST(('0x' || x[17:17])::INT % 4 + 1 AS INT), 1) || x[18:20] || '-' || x[21:32]) AS key FROM h""")

ORACLES["turtle_projection"] = """SELECT 'KnowledgeArea' AS kind, 'http://example.org/o#A' || r_regionkey AS key, r_name || '/' || lower(r_name) || '/reference' AS value FROM region
    UNION ALL SELECT 'KnowledgeUnit', 'http://example.org/o#U' || n_nationkey, n_name || '/' || lower(n_name) || '/reference' FROM nation
    UNION ALL SELECT 'PART_OF', 'http://example.org/o#U' || n_nationkey, 'http://example.org/o#A' || n_regionkey FROM nation"""
ORACLES["snapshot_problems"] = with_graph(""" SELECT key, 'classes Concept Topic' AS problem FROM nodes WHERE label = 'Concept' AND key LIKE '%7'
    UNION ALL SELECT 'D' || key, 'layer draft' FROM nodes WHERE label = 'Course'
    UNION ALL SELECT source, 'areas A0 ' || target FROM edges WHERE type = 'PART_OF' AND source LIKE 'U%' AND target <> 'A0'""")

from curralis.plans.dirty import CONCEPTS_SQL, RELATIONS_SQL, REQUIRED_SQL, TOPICS_SQL  # noqa: E402

_star = {n: n for n in (*TABLES, "lineitem")}
_VOC = """voc AS (SELECT CASE label WHEN 'KnowledgeUnit' THEN 'K' WHEN 'Topic' THEN 'T' ELSE 'C' END || '-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS ref, key, label
        FROM (SELECT key, label, row_number() OVER (PARTITION BY label ORDER BY name_es NULLS LAST, key) AS n FROM nodes WHERE label IN ('KnowledgeUnit', 'Topic', 'Concept')))"""
_LINK = f""", {_VOC},
    kn AS (SELECT label, norm, min(key) AS key FROM (SELECT label, key, {_norm('name_es')} AS norm FROM nodes UNION ALL SELECT label, key, {_norm('name_en')} FROM nodes) WHERE norm <> '' GROUP BY label, norm),
    tp AS (SELECT x.*, coalesce(kn.key, 'new|Topic|' || x.norm) AS key, kn.key IS NULL AS minted FROM (SELECT *, {_norm('name')} AS norm FROM ({TOPICS_SQL.format(**_star)})) x LEFT JOIN kn ON kn.label = 'Topic' AND kn.norm = x.norm),
    cp AS (SELECT x.*, coalesce(kn.key, 'new|Concept|' || x.norm) AS key, kn.key IS NULL AS minted FROM (SELECT *, {_norm('name')} AS norm FROM ({CONCEPTS_SQL.format(**_star)})) x LEFT JOIN kn ON kn.label = 'Concept' AND kn.norm = x.norm),
    rq AS (SELECT x.*, coalesce(kn.key, 'new|Concept|' || x.norm) AS key, kn.key IS NULL AS minted FROM (SELECT *, {_norm('name')} AS norm FROM ({REQUIRED_SQL.format(**_star)})) x LEFT JOIN kn ON kn.label = 'Concept' AND kn.norm = x.norm),
    un AS (SELECT tp.doc, tp.name, tp.key AS topic, voc.key, CASE WHEN voc.key IS NULL THEN 'EX-02' WHEN voc.label <> 'KnowledgeUnit' THEN 'EX-03' END AS discard FROM tp LEFT JOIN voc ON voc.ref = tp.unit WHERE tp.minted AND tp.unit IS NOT NULL),
    bad AS (SELECT DISTINCT doc FROM un WHERE discard IS NOT NULL),
    sg AS (SELECT DISTINCT doc, topic, {_norm('s')} AS norm FROM (SELECT doc, key AS topic, unnest(string_split_regex(name, '(?i)[,;:]|\\s(?:y|e|and)\\s')) AS s FROM tp)),
    hs AS (SELECT DISTINCT rq.doc, rq.key, sg.topic FROM rq JOIN sg ON sg.doc = rq.doc AND sg.norm = rq.norm),
    pl AS (SELECT cp.doc, cp.key, tp.key AS topic FROM cp JOIN tp ON tp.doc = cp.doc AND tp.t = cp.t),
    ta AS (SELECT doc, key FROM pl UNION SELECT doc, key FROM hs),
    ne AS (SELECT doc, key FROM rq EXCEPT SELECT doc, key FROM ta),
    bn_ AS (SELECT doc, norm, arg_min(key, o) AS key FROM (SELECT doc, norm, key, (0, t, c) AS o FROM cp UNION ALL SELECT doc, norm, key, (1, r, 0) FROM rq) GROUP BY doc, norm),
    re AS (SELECT doc, kind, {_norm('source')} AS s, target, CASE WHEN NOT regexp_matches(target, '^[KTC]-[0-9]{{3,}}$') THEN {_norm('target')} END AS t FROM ({RELATIONS_SQL.format(**_star)})),
    rl AS (SELECT re.doc, re.kind, a.key AS source, coalesce(b.key, voc.key) AS target FROM re JOIN bn_ a ON a.doc = re.doc AND a.norm = re.s LEFT JOIN bn_ b ON b.doc = re.doc AND b.norm = re.t LEFT JOIN voc ON re.t IS NULL AND voc.ref = re.target),
    le AS (SELECT doc, 'PART_OF' AS type, topic AS source, key AS target FROM un WHERE discard IS NULL UNION SELECT doc, 'PART_OF', key, topic FROM pl UNION SELECT doc, 'PART_OF', key, topic FROM hs UNION SELECT doc, kind, source, target FROM rl WHERE source <> target),
    ln AS (SELECT doc, key, label, bool_and(minted) AS minted FROM (SELECT doc, key, 'Topic' AS label, minted FROM tp UNION ALL SELECT doc, key, 'Concept', minted FROM cp UNION ALL SELECT doc, key, 'Concept', minted FROM rq) GROUP BY doc, key, label)
"""
_good = lambda t: f"{t} WHERE doc NOT IN (SELECT doc FROM bad)"
ORACLES["linked_edges"] = with_graph(_LINK + f"SELECT * FROM {_good('le')}")
ORACLES["linked_nodes"] = with_graph(_LINK + f"SELECT * FROM {_good('ln')}")
ORACLES["linked_taught_and_required"] = with_graph(_LINK + f"SELECT doc, key, 'taught' AS how FROM {_good('ta')} UNION ALL SELECT doc, key, 'required' FROM {_good('ne')}")
ORACLES["link_discards"] = with_graph(_LINK + "SELECT DISTINCT doc, discard, 'unit of ' || name AS place FROM un WHERE discard IS NOT NULL")
ORACLES["assembled_edges"] = with_graph(_LINK + f"""SELECT doc, type, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc, type FROM {_good('le')} UNION ALL SELECT doc, 'TEACHES_CONCEPT' FROM {_good('ta')} UNION ALL SELECT doc, 'REQUIRES_CONCEPT' FROM {_good('ne')}
    UNION ALL SELECT doc, 'IS_ABOUT' FROM {_good('ln')} AND label = 'Topic' UNION ALL SELECT s_suppkey, unnest(['IS_ABOUT', 'HAS_RESOURCE_TYPE']) FROM supplier WHERE s_suppkey NOT IN (SELECT doc FROM bad)) GROUP BY doc, type
    UNION ALL SELECT s_suppkey, upper(trim(s_name)), 1 FROM supplier WHERE s_suppkey NOT IN (SELECT doc FROM bad)""")
ORACLES["vocabulary_lines"] = with_graph(f""", {_VOC} SELECT DISTINCT a.ref || CASE type WHEN 'PART_OF' THEN ' part of ' WHEN 'HAS_PREREQUISITE' THEN ' requires ' ELSE ' is a kind of ' END || b.ref AS line FROM edges e JOIN voc a ON a.key = e.source JOIN voc b ON b.key = e.target WHERE type IN ('PART_OF', 'HAS_PREREQUISITE', 'SPECIALIZES')""")


def _walk(isolated: bool) -> str:
    before = "NULL" if isolated else "(SELECT arg_max(m.name, m.run_id) FROM n m JOIN orders ON o_orderkey = m.run_id AND o_orderstatus = 'F' WHERE m.key = x.key AND m.run_id < x.run_id)"
    return f"""WITH l AS (SELECT l_orderkey AS run_id, l_linenumber AS o, 'C' || l_partkey AS key, 'T' || l_suppkey % 7 AS topic FROM lineitem),
    n AS (SELECT run_id, key, min(o) AS o, key || '@' || run_id AS name FROM l WHERE o <= 3 GROUP BY run_id, key),
    d AS (SELECT run_id, key, min(pos) AS pos, max(p) AS p FROM (SELECT run_id, key, 2 * o AS pos, o % 2 AS p FROM l UNION ALL SELECT run_id, CASE WHEN o % 2 = 1 THEN topic ELSE 'C1' END, 2 * o + 1, o % 2 FROM l) GROUP BY run_id, key),
    x AS (SELECT coalesce(n.run_id, d.run_id) AS run_id, coalesce(n.key, d.key) AS key, n.o, n.name AS own, d.pos, d.p FROM n FULL JOIN d ON d.run_id = n.run_id AND d.key = n.key),
    f AS (SELECT DISTINCT 'T' || s_suppkey % 6 AS key, 'topic ' || s_suppkey % 6 AS name FROM supplier),
    w AS (SELECT x.*, coalesce(own, {before}, (SELECT f.name FROM f WHERE f.key = x.key)) AS name FROM x)
    SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY o NULLS LAST, pos, key) AS INTEGER) AS place, key, CASE WHEN name IS NOT NULL THEN CASE WHEN key LIKE 'T%' THEN 'Topic' ELSE 'Concept' END END AS label, name, coalesce(p, 1) = 0 AS related, name IS NULL AS unknown FROM w"""


ORACLES["walk_chain"], ORACLES["walk_isolated"] = _walk(False), _walk(True)
ORACLES["judged_runs"] = """WITH f AS (SELECT o_custkey, min(o_orderkey) AS first FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
    SELECT o_orderkey AS run_id, CAST(o.o_custkey AS VARCHAR) AS syllabus, CASE WHEN c_custkey IS NULL THEN 'no test case' WHEN o_orderkey > first THEN 'late' WHEN o_orderstatus = 'F' THEN 'measured' ELSE 'rejected' END AS role
    FROM orders o LEFT JOIN f ON f.o_custkey = o.o_custkey LEFT JOIN customer ON c_custkey = o.o_custkey AND c_nationkey % 2 = 0"""
ORACLES["eval_fusion_counts"] = """WITH m AS (SELECT DISTINCT l_suppkey AS node, l_suppkey % 2 AS label, l_partkey AS g FROM lineitem), c AS (SELECT p_partkey AS g FROM part WHERE p_size > 5), h AS (SELECT s_suppkey AS node FROM supplier WHERE s_nationkey < 5),
    k AS (SELECT g, label, count(*) AS n, count(*) FILTER (node IN (SELECT node FROM h)) AS held FROM m GROUP BY g, label), w AS (SELECT node, count(*) AS n, count(*) FILTER (g NOT IN (SELECT g FROM c)) AS plain FROM m GROUP BY node)
    SELECT (SELECT count(DISTINCT g) FROM k WHERE n > 1) AS duplicated_notions, (SELECT CAST(sum(n - 1) AS BIGINT) FROM k WHERE n > 1) AS surplus_nodes, (SELECT count(*) FROM (SELECT g FROM k GROUP BY g HAVING count(*) > 1)) AS split_notions,
           (SELECT count(DISTINCT g) FROM k WHERE n > 1 AND held > 0) AS duplicated_with_held_out, count(*) AS nodes_with_hits, count(*) FILTER (n > 1 AND plain <> 1) AS wrong_fusions, count(*) FILTER (n > 1 AND plain = 1) AS excepted_fusions,
           count(*) FILTER (n > 1 AND plain <> 1 AND node IN (SELECT node FROM h)) AS wrong_with_held_out FROM w"""
_REVIEW = f"(SELECT p_brand AS syllabus, p_partkey AS row_no, {_norm('nm')} AS norm, kind FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN p_name ELSE 'no such' END AS nm, CASE WHEN p_partkey % 5 < 3 THEN 'tema' ELSE 'otro' END AS kind FROM part WHERE p_size % 2 = 0))"
ORACLES["review_comparison"] = f"""WITH g AS (SELECT p_brand AS syllabus, 'G' || p_partkey % 500 AS gid, CASE WHEN p_size % 4 = 0 THEN 'tema' ELSE 'concepto' END AS kind, p_size % 3 <> 0 AS must, p_name, p_type FROM part),
    nm AS (SELECT DISTINCT gid, {_norm('p_name')} AS norm FROM g UNION SELECT gid, {_norm('p_type')} FROM g), r AS (SELECT syllabus, norm, arg_min(kind, row_no) AS kind, count(*) AS n FROM {_REVIEW} GROUP BY syllabus, norm),
    m AS (SELECT DISTINCT r.syllabus, r.norm, r.kind, g.gid, g.kind AS gk FROM r JOIN g ON g.syllabus = r.syllabus JOIN nm ON nm.gid = g.gid AND nm.norm = r.norm),
    a AS (SELECT syllabus, count(*) AS names, CAST(sum(n) - count(*) AS BIGINT) AS repeated_rows FROM r GROUP BY syllabus),
    b AS (SELECT syllabus, count(DISTINCT norm) AS registered, count(DISTINCT norm) FILTER (kind IN ('tema', 'concepto')) AS typed, count(DISTINCT norm) FILTER (kind = gk) AS agreeing FROM m GROUP BY syllabus),
    q AS (SELECT syllabus, gid, bool_or(must) AS must FROM g GROUP BY syllabus, gid), c AS (SELECT q.syllabus, count(*) AS notions, count(*) FILTER (x) AS extracted, count(*) FILTER (must) AS mandatory, count(*) FILTER (must AND x) AS mandatory_extracted
      FROM (SELECT q.*, EXISTS (SELECT 1 FROM m WHERE m.syllabus = q.syllabus AND m.gid = q.gid) AS x FROM q) q GROUP BY q.syllabus)
    SELECT *, notions - mandatory AS acceptable, extracted - mandatory_extracted AS acceptable_extracted FROM (SELECT a.*, c.* EXCLUDE (syllabus), coalesce(registered, 0) AS registered, coalesce(typed, 0) AS typed, coalesce(agreeing, 0) AS agreeing FROM a JOIN c USING (syllabus) LEFT JOIN b USING (syllabus))"""
_PIPE = f"(SELECT p_brand AS syllabus, count(*) AS items, count(*) FILTER (hit {{}}) AS registered FROM (SELECT p_brand, p_partkey, (p_brand, {_norm('p_name')}) IN (SELECT (syllabus, norm) FROM {_REVIEW}) AS hit FROM part) GROUP BY p_brand)"
ORACLES["review_pipeline"] = f"SELECT *, registered / items AS share FROM {_PIPE.format('OR p_partkey % 11 = 0')}"
ORACLES["review_total"] = f"""WITH p AS (SELECT * FROM {_PIPE.format('')}) SELECT 'all' AS "of", CAST(sum(registered) AS BIGINT) AS part, CAST(sum(items) AS BIGINT) AS whole, sum(registered) / sum(items) AS share FROM p
    UNION ALL SELECT 'lacking', NULL, NULL, NULL WHERE EXISTS (SELECT 1 FROM p WHERE syllabus = 'Brand#1') UNION ALL SELECT 'lacking', CAST(sum(registered) AS BIGINT), CAST(sum(items) AS BIGINT), sum(registered) / sum(items) FROM p WHERE NOT EXISTS (SELECT 1 FROM p WHERE syllabus = 'Brand#1') HAVING count(*) > 0"""
ORACLES["review_adjudicated"] = """WITH s AS (SELECT p_brand AS syllabus, CASE WHEN p_size % 2 = 0 THEN 'reviewer' ELSE 'annotation' END AS side, p_name AS name, p_partkey % 4 AS k FROM part),
    c AS (SELECT syllabus, side, name, max(CASE k WHEN 2 THEN 'same' WHEN 3 THEN 'error' END) AS category FROM s GROUP BY ALL) SELECT syllabus, side, coalesce(category, 'pending') AS category, count(*) AS n FROM c GROUP BY ALL"""
ORACLES["notion_choices"] = f"SELECT syllabus, global_id, global_id || ' · ' || arg_min(p_name, entry_id) AS choice FROM {_GOLD} GROUP BY syllabus, global_id"
ORACLES["kinds_of"] = with_graph(""" SELECT root, role, key, CAST(row_number() OVER (PARTITION BY root, role ORDER BY name_es NULLS LAST, key) AS INTEGER) AS place
    FROM (SELECT source AS root, 'general' AS role, target AS key FROM edges WHERE type = 'SPECIALIZES' UNION ALL SELECT target, 'kind', source FROM edges WHERE type = 'SPECIALIZES') JOIN nodes USING (key)""")
ORACLES["kinds_levels"] = with_graph(_closure("f", _all("Concept"), "SPECIALIZES", 99) + _closure("b", _all("Concept"), "SPECIALIZES", 99, back=True) + " SELECT root, node AS key, -depth AS level FROM f UNION ALL SELECT root, node, depth FROM b WHERE depth > 0")
ORACLES["lens_classes"] = with_graph(""" SELECT lens, count(*) AS n FROM nodes JOIN (VALUES ('prerequisites', 'Concept'), ('kinds', 'Concept'), ('courses', 'Course'), ('location', 'KnowledgeUnit Topic Concept'), ('contents', 'KnowledgeArea KnowledgeUnit Topic'),
    ('path', 'KnowledgeArea KnowledgeUnit Topic Concept Course'), ('resources', 'KnowledgeArea KnowledgeUnit Topic Concept Course'), ('neighborhood', 'KnowledgeArea KnowledgeUnit Topic Concept Course LearningResource ResourceType')) v(lens, classes)
    ON list_contains(string_split(classes, ' '), label) GROUP BY lens""")
ORACLES["node_connections"] = with_graph(" SELECT key, count(*) AS n FROM (SELECT source AS key FROM edges WHERE type <> 'WAS_DERIVED_FROM' UNION ALL SELECT target FROM edges WHERE type <> 'WAS_DERIVED_FROM') GROUP BY key")


def _loose(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: regexp_replace(w, 's$', '')), lambda w: w <> ''), ' ')"


_LABEL, _ALIAS = "p_name || ' ' || p_size", "p_type || ' ' || p_brand || ' ' || p_size"
ORACLES["ruled_notions"] = f"""WITH RECURSIVE names AS (SELECT p_partkey AS row_no, {_loose(_LABEL)} AS name FROM part WHERE p_size % 10 <> 1
        UNION SELECT p_partkey, {_loose(_ALIAS)} FROM part WHERE p_size % 10 <> 0 AND NOT (p_size % 10 = 1 AND {_loose(_ALIAS)} = {_loose(_LABEL)})),
    firsts AS (SELECT name, min(row_no) AS f FROM names GROUP BY name), pairs AS (SELECT row_no AS a, f AS b FROM names JOIN firsts USING (name) UNION SELECT p_partkey, p_partkey % 7 + 1 FROM part WHERE p_size = 50 UNION SELECT p_partkey, p_partkey FROM part),
    both_ AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON e.a = r.b), comp AS (SELECT a AS row_no, min(b) AS c FROM reach GROUP BY a)
    SELECT row_no, 'G-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS global_id FROM (SELECT row_no, dense_rank() OVER (ORDER BY c) AS n FROM comp)"""
ORACLES["loose_names"] = f"""SELECT p_partkey, {_loose("p_type || ' ' || p_brand")} AS name,
    array_to_string(list_transform(string_split(p_type || 's', ' '), lambda w: CASE WHEN lower(w) LIKE '%es' AND length(w) > 3 AND substr(lower(w), -3, 1) IN ('l', 'n', 'r', 'd', 'y') THEN substr(w, 1, length(w) - 2)
        WHEN lower(w) LIKE '%s' AND length(w) > 3 AND substr(lower(w), -2, 1) IN ('a', 'e', 'i', 'o', 'u') THEN substr(w, 1, length(w) - 1) ELSE w END), ' ') || ' (de) ' || p_name AS head FROM part"""
ORACLES["annotation_problems"] = """WITH r AS (SELECT p_size % 2 AS file, CAST(p_partkey AS VARCHAR) AS id, p_size, CASE WHEN p_size % 4 = 0 THEN 'tema' WHEN p_size = 7 THEN 'otro' ELSE 'concepto' END AS tipo,
        CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey - p_size % 30 AS VARCHAR) ELSE '' END AS up, CASE p_size % 5 WHEN 0 THEN 'q' WHEN 1 THEN 'n' ELSE '' END AS nota FROM part),
    w AS (SELECT r.*, q.tipo AS of FROM r LEFT JOIN r q ON q.file = r.file AND q.id = r.up AND q.p_size <> 50 WHERE r.p_size <> 50)
    SELECT CAST(file AS BIGINT) AS file, id, problem FROM (SELECT file, id, 'fields=8' AS problem FROM r WHERE p_size = 50 UNION ALL SELECT file, id, 'tipo=otro' FROM w WHERE tipo = 'otro' UNION ALL SELECT file, id, 'nivel=' FROM w WHERE p_size = 11
      UNION ALL SELECT file, id, 'seccion=x' FROM w WHERE p_size = 13 UNION ALL SELECT file, id, 'quoted note' FROM w WHERE nota = 'q' UNION ALL SELECT file, id, 'no such parent' FROM w WHERE up <> '' AND of IS NULL
      UNION ALL SELECT file, id, 'parent is no topic' FROM w WHERE up <> '' AND of <> 'tema' UNION ALL SELECT file, id, 'topic with a parent' FROM w WHERE up <> '' AND tipo = 'tema'
      UNION ALL SELECT file, id, 'concept without parent or note' FROM w WHERE up = '' AND tipo = 'concepto' AND nota = '')"""
ORACLES["run_warnings"] = """WITH f AS (SELECT o_custkey, min(o_orderkey) AS first FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
    n AS (SELECT o.o_custkey, first, count(*) AS before FROM orders o JOIN f USING (o_custkey) WHERE o_orderkey < first GROUP BY o.o_custkey, first)
    SELECT 'late' AS warning, o_orderkey AS run_id, CAST(o.o_custkey AS VARCHAR) AS syllabus FROM orders o JOIN f USING (o_custkey) JOIN customer ON c_custkey = o.o_custkey WHERE o_orderkey > first
    UNION ALL SELECT 'no test case', o_orderkey, CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'attempts', first, CAST(o_custkey AS VARCHAR) FROM n WHERE before >= 3 AND o_custkey IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'not run', NULL, CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"""
ORACLES["run_verdict"] = f"""WITH p AS (SELECT sum(hits) / sum(proposed) AS precision FROM {_SCORED}), a AS (SELECT count(*) = 0 AS complete FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
    SELECT precision, complete, CASE WHEN complete THEN precision >= 0.75 END AS passes, 'all' AS "of" FROM p, a UNION ALL SELECT precision, true, precision >= 0.75, 'run' FROM p"""
ORACLES["tree_counts"] = with_graph(_closure("down", _all("KnowledgeArea", "KnowledgeUnit", "Topic"), "PART_OF", 3, back=True) + """,
    c AS (SELECT n.key, n.label, count(*) FILTER (p.label = 'KnowledgeUnit') AS units, count(*) FILTER (p.label = 'Topic') AS topics, count(*) FILTER (p.label = 'Concept') AS concepts,
        count(*) FILTER (d.depth = 1 AND p.label <> 'Concept' AND n.label = 'KnowledgeArea' AND p.key NOT IN (SELECT target FROM edges WHERE type = 'PART_OF')) AS bare
      FROM nodes n JOIN down d ON d.root = n.key LEFT JOIN nodes p ON p.key = d.node AND d.depth > 0 WHERE n.label IN ('KnowledgeArea', 'KnowledgeUnit', 'Topic') GROUP BY n.key, n.label)
    SELECT key, units, topics, concepts, concepts BETWEEN 1 AND 24 AS with_concepts, bare, CASE WHEN bare > 4 THEN bare ELSE 0 END AS summarized FROM c""")
ORACLES["overview_ring"] = f"""SELECT key, part, place, coalesce(topics > 0, false) AS filled, CASE WHEN topics > 0 THEN topics || CASE WHEN topics = 1 THEN ' tema · ' ELSE ' temas · ' END || concepts || CASE WHEN concepts = 1 THEN ' concepto' ELSE ' conceptos' END END AS told
    FROM ({ORACLES['nav_overview']})"""
ORACLES["content_digests"] = "SELECT doc_id, substr(sha256(text), 1, 16) AS digest FROM documents"
