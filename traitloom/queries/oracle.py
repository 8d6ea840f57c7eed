"""The same queries as plain SQL over the same tables."""

from __future__ import annotations


def _term(key: str) -> str:
    return f"(CASE WHEN {key} % 10 = 7 THEN 'XX:' ELSE 'GO:' END || {key})"


_OBS = """obs AS (
  SELECT 'G' || o_custkey AS gene,
         CASE WHEN contains(o_orderpriority, 'URGENT') THEN 'lethal'
              WHEN contains(o_orderpriority, 'LOW') THEN 'viable' ELSE 'other' END AS status
  FROM orders)"""

_LABELS = _OBS + """, labels_ AS (
  SELECT gene, CASE WHEN bool_or(status = 'lethal') THEN 'lethal' ELSE 'viable' END AS status
  FROM obs GROUP BY gene)"""

_ANN = f"""ann AS (
  SELECT 'G' || o_custkey AS gene,
         CASE WHEN l_linenumber = 7 THEN 'GO:U' || l_suppkey ELSE {_term('l_partkey')} END AS term,
         l_orderkey, l_linenumber, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_returnflag = 'A')"""

_ANNOTATED = f"""{_LABELS}, {_ANN}, annotated AS (
  SELECT gene, status, term, count(*) AS copies
  FROM ann JOIN labels_ USING (gene) GROUP BY gene, status, term)"""


def _edges(alternates: bool = True, live: bool = True) -> str:
    where = "p_partkey > 0" + (" AND p_size <> 50" if live else "")
    children = f"SELECT p_partkey AS k, {_term('p_partkey')} AS child FROM part WHERE {where}"
    if alternates:
        children += f" UNION ALL SELECT p_partkey, 'GO:A' || p_partkey FROM part WHERE {where} AND p_size = 1"
    return f"""kids AS ({children}), edges_ AS (
  SELECT {_term('(k // 2)')} AS parent, child FROM kids
  UNION SELECT {_term('(k // 3)')}, child FROM kids)"""


_NODES = "nodes AS (SELECT parent AS term FROM edges_ UNION SELECT child FROM edges_)"
_GO = "go_terms AS (SELECT term FROM nodes WHERE contains(term, 'GO'))"
_OBSOLETE = f"obsolete AS (SELECT DISTINCT {_term('p_partkey')} AS term FROM part WHERE p_size = 50)"
_CLOSURE = """closure AS (
  SELECT term, term AS ancestor FROM nodes
  UNION SELECT c.term, e.parent FROM closure c JOIN edges_ e ON e.child = c.ancestor)"""
_DOWN = f"""roots_ AS (SELECT DISTINCT {_term('p_partkey')} AS root FROM part WHERE p_size = 7),
down AS (
  SELECT root, child AS term FROM roots_ JOIN edges_ ON parent = root
  UNION SELECT d.root, e.child FROM down d JOIN edges_ e ON e.parent = d.term)"""

_SIDES = """side AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS gene, l_linestatus AS s, l_returnflag AS flag, p_type AS term
  FROM lineitem JOIN part ON l_partkey = p_partkey),
ga AS (SELECT CAST(l_orderkey AS VARCHAR) AS gene,
         CASE WHEN bool_or(l_returnflag = 'R') THEN 'lethal' ELSE 'viable' END AS status
       FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
gb AS (SELECT CAST(l_orderkey AS VARCHAR) AS gene,
         CASE WHEN bool_or(l_returnflag = 'R') THEN 'lethal' ELSE 'viable' END AS status
       FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)"""


def _diff(not_a: str = "", not_b: str = "") -> str:
    """Every gene x term value of both matrices, 'NA' outside a vocabulary."""
    return f"""WITH {_SIDES},
va AS (SELECT DISTINCT term FROM side WHERE s = 'F' AND term <> '{not_a}'),
vb AS (SELECT DISTINCT term FROM side WHERE s = 'O' AND term <> '{not_b}'),
ca AS (SELECT DISTINCT gene, term FROM side WHERE s = 'F'),
cb AS (SELECT DISTINCT gene, term FROM side WHERE s = 'O'),
terms AS (SELECT term FROM va UNION SELECT term FROM vb),
grid AS (
  SELECT ga.gene, t.term,
         CASE WHEN va.term IS NULL THEN 'NA' WHEN ca.gene IS NULL THEN '0' ELSE '1' END AS a,
         CASE WHEN vb.term IS NULL THEN 'NA' WHEN cb.gene IS NULL THEN '0' ELSE '1' END AS b
  FROM ga JOIN gb USING (gene) CROSS JOIN terms t
  LEFT JOIN va ON va.term = t.term LEFT JOIN vb ON vb.term = t.term
  LEFT JOIN ca ON ca.gene = ga.gene AND ca.term = t.term
  LEFT JOIN cb ON cb.gene = ga.gene AND cb.term = t.term),
differing AS (SELECT gene, string_agg(term, ';' ORDER BY term) AS terms FROM grid WHERE a <> b GROUP BY gene),
rows_ AS (
  SELECT ga.gene, ga.status AS la, gb.status AS lb, gb.gene IS NULL AS gone,
         coalesce(d.terms, '') AS terms
  FROM ga LEFT JOIN gb USING (gene) LEFT JOIN differing d ON d.gene = ga.gene),
grouped AS (
  SELECT *, 1 AS rank, 'MISSING_IN_B' AS grp FROM rows_ WHERE gone
  UNION ALL SELECT *, 2, 'LABEL_MISMATCH' FROM rows_ WHERE NOT gone AND la <> lb
  UNION ALL SELECT *, 3, 'GO_TERM_MISMATCH' FROM rows_ WHERE NOT gone AND terms <> ''
  UNION ALL SELECT *, 4, 'EXACT_MATCH' FROM rows_ WHERE NOT gone AND la = lb AND terms = ''),
report AS (
  SELECT gene AS "Gene", la AS "Label A", coalesce(lb, '') AS "Label B", terms AS "GO Terms Differ",
         string_agg(grp, ';' ORDER BY rank) OVER (PARTITION BY gene) AS "Status", grp AS "group", rank
  FROM grouped)"""


_BRANDS = f"""{_LABELS}, brand AS (
  SELECT DISTINCT 'G''' || o_custkey AS gene, p_brand AS term
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
blab AS (SELECT 'G''' || substr(gene, 2) AS gene, status FROM labels_),
bvocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM (SELECT DISTINCT term FROM brand)),
bgenes AS (SELECT gene, status FROM blab WHERE gene IN (SELECT gene FROM brand))"""

_ENCODED = f"""SELECT g.gene, g.status, coalesce(s.n, 0) AS n, coalesce(s.idx_sum, 0) AS idx_sum
FROM (SELECT DISTINCT gene, status FROM annotated) g
LEFT JOIN (SELECT gene, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idx_sum
           FROM cells JOIN vocab_ USING (term) GROUP BY gene) s USING (gene)"""

_DIRECT_VOCAB = """vocab_ AS (
  SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx
  FROM go_terms WHERE term IN (SELECT term FROM annotated))"""

_TRACED = """traced AS (
  SELECT DISTINCT gene, status, ancestor AS term
  FROM annotated a JOIN closure c ON a.term = c.term WHERE contains(a.term, 'GO'))"""

_PAIRS = f"""WITH RECURSIVE {_edges()}, {_NODES}, {_CLOSURE}, {_OBSOLETE}, {_ANNOTATED}, {_TRACED},
pairs AS (
  SELECT gene, status, term FROM traced
  UNION SELECT gene, status, term FROM annotated
  WHERE contains(term, 'GO') AND term IN (SELECT term FROM obsolete))"""


_SUPPLIED = """SELECT DISTINCT CASE s_suppkey % 6 WHEN 0 THEN 'ring' WHEN 1 THEN 'small' WHEN 2 THEN 'gear'
    WHEN 3 THEN 'd b' WHEN 4 THEN 'line ' || s_suppkey END AS word FROM supplier"""

_CLASSIFY_TERMS = f"""WITH words AS ({_SUPPLIED}), flagged AS (
  SELECT p_partkey, p_size <> 9 AND EXISTS (SELECT 1 FROM words WHERE contains(p_name, word)) AS listed FROM part)
SELECT p_partkey, CASE WHEN listed THEN 'lethal' ELSE 'viable' END AS status, listed FROM flagged"""

# The cells of the fly rows, and the driver names, by the rules for fly.
_FLY_WITH = f"""WITH drivers AS (SELECT word AS name FROM ({_SUPPLIED}) WHERE word IS NOT NULL),
cells AS (
  SELECT p_partkey, p_brand || '-' || p_size AS gene,
         unnest([p_brand || '-' || p_size || '[' || p_partkey || ']', CAST(p_partkey AS VARCHAR),
           CASE p_type WHEN 'ECONOMY' THEN 'lethal, with ' || split_part(p_name, ' ', 1)
             WHEN 'SMALL' THEN 'viable, with ' || split_part(p_name, ' ', 1)
             WHEN 'PROMO' THEN 'lethal' WHEN 'STANDARD' THEN 'lethal'
             WHEN 'LARGE' THEN 'partially lethal' ELSE 'wing' END,
           CASE WHEN p_type = 'STANDARD' THEN 'with ' || split_part(p_name, ' ', 2) ELSE 'ref' END]) AS x
  FROM part),
marked AS (
  SELECT *, contains(x, 'with') AND NOT EXISTS (SELECT 1 FROM drivers WHERE contains(x, name)) AS partner
  FROM cells),
flags AS (
  SELECT p_partkey, gene, bool_or(contains(x, 'partially')) AS part_, bool_or(contains(x, 'lethal')) AS lethal,
         bool_or(contains(x, 'viable')) AS viable, bool_or(partner) AS partner,
         bool_or(partner AND contains(x, 'lethal')) AS lethal_partner
  FROM marked GROUP BY p_partkey, gene),
observed AS (
  SELECT gene, CASE WHEN lethal AND NOT partner THEN 'lethal' WHEN NOT lethal AND NOT viable THEN 'other'
                    WHEN viable THEN 'viable' ELSE 'other' END AS status
  FROM flags WHERE NOT part_ AND NOT lethal_partner)
SELECT gene, status, count(*) AS n FROM observed GROUP BY gene, status"""


def _gaf(extra: str = "") -> str:
    return f"""SELECT 'Y' || o_custkey AS gene, {_term('l_partkey')} AS term, count(*) AS copies
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_returnflag = 'A' AND l_linenumber <> 1 {extra} GROUP BY 1, 2"""


def _wide(key: str) -> str:
    return f"('WBPhenotype:' || lpad(CAST({key} AS VARCHAR), 12, '0'))"


_RAW = """SELECT o_orderkey, 'g' || o_custkey AS gene, 'g' || o_custkey || '[' || o_orderkey || ']' AS allele,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'x' || o_custkey WHEN '5' THEN 'y' ELSE '' END AS context,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Lethal, with x' || o_custkey || ' ' WHEN '2' THEN 'Dies early'
    WHEN '3' THEN 'dietary defect' WHEN '4' THEN 'wing' ELSE 'viable, with y' END AS phenotype,
  CASE substr(o_orderpriority, 1, 1) WHEN '4' THEN 'other' WHEN '5' THEN 'viable' ELSE 'lethal' END AS simple_pheno
FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0"""


def _csv(*cells: str) -> str:
    return " || ',' || ".join(f"(CASE WHEN contains({x}, ',') THEN '\"' || {x} || '\"' ELSE {x} END)" for x in cells)


def _rough(without: int, changed: str = "false", rows: str = "true") -> str:
    """The last row of each gene: brand, number of values, label."""
    return f"""(SELECT p_name || '/' || p_size AS gene,
    CASE WHEN {changed} THEN CAST(substr(p_brand, 7) AS INT) % 25 + 1 ELSE CAST(substr(p_brand, 7) AS INT) END AS b,
    CASE p_size % 5 WHEN 0 THEN 10 ELSE 24 END AS w, CASE WHEN p_partkey % 3 = 0 THEN 'lethal' ELSE 'viable' END AS status
  FROM part WHERE p_size NOT IN (7, 8) AND {rows}
  QUALIFY row_number() OVER (PARTITION BY p_name, p_size ORDER BY p_partkey DESC) = 1)"""


def _rough_value(row: str, without: int) -> str:
    """A brand's value in a row, 'NA' outside the attributes and beyond the row's end."""
    place = f"(i - (i > {without})::INT)"
    return f"CASE WHEN i = {without} OR {place} > {row}.w THEN 'NA' WHEN i = {row}.b THEN '1' ELSE '0' END"


_ARFF_DIFF = f"""WITH ra AS {_rough(3)}, rb AS {_rough(5, 'p_partkey % 4 = 0', 'p_size <> 9')},
differing AS (
  SELECT ra.gene, string_agg('Brand#' || i, ';' ORDER BY 'Brand#' || i) AS terms
  FROM ra JOIN rb USING (gene) CROSS JOIN range(1, 26) t(i)
  WHERE {_rough_value('ra', 3)} <> {_rough_value('rb', 5)} GROUP BY ra.gene),
rows_ AS (
  SELECT ra.gene, ra.status AS la, rb.status AS lb, rb.gene IS NULL AS gone, coalesce(terms, '') AS terms
  FROM ra LEFT JOIN rb ON rb.gene = ra.gene LEFT JOIN differing d ON d.gene = ra.gene),
grouped AS (
  SELECT *, 1 AS rank, 'MISSING_IN_B' AS grp FROM rows_ WHERE gone
  UNION ALL SELECT *, 2, 'LABEL_MISMATCH' FROM rows_ WHERE NOT gone AND la <> lb
  UNION ALL SELECT *, 3, 'GO_TERM_MISMATCH' FROM rows_ WHERE NOT gone AND terms <> ''
  UNION ALL SELECT *, 4, 'EXACT_MATCH' FROM rows_ WHERE NOT gone AND la = lb AND terms = '')
SELECT gene AS "Gene", la AS "Label A", coalesce(lb, '') AS "Label B", terms AS "GO Terms Differ",
       string_agg(grp, ';' ORDER BY rank) OVER (PARTITION BY gene) AS "Status", grp AS "group", rank
FROM grouped"""

ORACLE: dict[str, str] = {
    "str_before": """SELECT p_partkey, split_part(p_name || '[' || p_brand || ']', '[', 1) AS gene,
  split_part(p_type || '|' || p_name, '|', 1) AS synonym FROM part""",
    "str_after": """SELECT p_partkey, CASE WHEN contains(p_name, 'r')
  THEN trim(substr(p_name, strpos(p_name, 'r') + 1)) ELSE '' END AS context FROM part""",
    "classify_ci": """SELECT doc_id, CASE
  WHEN contains(lower(text), 'lethal') OR contains(lower(text), 'die') THEN 'lethal'
  WHEN contains(lower(text), 'viable') OR contains(lower(text), 'ing') THEN 'viable'
  ELSE 'other' END AS status FROM documents""",
    "classify_tag": """SELECT p_partkey, CASE
  WHEN (contains(p_name, 'ring') AND NOT contains(p_name, 'red ring')) OR contains(p_name, 'hot ring') THEN 'lethal'
  WHEN (contains(p_name, 'bolt') AND NOT contains(p_name, 'hot bolt')) OR contains(p_name, 'rod') THEN 'viable'
  ELSE 'other' END AS status FROM part""",
    "classify_anycol": """WITH c AS (SELECT p_partkey, [p_name, p_brand, p_type] AS cells FROM part),
d AS (SELECT p_partkey,
  len(list_filter(cells, lambda x: contains(x, 'PROMO'))) > 0 AS gone,
  len(list_filter(cells, lambda x: contains(x, 'red'))) > 0 AS lethal,
  len(list_filter(cells, lambda x: contains(x, 'Brand#1'))) > 0 AS viable FROM c)
SELECT p_partkey, CASE WHEN lethal THEN 'lethal' WHEN viable THEN 'viable' ELSE 'other' END AS status
FROM d WHERE NOT gone""",
    "classify_terms": _CLASSIFY_TERMS,
    "classify_terms_join": _CLASSIFY_TERMS,
    "classify_turns": """WITH words AS (SELECT DISTINCT lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS word FROM orders),
turns AS (SELECT row_number() OVER () AS r, * FROM conversations),
pieces AS (
  SELECT r, substr(text, place, 4) AS word
  FROM (SELECT r, text, unnest(range(1, length(text) - 2)) AS place FROM turns)),
hits AS (SELECT DISTINCT r FROM pieces SEMI JOIN words USING (word))
SELECT conv_id, turn, role, r IN (SELECT r FROM hits) AS listed FROM turns""",
    "extract_ids": "SELECT DISTINCT unnest(regexp_extract_all(html, '/[a-z]{4,12}')) AS id FROM pages ORDER BY id",
    "label": f"WITH {_LABELS} SELECT gene, status FROM labels_",
    "label_strict": f"""WITH {_OBS}
SELECT gene, CASE WHEN bool_or(status = 'lethal') THEN 'lethal' ELSE 'viable' END AS status
FROM obs GROUP BY gene HAVING NOT (bool_or(status = 'lethal') AND bool_or(status = 'viable'))""",
    "label_counts": f"""WITH {_ANNOTATED}
SELECT status, count(*) AS genes, 'labelled' AS stage FROM labels_ GROUP BY status
UNION ALL SELECT status, count(DISTINCT gene), 'annotated' FROM annotated GROUP BY status""",
    "gene_summary": f"""WITH {_OBS}, f AS (
  SELECT gene, bool_or(status = 'lethal') AS l, bool_or(status = 'viable') AS v FROM obs GROUP BY gene)
SELECT gene, CASE WHEN l THEN 'True' ELSE 'False' END AS ever_lethal,
  CASE WHEN v THEN 'True' ELSE 'False' END AS ever_viable,
  CASE WHEN l AND v THEN 'sometimes lethal, sometimes viable (context-dependent)'
       WHEN l THEN 'always lethal in data' WHEN v THEN 'always viable in data'
       ELSE 'no lethal/viable phenotypes found' END AS summary FROM f""",
    "annotate": f"WITH {_ANNOTATED} SELECT gene, status, term, copies FROM annotated",
    "annotate_list": f"""WITH {_ANN}
SELECT gene, row_number() OVER (PARTITION BY gene ORDER BY l_orderkey, l_linenumber, l_suppkey, term) - 1 AS nth,
  term FROM ann""",
    "skip_first": f"""WITH {_ANN}, numbered AS (
  SELECT gene, term,
    row_number() OVER (PARTITION BY gene ORDER BY l_orderkey, l_linenumber, l_suppkey, term) AS nth FROM ann)
SELECT gene, term, count(*) AS copies FROM numbered WHERE nth > 1 GROUP BY gene, term""",
    "semi_assign": f"""WITH {_ANNOTATED}
SELECT gene, status, term, copies FROM annotated WHERE gene IN (
  SELECT 'G' || c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_nationkey <> 3)""",
    "edges": f"WITH {_edges(alternates=False)} SELECT parent, child FROM edges_",
    "edges_alt": f"WITH {_edges()} SELECT parent, child FROM edges_",
    "vocab": f"""WITH {_edges()}, {_NODES}, {_GO}
SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM go_terms""",
    "vocab_union": f"""WITH RECURSIVE {_edges()}, {_DOWN}, {_ANN}
SELECT term FROM ann UNION SELECT term FROM down""",
    "attribute_lines": f"""WITH {_edges(alternates=False, live=False)}, {_NODES}
SELECT '@attribute ' || term || ' {{1,0}}' AS line FROM nodes""",
    "adjacency": f"""WITH {_edges()}
SELECT child AS id, 'p' AS side, parent AS other FROM edges_ UNION ALL SELECT parent, 'c', child FROM edges_""",
    "ancestors": f"WITH RECURSIVE {_edges()}, {_NODES}, {_CLOSURE} SELECT term, ancestor FROM closure",
    "descendants": f"WITH RECURSIVE {_edges()}, {_DOWN} SELECT root, term FROM down",
    "descendant_counts": f"""WITH RECURSIVE {_edges()}, {_DOWN}
SELECT r.root, count(d.term) AS descendants FROM roots_ r LEFT JOIN down d ON d.root = r.root GROUP BY r.root
UNION ALL SELECT '*', count(*) FROM (SELECT root AS t FROM roots_ UNION SELECT term FROM down)""",
    "unknown_terms": f"""WITH {_edges()}, {_NODES}, {_OBSOLETE}, {_ANN}
SELECT DISTINCT term FROM ann WHERE term NOT IN (SELECT term FROM nodes)
  AND term NOT IN (SELECT term FROM obsolete)""",
    "obsolete_terms": f"""WITH {_edges()}, {_NODES}, {_OBSOLETE}, {_ANN}
SELECT DISTINCT term FROM ann WHERE term NOT IN (SELECT term FROM nodes)
  AND term IN (SELECT term FROM obsolete)""",
    "missing_terms": f"""WITH {_edges()}, {_NODES}, {_GO}, {_ANN}
SELECT DISTINCT term FROM ann WHERE term NOT IN (SELECT term FROM go_terms)""",
    "encode_direct": f"""WITH {_edges()}, {_NODES}, {_GO}, {_ANNOTATED}, {_DIRECT_VOCAB},
cells AS (SELECT gene, term FROM annotated) {_ENCODED}""",
    "encode_propagated": f"""WITH RECURSIVE {_edges()}, {_NODES}, {_GO}, {_CLOSURE}, {_ANNOTATED}, {_TRACED},
vocab_ AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM go_terms),
cells AS (SELECT gene, term FROM traced) {_ENCODED}""",
    "encode_pruned_closure": f"""WITH RECURSIVE {_edges()}, {_NODES}, {_GO}, {_CLOSURE}, {_ANNOTATED}, {_TRACED},
vocab_ AS (
  SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx
  FROM go_terms WHERE term IN (SELECT term FROM traced))
SELECT g.gene, g.status, coalesce(string_agg(v.idx, ',' ORDER BY v.idx), '') AS ix
FROM (SELECT DISTINCT gene, status FROM annotated) g
LEFT JOIN (SELECT DISTINCT gene, term FROM traced) t ON t.gene = g.gene LEFT JOIN vocab_ v ON v.term = t.term
GROUP BY g.gene, g.status""",
    "prune_vocab": f"""WITH {_edges()}, {_NODES}, {_GO}, {_ANNOTATED}, {_DIRECT_VOCAB}
SELECT term, idx FROM vocab_""",
    "gene_term_pairs": f"{_PAIRS} SELECT term, count(*) AS genes FROM pairs GROUP BY term",
    "gene_term_label": f"""{_PAIRS}
SELECT gene, term, CASE status WHEN 'lethal' THEN 1 ELSE 0 END AS label FROM pairs""",
    "pivot_small": f"""WITH {_BRANDS}
SELECT gene, status, {', '.join(
    f'''max(CASE WHEN term = 'Brand#{i}' THEN 1 ELSE 0 END) AS "Brand#{i}"''' for i in range(1, 26))}
FROM brand JOIN blab USING (gene) GROUP BY gene, status""",
    "wide_blocks": f"""WITH pairs AS (
  SELECT DISTINCT c_nationkey AS gene, {_term('l_partkey')} AS term
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
vocab_ AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM (SELECT DISTINCT term FROM pairs))
SELECT g.gene, (v.idx // 1000)::INT AS block,
       string_agg(CASE WHEN p.term IS NULL THEN '0' ELSE '1' END, ',' ORDER BY v.idx) AS flags
FROM (SELECT DISTINCT gene FROM pairs) g CROSS JOIN vocab_ v LEFT JOIN pairs p ON p.gene = g.gene AND p.term = v.term
GROUP BY ALL""",
    "arff_lines": f"""WITH {_BRANDS}
SELECT 0 AS section, 0 AS at, '@RELATION gene_lethality' || chr(10) AS line
UNION ALL SELECT 0, 1, '@ATTRIBUTE gene string'
UNION ALL SELECT 1, idx, '@ATTRIBUTE ' || term || ' {{0,1}}' FROM bvocab
UNION ALL SELECT 2, 0, '@ATTRIBUTE class {{viable,lethal}}' || chr(10)
UNION ALL SELECT 2, 1, '@DATA'
UNION ALL SELECT 3, 0, replace(g.gene, '''', '-') || ',' ||
  string_agg(CASE WHEN b.gene IS NULL THEN '0' ELSE '1' END, ',' ORDER BY v.idx) || ',' || any_value(g.status)
FROM bgenes g CROSS JOIN bvocab v LEFT JOIN brand b ON b.gene = g.gene AND b.term = v.term GROUP BY g.gene""",
    "matrix_diff": f"{_diff()} SELECT * FROM report",
    "matrix_diff_vocab": f"""{_diff('PROMO', 'SMALL')}
SELECT "Gene", "Label A", "Label B", "GO Terms Differ", "Status" FROM report ORDER BY rank, "Gene" """,
    "diff_counts": f"""{_diff()}
SELECT s.status, count(r."group") AS rows
FROM (VALUES ('MISSING_IN_B'), ('LABEL_MISMATCH'), ('GO_TERM_MISMATCH'), ('EXACT_MATCH')) s(status)
LEFT JOIN report r ON r."group" = s.status GROUP BY s.status""",
    "scan_yeast": """WITH o AS (
  SELECT 'Y' || o_custkey AS gene, o_orderstatus = 'P' AS flagged,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'inviable' WHEN '5' THEN 'viable'
      WHEN '2' THEN 'viable: slow' ELSE 'growth' END AS status FROM orders)
SELECT gene, status, count(*) AS n FROM o
WHERE flagged OR status = 'inviable' OR contains(status, 'viable') GROUP BY gene, status""",
    "scan_fly": """WITH o AS (
  SELECT p_name || ' ' || p_brand AS gene,
    CASE p_type WHEN 'ECONOMY' THEN 'lethal' WHEN 'SMALL' THEN 'viable' WHEN 'STANDARD' THEN 'viable'
      WHEN 'PROMO' THEN NULL ELSE 'other' END AS status FROM part WHERE p_size <> 9)
SELECT gene, CASE WHEN bool_or(status = 'lethal') THEN 'lethal' ELSE 'viable' END AS status
FROM o WHERE status IS NOT NULL AND gene IN (
  SELECT p_name || ' ' || p_brand FROM part WHERE p_size > 20 AND p_type <> 'MEDIUM') GROUP BY gene""",
    "scan_fly_with": _FLY_WITH,
    "scan_fly_with_join": _FLY_WITH,
    "scan_fish": """WITH o AS (
  SELECT 'F' || o_custkey AS gene, o_orderstatus = 'P' AS boxed,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'lethal' WHEN '3' THEN 'lethal'
      WHEN '5' THEN 'viable' ELSE 'other' END AS status FROM orders)
SELECT CASE WHEN boxed AND status <> 'other' THEN gene || '[x]' ELSE gene END AS gene, status, count(*) AS n
FROM o GROUP BY 1, 2""",
    "scan_worm": """SELECT 'W' || user_id AS gene,
  CASE WHEN event_id % 40 IN (SELECT n_nationkey FROM nation) AND event_type <> 'error'
       THEN 'lethal' ELSE 'viable' END AS status, count(*) AS n FROM events GROUP BY 1, 2""",
    "scan_mouse": """SELECT 'MGI:' || l_suppkey AS gene,
  CASE WHEN CAST(l_quantity AS INT) IN (SELECT n_nationkey FROM nation)
       THEN 'lethal' ELSE 'viable' END AS status, count(*) AS n
FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1, 2""",
    "scan_gaf": _gaf(),
    "scan_gaf_positive": _gaf("AND l_linestatus <> 'O'"),
    "scan_obo_edges": f"WITH {_edges()} SELECT parent, child FROM edges_",
    "scan_lethal_terms": f"""WITH RECURSIVE e AS (
  SELECT p_partkey // 2 AS parent, p_partkey AS child FROM part WHERE p_partkey > 0
  UNION SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey > 0),
down AS (
  SELECT p_partkey AS k FROM part WHERE p_size = 7
  UNION SELECT e.child FROM down JOIN e ON e.parent = down.k)
SELECT {_wide('k')} AS "ID", CASE WHEN p_type = 'PROMO' THEN '**NOT-FOUND**' ELSE p_name END AS "Name"
FROM down JOIN part ON p_partkey = k
UNION ALL SELECT {_wide('p_partkey + 900000000000')}, '**NOT-FOUND**' FROM part WHERE p_size = 7
ORDER BY 1""",
    "scan_arff": f"""WITH {_BRANDS}
SELECT replace(gene, '''', '-') AS gene, status, term, '1' AS value FROM bgenes JOIN brand USING (gene)""",
    "scan_fly_raw": f"SELECT gene, allele, context, phenotype, simple_pheno FROM ({_RAW})",
    "scan_arff_rough": f"""SELECT gene, status, 'Brand#' || i AS term, {_rough_value('r', 3)} AS value
FROM {_rough(3)} r CROSS JOIN range(1, 26) t(i) WHERE i <> 3 AND {_rough_value('r', 3)} <> '0'""",
    "arff_diff": _ARFF_DIFF,
    "file_pairs": f"""{_PAIRS}
SELECT gene || chr(9) || term || chr(9) || CASE status WHEN 'lethal' THEN '1' ELSE '0' END AS line FROM pairs""",
    "file_adjacency": f"""WITH {_edges()}
SELECT child AS id, 'p' AS side, parent AS other FROM edges_ UNION ALL SELECT parent, 'c', child FROM edges_""",
    "file_nodes": f"WITH {_edges()}, {_NODES}, {_GO} SELECT term AS line FROM go_terms",
    "file_attributes": f"""WITH {_edges(alternates=False, live=False)}, {_NODES}
SELECT '@attribute ' || term || ' {{1,0}}' AS line FROM nodes""",
    "file_terms": f"""SELECT 'ID' || chr(9) || 'Name' AS line
UNION ALL SELECT {_term('p_partkey')} || chr(9) || CASE WHEN p_name LIKE 'r%' THEN '**NOT-FOUND**' ELSE p_name END
FROM part WHERE p_size = 7""",
    "file_report": f"""{_diff('PROMO', 'SMALL')}
SELECT 'Gene,Label A,Label B,GO Terms Differ,Status' AS line
UNION ALL SELECT "Gene" || ',' || "Label A" || ',' || "Label B" || ',' || "GO Terms Differ" || ',' || "Status" FROM report""",
    "file_summary": f"""WITH {_OBS}, f AS (
  SELECT gene, bool_or(status = 'lethal') AS l, bool_or(status = 'viable') AS v FROM obs GROUP BY gene),
s AS (SELECT gene, CASE WHEN l THEN 'True' ELSE 'False' END AS el, CASE WHEN v THEN 'True' ELSE 'False' END AS ev,
  CASE WHEN l AND v THEN 'sometimes lethal, sometimes viable (context-dependent)'
       WHEN l THEN 'always lethal in data' WHEN v THEN 'always viable in data'
       ELSE 'no lethal/viable phenotypes found' END AS summary FROM f)
SELECT 'gene,ever_lethal,ever_viable,summary' AS line UNION ALL SELECT {_csv('gene', 'el', 'ev', 'summary')} FROM s""",
    "file_raw": f"""SELECT 'gene,allele,context,phenotype,simple_pheno' AS line
UNION ALL SELECT {_csv('gene', 'allele', 'context', 'phenotype', 'simple_pheno')} FROM ({_RAW})""",
}
