"""Block trees, formula islands and table grids, built from the text tables row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import markup, trees
from tessera.plans.base import query

c = F.col

#: A conversation as a tree as deep as it has turns: each list holds a turn and the rest of the conversation.
_TREES = """SELECT conv_id, list_reduce(nodes, lambda acc, x: '{"t":"list","items":[[' || x || '],' || acc || ']}')::JSON AS node FROM (SELECT conv_id, list(CASE role
WHEN 'user' THEN '{"t":"p","c":[' || to_json({'t': 's', 'v': coalesce(text, '')}) || ',' || to_json({'t': 'm', 'tex': substr(text, 1, 1 + turn % 3)}) || ',{"t":"br"},' || to_json({'t': 'img', 'src': role || turn}) || ']}'
WHEN 'assistant' THEN '{"t":"table","rows":[[{"c":[' || to_json({'t': 's', 'v': substr(text, 1, 20)}) || ']},{"c":[' || to_json({'t': 'm', 'tex': substr(text, 3, 2)}) || ',{"t":"tab"}]}],[{"c":[{"t":"warn","v":"x"}]}]]}'
ELSE '[{"t":"p","review":true,"header":[{"t":"img","src":"top"}],"c":[{"t":"range"},[' || to_json({'t': 's', 'v': coalesce(text, '')}) || ']]},7,"loose",null]' END ORDER BY turn DESC, role DESC, text DESC) AS nodes
FROM conversations GROUP BY conv_id)"""
_LIST_ROLE = "CASE role WHEN 'node' THEN 'node' WHEN 'rows' THEN 'row' WHEN 'row' THEN 'cell' WHEN 'items' THEN 'item' WHEN 'item' THEN 'node' END"
_NODE = "role IN ('node', 'item')"
_WALK = f"""WITH RECURSIVE walk AS (SELECT conv_id, []::INT[] AS path, 'node' AS role, node FROM ({_TREES}) UNION ALL
SELECT conv_id, list_append(path, x.i::INT), x.role, x.node FROM (SELECT conv_id, path, unnest(CASE json_type(node) WHEN 'ARRAY' THEN list_transform(json_extract(node, '$[*]'), lambda e, i: {{'i': i - 1, 'role': {_LIST_ROLE}, 'node': e}})
WHEN 'OBJECT' THEN list_filter([{{'i': 0::BIGINT, 'role': CASE WHEN {_NODE} AND node->>'$.t' = 'p' OR role = 'cell' THEN 'node' END, 'node': json_extract(node, '$.c')}}, {{'i': 1, 'role': CASE WHEN {_NODE} AND node->>'$.t' = 'table' THEN 'rows' END, 'node': json_extract(node, '$.rows')}},
  {{'i': 2, 'role': CASE WHEN {_NODE} AND node->>'$.t' = 'list' THEN 'items' END, 'node': json_extract(node, '$.items')}}, {{'i': 3, 'role': NULL, 'node': json_extract(node, '$.content')}}, {{'i': 4, 'role': NULL, 'node': json_extract(node, '$.header')}}, {{'i': 5, 'role': NULL, 'node': json_extract(node, '$.passage')}}], lambda z: z.node IS NOT NULL) END) AS x FROM walk)),
nodes AS MATERIALIZED (SELECT conv_id, path, role, CASE json_type(node) WHEN 'OBJECT' THEN node->>'$.t' END AS t, node->>'$.v' AS v, node->>'$.tex' AS tex, node->>'$.src' AS src, node->>'$.review' = 'true' AS review FROM walk)"""


def _trees(t):
    text = F.coalesce("text", F.lit(""))
    one = lambda kind, key, value: F.to_json(F.struct(F.lit(kind).alias("t"), value.alias(key)))
    user = F.concat(F.lit('{"t":"p","c":['), one("s", "v", text), F.lit(","), one("m", "tex", F.substring(c("text"), F.lit(1), 1 + c("turn").cast("int") % 3)), F.lit(',{"t":"br"},'), one("img", "src", F.concat("role", c("turn").cast("string"))), F.lit("]}"))
    reply = F.concat(F.lit('{"t":"table","rows":[[{"c":['), one("s", "v", F.substring("text", 1, 20)), F.lit(']},{"c":['), one("m", "tex", F.substring("text", 3, 2)), F.lit(',{"t":"tab"}]}],[{"c":[{"t":"warn","v":"x"}]}]]}'))
    other = F.concat(F.lit('[{"t":"p","review":true,"header":[{"t":"img","src":"top"}],"c":[{"t":"range"},['), one("s", "v", text), F.lit(']]},7,"loose",null]'))
    node = F.when(c("role") == "user", user).when(c("role") == "assistant", reply).otherwise(other)
    turns = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", node.alias("node"))), False).alias("x"))
    nested = F.aggregate(F.slice("x", F.lit(2), F.size("x")), F.get("x", F.lit(0))["node"], lambda acc, x: F.concat(F.lit('{"t":"list","items":[['), x["node"], F.lit("],"), acc, F.lit("]}")))
    return trees.walk(turns.select("conv_id", nested.alias("tree")), "conv_id", "tree")


@query(f"""{_WALK} SELECT conv_id, array_to_string(list_sort(list_distinct(list(tex) FILTER (t = 'm' AND tex <> ''))), '|') AS tex, array_to_string(list_sort(list_distinct(list(src) FILTER (t = 'img' AND src <> ''))), '|') AS images,
coalesce(bool_or(t = 'table'), false) AS has_table, count(*) FILTER (t = 'warn' OR review) AS warns, count(*) AS places, max(len(path)) AS depth FROM nodes GROUP BY conv_id""")
def c19_tree_facts(t):
    nodes = _trees(t)
    size = nodes.groupBy("conv_id").agg(F.count("*").alias("places"), F.max("depth").alias("depth"))
    facts = trees.tree_facts(nodes, "conv_id").join(size, "conv_id")
    return facts.withColumns({k: F.when(F.size(k) > 0, F.array_join(k, "|")) for k in ("tex", "images")})


@query(f"""{_WALK}, pieces AS (SELECT conv_id, path, CASE WHEN {_NODE} THEN CASE t WHEN 's' THEN v WHEN 'm' THEN ' ' || tex || ' ' WHEN 'br' THEN ' ' WHEN 'tab' THEN ' ' WHEN 'range' THEN '…' END END AS s FROM nodes
  UNION ALL SELECT conv_id, list_append(path, 2147483647), CASE WHEN {_NODE} AND t = 'p' THEN chr(10) ELSE '' END || CASE WHEN role = 'cell' THEN ' | ' WHEN role IN ('row', 'item') THEN chr(10) ELSE '' END FROM nodes)
SELECT conv_id, regexp_replace(regexp_replace(regexp_replace(string_agg(s, '' ORDER BY path), '[ \\t]+', ' ', 'g'), '^\\s+', ''), '\\s+$', '') AS text FROM pieces GROUP BY conv_id""")
def c20_plain_text(t):
    return trees.plain_text(_trees(t), "conv_id")


#: Texts with braces, openers and backslashes where some letters and words were: nested, unbalanced and unfinished.
_BRACED = r"replace(replace(replace(translate(text, 'wk', '}{'), 'the', '{{tex:'), 'on', '}}'), ', ', '\')"


def _islands(source: str) -> str:
    """CTEs from docs (doc_id, body) to rests (doc_id, rest) and inside (doc_id, n, f), the islands of each body."""
    return rf"""WITH RECURSIVE docs AS MATERIALIZED ({source}),
tokens AS MATERIALIZED (SELECT doc_id, unnest(ts) AS s, unnest(range(len(ts))) AS i FROM (SELECT doc_id, regexp_extract_all(body, '\\+|\{{\{{tex:|[{{}}]|[^\\{{}}]+') AS ts FROM docs WHERE contains(body, '{{{{tex:'))),
looked AS (SELECT *, lead(s) OVER w AS following, lag(s) OVER w LIKE '\%' ESCAPE '^' AND length(lag(s) OVER w) % 2 = 1 AS escaped FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
stepped AS (SELECT *, CASE s WHEN '{{{{tex:' THEN 2 WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END AS raw, CASE WHEN coalesce(escaped, false) THEN 1 ELSE 0 END AS e FROM looked),
deep AS MATERIALIZED (SELECT doc_id, i, s, following, e, raw - e * sign(raw) AS step, sum(raw - e * sign(raw)) OVER (PARTITION BY doc_id ORDER BY i) AS d FROM stepped),
openers AS MATERIALIZED (SELECT o.doc_id, o.i, min(z.i) AS z FROM deep o LEFT JOIN deep z ON z.doc_id = o.doc_id AND z.i > o.i AND z.s = '}}' AND z.e = 0 AND z.following = '}}' AND z.d - z.step = o.d WHERE o.s = '{{{{tex:' GROUP BY o.doc_id, o.i),
chain AS (SELECT doc_id, 0::BIGINT AS n, i, z FROM openers QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1 UNION ALL
  SELECT c.doc_id, c.n + 1, o.i, o.z FROM chain c JOIN openers o ON o.doc_id = c.doc_id AND o.i >= c.z + 2 QUALIFY row_number() OVER (PARTITION BY c.doc_id ORDER BY o.i) = 1),
islands AS MATERIALIZED (SELECT * FROM chain WHERE z IS NOT NULL),
labelled AS (SELECT t.doc_id, t.i, t.s, n, x.i AS a, x.z FROM tokens t ASOF LEFT JOIN islands x ON x.doc_id = t.doc_id AND x.i <= t.i),
inside AS (SELECT doc_id, n, coalesce(string_agg(s, '' ORDER BY i) FILTER (i > a AND i < z), '') AS f FROM labelled WHERE n IS NOT NULL GROUP BY doc_id, n),
rests AS (SELECT doc_id, string_agg(CASE WHEN i = a THEN chr(0) || 'TEX' || n || chr(0) WHEN n IS NULL OR i > z + 1 THEN s ELSE '' END, '' ORDER BY i) AS rest FROM labelled GROUP BY doc_id)
"""


@query(_islands(f"SELECT doc_id, {_BRACED} AS body FROM documents") + " SELECT doc_id, any_value(sha256(coalesce(rest, body))) AS rest, count(n) AS islands, sha256(coalesce(string_agg(f, chr(31) ORDER BY n), '')) AS formulas FROM docs LEFT JOIN rests USING (doc_id) LEFT JOIN inside USING (doc_id) GROUP BY doc_id")
def k1_formula_islands(t):
    body = F.replace(F.replace(F.replace(F.translate("text", "wk", "}{"), F.lit("the"), F.lit("{{tex:")), F.lit("on"), F.lit("}}")), F.lit(", "), F.lit("\\"))
    found = markup.formula_islands(t.documents.select("doc_id", body.alias("body")), "doc_id", "body")
    return found.select("doc_id", F.sha2("rest", 256).alias("rest"), F.size("formulas").cast("long").alias("islands"), F.sha2(F.array_join("formulas", "\x1f"), 256).alias("formulas"))


#: Paragraphs: texts parted at some words, with references to tables among them, and islands that stand alone.
_MARKED = [(" and ", "\n\n"), (" die ", "\n \n{{tbl:1}}\n\n"), (" de ", "\n\n{{tex:a{b}}} \n\n"), (" the ", " {{tex:x}}"), (" que ", "\n\n {{tbl:7}} \n\n")]


def _marked_sql() -> str:
    x = "substr(text, 1, 900)"
    for old, new in _MARKED:
        x = f"replace({x}, '{old}', '{new}')"
    return x


_PARTS = f"SELECT doc_id AS id, n_chars % 3 AS tables, ps[i] AS part, i - 1 AS n FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, n_chars, list_filter(regexp_split_to_array({_marked_sql()}, '\\n\\s*\\n'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '') AS ps FROM documents))"
_REF = "nullif(regexp_extract(part, '^\\s*\\{\\{tbl:([0-9]+)\\}\\}\\s*$', 1), '')"


@query(_islands(f"SELECT id || ':' || n AS doc_id, id, n AS num, tables, {_REF}::INT AS ref, CASE WHEN {_REF} IS NULL THEN part END AS body FROM ({_PARTS})") + """, fs AS (SELECT doc_id, count(n) AS formulas FROM inside GROUP BY 1)
SELECT id AS doc_id, num AS n, CASE WHEN ref IS NULL THEN 'p' WHEN ref < tables THEN 'table' ELSE 'missing_table' END AS kind, ref AS \"table\", ref IS NULL AND coalesce(formulas, 0) = 1 AND trim(rest) = chr(0) || 'TEX0' || chr(0) AS display, CASE WHEN ref IS NULL THEN sha256(coalesce(rest, body)) END AS rest, coalesce(formulas, 0) AS formulas FROM docs LEFT JOIN rests USING (doc_id) LEFT JOIN fs USING (doc_id)""")
def k3_paragraph_kinds(t):
    text = F.substring("text", 1, 900)
    for old, new in _MARKED:
        text = F.replace(text, F.lit(old), F.lit(new))
    p = markup.paragraphs(t.documents.select("doc_id", text.alias("t"), "n_chars"), "doc_id", "t", c("n_chars") % 3)
    return p.withColumn("rest", F.sha2("rest", 256)).withColumn("formulas", F.size("formulas").cast("long"))


@query("""WITH RECURSIVE n AS (SELECT l_suppkey AS tab, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_tax) - 1 AS k, 1 + (l_quantity::INT % 5 = 0)::INT AS span, CASE l_returnflag WHEN 'R' THEN 'restart' WHEN 'A' THEN 'continue' END AS vm FROM lineitem),
cells AS MATERIALIZED (SELECT tab, k // 4 AS r, k % 4 AS i, span, vm, (sum(span) OVER (PARTITION BY tab, k // 4 ORDER BY k) - span)::BIGINT AS col FROM n),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tab, col ORDER BY r) AS j FROM cells),
fold AS (SELECT *, vm IS NOT DISTINCT FROM 'restart' AS open, 1 AS anchor, false AS up FROM numbered WHERE j = 1 UNION ALL
  SELECT x.*, CASE WHEN x.vm = 'continue' AND f.open THEN true ELSE x.vm IS NOT DISTINCT FROM 'restart' END, CASE WHEN x.vm = 'continue' AND f.open THEN f.anchor ELSE x.j END, coalesce(x.vm = 'continue' AND f.open, false) FROM fold f JOIN numbered x ON x.tab = f.tab AND x.col = f.col AND x.j = f.j + 1),
heights AS (SELECT tab, col, anchor, count(*) AS rowspan FROM fold GROUP BY 1, 2, 3)
SELECT f.tab, f.r, row_number() OVER (PARTITION BY f.tab, f.r ORDER BY f.i) - 1 AS out_place, f.col, f.span AS colspan, h.rowspan FROM fold f JOIN heights h ON h.tab = f.tab AND h.col = f.col AND h.anchor = f.j WHERE NOT f.up""")
def k4_table_grid(t):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_tax")) - 1
    cells = t.lineitem.select(c("l_suppkey").alias("tab"), k.alias("k"), (1 + (c("l_quantity").cast("int") % 5 == 0).cast("int")).alias("span"), F.when(c("l_returnflag") == "R", "restart").when(c("l_returnflag") == "A", "continue").alias("vm"))
    cells = cells.select("tab", F.floor(c("k") / 4).alias("r"), (c("k") % 4).alias("i"), "span", "vm")
    return trees.table_grid(cells, "tab", "r", "i", "span", "vm")
