"""Shared SQL of the oracles: derived texts, lines, statistics, n-grams, splits."""

from __future__ import annotations

# The Python whitespace set in RE2 notation.
WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

SNIPPETS = "snippets AS (SELECT doc_id AS snippet_id, text AS code, source AS task_name FROM documents)"

LABELLED = """labelled AS (
  SELECT d.doc_id AS snippet_id, d.text AS code,
         CASE WHEN l.quality = 1 THEN 'Human_written' ELSE 'AI_generated' END AS label, d.source AS task_name
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

PERTURBED = """p0 AS (SELECT doc_id AS snippet_id,
    replace(text, '. ', '.' || chr(10) || chr(10) || chr(9) || '  ') AS t FROM documents),
p1 AS (SELECT snippet_id, CASE WHEN snippet_id % 3 = 0 THEN replace(t, chr(10), ' ' || chr(10)) ELSE t END AS t FROM p0),
p2 AS (SELECT snippet_id, CASE WHEN snippet_id % 5 = 0 THEN replace(t, chr(10), chr(13) || chr(10))
    WHEN snippet_id % 5 = 1 THEN replace(t, chr(10), chr(13)) ELSE t END AS t FROM p1),
perturbed AS (SELECT snippet_id, CASE WHEN snippet_id % 7 = 0 THEN replace(t, ', ',
    ' ' || chr(8195) || ',' || chr(160) || chr(28) || chr(10) || chr(12288) || chr(8232) || chr(10)) ELSE t END AS code FROM p2)"""

NEWLINES = "replace(replace(coalesce(code, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
COLLAPSED = f"trim(regexp_replace(coalesce(code, ''), '[{WS}]+', ' ', 'g'))"


def line_stats(source: str, code: str = NEWLINES) -> str:
    """CTEs ending in line_stats(snippet_id, the nine line and indentation statistics)."""
    return f"""lines AS (SELECT snippet_id, unnest(string_split({code}, chr(10))) AS l FROM {source}),
line_facts AS (SELECT snippet_id, length(l) AS len, regexp_full_match(l, '[{WS}]*') AS blank,
    (l LIKE '% ' OR l LIKE '%' || chr(9)) AS trail, length(l) - length(ltrim(l, ' ' || chr(9))) AS ind,
    l LIKE chr(9) || '%' AS tab FROM lines),
line_stats AS (SELECT snippet_id, count(*) AS n_lines, avg(len) AS avg_line_len, stddev_pop(len) AS stdev_line_len,
    max(len) AS max_line_len, count(*) FILTER (WHERE blank) / count(*) AS blank_ratio,
    count(*) FILTER (WHERE trail) / count(*) AS trailing_ws_ratio,
    coalesce(avg(ind) FILTER (WHERE NOT blank), 0) AS avg_indent,
    coalesce(max(ind) FILTER (WHERE NOT blank), 0) AS max_indent,
    count(*) FILTER (WHERE tab AND NOT blank) / greatest(count(*) FILTER (WHERE NOT blank), 1) AS tab_leading_ratio
    FROM line_facts GROUP BY snippet_id)"""


def grams(source: str, key: str = "snippet_id", code: str = COLLAPSED, name: str = "grams") -> str:
    """CTEs ending in <name>(key, n, gram): one row per n-gram occurrence."""
    return f"""{name}_text AS (SELECT {key}, string_split(lower({code}), '') AS cs FROM {source}),
{name}_chars AS (SELECT {key}, unnest(cs) AS c, unnest(range(len(cs))) AS pos FROM {name}_text),
{name}_wide AS (SELECT {key}, c || lead(c, 1) OVER w || lead(c, 2) OVER w AS g3, lead(c, 3) OVER w AS c3,
    lead(c, 4) OVER w AS c4, lead(c, 5) OVER w AS c5 FROM {name}_chars
    WINDOW w AS (PARTITION BY {key} ORDER BY pos)),
{name}_all AS (SELECT {key}, unnest([3, 4, 5, 6]) AS n,
    unnest([g3, g3 || c3, g3 || c3 || c4, g3 || c3 || c4 || c5]) AS gram FROM {name}_wide),
{name} AS (SELECT {key}, n, gram FROM {name}_all WHERE gram IS NOT NULL)"""


SPLIT = f"""{LABELLED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat(CAST(snippet_id AS VARCHAR), ':42')), snippet_id) AS rn,
    count(*) OVER (PARTITION BY label) AS n FROM labelled),
splitted AS (SELECT snippet_id, code, label, task_name, CASE WHEN rn <= ceil(ceil(n * 0.2) * 0.5) THEN 'test'
    WHEN rn <= ceil(n * 0.2) THEN 'validation' ELSE 'train' END AS split FROM ranked)"""


# The same split over all stored vectors, each with the document of its number.
STORED_SPLIT = SPLIT.replace(LABELLED, """labelled AS (
  SELECT e.vec_id AS snippet_id, d.text AS code, CASE WHEN e.label % 2 = 1 THEN 'Human_written' ELSE 'AI_generated' END AS label,
         CAST(NULL AS VARCHAR) AS task_name FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id)""")


def vocabulary(k: int, source: str = "train") -> str:
    """CTEs from train(snippet_id, code) to vocab(gram, cf, df, idx, idf) of the k most frequent grams."""
    return f"""{grams(source)},
tf AS (SELECT snippet_id, gram, count(*) AS tf FROM grams GROUP BY ALL),
gram_stats AS (SELECT gram, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf GROUP BY gram),
top AS (SELECT * FROM gram_stats ORDER BY cf DESC, gram LIMIT {k}),
vocab AS (SELECT gram, cf, df, row_number() OVER (ORDER BY gram) - 1 AS idx,
    ln((1 + (SELECT count(*) FROM {source})) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM top)"""


def templates() -> str:
    """CTEs ending in tree_facts(snippet_id, code, ok, block repeats, raw counts): closed-form counts
    of what each template's blocks hold."""
    return """repeats AS (SELECT p_partkey AS snippet_id, p_name, p_partkey % 4 AS fn, (p_partkey // 4) % 3 AS box,
    (p_partkey // 12) % 2 AS run, (p_partkey // 24) % 3 AS comp, (p_partkey // 72) % 2 AS safe, p_partkey % 10 <> 0 AS ok
    FROM part),
template_text AS (SELECT *, 'import os.path as osp' || chr(10) || 'from sys import path' || chr(10) || '# ' || p_name || chr(10)
    || repeat('def fn(x):' || chr(10) || '    if x:' || chr(10) || '        return len(x)' || chr(10) || '    return x' || chr(10), fn)
    || repeat('class MyBox:' || chr(10) || '    MAX_N = 1' || chr(10) || '    def grow(self):' || chr(10) || '        while self:' || chr(10)
        || '            myVar = 2' || chr(10) || '        return myVar' || chr(10), box)
    || repeat('async def run(q):' || chr(10) || '    async for i in q:' || chr(10) || '        async with i:' || chr(10)
        || '            pass' || chr(10), run)
    || repeat('data = [fn(v) for v in data]' || chr(10) || 'pick = {v: 1 for v in data}' || chr(10) || 'key = lambda z: z' || chr(10), comp)
    || repeat('try:' || chr(10) || '    with path as p:' || chr(10) || '        for n in p:' || chr(10) || '            pass' || chr(10)
        || 'except ValueError:' || chr(10) || '    pass' || chr(10) || chr(10), safe)
    || CASE WHEN ok THEN '' ELSE ')' END AS code FROM repeats),
tree_facts AS (SELECT snippet_id, code, ok,
    CASE WHEN ok THEN 2 + 4 * fn + 4 * box + 3 * run + 11 * comp + 5 * safe ELSE 0 END AS n_names,
    CASE WHEN ok THEN 7 + 6 * fn + 19 * box + 3 * run + 26 * comp + 17 * safe ELSE 0 END AS len_names,
    CASE WHEN ok THEN 3 * fn + 3 * run + 5 * comp + 3 * safe ELSE 0 END AS single,
    CASE WHEN ok THEN 2 + 4 * fn + box + 3 * run + 11 * comp + 4 * safe ELSE 0 END AS snake,
    CASE WHEN ok THEN 2 * box ELSE 0 END AS camel,
    CASE WHEN ok THEN box ELSE 0 END AS upper_n,
    CASE WHEN ok THEN fn + box + run ELSE 0 END AS n_FunctionDef,
    CASE WHEN ok THEN box ELSE 0 END AS n_ClassDef,
    CASE WHEN ok THEN fn ELSE 0 END AS n_If,
    CASE WHEN ok THEN run + safe ELSE 0 END AS n_For,
    CASE WHEN ok THEN box ELSE 0 END AS n_While,
    CASE WHEN ok THEN safe ELSE 0 END AS n_Try,
    CASE WHEN ok THEN run + safe ELSE 0 END AS n_With,
    CASE WHEN ok THEN fn + comp ELSE 0 END AS n_Call,
    CASE WHEN ok THEN comp ELSE 0 END AS n_ListComp,
    CASE WHEN ok THEN comp ELSE 0 END AS n_DictComp,
    CASE WHEN ok THEN comp ELSE 0 END AS n_Lambda,
    CASE WHEN ok AND fn + box + run > 0 THEN 4 ELSE 0 END AS avg_func_len,
    CASE WHEN NOT ok THEN 0 WHEN fn + box + run > 0 THEN 6 WHEN comp + safe > 0 THEN 5 ELSE 2 END AS max_ast_depth,
    CASE WHEN ok THEN 1 ELSE 0 END AS n_imports,
    CASE WHEN ok THEN 1 ELSE 0 END AS n_from_imports,
    CASE WHEN ok THEN 2 ELSE 0 END AS n_unique_imports
    FROM template_text)"""


def tree_columns() -> list[tuple[str, str]]:
    """(feature, expression over tree_facts f) of the syntax features, in feature order."""
    share = "coalesce({} / nullif(f.n_names, 0), 0)"
    named = [("avg_ident_len", "len_names"), ("single_letter_ratio", "single"), ("snake_ratio", "snake"),
             ("camel_ratio", "camel"), ("upper_ratio", "upper_n")]
    plain = ["n_FunctionDef", "n_ClassDef", "n_If", "n_For", "n_While", "n_Try", "n_With", "n_Call", "n_ListComp",
             "n_DictComp", "n_Lambda", "avg_func_len", "max_ast_depth", "n_imports", "n_from_imports",
             "n_unique_imports"]
    return [(n, share.format("f." + c)) for n, c in named] + [(n, f"f.{n}") for n in plain]


LINE_COLUMNS = ["n_lines", "avg_line_len", "stdev_line_len", "max_line_len", "blank_ratio", "trailing_ws_ratio",
                "avg_indent", "max_indent", "tab_leading_ratio"]


def all_features() -> str:
    """CTEs ending in feats(snippet_id, 44 features) over the templates."""
    tree = tree_columns()
    counted = [n for n, _ in tree if n.startswith("n_")]
    cells = [f"CAST(s.{c} AS DOUBLE) AS {c}" for c in LINE_COLUMNS]
    cells += [f"CAST({e} AS DOUBLE) AS {n}" for n, e in tree]
    cells += [f"CAST(f.{n} / (s.n_lines / 1000) AS DOUBLE) AS {n}_per_kloc" for n in counted]
    return f"""{templates()},
{line_stats("template_text")},
feats AS (SELECT f.snippet_id, {", ".join(cells)} FROM tree_facts f JOIN line_stats s ON f.snippet_id = s.snippet_id)"""
