"""Queries of the index, search, symbol, import, read, report, usage and change operators, each over whole tables.

Documents serve as text files, `files` as source files; where an operator needs sources with a known answer, one source per row of
part or supplier is put together, and the SQL answers from the keys without parsing.
"""

from __future__ import annotations

import os
import uuid
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.functions import policy, text
from srcatlas.operators import changes, edit, graph, imports, index, reads, reports, search, symbols, usage
from srcatlas.sources import state
from srcatlas.sources import tree as tree_source
from srcatlas.sources.config import Config
from srcatlas.plans.runtime import cut, ensure_checkpoint_dir, read, spread

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# adapters ---------------------------------------------------------------------------------------------------------------------


def doc_files(spark: SparkSession, sf: str) -> DataFrame:
    return index.files_from_text(read(spark, sf, "documents"), "doc_id", "text")


def dealt_docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(doc_files(spark, sf))


def source_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files alive at the end, decodable or not."""
    return read(spark, sf, "files").where(F.col("deleted_at").isNull())


def made_files(keys: DataFrame, key: str, path: Column, body: Column) -> DataFrame:
    return index.files_table(keys.select(F.col(key).cast("bigint").alias("file_id"), path.alias("path"), body.alias("text")))


_DOCS = "docs AS (SELECT doc_id AS file_id, 'doc/' || lpad(CAST(doc_id AS VARCHAR), 10, '0') || '.txt' AS path, text FROM documents WHERE text IS NOT NULL)"
_SRC = "src AS (SELECT * FROM files WHERE deleted_at IS NULL)"


def _lines(table: str, name: str = "lines") -> str:
    return f"""{name}_p AS (SELECT *, string_split(text, chr(10)) AS p FROM {table}),
{name} AS (SELECT * EXCLUDE (p, text, i), CAST(i AS BIGINT) AS line, CASE WHEN i < len(p) THEN regexp_replace(p[i], '\\r$', '') ELSE p[i] END AS text
  FROM {name}_p, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i) WHERE NOT (i = len(p) AND p[i] = ''))"""


_TRIM = r"regexp_replace({0}, '^[\s\v\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\v\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"
_WORDS = "words_t AS (SELECT DISTINCT lower(w) AS term, file_id FROM (SELECT file_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) AS w FROM {0}) WHERE length(w) > 1)"
_TRIGRAMS = "trigrams_t AS (SELECT DISTINCT substring(t, i, 3) AS term, file_id FROM (SELECT file_id, t, unnest(range(1, length(t) - 1)) AS i FROM (SELECT file_id, lower(text) AS t FROM {0})) WHERE regexp_full_match(substring(t, i, 3), '[\\x20-\\x7e]{{3}}'))"


# index build ------------------------------------------------------------------------------------------------------------------


@query(f"WITH {_DOCS}, {_lines('docs')}, n AS (SELECT file_id, count(*) AS c FROM lines GROUP BY ALL) SELECT path, coalesce(c, 0) AS lines, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS hash FROM docs LEFT JOIN n USING (file_id)")
def tree(spark: SparkSession, sf: str) -> DataFrame:
    return index.tree(index.files_table(doc_files(spark, sf)))


@query("SELECT path, lines, bytes, hash FROM files WHERE deleted_at IS NULL ORDER BY path, file_id LIMIT 200")
def tree_limit(spark: SparkSession, sf: str) -> DataFrame:
    return source_files(spark, sf).orderBy("path", "file_id").limit(200).select("path", "lines", "bytes", "hash")


@query("SELECT file_id, CASE WHEN is_utf8 THEN lines ELSE len(string_split(text, chr(10))) - CASE WHEN text = '' OR suffix(text, chr(10)) THEN 1 ELSE 0 END END AS lines, CASE WHEN is_utf8 THEN bytes ELSE strlen(text) END AS bytes, CASE WHEN is_utf8 THEN line_offsets ELSE (SELECT list(o ORDER BY o) FROM (SELECT unnest([0] || list_filter(list_transform(list_filter(range(1, length(text) + 1), lambda i: text[i] = chr(10)), lambda i: strlen(text[1:i])), lambda o: o < strlen(text))) AS o)) END AS line_offsets, CASE WHEN is_utf8 THEN hash ELSE sha256(text) END AS hash FROM files")
def file_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes, line counts, offsets and hashes from the text; for decodable files the table's own columns are the answer."""
    rows = read(spark, sf, "files")
    return index.files_table(rows.select("file_id", "path", "text")).select("file_id", "lines", "bytes", "line_offsets", "hash")


@query(f"WITH {_DOCS}, {_lines('docs')} SELECT file_id, line, text FROM lines")
def lines(spark: SparkSession, sf: str) -> DataFrame:
    return index.lines_table(doc_files(spark, sf)).select("file_id", "line", "text")


@query(f"WITH {_DOCS}, {_WORDS.format('docs')} SELECT term, file_id FROM words_t")
def word_postings(spark: SparkSession, sf: str) -> DataFrame:
    return index.word_postings(doc_files(spark, sf))


@query(f"WITH {_SRC}, {_WORDS.format('src')} SELECT term, count(*) AS n_files FROM words_t GROUP BY ALL")
def word_doc_freq(spark: SparkSession, sf: str) -> DataFrame:
    return index.document_frequency(index.word_postings(source_files(spark, sf)))


@query(f"WITH {_DOCS}, {_TRIGRAMS.format('docs')} SELECT term, count(*) AS n_files FROM trigrams_t GROUP BY ALL")
def trigram_postings(spark: SparkSession, sf: str) -> DataFrame:
    return index.document_frequency(index.trigram_postings(doc_files(spark, sf)))


@query(f"WITH {_SRC}, {_WORDS.format('src')} SELECT term, file_id // 65536 AS block, list_sort(list(file_id)) AS file_ids FROM words_t GROUP BY ALL")
def inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    return index.inverted(index.word_postings(source_files(spark, sf)))


@query(f"WITH {_DOCS}, {_WORDS.format('docs')}, {_TRIGRAMS.format('docs')} SELECT (SELECT count(*) FROM docs) AS files, (SELECT count(DISTINCT term) FROM words_t) AS words, (SELECT count(DISTINCT term) FROM trigrams_t) AS trigrams")
def status(spark: SparkSession, sf: str) -> DataFrame:
    f = doc_files(spark, sf)
    return index.status({"files": f, "words": index.word_postings(f), "trigrams": index.trigram_postings(f)}).select("files", "words", "trigrams")


@query(f"WITH {_DOCS}, {_WORDS.format('docs')}, {_TRIGRAMS.format('docs')} SELECT (SELECT count(*) FROM docs) AS files, (SELECT count(DISTINCT term) FROM words_t) AS words, (SELECT count(DISTINCT term) FROM trigrams_t) AS trigrams")
def saved_index(spark: SparkSession, sf: str) -> DataFrame:
    """The same counts from an index that was saved, found valid by its manifest, and loaded."""
    f = doc_files(spark, sf)
    folder = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    index.save({"files": index.files_table(f), "words": index.word_postings(f), "trigrams": index.trigram_postings(f)}, folder, {"source": "documents"})
    return index.status(index.load(spark, folder, {"source": "documents"})).select("files", "words", "trigrams")


@query()
def status_sources(spark: SparkSession, sf: str) -> DataFrame:
    return index.status(index.build(source_files(spark, sf).select("file_id", "path", "ext", "bytes", "lines", "line_offsets", "hash", "mtime_ms", "is_utf8", "text")))


# content queries --------------------------------------------------------------------------------------------------------------


def _search_sql(q: str, limit: int | None, table: str = "docs", head: str = _DOCS, extra: str = "") -> str:
    tail = f"ORDER BY file_id, line LIMIT {limit}" if limit is not None else ""
    return f"WITH {head}, {_lines(table)} SELECT file_id, path, line, {_TRIM.format('text')} AS text FROM lines WHERE contains(lower(text), '{q}') {extra} {tail}"


@query(_search_sql("snapshot", None))
def search_literal(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(dealt_docs(spark, sf), "Snapshot", None)


@query(_search_sql("the index", 20))
def search_limit(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(dealt_docs(spark, sf), "the INDEX", 20)


@query(_search_sql("prüft", None))
def search_unicode_case(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(dealt_docs(spark, sf), "PRÜFT", None)


@query(_search_sql("no such passage anywhere", None))
def search_nothing(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(dealt_docs(spark, sf), "no such passage anywhere", None)


@query(_search_sql("", 50))
def search_every_line(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(dealt_docs(spark, sf), "", 50)


@query(_search_sql("return null;", None, "src", _SRC, "AND is_utf8"))
def search_sources(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(source_files(spark, sf), "return NULL;", None)


@query(_search_sql("second look", None))
def search_via_index(spark: SparkSession, sf: str) -> DataFrame:
    f = doc_files(spark, sf)
    return search.search(f, "second look", None, index.trigram_postings(f))


@query(f"SELECT path || ':' || line || ': ' || text AS value FROM ({_search_sql('second look', None)})")
def search_formatted(spark: SparkSession, sf: str) -> DataFrame:
    return search.format_hits(search.search(dealt_docs(spark, sf), "second look", None))


@query(f"WITH {_DOCS}, {_TRIGRAMS.format('docs')} SELECT file_id FROM trigrams_t WHERE term IN ('sna', 'nap', 'aps', 'psh', 'sho', 'hot') GROUP BY file_id HAVING count(*) = 6")
def trigram_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return search.candidate_files("Snapshot", index.trigram_postings(doc_files(spark, sf)))


@query(f"WITH {_DOCS}, {_WORDS.format('docs')} SELECT file_id, path FROM docs SEMI JOIN (SELECT file_id FROM words_t WHERE term = 'folder') USING (file_id) ORDER BY file_id LIMIT 20")
def word_lookup(spark: SparkSession, sf: str) -> DataFrame:
    f = doc_files(spark, sf)
    return search.word(f, index.word_postings(f), "Folder")


# eligibility -------------------------------------------------------------------------------------------------------------------

_FORMS = ("'src/f' || k || '.py'", "'.hidden/f' || k", "'node_modules/f' || k || '.js'", "'a/Build/f' || k", "'conf/.env.' || k", "'keys/k' || k || '.PEM'", "'a/credentials' || k || '.txt'", "'a/../f' || k", "'C:/f' || k", "'pkg/__pycache__/f' || k", "'a/b/c' || k || '.rs'")
_FORM_CASE = "CASE k % 11 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(_FORMS)) + " END"
_EXPECTED = "CASE WHEN k % 11 IN (0, 7, 8, 10) THEN NOT (k % 7 = 3) ELSE FALSE END"


def _policy_paths(spark: SparkSession, sf: str) -> DataFrame:
    keys = read(spark, sf, "part").select(F.col("p_partkey").cast("bigint").alias("k"))
    forms = [e.split(" || ") for e in _FORMS]
    path = F.lit(None).cast("string")
    for i, parts in enumerate(forms):
        path = F.when(F.col("k") % 11 == i, F.concat(*[F.col("k").cast("string") if p == "k" else F.lit(p.strip("'")) for p in parts])).otherwise(path)
    return keys.select("k", path.alias("path"), F.when(F.col("k") % 7 == 3, F.lit(2 << 20)).otherwise(F.lit(100)).cast("bigint").alias("bytes"))


@query(f"SELECT k, {_FORM_CASE} AS path, {_EXPECTED} AS eligible, k % 11 IN (4, 5, 6) AS sensitive, k % 11 IN (7, 8) AS unsafe FROM (SELECT p_partkey AS k FROM part)")
def eligibility(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return _policy_paths(spark, sf).select("k", "path", policy.eligible(p, F.col("bytes")).alias("eligible"), policy.is_sensitive(p).alias("sensitive"), policy.is_unsafe(p).alias("unsafe"))


@query("""SELECT file_id, NOT regexp_matches(lower(path), '(^|/)(\\.git|\\.srcatlas|node_modules|target|dist|build|\\.next|\\.cache|\\.venv|__pycache__)(/|$)') AND NOT regexp_matches(path, '(^|/)\\.[^/]')
 AND NOT regexp_matches(lower(path), '(^|/)(\\.env|\\.env\\.[^/]*|[^/]*\\.pem|[^/]*\\.key|id_rsa|id_ed25519|credentials[^/]*|secrets[^/]*)(/|$)') AND bytes <= 1048576 AS eligible FROM files""")
def eligible_files(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "files").select("file_id", policy.eligible(F.col("path"), F.col("bytes")).alias("eligible"))


@query("SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_partkey * 1024 WHEN 1 THEN p_partkey * 1048576 WHEN 2 THEN p_partkey END AS bytes FROM part")
def size_literals(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey").cast("bigint")
    unit = F.when(k % 4 == 0, "kb").when(k % 4 == 1, " MB").when(k % 4 == 2, "b").otherwise("gb")
    return read(spark, sf, "part").select(k.alias("k"), policy.size_literal(F.concat(k.cast("string"), unit)).alias("bytes"))


@query("SELECT file_id, contains(text, chr(0)) AND strlen(split_part(text, chr(0), 1)) < 8192 AS is_binary FROM files")
def binary_sniff(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "files").select("file_id", policy.looks_binary(F.encode("text", "UTF-8")).alias("is_binary"))


# imports and graph ------------------------------------------------------------------------------------------------------------


def _line_import_sql(ext: str, begin: str, clean: str, kind: str) -> str:
    return f"WITH {_SRC}, {_lines('src')}, t AS (SELECT file_id, line, {_TRIM.format('text')} AS t FROM lines WHERE ext = '{ext}') SELECT file_id, {clean} AS module, line, '{kind}' AS kind FROM t WHERE regexp_matches(t, '{begin}')"


def _imports(spark: SparkSession, sf: str, *exts: str) -> DataFrame:
    rows = source_files(spark, sf).where(F.col("ext").isin(*exts))
    return imports.extract_imports(rows).select("file_id", "module", "line", "kind")


@query(_line_import_sql("java", "^import ", "regexp_replace(regexp_replace(t, '^import ', ''), ';$', '')", "java_import"))
def imports_java(spark: SparkSession, sf: str) -> DataFrame:
    return _imports(spark, sf, "java")


@query(_line_import_sql("c", "^#include", "regexp_replace(trim(regexp_replace(t, '^#include', '')), '^[<\"]|[>\"]$', '', 'g')", "c_include"))
def imports_c(spark: SparkSession, sf: str) -> DataFrame:
    return _imports(spark, sf, "c")


@query(_line_import_sql("rb", "^require(_relative)? ", "regexp_replace(regexp_replace(t, '^require(_relative)? ', ''), '^[\"'']|[\"'']$', '', 'g')", "ruby_require"))
def imports_ruby(spark: SparkSession, sf: str) -> DataFrame:
    return _imports(spark, sf, "rb")


@query(_line_import_sql("py", "^(import|from) ", "regexp_replace(regexp_replace(t, '^(import|from) ', ''), '\\s*[;#].*$', '')", "x").replace("'x' AS kind", "CASE WHEN t[1] = 'i' THEN 'python_import' ELSE 'python_from_import' END AS kind") )
def imports_python(spark: SparkSession, sf: str) -> DataFrame:
    return _imports(spark, sf, "py")


@query(_line_import_sql("rs", "^use [^;]*;$", "regexp_replace(regexp_replace(t, '^use ', ''), ';$', '')", "rust_use") + " UNION ALL SELECT file_id, regexp_extract(t, '^(?:pub )?mod (\\w+)', 1), line, 'rust_mod' FROM t WHERE regexp_matches(t, '^(pub )?mod \\w+ ?[;{]')")
def imports_rust(spark: SparkSession, sf: str) -> DataFrame:
    return _imports(spark, sf, "rs")


#: Made sources, one per part: (extension, text, rows of (module, line, kind)), {k} the part's key.
IMPORTING = {
    "php": ("php", "<?php\nuse App\\A{k};\nuse Lib\\{B, C{k}};\nrequire_once 'lib/x{k}.php';\ninclude('y.php');\n// use Not\\This;\n", [("App\\A{k}", 2, "php_use"), ("Lib\\{B, C{k}}", 3, "php_use"), ("lib/x{k}.php", 4, "php_require"), ("y.php", 5, "php_require")]),
    "csharp": ("cs", "using System;\n  using N{k}.Inner;\nnamespace X {\n}\n", [("System", 1, "c_sharp_using"), ("N{k}.Inner", 2, "c_sharp_using")]),
    "cpp": ("hpp", "#include <v{k}>\n#  include no\n#include \"a/b{k}.h\"\n", [("v{k}", 1, "c_include"), ("a/b{k}.h", 3, "c_include")]),
    "rust_mod": ("rs", "mod a{k};\npub mod b {\n}\npub(crate) mod c{k};\n// mod no;\npub use x::{y,\n  z{k}};\n", [("a{k}", 1, "rust_mod"), ("b", 2, "rust_mod"), ("c{k}", 4, "rust_mod"), ("pub use x::{y,\n  z{k}}", 6, "rust_use")]),
    "js_literals": ("ts", "import x from './a\\x41{k}';\nimport('./\\u0062{k}');\nconst c = require(`./\\u{63}{k}`);\nimport './o\\'{k}';\nimport bad from './\\07{k}';\nimport t from `./${no}`;\n// import n from './n';\nconst s = \"import q from './q'\";\n", [("./aA{k}", 1, "es_import"), ("./b{k}", 2, "es_import"), ("./c{k}", 3, "common_js_require"), ("./o'{k}", 4, "es_import")]),
}


def _pieces(template: str) -> list[str]:
    return template.split("{k}")


def _imports_query(name: str):
    ext, template, found = IMPORTING[name]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        k = F.col("p_partkey").cast("string")
        body = F.concat(*[x for i, p in enumerate(_pieces(template)) for x in ([k] if i else []) + [F.lit(p)]])
        return imports.extract_imports(made_files(read(spark, sf, "part"), "p_partkey", F.concat(F.lit("gen/p"), k, F.lit("." + ext)), body)).select("file_id", "module", "line", "kind")

    quoted = lambda text: " || p_partkey || ".join("'" + p.replace("'", "''") + "'" for p in _pieces(text))
    run.__name__ = f"imports_{name}"
    return query(" UNION ALL ".join(f"SELECT p_partkey AS file_id, {quoted(module)} AS module, CAST({line} AS BIGINT) AS line, '{kind}' AS kind FROM part" for module, line, kind in found))(run)


for _name in IMPORTING:
    _imports_query(_name)


@query(
    f"WITH {_SRC}, {_lines('src')}, t AS (SELECT file_id, line, text FROM lines WHERE ext IN ('js', 'ts')) "
    "SELECT file_id, regexp_extract(text, 'from [''\"]([^''\"]+)[''\"];?$', 1) AS module, line, 'es_import' AS kind FROM t WHERE regexp_matches(text, '^(import|export) .*from [''\"][^''\"]+[''\"];?$') "
    "UNION ALL SELECT file_id, regexp_extract(text, 'require\\(''([^'']+)''\\)', 1), line, 'common_js_require' FROM t WHERE regexp_matches(text, '^const \\w+ = require\\(''[^'']+''\\)')"
)
def imports_js(spark: SparkSession, sf: str) -> DataFrame:
    return _imports(spark, sf, "js", "ts")


@query(
    f"WITH {_SRC}, {_lines('src')}, o AS (SELECT file_id, min(line) AS a FROM lines WHERE ext = 'go' AND text = 'import (' GROUP BY file_id), c AS (SELECT file_id, a, min(line) AS b FROM lines JOIN o USING (file_id) WHERE text = ')' AND line > a GROUP BY ALL) "
    "SELECT file_id, regexp_extract(text, '\"([^\"]+)\"', 1) AS module, line, 'go_import' AS kind FROM lines JOIN c USING (file_id) WHERE line > a AND line < b AND contains(text, '\"')"
)
def imports_go(spark: SparkSession, sf: str) -> DataFrame:
    return _imports(spark, sf, "go")


def _modules(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    target = F.concat(F.lit("./m"), (F.col("s_suppkey") % 10).cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ".js").otherwise(""))
    body = F.concat(F.lit("const x = require('"), target, F.lit("');\nimport y from \"../lib/none\";\nimport z from 'bare';\n"))
    return made_files(read(spark, sf, "supplier"), "s_suppkey", F.concat(F.lit("src/m"), k, F.lit(".js")), body)


_RESOLVED = "r AS (SELECT s.s_suppkey AS file_id, t.s_suppkey AS target FROM supplier s LEFT JOIN supplier t ON t.s_suppkey = s.s_suppkey % 10)"


@query(f"""WITH {_RESOLVED} SELECT CAST(file_id AS BIGINT) AS file_id, './m' || (file_id % 10) || CASE WHEN file_id % 2 = 0 THEN '.js' ELSE '' END AS module, CAST(1 AS BIGINT) AS line, 'common_js_require' AS kind,
  CASE WHEN target IS NOT NULL THEN 'src/m' || target || '.js' END AS resolved_path, CAST(target AS BIGINT) AS resolved_file_id FROM r
UNION ALL SELECT file_id, '../lib/none', 2, 'es_import', NULL, NULL FROM r UNION ALL SELECT file_id, 'bare', 3, 'es_import', NULL, NULL FROM r""")
def resolve_js(spark: SparkSession, sf: str) -> DataFrame:
    f = _modules(spark, sf)
    return graph.resolve_imports(imports.extract_imports(f), f).select("file_id", "module", "line", "kind", "resolved_path", "resolved_file_id")


@query(f"WITH {_RESOLVED} SELECT DISTINCT file_id AS src_id, target AS dst_id FROM r WHERE target IS NOT NULL")
def deps_edges(spark: SparkSession, sf: str) -> DataFrame:
    f = _modules(spark, sf)
    return graph.edges(graph.resolve_imports(imports.extract_imports(f), f))


@query(f"WITH {_RESOLVED} SELECT target AS file_id, file_id // 65536 AS block, list_sort(list(file_id)) AS neighbours FROM r WHERE target IS NOT NULL GROUP BY ALL")
def deps_reverse(spark: SparkSession, sf: str) -> DataFrame:
    f = _modules(spark, sf)
    return graph.adjacency(graph.edges(graph.resolve_imports(imports.extract_imports(f), f)), reverse=True)


@query("SELECT s_suppkey AS file_id, 'src/m' || s_suppkey || '.js' AS path FROM supplier WHERE s_suppkey % 10 = 3")
def rdeps(spark: SparkSession, sf: str) -> DataFrame:
    f = _modules(spark, sf)
    return graph.rdeps(graph.edges(graph.resolve_imports(imports.extract_imports(f), f)), f, "src/m3.js")


@query("SELECT CAST(0 AS BIGINT) AS ord, './m7' AS module, CAST(1 AS BIGINT) AS line UNION ALL SELECT 1, '../lib/none', 2 UNION ALL SELECT 2, 'bare', 3")
def deps(spark: SparkSession, sf: str) -> DataFrame:
    return graph.deps(imports.extract_imports(_modules(spark, sf)), "src/m7.js").select("ord", "module", "line")


@query("""WITH f AS (SELECT file_id, repo, path, first_seen_at, coalesce(deleted_at, TIMESTAMP '9999-01-01') AS gone FROM files),
i AS (SELECT DISTINCT import_id, repo, indexed_at, resolved_path FROM imports WHERE resolved_path IS NOT NULL)
SELECT i.repo, count(DISTINCT import_id) AS n_resolved FROM i JOIN f ON f.repo = i.repo AND f.path = i.resolved_path AND f.first_seen_at <= i.indexed_at AND f.gone > i.indexed_at GROUP BY i.repo""")
def live_import_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Per repo, the imports whose resolved path was a live file when they were indexed."""
    f = read(spark, sf, "files").select("repo", F.col("path").alias("resolved_path"), "first_seen_at", "deleted_at")
    i = read(spark, sf, "imports").where(F.col("resolved_path").isNotNull()).select("import_id", "repo", "indexed_at", "resolved_path").distinct()
    alive = (F.col("first_seen_at") <= F.col("indexed_at")) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > F.col("indexed_at")))
    return i.join(f, ["repo", "resolved_path"]).where(alive).groupBy("repo").agg(F.countDistinct("import_id").alias("n_resolved"))


# symbols ----------------------------------------------------------------------------------------------------------------------

#: One source per part, by language: (extension, text with {k}, expected (name, kind, line, column, end line, signature end)).
SOURCES = {
    "rust": ("rs", "pub struct S{k} {{\n    a: u8,\n}}\nimpl Show for S{k} {{\n    fn show(&self) -> u8 {{\n        1\n    }}\n}}\nfn free{k}() {{}}\n",
             [("S{k}", "struct", 1, 1, 3, 1), ("Show for S{k}", "impl", 4, 1, 8, 4), ("show", "method", 5, 5, 7, 5), ("free{k}", "function", 9, 1, 9, 9)]),
    "javascript": ("js", "export class C{k} {{\n  run(a) {{\n    return a;\n  }}\n}}\nfunction f{k}(x) {{\n  const inner = x;\n}}\nconst g{k} = (a) => a;\n",
                   [("C{k}", "class", 1, 8, 5, 1), ("run", "method", 2, 3, 4, 2), ("f{k}", "function", 6, 1, 8, 6), ("inner", "variable", 7, 3, 7, None), ("g{k}", "function", 9, 1, 9, None)]),
    "typescript": ("ts", "interface I{k} {{\n  go(): void;\n}}\ntype T{k} = string;\nclass K{k} {{}}\n",
                   [("I{k}", "interface", 1, 1, 3, 1), ("go", "method", 2, 3, 2, None), ("T{k}", "type", 4, 1, 4, None), ("K{k}", "class", 5, 1, 5, 5)]),
    "python": ("py", "class A{k}:\n    def m(self):\n        x = 1\n        return x\n\ndef f{k}(a,\n       b):\n    y = a\n    return y\nZ{k} = 3\n",
               [("A{k}", "class", 1, 1, 4, 1), ("m", "method", 2, 5, 4, 2), ("f{k}", "function", 6, 1, 9, 7), ("y", "variable", 8, 5, 8, None), ("Z{k}", "variable", 10, 1, 10, None)]),
    "go": ("go", "package p\n\nfunc F{k}() int {{\n\treturn 1\n}}\n\nfunc (s *S) M{k}() {{\n}}\n\ntype S{k} struct {{\n\tA int\n}}\n",
           [("F{k}", "function", 3, 1, 5, 3), ("M{k}", "method", 7, 1, 8, 7), ("S{k}", "type", 10, 6, 12, None)]),
    "php": ("php", "<?php\nclass P{k} {{\n    public function m{k}() {{\n        return 1;\n    }}\n}}\nfunction f{k}() {{\n}}\n",
            [("P{k}", "class", 2, 1, 6, 2), ("m{k}", "method", 3, 5, 5, 3), ("f{k}", "function", 7, 1, 8, 7)]),
    "java": ("java", "public class J{k} {{\n    J{k}() {{\n    }}\n\n    int m{k}(int a) {{\n        return a;\n    }}\n}}\n",
             [("J{k}", "class", 1, 1, 8, 1), ("J{k}", "method", 2, 5, 3, 2), ("m{k}", "method", 5, 5, 7, 5)]),
    "csharp": ("cs", "public struct V{k} {{\n    public int Go{k}(int a) {{\n        return a;\n    }}\n}}\n", [("V{k}", "struct", 1, 1, 5, 1), ("Go{k}", "method", 2, 5, 4, 2)]),
    "c": ("c", "struct s{k} {{\n    int a;\n}};\n\nint f{k}(int a)\n{{\n    return a;\n}}\n", [("s{k}", "struct", 1, 1, 3, 1), ("f{k}", "function", 5, 1, 8, 6)]),
    "cpp": ("cpp", "class K{k} {{\n}};\nusing T{k} = int;\n", [("K{k}", "class", 1, 1, 2, 1), ("T{k}", "type", 3, 1, 3, None)]),
    "ruby": ("rb", "module M{k}\n  class C{k}\n    def m{k}(a)\n      b = a\n    end\n  end\nend\n",
             [("M{k}", "module", 1, 1, 7, 1), ("C{k}", "class", 2, 3, 6, 2), ("m{k}", "function", 3, 5, 5, 3), ("b", "variable", 4, 7, 4, None)]),
    "json": ("json", '{{\n  "b{k}": 1,\n  "a": {{"x{k}": [1]}}\n}}\n', [("a", "key", 3, 3, 3, None), ("a.x{k}", "key", 3, 9, 3, None), ("b{k}", "key", 2, 3, 2, None)]),
    "toml": ("toml", "top{k} = 1\n[t]\nx.y{k} = 2\n", [("top{k}", "key", 1, 1, 1, None), ("t", "key", 2, 2, 2, None), ("t.x", "key", 3, 1, 3, None), ("t.x.y{k}", "key", 3, 1, 3, None)]),
    "yaml": ("yml", "# note: no\nname{k}: x\nlist:\n  - item: no\n  sub{k}: http://a:1\n", [("name{k}", "key", 2, 1, 2, None), ("list", "key", 3, 1, 3, None), ("sub{k}", "key", 5, 3, 5, None)]),
}


def made_sources(spark: SparkSession, sf: str, language: str) -> DataFrame:
    ext, template, _ = SOURCES[language]
    k = F.col("p_partkey").cast("string")
    pieces = template.replace("{{", "\x01").replace("}}", "\x02").split("{k}")
    body = F.concat(*[x for i, p in enumerate(pieces) for x in ([k] if i else []) + [F.lit(p.replace("\x01", "{").replace("\x02", "}"))]])
    return made_files(read(spark, sf, "part"), "p_partkey", F.concat(F.lit("gen/p"), k, F.lit("." + ext)), body)


def _symbols_sql(language: str) -> str:
    def number(x: int | None) -> str:
        return "CAST(NULL AS BIGINT)" if x is None else f"CAST({x} AS BIGINT)"

    return " UNION ALL ".join(
        "SELECT p_partkey AS file_id, " + " || ".join(f"'{p}'" for p in [name.split("{k}")[0]]) + (" || p_partkey || '" + name.split("{k}")[1] + "'" if "{k}" in name else "")
        + f" AS name, '{kind}' AS kind, {number(a)} AS line, {number(b)} AS \"column\", {number(c)} AS end_line, {number(d)} AS signature_end_line FROM part"
        for name, kind, a, b, c, d in SOURCES[language][2]
    )


def _symbols_query(language: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return symbols.extract_symbols(made_sources(spark, sf, language)).select("file_id", "name", "kind", "line", "column", "end_line", "signature_end_line")

    run.__name__ = f"symbols_{language}"
    return query(_symbols_sql(language))(run)


for _language in SOURCES:
    _symbols_query(_language)


@query()
def symbols_sources(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.extract_symbols(source_files(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH src AS (SELECT * FROM files WHERE deleted_at IS NULL AND ext = 'yml'), """ + _lines("src") + r""", t AS (SELECT file_id, line, text, trim(text, ' ') AS t FROM lines)
SELECT file_id, trim(split_part(t, ':', 1), ' ') AS name, line FROM t WHERE t <> '' AND NOT regexp_matches(t, '^[#-]') AND contains(t, ':') AND trim(split_part(t, ':', 1), ' ') <> ''""")
def symbols_yaml_sources(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.yaml_keys(source_files(spark, sf)).select("file_id", "name", "line")


#: Declarations that a line shows by itself: (extensions, kinds, the line's beginning with the name as the last group).
LINE_DECLARED = {
    "python": (("py",), ("function", "method", "class"), r"^[ \t]*(?:async +)?(?:def|class) +(\w+)"),
    "go": (("go",), ("function", "method"), r"^func +(?:\([^)]*\) *)?(\w+)"),
    "ruby": (("rb",), ("function", "class", "module"), r"^[ \t]*(?:def|class|module) +(?:self\.)?([A-Za-z_]\w*(?:::\w+)*[?!=]?)"),
    "rust": (("rs",), ("struct", "enum", "trait"), r"^[ \t]*(?:pub(?:\([^)]*\))? +)?(?:struct|enum|trait) +(\w+)"),
    "java": (("java",), ("class", "interface", "enum"), r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|sealed) +)*(?:class|interface|enum) +(\w+)"),
    "js": (("js", "ts"), ("class",), r"^[ \t]*(?:export +)?(?:default +)?class +([\w$]+)"),
}


def _line_declared_query(language: str):
    exts, kinds, beginning = LINE_DECLARED[language]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return symbols.extract_symbols(source_files(spark, sf).where(F.col("ext").isin(*exts))).where(F.col("kind").isin(*kinds)).select("file_id", "name", "line")

    run.__name__ = f"symbols_{language}_sources"
    some = ", ".join(f"'{e}'" for e in exts)
    return query(f"WITH src AS (SELECT * FROM files WHERE deleted_at IS NULL AND ext IN ({some})), {_lines('src')} SELECT file_id, regexp_extract(text, '{beginning}', 1) AS name, line FROM lines WHERE regexp_matches(text, '{beginning}')")(run)


for _language in LINE_DECLARED:
    _line_declared_query(_language)


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'A7', 'class'), (1, 'm', 'method'), (2, 'f7', 'function'), (3, 'y', 'variable'), (4, 'Z7', 'variable')) t(ord, name, kind)")
def outline(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.outline(symbols.extract_symbols(made_sources(spark, sf, "python")), "gen/p7.py").select("ord", "name", "kind")


@query("SELECT CAST(12 AS BIGINT) AS file_id, 'F12' AS name, 'function' AS kind")
def symbol_exact(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.find_symbol(symbols.extract_symbols(made_sources(spark, sf, "go")), "f12").select("file_id", "name", "kind")


@query("SELECT p_partkey AS file_id, 'top' || p_partkey AS name FROM part WHERE contains('top' || p_partkey, 'op1') ORDER BY p_partkey LIMIT 20")
def symbol_substring(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.find_symbol(symbols.extract_symbols(made_sources(spark, sf, "toml")), "OP1").select("file_id", "name")


# reads ------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {_DOCS}, {_lines('docs')} SELECT file_id, line AS line_no, text FROM lines WHERE line BETWEEN 3 AND 9")
def read_range(spark: SparkSession, sf: str) -> DataFrame:
    return reads.read_normal(doc_files(spark, sf), "3-9").select("file_id", "line_no", "text")


_CUT = """cut0 AS (SELECT file_id, text, list_max(list_filter(range(0, 101), lambda i: strlen(substring(text, 1, i)) <= 100)) AS k FROM files WHERE text IS NOT NULL),
src0 AS (SELECT file_id, substring(text, 1, k) || CASE WHEN k < length(text) AND strlen(substring(text, 1, k)) < 100 THEN chr(65533) ELSE '' END AS text FROM cut0)"""


@query(f"WITH {_CUT}, {_lines('src0')} SELECT file_id, line AS line_no, text FROM lines")
def read_bytes_cap(spark: SparkSession, sf: str) -> DataFrame:
    """A character cut in two becomes one replacement character."""
    return reads.read_normal(read(spark, sf, "files"), max_bytes=100).select("file_id", "line_no", "text")


def _long_functions(spark: SparkSession, sf: str) -> DataFrame:
    """One Python function of 3 + k % 40 body lines per supplier, behind an import."""
    k = F.col("s_suppkey").cast("int")
    body = F.concat(F.lit("import os\n\ndef f():\n"), F.array_join(F.transform(F.sequence(F.lit(1), 3 + k % 40), lambda i: F.concat(F.lit("    x = "), i.cast("string"))), "\n"), F.lit("\n"))
    return made_files(read(spark, sf, "supplier"), "s_suppkey", F.concat(F.lit("long/f"), F.col("s_suppkey").cast("string"), F.lit(".py")), body)


_LONG = "s AS (SELECT s_suppkey AS file_id, CAST(3 + s_suppkey % 40 AS BIGINT) AS n FROM supplier)"


@query(f"""WITH {_LONG} SELECT file_id, CAST(1 AS BIGINT) AS line_no, 'import os' AS text FROM s UNION ALL SELECT file_id, 2, '' FROM s UNION ALL SELECT file_id, 3, 'def f():' FROM s
UNION ALL SELECT file_id, CAST(3 + i AS BIGINT), '    x = ' || i FROM s, LATERAL (SELECT unnest(range(1, n + 1)) AS i) WHERE n + 1 <= 20
UNION ALL SELECT file_id, NULL, '    ... body omitted (' || n || ' lines)' FROM s WHERE n + 1 > 20""")
def read_compact(spark: SparkSession, sf: str) -> DataFrame:
    f = _long_functions(spark, sf)
    return reads.read_compact(f, symbols.extract_symbols(f)).select("file_id", "line_no", "text")


@query(f"WITH {_LONG} SELECT file_id, CAST(1 AS BIGINT) AS line_no, 'import os' AS text FROM s UNION ALL SELECT file_id, 3, 'def f():' FROM s")
def read_aggressive(spark: SparkSession, sf: str) -> DataFrame:
    f = _long_functions(spark, sf)
    return reads.read_aggressive(f, symbols.extract_symbols(f)).select("file_id", "line_no", "text")


@query(f"""WITH {_DOCS}, {_lines('docs')}, k AS (SELECT *, lag(line, 1, 0) OVER (PARTITION BY file_id ORDER BY line) AS before FROM lines
WHERE line <= 40 OR regexp_matches(ltrim(text, ' '), '^(use |mod |import |from |include |#include|require|package |module |fn |pub fn |def |class |struct |enum |interface |type |impl |trait |function |export function )'))
SELECT file_id, line AS line_no, text FROM k UNION ALL SELECT file_id, NULL, '... ' || (line - before - 1) || ' lines omitted' FROM k WHERE line - before > 1
UNION ALL SELECT DISTINCT file_id, CAST(NULL AS BIGINT), '... no parser for this language, showing structural lines' FROM lines""")
def read_compact_fallback(spark: SparkSession, sf: str) -> DataFrame:
    f = doc_files(spark, sf)
    none = symbols.extract_symbols(f.where(F.lit(False)))
    return reads.read_compact(f, none).select("file_id", "line_no", "text")


@query(f"""WITH {_LONG} SELECT file_id, CAST(2 AS BIGINT) AS line_no, '' AS text FROM s UNION ALL SELECT file_id, 3, 'def f():' FROM s
UNION ALL SELECT file_id, CAST(3 + i AS BIGINT), '    x = ' || i FROM s, LATERAL (SELECT unnest(range(1, n + 1)) AS i) WHERE n + 1 <= 20 AND i <= 2
UNION ALL SELECT file_id, NULL, '    ... body omitted (' || n || ' lines)' FROM s WHERE n + 1 > 20""")
def read_compact_range(spark: SparkSession, sf: str) -> DataFrame:
    """Lines 2 to 5; a notice stays, as no numbered line beyond the range comes before it."""
    f = _long_functions(spark, sf)
    return reads.read_compact(f, symbols.extract_symbols(f), "2-5").select("file_id", "line_no", "text")


# reports ----------------------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey AS file_id, 'Python' AS language, 'tree-sitter-python' AS parser, FALSE AS fallback, CAST(2 AS BIGINT) AS functions, CAST(1 AS BIGINT) AS classes, CAST([] AS VARCHAR[]) AS imports, CAST([] AS VARCHAR[]) AS summary FROM part""")
def smart_report(spark: SparkSession, sf: str) -> DataFrame:
    f = made_sources(spark, sf, "python")
    r = reports.smart_reports(f, symbols.extract_symbols(f), imports.extract_imports(f))
    return r.select("file_id", "language", "parser", "fallback", "symbols.functions", "symbols.classes", "imports", "summary")


@query()
def smart_sources(spark: SparkSession, sf: str) -> DataFrame:
    f = index.files_table(source_files(spark, sf).select("file_id", "path", "ext", "bytes", "lines", "line_offsets", "hash", "mtime_ms", "is_utf8", "text"))
    return reports.smart_reports(f, symbols.extract_symbols(f), imports.extract_imports(f))


def _test_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Per supplier a Python test with k % 5 assertions behind pytest; every third one lies outside and has assertions before it too."""
    k = F.col("s_suppkey").cast("int")
    asserts = F.array_join(F.transform(F.array_repeat(F.lit(1), k % 5), lambda _: F.lit("assert x == 1\n")), "")
    body = F.when(k % 3 == 0, F.concat(F.lit("assert early\nimport pytest\n"), asserts)).when(k % 3 == 1, F.concat(F.lit("x = 1\n"), asserts)).otherwise(F.concat(F.lit("@pytest.fixture\nm = fake()\n"), asserts))
    path = F.concat(F.when(k % 3 == 1, "src/plain").otherwise("pkg/tests/t"), F.col("s_suppkey").cast("string"), F.lit(".py"))
    path = F.when(k % 3 == 0, F.concat(F.lit("src/u"), F.col("s_suppkey").cast("string"), F.lit(".py"))).otherwise(path)
    return made_files(read(spark, sf, "supplier"), "s_suppkey", path, body)


_TESTS = """SELECT CASE s_suppkey % 3 WHEN 0 THEN 'src/u' ELSE 'pkg/tests/t' END || s_suppkey || '.py' AS path, 'Python' AS language, ['pytest'] AS frameworks, CAST(1 AS BIGINT) AS framework_lines,
 CAST(CASE s_suppkey % 3 WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS fixtures, CAST(CASE s_suppkey % 3 WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS mocks, CAST(s_suppkey % 5 AS BIGINT) AS assertions FROM supplier WHERE s_suppkey % 3 <> 1"""


@query(_TESTS)
def tests_aware_files(spark: SparkSession, sf: str) -> DataFrame:
    return reports.tests_aware_files(_test_sources(spark, sf)).drop("important_lines")


@query(f"SELECT count(*) AS test_files, CAST(sum(fixtures) AS BIGINT) AS fixtures, CAST(sum(mocks) AS BIGINT) AS mocks, CAST(sum(assertions) AS BIGINT) AS assertions, ['pytest'] AS frameworks, 'high' AS confidence FROM ({_TESTS})")
def tests_aware_totals(spark: SparkSession, sf: str) -> DataFrame:
    return reports.tests_aware_totals(_test_sources(spark, sf))


_RULES = [
    ("ext = 'rs'", "t = '#[test]' OR starts_with(t, '#[tokio::test') OR starts_with(t, '#[async_std::test')", "rust-test"), ("ext = 'py'", "contains(low, 'pytest')", "pytest"), ("ext = 'py'", "contains(low, 'unittest')", "unittest"),
    ("ext IN ('js', 'ts')", "regexp_matches(t, '(^|[^A-Za-z0-9_])(describe|it|test)\\(')", "js-test-runner"), ("ext IN ('js', 'ts')", "contains(low, 'jest')", "jest"), ("ext IN ('js', 'ts')", "contains(low, 'vitest') OR contains(t, 'vi.')", "vitest"),
    ("ext = 'go'", "contains(t, 'func Test') OR contains(t, 'testing.T')", "go-test"), ("ext = 'java'", "contains(t, '@Test') OR contains(low, 'org.junit')", "junit"), ("ext = 'rb'", "contains(t, 'RSpec.describe') OR starts_with(t, 'describe ')", "rspec"),
]
_FRAMEWORKS = "list_filter([" + ", ".join(f"CASE WHEN {a} AND ({b}) THEN '{c}' END" for a, b, c in _RULES) + "], lambda x: x IS NOT NULL)"
_TEST_LANGUAGE = "CASE " + " ".join(f"WHEN ext = '{e}' THEN '{n}'" for e, n in reports.TEST_LANGUAGES.items()) + " ELSE 'Unknown' END"


@query(
    rf"""WITH {_SRC}, u AS (SELECT file_id, path, ext, text FROM src WHERE is_utf8), {_lines('u')}, t0 AS (SELECT file_id, path, ext, line, {_TRIM.format('text')} AS t FROM lines), t1 AS (SELECT *, lower(t) AS low FROM t0),
f AS (SELECT *, {_FRAMEWORKS} AS fw, regexp_matches(lower(replace(path, '\\', '/')), '/(tests|test|__tests__)/') OR regexp_matches(lower(regexp_extract(path, '([^/]*)$', 1)), '^test_|(_test\.rs|_test\.go|_test\.py|\.test\.js|\.test\.ts|\.test\.tsx|\.spec\.js|\.spec\.ts|\.spec\.tsx|test\.java|tests\.cs)$') AS in_path,
  starts_with(t, 'assert ') OR contains(t, ' assert ') OR contains(t, 'assert!(') OR contains(t, 'assert_eq!(') OR contains(t, 'assert_ne!(') OR contains(t, 'expect(') OR contains(t, 'assertThat(') OR contains(low, 'assert_') OR contains(low, 'require.') AS a FROM t1),
g AS (SELECT *, min(CASE WHEN len(fw) > 0 THEN line END) OVER (PARTITION BY file_id) AS first FROM f)
SELECT path, {_TEST_LANGUAGE} AS language, coalesce(list_sort(list_distinct(flatten(list(fw)))), []) AS frameworks, CAST(count_if(a AND (in_path OR coalesce(line >= first, FALSE))) AS BIGINT) AS assertions FROM g GROUP BY file_id, path, ext, in_path HAVING in_path OR max(len(fw)) > 0"""
)
def tests_aware_sources(spark: SparkSession, sf: str) -> DataFrame:
    return reports.tests_aware_files(source_files(spark, sf)).select("path", "language", "frameworks", "assertions")


# usage ------------------------------------------------------------------------------------------------------------------------


def usage_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("event_type")
    e = read(spark, sf, "events").select(
        F.when(t == "view", "").when(t == "click", "rpc").otherwise("cli").alias("mode"), F.when(t == "error", None).when(t.isin("view", "click"), "normal").otherwise("compact").alias("level"),
        F.when(t.isin("view", "error"), None).otherwise("tree-sitter-rust").alias("parser"), (t == "error").alias("fallback"), F.when(t == "view", None).when(t == "click", "line_range").otherwise("compact").alias("savings_source"),
        F.floor(F.abs("value") * 100).cast("bigint").alias("bytes_raw"), F.floor(F.abs("value") * 25).cast("bigint").alias("bytes_out"),
    )
    return usage.with_estimates(e)


_USAGE = """e AS (SELECT CASE event_type WHEN 'view' THEN 'unknown' WHEN 'click' THEN 'rpc' ELSE 'cli' END AS mode, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN 'normal_read' WHEN event_type = 'click' THEN 'normal_line_range' ELSE 'compact' END AS level,
 CASE WHEN event_type = 'error' THEN 'fallback' WHEN event_type = 'view' THEN 'not_applicable' ELSE 'tree-sitter-rust' END AS parser, CASE event_type WHEN 'view' THEN 'unknown' WHEN 'click' THEN 'line_range' ELSE 'compact' END AS savings_source,
 CAST(floor(abs(value) * 100) AS BIGINT) AS bytes_raw, CAST(floor(abs(value) * 25) AS BIGINT) AS bytes_out FROM events), u AS (SELECT *, bytes_raw // 4 AS tokens_raw_est, bytes_out // 4 AS tokens_out_est, greatest(0, bytes_raw // 4 - bytes_out // 4) AS tokens_saved_est FROM e)"""


def _gain_sql(dimension: str, bucket: str) -> str:
    sums = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in usage.COUNTERS)
    where = f"WHERE {bucket} IS NOT NULL" if dimension != "total" else ""
    return f"SELECT '{dimension}' AS dimension, {bucket} AS bucket, count(*) AS events, {sums}, CASE WHEN coalesce(sum(tokens_raw_est), 0) = 0 THEN 0.0 ELSE CAST(sum(tokens_saved_est) AS DOUBLE) / CAST(sum(tokens_raw_est) AS DOUBLE) END AS ratio FROM u {where} GROUP BY ALL"


_GAIN = " UNION ALL ".join(_gain_sql(d, "'total'" if d == "total" else d) for d in ("total", "mode", "level", "parser", "savings_source"))


@query(f"WITH {_USAGE} {_GAIN}")
def gain_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return usage.gain(usage_rows(spark, sf))


def _gain_query(dimension: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return usage.gain(usage_rows(spark, sf)).where(F.col("dimension") == dimension)

    run.__name__ = f"gain_{'total' if dimension == 'total' else 'by_' + dimension}"
    return query(f"WITH {_USAGE} {_gain_sql(dimension, repr('total') if dimension == 'total' else dimension)}")(run)


for _dimension in ("total", "mode", "level", "parser", "savings_source"):
    _gain_query(_dimension)


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'compact' WHEN event_id % 4 = 1 THEN 'aggressive' WHEN event_id % 3 = 0 AND event_id % 5 = 0 THEN 'line_range_and_byte_cap' WHEN event_id % 3 = 0 THEN 'line_range' WHEN event_id % 5 = 0 THEN 'byte_cap' ELSE 'full_read' END AS savings_source FROM events""")
def savings_sources(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    level = F.when(k % 4 == 0, "compact").when(k % 4 == 1, "aggressive").otherwise("normal")
    return read(spark, sf, "events").select("event_id", usage.savings_source(level, k % 3 == 0, k % 5 == 0).alias("savings_source"))


@query(f"WITH {_USAGE} SELECT mode, count(*) AS events, CAST(sum(bytes_raw) AS BIGINT) AS bytes_raw FROM u GROUP BY ALL")
def usage_log(spark: SparkSession, sf: str) -> DataFrame:
    """The events appended to a log, between lines that are none, and read back."""
    folder = f"{ensure_checkpoint_dir(spark)}/usage-{uuid.uuid4().hex}"
    rows = usage_rows(spark, sf)
    state.append_usage(rows, folder)
    broken = F.concat(F.lit('{"mode": "cli", "bytes_raw": '), F.when(F.col("s_suppkey") % 2 == 0, "7}").otherwise('"x"'))
    read(spark, sf, "supplier").select(broken.alias("value")).write.mode("append").text(folder)
    log = state.read_usage(spark, folder)
    return log.groupBy(F.when(F.trim(F.coalesce("mode", F.lit(""))) == "", "unknown").otherwise(F.col("mode")).alias("mode")).agg(F.count(F.lit(1)).alias("events"), F.sum("bytes_raw").alias("bytes_raw"))


# changes ----------------------------------------------------------------------------------------------------------------------


def _signatures(spark: SparkSession, sf: str, before: bool) -> DataFrame:
    """A user's events before or after the middle of the table as a file's signature: their number and newest minute."""
    e = read(spark, sf, "events")
    half = F.col("event_id") % 2 == (0 if before else 1)
    return e.where(half).groupBy(F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("path")).agg(F.count(F.lit(1)).alias("bytes"), (F.max("event_id") % 3).cast("bigint").alias("mtime_ms"))


_SIGNATURES = "sig AS (SELECT 'u/' || user_id AS path, event_id % 2 AS half, count(*) AS bytes, max(event_id) % 3 AS mtime FROM events GROUP BY ALL), diff AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'create' WHEN b.path IS NULL THEN 'remove' WHEN a.bytes <> b.bytes OR a.mtime <> b.mtime THEN 'modify' END AS kind FROM (SELECT * FROM sig WHERE half = 0) a FULL OUTER JOIN (SELECT * FROM sig WHERE half = 1) b USING (path))"


@query(f"WITH {_SIGNATURES} SELECT path, kind FROM diff WHERE kind IS NOT NULL")
def signature_diff(spark: SparkSession, sf: str) -> DataFrame:
    return changes.signature_diff(_signatures(spark, sf, True), _signatures(spark, sf, False))


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select((F.col("event_id") % 5).cast("bigint").alias("sequence"), F.lit(0).cast("bigint").alias("updated_at_ms"), F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("kind"))


@query("SELECT CAST(4 AS BIGINT) AS sequence, 'u/' || user_id AS path, event_type AS kind FROM events WHERE event_id % 5 = 4")
def changes_latest(spark: SparkSession, sf: str) -> DataFrame:
    return changes.latest(_batches(spark, sf)).select("sequence", "path", "kind")


@query("SELECT DISTINCT 'u/' || user_id AS path FROM events WHERE event_id % 5 = 4 ORDER BY path LIMIT 20")
def hot(spark: SparkSession, sf: str) -> DataFrame:
    return changes.hot(_batches(spark, sf))


@query(f"WITH {_DOCS}, {_WORDS.format('docs')} SELECT term, count(*) AS n_files FROM words_t GROUP BY ALL")
def incremental_merge(spark: SparkSession, sf: str) -> DataFrame:
    """An index of stale texts with half the documents replaced and added equals one built anew."""
    f = doc_files(spark, sf)
    stale = f.where(F.col("file_id") % 2 == 1).unionByName(f.where(F.col("file_id") % 4 == 0).select("file_id", "path", F.lit("stale words").alias("text")))
    changed = f.where(F.col("file_id") % 2 == 0)
    return index.document_frequency(index.merge_postings(index.word_postings(stale), changed, index.word_postings(changed)))


def _moved(path: Column, k: Column) -> Column:
    """Every fifth path in a folder or under a name that is not indexed."""
    return F.when(k % 10 == 5, F.concat(F.lit("node_modules/"), path)).when(k % 10 == 0, F.concat(F.lit("x/.env."), k.cast("string"))).otherwise(path)


@query(f"WITH {_DOCS} SELECT path, sha256(text) AS hash FROM docs WHERE file_id % 5 <> 0 OR file_id % 2 = 1 AND file_id % 10 <> 5 UNION ALL SELECT path, sha256(text) FROM docs WHERE file_id % 2 = 1 AND file_id % 10 = 5")
def upsert_files(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the files are old, the other half created or changed; some of the changed paths are not eligible, which removes what was there."""
    f = doc_files(spark, sf)
    k = F.col("file_id")
    path = F.when(k % 2 == 0, _moved(F.col("path"), k)).otherwise(F.col("path"))
    placed = f.withColumn("path", path)
    base = f.where(k % 2 == 1).unionByName(placed.where(k % 4 == 0).select("file_id", "path", F.lit("old").alias("text")))
    return index.upsert_files(base, placed.where(k % 2 == 0).select("path", "text"), Config(max_file_size=1 << 40)).select("path", F.sha2("text", 256).alias("hash"))


_MODULES = "t AS (SELECT s_suppkey AS k, s_suppkey % 10 AS d FROM supplier)"


@query(f"""WITH {_MODULES} SELECT 'src/m' || k || '.js' AS path, './d' || d AS module, CASE WHEN d % 3 = 1 THEN 'src/d' || d || '/index.js' WHEN d % 3 = 2 THEN 'src/d' || d || '.ts' ELSE 'src/d' || d || '.js' END AS resolved_path FROM t""")
def reindex(spark: SparkSession, sf: str) -> DataFrame:
    """Modules import one of ten targets; a change removes some (the folder's index takes over), and creates better ones for others, beside files that are never indexed."""
    k, t = F.col("s_suppkey").cast("string"), F.col("i").cast("string")
    users = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("bigint").alias("file_id"), F.concat(F.lit("src/m"), k, F.lit(".js")).alias("path"), F.concat(F.lit("import x from './d"), (F.col("s_suppkey") % 10).cast("string"), F.lit("';\n")).alias("text"))
    ten = spark.range(10).select(F.col("id").alias("i"))
    target = lambda end, start: ten.select((F.lit(start) + F.col("i")).cast("bigint").alias("file_id"), F.concat(F.lit("src/d"), t, F.lit(end)).alias("path"), F.lit("1;").alias("text"))
    base = users.unionByName(target(".js", 1_000_000_000).where("file_id % 10 <> 2 and file_id % 10 <> 5 and file_id % 10 <> 8")).unionByName(target("/index.js", 1_000_000_100)).unionByName(target(".tsx", 1_000_000_200).where("file_id % 10 = 2"))
    tables = {name: cut(df) for name, df in index.build(base).items() if name in ("files", "imports", "edges")}
    created = target(".ts", 0).where("file_id % 3 = 2").select("path", "text").unionByName(ten.select(F.concat(F.lit("node_modules/d"), t, F.lit(".js")).alias("path"), F.lit("1;").alias("text")))
    removed = target(".js", 0).where("file_id % 3 = 1").select("path")
    return index.apply_changes(tables, created, removed)["imports"].select("path", "module", "resolved_path")


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 9 AS f FROM customer) SELECT CASE f WHEN 0 THEN 'a/b' || (k % 7) || '/t' || k || '.txt' WHEN 1 THEN 'keep' || k || '.log' ELSE 't' || k || '.py' END AS path, CAST(length('customer ' || k) AS BIGINT) AS bytes FROM c WHERE f IN (0, 1, 2)""")
def tree_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A tree with one file per customer, a third of them eligible: the others are hidden, generated, sensitive, too large, ignored or binary."""
    folder = f"{ensure_checkpoint_dir(spark)}/tree-{uuid.uuid4().hex}".removeprefix("file:")
    forms = ["'a/b' || k7 || '/t' || k || '.txt'", "'keep' || k || '.log'", "'t' || k || '.py'", "'.h/t' || k", "'dist/t' || k || '.js'", "'c/secrets' || k || '.txt'", "'big' || k || '.txt'", "'a/t' || k || '.log'", "'bin' || k || '.dat'"]
    path = F.expr("CASE f " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(forms)) + " END")
    body = F.concat(F.lit("customer "), F.col("k"))
    rows = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("k"), (F.col("c_custkey") % 7).cast("string").alias("k7"), (F.col("c_custkey") % 9).alias("f"))
    text = F.when(F.col("f") == 6, F.repeat(body, 20)).when(F.col("f") == 8, F.concat(body, F.lit("\x00"))).otherwise(body)
    written = rows.select(path.alias("path"), text.alias("text")).mapInPandas(partial(_write_files, folder=folder), "path string")
    written.unionByName(spark.createDataFrame([(".gitignore", "*.log\n!keep*.log\n")], "path string, text string").mapInPandas(partial(_write_files, folder=folder), "path string")).count()
    found = index.files_from_scan(tree_source.scan(spark, folder, max_file_size=100)).select("path", "bytes")
    return cut(found)


def _write_files(batches, folder: str):
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["text"]):
            full = os.path.join(folder, path)
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "wb") as f:
                f.write(content.encode())
        yield pdf[["path"]]


# edits ------------------------------------------------------------------------------------------------------------------------

_LF = "lf AS (SELECT doc_id AS file_id, text, string_split(text, chr(10)) AS p0 FROM documents WHERE text IS NOT NULL), d AS (SELECT file_id, text, p0[len(p0)] = '' AS ended, CASE WHEN p0[len(p0)] = '' THEN p0[1:len(p0) - 1] ELSE p0 END AS p FROM lf)"


@query(f"WITH {_LF} SELECT file_id, array_to_string(p[1:1] || ['new a', 'new b'] || p[4:], chr(10)) || CASE WHEN len(p) > 3 AND NOT ended THEN '' ELSE chr(10) END AS text FROM d WHERE len(p) >= 3")
def edit_replace(spark: SparkSession, sf: str) -> DataFrame:
    return edit.edit_column(doc_files(spark, sf), "replace", 2, 3, "new a\nnew b\n").select("file_id", "text")


@query(f"WITH {_LF} SELECT file_id, array_to_string(p[1:1] || ['put in'] || p[2:], chr(10)) || CASE WHEN len(p) > 1 AND NOT ended THEN '' ELSE chr(10) END AS text FROM d WHERE len(p) >= 1")
def edit_insert(spark: SparkSession, sf: str) -> DataFrame:
    return edit.edit_column(doc_files(spark, sf), "insert", 2, None, "put in\n").select("file_id", "text")


@query(f"WITH {_LF} SELECT file_id, CASE WHEN len(p) = 2 THEN '' ELSE array_to_string(p[3:], chr(10)) || CASE WHEN ended THEN chr(10) ELSE '' END END AS text FROM d WHERE len(p) >= 2")
def edit_delete(spark: SparkSession, sf: str) -> DataFrame:
    return edit.edit_column(doc_files(spark, sf), "delete", 1, 2).select("file_id", "text")


# streaming --------------------------------------------------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS n, CAST(count_if(event_type = 'error') AS BIGINT) AS n_errors FROM events GROUP BY user_id")
def stream_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Events drained as a stream into a table, each batch merged once, then counted: equal to the batch result."""
    from srcatlas.streaming.watch import merge_stream

    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = f"{sf}/events.parquet"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(source)

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors")).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    merge_stream(stream, merge, f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("n_errors").alias("n_errors"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS newest FROM events GROUP BY user_id")
def utc_stamps(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    seconds = F.floor(F.unix_micros(F.max("ts").cast("timestamp")) / 1_000_000)
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), text.utc_text(seconds).alias("newest"))
