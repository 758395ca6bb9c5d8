"""One-file summaries and the report about test files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.functions.text import ascii_lower, split_lines, trim_unicode
from srcatlas.plans.runtime import spread

# Labels by extension, in summaries and in the test report.
_JS, _TS, _TSX = ("js", "mjs", "cjs"), ("ts", "mts", "cts"), ("tsx",)
SMART_LANGUAGES = {
    "rs": "Rust", **dict.fromkeys(_JS, "JavaScript"), **dict.fromkeys(_TS, "TypeScript"), "tsx": "TSX", "jsx": "JSX", **dict.fromkeys(("py", "pyw"), "Python"), "go": "Go", "php": "PHP", "java": "Java", "cs": "C#",
    **dict.fromkeys(("c", "h"), "C"), **dict.fromkeys(("cc", "cpp", "cxx", "hpp", "hh", "hxx"), "C++"), "rb": "Ruby", "json": "JSON", "toml": "TOML", **dict.fromkeys(("yml", "yaml"), "YAML"),
}
SMART_PARSERS = {
    "rs": "tree-sitter-rust", **dict.fromkeys(_JS, "tree-sitter-javascript"), **dict.fromkeys(_TS, "tree-sitter-typescript"), **dict.fromkeys(("tsx", "jsx"), "tree-sitter-tsx"), **dict.fromkeys(("py", "pyw"), "tree-sitter-python"),
    "go": "tree-sitter-go", "php": "tree-sitter-php", "java": "tree-sitter-java", "cs": "tree-sitter-c-sharp", **dict.fromkeys(("c", "h"), "tree-sitter-c"), **dict.fromkeys(("cc", "cpp", "cxx", "hpp", "hh", "hxx"), "tree-sitter-cpp"), "rb": "tree-sitter-ruby",
}
TEST_LANGUAGES = {"rs": "Rust", **dict.fromkeys(_JS, "JavaScript"), **dict.fromkeys(_TS, "TypeScript"), **dict.fromkeys(("tsx", "jsx"), "React"), **dict.fromkeys(("py", "pyw"), "Python"), "go": "Go", "php": "PHP", "java": "Java", "cs": "C#", "rb": "Ruby"}
COUNTED = {"functions": ("function", "method"), "structs": ("struct",), "enums": ("enum",), "traits": ("trait",), "impls": ("impl",), "classes": ("class",), "interfaces": ("interface",)}
KNOWN_MODULES = ("clap", "axum", "express", "django")
LARGE_BYTES = 20_000
IMPORTANT, IMPORTANT_CHARS = 8, 160


def label_of(ext: Column, table: dict[str, str], default: str | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), ext)
    return found if default is None else F.coalesce(found, F.lit(default))


def smart_reports(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(file_id, path, language, parser, fallback, size_bytes, symbols struct, imports sorted, summary) of every file."""
    counts = symbols.groupBy("file_id").agg(*[F.count_if(F.col("kind").isin(*kinds)).alias(name) for name, kinds in COUNTED.items()], F.max(F.col("name") == "main").alias("has_main"))
    modules = imports.groupBy("file_id").agg(F.sort_array(F.collect_set("module")).alias("modules"))
    rows = files.join(counts, "file_id", "left").join(modules, "file_id", "left")
    names = F.coalesce("modules", F.array().cast("array<string>"))
    known = F.filter(F.array(*map(F.lit, KNOWN_MODULES)), lambda m: F.array_contains(names, m))
    summary = F.array_compact(
        F.array(
            F.when(F.col("has_main"), "Has an entry point named main."),
            F.when(F.size(known) > 0, F.concat(F.lit("Uses the "), F.array_join(known, ", "), F.lit(" module."))),
            F.when(F.col("bytes") > LARGE_BYTES, "Is a large file; read a range of it."),
        )
    )
    parser = label_of(F.col("ext"), SMART_PARSERS)
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "file_id", "path", label_of(F.col("ext"), SMART_LANGUAGES, "Unknown").alias("language"), parser.alias("parser"), parser.isNull().alias("fallback"), F.col("bytes").alias("size_bytes"),
        F.struct(*[F.coalesce(F.col(c), zero).alias(c) for c in COUNTED]).alias("symbols"), names.alias("imports"), summary.alias("summary"),
    )


def _any(t: Column, low: Column, starts: tuple = (), holds: tuple = (), holds_low: tuple = ()) -> Column:
    result = F.lit(False)
    if starts:
        result = result | F.rlike(t, F.lit("^(?:" + "|".join(map(re.escape, starts)) + ")"))
    if holds:
        result = result | F.rlike(t, F.lit("|".join(map(re.escape, holds))))
    if holds_low:
        result = result | F.rlike(low, F.lit("|".join(map(re.escape, holds_low))))
    return result


def is_test_path(path: Column) -> Column:
    """In a folder tests, test or __tests__ below another one, or named like a test, in any case of letters and with either separator."""
    name = ascii_lower(F.regexp_extract(path, r"([^/]*)$", 1))
    suffixes = ("_test.rs", "_test.go", "_test.py", ".test.js", ".test.ts", ".test.tsx", ".spec.js", ".spec.ts", ".spec.tsx", "test.java", "tests.cs")
    folders = ascii_lower(F.translate(path, "\\", "/"))
    return F.rlike(folders, F.lit("/(?:tests|test|__tests__)/")) | name.startswith("test_") | F.rlike(name, F.lit("(?:" + "|".join(map(re.escape, suffixes)) + ")$"))


# What shows a test framework, a fixture, a mock or an assertion, here and in `test_lines`.
def frameworks_of(ext: Column, t: Column, low: Column) -> Column:
    """Labels of the test frameworks that a line shows, by the file's language; a line may show several."""
    js = ext.isin("js", "mjs", "cjs", "ts", "mts", "cts", "tsx", "jsx")
    rules = [
        (ext == "rs", (t == "#[test]") | t.startswith("#[tokio::test") | t.startswith("#[async_std::test"), "rust-test"),
        (ext.isin("py", "pyw"), low.contains("pytest"), "pytest"),
        (ext.isin("py", "pyw"), low.contains("unittest"), "unittest"),
        (js, F.rlike(t, F.lit(r"(?<![A-Za-z0-9_])(?:describe|it|test)\(")), "js-test-runner"),
        (js, low.contains("jest"), "jest"),
        (js, low.contains("vitest") | t.contains("vi."), "vitest"),
        (ext == "go", t.contains("func Test") | t.contains("testing.T"), "go-test"),
        (ext == "java", t.contains("@Test") | low.contains("org.junit"), "junit"),
        (ext == "cs", t.contains("[Fact]") | t.contains("[Theory]"), "xunit"),
        (ext == "cs", t.contains("[Test]") | low.contains("nunit"), "nunit"),
        (ext == "php", low.contains("phpunit"), "phpunit"),
        (ext == "rb", t.contains("RSpec.describe") | t.startswith("describe "), "rspec"),
    ]
    return F.array_compact(F.array(*[F.when(a & b, name) for a, b, name in rules]))


def test_lines(files: DataFrame) -> DataFrame:
    """(file_id, path, ext, line, text, frameworks, fixture, mock, assertion, in_path) of every line of valid UTF-8 files, context applied.

    Outside a test path, fixtures, mocks and assertions count only from the first framework line on. The running flag is one
    aggregation per file and a join, so that a very long file is not sorted in one window.
    """
    rows = files.where(F.col("text").isNotNull())
    rows = rows.where(F.col("is_utf8")) if "is_utf8" in files.columns else rows
    rows = spread(rows.select("file_id", "path", "ext", "text"))
    lines = rows.select("file_id", "path", "ext", is_test_path(F.col("path")).alias("in_path"), F.posexplode(split_lines(F.col("text"))).alias("n", "raw"))
    t, low = F.col("t"), F.col("low")
    flagged = (
        lines.withColumn("t", trim_unicode(F.col("raw"))).withColumn("low", ascii_lower(F.col("t")))
        .select(
            "file_id", "path", "ext", "in_path", (F.col("n") + 1).cast("bigint").alias("line"), t.alias("text"), frameworks_of(F.col("ext"), t, low).alias("frameworks"),
            _any(t, low, ("setUp(", "def setUp", "tearDown(", "def tearDown"), ("@pytest.fixture",), ("fixture", "beforeeach", "before_each", "beforeall", "aftereach", "after_each", "afterall")).alias("fixture"),
            _any(t, low, (), ("jest.fn", "vi.fn", "Mockito."), ("mock", "monkeypatch", "stub", "spy", "fake")).alias("mock"),
            _any(t, low, ("assert ",), (" assert ", "assert!(", "assert_eq!(", "assert_ne!(", "expect(", "assertThat("), ("assert_", "require.")).alias("assertion"),
        )
    )
    first = flagged.where(F.size("frameworks") > 0).groupBy("file_id").agg(F.min("line").alias("first"))
    counted = F.col("in_path") | (F.col("line") >= F.col("first"))
    joined = flagged.join(first, "file_id", "left")
    return joined.select("file_id", "path", "ext", "in_path", "line", "text", "frameworks", *[(F.col(c) & F.coalesce(counted, F.lit(False))).alias(c) for c in ("fixture", "mock", "assertion")])


def tests_aware_files(files: DataFrame) -> DataFrame:
    """(path, language, frameworks, framework_lines, fixtures, mocks, assertions, important_lines) of test files: those matched by path or content."""
    lines = test_lines(files)
    kinds = F.concat(
        F.transform("frameworks", lambda f: F.struct(F.lit(0).alias("o"), F.lit("framework").alias("kind"))),
        F.array_compact(F.array(*[F.when(F.col(c), F.struct(F.lit(i).alias("o"), F.lit(c).alias("kind"))) for i, c in enumerate(("fixture", "mock", "assertion"), 1)])),
    )
    important = lines.select("file_id", "line", F.substring("text", 1, IMPORTANT_CHARS).alias("text"), F.posexplode(kinds).alias("p", "k"))
    w = Window.partitionBy("file_id").orderBy("line", "p")
    top = important.withColumn("r", F.row_number().over(w)).where(F.col("r") <= IMPORTANT).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("line", "p", F.col("k.kind").alias("kind"), "text"))).alias("top"))
    per_file = lines.groupBy("file_id").agg(
        F.max("path").alias("path"), F.max("ext").alias("ext"), F.max("in_path").alias("in_path"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("frameworks")))).alias("frameworks"),
        F.count_if(F.size("frameworks") > 0).alias("framework_lines"), F.count_if("fixture").alias("fixtures"), F.count_if("mock").alias("mocks"), F.count_if("assertion").alias("assertions"),
    )
    kept = per_file.where(F.col("in_path") | (F.col("framework_lines") > 0)).join(top, "file_id", "left")
    shown = F.transform(F.coalesce("top", F.array().cast("array<struct<line:bigint,p:int,kind:string,text:string>>")), lambda x: F.struct(x["line"].alias("line"), x["kind"].alias("kind"), x["text"].alias("text")))
    return kept.select("path", label_of(F.col("ext"), TEST_LANGUAGES, "Unknown").alias("language"), "frameworks", "framework_lines", "fixtures", "mocks", "assertions", shown.alias("important_lines"))


def tests_aware_totals(files: DataFrame) -> DataFrame:
    """One row: test files, sums of the counts, distinct frameworks, confidence high if any framework was seen, else medium."""
    per_file = tests_aware_files(files)
    # the set of frameworks is bounded by the rules above
    return per_file.agg(
        F.count(F.lit(1)).alias("test_files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("fixtures", "mocks", "assertions")], F.array_sort(F.array_distinct(F.flatten(F.collect_set("frameworks")))).alias("frameworks")
    ).withColumn("confidence", F.when(F.size("frameworks") > 0, "high").otherwise("medium"))
