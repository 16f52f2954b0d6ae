"""Queries over table-backed file catalogs, and the same in DuckDB SQL, written independently of the lowering here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filescope.functions import paths, previews
from filescope.functions.matching import MatchOptions, fnmatch, matches
from filescope.functions.patterns import PathPattern, Pattern, escape, try_expand
from filescope.operators import budget, prefer, prune
from filescope.operators.ignore import IgnoreFile, decide_by_table, ignored, rule_table
from filescope.operators.ruleset import Ruleset
from filescope.plans import report
from filescope.sources import scores, tables

HIDE = MatchOptions(literal_dot=True)
SHOW = MatchOptions()

#: The catalog in SQL; kinds are spelled out for what it can hold.
DOCS = """
docs AS (SELECT doc_id, text, source || '/' || lang || '/' ||
  CASE WHEN doc_id % 23 = 0 THEN 'target/' WHEN doc_id % 19 = 0 THEN 'tests/' WHEN doc_id % 17 = 0 THEN '.cache/' ELSE '' END ||
  CASE WHEN doc_id % 13 = 0 THEN '.doc_' ELSE 'doc_' END || doc_id || '.' ||
  (['rs','py','md','toml','json','png','j2','swift','html','xyz'])[(doc_id % 10 + 1)::INT] AS path,
  octet_length(encode(text))::BIGINT AS size, ((octet_length(encode(text)) * 2 + 6) // 7)::BIGINT AS tokens_est,
  timestamp '2024-01-01 00:00:00' + to_minutes((doc_id * 7919 % 100000)::BIGINT) AS modified,
  CASE WHEN doc_id % 23 = 0 THEN 'build' WHEN doc_id % 19 = 0 THEN 'test'
    ELSE (['source','source','doc','config','data','binary','generated','source','source','unknown'])[(doc_id % 10 + 1)::INT] END AS kind
  FROM documents)"""


def _sql(body: str, *more: str) -> str:
    return "WITH " + ",".join([DOCS, *more]) + body


def _entries(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return tables.doc_catalog(spark, sf_dir, *keep)


def _glob(text: str, options: MatchOptions = HIDE, max_depth: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        patterns = [PathPattern.parse(p) for p in try_expand(text)]
        hit = prune.any_of(prune.matched(patterns, options, max_depth))
        return _entries(spark, sf_dir).filter(hit).select("path", "size", "tokens_est", "kind")

    return run


def _glob_sql(test: str) -> str:
    return _sql(f" SELECT path, size, tokens_est, kind FROM docs WHERE {test}")


def _full(*tests: tuple[str, MatchOptions]) -> Callable[[SparkSession, str], DataFrame]:
    """One flag a pattern, over whole paths."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _entries(spark, sf_dir)
        return df.select("path", *[fnmatch(F.col("path"), p, o).alias(f"m{i}") for i, (p, o) in enumerate(tests)])

    return run


def _full_sql(*tests: str) -> str:
    return _sql(" SELECT path, " + ", ".join(f"{t} AS m{i}" for i, t in enumerate(tests)) + " FROM docs")


def _re(pattern: str) -> str:
    return f"regexp_full_match(path, '{pattern}', 's')"


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
S: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    Q[name] = run
    if sql is not None:
        S[name] = sql


# patterns

_add(
    "glob_recursive",
    lambda s, d: _glob("src1*/**/*.{rs,py}")(s, d).orderBy(paths.order_key(F.col("path"))),
    _glob_sql(_re(r"src1[^/]*/([^/.][^/]*/)*[^/.][^/]*\.(rs|py)")) + " ORDER BY string_split(path, '/')",
)
_add("glob_star", _glob("src2/*/doc_1*.md"), _glob_sql(_re(r"src2/[^/.][^/]*/doc_1[^/]*\.md")))
_add("glob_question", _glob("src?/e?/doc_?1.*"), _glob_sql(_re(r"src[^/]/e[^/]/doc_[^/]1\.[^/]*")))
_add("glob_class", _glob("src[1-3]/[de][ens]/doc_[0-9][02468].*"), _glob_sql(_re(r"src[1-3]/[de][ens]/doc_[0-9][02468]\.[^/]*")))
_add("glob_negated_class", _glob("src[!1-8]/**/*[^0-8].[!jm]*"), _glob_sql(_re(r"src[^1-8/]/([^/.][^/]*/)*([^/.][^/]*)?[^0-8/]\.[^jm/][^/]*")))
_add("glob_posix_class", _glob("src[[:digit:]]/[[:lower:]][[:alpha:]]/doc_*[[:digit:]].[[:alnum:]]*"), _glob_sql(_re(r"src[0-9]/[a-z][a-zA-Z]/doc_[^/]*[0-9]\.[a-zA-Z0-9][^/]*")))
_add("glob_case_insensitive", _glob("SRC1?/EN/*.RS", MatchOptions(case_sensitive=False, literal_dot=True)), _glob_sql(_re(r"src1[^/]/en/[^/.][^/]*\.rs")))
_add("glob_brace_union", _glob("{src0,src1{0,1}}/{en,de}/*.{rs,py}"), _glob_sql(_re(r"(src0|src10|src11)/(en|de)/[^/.][^/]*\.(rs|py)")))
_add("glob_dotfile_rule", lambda s, d: _glob("**/*.rs")(s, d).withColumn("rule", F.lit("hide")).unionByName(_glob("**/*.rs", SHOW)(s, d).withColumn("rule", F.lit("show"))).unionByName(_glob("**/.*")(s, d).withColumn("rule", F.lit("dots"))),
     _sql(f""" SELECT path, size, tokens_est, kind, 'hide' AS rule FROM docs WHERE {_re(r'([^/.][^/]*/)*[^/.][^/]*\.rs')}
       UNION ALL SELECT path, size, tokens_est, kind, 'show' FROM docs WHERE path LIKE '%.rs'
       UNION ALL SELECT path, size, tokens_est, kind, 'dots' FROM docs WHERE {_re(r'([^/.][^/]*/)*[.][^/]*')}"""))  # fmt: skip
_add("glob_trailing_recursive", _glob("src1/**"), _glob_sql(_re(r"src1(/[^/.][^/]*)+")))
_add("glob_middle_recursive", _glob("**/tests/**/doc_*"), _glob_sql(_re(r"([^/.][^/]*/)*tests/([^/.][^/]*/)*doc_[^/]*")))
_add("glob_literal", _glob("src4/fr/doc_4.json"), _glob_sql("path = 'src4/fr/doc_4.json'"))
_add("glob_many_stars", _glob("src*/*/d*o*c*_*1*.*"), _glob_sql(_re(r"src[^/]*/[^/.][^/]*/d[^/]*o[^/]*c[^/]*_[^/]*1[^/]*\.[^/]*")))
_add("glob_escape", lambda s, d: _entries(s, d).select("path", fnmatch(F.col("path"), escape("src1/en/doc_1.py"), SHOW).alias("own"), F.lit(matches(Pattern.parse(escape("a*[b]{c}?\\")), "a*[b]{c}?\\")).alias("round_trip")),
     _sql(" SELECT path, path = 'src1/en/doc_1.py' AS own, true AS round_trip FROM docs"))
_add("glob_pathname", _full(("src1/*.rs", SHOW), ("src1/*.rs", MatchOptions(literal_separator=True)), ("src1/*/*.rs", MatchOptions(literal_separator=True)), ("src?/**/*.py", SHOW)),
     _full_sql(_re(r"src1/.*\.rs"), _re(r"src1/[^/]*\.rs"), _re(r"src1/[^/]*/[^/]*\.rs"), _re(r"src./(.*/)?.*\.py")))
_add("fnmatch_period", _full(("*.doc_*", MatchOptions(literal_dot=True)), ("*/*/.doc_*", MatchOptions(literal_separator=True, literal_dot=True)), ("src*[!0-4].rs", SHOW)),
     _full_sql(_re(r".*\.doc_.*") + " AND " + _re(r"[^/.].*") + " AND NOT regexp_matches(regexp_extract(path, '^(.*)[.]doc_', 1) , '(^|/)[.]') AND NOT regexp_matches(regexp_extract(path, '[.]doc_(.*)$', 1), '/[.]')",
               _re(r"[^/.][^/]*/[^/.][^/]*/\.doc_[^/]*"), _re(r"src.*[^0-4]\.rs")))
_add("brace_expansion", lambda s, d: s.createDataFrame([(i, p) for i, p in enumerate(try_expand("{a,b{c,d}}/{x,}*.{rs,py}"))], "i int, pattern string"),
     """SELECT (row_number() OVER (ORDER BY a, x, e) - 1)::INT AS i, ['a','bc','bd'][a] || '/' || ['x',''][x] || '*.' || ['rs','py'][e] AS pattern
        FROM range(1, 4) t(a), range(1, 3) u(x), range(1, 3) v(e)""")  # fmt: skip
_add("pattern_table_join", lambda s, d: _entries(s, d).join(F.broadcast(s.createDataFrame([("rust", r"(?s)^.*\.rs\z"), ("english", r"(?s)^[^/]*/en/.*\z")], "label string, said string")), F.expr("rlike(path, said)")).groupBy("label").agg(F.count(F.lit(1)).alias("n")),
     _sql(" SELECT 'rust' AS label, count(*) AS n FROM docs WHERE path LIKE '%.rs' UNION ALL SELECT 'english', count(*) FROM docs WHERE path LIKE '%/en/%' AND path NOT LIKE '%/%/en/%'"))

# scalar functions

_add("kind_counts", lambda s, d: _entries(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("tokens_est").alias("tokens_est")),
     _sql(" SELECT kind, count(*) AS files, sum(tokens_est)::BIGINT AS tokens_est FROM docs GROUP BY kind"))
_add("tokens_by_extension", lambda s, d: _entries(s, d).select(paths.extension(F.col("path")).alias("ext"), paths.tokens_by_extension(F.col("path")).alias("guess")).groupBy("ext", "guess").agg(F.count(F.lit(1)).alias("n")),
     _sql(""" SELECT ext, CASE ext WHEN 'rs' THEN 858 WHEN 'py' THEN 715 WHEN 'md' THEN 1143 WHEN 'toml' THEN 429 WHEN 'json' THEN 429
       WHEN 'swift' THEN 1000 WHEN 'html' THEN 1429 ELSE 572 END::BIGINT AS guess, count(*) AS n
       FROM (SELECT regexp_extract(path, '[.]([a-z0-9]*)$', 1) AS ext FROM docs) GROUP BY ext"""))  # fmt: skip
_add("language_counts", lambda s, d: _entries(s, d).groupBy(paths.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n")),
     _sql(""" SELECT CASE doc_id % 10 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'markdown' WHEN 3 THEN 'toml' WHEN 4 THEN 'json'
       WHEN 7 THEN 'swift' WHEN 8 THEN 'html' END AS language, count(*) AS n FROM docs GROUP BY 1"""))  # fmt: skip
_add("path_parts", lambda s, d: _entries(s, d).select("path", paths.name(F.col("path")).alias("name"), paths.extension(F.col("path")).alias("ext"), F.array_join(paths.parents(F.col("path")), "|").alias("above")),
     _sql(" SELECT path, string_split(path, '/')[-1] AS name, regexp_extract(path, '[.]([a-z0-9]*)$', 1) AS ext, array_to_string(string_split(path, '/')[:-2], '|') AS above FROM docs"))
_add("sif_records", lambda s, d: report.records(_entries(s, d)).select("path", "record"),
     _sql(" SELECT path, path || chr(9) || size || chr(9) || kind || chr(9) || tokens_est || chr(9) || 'false' AS record FROM docs"))
_add("quoted_fields", lambda s, d: s.read.parquet(f"{d}/benchmark.parquet").select("item_id", paths.field(F.col("text")).alias("field"), paths.attribute(F.col("text")).alias("attribute")),
     r"""SELECT item_id, CASE WHEN regexp_matches(a, '^[#§ ]|[ ]$|[\x00-\x1f,\[\]{}"\\]') THEN '"' || replace(replace(replace(a, '\', '\\'), '"', '\"'), chr(10), '\n') || '"' ELSE a END AS field,
       CASE WHEN regexp_full_match(b, '[!#-<>-\[\]-~]+') THEN b ELSE '"' || replace(replace(replace(b, '\', '\\'), '"', '\"'), chr(10), '\n') || '"' END AS attribute
       FROM (SELECT item_id, text AS a, text AS b FROM benchmark)""")  # fmt: skip
_add("url_catalog", lambda s, d: tables.url_catalog(s, d).select("page_id", "path", "size", "tokens_est"),
     "SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path, octet_length(encode(html))::BIGINT AS size, ((octet_length(encode(html)) * 2 + 6) // 7)::BIGINT AS tokens_est FROM pages")

# filters and pruning

_add("depth_limit", _glob("**", HIDE, 3), _glob_sql(_re(r"[^/.][^/]*(/[^/.][^/]*){0,2}")))
_add("depth_after_prefix", _glob("src1/en/**", HIDE, 1), _glob_sql(_re(r"src1/en/[^/.][^/]*")))


def _decided(**options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pattern = options.get("pattern", "**")
        said = prune.decision([PathPattern.parse(p) for p in try_expand(pattern)], HIDE, **{k: v for k, v in options.items() if k != "pattern"})
        return _entries(spark, sf_dir).withColumn("decision", said)

    return run


def _kept(**options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: _decided(**options)(s, d).filter("decision = 'keep'").select("path", "kind")


VISIBLE = _re(r"[^/.][^/]*(/[^/.][^/]*)*")
_add("exclude_name", _kept(exclude=[Pattern.parse("t*s"), Pattern.parse("*.p?")]), _sql(f" SELECT path, kind FROM docs WHERE {VISIBLE} AND NOT {_re(r'(.*/)?(t[^/]*s(/.*)?|[^/]*[.]p[^/])')}"))
_add("exclude_path", _kept(exclude=[Pattern.parse("src1*/**/target/"), Pattern.parse("src2/en/*")]), _sql(f" SELECT path, kind FROM docs WHERE {VISIBLE} AND NOT {_re(r'src1[^/]*/(.*/)?target/.*|src2/en/.*')}"))
_add("kind_filter", _kept(kinds=["source", "doc"]), _sql(f" SELECT path, kind FROM docs WHERE {VISIBLE} AND kind IN ('source', 'doc')"))
_add("only_dirs", lambda s, d: tables.with_directories(_entries(s, d)).withColumn("decision", prune.decision([PathPattern.parse("src1*/**")], SHOW, only_dirs=True)).filter("decision = 'keep'").select("path", "size", "kind", "is_dir"),
     _sql(r""" SELECT DISTINCT p AS path, 0::BIGINT AS size, 'unknown' AS kind, true AS is_dir FROM (SELECT unnest([regexp_extract(path, '^(src1[^/]*/[^/]*)/', 1), regexp_extract(path, '^(src1[^/]*/[^/]*/[^/]*)/', 1)]) AS p FROM docs) WHERE p <> ''"""))
_add("user_predicate", lambda s, d: _kept(predicate=F.col("size") % 2 == 0)(s, d), _sql(f" SELECT path, kind FROM docs WHERE {VISIBLE} AND size % 2 = 0"))
_add("pruned_counts", lambda s, d: report.decision_counts(_decided(pattern="src1*/**", exclude=[Pattern.parse("tests")], ignores=[IgnoreFile.parse("target/\n")], kinds=["source"])(s, d)),
     _sql(f""" SELECT decision, count(*) AS n FROM (SELECT CASE WHEN NOT {VISIBLE} THEN 'hidden' WHEN path LIKE '%/target/%' THEN 'gitignore' WHEN path LIKE '%/tests/%' THEN 'exclude'
       WHEN kind <> 'source' THEN 'kind' ELSE 'keep' END AS decision FROM docs WHERE path LIKE 'src1%') GROUP BY 1"""))  # fmt: skip

# order, limits and budgets

for _name, _order, _by in (("prefer_size", "size", "size DESC"), ("prefer_size_asc", "size-asc", "size ASC"), ("prefer_recent", "recent", "modified DESC NULLS LAST")):
    _add(_name, lambda s, d, o=_order: _entries(s, d).orderBy(*prefer.keys(o)).limit(50).select("path", "size", "modified"), _sql(f" SELECT path, size, modified FROM docs ORDER BY {_by}, string_split(path, '/') LIMIT 50"))
_add("limit_top_n", lambda s, d: budget.stop(_entries(s, d), prefer.keys("path"), limit=20).filter("kept").select("position", "path"),
     _sql(" SELECT position::INT AS position, path FROM (SELECT row_number() OVER (ORDER BY string_split(path, '/')) AS position, path FROM docs) WHERE position <= 20"))
RUN = "run AS (SELECT *, row_number() OVER w AS position, sum(size) OVER w AS run_bytes, sum(tokens_est) OVER w AS run_tokens FROM docs WINDOW w AS (ORDER BY string_split(path, '/') ROWS UNBOUNDED PRECEDING))"
_add("budget_stop_tokens", lambda s, d: budget.stop(_entries(s, d), prefer.keys("path"), tokens=80_000).filter("kept").select("path", "tokens_est", "run_tokens"),
     _sql(" SELECT path, tokens_est, run_tokens::BIGINT AS run_tokens FROM run WHERE run_tokens <= 80000", RUN))
_add("budget_stop_bytes", lambda s, d: budget.stop(_entries(s, d), prefer.keys("path"), size=100_000).filter("kept").select("path", "size", "run_bytes"),
     _sql(" SELECT path, size, run_bytes::BIGINT AS run_bytes FROM run WHERE run_bytes <= 100000", RUN))


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [("tokens", {"tokens": 80_000}), ("bytes", {"size": 100_000}), ("both", {"tokens": 10, "size": 10}), ("limit", {"limit": 5, "tokens": 10**12}), ("none", {"tokens": 10**12})]
    out = None
    for name, options in cases:
        row = budget.stop_reason(budget.stop(_entries(spark, sf_dir), prefer.keys("path"), **options)).select(F.lit(name).alias("budget"), "stopped_early")
        out = row if out is None else out.unionByName(row)
    return out


_add("stop_reason", _reasons, "SELECT * FROM (VALUES ('tokens', 'token_budget'), ('bytes', 'byte_budget'), ('both', 'token_budget'), ('limit', 'limit'), ('none', NULL)) t(budget, stopped_early)")
FIT = """n AS (SELECT path, tokens_est, row_number() OVER (ORDER BY string_split(path, '/')) AS i FROM docs),
f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS used, ''::VARCHAR AS path, 0::BIGINT AS tokens_est, false AS kept UNION ALL
  SELECT n.i, CASE WHEN f.used + n.tokens_est <= 80000 THEN f.used + n.tokens_est ELSE f.used END, n.path, n.tokens_est, f.used + n.tokens_est <= 80000 FROM f JOIN n ON n.i = f.i + 1)"""
_add("budget_fit", lambda s, d: budget.fit(_entries(s, d), prefer.keys("path"), tokens=80_000).filter("decision = 'keep'").select("path", "tokens_est"),
     _sql(" SELECT path, tokens_est FROM f WHERE kept", FIT).replace("WITH ", "WITH RECURSIVE ", 1))
_add("budget_fit_skipped", lambda s, d: budget.fit(_entries(s, d), prefer.keys("path"), tokens=80_000).filter("decision = 'skip'").agg(F.count(F.lit(1)).alias("files"), F.sum("tokens_est").alias("tokens_est"), F.max_by("path", "tokens_est").alias("largest")),
     _sql(" SELECT count(*) AS files, sum(tokens_est)::BIGINT AS tokens_est, max_by(path, tokens_est) AS largest FROM f WHERE NOT kept AND i > 0", FIT).replace("WITH ", "WITH RECURSIVE ", 1))

# rankings and sets


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _entries(spark, sf_dir, "doc_id").join(labels, "doc_id").select("path", (F.col("quality") + F.col("toxic") * 0.5).alias("score"))


RANK = "rank AS (SELECT path, (quality + toxic * 0.5)::DOUBLE AS score FROM docs JOIN labels USING (doc_id))"
_add("prefer_scores", lambda s, d: prefer.scored(_entries(s, d), scores.ranking(_ranking(s, d))).orderBy(*prefer.keys("scores")).limit(60).select("path", "score"),
     _sql(" SELECT path, score FROM docs LEFT JOIN rank USING (path) ORDER BY score DESC NULLS LAST, string_split(path, '/') LIMIT 60", RANK))
_add("scored_count", lambda s, d: prefer.scored(_entries(s, d), scores.ranking(_ranking(s, d))).agg(F.count("score").alias("scored"), F.count(F.lit(1)).alias("results")),
     _sql(" SELECT count(score) AS scored, count(*) AS results FROM docs LEFT JOIN rank USING (path)", RANK))


def _score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    line = F.when(i % 4 == 0, F.concat(F.lit('{"path": "./'), "path", F.lit('", "score": '), (i / 4).cast("string"), F.lit("}"))).when(i % 4 == 1, F.concat("path", F.lit("\t"), i.cast("string")))
    line = line.when(i % 4 == 2, F.concat(F.lit("  "), i.cast("string"), F.lit(" "), "path")).when(i % 8 == 3, F.lit("# comment")).otherwise(F.concat(F.lit("not a "), "path"))
    return scores.parse(_entries(spark, sf_dir, "doc_id").select(line.alias("value"))).select("path", "score", "ok")


_add("score_lines", _score_lines, _sql(""" SELECT CASE doc_id % 4 WHEN 3 THEN 'a ' || path ELSE path END AS path, CASE doc_id % 4 WHEN 0 THEN doc_id / 4.0 WHEN 3 THEN NULL ELSE doc_id::DOUBLE END::DOUBLE AS score,
  doc_id % 4 <> 3 AS ok FROM docs WHERE doc_id % 8 <> 3"""))


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files whose documents are labelled, and as many that are gone."""
    labelled = _entries(spark, sf_dir, "doc_id").join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id"), "doc_id", "left_semi")
    return labelled.select("path").unionByName(labelled.select(F.concat(F.lit("gone/"), "path").alias("path")))


_add("changed_semi_join", lambda s, d: _entries(s, d).join(_changed(s, d), "path", "left_semi").select("path", "kind"), _sql(" SELECT path, kind FROM docs WHERE doc_id IN (SELECT doc_id FROM labels)"))
_add("deleted_anti_join", lambda s, d: report.deleted(_changed(s, d), _entries(s, d)), _sql(" SELECT 'gone/' || path AS path, kind FROM docs WHERE doc_id IN (SELECT doc_id FROM labels)"))
_add("pattern_intersection", lambda s, d: _glob("**/*.rs")(s, d).join(_changed(s, d), "path", "left_semi").select("path"), _sql(f" SELECT path FROM docs WHERE doc_id IN (SELECT doc_id FROM labels) AND path LIKE '%.rs' AND {VISIBLE}"))

# rules

RULES = Ruleset().include("src*").include("*.rs", 2.0).exclude("*/target/*").include("*/en/*.md", 0.5).exclude("*/doc_1*")
INCLUDE_LAST = """CASE WHEN path LIKE '%/doc\\_1%' ESCAPE '\\' THEN false WHEN regexp_full_match(path, '.*/en/.*[.]md', 's') THEN true WHEN path LIKE '%/target/%' THEN false ELSE true END"""
_add("ruleset_match", lambda s, d: RULES.filter(_entries(s, d)).select("path"), _sql(f" SELECT path FROM docs WHERE {INCLUDE_LAST}"))
_add("ruleset_relevance", lambda s, d: RULES.rank(_entries(s, d)).select("path", F.col("relevance").cast("double").alias("relevance")),
     _sql(f" SELECT path, (1 + CASE WHEN path LIKE '%.rs' THEN 2 ELSE 0 END + CASE WHEN regexp_full_match(path, '.*/en/.*[.]md', 's') THEN 0.5 ELSE 0 END)::DOUBLE AS relevance FROM docs WHERE {INCLUDE_LAST}"))
_add("ruleset_kind", lambda s, d: RULES.filter(_entries(s, d), "source").select("path", "kind"), _sql(f" SELECT path, kind FROM docs WHERE {INCLUDE_LAST} AND kind = 'source'"))
IGNORES = [IgnoreFile.parse("target/\n*.png\n!doc_1*.png\n/src3/\n\\#x\n"), IgnoreFile.parse("!*.png\n/en/*.rs\n*.toml\n", "src5")]
IGNORED = r"""(path LIKE '%/target/%' OR path LIKE 'src3/%' OR CASE WHEN path LIKE 'src5/%' AND path LIKE '%.png' THEN false
  WHEN regexp_full_match(path, 'src5/en/[^/]*[.]rs|src5/.*[.]toml', 's') THEN true
  WHEN path LIKE '%.png' THEN NOT regexp_full_match(path, '(.*/)?doc_1[^/]*[.]png', 's') ELSE false END)"""
_add("gitignore_last_match", lambda s, d: decide_by_table(_entries(s, d), rule_table(s, IGNORES)), _sql(f" SELECT path, {IGNORED} AS ignored FROM docs"))
_add("gitignore_ancestor", lambda s, d: _entries(s, d).select("path", ignored(IGNORES, F.col("path"), F.lit(False)).alias("ignored")), _sql(f" SELECT path, {IGNORED} AS ignored FROM docs"))

# previews


def _preview(spec: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _entries(spark, sf_dir, "text").filter("kind <> 'binary'")
        x = previews.excerpt(F.col("path"), F.col("text"), previews.Preview.parse(spec))
        return df.select("path", x.alias("x")).filter("x is not null").select("path", "x.start", F.array_join("x.lines", "\n").alias("lines"))

    return run


LINES = r"lines AS (SELECT path, kind, regexp_split_to_array(regexp_replace(text, '\r?\n$', ''), '\r?\n') AS l FROM docs WHERE text <> '' AND kind <> 'binary')"
_add("preview_head", _preview("3"), _sql(" SELECT path, 1 AS start, array_to_string(l[1:3], chr(10)) AS lines FROM lines", LINES))
_add("preview_range", _preview("2-4"), _sql(" SELECT path, 2 AS start, array_to_string(l[2:4], chr(10)) AS lines FROM lines WHERE len(l) >= 2", LINES))
_add("preview_code", _preview("code:3"))

# accounts

_add("summary_totals", lambda s, d: report.totals(_entries(s, d)), _sql(" SELECT count(*) AS total_files, 0::BIGINT AS total_dirs, sum(size)::BIGINT AS total_bytes, sum(tokens_est)::BIGINT AS total_tokens_est FROM docs"))
_add("summary_kinds", lambda s, d: report.kinds(_entries(s, d)), _sql(" SELECT kind, count(*) AS n FROM docs GROUP BY kind ORDER BY n DESC, kind"))
_add("budget_remaining", lambda s, d: budget.stop(_entries(s, d), prefer.keys("path"), tokens=80_000).filter("kept").agg(F.greatest(F.lit(80_000) - F.sum("tokens_est"), F.lit(0)).alias("remaining")),
     _sql(" SELECT greatest(80000 - sum(tokens_est), 0)::BIGINT AS remaining FROM run WHERE run_tokens <= 80000", RUN))
_add("skipped_section", lambda s, d: report.skipped(budget.fit(_entries(s, d), prefer.keys("path"), tokens=80_000).filter("decision = 'skip'"), 50).select("path", "size", "kind", "tokens_est"),
     _sql(" SELECT path, size, kind, docs.tokens_est FROM docs JOIN f USING (path) WHERE NOT kept AND i > 0 ORDER BY docs.tokens_est DESC, string_split(path, '/') LIMIT 50", FIT).replace("WITH ", "WITH RECURSIVE ", 1))
_add("path_order", lambda s, d: budget.running(_entries(s, d).select("path"), prefer.keys("path"), {}).select("path", F.col("position").cast("bigint").alias("i")), _sql(" SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS i FROM docs"))
_add("output_cap", lambda s, d: report.capped_paths(_entries(s, d), 2_000).select("path"), _sql(" SELECT path FROM (SELECT path, sum(octet_length(encode(path)) + 1) OVER (ORDER BY string_split(path, '/') ROWS UNBOUNDED PRECEDING) AS b FROM docs) WHERE b <= 7000"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(S)
