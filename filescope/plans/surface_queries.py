"""Queries for what a user meets around the catalog: documents, specs, sizes, errors, comment families, tracked names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filescope import cli
from filescope.functions import paths, previews
from filescope.functions.matching import MatchOptions
from filescope.functions.patterns import GlobError, PathPattern, PatternError
from filescope.operators import prune
from filescope.operators.ignore import IgnoreFile, decide_by_table, ignored, rule_table
from filescope.operators.ruleset import Ruleset
from filescope.plans import document, query, report
from filescope.plans.catalog_queries import LINES, VISIBLE, _re, _sql
from filescope.sources import tables

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
S: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    Q[name], S[name] = run, sql


def _said(call: Callable[[str], object], text: str) -> str:
    """What a parser makes of a text, or its error."""
    try:
        return str(call(text))
    except PatternError as e:
        return f"{e.kind} at {e.pos}"
    except GlobError:
        return "error"


def _table(call: Callable[[str], object], texts: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, _: spark.createDataFrame([(t, _said(call, t)) for t in texts], "text string, said string")


def _values(*rows: tuple[str, str]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in rows) + ") t(text, said)"


def _cases(name: str, call: Callable[[str], object], *rows: tuple[str, str]) -> None:
    _add(name, _table(call, [t for t, _ in rows]), _values(*rows))


# what is typed

_cases("size_literal", cli.size, ("500", "500"), ("80K", "80000"), ("1.5M", "1500000"), ("2G", "2000000000"), ("1k", "1000"), ("0.0004K", "0"), ("1e3", "1000"), ("", "error"), ("K", "error"), ("-1", "error"), ("1T", "error"), ("0x10", "error"), ("99999999999999999999", "error"))
_cases("count_literal", cli._positive(cli._count), ("3", "3"), ("unlimited", "None"), ("0", "error"), ("-1", "error"), ("3K", "error"), ("", "error"))
_cases("preview_spec", lambda x: "{0.mode} {0.a} {0.b}".format(previews.Preview.parse(x)), ("5", "head 5 0"), ("3-9", "range 3 9"), ("4-4", "range 4 4"), ("code:7", "code 7 0"), ("0", "error"), ("9-3", "error"), ("code:", "error"), ("0-4", "error"), ("x", "error"), ("3-", "error"))
_cases("slash_in_bracket", lambda x: len(PathPattern.parse(x).components), ("src/*.rs", "2"), ("src/[a/b]c", "separator in bracket at 4"), ("[/]", "separator in bracket at 0"), ("a/b[!/x]/d", "separator in bracket at 3"), ("é/[x/y]", "separator in bracket at 3"), ("a[b]/c", "2"), ("[ab", "unclosed bracket at 0"), ("a**", "** not alone at 0"), ("***", "invalid wildcard at 2"), ("[[:nope:]]", "unknown character class at 0"))


def _checked(said: str) -> str:
    """A set of options, written as name=value, and whether it can be asked for."""
    values = {k: int(v) if v.isdigit() else v == "yes" if v in ("yes", "no") else v for k, v in (x.split("=") for x in said.split() if "=" in x)}
    kinds = [values.pop("kind")] if "kind" in values else []
    query.Options([x for x in said.split() if "=" not in x], kinds=kinds, **values).check()
    return "ok"


_cases("option_errors", _checked, ("*", "ok"), ("", "error"), ("* limit=0", "error"), ("* max_depth=0", "error"), ("* token_budget=0", "error"), ("* byte_budget=0", "error"), ("* limit=1 fit=no", "ok"), ("* no_stat=yes prefer=size", "error"), ("* no_stat=yes prefer=path", "ok"),
       ("* prefer=age", "error"), ("* git_files=yes only_dirs=yes", "error"), ("* kind=source", "ok"), ("* kind=soup", "error"))


# the catalog


def _docs(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return tables.doc_catalog(spark, sf_dir, *keep)


_add("comment_families", lambda s, d: _docs(s, d).select("path", previews.family_of(F.col("path")).alias("family")),
     _sql(" SELECT path, (['c','python','markup','hash','none','generic','generic','c','markup','generic'])[(doc_id % 10 + 1)::INT] AS family FROM docs"))
_add("datetimes_and_numbers", lambda s, d: _docs(s, d, "doc_id").select("path", paths.datetime_text(F.when(F.col("doc_id") % 7 > 0, F.col("modified"))).alias("time"), paths.number_text(F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") / 4)).alias("number")),
     _sql(""" SELECT path, CASE WHEN doc_id % 7 > 0 THEN strftime(modified, '%Y-%m-%dT%H:%M:%SZ') ELSE '_' END AS time,
       CASE WHEN doc_id % 5 = 0 THEN '_' WHEN doc_id % 4 = 0 THEN (doc_id // 4)::VARCHAR ELSE (doc_id / 4)::VARCHAR END AS number FROM docs"""))  # fmt: skip


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _docs(spark, sf_dir, "doc_id", "text").withColumn("text", F.concat(F.lit("first\n"), F.when(F.col("doc_id") % 3 == 0, "#/block\n").when(F.col("doc_id") % 3 == 1, " #/block\n").otherwise(""), F.coalesce("text", F.lit(""))))
    x = previews.excerpt(F.col("path"), F.col("text"), previews.Preview("head", 3))
    return df.select("path", F.array_join(x["lines"], "\n").alias("lines"))


_add("block_guard", _guarded, _sql(r""" SELECT path, CASE doc_id % 3 WHEN 0 THEN 'first' ELSE array_to_string(l[1:3], chr(10)) END AS lines
  FROM (SELECT path, doc_id, regexp_split_to_array(regexp_replace('first' || chr(10) || CASE WHEN doc_id % 3 = 1 THEN ' #/block' || chr(10) ELSE '' END || coalesce(text, ''), '\r?\n$', ''), '\r?\n') AS l FROM docs)"""))
_add("binary_sniff", lambda s, d: _docs(s, d, "doc_id", "text").select("path", previews.binary(F.concat(F.encode(F.substring("text", 1, 50), "UTF-8"), F.encode(F.repeat(F.lit("x"), (F.col("doc_id") * 100 % 30_000).cast("int")), "UTF-8"), F.unhex(F.when(F.col("doc_id") % 2 == 0, "00").otherwise("20")))).alias("is_binary")),
     _sql(" SELECT path, doc_id % 2 = 0 AND octet_length(encode(substr(text, 1, 50))) + doc_id * 100 % 30000 < 16384 AS is_binary FROM docs"))

#: The first line of code, line by line in SQL: comment marks of the families that the catalog has.
_MARKS = "(['//','#','','#','','//','//','//','','//'])[(doc_id % 10 + 1)::INT]"
_CODE = _sql(f""" SELECT path, start, array_to_string(CASE WHEN len(y) = 0 THEN l[start : start] ELSE l[start : start + len(y) - 1] END, chr(10)) AS lines
  FROM (SELECT path, l, start, list_reverse(list_filter(list_transform(range(1, least(3, len(l) - start + 1) + 1), lambda i: CASE WHEN trim(array_to_string(l[start + i - 1 : start + 2], '')) <> '' THEN i END), lambda i: i IS NOT NULL)) AS y
    FROM (SELECT path, l, coalesce(list_position(list_transform(l, lambda x: trim(x, ' ' || chr(9)) <> '' AND NOT (mark <> '' AND starts_with(trim(x, ' ' || chr(9)), mark)) AND NOT (other <> '' AND starts_with(trim(x, ' ' || chr(9)), other))), true), 1) AS start
      FROM (SELECT path, doc_id, {_MARKS} AS mark, CASE WHEN doc_id % 10 IN (6, 9, 5) THEN '#' ELSE '' END AS other, l FROM lines JOIN docs USING (path))))""", LINES)


# rules and decisions

_add("tracked_dot_names", lambda s, d: _docs(s, d, "doc_id").withColumn("tracked", F.col("doc_id") % 2 == 0).withColumn("decision", prune.decision([PathPattern.parse("**")], MatchOptions(literal_dot=True), tracked=F.col("tracked"))).select("path", "decision"),
     _sql(f" SELECT path, CASE WHEN {VISIBLE} OR doc_id % 2 = 0 THEN 'keep' ELSE 'hidden' END AS decision FROM docs"))


def _repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the files lie below .git: never listed under ignore rules, unless the pattern names it."""
    i = F.col("doc_id")
    df = _docs(spark, sf_dir, "doc_id").withColumn("path", F.when(i % 2 == 0, F.concat(F.lit(".git/"), "path")).when(i % 3 == 0, F.concat(F.lit("a/.git/"), "path")).otherwise(F.col("path")))
    rules = [IgnoreFile.parse("*.png\n")]
    told = lambda *p, **o: prune.decision([PathPattern.parse(x) for x in p], MatchOptions(), ignores=rules, **o)
    return df.select("path", told("**").alias("every"), told(".git/**").alias("own"))


_add("git_folder_skipped", _repository, _sql(""" SELECT p AS path, CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN NULL WHEN p LIKE '%.png' THEN 'gitignore' ELSE 'keep' END AS every,
  CASE WHEN doc_id % 2 <> 0 THEN NULL WHEN p LIKE '%.png' THEN 'gitignore' ELSE 'keep' END AS own
  FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '.git/' WHEN doc_id % 3 = 0 THEN 'a/.git/' ELSE '' END || path AS p FROM docs)"""))

#: src5 and src7/en are repositories of their own, the first file stands above the top, in up/top.
_BOUNDED = [
    IgnoreFile.parse("*.rs\ntop/src1/\n/src2/\nup/top/src3/de\n", prefix="up/top"),
    replace(IgnoreFile.parse("*.md\n!doc_1*.md\n"), stops=("src5", "src7/en")),
    replace(IgnoreFile.parse("*.toml\n", "src7"), stops=("src7/en",)),
    IgnoreFile.parse("*.json\n", "src7/en"),
]
_IGNORED = r"""(path LIKE 'src3/de/%' OR path LIKE 'src5/%.rs' OR (path LIKE '%.rs') OR (path LIKE '%.md' AND path NOT LIKE 'src5/%' AND path NOT LIKE 'src7/en/%' AND NOT regexp_full_match(path, '(.*/)?doc_1[^/]*[.]md', 's'))
  OR (path LIKE 'src7/%.toml' AND path NOT LIKE 'src7/en/%') OR path LIKE 'src7/en/%.json')"""
_add("gitignore_boundaries", lambda s, d: _docs(s, d).select("path", ignored(_BOUNDED, F.col("path"), F.lit(False)).alias("ignored")), _sql(f" SELECT path, {_IGNORED} AS ignored FROM docs"))
_add("gitignore_boundaries_by_table", lambda s, d: decide_by_table(_docs(s, d), rule_table(s, _BOUNDED)), _sql(f" SELECT path, {_IGNORED} AS ignored FROM docs"))


# whole queries over the catalog


def _run(spark: SparkSession, sf_dir: str, *patterns: str, **options) -> query.Report:
    return query.run(spark, query.Options(list(patterns), **options), catalog=_docs(spark, sf_dir))


_add("overlapping_patterns", lambda s, d: _run(s, d, "src1/**", "src1/en/**", "src{1,2}/*/*").entries.select("path", "kind"),
     _sql(f" SELECT path, kind FROM docs WHERE {VISIBLE} AND (path LIKE 'src1/%' OR {_re('src2/[^/]*/[^/]*')}) ORDER BY string_split(path, '/')"))
_add("unsorted_query", lambda s, d: _run(s, d, "src1/**", sort=False).entries.select("path"), _sql(f" SELECT path FROM docs WHERE {VISIBLE} AND path LIKE 'src1/%'"))
_add("case_insensitive_query", lambda s, d: _run(s, d, "SRC1/En/*", "src2/de/DOC*", case_sensitive=False).entries.select("path"), _sql(f" SELECT path FROM docs WHERE {VISIBLE} AND {_re('(src1/en|src2/de)/[^/]*')}"))
_add("query_counts", lambda s, d: report.decision_counts(_run(s, d, "src1*/**", exclude=["tests"], kinds=["source"]).decided),
     _sql(f""" SELECT decision, count(*) AS n FROM (SELECT CASE WHEN NOT {VISIBLE} THEN 'hidden' WHEN path LIKE '%/tests/%' THEN 'exclude' WHEN kind <> 'source' THEN 'kind' ELSE 'keep' END AS decision
       FROM docs WHERE path LIKE 'src1%') GROUP BY 1"""))  # fmt: skip


def _ruleset_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = Ruleset().include("**/*.rs").include("src1/**", 2.0).exclude("**/de/**")
    return rules.rank(_run(spark, sf_dir, "**", hidden=True).entries).select("path", F.col("relevance").cast("double").alias("relevance"))


_add("ruleset_query", _ruleset_query, _sql(""" SELECT path, (CASE WHEN path LIKE '%.rs' THEN 1 ELSE 0 END + CASE WHEN path LIKE 'src1/%' THEN 2 ELSE 0 END)::DOUBLE AS relevance
  FROM docs WHERE (path LIKE '%.rs' OR path LIKE 'src1/%') AND NOT regexp_full_match(path, '(.*/)?de/.*', 's')"""))


def _document(limit: int, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        said = query.Options(["src1*/**"], limit=limit, **options)
        text = document.build(query.run(spark, said, catalog=_docs(spark, sf_dir)), said, summary=True, cap=None).text()
        return spark.createDataFrame(list(enumerate(text.split("\n")[:-1], 1)), "i bigint, line string")

    return run


def _document_sql(limit: int, order: str, sort: str, extra: str = "", prefer: str = "") -> str:
    kinds = "enum(" + ",".join(paths.KINDS) + ")"
    field = f"path || chr(9) || size || chr(9) || kind || chr(9) || tokens_est || chr(9) || 'false'{extra}"
    schema = f"#schema path:str:path size:uint kind:{kinds} tokens_est:uint is_dir:bool{' modified:datetime?' if extra else ''}"
    return _sql(
        " SELECT row_number() OVER (ORDER BY part, j) AS i, line FROM l",
        f"m AS (SELECT *, row_number() OVER (ORDER BY {order}string_split(path, '/')) AS p FROM docs WHERE path LIKE 'src1%' AND {VISIBLE})",
        f"t AS (SELECT * FROM m WHERE p <= {limit})",
        "n AS (SELECT count(*) AS files, sum(size)::BIGINT AS size, sum(tokens_est)::BIGINT AS tokens FROM t)",
        f"""l AS (SELECT 0 AS part, j, line FROM (VALUES (1, '#!sif v1'), (2, '#context File listing produced by filescope'), (3, '{schema}'), (4, '#sort {sort}'), (5, '#limit {limit}')) v(j, line)
  UNION ALL SELECT 0, 6, '#truncated reason=limit' FROM n WHERE files = {limit}
  UNION ALL SELECT 1, p, {field} FROM t
  UNION ALL SELECT 2, j, line FROM (VALUES (1, '---'), (2, '§summary'), (3, '#schema key:str:id value:str note:str?')) v(j, line)
  UNION ALL SELECT 3, unnest([1, 2, 3, 4]), unnest(['total_files' || chr(9) || files, 'total_dirs' || chr(9) || 0, 'total_bytes' || chr(9) || size, 'total_tokens_est' || chr(9) || tokens]) FROM n
  {prefer}
  UNION ALL SELECT 3, 6, 'stopped_early' || chr(9) || 'limit' || chr(9) || 'more matches may exist' FROM n WHERE files = {limit}
  UNION ALL SELECT 3, 7, 'pruned_hidden' || chr(9) || count(*) || chr(9) || 'dot-names skipped by wildcards; use -a to include' FROM docs WHERE path LIKE 'src1%' AND NOT {VISIBLE} HAVING count(*) > 0
  UNION ALL SELECT 4, row_number() OVER (ORDER BY count(*) DESC, kind), 'kind_' || kind || chr(9) || count(*) FROM t GROUP BY kind)""",
    )


_add("sif_document", _document(20), _document_sql(20, "", "path"))
_add("sif_document_recent", _document(15, prefer="recent"), _document_sql(15, "modified DESC NULLS LAST, ", "modified desc", " || chr(9) || strftime(modified, '%Y-%m-%dT%H:%M:%SZ')", "UNION ALL SELECT 3, 5, 'prefer' || chr(9) || 'recent'"))


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of all files under a cap: how many records it shows, and whether it keeps the cap."""
    said = query.Options(["**"])
    found = query.run(spark, said, catalog=_docs(spark, sf_dir))
    text = document.build(found, said, cap=1_000).fitted()
    lost = next(x for x in text.split("\n") if x.startswith("#truncated"))
    shown = sum(not x.startswith("#") for x in text.split("\n")[:-1])
    return spark.createDataFrame([(document.tokens_of(text) <= 1_000, shown, int(lost.split("dropped=")[1].split(" ")[0]))], "within boolean, shown bigint, dropped bigint")


_add("sif_document_cap", _capped, _sql(f""" SELECT true AS within, max(p) FILTER (ok) AS shown, count(*) - max(p) FILTER (ok) AS dropped
  FROM (SELECT p, total - p AS lost, (head + length('#truncated reason=output_budget dropped=' || (total - p) || ' budget=1000 recover="--max-output-tokens unlimited"') + 1 + b) * 2 <= 7000 AS ok
    FROM (SELECT row_number() OVER w AS p, sum(octet_length(encode(path || size || kind || tokens_est)) + 10) OVER (w ROWS UNBOUNDED PRECEDING) AS b, count(*) OVER () AS total,
      length('#!sif v1#context File listing produced by filescope#schema path:str:path size:uint kind:enum({','.join(paths.KINDS)}) tokens_est:uint is_dir:bool#sort path') + 4 AS head
      FROM docs WHERE {VISIBLE} WINDOW w AS (ORDER BY string_split(path, '/'))))"""))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return S | {"preview_code": _CODE}
