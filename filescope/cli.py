"""Command line: `python -m filescope.cli [options] PATTERN...`, `match PATTERN [TEXT...]`, `expand PATTERN`."""

from __future__ import annotations

import argparse
import re
import sys
import time

from filescope.functions.patterns import GlobError, Pattern, try_expand

KINDS = "source, test, config, build, doc, data, generated, binary, unknown"


def size(text: str) -> int:
    """500, 80K, 1.5M, 2G: decimal multiples, rounded."""
    m = re.fullmatch(r"\s*([0-9]*\.?[0-9]*(?:[eE][+-]?[0-9]+)?)([KkMmGg]?)\s*", text)
    try:
        x = float(m[1]) if m and m[1] else None
    except ValueError:
        x = None
    if x is None:
        raise GlobError(f"invalid size: {text!r} (examples: 500, 80K, 1.5M, 2G)")
    factor = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9}[m[2].lower()]
    out = int(m[1]) * factor if m[1].isdigit() else int(x * factor + 0.5)
    if out >= 1 << 64:
        raise GlobError(f"invalid size: {text!r}")
    return out


def _positive(parse):
    def run(text: str) -> int | None:
        if text == "unlimited":
            return None
        n = parse(text)
        if n <= 0:
            raise GlobError("must be at least 1 (use `unlimited` for none)")
        return n

    return run


def _count(text: str) -> int:
    if not text.isdigit():
        raise GlobError(f"expected a positive number or `unlimited`, got {text!r}")
    return int(text)


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise GlobError(message)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="filescope", allow_abbrev=False, description=__doc__)
    p.add_argument("patterns", nargs="*")
    p.add_argument("-p", "--paths", action="store_true", help="plain paths, exact bytes")
    p.add_argument("-s", "--sif", dest="paths", action="store_false", help="a document (the default)")
    p.add_argument("-S", "--summary", action="store_true")
    p.add_argument("-P", "--preview", help="N, N-M or code:N lines of each file")
    p.add_argument("-a", "--hidden", action="store_true", help="wildcards match dot-names")
    p.add_argument("-d", "--dirs", action="store_true")
    p.add_argument("-L", "--follow", action="store_true", help="enter symbolic links to directories")
    p.add_argument("-e", "--exclude", action="append", default=[])
    p.add_argument("-g", "--gitignore", action="store_true")
    p.add_argument("--git-files", action="store_true", help="what git lists")
    p.add_argument("--skip-nested-repos", action="store_true")
    p.add_argument("-G", "--git-changed", nargs="?", const="HEAD", metavar="REF")
    p.add_argument("-r", "--root", default="")
    p.add_argument("--depth", type=str)
    p.add_argument("-n", "--limit", type=str)
    p.add_argument("-t", "--content-budget", "--token-budget", dest="tokens", type=str)
    p.add_argument("--byte-budget", dest="bytes", type=str)
    p.add_argument("--fit", action="store_true", help="pass over what does not fit")
    p.add_argument("--prefer", choices=["path", "size", "size-asc", "recent"])
    p.add_argument("--prefer-from", metavar="FILE", help="a ranking, - for standard input")
    p.add_argument("--max-output-tokens", type=str)
    p.add_argument("--skipped", default="50", help="rows of skipped entries, none or unlimited")
    p.add_argument("-k", "--kind", action="append", default=[], help=KINDS)
    p.add_argument("--no-sort", action="store_true")
    p.add_argument("--no-stat", action="store_true")
    return p


def _glob(argv: list[str]) -> int:
    began = time.monotonic()
    # -G takes the next word as its ref unless that is a flag or looks like a pattern
    for i, a in enumerate(argv):
        if a in ("-G", "--git-changed") and (i + 1 == len(argv) or argv[i + 1].startswith("-") or re.search(r"[*?\[]", argv[i + 1])):
            argv[i] = "--git-changed=HEAD"
    a = parser().parse_intermixed_args(argv) if "--" not in argv else parser().parse_args(argv)
    from filescope.functions.previews import Preview
    from filescope.plans import document, query

    if a.prefer and a.prefer_from:
        raise GlobError("use either --prefer or --prefer-from, not both")
    number = lambda f, x: None if x is None else _positive(f)(x)
    ranking = None
    if a.prefer_from:
        try:
            ranking = sys.stdin.read() if a.prefer_from == "-" else open(a.prefer_from, encoding="utf-8").read()
        except OSError as e:
            raise RuntimeError(f"reading {a.prefer_from}: {e.strerror}") from None
    options = query.Options(
        a.patterns, hidden=a.hidden, only_dirs=a.dirs, kinds=[k.strip() for x in a.kind for k in x.split(",")], max_depth=number(_count, a.depth), exclude=a.exclude,
        gitignore=a.gitignore, follow=a.follow, skip_nested_repos=a.skip_nested_repos, git_files=a.git_files, git_changed=a.git_changed,
        root="" if a.root in (".", "./") else a.root, limit=number(_count, a.limit), token_budget=number(size, a.tokens), byte_budget=number(size, a.bytes),
        fit=a.fit, prefer=a.prefer or "path", ranking=ranking, no_stat=a.no_stat, sort=not a.no_sort,
    )
    options.check()
    preview = Preview.parse(a.preview) if a.preview else None
    rows = 0 if a.skipped == "none" else _positive(_count)(a.skipped)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = query.run(spark, options)
    unread = found.errors.count()
    if unread:
        first = found.errors.orderBy("path").select("path", "message").first()
        more = f" (and {unread - 1} more)" if unread > 1 else ""
        print(f"warning: skipped unreadable directory: {first['path']}: {first['message']}{more}", file=sys.stderr)
    if not a.paths:
        cap = 25_000 if a.max_output_tokens is None else _positive(size)(a.max_output_tokens)
        source = "stdin" if a.prefer_from == "-" else a.prefer_from or "scores"
        sys.stdout.write(document.build(found, options, a.summary, preview, rows, cap, source, began).fitted())
        return 0
    for name, said in (("summary", a.summary), ("preview", a.preview)):
        if said:
            print(f"warning: --{name} has no effect with --paths", file=sys.stderr)
    return _print_paths(found, options, number(size, a.max_output_tokens))


def _print_paths(found, options, cap: int | None) -> int:
    from pyspark.sql import functions as F

    if options.fit:
        lost = found.skipped.agg(F.count(F.lit(1)), F.max_by("path", "tokens_est"), F.max("tokens_est")).first()
        if lost[0]:
            print(f"note: --fit left out {lost[0]} matching file(s) over budget, largest: {lost[1]} (~{lost[2]} tokens)", file=sys.stderr)
    gone = [r["path"] for r in found.deleted.orderBy("path").collect()]
    if gone:
        more = f" (and {len(gone) - 5} more)" if len(gone) > 5 else ""
        print(f"note: {len(gone)} matching file(s) changed since {options.git_changed} were deleted: {', '.join(gone[:5])}{more}", file=sys.stderr)
    listed = found.entries.select("path_bytes")
    sys.stdout.flush()
    if cap is None:
        for r in listed.toLocalIterator(prefetchPartitions=True):
            sys.stdout.buffer.write(bytes(r["path_bytes"]) + b"\n")
        sys.stdout.flush()
        return 0
    most = cap * 7 // 2
    lines = [bytes(r["path_bytes"]) + b"\n" for r in listed.limit(most // 2 + 1).collect()]  # a line has two bytes at least
    total, shown = 0, 0
    while shown < len(lines) and (total := total + len(lines[shown])) <= most:
        shown += 1
    if shown < len(lines):
        print(f"note: output truncated to {shown} of {found.entries.count()} paths by --max-output-tokens {cap}; use --max-output-tokens unlimited", file=sys.stderr)
    sys.stdout.buffer.write(b"".join(lines[:shown]))
    sys.stdout.flush()
    return 0


def _match(argv: list[str]) -> int:
    from filescope.functions.matching import MatchOptions, matches

    p = _Parser(prog="filescope match", allow_abbrev=False)
    p.add_argument("-i", "--ignore-case", action="store_true")
    p.add_argument("--pathname", action="store_true")
    p.add_argument("pattern")
    p.add_argument("texts", nargs="*")
    a = p.parse_args(argv)
    pattern, o = Pattern.parse(a.pattern), MatchOptions(not a.ignore_case, a.pathname)
    hits = [t for t in a.texts or sys.stdin.read().splitlines() if matches(pattern, t, o)]
    print(*hits, sep="\n", end="\n" if hits else "")
    return 0 if hits else 1


def main(argv: list[str] | None = None) -> int:
    """0 if all went well, also without a match; 1 if a run failed or `match` found nothing; 2 for what cannot be asked for."""
    argv = list(sys.argv[1:] if argv is None else argv)
    try:
        if argv[:1] == ["match"]:
            return _match(argv[1:])
        if argv[:1] == ["expand"]:
            if len(argv) != 2:
                raise GlobError("expand requires a pattern")
            print(*try_expand(argv[1]), sep="\n")
            return 0
        if not argv:
            parser().print_help()
            return 0
        return _glob(argv)
    except GlobError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1 if type(e).__name__ == "GitError" else 2
    except RuntimeError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
