"""A report as a text document of tab-separated sections, cut to a number of estimated tokens where asked for."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescope.functions import paths, previews
from filescope.plans import report as accounts
from filescope.plans.query import Options, Report
from filescope.session import ship

#: Fixed values of the format.
KIND_TYPE = f"enum({','.join(paths.KINDS)})"
SORTS = {"path": "path", "size": "size desc", "size-asc": "size asc", "recent": "modified desc", "scores": "score desc"}
EXTRA = {"recent": " modified:datetime?", "scores": " score:float?"}
RECOVER = 'recover="--max-output-tokens unlimited"'
LEFT_OUT = (
    ("pruned_hidden", "dot-names skipped by wildcards; use -a to include"),
    ("pruned_gitignore", "matched a gitignore rule; drop -g to include"),
    ("pruned_exclude", "matched an -e pattern"),
    ("pruned_nested_repos", "nested repositories not entered; drop --skip-nested-repos"),
    ("pruned_symlink_dirs", "symlinked directories not entered; use -L to follow"),
    ("filtered_kind", "matches of other kinds, dropped by -k"),
    ("filtered_git_changed", "matches unchanged since the -G ref"),
    ("unreadable_dirs", "directories that could not be read"),
    ("preview_skipped_binary", "binary files are not previewed"),
    ("git_deleted", "changed since the -G ref but deleted; listed in §deleted"),
    ("non_utf8_names", "paths that aren't UTF-8, shown with U+FFFD here; -p prints the exact bytes"),
)
LEAST_LINES = 3
#: Bytes that a record line has at least: a name, a kind, a flag, what is between and its end.
LEAST_RECORD = 10


def tokens_of(text: str) -> int:
    return -(-len(text.encode()) * 2 // 7)


def least(low: int, high: int, fits: Callable[[int], bool]) -> int:
    """The least number from low to high that fits, or high: fits only turns true once."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@dataclass(frozen=True)
class Block:
    path: str
    language: str | None
    start: int
    lines: tuple[str, ...]

    def text(self, most: int | None = None) -> str:
        shown = self.lines[:most]
        lang = f" language={self.language}" if self.language else ""
        return f"#block code{lang} file={self.path} lines={self.start}-{self.start + len(shown) - 1}\n" + "".join(f"{x}\n" for x in shown) + "#/block\n"


@dataclass(frozen=True)
class Cuts:
    records: int = 0
    skipped: int = 0
    lines: int | None = None
    blocks: int = 0


@dataclass
class Document:
    """All parts as lines; text() joins what the cuts leave."""

    stat: bool = True
    order: str | None = "path"
    limit: int | None = None
    stopped: str | None = None
    records: list[str] = field(default_factory=list)
    summary: list[tuple[str, ...]] | None = None
    kinds: list[tuple[str, ...]] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    skipped_total: int = 0
    show_skipped: bool = True
    deleted: list[str] = field(default_factory=list)
    since: str = "the ref"
    blocks: list[Block] | None = None
    binaries: int = 0
    cap: int | None = None
    #: Records, excerpts and skipped rows that are over the cap in any case and were never read.
    beyond: int = 0
    blocks_beyond: int = 0
    lines_beyond: int = 0
    skipped_beyond: int = 0

    def _lost(self, n: int, more: str = "") -> list[str]:
        return [f"#truncated reason=output_budget{more} dropped={n} budget={self.cap or 0} {RECOVER}"]

    def text(self, cuts: Cuts = Cuts()) -> str:  # noqa: B008
        size, est = (" size:uint", " tokens_est:uint") if self.stat else ("", "")
        out = ["#!sif v1", "#context File listing produced by filescope", f"#schema path:str:path{size} kind:{KIND_TYPE}{est} is_dir:bool{EXTRA.get(self.order, '')}"]
        out += [f"#sort {SORTS[self.order]}"] if self.order else []
        out += [f"#limit {self.limit}"] if self.limit is not None else []
        out += [f"#truncated reason={self.stopped}"] if self.stopped else []
        out += self._lost(cuts.records + self.beyond) if cuts.records else []
        out += self.records[: len(self.records) - cuts.records]
        if self.summary is not None:
            cut = [n for n, on in (("records", cuts.records), ("skipped", cuts.skipped), ("preview", cuts.lines is not None or cuts.blocks or self.blocks_beyond)) if on]
            note = [("output_truncated", ",".join(cut), f"output capped at --max-output-tokens {self.cap}; use --max-output-tokens unlimited")] if cut else []
            at = next((i for i, r in enumerate(self.summary) if r[0] in {k for k, _ in LEFT_OUT}), len(self.summary))
            out += ["---", "§summary", "#schema key:str:id value:str note:str?", *("\t".join(r) for r in [*self.summary[:at], *note, *self.summary[at:], *self.kinds])]
        if self.skipped_total and self.show_skipped:
            shown = len(self.skipped) - cuts.skipped
            out += ["---", "§skipped", f"#context Matched but left out to fit the budget, largest first ({shown} of {self.skipped_total})", f"#schema path:str:path{size} kind:{KIND_TYPE}{est}", "#sort tokens_est desc"]
            asked = len(self.skipped) + self.skipped_beyond
            out += [f"#limit {asked}"] if asked < self.skipped_total else []
            out += (self._lost(cuts.skipped + self.skipped_beyond) if cuts.skipped else []) + self.skipped[:shown]
        if self.deleted:
            out += ["---", "§deleted", f"#context Changed since {self.since} but deleted from the working tree", f"#schema path:str:path kind:{KIND_TYPE}", *self.deleted]
        said = "".join(f"{x}\n" for x in out)
        if self.blocks is not None:
            head = ["---", "§preview", *([f"#context {self.binaries} binary file(s) not previewed"] if self.binaries else [])]
            if cuts.lines is not None or cuts.blocks or self.blocks_beyond:
                head += self._lost(cuts.blocks + self.blocks_beyond, f" lines_per_file={cuts.lines}" if cuts.lines is not None else "")
            said += "".join(f"{x}\n" for x in head) + "".join(b.text(cuts.lines) for b in self.blocks[: len(self.blocks) - cuts.blocks])
        return said

    def fitted(self) -> str:
        """Within the cap: excerpts get shorter, then fewer, then skipped rows go, then records."""
        fits = lambda c: self.cap is None or tokens_of(self.text(c)) <= self.cap
        cuts = Cuts()
        if fits(cuts):
            return self.text()
        if self.blocks_beyond:
            cuts = replace(cuts, lines=min(LEAST_LINES, self.lines_beyond))
        if self.blocks:
            longest = max(len(b.lines) for b in self.blocks)
            floor = min(LEAST_LINES, longest)
            less = least(0, longest - floor, lambda n: fits(replace(cuts, lines=longest - n)))
            cuts = replace(cuts, lines=longest - less)
            if fits(cuts):
                return self.text(cuts)
            cuts = replace(cuts, blocks=least(0, len(self.blocks), lambda n: fits(replace(cuts, blocks=n))))
            if cuts.blocks < len(self.blocks):
                return self.text(cuts)
        cuts = replace(cuts, skipped=least(0, len(self.skipped), lambda n: fits(replace(cuts, skipped=n))))
        if not fits(cuts):
            cuts = replace(cuts, records=least(0, len(self.records), lambda n: fits(replace(cuts, records=n))))
        return self.text(cuts)


def excerpts(entries: DataFrame, preview: previews.Preview, most: int | None = None) -> DataFrame:
    """(path, start, lines, binary) of the files of entries, read where the entries are; nothing of files that cannot be read.
    Each is read up to what is shown, and with most no further than so many bytes behind its first line shown."""
    ship(entries.sparkSession)
    base = os.fsencode(os.getcwd())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, raw, kind in zip(b["path"], b["path_bytes"], b["kind"], strict=True):
                found = None
                if kind != "binary":
                    try:
                        with open(os.path.join(base, bytes(raw)), "rb") as f:
                            found = previews.file_excerpt(f, path, preview, most)
                    except OSError:
                        continue
                if found is None or found[1]:
                    out.append((path, *(found or (None, None)), found is None))
            yield pd.DataFrame(out, columns=["path", "start", "lines", "binary"]).astype({"start": "Int32"})

    return entries.filter(~F.col("is_dir")).select("path", "path_bytes", "kind").mapInPandas(run, "path string, start int, lines array<string>, binary boolean")


def build(found: Report, options: Options, summary: bool = False, preview: previews.Preview | None = None, skipped_rows: int | None = 50, cap: int | None = 25_000, source: str = "scores", started: float | None = None) -> Document:
    """The document of a report.  Of listed rows and excerpts only what can be within the cap comes to the driver."""
    order = "scores" if options.ranking is not None else options.prefer
    extra = {"recent": lambda: paths.datetime_text(F.col("modified")), "scores": lambda: paths.number_text(F.col("score"))}.get(order)
    stat = not options.no_stat
    most = None if cap is None else cap * 7 // 2
    lined = accounts.records(found.entries, stat, extra() if extra else None)
    shown = lined.select("record", "path", paths.attribute(F.col("path")).alias("quoted"), paths.language(F.col("path")).alias("language"))
    rows = (shown if most is None else shown.limit(most // LEAST_RECORD + 1)).collect()
    total = len(rows) if most is None or len(rows) <= most // LEAST_RECORD else found.entries.count()
    left = accounts.skipped(found.skipped, skipped_rows if most is None else min(skipped_rows or most, most // LEAST_RECORD + 1)).select(F.concat_ws("\t", paths.field(F.col("path")), *([F.col("size").cast("string")] if stat else []), "kind", *([F.col("tokens_est").cast("string")] if stat else [])).alias("line"))
    fitting = options.fit and bool(options.token_budget or options.byte_budget)
    lost = found.skipped.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens_est"), F.lit(0)).alias("t"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first() if fitting else {"n": 0, "t": 0, "b": 0}
    gone = [r[0] for r in found.deleted.orderBy("path").select(F.concat_ws("\t", paths.field(F.col("path")), "kind")).collect()]
    doc = Document(stat, order if options.sort or order != "path" else None, options.limit, found.stopped_early, [r["record"] for r in rows], cap=cap, deleted=gone, since=options.git_changed or "the ref", beyond=total - len(rows))
    doc.skipped, doc.skipped_total, doc.show_skipped = [r[0] for r in left.collect()] if lost["n"] and skipped_rows != 0 else [], lost["n"], skipped_rows != 0
    doc.skipped_beyond = min(doc.skipped_total, doc.skipped_total if skipped_rows is None else skipped_rows) - len(doc.skipped)
    if preview is not None:
        read = excerpts(found.entries, preview, most)
        if doc.beyond:  # the listing alone is over the cap: of excerpts only their numbers are told
            counts = read.agg(F.count_if("binary").alias("binaries"), F.count_if(~F.col("binary")).alias("blocks"), F.coalesce(F.max(F.size("lines")), F.lit(0)).alias("lines")).first()
            doc.blocks, doc.binaries, doc.blocks_beyond, doc.lines_beyond = [], counts["binaries"], counts["blocks"], counts["lines"]
        else:
            got = {r["path"]: r for r in read.collect()}
            doc.blocks = [Block(r["quoted"], r["language"], x["start"], tuple(x["lines"])) for r in rows if (x := got.get(r["path"])) and not x["binary"]]
            doc.binaries = sum(r["binary"] for r in got.values())
    if summary:
        doc.summary, doc.kinds = _summary(found, options, order, lost, fitting, len(gone), doc.binaries, source)
        if started is not None and (took := int((time.monotonic() - started) * 1000)) > 0:
            doc.summary.append(("wall_time_ms", str(took)))
    return doc


def _summary(found: Report, options: Options, order: str, lost, fitting: bool, gone: int, binaries: int, source: str):
    t = accounts.totals(found.entries).first()
    rows: list[tuple[str, ...]] = [("total_files", t["total_files"]), ("total_dirs", t["total_dirs"])]
    if not options.no_stat:
        rows += [("total_bytes", t["total_bytes"]), ("total_tokens_est", t["total_tokens_est"])]
    for name, most, used in (("token_budget", options.token_budget, t["total_tokens_est"]), ("byte_budget", options.byte_budget, t["total_bytes"])):
        rows += [] if most is None else [(name, most), (f"{name}_remaining", max(0, most - used))]
    if order != "path":
        rows.append(("prefer", order))
    if order == "scores":
        n = found.entries.agg(F.count("score").alias("s"), F.count(F.lit(1)).alias("n")).first()
        known = len({x for x in (line.strip() for line in options.ranking.split("\n")) if x and x[0] != "#"})
        rows.append(("prefer_from", source, f"{n['s']} of {n['n']} results scored; {known} paths in the ranking"))
    if fitting:
        rows += [("budget_mode", "fit"), ("budget_skipped_files", lost["n"]), ("budget_skipped_tokens_est", lost["t"]), ("budget_skipped_bytes", lost["b"])]
    if found.stopped_early:
        rows.append(("stopped_early", found.stopped_early, "more matches may exist"))
    said = found.counts()
    odd = found.entries.filter(F.col("path").contains("�")).count() if "path_bytes" in found.entries.columns else 0
    counts = {
        "pruned_hidden": said.get("hidden", 0), "pruned_gitignore": said.get("gitignore", 0), "pruned_exclude": said.get("exclude", 0),
        "pruned_nested_repos": found.nested_repos, "pruned_symlink_dirs": found.symlink_dirs, "filtered_kind": said.get("kind", 0),
        "filtered_git_changed": said.get("git_changed", 0), "unreadable_dirs": found.errors.count(), "preview_skipped_binary": binaries,
        "git_deleted": gone, "non_utf8_names": odd,
    }
    rows += [(key, counts[key], note) for key, note in LEFT_OUT if counts[key]]
    kinds = [(f"kind_{r['kind']}", r["n"]) for r in accounts.kinds(found.entries).collect()]
    return [tuple(map(str, r)) for r in rows], [tuple(map(str, r)) for r in kinds]
