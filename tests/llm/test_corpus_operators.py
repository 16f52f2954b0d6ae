"""Sharding, joins, dedup, search, extraction and the pipeline against plain versions."""

import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from filescope.llm import decontaminate, html_dom, jaccard, neighbours, queries, sharding, suffix_dedup, wrapper
from filescope.llm.components import components

DIR, SMOKE = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_shards_take_only_into_the_new_one(spark):
    df = spark.range(4000).select(F.col("id").alias("k"))
    got = sharding.shard(df, "k", [1.0] * 9).collect()
    more = {r["k"]: r["shard"] for r in sharding.shard(df, "k", [1.0] * 10).collect()}
    assert all(more[r["k"]] == r["grown_shard"] and r["grown_shard"] in (r["shard"], 9) for r in got)
    sizes = np.bincount([r["shard"] for r in got], minlength=9)
    assert sizes.min() > 340 and sizes.max() < 550
    heavy = np.bincount([r["shard"] for r in sharding.shard(df, "k", [1.0, 3.0]).collect()])
    assert 2.6 < heavy[1] / heavy[0] < 3.4
    with pytest.raises(ValueError, match="weights"):
        sharding.shard(df, "k", [])


def test_slots_have_no_gaps(spark):
    df = docs(spark, [(i % 50, "x") for i in range(300)] + [(None, None)] * 5).select(F.col("doc_id").alias("k"), "text")
    got = sharding.slotted(sharding.shard(df, "k", [1.0] * 4), "k").collect()
    assert len(got) == 305
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.slotted(sharding.shard(df.limit(0), "k", [1.0]), "k").count() == 0


@data
def test_shards_of_documents(spark):
    got = sharding.op1_rendezvous_sharding(spark, SMOKE).collect()
    import zlib

    want = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {k: (len(b) + 16, zlib.crc32(b)) for k, b in want.items()}


@data
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    a, b = queries.queries()[name](spark, DIR).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert (a == b).all().all()


def test_contamination_by_items_without_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(12)), " ".join(f"b{i}" for i in range(12))
    rows, items = [(1, f"x {a} y"), (2, f"{a} {b}"), (3, "nothing here"), (4, b)], [(None, a), (7, b), (None, b)]
    got = decontaminate.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({decontaminate.OP2_SQL})").fetchall())
    assert sorted(tuple(r[c] for c in names) for r in got) == want
    assert [r[2:4] for r in want] == [(12, 0), (24, 1), (0, 0), (12, 1)]


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)]
    up = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: v for x, v in up.items() if x in got} and set(up) - set(got) <= {a for a, b in edges if a == b}


def test_jaccard_classes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = random.Random(7)
    base = [[f"w{rng.randrange(500)}" for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 8])):
            w[rng.randrange(len(w))] = f"n{i}"
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, "a b"), (103, "A, b!"), (None, "a b"), (5, "other text of five words")]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (re.findall(r"[a-z0-9]+", (t or "").lower()) for _, t in rows)]
    link = lambda x, y: bool(x and y) and 5 * len(x & y) >= 4 * len(x | y)
    n = [sum(i != j and link(x, y) for j, y in enumerate(sets)) for i, x in enumerate(sets)]
    up = list(range(len(rows)))
    for _ in range(len(rows)):
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if link(x, y):
                    up[i] = up[j] = min(up[i], up[j])
    key = lambda k: -(2**63) if k is None else k
    least = {u: min(key(rows[i][0]) for i in range(len(rows)) if up[i] == u) for u in up}
    want = sorted((key(k), least[up[i]], n[i]) for i, (k, _) in enumerate(rows))
    got = jaccard.join(docs(spark, rows)).collect()
    assert sorted((key(r["doc_id"]), key(r["class_id"]), r["n_links"]) for r in got) == want
    assert jaccard.join(docs(spark, [])).count() == 0
    assert 1 - (1 - 0.8**jaccard.ROWS) ** jaccard.bands_for() >= jaccard.RECALL


def test_jaccard_large_group(spark, monkeypatch):
    """3,000 near copies of one text in six blocks and as one: every link counts, and edges do not grow with pairs of texts."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(3000):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    names = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(rows), len(names)), np.float32)
    for i, g in enumerate(sets):
        m[i, [names[x] for x in g]] = 1
    both = m @ m.T
    size = m.sum(1)
    linked = 5 * both >= 4 * (size[:, None] + size[None, :] - both)
    want = dict(enumerate((linked.sum(1) - 1).tolist()))
    seen = []
    plain = jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda edges: seen.append(edges.count()) or plain(edges))
    for block in (500, 2048):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        seen.clear()
        got = jaccard.join(docs(spark, rows)).collect()
        found = {r["doc_id"]: r["n_links"] for r in got}
        assert {r["class_id"] for r in got} == {0} and all(found[i] <= n for i, n in want.items())
        assert sum(found.values()) >= jaccard.RECALL * sum(want.values())  # of 3.7 million pairs banding may miss a few at just 0.8
        assert len(seen) == (2 if block == 500 else 1) and sum(seen) < 20 * len(rows), seen
        assert block != 500 or seen[1] < 18 * 6 * 5, seen


def plain_removed(texts):
    """Bytes covered by 100-byte strings that start earlier, by document in order."""
    seen, out = set(), []
    for b in texts:
        hit = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                hit[s : s + 100] = True
            seen.add(b[s : s + 100])
        out.append(hit)
    return out


def test_cover():
    assert {(a - b) % suffix_dedup.V for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.V))


@pytest.mark.parametrize(("hot", "piece"), [(1000, 1 << 20), (2, 300)])
def test_dedup(spark, monkeypatch, hot, piece):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rng = random.Random(8)
    para = lambda n: " ".join(rng.choice(["the", "of", "er", "thin", "ou", "é", "a", "retion"]) for _ in range(n))
    base = [para(60) for _ in range(5)] + ["a" * 333, "ab" * 150, "x" * 60 + "\n"]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            at = rng.randrange(len(b))
            parts.append(b if rng.random() < 0.4 else b[:at] + rng.choice(["", "Q", "é"]) + b[at + rng.randint(0, 2) :])
        rows.append((i, "".join(parts)))
    rows += [(50, None), (51, ""), (52, "q" * 99), (53, "q" * 100), (None, base[0]), (7, base[5]), (7, base[5])]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for (k, t), hit in zip(ordered, plain_removed([(t or "").encode() for _, t in ordered]), strict=True):
        b = (t or "").encode()
        want.append((str(k), len(b), int(hit.sum()), np.frombuffer(b, np.uint8)[~hit].tobytes()))
    clean, changed = suffix_dedup.dedup(docs(spark, rows))
    got = [(str(r["doc_id"]), len(r["text"].encode()), 0, r["text"].encode()) for r in clean.collect()]
    for r in changed.collect():
        got.append((str(r["doc_id"]), len(r["text"].encode()), sum(s["end"] - s["begin"] for s in r["removed"]), bytes(r["kept"])))
    assert sorted(got) == sorted(want)
    clean, changed = suffix_dedup.dedup(docs(spark, []))
    assert clean.count() == changed.count() == 0


@data
def test_dedup_documents(spark):
    got = {r["doc_id"]: r for r in suffix_dedup.op10_suffix_dedup(spark, SMOKE).collect()}
    rows = sorted((r["doc_id"], r["text"].encode()) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect())
    for (k, b), hit in zip(rows, plain_removed([b for _, b in rows]), strict=True):
        spans = int((np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])) == 1).sum())
        want = (len(b), int(hit.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~hit].tobytes()).hexdigest())
        assert tuple(got[k][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want


@data
def test_search_recall(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got: dict = {}
    for r in neighbours.op3_collision_counting(spark, DIR).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    recall = []
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        recall.append(len(best & {v for v, _ in found}) / 20)
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(abs(score - s[ids == v][0]) < 1e-9 for v, score in found)
    assert np.mean(recall) >= 0.9


def test_search_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (20, [0.5, 0.5]), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1.0), (0, 7, 1.0), (0, 20, 0.5), (20, 0, 0.5), (20, 1, 0.5), (20, 7, 0.5)]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


class Scored(np.ndarray):
    """Vectors that count how many of them are multiplied with a query."""

    rows = 0

    def __matmul__(self, q):
        Scored.rows += len(self)
        return np.asarray(self) @ q


def test_windows_count_what_they_gain():
    """Opened and widened windows hold what a plain count says, and widening reads the gained entries only."""
    rng = np.random.default_rng(6)
    index = neighbours.SortedArrays(np.arange(900), rng.normal(size=(900, 12)))
    place = np.empty_like(index.values)
    np.put_along_axis(place, index.by, index.values, 1)
    read = []
    plain = index._counted
    index._counted = lambda spans: read.append(sum(max(0, y - x) for _, x, y in spans)) or plain(spans)
    for _ in range(20):
        at = rng.normal(size=(1, neighbours.PROJECTIONS))
        counts, ends = None, None
        for r in (0.05, 0.3, 0.31, 0.9, 2.5):
            new = [e[0] for e in index._ends(at, np.array([r]))]
            read.clear()
            if counts is None:
                counts = index.opened(*new)
            else:
                index.widened(counts, *ends, *new)
                assert read == [int((new[1] - new[0]).sum() - (ends[1] - ends[0]).sum())]
            ends = new
            want = (np.abs(place - at[0][:, None]) <= neighbours.TAU * r).sum(0)
            assert counts.tolist() == want.tolist()


@pytest.mark.parametrize("grow", [False, True])
def test_search_scores_candidates_only(grow):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 4000)] + 0.2 * rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = neighbours.SortedArrays(np.arange(4000), x)
    index.flat = index.flat.view(Scored)
    asked = np.arange(0, 4000, 400)
    reach = np.full(len(asked), 0.999) if grow else neighbours.guessed(x[asked], x[1:4000:20], 10, 4000)
    Scored.rows = 0
    for q, ids, scores, _ in index.search(asked, x[asked], reach, 10, grow):
        want = x @ x[q]
        want[q] = -np.inf
        best = np.lexsort((np.arange(4000), -want))[:10]
        assert len(set(ids) & set(best)) >= 9 and np.allclose(scores, want[ids])
    assert Scored.rows < 4000 * len(asked) / 4


def test_search_of_many_copies_in_blocks(spark, monkeypatch):
    """A vector that a third of the rows share, longer and shorter ones, several blocks and a bad sample: the exact neighbours."""
    monkeypatch.setattr(neighbours, "NUMBERS", 100)
    monkeypatch.setattr(neighbours, "LEAST_BLOCK", 100)
    monkeypatch.setattr(neighbours, "SAMPLE", 30)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 8)) * rng.uniform(0.5, 2, (600, 1))
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    same = 0
    for q, ids in got.items():
        s = np.array([sum(a * b for a, b in zip(v, x[q], strict=True)) for v in x])
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:7].tolist()
        same += len(set(best) & set(ids))
        assert len(ids) == 7 and (q % 3 or ids == best)
    assert len(got) == 30 and same >= 0.97 * 210


PAGE = """<!doctype html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body class=x>
<header><a href=/>Site</a></header><nav><ul><li>{nav}<li>b</ul></nav><div class="content-wrap"><div class="side-bar">{nav} links</div>
<div id=main-text><h1>{title} &amp; &#233;</h1><p>First <b>bold{i}<br>line<p>Second&nbsp;para {i}</p><div class="ad-box ad">Buy {i}</div><ul><li>one {i}</li><li>two</ul>
<div class="note">Subscribe to our letter now</div></div></div><form><input>go {i}</form><div class="comments">me: {i}</div><footer>&copy; {i}</footer></body></html>"""


def test_extraction(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i=i, nav=f"n{i}", title=f"T{i}")) for i in range(12)]
    rows += [(100, "http://one.example/", "<p>a&amp;b <b>c</b>\n d<p>e<br>f"), (101, None, None), (102, "x", ""), (None, "http://h.example/9", "plain &lt; text"), (103, "http://a.example/", "<article><h1>H</h1><aside>x</aside><p>P</article><p>out")]
    got = {r["page_id"]: r for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == "T3 & é\n\nFirst bold3 line\n\nSecond para 3\n\none 3\n\ntwo"  # what all pages say inside the slot is template
    assert (got[100]["text"], got[101]["text"], got[102]["text"], got[None]["text"]) == ("a&b c d\n\ne f", "", "", "plain < text")
    assert got[103]["text"] == "H\n\nP" and got[103]["n_chars"] == 4
    assert wrapper.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_in_many_partitions_make_no_template(spark):
    page = "<body><nav>n</nav><article><h1>{}</h1><div><p>{}</p></div></article></body>"
    rows = [(i, "http://c.example/", page.format("Title", "The only paragraph")) for i in range(64)]
    rows += [(100 + i, "http://c.example/", page.format(f"T{i}", f"Other {i}")) for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n in (1, 16):
        got = {r["page_id"]: r["text"] for r in wrapper.extract_pages(df.repartition(n, "page_id")).collect()}
        assert {got[i] for i in range(64)} == {"Title\n\nThe only paragraph"}
        assert all(got[100 + i] == f"T{i}\n\nOther {i}" for i in range(2))


def test_pages_without_an_article_keep_all_that_varies(spark):
    long = "body {} " * 30
    page = "<body><div class=top>Our site</div><div class=lead>Lead {i}</div><h1>{title}</h1><div class=wrap>Welcome<div class=post><p>{text}</p><p>More {i}</p></div></div><div class=tail>Tail {i}</div></body>"
    rows = [(i, "http://d.example/", page.format(i=i, title=f"T{i}", text=long.format(*[i] * 30))) for i in range(10)]
    other = "<body><h1>{}</h1><div class=post><p>{}</p></div></body>"  # a title that most pages share, not all
    rows += [(100 + i, "http://e.example/", other.format("Notes" if i else "One of its own", long.format(*[i] * 30))) for i in range(20)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(10):
        assert got[i] == f"Lead {i}\n\nT{i}\n\n{long.format(*[i] * 30).strip()}\n\nMore {i}\n\nTail {i}"
    assert got[100].startswith("One of its own\n\nbody 0") and got[101].startswith("body 1")


def test_captions_fallbacks_and_headings_of_an_article_stay():
    page = """<article><h2 id="related-work">Related work</h2><h2><span id=Search>Search</span></h2><p id="copyright">On <a id=related>copies</a><h3 class="share-this">share</h3>
<figure><img><figcaption>A caption</figcaption></figure><object>An object</object><video>A film</video><audio>A sound</audio><map>A map</map><fieldset>A set</fieldset>
<p class="ad" id=x>buy<div id="comments">me</div><section id="related-posts">more</section></article>"""
    text = wrapper.extract(html_dom.parse(page), {"path": ["article"], "const": []})
    assert text == "\n\n".join(["Related work", "Search", "On copies", "A caption", "An object", "A film", "A sound", "A map", "A set"])


HOST = """<html><body><div class="top"><a href=/>Our site</a></div><nav><a href=/a>N {i}</a></nav><div class="teaser">Tip {i}</div>{open}<h1>Title {i}</h1>
<p>Body {i}: shares cost <span class="share-price">{i} dollars</span> and <b id="comments">more</b>.</p><div class='related-work'>Earlier work {i}</div>
<figure><img><figcaption>Figure {i}</figcaption></figure>{extra}<div class="share-tools"><a href=/s>Post {i}</a> <a href=/t>Mail {i}</a></div>
<div class="comments">Reader {i} says no</div><div class="note">The same note on every page</div>{close}<footer>About {i}</footer></body></html>"""


def hosted(n, tag, start=0):
    return [(start + i, f"http://h{start}.example/{i}", HOST.format(i=start + i, open=f"<{tag}>", close=f"</{tag.split()[0]}>", extra=f"<div class='notes-menu'>Point {i}</div>" if i == 2 else "")) for i in range(n)]


def said(i, *more):
    return "\n\n".join([f"Title {i}", f"Body {i}: shares cost {i} dollars and more.", f"Earlier work {i}", f"Figure {i}", *more])


def test_words_of_an_article_stay(spark):
    """Names count as parts of words only where pages align on a list of links; inline elements are text; what all say goes."""
    rows = hosted(8, "article") + hosted(3, "article", 100) + hosted(1, "main", 200)
    got = {r["page_id"]: r["text"] for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i] == said(i, *(["Point 2"] if i == 2 else []))
    for i in (100, 101, 102, 200):  # too few pages to align: no template, and no list of links is known as one
        assert got[i] == said(i, *(["Point 2"] if i == 102 else []), f"Post {i} Mail {i}", "The same note on every page")


def test_slot_without_an_article(spark):
    """A <div> that holds the article is found by alignment, and a host with too few pages says all that has no name of noise."""
    rows = [(i, u, h.replace('<div class="teaser">', '<div class="promo-teaser">')) for i, u, h in hosted(9, "div id=story") + hosted(2, "div id=story", 50)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    outer = lambda i, *more: "\n\n".join([f"Title {i}", f"Body {i}: shares cost {i} dollars and more.", f"Figure {i}", *more])
    for i in range(9):  # children of a slot that is no article lose what has a name of noise
        assert got[i] == outer(i)
    for i in (50, 51):
        assert got[i] == "\n\n".join(["Our site", said(i), f"Post {i} Mail {i}", "The same note on every page"])


def test_alignment_comes_before_tags(spark):
    """An <article> on one page of ten does not make it the slot of the host; on most it does, whatever stands beside it."""
    page = "<body><div class=lead>Lead {i}</div><div class=text><p>Words {i}</p>{more}</div></body>"
    rows = [(i, "http://t.example/", page.format(i=i, more="<article>Aside</article>" if i == 0 else "")) for i in range(10)]
    rows += [(100 + i, "http://u.example/", f"<body><div class=lead>Lead {i}</div><article><p>Words {i}</p></article></body>") for i in range(10)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "Lead 0\n\nWords 0\n\nAside" and got[3] == "Lead 3\n\nWords 3" and got[103] == "Words 3"


@pytest.mark.parametrize("unit", ["<a b ", "<a x='", '<a x="', "<a x='>'", "<a x='y' ", "<!", "<!--", "<![CDATA[", "<div>", "</x>", "<p><b>", "<li><i>", "<", "<i></div>", "<b><div></b>", "<script>", "&amp", "<td><table><i><tr></tr>"])
def test_parser_is_linear(unit):
    import time

    for end in ("", ">", "'>", '">x'):
        page = unit * (100_000 // len(unit)) + end
        began = time.time()
        wrapper.extract(html_dom.parse(page), {"path": [], "const": []})
        assert time.time() - began < 3


def test_quotes_of_attributes():
    text = lambda page: wrapper.extract(html_dom.parse(page), {"path": [], "const": []})
    assert text("<p title='a > b'>x<p data-x=it's>y<p title = \"c>d\" class=ad>z") == "x\n\ny"
    assert text("<p title='never closed>x</p><p>y") == "x\n\ny"
    assert text("a < b <3 <p>c</p> d <") == "a < b <3\n\nc\n\nd <"
    assert html_dom.parse('<div title="x class=ad" CLASS=\'One two\' id=n>').children[0].mark == "one two n"


def test_parser_never_fails():
    rng = random.Random(9)
    for _ in range(2000):
        text = "".join(rng.choice(["<p>", "</p>", "<div class='a'>", "</div>", "<b>", "</b>", "x", " & ", "<", ">", "<!--", "-->", "<script>", "</script>", "<li>", "</ul>", "<br/>", "&amp"]) for _ in range(rng.randint(0, 15)))
        wrapper.extract(html_dom.parse(text), {"path": [], "const": []})


def test_wide_pages():
    import time

    began = time.time()
    pages = [html_dom.parse("<main>" + "".join(f"<div class=k{chr(97 + (i * j) % 23)}{'x' * (i % 40)}>t{i}</div><p>q" for i in range(4000))) for j in (1, 2, 3)]
    w = wrapper.merge(wrapper.merge(*map(wrapper.as_wrapper, pages[:2])), wrapper.as_wrapper(pages[2]))
    assert wrapper.extract(pages[0], wrapper.rules(w)).startswith("t0\n\nq\n\nt1") and time.time() - began < 20


def test_deep_pages(spark):
    deep = "<div>" * 5000 + "<p>a</p>" + "<b>" * 3000 + "b" + "</div>" * 5000 + "<p>c"
    rows = [(i, "http://d.example/", deep + str(i)) for i in range(3)]
    assert {r["text"] for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {f"a\n\nb\n\nc{i}" for i in range(3)}


@data
def test_extraction_of_pages(spark):
    import html as h

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMOKE}/pages.parquet").collect()}
    for r in wrapper.op4_html_wrapper(spark, SMOKE).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


@data
def test_pipeline(spark):
    import corpus_pipeline as cp
    from filescope.llm.common import stored, table

    assert [n for n, _ in cp.STAGES] == ["toxicity", "ngram_jaccard", "suffix_dedup", "decontaminate", "bpe"]
    start = at = table(spark, SMOKE, "documents")
    outs = []
    for name, stage in cp.STAGES:
        at = stored(stage(spark, at, SMOKE), name)
        outs.append(at)
    assert all(o.columns == start.columns for o in outs[:-1])
    counts = [o.count() for o in outs]
    assert counts[0] > 0.8 * start.count() and counts == sorted(counts, reverse=True) and counts[3] == counts[4]
    one = jaccard.join(outs[1]).filter("n_links > 0")
    assert one.isEmpty(), "no near copies are left"
    rows = sorted((r["doc_id"], r["text"].encode()) for r in outs[1].collect())
    want = {k: np.frombuffer(b, np.uint8)[~hit].tobytes().decode("utf-8", "ignore") for (k, b), hit in zip(rows, plain_removed([b for _, b in rows]), strict=True)}
    assert {r["doc_id"]: r["text"] for r in outs[2].collect()} == want
    assert decontaminate.contamination(outs[3], table(spark, SMOKE, "benchmark")).filter("contaminated").isEmpty()
    assert cp.run(spark, SMOKE).count() == counts[-1]
    empty = start.limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, SMOKE)
    assert empty.count() == 0
