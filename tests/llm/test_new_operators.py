"""Merkle manifest, page text and resampling against plain versions, with odd rows."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser
from math import floor, log

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import merkle, pages, resampling
from loomgraph.llm.queries import QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(nodes, fanout):
    """Root, and for each leaf the (left, right) texts on its way."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, p in zip(ways, at, strict=True):
            a = p // fanout * fanout
            way.append(("".join(nodes[a:p]), "".join(nodes[p + 1 : a + fanout])))
        at = [p // fanout for p in at]
        nodes = [sha("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
    return nodes[0], ways


def plain_manifest(rows, fanout=2):
    """Rows as (doc_id, text, lang, source, n_chars) to (id, leaf, subroot, root, way), any order."""
    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        groups[lang].append((i is not None, i or 0, sha("".join(map(encoded, (i, source, lang, n, text)))), i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([leaf for *_, leaf, _ in sorted(groups[g], key=lambda r: r[:3])], fanout) for g in names}
    root, tops = plain_tree([trees[g][0] for g in names], fanout)
    out = []
    for g, top in zip(names, tops, strict=True):
        for (*_, leaf, i), way in zip(sorted(groups[g], key=lambda r: r[:3]), trees[g][1], strict=True):
            out.append((i, leaf, trees[g][0], root, tuple(way + top)))
    return out


def odd_documents():
    rng = random.Random(5)
    rows = [(i * 3 % 211, " ".join(rng.choices("alpha beta Gamma DELTA épsilon 12 x-y".split(), k=rng.randint(0, 60))), "en" if i % 3 else rng.choice(["de", "fr", "", None]), rng.choice(["a", None, "ü"]), rng.choice([None, 5, 77])) for i in range(211)]
    rows += [(None, None, None, None, None), (None, "", "en", "", 0), (7, "same id", "en", "a", 1), rows[3], rows[3], (900, "one of its own", "zz", None, 3)]
    rows += [(901, "word " * 300_000, "en", "a", 1_500_000), (902, "\x00   𝔘 < ﬀ", "ß", "a", None)]
    return rows


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder, rows = str(tmp_path_factory.mktemp("docs")), odd_documents()
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], DOCS + ", leaf int, `row` string")  # columns of names used inside
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    items = [(0, "Alpha beta alpha beta gamma"), (1, None), (2, ""), (3, "épsilon 12 delta"), (4, "zeta")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


@pytest.mark.parametrize(("fanout", "block"), [(2, 1024), (2, 4), (3, 9), (5, 5)])
def test_manifest(spark, documents, fanout, block):
    folder, rows, _ = documents
    made = merkle.manifest(spark.read.parquet(f"{folder}/documents.parquet"), fanout=fanout, block=block)
    got = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["left"], s["right"]) for s in r["proof"])) for r in made.collect()]
    assert Counter(got) == Counter(plain_manifest(rows, fanout))


def test_op11(spark, documents):
    folder, rows, _ = documents
    got = QUERIES["op11_merkle"](spark, folder).collect()
    want = plain_manifest(rows)
    assert Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got) == Counter((*w[:4], sha("".join(a + b for a, b in w[4]))) for w in want)
    values = defaultdict(list)
    for i, text, lang, source, n in rows:
        values[sha("".join(map(encoded, (i, source, lang, n, text))))] = (i, text, lang, source, n)
    ways = defaultdict(set)
    for w in want:
        ways[w[1]].add(w[4])
    tampered = 0
    for r in got:
        i, text, lang, source, n = values[r["leaf"]]
        if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0:
            n += 1
            tampered += 1
        ends = set()
        for way in ways[r["leaf"]]:
            node = sha("".join(map(encoded, (i, source, lang, n, text))))
            for left, right in way:
                node = sha(left + node + right)
            ends.add(node)
        assert r["folded_root"] in ends and r["verified"] == (r["folded_root"] == r["root"])
    assert 0 < tampered == sum(not r["verified"] for r in got)


def test_manifest_of_few_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle.manifest(empty).collect() == []
    for rows in ([(1, "t", "en", "s", 1)], [(1, "t", "en", "s", 1), (2, "t", None, "s", 1), (3, None, "de", None, None)]):
        got = merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()
        assert sorted((r["doc_id"], r["leaf"], r["subroot"], r["root"]) for r in got) == sorted(w[:4] for w in plain_manifest(rows))
    with pytest.raises(ValueError, match="root"):
        merkle.manifest(empty.withColumnRenamed("doc_id", "root"), id_col="root")


def test_manifest_changes_show(spark):
    rows = [(i, f"text {i}", "en", "s", i) for i in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    before = merkle.manifest(df, block=4)
    for change in ({"n_chars": F.when(F.col("doc_id") == 17, 0).otherwise(F.col("n_chars"))}, {"text": F.when(F.col("doc_id") == 39, None).otherwise(F.col("text"))}):
        assert before.select("root").first() != merkle.manifest(df.withColumns(change), block=4).select("root").first()
    folded = before.select((merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok")).distinct().collect()
    assert [r["ok"] for r in folded] == [True]


# Resampling


def plain_features(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def plain_resample(rows, items):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % 10_000

    s = Counter(bucket(f) for r in rows for f in plain_features(r[1])[1])
    t = Counter(bucket(f) for i in items for f in plain_features(i[1])[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for r in rows:
        words, features = plain_features(r[1])
        gains = [floor(1000 * log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in map(bucket, features)]
        h = int(sha(f"7:{'' if r[0] is None else r[0]}")[:8], 16)
        weight = sum(gains) // len(gains) if gains else 0
        out.append((r[0], len(words), len(features), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296)))))
    order = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    ranks = defaultdict(list)
    for k, x in enumerate(order[: 25 * len(order) // 100], 1):
        ranks[x].append(k)
    for x in order[25 * len(order) // 100 :]:
        ranks[x].append(None)
    return Counter((x[0], *x[2:], ranks[x].pop(0) if ranks[x] else None) for x in out)


def test_op13(spark, documents):
    folder, rows, items = documents
    made = QUERIES["op13_resampling"](spark, folder)
    assert made.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, made.collect())) == plain_resample(rows, items)


@pytest.mark.parametrize("runs", [1, 2, 3, 5])
def test_ring_gives_every_run(runs):
    text = "Größe a b  a\tb c-d 7 ÀB " * 3
    words, _ = plain_features(text)
    want = Counter(zlib.crc32(" ".join(words[k : k + n]).encode()) % 97 for n in range(1, runs + 1) for k in range(len(words) - n + 1))
    count, found = resampling.text_buckets(text.encode(), runs, 97)
    assert count == len(words) and Counter(found) == want


def test_resampling_odd_tables(spark, documents):
    folder, rows, items = documents
    df, target = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    assert resampling.resample(df.limit(0), target).collect() == []
    assert Counter(map(tuple, resampling.resample(df, target.limit(0)).collect())) == plain_resample(rows, [])
    blank = spark.createDataFrame([(1, None), (2, " -"), (None, "")], "doc_id int, text string")
    assert all(r["n_features"] == 0 and r["weight"] == 0 and r["rank"] is None for r in resampling.resample(blank, target).collect())
    wide = resampling.resample(df, target, buckets=100_000, share=(1, 1), least_words=0)
    assert sorted(r["rank"] for r in wide.collect()) == list(range(1, len(rows) + 1))
    unique = df.where("doc_id < 211 AND doc_id != 7").dropDuplicates(["doc_id"])
    kept = resampling.drawn(unique, target)
    assert kept.columns == unique.columns and kept.count() == resampling.resample(unique, target).where("rank > 0").count() > 0
    with pytest.raises(ValueError, match="score"):
        resampling.resample(df.withColumnRenamed("doc_id", "score"), target, id_col="score")


def test_resampling_favours_the_target(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["law", "court", "judge"] if i % 2 else ["ball", "goal", "team"], k=30))) for i in range(200)]
    target = spark.createDataFrame([("the judge of the court of law",), ("court law judge",)], "text string")
    scored = resampling.resample(spark.createDataFrame(rows, "doc_id int, text string"), target).collect()
    assert min(r["weight"] for r in scored if r["doc_id"] % 2) > max(r["weight"] for r in scored if not r["doc_id"] % 2)
    ranked = [r for r in scored if r["rank"]]
    assert len(ranked) == 50 and sum(r["doc_id"] % 2 for r in ranked) > 25


# Pages


class PlainArticle(HTMLParser):
    """The text of <article>, cut at its paragraphs and headings, by Python's own parser."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def plain_article(page):
    parser = PlainArticle()
    parser.feed(re.sub(r"&(?=[a-z]+(?![a-z;]))", "&amp;", page))  # references without an end are text there
    return " ".join(t for t in (" ".join(html.unescape(b).split()) for b in parser.blocks) if t)


def test_op12_against_plain_version(spark):
    made = QUERIES["op12_page_text"](spark, "/root/testdata/sf0.01")
    assert made.columns == ["page_id", "url", "text", "n_chars"]
    got = {r["page_id"]: r for r in made.collect()}
    source = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(got) == len(source)
    differ = 0
    for r in source:
        text = got[r["page_id"]]["text"]
        assert got[r["page_id"]]["n_chars"] == len(text) and got[r["page_id"]]["url"] == r["url"]
        differ += text != plain_article(r["html"])
    assert differ == 0


LONG = "The house of the people that was on the hill is the one that they had built with their own hands in the spring of that year. "
PARTS = {
    "<p>{}</p>": True,
    "<p><b>{}</b></p>": True,
    "<div>{}</div>": True,
    "<ul><li>{}</li></ul>": True,
    "<blockquote>{}</blockquote>": True,
    '<div class="ad">{}</div>': False,
    '<p class="advert">{}</p>': False,
    '<aside>{}</aside>': False,
    '<div id="sidebar"><p>{}</p><p>x</p></div>': False,
    '<section class="comments"><article><p>{}</p></article></section>': False,
    '<div role="alert">{}</div>': False,
    '<div class="cookie-notice">{}</div>': False,
    "<form><p>{}</p><input name=q><select><option>a</option></select></form>": False,
    '<nav><a href="/x">{}</a></nav>': False,
    '<p><a href="/x">{}</a></p>': False,
    '<div style="display:none">{}</div>': False,
    "<script>if (a < b) {{ '</p>' }} // {}</script>": False,
    "<!-- {} -->": False,
    "<noscript>{}</noscript>": False,
    '<span class="promo">{}</span>': False,
}


@pytest.mark.parametrize("frame", ["<article>{}</article>", '<div class="content">{}</div>', "<main>{}</main>", "{}"])
def test_parts_of_pages(frame):
    rng = random.Random(frame)
    for _ in range(30):
        picked = [(part, f"{LONG}Number {k} of these is told apart by the mark m{k}q.") for k, part in enumerate(rng.choices(list(PARTS), k=8))]
        inner = "".join(part.format(text) for part, text in picked)
        page = f"<html><head><title>T</title></head><body class='menu'><header><p>{LONG}</p></header>{frame.format(inner)}<footer>{LONG}</footer></body></html>"
        assert pages.main_text(page) == " ".join(text for part, text in picked if PARTS[part])


def test_short_blocks_inherit():
    body = f"<h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p>Last.</p>"
    want = f"Title {LONG}Short. {LONG}Last."
    menu = "<nav><ul><li><a href='/'>Home</a></li></ul></nav>"
    for frame in (f"<article>{body}</article>", f"<div>{body}</div>", f"<main>{body}</main>"):
        assert pages.main_text(f"{menu}{frame}<footer>&copy; 2020</footer>") == want
    links = "".join(f"<li><a href='/{k}'>Page {k} of many pages</a></li>" for k in range(9))
    assert pages.main_text(f"<div><ul>{links}<li>more</li>{links}</ul></div><article>{body}</article>") == want
    assert pages.main_text("<nav>a</nav><article><p>On.</p></article><footer>b</footer>") == "On."
    assert pages.main_text("<p>Buy now</p><footer>b</footer>") == ""


def test_odd_pages(spark):
    long = f"<article><p>{LONG * 12_000}</p></article>"
    rows = [
        (1, "u", None),
        (2, None, ""),
        (None, "u", "<article><p>a&amp;b &lt;c&gt; &#233;&#x41;&nbsp;\n\t d<b>e</b>f<br>g &am &amp h</p></article>"),
        (4, "u", "<article><p>one<p>two<br><br>three<li>four"),
        (5, "u", "<article><p>never <a href='x"),
        (6, "u", "<article><p>3 < 4 and a<b</p><!-- never closed <p>x</p>"),
        (7, "u", "no markup at all"),
        (8, "u", '<ARTICLE><P TITLE="a>b">Upper</P></ARTICLE><p data-x=\'</p>\'>'),
        (9, "u", long),
        (9, "u", long),
        (10, "u", "<div>" * 5000 + "<article>deep</article>"),
        (11, "u", '<a "' * 50_000),
        (12, "u", "<article><p>x\x00y &#0; &#xD800; &bogus;</p></article>"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id int, url string, html string, text int")
    got = pages.extract_pages(df).collect()
    assert [(r["page_id"], r["url"]) for r in got] == [r[:2] for r in rows] and all(r["n_chars"] == len(r["text"]) for r in got)
    texts = [r["text"] for r in got]
    assert texts[:8] == ["", "", "a&b <c> éA def g &am & h", "one two three four", "never", "3 < 4 and a<b", "", "Upper"]
    assert texts[8] == texts[9] == (LONG * 12_000).strip() and texts[10] == "deep" and texts[11] == ""
    assert texts[12] == "x\x00y � � &bogus;"
    assert pages.extract_pages(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="text"):
        pages.extract_pages(df, id_col="text")
