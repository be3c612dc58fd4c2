import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemill.llm import clustering as cl
from tidemill.llm import exact_dedup as ed
from tidemill.llm import merkle as mk

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def text_of(r, sentences):
    return "".join(" ".join(r.choice(["Alpha", "beta", "Größe", "İx", "日本語"]) + str(r.randint(0, 99)) for _ in range(r.randint(1, 12))) + r.choice([".", "!\n", "?\n\n", "\n"]) for _ in range(sentences))


def dedup_rows():
    r = random.Random(11)
    texts = [text_of(r, n) for n in (1, 3, 40, 400)] + ["", None, "x" * 50_000, "no end", "İ", "i̇", "a￿b", "ab"]
    rows = []
    for i in range(300):
        t = r.choice(texts[:4] if i % 3 else texts)
        rows.append((r.choice([i, i, None, 5]), t.swapcase() if t and i % 5 == 0 else t, 1))
    return [*rows, (900, texts[3][:-1] + "#", 1), (901, "#" + texts[3], 1), (5, texts[2], 1), (5, texts[2], 1)]


def check_dedup(rows, got):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[(t or "").translate(LOWER)].append(d)
    want = Counter()
    for t, ids in groups.items():
        for d in ids:
            want[d, max((x for x in ids if x is not None), default=None), len(ids), sha(t)] += 1
    assert Counter((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got) == want
    kept = [x for x in got if x.kept]
    assert len(kept) == len(groups) and all(x.doc_id == x.keep_id for x in kept)
    assert len({x.text_sha256 for x in kept}) == len(groups)


@pytest.mark.parametrize("fingerprint", [F.xxhash64, lambda c: F.length(c) % 7, lambda c: F.lit(1)], ids=["hash", "collisions", "all collide"])
def test_exact_dedup(spark, fingerprint):
    rows = dedup_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, pointer int").repartition(5)
    got = ed.exact_dedup(docs, lambda c: fingerprint(c).cast("long")).collect()
    check_dedup(rows, got)


def test_exact_dedup_of_nothing_and_of_one(spark):
    docs = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert [tuple(r) for r in ed.exact_dedup(docs).collect()] == [(None, None, 1, True, sha(""))]
    assert ed.exact_dedup(docs.limit(0)).count() == 0


def test_chunks_are_the_text_and_survive_an_insertion(spark):
    r = random.Random(3)
    long = text_of(r, 3000)
    texts = ["", "one.", "no end", "..!?\n" * 2000, "z" * 100_000, "a￿b. c", long, long[:5000] + "something new. " + long[5000:]]
    got = [x.chunks for x in ed.with_chunks(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(1)).orderBy("i").collect()]
    assert ["".join(c) for c in got] == texts
    assert all(len(x) <= ed.MOST for c in got[:5] for x in c)
    assert len(got[6]) > 50 and len(set(got[7]) - set(got[6])) <= 2


def merkle_brute(rows, fanout=3):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda row: sha("".join(map(field, row)))

    def tree(hs):
        """Root, and for each leaf its list of (left, right)."""
        paths, own = [[] for _ in hs], [[i] for i in range(len(hs))]
        while len(hs) > 1:
            up, own_up = [], []
            for i in range(0, len(hs), fanout):
                run = hs[i : i + fanout]
                for j in range(len(run)):
                    for x in own[i + j]:
                        paths[x].append(("".join(run[:j]), "".join(run[j + 1 :])))
                up.append(sha("".join(run)))
                own_up.append([x for o in own[i : i + fanout] for x in o])
            hs, own = up, own_up
        return hs[0], paths

    by = defaultdict(list)
    for row in rows:
        by[row[1]].append(row)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda row: (row[0] is not None, row[0] or 0, leaf(row)))
        trees[s] = tree([leaf(row) for row in by[s]])
    root, tops = tree([trees[s][0] for s in sources])
    out = Counter()
    for s, top in zip(sources, tops, strict=True):
        for row, path in zip(by[s], trees[s][1], strict=True):
            now = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                now = (*row[:4], row[4].replace("\n", ""))
            folded = leaf(now)
            for a, b in path + top:
                folded = sha(a + folded + b)
            out[row[0], leaf(row), trees[s][0], root, sha("".join(a + b for a, b in path + top)), folded, folded == root] += 1
    return out


@pytest.mark.parametrize("height", [1, 2, 6])
def test_merkle(spark, height):
    r = random.Random(height)
    sizes = {"web": 82, None: 9, "": 1, "é": 10, "z\nz": 3, "hot": 244, "27": 27, "28": 28}
    rows = [(r.choice([i, i, i, -i, None]), s, r.choice([None, "en"]), r.choice([None, 3, -1]), r.choice([None, "", "a\nb", "plain ß", "\n\n"])) for s, n in sizes.items() for i in range(n)]
    rows += rows[:2] * 3
    docs = spark.createDataFrame([(*x, 1, "s") for x in rows], "doc_id long, source string, lang string, n_chars long, text string, n int, pos string").repartition(5)
    got = mk.merkle_manifest(docs, height=height)
    assert Counter(tuple(x) for x in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()) == merkle_brute(rows)


def test_merkle_of_nothing_one_and_a_long_text(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    for rows in ([(1, None, None, None, None)], [(3, "s", "en", 1, "a\n" * 500_000)]):
        got = mk.merkle_manifest(spark.createDataFrame(rows, schema)).collect()
        assert Counter(tuple(x) for x in got) == merkle_brute(rows)
    assert mk.merkle_manifest(spark.createDataFrame([], schema)).count() == 0


def cluster_brute(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, sha(f"3:{r[0]}"), r[1]))[:k]
    centroids = [list(v) for _, v in first]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for j, own in groups.items():
            centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, *reversed(near(v))) for i, v in kept]
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), sha(",".join(map(str, centroids[c])))) for i, c, d in out)


def vectors(kind):
    r = random.Random(5)
    values = {"dense": lambda: r.gauss(0, 0.2), "quantised": lambda: r.choice([-1.0, -0.5, 0.25]), "wide": lambda: r.gauss(0, 20000)}[kind]
    rows = [(i, [values() for _ in range(64)]) for i in range(150)]
    rows += [(1000 + i, rows[i % 4][1]) for i in range(60)] + rows[:3] + [(None, rows[7][1]), (None, rows[8][1])]
    bad = rows[0][1]
    return rows + [(2000, None), (2001, []), (2002, bad[:63]), (2003, [*bad[:63], None]), (2004, [*bad[:63], float("nan")]), (2005, [float("-inf"), *bad[1:]]), (2006, [*bad, 0.0])]


@pytest.mark.parametrize("kind", ["dense", "quantised", "wide"])
@pytest.mark.parametrize("limit", [cl.BROADCAST_BYTES, 0], ids=["codes", "joined"])
def test_clustering(spark, kind, limit):
    rows = vectors(kind)
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, v int, cluster int").repartition(5)
    got = cl.centroid_clustering(df, limit=limit)
    assert Counter(tuple(x) for x in got.collect()) == cluster_brute(rows)


def test_clustering_of_few_and_none(spark):
    df = spark.createDataFrame(vectors("dense")[:3], "vec_id long, embedding array<double>")
    assert Counter(tuple(x) for x in cl.centroid_clustering(df).collect()) == cluster_brute(vectors("dense")[:3])
    assert cl.centroid_clustering(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        cl.centroid_clustering(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"))


def test_quantised_blocks_take_wide_dictionaries(spark):
    rows = [(i, [float((i * 7 + d // 8) % 3) for d in range(64)]) for i in range(400)]
    ints = cl.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1024, 64)
    keys, known = cl.choose(ints, 64, 8, cl.BROADCAST_BYTES)
    assert keys.width == 16 and all(len(own) == 3 for own in known)
    assert sorted(keys.back(0, known[0])[:, 0].tolist()) == [0, 1024, 2048]


def test_line_separators_at_the_end_are_words(spark):
    """Only ASCII white space separates words, so a last U+2028, U+2029 or U+0085 is one."""
    from tidemill.llm.quality_rules import quality_rules
    from tidemill.llm.token_counts import word_count

    texts = ["a \u2028", "a \u2029 ", "\u2028", "a \u0085", " \u0085 ", "a \n", "a \u2028 ", "  \u2028b", "a\r\n", "\n"]
    want = [len([w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_words for r in quality_rules(docs).orderBy("doc_id").collect()] == want
    assert [r.n for r in docs.select("doc_id", word_count(F.col("text")).alias("n")).orderBy("doc_id").collect()] == want


LONG = "A paragraph of the article with a good many words in it, and then some more of them."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<p>{LONG}</p><p>Yes.</p>", f"{LONG} Yes."),
        (f"<article><p>{LONG}</p><ul><li>one</li><li>two</li><li>three</li></ul></article>", f"{LONG} one two three"),
        (f"<p>Short.</p><p>{LONG}</p><p>{LONG}</p><ul><li><a href='/1'>Link one</a></li><li><a href='/2'>Link two</a></li></ul>", f"Short. {LONG} {LONG}"),
        (f'<article><h2 id="related-work">Related work</h2><p>{LONG}</p><h2 id="social-effects">Social effects</h2><section id="related-work"><p>{LONG}</p></section></article>', f"Related work {LONG} Social effects {LONG}"),
        (f'<article><p>{LONG}</p><section id="comments"><p>{LONG}</p></section></article>', LONG),
        (f'<form id="aspnetForm"><div><p>{LONG}</p></div></form>', LONG),
        (f'<form id="aspnetForm"><nav><a href="/">Home</a></nav><main><p>{LONG}</p></main><footer>end</footer></form>', LONG),
        (f'<nav><a href="/">Home</a><article><p>{LONG}</p></article>', LONG),
        (f"<p>{LONG}</p><form><p>Your name</p></form>", LONG),
        (f"<p>{LONG} a < b and <", f"{LONG} a < b and <"),
    ],
    ids=["short end", "list", "links", "ids", "comments", "form", "form and main", "unclosed nav", "form in page", "lone signs"],
)
def test_articles_lose_nothing(page, want):
    from tidemill.llm.html_text import main_text

    assert main_text(page) == want


def test_every_given_article_alone_is_kept(spark):
    """Through the query: each page's article alone, with and without its element, gives what the page gives."""
    from tidemill.llm.html_text import html_text

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    whole = {r.page_id: r.text for r in html_text(pages).collect()}
    article = F.regexp_extract("html", r"(?s)<article[^>]*>.*</article>", 0)
    for inner in (article, F.regexp_replace(article, r"^<article[^>]*>|</article>$", "")):
        got = {r.page_id: r.text for r in html_text(pages.withColumn("html", inner)).collect()}
        assert len(got) == 250 and got == whole


def test_unclosed_tags_take_linear_time():
    import time

    from tidemill.llm.html_text import main_text

    began = time.process_time()
    assert main_text("<p>text</p>" + "<a " * 50_000).startswith("text")
    assert main_text("<" * 100_000) == "<" * 100_000
    assert time.process_time() - began < 2
