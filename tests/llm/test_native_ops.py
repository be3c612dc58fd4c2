import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemill.llm import line_dedup as ld
from tidemill.llm.decontaminate import decontaminate
from tidemill.llm.quality_rules import quality_rules
from tidemill.llm.url_filter import RULES, url_filter


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def variants(seed, n, size=40):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdé ") for _ in range(size)).strip() + "." for _ in range(5)]
    out = []
    for _ in range(n):
        s = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(1, len(s) - 1)
            s[i : i + r.randint(0, 1)] = r.choice(["", "x", "y", "😀"])
        out.append("".join(s).strip())
    return out


@pytest.mark.parametrize("t", [1, 2])
def test_banded_distance(spark, t):
    v = variants(t, 60)
    rows = [(a, b) for a in v[:30] for b in v[30:]]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", ld.within(F.col("a"), F.col("b"), t).alias("w")).collect()
    assert all(r.w == (edits(r.a, r.b) <= t) for r in got)


def line_brute(rows, t, least):
    lines = []
    for d, x in rows:
        for p, s in enumerate((x or "").split("\n") if x is not None else []):
            s = re.sub(r"[\t-\r]+", " ", s).strip(" ")
            if len(s) >= least:
                lines.append((d, p, s))
    texts = sorted({s for *_, s in lines})
    up = {s: s for s in texts}

    def root(s):
        while up[s] != s:
            s = up[s]
        return s

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if abs(len(a) - len(b)) <= t and edits(a, b) <= t:
                up[root(a)] = root(b)
    own = {}
    for d, p, s in lines:
        own[root(s)] = min(own.get(root(s), (d, p)), (d, p))
    gone = {(d, p) for d, p, s in lines if own[root(s)] != (d, p)}
    return {d: None if x is None else "\n".join(s for p, s in enumerate(x.split("\n")) if (d, p) not in gone) for d, x in rows}


@pytest.mark.parametrize("t,bucket", [(1, 32), (1, 2), (2, 32), (2, 2)])
def test_line_dedup(spark, t, bucket, monkeypatch):
    monkeypatch.setattr(ld, "SMALL_BUCKET", bucket)
    r, v = random.Random(3), variants(7, 40)
    rows = [(i, "\n".join([r.choice(v), "short", r.choice(v) + r.choice(["", " ", "\t"]), ""])) for i in range(25)] + [(100, None), (101, ""), (102, "\n\n"), (103, "z" * 900 + "\n" + "z" * 899)]
    docs = spark.createDataFrame([(d, x, 5, "k") for d, x in rows], "doc_id long, text string, n_lines int, key string").repartition(3)
    got = {x.doc_id: x.text for x in ld.line_dedup(docs, t).collect()}
    assert got == line_brute(rows, t, 20)


def test_line_dedup_edges(spark):
    assert ld.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    line = "the same line of some length"
    twice = spark.createDataFrame([(1, line), (1, line), (2, line), (None, line)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text, r.n_removed) for r in ld.line_dedup(twice).collect())
    assert got == [("1", line, 0), ("1", line, 0), ("2", "", 1), ("None", "", 1)]


def one_word(a, b):
    """Whether two lines differ in one word, replaced or left out, of at most a tenth of its line."""
    x, y = a.split(" "), b.split(" ")
    fits = lambda w, line: 10 * len(w) <= len(line)
    if len(x) == len(y):
        at = [i for i in range(len(x)) if x[i] != y[i]]
        return len(at) == 1 and fits(x[at[0]], a) and fits(y[at[0]], b)
    if len(x) < len(y):
        x, y, b = y, x, a
        a = " ".join(x)
    return len(x) == len(y) + 1 and any(x[:i] + x[i + 1 :] == y and fits(x[i], a) for i in range(len(x)))


def test_lines_but_for_one_word(spark):
    r, vocab = random.Random(8), ["alpha", "an", "of", "river", "longerword", "über", "😀"]
    base = [[r.choice(vocab) for _ in range(r.choice([1, 3, 9, 14, 20]))] for _ in range(12)]
    lines = []
    for _ in range(110):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            i = r.randrange(len(w) + 1)
            w[i : i + r.randint(0, 1)] = r.choice([[], ["sand"], ["stone"], ["incomparably"]])
        lines.append(" ".join(w))
    lines += ["b c " + "word " * 9 + "end", "c b " + "word " * 9 + "end", "b " + "word " * 9 + "end", "tiny", "tiny", "x" * 30, "y", "x" * 30 + " y"]
    texts = sorted(set(lines))
    up = {s: s for s in texts}

    def root(s):
        while up[s] != s:
            s = up[s]
        return s

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if len(a) >= 20 and len(b) >= 20 and (one_word(a, b) or (abs(len(a) - len(b)) <= 1 and edits(a, b) <= 1)):
                up[root(a)] = root(b)
    own = {}
    for d, s in enumerate(lines):
        own.setdefault(root(s), d)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.n_removed for x in ld.line_dedup(docs, one_word=True, exact_chars=1).collect()}
    assert got == {d: int(own[root(s)] != d and s != "") for d, s in enumerate(lines)}
    assert len(set(map(root, texts))) < len(texts) - 10


def words5(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def test_decontaminate(spark):
    r = random.Random(1)
    vocab = [f"v{i}" for i in range(300)] + ["été", "the"]
    items = [(str(i), " ".join(r.choice(vocab) for _ in range(r.choice([3, 9, 10, 11, 25])))) for i in range(25)] + [("98", None), ("99", " .,"), (None, "v1 v2"), ("5", "v3")]
    rows = []
    for i in range(80):
        w = [r.choice(vocab) for _ in range(r.randint(0, 60))]
        if r.random() < 0.5:
            x = r.choice(items[:25])[1].split()
            n = r.randint(1, len(x))
            w[r.randint(0, len(w)) : 0] = [y.upper() + r.choice(["", ",", "\x00"]) for y in x[:n]]
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (None, items[0][1]), (3, rows[3][1])]
    docs = spark.createDataFrame([(d, t, 1, "w") for d, t in rows], "doc_id long, text string, n int, word string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = sorted(((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontaminate(docs, bench).collect()), key=str)
    want = []
    for d, t in rows:
        w, hit, found = words5(t), set(), set()
        for item, x in items:
            x = words5(x)
            size = min(10, len(x))
            for i in range(len(x) - size + 1) if x and item is not None else []:
                for j in range(len(w) - size + 1):
                    if w[j : j + size] == x[i : i + size]:
                        hit |= set(range(j, j + size))
                        found.add(item)
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want, key=str)
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_quality_rules(spark):
    r = random.Random(2)
    rows = [(i, "".join(r.choice(["a ", "b ", "c\t", "d\n", "# ", "é&", "\n", "word. "]) for _ in range(r.randint(0, 90)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n\x0b"), (None, "one two"), (503, "x y z w v " * 50), (504, "home | about | contact | login\n" * 5 + "A sentence of quite a few good words stands here. " * 1)]
    got = {(x.doc_id): x for x in quality_rules(spark.createDataFrame([(d, t, 1, "h") for d, t in rows], "doc_id long, text string, n_words int, h string")).collect()}
    for d, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {p for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        x = got[d]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)), (d, t)
        assert x.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
    assert got[504].kept is False
    assert quality_rules(spark.createDataFrame([(1, "Some clean words in a row, written as people write them. They go on for a while.")], "doc_id long, text string")).first().kept


def test_url_filter(spark):
    urls = ["http://example.org/es/1", "https://WWW.Example.ORG/en/1?x", "http://a.example.org/en/2", "ftp://x.com/de/#a", "http://x.com/fr/y", "http://x.com/fr", "http://x.net/", None, "", "no-scheme.org/", "http://org", "http://org/", "http://xample.org?y://b.com/de/", "http://b.orgs/", "//x.org/"]
    pages = spark.createDataFrame([(i, u, "k", 2) for i, u in enumerate(urls)] + [(None, urls[0], "k", 2)], "page_id long, url string, key string, row int")
    rules = spark.createDataFrame(RULES, "verdict string, rule string")
    got = [(x.page_id, x.host, x.path, x.rule, x.verdict) for x in url_filter(pages, rules).collect()]

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(x), x, v) for v, x in RULES if (host == (h := x.split("/")[0]) or host.endswith("." + h)) and path.startswith(x[len(h) :])]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    assert sorted(got, key=str) == sorted([(i, *brute(u)) for i, u in enumerate(urls)] + [(None, *brute(urls[0]))], key=str)
    shuffled = url_filter(pages, rules, broadcast_bytes=0)
    assert sorted(((x.page_id, x.host, x.path, x.rule, x.verdict) for x in shuffled.collect()), key=str) == sorted(got, key=str)
    assert "BroadcastHashJoin" not in shuffled._jdf.queryExecution().optimizedPlan().toString() and "broadcast" not in shuffled._jdf.queryExecution().optimizedPlan().toString()
    assert url_filter(pages.limit(0), rules).count() == 0
    assert {x.verdict for x in url_filter(pages, rules.limit(0)).collect()} == {"allow"}


def test_long_lines_that_share_a_half(spark):
    """Lines of one large bucket, most of which match nothing, and some that are an edit or two apart."""
    r = random.Random(11)
    half = "".join(r.choice("abcdefgh ") for _ in range(8000)) + "."
    rest = ["".join(r.choice("abcdefgh ") for _ in range(8000)) + "." for _ in range(40)]
    rows = [(i, half + x) for i, x in enumerate(rest)]
    rows += [(100, half + rest[3][:5000] + "Z" + rest[3][5001:]), (101, half + rest[3][:5000] + rest[3][5001:]), (102, half + rest[3][:7000] + "ZZ" + rest[3][7002:])]
    got = {x.doc_id: x.n_removed for x in ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {d for d, n in got.items() if n} == {100, 101}


@pytest.mark.parametrize("blocks", [2, 3, 16])
def test_refinement_finds_all_lines_one_edit_apart(spark, blocks, monkeypatch):
    monkeypatch.setattr(ld, "SMALL_BUCKET", 1)
    monkeypatch.setattr(ld, "BLOCKS", blocks)
    v = sorted(set(variants(9, 60, 23)))
    lines = spark.createDataFrame([(s, s) for s in v], "id string, line string")
    up = {s: s for s in v}

    def root(s):
        while up[s] != s:
            s = up[s]
        return s

    pairs = [(p.a, p.b) for p in ld.refined(lines).collect()]
    for a, b in pairs:
        assert edits(a, b) <= 2  # lines of a star may be two apart by its hub
        if edits(a, b) <= 1:
            up[root(a)] = root(b)
    for i, a in enumerate(v):
        for b in v[i + 1 :]:
            assert edits(a, b) > 1 or root(a) == root(b), (a, b)


def test_rules_of_equal_length_and_repeated_pages(spark):
    rules = spark.createDataFrame([("allow", "b.org/"), ("block", "b.org/"), ("allow", "a.b.org/x"), ("block", "b.org/xyzu"), (None, "c.org/"), ("block", None)], "verdict string, rule string")
    pages = spark.createDataFrame([(1, "http://b.org/q")] * 3 + [(2, "http://a.b.org/xyzu"), (3, "http://c.org/"), (4, "http://" + "a." * 300 + "b.org/" + "x" * 50_000)], "page_id long, url string")
    got = Counter((r.page_id, r.rule, r.verdict) for r in url_filter(pages, rules).collect())
    assert got == Counter({(1, "b.org/", "block"): 3, (2, "b.org/xyzu", "block"): 1, (3, None, "allow"): 1, (4, "a.b.org/x", "allow"): 1})


def test_long_texts_repeated_rows_and_empty_tables(spark):
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long), (1, long), (2, "x " * 100_000)], "doc_id long, text string")
    rows = {(r.doc_id, r.n_words, r.n_repeat_words, r.base_failed) for r in quality_rules(docs).collect()}
    assert rows == {(1, 200_000, 200_000, True), (2, 100_000, 100_000, True)} and quality_rules(docs).count() == 3
    assert quality_rules(docs.limit(0)).count() == 0
    bench = spark.createDataFrame([("i", " ".join(f"w{i}" for i in range(4990, 5010)))], "item_id string, text string")
    hit = [(r.doc_id, r.n_hit) for r in decontaminate(docs, bench).orderBy("doc_id").collect()]
    assert hit[0] == hit[1] == (1, 40 * 10) and hit[2] == (2, 0)


def test_every_kind_of_line_rule(spark):
    good = "A sentence of quite a few good words stands here and goes on."
    bad = ["Alle Rechte vorbehalten, Stadt", "Tous droits réservés par nous", "Todos los derechos reservados aquí", "!!! ??? *** now", "home | about | news | more", "Click HERE to go on"]
    docs = spark.createDataFrame([(0, good)] + [(i + 1, f"{good}\n{x}") for i, x in enumerate(bad)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed_lines, r.kept, r.clean_text) for r in quality_rules(docs, clean=True).collect()}
    assert got == {0: (0, True, good), **{i + 1: (1, True, good) for i in range(len(bad))}}
