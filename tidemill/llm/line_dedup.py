"""Line dedup by a segment-partition edit join, in SQL functions only.

Lines of at least min_chars characters are cut into threshold + 1 segments. A line within the threshold of
another holds one of its segments unchanged, at a place that the lengths and the segment's number narrow to
a few (multi-match-aware selection), so lines meet on hashes of (segment number, length, substring). Keys of
one line only are dropped by an aggregate that combines on the map side. Small buckets give their pairs.
Buckets over SMALL_BUCKET lines are dealt anew by what surrounds each of at most BLOCKS blocks of the line; groups
still large by what surrounds each block of such a block, and so on down to single characters: lines agreeing
there are one edit apart, and a star links them. Candidates are verified by a banded bit-parallel edit distance.

With one_word, lines also link that differ in one whole word, replaced or left out, of at most a tenth of its
line. One half of their words is the same, so only lines that share a half go on; these meet on hashes of all
other words, which XOR gives in one step for each word, and are then grouped by those words themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import components, maybe_broadcast, stash

SMALL_BUCKET = 32
#: Blocks into which a line, or a block of it, is cut at most.
BLOCKS = 16
#: Rows of a class from which its first line is broadcast, so that the class isn't dealt to one task.
LARGE_CLASS = 4096
#: Characters of two lines compared before the whole lines are.
LOOK = 64
#: A word that lines may differ in is at most such a part of its line.
WORD_SHARE = 10
SAME = ["doc_id", "text_hash"]


def _split(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, pos, line, h1, h2) of lines long enough; spaces around a line don't count."""
    text = F.col("text")
    odd = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\x0c"))
    plain = F.when(odd, F.regexp_replace(text, r"[\x09\x0B-\x0D]+", " ")).otherwise(text)
    at = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(plain, "\n")).alias("pos", "line"))
    at = at.withColumn("line", F.trim("line")).where(F.length("line") >= min_chars)
    return at.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def segment_keys(line: Column, threshold: int) -> list[tuple[Column, int]]:
    """(key, role): role 0 the line's own segments, role 1 substrings probing shorter lines' segments (null: none)."""
    k, size = threshold + 1, F.length(line)
    out = []
    for shorter in range(threshold + 1):
        target = size - shorter
        base, extra = F.floor(target / k).cast("int"), F.pmod(target, F.lit(k))
        for i in range(1, k + 1):
            long_before = F.greatest(F.lit(0), F.lit(i - 1 - k) + extra)  # the last `extra` segments are one longer
            start = base * (i - 1) + long_before + 1
            length = base + F.when(F.lit(k - i) < extra, 1).otherwise(0)
            for move in range(max(-(i - 1), shorter - (k - i)), min(i - 1, shorter + (k - i)) + 1):
                key = F.xxhash64(F.lit(i), target, F.substring(line, start + move, length))
                own = shorter == 0 and move == 0
                inside = (start + move >= 1) & (start + move + length - 1 <= size)
                out.append((F.when(inside, key), 0 if own else 1))
    return out


def around(rows: DataFrame) -> DataFrame:
    """Rows (id, key, part, lack) by what lies before and after each block of part: (id, key, part, lack, last).

    part stands for a stretch of length(part) + lack characters, so that lines which miss one of them (lack 1)
    meet the others. key says what surrounds the part in the line; last, whether blocks are single characters.
    """
    whole = F.length("part") + F.col("lack")
    block = F.ceil(whole / BLOCKS).cast("int")

    def cut(j: Column) -> Column:
        after = whole - (j + 1) * block
        key = F.xxhash64("key", whole, j, F.substring("part", F.lit(1), j * block), F.when(after > 0, F.right("part", after)).otherwise(F.lit("")))
        inside = F.least(block, whole - j * block) - F.col("lack")
        return F.struct(key.alias("key"), F.substring("part", j * block + 1, inside).alias("part"), (block == 1).alias("last"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((whole - 1) / block).cast("int")), cut)
    return rows.select("id", "lack", F.explode(blocks).alias("s")).select("id", "s.key", "s.part", "lack", "s.last")


def refined(lines: DataFrame) -> DataFrame:
    """(a, b): pairs of lines (id, line) among which are all that are one edit apart, but for chains through a star's hub."""
    rows = lines.select("id", F.lit(0).cast("long").alias("key"), F.col("line").alias("part"), F.explode(F.array(F.lit(0), F.lit(1))).alias("lack"))
    pairs = []
    while True:
        cut = stash(around(rows))
        sizes = cut.groupBy("key").agg(F.count("*").alias("g"), F.min("id").alias("low")).where("g > 1")
        live = stash(cut.join(sizes, "key"))
        pairs.append(_pairs(live.where(f"g <= {SMALL_BUCKET} and not last").select("key", "id", F.lit(0).alias("role"))))
        pairs.append(live.where("last and id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct())
        rows = live.where(f"g > {SMALL_BUCKET} and not last").select("id", "key", "part", "lack")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, pairs).distinct()


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _common(a: Column, b: Column, part) -> Column:
    """Characters that part (F.left or F.right) of both strings shares, by bisection."""
    most = F.least(F.length(a), F.length(b))
    start = F.struct(F.lit(0).alias("low"), most.alias("high"))

    def halve(held: Column, _: Column) -> Column:
        mid = F.shiftright(held["low"] + held["high"] + 1, 1)
        same = part(a, mid) == part(b, mid)
        return F.struct(F.when(same, mid).otherwise(held["low"]).alias("low"), F.when(same, held["high"]).otherwise(mid - 1).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(most + 1)).cast("int"))
    return F.aggregate(steps, start, halve, lambda held: held["low"])


def _band(a: Column, b: Column, threshold: int, finish) -> Column:
    """finish(bits of the last level, row of the table) after all characters of b, which is not empty.

    Bit d of level e says that prefixes whose lengths differ by d - threshold are within e edits; one step
    over a character of b moves all diagonals of the band at once.
    """
    t, band = threshold, (1 << (2 * threshold + 1)) - 1
    zero = F.lit(0).cast("int")
    start = [F.lit(sum(1 << d for d in range(t, min(t + e, 2 * t) + 1))).cast("int") for e in range(t + 1)]

    def step(held: Column, j: Column) -> Column:
        match = zero
        for d in range(2 * t + 1):
            match = match.bitwiseOR(F.when((j + d - t >= 0) & (F.get(held["x"], j + d - t) == F.get(held["y"], j)), F.lit(1 << d)).otherwise(zero))
        new: list[Column] = []
        for e in range(t + 1):
            r = held[f"r{e}"].bitwiseAND(match)
            if e:
                old = held[f"r{e - 1}"]
                r = r.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(band))
            new.append(r)
        return F.struct(held["x"].alias("x"), held["y"].alias("y"), *[r.alias(f"r{e}") for e, r in enumerate(new)])

    first = F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"), *[r.alias(f"r{e}") for e, r in enumerate(start)])
    return F.aggregate(F.sequence(F.lit(0), F.length(b) - 1), first, step, lambda held: finish(held[f"r{t}"], held))


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether the edit distance of two strings is at most the threshold: bit-parallel over a band of diagonals.

    What both strings begin and end with is cut off first, which leaves the distance as it is. The band runs
    over LOOK characters of the rest and, if a diagonal is still alive, over all of it.
    """
    t = threshold

    def core(s: Column) -> Column:
        n, m = F.length(s["x"]), F.length(s["y"])
        near = _band(F.left(s["x"], F.lit(LOOK + t)), F.left(s["y"], F.lit(LOOK)), t, lambda bits, _: bits != 0)
        whole = _band(s["x"], s["y"], t, lambda bits, held: F.call_function("shiftright", bits, F.size(held["x"]) - F.size(held["y"]) + t).bitwiseAND(F.lit(1)) == 1)
        return F.when(F.abs(n - m) > t, F.lit(False)).when(m == 0, F.lit(True)).when(n == 0, m <= t).when(~near, F.lit(False)).otherwise(whole)

    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ends = lambda s: _let(_common(s["x"], s["y"], F.right), lambda q: pair(F.left(s["x"], F.length(s["x"]) - q), F.left(s["y"], F.length(s["y"]) - q)))
    starts = _let(_common(a, b, F.left), lambda p: pair(F.right(a, F.length(a) - p), F.right(b, F.length(b) - p)))
    return F.when(F.abs(F.length(a) - F.length(b)) > t, F.lit(False)).otherwise(_let(_let(starts, ends), core))


def _may_be_one_edit(a: Column, b: Column) -> Column:
    """Necessary for one edit: at every cut, what lies before it or what lies after it is the same."""
    out = F.abs(F.length(a) - F.length(b)) <= 1
    for i in range(1, 8):
        cut = F.floor(F.length(a) * i / 8).cast("int")
        out = out & ((F.left(a, cut) == F.left(b, cut)) | (F.right(a, F.length(a) - cut) == F.right(b, F.length(a) - cut)))
    return out


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs of line ids within buckets; of two probing rows neither may see the other."""
    x = rows.select("key", F.col("id").alias("a"), F.col("role").alias("ra"))
    y = rows.select("key", F.col("id").alias("b"), F.col("role").alias("rb"))
    return x.join(y, "key").where("a < b and (ra = 0 or rb = 0)").select("a", "b").distinct()


def _texts(docs: DataFrame, lines: DataFrame, ids: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, line) of the lines named by ids, read from the first document of each."""
    ids_here = maybe_broadcast(ids)
    homes = lines.join(ids_here, ["h1", "h2"]).groupBy("h1", "h2").agg(F.min(F.struct(*SAME)).alias("home"))
    homes = stash(homes.select(F.col("home.doc_id").alias("k_id"), F.col("home.text_hash").alias("k_hash")).distinct())
    there = docs.join(maybe_broadcast(homes), F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.xxhash64("text") == F.col("k_hash")), "left_semi")
    return _split(there, min_chars).join(ids_here, ["h1", "h2"]).select("h1", "h2", "line").dropDuplicates(["h1", "h2"])


#: Roles of the columns of half_keys: a line's own halves, and those that a line without one of its words would have.
HALF_ROLES = [0, 0, 1, 1]


def half_keys(line: Column) -> Column:
    """Hashes of the first and second half of a line's words, and of such halves as a line of one word less shares with it."""

    def halves(words: Column) -> Column:
        def of(n: Column) -> list[Column]:
            first = F.floor(n / 2).cast("int")
            return [F.xxhash64(F.lit(0), n, F.slice(words, F.lit(1), first)), F.xxhash64(F.lit(1), n, F.slice(words, F.size(words) - (n - first) + 1, n - first))]

        fewer = [F.when(F.size(words) > 1, key) for key in of(F.greatest(F.size(words) - 1, F.lit(1)))]
        return F.array(*of(F.size(words)), *fewer)

    return _let(F.split(line, " "), halves)


def word_keys(line: Column) -> Column:
    """Structs (key, role, i): role 0 the line but for word i, role 1 its words but word i in any order, role 2 all its words so."""
    xor = lambda hashes: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h))
    row = lambda key, role, i: F.struct(key.alias("key"), F.lit(role).cast("byte").alias("role"), i.cast("int").alias("i"))

    def keys(s: Column) -> Column:
        words, n = s["words"], F.size(s["words"])
        may_go = lambda w: F.length(w) * WORD_SHARE <= s["size"]
        other = F.transform(words, lambda w, i: row(F.when(may_go(w), F.xxhash64(F.lit(0), n, i, s["placed"].bitwiseXOR(F.xxhash64(i, w)))), 0, i))
        fewer = F.transform(words, lambda w, i: row(F.when(may_go(w), F.xxhash64(F.lit(1), n - 1, s["loose"].bitwiseXOR(F.xxhash64(w)))), 1, i))
        return F.concat(other, fewer, F.array(row(F.xxhash64(F.lit(1), n, s["loose"]), 2, F.lit(-1))))

    hashed = lambda s: F.struct(s["words"].alias("words"), s["size"].alias("size"), xor(F.transform(s["words"], lambda w, i: F.xxhash64(i, w))).alias("placed"), xor(F.transform(s["words"], lambda w: F.xxhash64(w))).alias("loose"))
    return _let(_let(F.struct(F.split(line, " ").alias("words"), F.length(line).alias("size")), hashed), keys)


def word_links(docs: DataFrame, lines: DataFrame, uniq: DataFrame, min_chars: int) -> DataFrame:
    """(a, b): links of lines that differ in one word of at most a WORD_SHARE-th of its line; a star each where many agree but for one word."""
    each = F.array(*[F.struct(F.get("halves", i).alias("key"), F.lit(role).cast("byte").alias("role")) for i, role in enumerate(HALF_ROLES)])
    halves = uniq.where("halves is not null").select("h1", "h2", F.explode(each).alias("s")).select("h1", "h2", "s.*").where("key is not null")
    common = halves.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.min("role").alias("role")).where("low <> high and role = 0").select("key")
    near = stash(halves.join(maybe_broadcast(stash(common)), "key").select("h1", "h2").distinct())
    texts = stash(_texts(docs, lines, near, min_chars))
    keyed = texts.select("h1", "h2", F.explode(word_keys(F.col("line"))).alias("s")).select("h1", "h2", "s.*").where("key is not null")
    live = keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.min("role").alias("r0"), F.max("role").alias("r1"))
    live = stash(live.where("low <> high and (r1 = 0 or (r0 = 1 and r1 = 2))").select("key"))
    rows = stash(keyed.join(maybe_broadcast(live), "key").select("h1", "h2", "role", "i").distinct())
    words, i = F.split("line", " "), F.col("i")
    before, after = F.slice(words, F.lit(1), F.greatest(i, F.lit(0))), F.slice(words, i + 2, F.size(words))
    place = F.when(F.col("role") == 0, i).otherwise(-1)  # lines that lack a word agree wherever it stood
    held = rows.join(texts, ["h1", "h2"]).withColumn("rest", F.when(F.col("role") == 2, F.col("line")).otherwise(F.array_join(F.concat(before, after), " ")))
    held = held.select(F.concat(F.hex("h1"), F.lit("-"), F.hex("h2")).alias("id"), "role", place.alias("place"), F.size(words).alias("n"), F.xxhash64("rest").alias("g1"), F.xxhash64(F.lit(1), "rest").alias("g2"))
    held = stash(held.withColumn("n", F.when(F.col("role") == 2, F.col("n") + 1).otherwise(F.col("n"))))
    group = ["g1", "g2", "place", "n"]
    hub = held.groupBy(*group).agg(F.min(F.when(F.col("role") != 1, F.col("id"))).alias("hub"))
    return held.join(hub, group).where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()


def near_lines(docs: DataFrame, lines: DataFrame, uniq: DataFrame, threshold: int, min_chars: int, one_word: bool = False) -> DataFrame:
    """(id, label) of lines linked to another line, by connected components; id is hex of (h1, h2)."""
    roles = [role for _, role in segment_keys(F.lit(""), threshold)]
    keys = F.array(*[F.struct(F.col(f"k{i}").alias("key"), F.lit(role).cast("byte").alias("role")) for i, role in enumerate(roles)])
    keyed = uniq.select("h1", "h2", F.explode(keys).alias("s")).select("h1", "h2", "s.key", "s.role").where("key is not null")
    live = keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.min("role").alias("role")).where("low <> high and role = 0").select("key")
    live = stash(live)
    ident = F.concat(F.hex("h1"), F.lit("-"), F.hex("h2"))
    rows = stash(keyed.join(maybe_broadcast(live), "key").distinct().select("key", "role", "h1", "h2"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("g"))
    small_keys, large_keys = sizes.where(F.col("g") <= SMALL_BUCKET).select("key"), sizes.where(F.col("g") > SMALL_BUCKET).select("key")
    named = rows.select("key", "role", ident.alias("id"))
    pairs = stash(_pairs(named.join(small_keys, "key")))
    hot = rows.join(large_keys, "key").select("h1", "h2").distinct()
    ids = stash(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().unionByName(hot.select(ident.alias("id"))).distinct())
    ids = ids.select(F.conv(F.split_part("id", F.lit("-"), F.lit(1)), 16, -10).cast("long").alias("h1"), F.conv(F.split_part("id", F.lit("-"), F.lit(2)), 16, -10).cast("long").alias("h2"))
    texts = _texts(docs, lines, ids, min_chars)
    texts = stash(texts.select("h1", "h2", ident.alias("id"), "line"))

    if threshold == 1:
        hot_lines = texts.join(hot, ["h1", "h2"], "left_semi")
        pairs = pairs.unionByName(refined(hot_lines.select("id", "line")))
    else:  # every pair of a large bucket, dealt out by the key and a salt of one side
        wide = named.join(large_keys, "key").select("key", "id", "role")
        salted = wide.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)))
        spread = wide.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
        x, y = salted.toDF("key", "a", "ra", "salt"), spread.toDF("key", "b", "rb", "salt")
        pairs = pairs.unionByName(x.join(y, ["key", "salt"]).where("a < b and (ra = 0 or rb = 0)").select("a", "b").distinct())
    pairs = stash(pairs.distinct())
    t = texts.select("id", "line")
    both = pairs.join(t.toDF("a", "la"), "a").join(t.toDF("b", "lb"), "b")
    if threshold == 1:
        both = stash(both.where(_may_be_one_edit(F.col("la"), F.col("lb"))))
    links = stash(both.where(within(F.col("la"), F.col("lb"), threshold)).select("a", "b"))
    if one_word:
        links = stash(links.unionByName(word_links(docs, lines, uniq, min_chars)))
    return components(links).select(F.col("node").alias("id"), F.col("component").alias("label"))


def line_dedup(docs: DataFrame, threshold: int = 1, min_chars: int = 20, doc_id: str = "doc_id", text: str = "text", one_word: bool = False, exact_chars: int | None = None) -> DataFrame:
    """All columns of docs, text without its duplicate lines, and n_lines, n_removed (long).

    A line is what lies between line feeds; spaces around it don't count in comparisons. Lines shorter than
    min_chars are left alone, but of exact_chars and more, where given, repeats of them go. Lines equal or linked
    by chains of edit distances up to the threshold (with one_word also of one other, missing or added word of at
    most a tenth of its line) form a class; its first line in the document of the smallest id stays, all others go. Null and empty texts are
    returned as they are, with no line or one. Rows with the same id and text are one document seen twice:
    each keeps the same lines. Rows with a null id come after all others. Columns named like the two counts
    are replaced. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    least = min_chars if exact_chars is None else min(min_chars, exact_chars)
    keys = [F.when(F.length("line") >= min_chars, key).alias(f"k{i}") for i, (key, _) in enumerate(segment_keys(F.col("line"), threshold))]
    names = [f"k{i}" for i in range(len(keys))]
    if one_word:
        keys, names = [*keys, F.when(F.length("line") >= min_chars, half_keys(F.col("line"))).alias("halves")], [*names, "halves"]
    lines = stash(_split(rows, least).select(*SAME, "pos", "h1", "h2", *keys))
    uniq = stash(lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in names]))
    labels = stash(near_lines(rows, lines, uniq, threshold, min_chars, one_word))
    ident = F.concat(F.hex("h1"), F.lit("-"), F.hex("h2"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    near_ids = labels.select(F.conv(F.split_part("id", F.lit("-"), F.lit(1)), 16, -10).cast("long").alias("h1"), F.conv(F.split_part("id", F.lit("-"), F.lit(2)), 16, -10).cast("long").alias("h2"), "label")
    again = stash(uniq.select("h1", "h2", "n").join(maybe_broadcast(near_ids), ["h1", "h2"], "left").where("n > 1 or label is not null").select("h1", "h2", F.coalesce("label", ident).alias("class")))
    repeats = lines.select(*SAME, "pos", "h1", "h2").join(maybe_broadcast(again), ["h1", "h2"])
    firsts = repeats.groupBy("class", *SAME).agg(F.min("pos").alias("pos"))
    owner = firsts.groupBy("class").agg(F.count("*").alias("in_docs"), F.min(F.struct(*[order[c].alias(c) for c in ("none", "doc_id", "text_hash")], "pos")).alias("own"))
    large = stash(owner.where(F.col("in_docs") >= LARGE_CLASS).select("class", "own"))  # these rows stay where they are
    here = maybe_broadcast(large)
    owned = repeats.join(here, "class").unionByName(repeats.join(here.select("class"), "class", "left_anti").join(owner.drop("in_docs"), "class"))
    gone = owned.where(~(F.col("doc_id").eqNullSafe(F.col("own.doc_id")) & (F.col("text_hash") == F.col("own.text_hash")) & (F.col("pos") == F.col("own.pos"))))
    gone = stash(gone.groupBy(*SAME).agg(F.sort_array(F.collect_set("pos")).alias("gone")))
    # One character a line, 1 for lines that go, so that no line has to be looked up in a list.
    runs = F.transform("gone", lambda pos, i: F.concat(F.repeat(F.lit("0"), pos - F.when(i > 0, F.get("gone", i - 1)).otherwise(-1) - 1), F.lit("1")))
    k_id, k_hash, n_gone, mask = ("_" * max(map(len, docs.columns)) + name for name in ("id", "hash", "n_gone", "mask"))  # no column of docs
    keyed = gone.select(F.col("doc_id").alias(k_id), F.col("text_hash").alias(k_hash), F.size("gone").alias(n_gone), F.encode(F.array_join(runs, ""), "utf-8").alias(mask))
    out = docs.drop("n_lines", "n_removed")
    joined = out.join(maybe_broadcast(keyed), F.col(doc_id).eqNullSafe(F.col(k_id)) & (F.xxhash64(F.col(text)) == F.col(k_hash)), "left")
    parts = F.split(F.col(text), "\n")
    joined = joined.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("long"))
    joined = joined.withColumn("n_removed", F.coalesce(n_gone, F.lit(0)).cast("long"))
    kept = F.filter(parts, lambda _, i: F.substring(F.col(mask), i + 1, F.lit(1)) != F.lit(b"1"))
    clean = F.when(F.col(mask).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[clean.alias(text) if c == text else F.col(c) for c in out.columns], "n_lines", "n_removed")
