"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Lines are the parts of a text between line feeds, compared without blanks at their ends; blank lines are
never touched. Two lines are linked if they are equal or, from `min_chars` characters on, if their edit
distance is at most `tau`. Of each class of linked lines the first occurrence (smallest doc_id, then
position) stays; every other occurrence goes.

1. Equal lines meet by 128-bit hash. Keys and pairs carry 63 bits of it; lines that share these are judged apart
   when the texts are fetched, and links and classes hold all 128. A line is split into tau + 1 segments; by the pigeonhole principle a line
   within tau edits holds one of them unchanged, near its place. A line's own segments are index keys
   (length, segment number, content); substrings of longer lines at the places that multi-match-aware
   selection leaves are probe keys for each shorter length. Lines with more than a 100,000th of all
   occurrences (so at most 100,000 of them) make keys at their first place only.
2. Keys are dealt once, by key: there, those with one line only drop out, and the rest are members. Keys of up
   to `bucket` lines pair probes with index lines.
3. Lines of a larger key are looked at again with longer signatures: of tau + 3 segments, three stay unchanged
   within tau edits, so any two of them meet under three segments' contents at once, some three fifths of the
   line. A signature that is still shared by more than `bucket` lines is dealt into blocks, two at a time to a
   group, which is exact and splits the work, but grows with the square of such lines.
4. Only pairs whose parities of letters allow tau edits are made at all, so lines that share a key but differ in
   a word or more give no rows. The built-in banded distance drops what is hopeless still; the others are judged by a
   nondeterministic automaton of 2 tau + 1 diagonals and tau + 1 error levels in the bits of one long.
5. Components of links are the classes; occurrences to drop are joined to the texts by doc_id, and
   a line goes only if its hash there is the recorded one.

A null text stays null with no lines. A null doc_id counts as larger than any other. Rows that share a
doc_id are one document: equal lines at the same position are one occurrence. Candidate lines are fetched
by a broadcast join only while they number at most `broadcast_lines` (16 bytes each), and by a shuffle join
beyond. Columns of any name may be there; the counts take names that the caller chooses.
"""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .debruijn import NO_ID

BLANKS = " \t\r\x0b\x0c"


def stripped(line: Column) -> Column:
    """Without blanks at its ends; the slow trim is for lines with other blanks than spaces there."""
    plain, odd = F.trim(line), F.lit(False)
    for b in BLANKS[1:]:
        odd = odd | F.startswith(plain, F.lit(b)) | F.endswith(plain, F.lit(b))
    return F.when(odd, F.btrim(line, F.lit(BLANKS))).otherwise(plain)


def common_start(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, by bisection over powers of two."""
    most = F.least(F.length(a), F.length(b))
    steps = F.array(*(F.lit(1 << i) for i in range(30, -1, -1)))
    return F.aggregate(F.filter(steps, lambda s: s <= most), F.lit(0), lambda n, s: F.when((n + s <= most) & (F.substring(a, n + 1, s) == F.substring(b, n + 1, s)), n + s).otherwise(n))


def within(a: Column, b: Column, tau: int) -> Column:
    """Whether the edit distance of two strings is at most tau."""
    start = common_start(a, b)
    rest = F.struct(F.substring(a, start + 1, F.length(a)).alias("a"), F.substring(b, start + 1, F.length(b)).alias("b"))

    def core(r: Column) -> Column:
        end = common_start(F.reverse(r["a"]), F.reverse(r["b"]))
        return F.struct(*(F.split(F.substring(r[x], F.lit(1), F.length(r[x]) - end), "").alias(x) for x in "ab"), *((F.length(r[x]) - end).alias(f"n{x}") for x in "ab"))

    width, band = 2 * tau + 2, (1 << (2 * tau + 1)) - 1

    def automaton(c: Column) -> Column:
        first = sum((((1 << (e + 1)) - 1) << tau & band) << (width * e) for e in range(tau + 1))

        def step(state: Column, j: Column) -> Column:
            # bit d of `match`: the next character of b equals that of a on diagonal d - tau
            here = F.get(c["b"], j)
            match = F.lit(0).cast("long")
            for d in range(2 * tau + 1):
                match = match + F.when((j + d - tau >= 0) & (j + d - tau < c["na"]) & (F.get(c["a"], j + d - tau) == here), F.lit(1 << d)).otherwise(0)

            def advance(m: Column) -> Column:
                out, new = F.lit(0).cast("long"), None
                for e in range(tau + 1):
                    own = F.shiftrightunsigned(state, width * e).bitwiseAND(band)
                    got = own.bitwiseAND(m)
                    if e:
                        under = F.shiftrightunsigned(state, width * (e - 1)).bitwiseAND(band)
                        got = got.bitwiseOR(under).bitwiseOR(F.shiftright(under, 1)).bitwiseOR(F.shiftleft(new, 1).bitwiseAND(band))
                    new = got
                    out = out.bitwiseOR(F.shiftleft(new, width * e))
                return out

            return F.get(F.transform(F.array(match), advance), F.lit(0))

        last = F.aggregate(F.when(c["nb"] > 0, F.sequence(F.lit(0), c["nb"] - 1)).otherwise(F.array().cast("array<int>")), F.lit(first).cast("long"), step)
        goal = F.pow(F.lit(2), c["na"] - c["nb"] + tau).cast("long")
        return F.shiftrightunsigned(last, width * tau).bitwiseAND(goal) != 0

    near = F.get(F.transform(F.transform(F.array(rest), core), automaton), F.lit(0))
    return F.when(F.levenshtein(a, b, tau) < 0, False).otherwise(near)


def segments(n: Column, parts: int) -> list[tuple[Column, Column]]:
    """Start (from 1) and length of the parts of a line of n characters; longer ones last."""
    short = F.call_function("div", n, F.lit(parts)).cast("int")
    longer = (n % parts).cast("int")
    starts = [F.lit(1) + short * i + F.greatest(longer - (parts - i), F.lit(0)) for i in range(parts)]
    return [(start, short + (longer > parts - 1 - i).cast("int")) for i, start in enumerate(starts)]


# A line's number is 63 bits of its hash; the sign bit of a key's tag marks a probe.
PROBE = -(1 << 63)


def number(line: Column) -> Column:
    return F.xxhash64(line).bitwiseAND(F.lit(~PROBE))


def keys(tau: int) -> tuple[Column, int]:
    """Of columns (wide, n): an array of index keys of the line's own length, then probe keys of it and of shorter
    lengths; and how many index keys there are. Keys whose place doesn't fit are null. `wide` holds four bytes a
    character, so that a place is found without counting characters."""
    n, wide, own, probes = F.col("n"), F.col("wide"), [], []
    for delta in range(tau + 1):
        for i, (start, size) in enumerate(segments(n - delta, tau + 1)):
            low, high = max(-i, delta - (tau - i)), min(i, delta + (tau - i))
            for shift in range(low, high + 1):
                key = F.xxhash64(n - delta, F.lit(i), F.substring(wide, (start + shift) * 4 - 3, size * 4))
                if delta == shift == 0:
                    own.append(key)
                else:
                    probes.append(F.when((start + shift >= 1) & (start + shift + size <= n + 1), key))
    return F.array(*own, *probes), len(own)


def signatures(lines: DataFrame, tau: int, shared: int) -> DataFrame:
    """lines (id, line, n) -> (id, own, key) for `shared` unchanged segments out of tau + shared at once."""
    parts, patterns = tau + shared, []
    for delta in range(tau + 1):
        for shifts in product(range(-tau, tau + 1), repeat=shared):
            path = (0, *shifts, delta)
            if sum(abs(x - y) for x, y in zip(path, path[1:])) <= tau:
                patterns += [(delta, *chosen, *shifts) for chosen in combinations(range(parts), shared)]
    names = ["delta", *(f"i{k}" for k in range(shared)), *(f"s{k}" for k in range(shared))]
    fixed = ", ".join(f"named_struct({', '.join(f"'{name}', {x}" for name, x in zip(names, p))})" for p in patterns)
    rows = lines.select("id", "line", "n", F.expr(f"inline(array({fixed}))")).withColumn("m", F.col("n") - F.col("delta"))
    short, longer = F.expr(f"m div {parts}").cast("int"), (F.col("m") % parts).cast("int")
    rows = rows.select("*", short.alias("short"), longer.alias("longer"))
    content, fits, still = [], F.lit(True), F.col("delta") == 0
    for k in range(shared):
        i, shift = F.col(f"i{k}"), F.col(f"s{k}")
        start = F.col("short") * i + F.greatest(F.col("longer") - (parts - i), F.lit(0)) + 1 + shift
        size = F.col("short") + (F.col("longer") > parts - 1 - i).cast("int")
        content += [i, F.substring(F.col("line"), start, size)]
        fits, still = fits & (start >= 1) & (start + size <= F.col("n") + 1), still & (shift == 0)
    return rows.where(fits).select("id", still.alias("own"), F.xxhash64("m", *content).alias("key"))


def segment_keys(lines: DataFrame, tau: int) -> DataFrame:
    """lines (id, line, n) -> (id, own, key) of single segments."""
    array, own = keys(tau)
    wide = lines.select("id", "n", F.encode("line", "UTF-32").alias("wide"))
    # the array is a column of its own: inside the generator its code would be too long to be compiled
    return wide.select("id", array.alias("keys")).select("id", F.posexplode("keys").alias("at", "key")).where("key is not null").select("id", (F.col("at") < own).alias("own"), "key")


def members_of(keyed: DataFrame) -> DataFrame:
    """(id, own, key) -> (key, id, probe) of keys that two lines or more share, one of them by an index key."""
    tag = F.when(F.col("own"), F.col("id")).otherwise(F.col("id").bitwiseOR(F.lit(PROBE)))
    by = Window.partitionBy("key")
    dealt = keyed.select("key", tag.alias("tag")).withColumns({"lo": F.min("tag").over(by), "hi": F.max("tag").over(by)}).where("hi >= 0 and lo < hi")
    return dealt.select("key", "tag").distinct().select("key", F.col("tag").bitwiseAND(F.lit(~PROBE)).alias("id"), (F.col("tag") < 0).alias("probe"))


def parities(line: Column) -> Column:
    """A bit for each letter, digit and the blank: whether the line holds it an odd number of times. An edit changes two bits at most."""
    out = F.lit(0).cast("long")
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz 0123456789"):
        odd = (F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))) % 2
        out = out.bitwiseOR(F.shiftleft(odd.cast("long"), i))
    return out


def pairs_of(members: DataFrame, tau: int, bucket: int) -> DataFrame:
    """(key, id, probe, n, bits) -> distinct (a, b), a < b, whose parities leave `tau` edits possible. A key of more than
    `bucket` members is dealt into blocks."""
    placed = members.withColumn("blocks", F.ceil(F.col("n") / bucket)).withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # lines of different blocks meet under both blocks; those of one block under that block alone
    placed = placed.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "probe", "block", "bits")
    index = placed.where("not probe").select("key", "i", "j", F.col("id").alias("a"), F.col("block").alias("own"), F.col("bits").alias("own_bits"))
    met = index.join(placed.withColumnRenamed("id", "b"), ["key", "i", "j"]).where(f"a <> b and (probe or a < b) and (i = j or own <> block) and bit_count(own_bits ^ bits) <= {2 * tau}")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_links(lines: DataFrame, *, tau: int, bucket: int, broadcast_lines: int) -> DataFrame:
    """lines (id, id2, line, n) with repeats -> links (a, b) between different lines within tau edits, each known by (id, id2)."""

    def texts_of(wanted: DataFrame) -> DataFrame:
        some = F.broadcast(wanted) if wanted.count() <= broadcast_lines else wanted
        return cut(lines.join(some, "id").groupBy("id", "id2").agg(F.min("line").alias("line")).select("id", "id2", "line", F.length("line").alias("n"), parities(F.col("line")).alias("bits")))

    members = cut(members_of(segment_keys(lines, tau)))
    texts = texts_of(cut(members.select("id").distinct()))
    bits = texts.select("id", "bits")
    sizes = cut(members.groupBy("key").agg(F.count("*").alias("n")))
    pairs = cut(pairs_of(members.join(sizes.where(F.col("n") <= bucket), "key").join(bits, "id"), tau, bucket))
    crowded = cut(members.join(sizes.where(F.col("n") > bucket), "key", "left_semi").select("id").distinct())
    if not crowded.isEmpty():
        again = cut(members_of(signatures(texts.join(crowded, "id", "left_semi"), tau, 3)))
        more = again.join(again.groupBy("key").agg(F.count("*").alias("n")), "key").join(bits, "id")
        pairs = cut(pairs.union(pairs_of(more, tau, bucket)).distinct())
    first, second = (texts.select(F.col("id").alias(x), F.struct("id", "id2").alias(f"id{x}"), F.col("line").alias(f"l{x}")) for x in "ab")
    return cut(pairs.join(first, "a").join(second, "b").where(within(F.col("la"), F.col("lb"), tau)).select(F.col("ida").alias("a"), F.col("idb").alias("b")))


def without_repeated_lines(docs: DataFrame, *, tau: int = 2, min_chars: int = 20, bucket: int = 64, broadcast_lines: int = 2_000_000, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with doc_id and text -> all columns of docs with the text cleaned, and the two `counts` at the end. A
    column of docs that already has the name of a count is left out."""
    if tau < 1 or min_chars <= tau:
        raise ValueError("tau must be at least 1 and below min_chars")
    names = {c.lower() for c in counts}
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in names))
    doc, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.col("text").cast("string")
    split = docs.select(doc.alias("doc"), F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    lines = split.select("doc", "pos", stripped(F.col("raw")).alias("line")).where("line <> ''")
    lines = lines.select("doc", "pos", "line", number(F.col("line")).alias("id"), F.xxhash64(F.lit(1), "line").alias("id2"))
    places = cut(lines.select("id", "id2", F.struct("doc", "pos").alias("at")))
    found = cut(places.groupBy("id", "id2").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")))
    total = found.agg(F.sum("n")).first()[0] or 0
    common = found.where(F.col("n") > max(1000, total // 100_000)).select("id", "id2", "first")  # 100,000 rows at most
    long = lines.where(F.length("line") >= min_chars).join(F.broadcast(common), ["id", "id2"], "left").where("first is null or (first.doc = doc and first.pos = pos)").select("id", "id2", "line", F.length("line").alias("n"))
    classes = components(near_links(long, tau=tau, bucket=bucket, broadcast_lines=broadcast_lines)).select("id.id", "id.id2", "component_id")
    firsts = found.join(classes, ["id", "id2"], "left").where("component_id is not null or first < last")
    firsts = firsts.withColumn("class", F.coalesce("component_id", F.struct("id", "id2")))
    kept = firsts.groupBy("class").agg(F.min("first").alias("kept"))
    repeated = firsts.select("id", "id2", "class").join(kept, "class").select("id", "id2", "kept")
    gone = places.join(repeated, ["id", "id2"]).where("at <> kept").groupBy("at.doc").agg(F.collect_set(F.struct("at.pos", "id")).alias("gone"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), doc.alias("doc")).join(gone, "doc", "left")
    text = F.col("row.text").cast("string")
    there = F.split(text, "\n")
    ids = lambda x: number(stripped(x))
    stays = lambda x, i: ~F.coalesce(F.array_contains(F.col("gone"), F.struct(i.alias("pos"), ids(x).alias("id"))), F.lit(False))
    whole = whole.withColumn("left", F.when(F.col("gone").isNotNull(), F.filter(there, stays)))
    solid = lambda a: F.coalesce(F.size(F.filter(a, lambda x: stripped(x) != "")), F.lit(0)).cast("long")
    before = F.when(text.isNull(), F.lit(0).cast("long")).otherwise(solid(there))
    after = F.when(F.col("gone").isNull(), before).otherwise(solid(F.col("left")))
    return whole.select(*(F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join("left", "\n")).alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns), before.alias(counts[0]), (before - after).alias(counts[1]))
