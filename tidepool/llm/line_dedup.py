"""Line dedup: exact repeats and near repeats of lines, by a segment-partition edit join in DataFrame functions alone.

Lines are dealt into classes of like length, which overlap by max_edits. Each distinct line is cut into max_edits + 1 segments that have
the same size and place in all lines of a class, seen from the nearer end of the line; two lines within max_edits edits share
a class and one of these at nearly the same place. Places and hashes of segments are what is shuffled. Only lines with a
hash that another one has are read again: they must nearly agree in their letter counts, of which an edit changes two by one
at most; the rest is verified with a banded bit-parallel edit distance. Where many lines share a segment, they first
meet the earliest of them only: a line that is near one of these is decided, and two decided lines need not meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm._shared import NULL_ID, once, written

MAX_EDITS, MIN_CHARS = 2, 40
#: Line numbers to remove (4 bytes each) up to this many are sent to every executor; more meet the texts in a shuffle.
BROADCAST_NUMBERS = 10_000_000
#: Rows of a table that is joined (keys, line numbers with their places or counts) up to this number are sent to every executor.
BROADCAST_LINES = 1_000_000
PLACE = ("rid", "th", "pos")
#: Characters whose counts are compared, in the lowest bits of a long: LETTERS modulo 4 (two bits each), RARE ones modulo 2 (those of one
#: string share a bit). The characters beyond ASCII, of any script, share the next OTHERS bits by their code. The sign bit tells decided lines.
LETTERS, RARE, OTHERS = "etaoinsrhldcu", [*"mfpgwybvkxjqz", "05", "16", "27", "38", "49"], 19
#: Lines of one class that share a segment; above this number they meet PIVOTS of them first, in up to ROUNDS rounds.
HOT, PIVOTS, ROUNDS = 64, 16, 3


def _segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """1-based start and size of segment i (from 0) of a line of this length; the last segments take the remainder."""
    k = edits + 1
    size, extra = F.floor(length / k).cast("int"), (length % k).cast("int")
    longer = F.greatest(F.lit(0), F.lit(i - k) + extra)
    return size * i + longer + 1, size + (F.lit(i) >= F.lit(k) - extra).cast("int")


def _classes(length: Column, edits: int) -> tuple[Column, Column]:
    """The length class of a line, and the next one if lines of that can be within `edits` edits (else the same)."""
    width = 4 * max(edits, 1)
    return F.floor(length / width).cast("int"), F.floor((length + edits) / width).cast("int")


def _keys(line: Column, length: Column, edits: int, shifts: Callable[[int], range]) -> Column:
    """Hashes of the segments i of a line, moved by shifts(i), in its classes. Of k edits with i before a segment and k - i behind it,
    the segment moves by i from the line's start, by k - i from its end."""

    def of_class(x, c):
        least = F.greatest(c * (4 * max(edits, 1)) - edits, F.lit(0))
        out = []
        for i in range(edits + 1):
            start, size = _segment(least, i, edits)
            start = start if 2 * i <= edits else start + (length - least)
            out += [F.xxhash64(F.lit(i), c, F.substring(x, start + by, size)) for by in shifts(i)]
        return out

    own, later = _classes(length, edits)
    cut = lambda x: F.when(own == later, F.array(*of_class(x, own))).otherwise(F.array(*of_class(x, own), *of_class(x, later)))
    # bytes are a line's characters if there are as many, and a piece of those is found without reading what stands before it
    return F.when(F.octet_length(line) == length, cut(line.cast("binary"))).otherwise(cut(line))


def index_keys(line: Column, length: Column, edits: int) -> Column:
    return _keys(line, length, edits, lambda i: range(1))


def probe_keys(line: Column, full: Column, edits: int) -> Column:
    """Keys of every segment that a line within `edits` edits can have whole in this one."""
    return _keys(line, full, edits, lambda i: range(-min(i, edits - i), min(i, edits - i) + 1))


def join_keys(line: Column, length: Column, edits: int) -> Column:
    """Keys of which lines within `edits` edits share one. Up to two edits, a segment that stands a place earlier in one line only
    matters with one edit on either side of it; then the other line's segment stands a place later in this one."""
    return _keys(line, length, edits, lambda i: range(-min(i, edits - i) if edits > 2 else 0, min(i, edits - i) + 1))


def letter_parity(line: Column) -> Column:
    """Bits for characters, whatever the script. Of LETTERS the count modulo 4, as two bits of which one changes when it goes up or down
    by one; of others whether the line holds them an odd number of times. An edit takes one character and gives one, and
    a character has one bit to change at most, so two lines within k edits differ in 2 k bits at most."""
    n, rest, left, at, bits = F.octet_length(line), line, F.octet_length(line), 0, []
    for k, own in enumerate([*LETTERS, *RARE]):  # what was counted is gone before the next is
        before = left
        for c in own:
            rest = F.replace(rest, F.lit(c), F.lit(""))
        left = F.octet_length(rest)
        count = (before - left) % (4 if k < len(LETTERS) else 2)
        bits.append(F.shiftleft(count.bitwiseXOR(F.shiftright(count, 1)).cast("long"), at))
        at += 2 if k < len(LETTERS) else 1
    chars = F.split(F.regexp_replace(line, r"[\x00-\x7F]+", ""), "")  # the fold costs something a character: only what is not ASCII
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % OTHERS + at)
    others = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0).cast("long"), lambda s, c: s.bitwiseXOR(bit(c)))
    return sum(bits[1:], bits[0]).bitwiseOR(F.when(n > F.length(line), others).otherwise(F.lit(0).cast("long")))


def _may(s1: str, s2: str, edits: int) -> Column:
    """Whether two lines' bits let them be within `edits` edits, and one of them is not decided."""
    same = F.col(s1).bitwiseXOR(F.col(s2)).bitwiseAND(F.lit((1 << 63) - 1))
    return (F.bit_count(same) <= 2 * edits) & (F.col(s1).bitwiseAND(F.col(s2)) >= 0)


def _stripped(a: Column, b: Column, blocks: int = 16) -> Column:
    """(x, y): both strings without what they share at their ends, to a sixteenth of the length; that changes no distance."""
    n, m = F.length(a), F.length(b)
    short = F.least(n, m)

    def cut(size):
        lead = [(F.substring(a, 1, size * k) == F.substring(b, 1, size * k)).cast("int") for k in range(1, blocks + 1)]
        tail = [(F.substring(a, n - size * k + 1, size * k) == F.substring(b, m - size * k + 1, size * k)).cast("int") for k in range(1, blocks + 1)]
        inner = lambda p, q: F.struct(F.substring(a, p + 1, n - p - q).alias("x"), F.substring(b, p + 1, m - p - q).alias("y"))
        return once(size * sum(lead[1:], lead[0]), lambda p: once(F.least(size * sum(tail[1:], tail[0]), short - p), lambda q: inner(p, q)))

    return once(F.floor(short / blocks).cast("int"), cut)


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two strings is at most `edits`: bit k of a word is row j - edits + k of column j, so a
    column is a few operations on one long whatever the strings' length."""
    full = (1 << (2 * edits + 1)) - 1

    def distance(pair):
        x, y = pair["x"], pair["y"]
        n, m = F.size(x), F.size(y)
        bit = lambda j, k: F.when(F.get(x, j - edits + k) == F.get(y, j), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
        equal = lambda j: sum((bit(j, k) for k in range(1, 2 * edits + 1)), bit(j, 0))
        matches = F.transform(F.sequence(F.lit(0), m - 1), equal)

        def step(s, e):
            p, q = s["p"], s["q"]
            zero = ((((e.bitwiseAND(p)) + p).bitwiseXOR(p)).bitwiseOR(e).bitwiseOR(q)).bitwiseAND(F.lit(full))

            def after(z):
                plus = q.bitwiseOR(F.bitwise_not(z.bitwiseOR(p)).bitwiseAND(F.lit(full)))
                down = F.shiftright(z, 1)
                vertical = z.bitwiseAND(p).bitwiseOR(F.bitwise_not(down.bitwiseOR(plus)).bitwiseAND(F.lit(full)))
                return F.struct(vertical.alias("p"), down.bitwiseAND(plus).alias("q"), (s["d"] + F.lit(1) - F.shiftright(z, 2 * edits)).alias("d"))

            return once(zero, after)

        start = F.struct(F.lit((full << edits) & full).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(edits).cast("long").alias("d"))
        beyond = F.lit((1 << (2 * edits)) - 1).cast("long") - (F.call_function("shiftleft", F.lit(1).cast("long"), (n - m + edits).cast("int")) - 1)
        end = lambda s: s["d"] - F.bit_count(s["p"].bitwiseAND(beyond)) + F.bit_count(s["q"].bitwiseAND(beyond))
        return F.when((n == 0) | (m == 0), F.lit(0).cast("long")).otherwise(F.aggregate(matches, start, step, end))

    chars = lambda c: F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))
    both = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    of_pair = once(_stripped(a, b), lambda s: once(_stripped(s["x"], s["y"]), lambda t: once(both(chars(t["x"]), chars(t["y"])), distance)))
    return F.when(F.abs(F.length(a) - F.length(b)) > edits, F.lit(False)).otherwise(of_pair <= edits)


def _blocks_alive(a: Column, b: Column, edits: int, blocks: int = 16) -> Column:
    """Necessary for within_edits: an edit can damage one of `blocks` blocks of a only, the others stand in b near their place."""
    size = F.floor(F.length(a) / blocks).cast("int")
    found = []
    for k in range(blocks):
        at = size * k + 1
        first = F.greatest(F.lit(1), at - edits)
        found.append(F.contains(F.substring(b, first, size + (at - first) + edits), F.substring(a, at, size)).cast("int"))
    return sum(found[1:], found[0]) >= blocks - edits


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """(rid, th, removed): the numbers (from 0) of the lines to remove, for each document that has some; see dedup_lines.

    rid is the id (nulls as the largest number), th a hash of the text.
    """
    if min_chars < 8 * (max_edits + 1):
        raise ValueError("min_chars must be at least 8 * (max_edits + 1)")
    doc = ["rid", "th"]
    known = docs.select(*_identity(id_col, text_col), F.col(text_col).alias("text"))
    if not known.groupBy(*doc).count().where("count > 1").isEmpty():  # rows that repeat id and text are one document here
        known = known.groupBy(*doc).agg(F.first("text").alias("text"))
    lines = F.coalesce(F.split("text", "\n", -1), F.array().cast("array<string>"))
    least = min_chars if exact_chars is None else min(min_chars, exact_chars)
    counts = lambda x: (F.length(x) >= min_chars) | ((F.length(x) >= least) & x.rlike(r"\S")) if least < min_chars else F.length(x) >= min_chars
    judged = known.select(*doc, F.posexplode(lines).alias("pos", "line")).where(counts(F.col("line"))).withColumn("n", F.length("line"))
    keys = F.when(F.col("n") >= min_chars, join_keys(F.col("line"), F.col("n"), max_edits))
    judged = judged.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.struct(*PLACE, keys.alias("keys")).alias("f"))
    # the first line of equal ones; in the joins it is one number
    distinct = judged.groupBy("h1", "h2").agg(F.min("f").alias("f")).select(F.monotonically_increasing_id().alias("lid"), "f.*")
    distinct = written(distinct, "lines")
    kept = _with_few(distinct.select("lid", *PLACE), _near_lines(distinct, known, max_edits), "lid", "left_anti").groupBy(*doc).agg(F.collect_list("pos").alias("kept"))
    seen = F.filter(F.transform("lines", lambda x, i: F.when(counts(x), i)), lambda i: i.isNotNull())
    seen = known.select(*doc, lines.alias("lines")).select(*doc, seen.alias("seen")).where(F.size("seen") > 0)
    gone = F.array_except("seen", F.coalesce("kept", F.array().cast("array<int>")))
    return seen.join(kept, doc, "left").select(*doc, gone.alias("removed")).where(F.size("removed") > 0)


def _near_lines(distinct: DataFrame, docs: DataFrame, max_edits: int) -> DataFrame:
    """lid of the lines within max_edits edits of one that is first seen earlier. distinct: lid, rid, th, pos, keys; docs: rid, th, text."""
    keyed = distinct.select("lid", F.explode(F.array_distinct("keys")).alias("k"))
    shared = written(keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = written(_with_few(keyed, shared, "k", "inner"), "members")
    texts = written(_texts(distinct, members, docs), "texts")
    decided = _decided(members, texts, max_edits)
    bits = texts.select("lid", "sig")
    if decided is not None:
        bits = _with_few(bits, decided.withColumn("done", F.lit(-(1 << 63))), "lid", "left")
        bits = bits.select("lid", F.col("sig").bitwiseOR(F.coalesce("done", F.lit(0).cast("long"))).alias("sig"))
    marked = _with_few(members.drop("n"), bits, "lid", "inner", texts)
    side = lambda n: marked.select(F.col("lid").alias(f"l{n}"), F.col("sig").alias(f"s{n}"), "k")
    met = side(1).join(side(2), "k").where((F.col("l1") < F.col("l2")) & _may("s1", "s2", max_edits)).select("l1", "l2")
    pairs = _verified(written(met.distinct(), "pairs"), texts, max_edits)
    near = pairs.select(F.when(F.col("at1") < F.col("at2"), F.col("l2")).otherwise(F.col("l1")).alias("lid"))
    return written((near if decided is None else near.unionByName(decided)).distinct(), "near")


def _texts(distinct: DataFrame, members: DataFrame, docs: DataFrame) -> DataFrame:
    """lid, rid, th, pos, line, sig of the lines in members."""
    wanted = written(members.select("lid").distinct(), "wanted")
    places = written(_with_few(distinct.select("lid", *PLACE), wanted, "lid", "left_semi").groupBy("rid", "th").agg(F.collect_list(F.struct("pos", "lid")).alias("at")), "places")
    found = _with_few(docs, places, ["rid", "th"], "inner", wanted).select("rid", "th", "at", F.split("text", "\n", -1).alias("lines"))
    found = found.select("rid", "th", F.explode(F.transform("at", lambda a: F.struct(a["lid"].alias("lid"), a["pos"].alias("pos"), F.get("lines", a["pos"]).alias("line")))).alias("x"))
    return found.select("x.lid", "rid", "th", "x.pos", "x.line", letter_parity(F.col("x.line")).alias("sig"))


def _with_few(df: DataFrame, few: DataFrame, key: str | list[str], how: str, counted: DataFrame | None = None) -> DataFrame:
    """df joined with a table that usually is small: itself, or the table with as many rows, in the shared folder."""
    return df.join(F.broadcast(few) if (few if counted is None else counted).count() <= BROADCAST_LINES else few, key, how)


def _verified(pairs: DataFrame, lines: DataFrame, max_edits: int) -> DataFrame:
    """The pairs (l1, l2) within max_edits edits, with their places at1 and at2. lines: lid, line and its place."""
    wanted = written(pairs.select(F.col("l1").alias("lid")).unionByName(pairs.select(F.col("l2").alias("lid"))).distinct(), "wanted")
    texts = _with_few(lines.select("lid", *PLACE, "line"), wanted, "lid", "inner")
    side = lambda n: texts.select(F.col("lid").alias(f"l{n}"), F.struct(*PLACE).alias(f"at{n}"), F.col("line").alias(f"line{n}"))
    pairs = pairs.join(side(1), "l1").join(side(2), "l2")
    return pairs.where(_blocks_alive(F.col("line1"), F.col("line2"), max_edits)).where(within_edits(F.col("line1"), F.col("line2"), max_edits))


def _decided(members: DataFrame, texts: DataFrame, max_edits: int) -> DataFrame | None:
    """lid of lines that are near an earlier one, of those that share a segment with more than HOT others; None if there are none.

    In a round the earliest PIVOTS of a segment's undecided lines meet all of its undecided lines, so the pairs are at most
    PIVOTS for a line and segment. What is not found here is found by the join of all.
    """
    hot = members.where(F.col("n") > HOT).drop("n")
    if hot.isEmpty():
        return None
    lines = texts.join(written(hot.select("lid").distinct(), "hot_ids"), "lid", "left_semi")
    lines = written(lines, "hot_lines")
    left = hot.join(lines.drop("line"), "lid")
    decided = None
    for k in range(ROUNDS):
        nth = F.row_number().over(Window.partitionBy("k").orderBy(*PLACE))
        pivots = left.withColumn("nth", nth).where(F.col("nth") <= (k + 1) * PIVOTS).where(F.col("nth") > k * PIVOTS)
        pivots = written(pivots.select("k", F.col("lid").alias("l1"), F.col("sig").alias("s1"), F.struct(*PLACE).alias("first")), "pivots")
        met = _with_few(left.withColumnRenamed("sig", "s2"), pivots, "k", "inner").where(_may("s1", "s2", max_edits) & (F.struct(*PLACE) > F.col("first")))
        near = _verified(written(met.select("l1", F.col("lid").alias("l2")).distinct(), "pairs_of_pivots"), lines, max_edits)
        found = written(near.select(F.col("l2").alias("lid")).distinct(), "decided")
        if found.isEmpty():
            break
        decided = found if decided is None else written(decided.unionByName(found), "decided")
        left = left.join(found, "lid", "left_anti")
    return decided


def _identity(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("rid"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("th")]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, carry: tuple[str, ...] = (), exact_chars: int | None = None) -> DataFrame:
    """Remove repeats of lines from documents: doc_id, n_lines, n_removed, kept_text of every row, and the columns in `carry`.

    Lines (split at \\n) of at least min_chars characters are judged, in order of document id and line. A line is removed if
    the same line stands earlier, or if a line first seen earlier is within max_edits edits of it. Shorter lines are
    kept, but with exact_chars those of so many characters and not blank go where the same line stands earlier (1: all).

    Null text: no lines, kept_text null; empty text: one line, kept. Texts and lines may have any length. A null id sorts after
    all others. Rows with one id and one text are one document and get the same result; rows with one id and different
    texts are ordered by a hash of the text. Other columns are ignored, and those in `carry` may have any name; an empty
    table gives no rows. min_chars must be at least 8 * (max_edits + 1) for the segments to tell lines apart.
    """
    removed = written(removed_lines(docs, id_col, text_col, max_edits, min_chars, exact_chars), "removed")
    numbers = removed.agg(F.coalesce(F.sum(F.size("removed") + 8), F.lit(0))).first()[0]
    removed = F.broadcast(removed) if numbers <= BROADCAST_NUMBERS else removed
    own = docs.select(F.col(id_col).alias("doc_id"), F.struct(*carry).alias("carry") if carry else F.lit(None).alias("carry"), *_identity(id_col, text_col), F.col(text_col).alias("text"))
    cut = own.join(removed, ["rid", "th"], "left")
    keep = lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed")), lambda p: F.get(lines, p)), "\n")
    kept = once(F.split("text", "\n", -1), keep)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1)
    out = (n.cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept).alias("kept_text"))
    return cut.select("doc_id", *(F.col("carry").getField(c).alias(c) for c in carry), *out)
