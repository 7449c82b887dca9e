"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame operations only.

Two lines are within k edits if what remains of them after deletions is equal: a substitution deletes a character at the same place
of the remainder in both, an insertion or deletion deletes one in one of them only. Each line emits a key for every choice of up to
k deletions: the remainder's hash, the places of those that count as substitutions, and how many others there are. Lines whose keys
agree in remainder and substitutions and whose other deletions are at most k with the substitutions are within k edits of each
other, so a key's earliest line decides for all others and no pairs are written. What it decides is verified by edit distance.

A remainder's hash is the exclusive or of hashes of each character with its place, so that running values give the hashes after one
more deletion at any place in time linear in the line.

With one edit, few lines have to emit keys. Of any two lines within an edit, both halves but one are equal, and of any number of
parts all but one: what stands before and behind that part, for the length that the longer line has. So only lines that share a
half with another distinct line are looked up in the texts, only those that share all but a part emit keys, and only for deletions
in that part. This loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, checked_broadcast, join_counted

#: Edits up to which lines repeat each other.
EDITS = 1
#: Lines of fewer characters are compared exactly only; 1: all lines are compared by edits.
LEAST_CHARS = 1
#: Characters whose keys a task makes.
TASK_CHARS = 1 << 18
HALVES = ("head", "tail", "head_1", "tail_1")
#: Parts of which lines within one edit share all but one.
PARTS = 8


def document_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, at, h, g, halves): the lines that count, by their place in the text from 0; h and g stand for the whole line."""
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("at", "line"))
    return lines.where(F.trim("line") != "").select("id", "at", *whole_keys(F.col("line")), *half_keys(F.col("line")))


def whole_keys(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit(9), F.reverse(line)).alias("g")]


def half_keys(line: Column) -> list[Column]:
    """Of these hashes any two lines within one edit share one.

    For both lengths that the longer of two such lines can have, the first half of that length, and the rest counted from the end.
    """
    n, keys = F.char_length(line), []
    for more, names in ((0, HALVES[:2]), (1, HALVES[2:])):
        half = F.floor((n + more) / 2).cast("int")
        rest = (n + more - half).cast("int")
        keys.append(F.xxhash64(n + more, F.lit("first"), line.substr(F.lit(1), half)).alias(names[0]))
        keys.append(F.xxhash64(n + more, F.lit("last"), line.substr(n - rest + 1, rest)).alias(names[1]))
    return keys


def sharing_lines(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, g, place): distinct lines that share a first or last half with another."""
    halves = distinct.select("h", "g", "place", F.explode(F.array(*HALVES)).alias("half"))
    shared = halves.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("half")
    shared = checked_broadcast(scratch.keep(shared, "shared"))
    return halves.join(shared, "half").select("h", "g", "place").distinct()


def sharing_parts(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(rank, parts): the lines that share all but one of PARTS parts with another, and a bit for each such part of their own."""
    n, keys = F.char_length("line"), []
    for more in (0, 1):
        cut = [F.floor((n + more) * k / PARTS).cast("int") for k in range(PARTS + 1)]
        for k in range(PARTS):
            behind = (n + more - cut[k + 1]).cast("int")
            shared = F.xxhash64(n + more, F.lit(k), F.col("line").substr(F.lit(1), cut[k]), F.col("line").substr(n - behind + 1, behind))
            keys.append(F.struct(shared.alias("key"), F.lit(0 if more else 1 << k).cast("long").alias("part")))
    keyed = scratch.keep(lines.select("rank", F.explode(F.array(*keys)).alias("k")).select("rank", "k.key", "k.part"), "parts")
    met = keyed.groupBy("key").agg(F.min("rank").alias("a"), F.max("rank").alias("b")).where("a <> b").select("key")
    return keyed.join(checked_broadcast(scratch.keep(met, "met-parts")), "key").groupBy("rank").agg(F.bit_or("part").alias("parts"))


def candidate_lines(df: DataFrame, id_col: str, text_col: str, chosen: DataFrame, least_chars: int, scratch: Scratch) -> DataFrame:
    """(rank, h, g, place, line) of the lines of `chosen`, from the texts; ranks are in the order of the places."""
    wanted = chosen.groupBy(F.col("place.id").alias("wanted_id")).agg(F.collect_list(F.struct("h", "g", "place")).alias("wanted"))
    wanted = checked_broadcast(scratch.keep(wanted, "wanted"))
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(wanted, F.col("id").eqNullSafe(F.col("wanted_id")))
    found = texts.select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w")).select("w.*", F.try_element_at("lines", F.col("w.place.at") + 1).alias("line"))
    h, g = whole_keys(F.col("line"))
    found = found.where((F.col("h") == h) & (F.col("g") == g) & (F.char_length("line") >= least_chars))  # rows that repeat an id have several texts
    found = scratch.keep(found.dropDuplicates(["h", "g"]), "found")
    return found.orderBy("place").withColumn("rank", F.monotonically_increasing_id())


def less_one(rows: DataFrame) -> DataFrame:
    """rows and, for each of their characters from `start`, the row without it, as a substitution and as none."""
    at = F.explode(F.sequence(F.col("start"), F.char_length("rest"))).alias("t")  # a character's place from 1; the last one is none
    shorter = rows.select("*", at).where(F.col("t") < F.char_length("rest"))
    rest = F.concat(F.col("rest").substr(F.lit(1), F.col("t")), F.col("rest").substr(F.col("t") + 2, F.char_length("rest")))
    kinds = F.explode(F.array(F.struct((F.col("subs") + 1).alias("subs"), F.xxhash64("sub", "t").alias("sub"), F.col("others").alias("others")), F.struct("subs", "sub", (F.col("others") + 1).alias("others"))))
    shorter = shorter.select("rank", "parts", rest.alias("rest"), F.col("t").alias("start"), kinds.alias("k")).select("rank", "parts", "rest", "start", "k.subs", "k.sub", "k.others")
    return rows.unionByName(shorter.distinct())


def deletion_keys(lines: DataFrame, edits: int) -> DataFrame:
    """(subs, sub, d1, d2, others, rank): keys of lines after up to `edits` deletions.

    subs of them are substitutions, at the places that the hash sub stands for, and others are not; d1 and d2 stand for the rest.
    """
    zero = F.lit(0)
    rows = lines.select("rank", "parts", F.col("line").alias("rest"), zero.alias("start"), zero.alias("subs"), zero.cast("long").alias("sub"), zero.alias("others"))
    for _ in range(edits - 1):
        rows = less_one(rows)
    n_chars = rows.agg(F.sum(F.char_length("rest"))).first()[0] or 0
    one = ["rank", "rest", "start", "subs", "sub", "others"]
    dealt = rows.repartition(n_chars // TASK_CHARS + 1, "rank", "sub")
    chars = dealt.select(*(c for c in one if c != "rest"), F.xxhash64("rest").alias("rest"), "parts", F.posexplode(F.split("rest", "")).alias("t", "c"))
    empty = F.col("c") == ""  # the one element of an empty rest
    hashed = {f"{x}{s}": F.when(empty, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(s), "c", place)) for s in (1, 2) for x, place in (("f", F.col("t")), ("b", F.col("t") - 1))}
    chars = chars.withColumns(hashed)
    line = Window.partitionBy(*one)
    so_far = line.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    runs = [F.bit_xor(f"{x}{s}").over(w).alias(f"{x}{s}_{name}") for s in (1, 2) for x in "fb" for name, w in (("to", so_far), ("all", line))]
    chars = chars.select("*", F.count(F.lit(1)).over(line).alias("n"), *runs)
    # the characters before keep their places, those behind move up by one
    less = [F.col(f"f{s}_to").bitwiseXOR(F.col(f"f{s}")).bitwiseXOR(F.col(f"b{s}_all")).bitwiseXOR(F.col(f"b{s}_to")) for s in (1, 2)]
    part = F.floor(((F.col("t") + 1) * PARTS - 1) / F.col("n")).cast("int")
    is_wanted = F.getbit("parts", part) == 1 if edits == 1 else F.lit(True)
    key = lambda subs, sub, d, others: F.struct(subs.alias("subs"), sub.alias("sub"), d[0].alias("d1"), d[1].alias("d2"), others.alias("others"))
    subs, sub, others = F.col("subs"), F.col("sub"), F.col("others")
    more = is_wanted & (F.col("t") >= F.col("start")) & (subs + others < edits) & ~empty
    emitted = F.when(more, F.array(key(subs + 1, F.xxhash64("sub", "t"), less, others), key(subs, sub, less, others + 1))).otherwise(F.array())
    itself = F.when(F.col("t") == 0, F.array(key(subs, sub, [F.col("f1_all"), F.col("f2_all")], others))).otherwise(F.array())
    return chars.select("rank", F.explode(F.concat(emitted, itself)).alias("k")).select("k.*", "rank")


def earlier_lines(lines: DataFrame, scratch: Scratch, edits: int) -> DataFrame:
    """(h, g, earlier): of distinct lines within `edits` of an earlier one, the place of the earliest such."""
    keys = deletion_keys(lines, edits)
    same = Window.partitionBy("subs", "sub", "d1", "d2")
    least = [F.min(F.when(F.col("others") == q, F.col("rank"))).over(same) for q in range(edits + 1)]
    partner = F.least(*(F.when(F.col("subs") + F.col("others") + q <= edits, least[q]) for q in range(edits + 1)), F.lit(None).cast("long"))
    met = keys.withColumn("earlier", partner).where("earlier < rank").groupBy("rank").agg(F.min("earlier").alias("earlier"))
    met = scratch.keep(met, "near-ranks")
    other = lines.select(F.col("rank").alias("earlier"), F.col("place").alias("because"), F.col("line").alias("two"))
    near = met.join(lines, "rank").join(other, "earlier").where(F.levenshtein("line", "two", edits) >= 0)
    return near.select("h", "g", F.col("because").alias("earlier"))


def line_decisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id, at, first_id, first_at) of each line to drop, and the earlier line that it repeats.

    Lines are split at line feeds and ordered by id and place. A line is dropped if an earlier line is equal to it or within `edits`
    insertions, deletions or substitutions of a character; that earlier line may itself be dropped. The bound holds for lines of
    `least_chars` characters and more, by default for all; the keys of a line grow as its length to the power of `edits`. Lines of
    spaces only are layout: they are never dropped. A null text has no lines. Rows with a null id sort first; of rows that repeat
    an id, equal lines at equal places are one line. An empty table gives an empty result.
    """
    if edits < 0 or least_chars < 1:
        raise ValueError("edits must be at least 0 and least_chars at least 1")
    scratch = Scratch(df.sparkSession, "lines")
    lines = scratch.keep(document_lines(df, id_col, text_col), "lines")
    distinct = scratch.keep(lines.groupBy("h", "g", *HALVES).agg(F.min(F.struct("id", "at")).alias("place"), F.count(F.lit(1)).alias("n")), "distinct")
    if edits:
        chosen = scratch.keep(sharing_lines(distinct, scratch) if edits == 1 else distinct.select("h", "g", "place"), "chosen")
        candidates = scratch.keep(candidate_lines(df, id_col, text_col, chosen, least_chars, scratch), "candidates")
        parts = sharing_parts(candidates, scratch) if edits == 1 else candidates.select("rank", F.lit(-1).cast("long").alias("parts"))
        candidates = scratch.keep(candidates.join(checked_broadcast(scratch.keep(parts, "sharing-parts")), "rank"), "partners")
        near = checked_broadcast(scratch.keep(earlier_lines(candidates, scratch, edits), "near"))
        distinct = distinct.join(near, ["h", "g"], "left")
    else:
        distinct = distinct.withColumn("earlier", F.lit(None).cast(distinct.schema["place"].dataType))
    repeated = distinct.where("n > 1 or earlier is not null").select("h", "g", "n", F.coalesce("earlier", "place").alias("because"))
    repeated = scratch.keep(repeated, "repeated")
    for label in ("distinct", "shared", "chosen", "wanted", "found", "candidates", "parts", "met-parts", "sharing-parts", "partners", "near-ranks", "near"):
        scratch.drop(label)
    dropped = join_counted(lines.select("id", "at", "h", "g"), repeated, ["h", "g"], "n").where(~F.struct("id", "at").eqNullSafe(F.col("because")))
    return dropped.select(F.col("id").alias(id_col), "at", F.col("because.id").alias("first_id"), F.col("because.at").alias("first_at"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row per input row: id, n_lines, n_dropped, dropped (places of the dropped lines, ascending)."""
    decisions = line_decisions(df, id_col, text_col, edits=edits, least_chars=least_chars)
    by_row = decisions.groupBy(F.col(id_col).alias("drop_id")).agg(F.array_sort(F.collect_set("at")).alias("dropped"))
    text = F.col(text_col).cast("string")
    n_lines = F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    rows = df.select(F.col(id_col).alias("id"), n_lines.cast("long").alias("n_lines"))
    joined = rows.join(by_row, F.col("id").eqNullSafe(F.col("drop_id")), "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    return joined.select(F.col("id").alias(id_col), "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def without_dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """df with the dropped lines taken out of its texts; all columns stay."""
    drops = dedup_lines(df, id_col, text_col, edits=edits, least_chars=least_chars).where("n_dropped > 0").select(F.col(id_col).alias("__id"), "dropped").dropDuplicates(["__id"])
    joined = df.join(drops.withColumnRenamed("dropped", "__dropped"), F.col(id_col).eqNullSafe(F.col("__id")), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda line, at: ~F.array_contains(F.col("__dropped"), at)), "\n")
    text = F.when(F.col("__dropped").isNull(), F.col(text_col)).otherwise(kept)
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in df.columns))
