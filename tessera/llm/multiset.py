"""Document fingerprints: a homomorphic multiset hash of paragraphs, with DataFrame functions only.

Each paragraph is hashed to a wide vector: WIDE lanes modulo 2^32 that tell multisets apart, a one that counts
paragraphs, and SIGNS signs, whose sums tell how much two multisets share. A document's fingerprint is the sum of
the vectors of its paragraphs, so it doesn't depend on their order; paragraphs are added and taken away by adding
and subtracting vectors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Paragraphs end at line breaks and at the ends of sentences; white space around them doesn't count.
PARAGRAPH_END, AROUND = r"[\n.!?]+", " \t\r\x0b\x0c"
#: Lanes of 32 bits, and signs; both come in pairs from the halves of 64-bit hashes.
WIDE, SIGNS = 8, 128
LOW, BOTH = 0xFFFFFFFF, 1 | 1 << 32


def hashes(piece: Column) -> list[Column]:
    return [F.xxhash64(F.lit(i), piece) for i in range(WIDE // 2 + SIGNS // 64)]


def entries(h: list[Column]) -> list[Column]:
    """What one paragraph adds: lanes, then pairs of sign bits in a long, then one."""
    lanes = [x for g in h[: WIDE // 2] for x in (g.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(g, 32))]
    signs = [F.shiftrightunsigned(g, k).bitwiseAND(F.lit(BOTH)) for g in h[WIDE // 2 :] for k in range(32)]
    return [*lanes, *signs, F.lit(1).cast("long")]


def shaped(total: list[Column]) -> Column:
    """struct<wide array<long>, signs array<int>, pieces long> of the sums of entries.

    A text has fewer than 2^30 paragraphs, as it has fewer than 2^31 bytes: neither the sums of lanes nor two counts
    that share a long can run over.
    """
    n, pairs = total[-1], total[WIDE:-1]
    counts = [*[x.bitwiseAND(F.lit(LOW)) for x in pairs], *[F.shiftrightunsigned(x, 32) for x in pairs]]
    return F.struct(F.array(*[x.bitwiseAND(F.lit(LOW)) for x in total[:WIDE]]).alias("wide"), F.array(*[(2 * x - n).cast("int") for x in counts]).alias("signs"), n.alias("pieces"))


def trimmed(piece: Column) -> Column:
    return F.btrim(piece, F.lit(AROUND))


def vector(text: Column) -> Column:
    """The vector of a text that isn't null, as an expression, for some paragraphs to insert or delete; it isn't
    compiled, so ``vectors`` is the faster way for whole tables. Empty paragraphs add nothing."""
    zero = F.array_repeat(F.lit(0).cast("long"), WIDE + SIGNS // 2 + 1)

    def add(total: Column, raw: Column) -> Column:
        # arrays of one element bind the paragraph and its hashes to names, so that each is taken once
        piece = F.array(trimmed(raw))
        made = F.transform(F.transform(piece, lambda p: F.array(*hashes(p))), lambda h: F.array(*entries([h[i] for i in range(WIDE // 2 + SIGNS // 64)])))
        return F.when(piece[0] == "", total).otherwise(F.zip_with(total, made[0], lambda x, y: x + y))

    return F.aggregate(F.split(text, PARAGRAPH_END), zero, add, lambda total: shaped([total[i] for i in range(WIDE + SIGNS // 2 + 1)]))


def vectors(texts: DataFrame, keys: list[str], text_col: str, out_col: str) -> DataFrame:
    """(keys, vector) of ``texts``, whose keys are unique and whose texts aren't null; rows that are dealt by the keys
    already aren't shuffled again."""
    cut = texts.select(*keys, F.explode(F.split(F.col(text_col), PARAGRAPH_END)).alias("piece")).withColumn("piece", trimmed(F.col("piece")))
    names = [f"h{i}" for i in range(WIDE // 2 + SIGNS // 64)]
    hashed = cut.select(*keys, (F.col("piece") != "").alias("there"), *[h.alias(n) for h, n in zip(hashes(F.col("piece")), names, strict=True)])
    hashed = hashed.select(*keys, F.col("there").cast("long").alias("there"), *[F.when(F.col("there"), F.col(n)).otherwise(F.lit(0).cast("long")).alias(n) for n in names])
    *own, _ = entries([F.col(n) for n in names])
    sums = hashed.groupBy(*keys).agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate([*own, F.col("there")])])
    return sums.select(*keys, shaped([F.col(f"s{i}") for i in range(len(own) + 1)]).alias(out_col))


def combined(a: Column, b: Column, sign: int) -> Column:
    return F.struct(
        F.zip_with(a.wide, b.wide, lambda x, y: (x + sign * y).bitwiseAND(F.lit(LOW))).alias("wide"),
        F.zip_with(a.signs, b.signs, lambda x, y: x + sign * y).alias("signs"),
        (a.pieces + sign * b.pieces).alias("pieces"),
    )


def plus(a: Column, b: Column) -> Column:
    """The vector of both multisets together: inserts the paragraphs of b."""
    return combined(a, b, 1)


def minus(a: Column, b: Column) -> Column:
    """The vector of a without the paragraphs of b, which have to be among a's."""
    return combined(a, b, -1)


def named(v: Column) -> Column:
    """A vector as text, the fingerprint: 64 hex digits of the lanes, the number of paragraphs, the sums of signs."""
    digits = F.transform(v.wide, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))
    return F.concat_ws(":", F.array_join(digits, ""), v.pieces.cast("string"), F.array_join(v.signs.cast("array<string>"), ","))


def parsed(fingerprint: Column) -> Column:
    """The vector that a fingerprint names."""
    part = F.split(fingerprint, ":")
    lane = lambda i: F.conv(F.substring(part[0], 8 * i + 1, 8), 16, 10).cast("long")
    return F.struct(F.array(*map(lane, range(WIDE))).alias("wide"), F.split(part[2], ",").cast("array<int>").alias("signs"), part[1].cast("long").alias("pieces"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of two multisets of paragraphs, in 0..1, from their vectors; 1 for equal ones (two empty ones too)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x.signs, y.signs, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, z: s + z)
    cosine = F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
    same = (a.wide == b.wide) & (a.pieces == b.pieces)
    return F.when(same, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, k, h): null texts are empty, k names the id, null or not, and h is the text's hash."""
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return docs.select("id", "text", F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("")).alias("k"), F.xxhash64("text").alias("h"))


def documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, h, id, n, copies, own): a row for each distinct row of id and text, with its length and vector.

    Paragraphs are summed where the texts are read; only sums are shuffled.
    """
    rows = keyed(df, id_col, text_col).withColumn("n", F.char_length("text")).withColumn("row", F.monotonically_increasing_id())
    each = vectors(rows, ["k", "h", "id", "n", "row"], "text", "own")
    return each.groupBy("k", "h").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.count("*").alias("copies"), F.first("own").alias("own"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of each distinct row of id and text. Null texts count as empty, with no paragraphs."""
    return documents(df, id_col, text_col).select(F.col("id").alias(id_col), named(F.col("own")).alias("fingerprint"))


def neighbours(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each row of distinct ``keys`` with the next row's keys as next_*, after the last the first's.

    Rows are dealt by ranges and ordered within each; what follows a range's last row is the first row of the
    next range, of which there is one for each partition.
    """
    dealt = written(rows.repartitionByRange(*keys).withColumn("pid", F.spark_partition_id()), "ranges")
    me = F.struct(*keys)
    order = Window.partitionBy("pid").orderBy(*keys)
    dealt = dealt.withColumn("next", F.lead(me).over(order))
    firsts = dealt.groupBy("pid").agg(F.min(me).alias("head"))
    # as many rows as there are partitions
    each = Window.partitionBy(F.lit(1)).orderBy("pid")
    firsts = firsts.select("pid", F.coalesce(F.lead("head").over(each), F.first("head").over(each)).alias("after"))
    out = dealt.join(firsts, "pid").withColumn("next", F.coalesce("next", "after"))
    return out.select(*rows.columns, *[F.col(f"next.{k}").alias(f"next_{k}") for k in keys])


def with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, the fingerprint, that of the edited text and of how alike they and the next one are.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next text in order
    of id. Null texts count as empty. Rows with equal id are ordered by a hash of the text; exact repeats of a
    row are one document in that order and each get its result. A null id comes first. A single document is its
    own next. An empty table gives none.
    """
    own = written(documents(df, id_col, text_col), "vectors")
    order = written(neighbours(own.select("id", "h", "k", "n"), ["id", "h", "k"]), "order")
    # each as the follower of the document before it
    before = order.select(F.col("next_k").alias("n_k"), F.col("next_h").alias("n_h"), F.col("k").alias("p_k"), F.col("h").alias("p_h"), F.expr("n div 2").cast("int").alias("take"))
    follows = (F.col("k") == F.col("n_k")) & (F.col("h") == F.col("n_h"))
    precedes = (F.col("k") == F.col("p_k")) & (F.col("h") == F.col("p_h"))
    # texts are dealt by (k, h), one row a document however often it is repeated, and only beginnings are dealt again
    texts = keyed(df, id_col, text_col).groupBy("k", "h").agg(F.first("text").alias("text"))
    heads = texts.join(before, follows).select("p_k", "p_h", "take", F.expr("substring(text, 1, take)").alias("begin"))
    edited = texts.join(heads, precedes).select("k", "h", F.expr("concat(substring(text, 1, char_length(text) - take), begin)").alias("text"))
    edited = vectors(edited.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)), ["k", "h", "sha"], "text", "edited")
    followers = own.join(before, follows).select("p_k", "p_h", F.col("own").alias("follower"))
    out = own.join(edited, ["k", "h"]).join(followers, precedes)
    v = F.col("own")
    out = out.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), named(v).alias("fingerprint"), named(F.col("edited")).alias("edited_fingerprint"),
        likeness(v, F.col("edited")).alias("near_edited"), likeness(v, F.col("follower")).alias("near_next"), F.explode(F.expr("sequence(1L, copies)")).alias(copy := f"copy_{uuid.uuid4().hex}"),
    )
    return out.drop(copy)
