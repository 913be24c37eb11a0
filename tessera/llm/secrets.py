"""Secret scans with ownership frequency over the whole corpus."""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import sliced, written

KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of 32 hex digits or more; runs are matched whole, as the shorter pattern would, and short ones dropped.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: What else may be a credential: a long run of token characters, judged by its entropy and its owners.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}")
#: Bits a character, and the most owners and repositories of a credential that looks live.
LEAST_ENTROPY, MOST_OWNERS, MOST_REPOS = 3.5, 1, 1


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, the secret itself), by start, then kind."""
    out = []
    lower = text.lower() if text.isascii() else text
    if any(k in lower for k in ("passw", "secret", "token", "api")) or not text.isascii():
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def more_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long runs of digits and both letter cases with high entropy that overlap no base span."""
    out = []
    for m in TOKEN.finditer(text):
        s = m[0]
        if any("0" <= c <= "9" for c in s) and not s.isupper() and not s.islower() and entropy(s) >= LEAST_ENTROPY and not any(a < m.end() and m.start() < e for a, _, e, _ in base):
            out.append((m.start(), 3, m.end(), s))
    return out


def listed(spans: list) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


def candidates(df: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """Per row the ids, counts and digest of the base spans, and all candidates (start, kind, end, hash)."""
    kept = df.select(*id_cols, text_col)
    schema = df.select(*id_cols).schema
    for c in ("n_assign", "n_access", "n_hex"):
        schema = schema.add(c, "long")
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("hash", T.StringType())])
    schema = schema.add("base_sha256", "string").add("found", T.ArrayType(span))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.string())]))
        for batch in sliced(batches):
            counts: list[list[int]] = [[], [], []]
            sha, found = [], []
            for text in batch.column(len(id_cols)).to_pylist():
                text = text or ""
                base = base_spans(text)
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                sha.append(hashlib.sha256(listed(base).encode()).hexdigest())
                every = sorted(base + more_spans(text, base))
                found.append([{"start": a, "kind": k, "end": e, "hash": hashlib.sha256(s.encode()).hexdigest()} for a, k, e, s in every])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(id_cols)], *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(found, kind)], schema.names)

    return kept.mapInArrow(run, schema)


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_docs, n_repos, n_owners) of each candidate of ``found(hash, repo, owner)`` over the whole corpus.

    Rows are counted by hash, repository and owner before they are counted by hash, each with partial sums, so
    a candidate that a third of all rows hold arrives as a row for each task.
    """
    each = found.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    by_owner = each.groupBy("hash", "owner").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_owners"))
    by_repo = each.groupBy("hash", "repo").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.count("*").alias("n_repos"))
    return by_owner.join(by_repo, "hash")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str | None = None) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied and the spans as an array.

    Base spans are those of three patterns. The method hashes every candidate, base or of high entropy, and
    counts its distinct repositories and owners over the corpus: one with a single owner and repository looks
    live, one that several hold is a copied example. Candidates beyond the base patterns are added to the spans
    as kind "live" if they look live. Owners default to the repository's name up to its first slash; a null
    repository is one of its own. Null texts count as empty. Repeated rows each get a row and count as one
    owner's. An empty table gives none; further columns don't matter.
    """
    owner = F.col(f"`{owner_col}`") if owner_col else F.substring_index(F.col(f"`{repo_col}`"), "/", 1)
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{repo_col}`"), F.lit("")).alias("repo"), F.coalesce(owner, F.lit("")).alias("owner"), F.col(f"`{text_col}`").alias("text"))
    rows = written(candidates(docs.withColumn("row", F.monotonically_increasing_id()), ["row", "id", "repo", "owner"], "text"), "candidates")
    spans = rows.select("row", "repo", "owner", F.explode("found").alias("f")).select("row", "repo", "owner", "f.*")
    counts = ownership(spans.select("hash", "repo", "owner"))
    # one row for each text and candidate that it holds, then one for each text
    looks = spans.join(counts, "hash").withColumn("live", (F.col("n_owners") <= MOST_OWNERS) & (F.col("n_repos") <= MOST_REPOS))
    span = F.struct("start", "kind", "end", "live", "n_owners", "n_repos")
    looks = looks.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("all"))
    out = rows.join(looks, "row", "left")
    every = F.coalesce(F.col("all"), F.array().cast(looks.schema["all"].dataType))
    shown = F.filter(every, lambda s: (s.kind < 3) | s.live)
    name = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(shown, lambda s: F.concat_ws(":", F.element_at(name, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")
    return out.select(
        F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"),
        F.size(F.filter(every, lambda s: s.live)).cast("long").alias("n_live"), F.size(F.filter(every, lambda s: ~s.live)).cast("long").alias("n_copied"), shown.alias("details"),
    )


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source") -> DataFrame:
    """``df`` with every base span and live candidate overwritten by ``[secret]``; other texts stay as they are.

    The spans found are joined to the rows by the id and the text's hash, rows without spans pass by the join. Columns
    of any name pass through; null texts, repeated rows and rows without id stay.
    """
    key, ref, spans = (f"{x}_{uuid.uuid4().hex}" for x in ("key", "ref", "spans"))
    keyed = df.withColumn(key, F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h")))
    found = scan(keyed, key, text_col, repo_col).where(F.size("details") > 0)
    found = found.select(F.col(key).alias(ref), F.transform("details", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))).alias(spans)).dropDuplicates([ref])
    same = F.col(f"{key}.id").eqNullSafe(F.col(f"{ref}.id")) & (F.col(f"{key}.h") == F.col(f"{ref}.h"))
    joined, text = keyed.join(found, same, "left"), F.col(f"`{text_col}`")
    cut = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(s.end <= acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s.start - acc["at"])), F.when(s.start >= acc["at"], F.lit("[secret]")).otherwise(F.lit("")))).alias("out"),
            F.greatest(acc["at"], s.end).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2**31 - 1))),
    )
    return joined.select(*[F.when(F.col(spans).isNull(), text).otherwise(cut).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
