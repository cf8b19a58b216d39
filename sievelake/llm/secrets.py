"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed; only pairs of blob and rule version that the ledger lacks are
scanned, and findings are joined back to all paths and versions that hold the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import cut, forget, narrow, new_folder, possibly_with, split_by
from ._text import slices


@dataclass(frozen=True)
class Rule:
    """A rule with its version; a new version is scanned again. The pattern must not match across a NUL character."""

    name: str
    version: int
    pattern: str


RULES = (
    Rule("aws_access_key", 1, r"AKIA[0-9A-Z]{16}"),
    Rule("github_token", 1, r"gh[pousr]_[0-9A-Za-z]{36}"),
    Rule("slack_token", 1, r"xox[abprs]-[0-9A-Za-z-]{10,72}"),
    Rule("google_api_key", 1, r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", 1, r"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("password", 1, r"password=[^\s\x00]{8,}"),
    Rule("token", 1, r"token = \"[0-9a-zA-Z_.-]{16,}\""),
)


def _name(rule: Rule) -> str:
    return f"{rule.name}:{rule.version}"


def _names(rules: Sequence[Rule]) -> str:
    return " ".join(map(_name, rules))


class Ledger:
    """Two append-only Parquet tables in a shared folder: findings, and the scanned pairs of blob and rule version.

    A run writes its findings first; only then do the pairs count as scanned. A run that breaks off in between is done
    again, and the repeated findings are one. Rows keep a blob as 32 bytes, and its rules as a mask of bits of a list of
    rule versions, of which there are few.
    """

    FINDINGS = "blob binary, rule string, rule_version int, secret string, masked string, first int, occurrences long"
    SCANNED = "blob binary, rules string, mask long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, kind: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{kind}"
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def findings(self) -> DataFrame:
        return self._read("findings", self.FINDINGS).distinct()

    def scanned(self) -> DataFrame:
        return self._read("scanned", self.SCANNED)

    def done(self, rules: Sequence[Rule]) -> DataFrame:
        """(blob, done): bit k says that the blob was scanned with rule k."""
        t = self.scanned()
        now, bit = {_name(r): k for k, r in enumerate(rules)}, F.lit(0).cast("long")
        for (names,) in t.select("rules").distinct().collect():
            same = F.lit(0).cast("long")
            for k, name in enumerate(names.split(" ")):
                if name in now:
                    same = same.bitwiseOR(F.when(F.col("mask").bitwiseAND(1 << k) != 0, F.lit(1 << now[name])).otherwise(F.lit(0)).cast("long"))
            bit = F.when(F.col("rules") == names, same).otherwise(bit)
        return t.select("blob", bit.alias("bit")).groupBy("blob").agg(F.bit_or("bit").alias("done"))

    def append(self, findings: DataFrame, scanned: DataFrame) -> None:
        findings.write.mode("append").parquet(f"{self.folder}/findings")
        scanned.write.mode("append").parquet(f"{self.folder}/scanned")


def find_secrets(texts: pa.Array, mask: np.ndarray, rules: Sequence[Rule], compiled: list[re.Pattern]) -> list[tuple[int, int, str, int, int]]:
    """(row, rule, secret, first, occurrences) of every distinct secret; bit k of a row's mask asks for rule k."""
    out = []
    for lo, hi in slices(texts):
        rows = [t.replace("\x00", " ") if t else "" for t in texts.slice(lo, hi - lo).to_pylist()]
        joined = "\x00".join(rows)
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in rows])])
        for k, pattern in enumerate(compiled):
            found: dict[tuple[int, str], list[int]] = {}
            for m in pattern.finditer(joined):
                r = int(np.searchsorted(begin, m.start(), side="right")) - 1
                if int(mask[lo + r]) >> k & 1:
                    found.setdefault((r, m.group()), []).append(m.start())
            out += [(lo + r, k, secret, rows[r].find(secret) + 1, len(at)) for (r, secret), at in found.items()]
    return out


def scan(versions: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan what the ledger lacks, add it, and return the findings of all versions (doc_id, path, text).

    Rows (doc_id, path, rule, rule_version, secret, masked, first, occurrences): secret is the SHA-256 of a match,
    masked its first four characters, first the place (from 1) where it first occurs in the text. NULL texts have no
    blob; empty texts are a blob without findings; a NULL id or path stays NULL in the result; a row that is there
    twice is in the result twice. At most 62 rules.
    """
    if len(rules) > 62 or any(" " in _name(r) for r in rules):
        raise ValueError("at most 62 rules, without blanks in their names")
    spark = versions.sparkSession
    v = narrow(versions, "doc_id", "path", "text").where("text is not null").withColumn("blob", F.unhex(F.sha2("text", 256)))
    v = v.withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    at = cut(v.select("doc_id", "path", "blob", "key"))
    done = ledger.done(rules)
    every = (1 << len(rules)) - 1
    blobs = at.groupBy("blob").agg(F.min("key").alias("key"))
    todo = blobs.join(done, "blob", "left").withColumn("mask", F.lit(every).bitwiseAND(F.bitwise_not(F.coalesce("done", F.lit(0).cast("long")))))
    todo = cut(todo.where("mask <> 0").select("blob", "key", "mask"))
    # a row is scanned straight from the table if its key is certainly none of a settled or partly settled blob
    whole = todo.where(F.col("mask") == every).select("blob", F.col("key").alias("whole_key"))
    unsure = cut(at.join(whole, "blob", "left").where("whole_key is null or key <> whole_key").select("key").distinct())
    text = v.select("key", "blob", "text")
    direct, rest = split_by(text, "key", unsure)
    rest = possibly_with(rest, "key", todo.select("key"))
    t = todo.select(F.col("blob").alias("todo_blob"), F.col("key").alias("todo_key"), "mask")
    rest = rest.join(t, (F.col("key") == F.col("todo_key")) & (F.col("blob") == F.col("todo_blob"))).select("blob", "text", "mask")
    if direct is not None:
        rest = direct.withColumn("mask", F.lit(every).cast("long")).select("blob", "text", "mask").unionByName(rest)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern) for r in rules]
        for b in batches:
            got = find_secrets(b.column(1), b.column(2).to_numpy(), rules, compiled)
            blobs = b.column(0).take(pa.array([g[0] for g in got], pa.int64()))
            yield pa.RecordBatch.from_arrays([blobs, pa.array([rules[g[1]].name for g in got], pa.string()), pa.array([rules[g[1]].version for g in got], pa.int32()), pa.array([hashlib.sha256(g[2].encode("utf-8", "surrogatepass")).hexdigest() for g in got], pa.string()), pa.array([g[2][:4] for g in got], pa.string()), pa.array([g[3] for g in got], pa.int32()), pa.array([g[4] for g in got], pa.int64())], names=["blob", "rule", "rule_version", "secret", "masked", "first", "occurrences"])

    ledger.append(rest.mapInArrow(part, Ledger.FINDINGS), todo.select("blob", F.lit(_names(rules)).alias("rules"), "mask"))
    current = spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, rule_version int")
    found = ledger.findings().join(F.broadcast(current), ["rule", "rule_version"])
    return at.join(found, "blob").select("doc_id", "path", "rule", "rule_version", "secret", "masked", "first", "occurrences")


def scan_fresh(spark: SparkSession, versions: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """scan() with a new, empty ledger in the shared folder, which goes when the Python process ends."""
    folder = new_folder(spark, "ledger")
    forget(spark, folder)
    return scan(versions, Ledger(spark, folder), rules)
