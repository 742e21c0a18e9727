"""Secret scans with corpus-wide ownership frequency.

A value that stands in the repositories of many owners is a copied example, and so is one
that several owners share in very many repositories; one that stays with an owner, in
however many repositories, or with two in a few, looks like a live credential. One pass finds candidates,
their hashes are aggregated over the whole corpus by distinct owner and repository,
and the verdicts go back to the texts by a join on the hash.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import written
from .spans import Cover, digest, text_rows

# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Candidates that the base patterns don't have: long mixed tokens.
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{24,}")
KINDS = ("assign", "access", "hex", "opaque")
FOUND = "array<struct<kind:string,start:bigint,end:bigint,key:string>>"


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind; base kinds as they are defined, then opaque
    tokens that have digits and both cases and touch no base span."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    covered = Cover([x[1:3] for x in out]).touches
    for m in OPAQUE.finditer(text):
        if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and not covered(*m.span()):
            out.append(("opaque", *m.span(), m[0]))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _scan(row: dict):
    found = candidates(row["text"] or "")
    base = [x[:3] for x in found if x[0] != "opaque"]
    count = lambda kind: sum(x[0] == kind for x in base)
    return row["id"], row["owner"], row["sig"], count("assign"), count("access"), count("hex"), digest(base), [{"kind": k, "start": s, "end": e, "key": hashlib.sha256(v.encode()).hexdigest()} for k, s, e, v in found]


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, example_owners: int = 3, example_repos: int = 20) -> DataFrame:
    """One row for each row of docs: (id, sig, n_assign, n_access, n_hex, base_sha256, found).

    found has, by start and kind, each candidate with kind, start, end (code points, end
    exclusive), n_owners, n_repos and verdict: `example` where its value stands with
    example_owners distinct owners or more, or with two or more in example_repos distinct
    repositories or more, else `live`. A repository is counted for its owner. Opaque tokens are listed only
    when they are live. sig is the text's xxhash64. repo_col is by default the id: each
    document is a repository of its owner. A null text has no candidates, null owners
    count as one owner of their own, apart from '', and null repositories likewise. Repeated rows each give a row, and a repeated
    document counts once for its owner. Other columns are ignored; an empty table gives
    an empty result.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(docs[id_col].alias("id"), docs[owner_col].cast("string").alias("owner"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("sig"), docs[repo_col or id_col].cast("string").alias("repo"))
    names = ["id", "owner", "sig", "n_assign", "n_access", "n_hex", "base_sha256", "found"]
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("key", pa.string())])
    kinds = [to_arrow_type(kind), pa.string(), *[pa.int64()] * 4, pa.string(), pa.list_(item)]
    work = _scan
    schema = f"id {kind.simpleString()}, owner string, sig bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, found {FOUND}"
    if repo_col:
        names, kinds, schema = [*names, "repo"], [*kinds, pa.string()], f"{schema}, repo string"
        work = lambda row: (*_scan(row), row["repo"])
    scanned = rows.mapInArrow(text_rows(work, names, kinds), schema)
    # the written table fixes each row's uid
    scanned = written(scanned.withColumn("uid", F.monotonically_increasing_id()))

    each = scanned.where(F.size("found") > 0).select("uid", "owner", F.col("repo" if repo_col else "id").cast("string").alias("repo"), F.posexplode("found").alias("at", "c")).select("uid", "owner", "repo", "at", "c.*")
    held = each.select("key", "owner", "repo").distinct()  # nulls are values of their own here
    by_key = held.groupBy("key", "owner").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"))
    # a value may stand in most documents: between two written tables Spark splits its rows
    widely = (F.col("n_owners") >= example_owners) | ((F.col("n_owners") >= 2) & (F.col("n_repos") >= example_repos))
    judged = each.join(written(by_key), "key").withColumn("verdict", F.when(widely, "example").otherwise("live"))
    judged = judged.where("kind <> 'opaque' or verdict = 'live'")
    lists = judged.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "start", "end", "n_owners", "n_repos", "verdict"))).alias("found"))
    out = scanned.drop("found").join(lists, "uid", "left")
    empty = F.expr("cast(array() as array<struct<at:int,kind:string,start:bigint,end:bigint,n_owners:bigint,n_repos:bigint,verdict:string>>)")
    return out.select(F.col("id").alias(id_col), "sig", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("found", empty).alias("found"))


def live_cuts(scanned: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """What spans.rewrite() needs to take live-looking secrets out of the texts."""
    cuts = F.transform(F.filter("found", lambda c: c["verdict"] == "live"), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit("[SECRET]").alias("put")))
    return scanned.select(id_col, "sig", cuts.alias("cuts")).where(F.size("cuts") > 0).distinct()
