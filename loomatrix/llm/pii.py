"""Personal data, with information-theoretic sanitisation of the terms around it.

Base spans come from fixed patterns. Then, over the whole corpus: in how many documents
does a term stand near an entity (an e-mail address, a number), in how many does it
stand at all, in how many the entity? A term reveals an entity as far as the share of
its documents that hold the entity, P(e|t), exceeds the entity's own share, P(e).
Terms above the thresholds are spans too: removed when they all but name the entity,
generalised to their class otherwise. Most entities stand in one or two documents, where
a share says nothing: P(e|t) is taken at its lower confidence bound (Wilson's, `z` standard
deviations), so that one coincidence is no disclosure and five without an exception are.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import null_safe, slices, words_of, written
from .spans import Cover, digest, hash_filter_for_tasks, rewrite, text_rows

# fixed values: the base patterns. E-mails are [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+,
# addresses [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+); both are found from parts that each character
# belongs to once, since the whole patterns take a time that grows with the square of a run.
LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
PART = re.compile(r"[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "term")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ".,;:!?\"'()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost spans that don't overlap: from each @ to the left as far as the last span allows,
    then over the labels to its right."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = last + len(text[last:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        last = at + 1
        if found:
            out.append((start, found.end()))
            last = found.end()
        at = text.find("@", last)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Leftmost spans that don't overlap: the parts of a dotted run, four by four, if none is above 255."""
    out = []
    for run in DOTTED.finditer(text):
        parts = [m.span() for m in PART.finditer(text, *run.span())]
        for k in range(0, len(parts) - 3, 4):
            said = [text[a:b].lstrip("0") or "0" for a, b in parts[k : k + 4]]
            if all(len(x) <= 3 and int(x) <= 255 for x in said):
                out.append((parts[k][0], parts[k + 3][1]))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = []
    if "@" in text:
        out += [("email", *x) for x in emails(text)]
    if re.search("[0-9]", text):
        if "." in text:
            out += [("ip", *x) for x in addresses(text)]
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def term_of(word: str) -> str:
    """A word as a term: lower case, without punctuation at its edges; too short gives ''."""
    term = word.strip(EDGES).lower()
    return term if len(term) >= 3 else ""


def class_of(word: str) -> str:
    """What a generalised word is replaced by: a number, a code (letters and digits), a name, a term."""
    bare = word.strip(EDGES)
    if re.search("[0-9]", bare):
        return "code" if re.search("[^\\W\\d_]", bare) else "number"
    return "name" if bare[:1].isupper() else "term"


def _near(text: str, spans: list[tuple[str, int, int]], reach: int) -> list[dict]:
    """Distinct (entity, term) of terms at most `reach` words from an entity, outside all base spans."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    starts = np.array([s for s, _ in words])
    covered = Cover([x[1:] for x in spans]).touches
    pairs = set()
    for kind, start, end in spans:
        value = text[start:end].lower() if kind == "email" else re.sub("[^0-9.]" if kind == "ip" else "[^0-9]", "", text[start:end])
        first, last = int(np.searchsorted(starts, start, "right")) - 1, int(np.searchsorted(starts, end))
        entity = f"{kind}:{value}"
        for s, e in words[max(0, first - reach) : last + reach]:
            if (term := term_of(text[s:e])) and not covered(s, e):
                pairs.add((entity, term))
        pairs.add((entity, ""))
    return [{"entity": e, "term": t} for e, t in sorted(pairs)]


def _scan(reach: int):
    def work(row: dict):
        text = row["text"] or ""
        spans = base_spans(text)
        count = lambda kind: sum(x[0] == kind for x in spans)
        return row["id"], row["sig"], *map(count, KINDS[:4]), digest(spans), hashlib.sha256(text.encode()).hexdigest(), [{"kind": k, "start": s, "end": e} for k, s, e in spans], _near(text, spans, reach) if spans else []

    return work


def _occurrences(filled, id_type: pa.DataType):
    """Rows (id, sig, spots) of texts that hold a term which passes the filter; free: outside base spans."""
    spot = pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("class", pa.string()), ("free", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            codes, distinct, offsets = words_of(batch.column("text"))
            said = [term_of(word) for word in distinct]
            hit = np.append(filled.value.of_texts(said) & np.array([t != "" for t in said], bool), False)
            total = np.concatenate([[0], np.cumsum(hit[codes])])
            ids, sigs, spots = [], [], []
            for k in np.flatnonzero(total[offsets[1:]] > total[offsets[:-1]]):
                text = batch.column("text")[int(k)].as_py()
                covered = Cover([x[1:] for x in base_spans(text)]).touches
                wanted = {distinct[j] for j in set(codes[offsets[k] : offsets[k + 1]].tolist()) if hit[j]}
                found = [{"term": term_of(m[0]), "start": m.start(), "end": m.end(), "class": class_of(m[0]), "free": not covered(*m.span())} for m in WORD.finditer(text) if m[0] in wanted]
                ids.append(batch.column("id")[int(k)].as_py())
                sigs.append(batch.column("sig")[int(k)].as_py())
                spots.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(sigs, pa.int64()), pa.array(spots, pa.list_(spot))], ["id", "sig", "spots"])

    return run


def lower_bound(k: Column, n: Column, z: float) -> Column:
    """Wilson's lower bound of a share of which k of n were seen; z = 0 gives k / n."""
    n = n.cast("double")
    share = k / n
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reach: int = 8, min_docs: int = 3, min_posterior: float = 0.5, remove_posterior: float = 0.6, min_bits: float = 4.0, z: float = 1.645) -> DataFrame:
    """One row for each row of docs: (id, sig, n_email, n_ip, n_card, n_phone, base_sha256, text_sha256, found).

    found: array of (kind, start, end, action, class), by kind as in KINDS, then start;
    code points, end exclusive; action is `mask` for base spans, `generalise` or `remove`
    for terms, class what a term is generalised to. A term is disclosing if it stands
    within `reach` words of one entity in min_docs documents or more, the lower bound of
    P(e|t) = n(e, t) / n(t) is min_posterior at least and so many times P(e) that log2 of
    it is min_bits; from remove_posterior on it is removed. With z = 1.645, a bound that
    holds in 95 of 100 cases, three documents of three give 0.53, five 0.65, and eight of
    ten 0.54. All occurrences of a disclosing term outside base spans are reported.
    Document counts cover all rows, a repeated row each time. A null text is empty; null
    ids stay null; repeated rows each give a row; other columns are ignored; an empty
    table gives an empty result.
    """
    kind = docs.schema[id_col].dataType
    arrow, sql = to_arrow_type(kind), kind.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("sig"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    pair = pa.struct([("entity", pa.string()), ("term", pa.string())])
    scan = text_rows(_scan(reach), ["id", "sig", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "text_sha256", "base", "near"], [arrow, *[pa.int64()] * 5, pa.string(), pa.string(), pa.list_(span), pa.list_(pair)])
    scanned = written(rows.mapInArrow(scan, f"id {sql}, sig bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, text_sha256 string, base array<struct<kind:string,start:bigint,end:bigint>>, near array<struct<entity:string,term:string>>"))

    some = scanned.where(F.size("near") > 0)
    pairs = some.select(F.explode("near").alias("p")).groupBy("p.entity", "p.term").agg(F.count("*").alias("n_both"))
    pairs = written(pairs.where(F.col("n_both") >= min_docs))
    # a term stands in n_near documents at least; where even that is too many for the posterior, it needn't be counted
    near = some.select(F.explode(F.array_distinct(F.transform("near", lambda p: p["term"]))).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("n_near"))
    most = pairs.where("term <> ''").groupBy("term").agg(F.max("n_both").alias("most"))
    terms = written(most.join(near, "term").where(lower_bound(F.col("most"), F.col("n_near"), z) >= min_posterior).select("term"))
    # one pass finds where such terms stand, which also counts their documents
    few = hash_filter_for_tasks(terms, F.xxhash64("term"), 256)
    spots = written(rows.mapInArrow(_occurrences(few, arrow), f"id {sql}, sig bigint, spots array<struct<term:string,start:bigint,end:bigint,class:string,free:boolean>>"))
    counts = spots.select(F.explode(F.array_distinct(F.transform("spots", lambda s: s["term"]))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    entities = pairs.where("term = ''").select("entity", F.col("n_both").alias("n_entity"))
    all_docs = F.lit(float(max(1, scanned.count())))
    scored = pairs.where("term <> ''").join(terms, "term", "left_semi").join(counts, "term").join(entities, "entity")
    scored = scored.withColumn("posterior", lower_bound(F.col("n_both"), F.col("n_term"), z)).withColumn("bits", F.log2(F.col("posterior") * all_docs / F.col("n_entity")))
    disclosing = written(scored.where((F.col("posterior") >= min_posterior) & (F.col("bits") >= min_bits)).groupBy("term").agg(F.max("posterior").alias("posterior")))

    each = spots.select("id", "sig", F.explode("spots").alias("s")).where("s.free").select("id", "sig", "s.*").join(disclosing, "term")
    action = F.when(F.col("posterior") >= remove_posterior, "remove").otherwise("generalise")
    lists = each.groupBy("id", "sig").agg(F.array_sort(F.collect_set(F.struct("start", "end", action.alias("action"), "class"))).alias("terms"))
    out = null_safe(scanned.drop("near"), lists, ["id", "sig"], "left")
    base = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"), F.lit("mask").alias("action"), b["kind"].alias("class")))
    more = F.transform("terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"), t["action"].alias("action"), t["class"].alias("class")))
    return out.select(F.col("id").alias(id_col), "sig", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "text_sha256", F.when(F.col("terms").isNull(), base).otherwise(F.concat(base, more)).alias("found"))


def sanitising_cuts(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """What spans.rewrite() needs: base spans become [EMAIL] and so on, generalised terms their
    class ([NAME], [NUMBER], [CODE], [TERM]), removed ones nothing."""
    put = lambda c: F.when(c["action"] == "remove", "").otherwise(F.concat(F.lit("["), F.upper(c["class"]), F.lit("]")))
    cuts = F.transform("found", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), put(c).alias("put")))
    return found.select(id_col, "sig", cuts.alias("cuts")).where(F.size("cuts") > 0).distinct()


def sanitised(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sig, text) of the texts that find_personal_data changes, once each; sig is that of the source.

    Only rows whose text has spans, as a filter tells, are moved to meet them.
    """
    cuts = written(sanitising_cuts(found, id_col=id_col))
    known = hash_filter_for_tasks(cuts.select("sig").distinct(), F.col("sig"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(known.value(batch.column("sig").to_numpy().view(np.uint64))))

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col], docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("sig")).mapInArrow(some, f"`{id_col}` {kind}, text string, sig bigint")
    rows = null_safe(rows, cuts.select(id_col, "sig").distinct(), [id_col, "sig"], "left_semi").dropDuplicates([id_col, "sig"])
    return rewrite(rows, cuts, id_col=id_col, text_col="text")
