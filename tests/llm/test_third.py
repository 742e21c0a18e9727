"""Registered queries over whole tables against plain versions, and what went wrong before."""

import json
import os
import random
import re

import brute
import duckdb
import pytest
from pyspark.sql import functions as F
from test_first import DOCS, HARD, WORDS

import corpus_pipeline
from loomatrix.llm import chat, common, decontaminate, oracles, pii, registry, repeats, secret_scan, simhash, token_counts, warc, word_bpe

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def plain():
    return token_counts.tokenizer_of(common.vocabulary_path(registry.VOCABULARY))


def by_id(rows):
    return {r.doc_id: r for r in rows}


# ---- whole tables


def test_op1_table(spark, texts, plain):
    got = by_id(registry.op1_token_counts(spark, SMALL).collect())
    for k, t in texts.items():
        n = len(plain.encode(t, add_special_tokens=False))
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len(t.encode()), n, n > 1024)
    assert len(got) == len(texts)


def test_op4_table(spark, texts):
    got = by_id(registry.op4_pii(spark, SMALL).collect())
    terms = brute.disclosing_terms(texts)
    for k, t in texts.items():
        *counts, listed = brute.pii(t)
        r = got[k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256] == counts
        assert [s for s in r.spans.split(",") if s and not s.startswith("term:")] == listed
        actions = [":".join(a.split(":")[:3]) for a in r.actions.split(",") if a]
        assert actions == terms[k] and r.n_generalised + r.n_removed == len(actions)
        assert r.sanitised_sha256 == brute.sha(brute.sanitised(t, listed, r.actions))
    assert len(got) == len(texts)


def test_op8_table(spark, texts):
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    owners, repos = {}, {}
    for k, t in texts.items():
        for *_, value in secret_scan.candidates(t):
            owners.setdefault(value, set()).add(source[k])
            repos.setdefault(value, set()).add((source[k], k))
    for k, r in by_id(registry.op8_secret_scan(spark, SMALL).collect()).items():
        *counts, listed = brute.secrets(texts[k])
        assert [r.n_assign, r.n_access, r.n_hex, r.base_sha256] == counts
        assert [s for s in r.spans.split(",") if s and not s.startswith("opaque:")] == listed
        wide = [len(owners[v]) >= 3 or len(owners[v]) == 2 and len(repos[v]) >= 20 for *_, v in secret_scan.candidates(texts[k])]
        assert r.n_live == wide.count(False)


def test_op9_table(spark, texts):
    prints = {k: brute.simhash(t) for k, t in texts.items()}
    want = brute.components(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in registry.op9_simhash(spark, SMALL).collect()} == {k: (prints[k], want[k]) for k in texts}


def test_op10_table(spark, texts, plain):
    got = by_id(registry.op10_word_bpe(spark, SMALL).collect())
    for k, t in texts.items():
        ids = plain.encode(t, add_special_tokens=False).ids
        assert tuple(got[k]) == (k, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(plain.decode(ids, skip_special_tokens=False)))
    assert len(got) == len(texts)


def test_op6_cutoffs_act(spark):
    """At this size labels suffice for cutoffs; the verdicts are those of the SQL."""
    folder = "/root/testdata/sf0.1"
    got = {tuple(r) for r in registry.op6_quality_rules(spark, folder).select("doc_id", "n_repeat_words", "base_failed", "kept").collect()}
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = set(db.sql(oracles.oracle_sql()["op6_quality_rules"]).select("doc_id", "n_repeat_words", "base_failed", "kept").fetchall())
    assert got == want and any(not failed and not kept for _, _, failed, kept in got)


# ---- 1: splicing by tokenizer


@pytest.mark.parametrize("change", ["trimmed", "prefix", "long token"])
def test_splicing_by_tokenizer(spark, texts, tmp_path, change):
    said = json.load(open(common.vocabulary_path(registry.VOCABULARY)))
    if change == "trimmed":
        said["post_processor"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    elif change == "prefix":
        said["pre_tokenizer"]["add_prefix_space"] = True
    else:
        said["added_tokens"].append(said["added_tokens"][0] | {"id": 50257, "content": "ab" * 60})
    path = str(tmp_path / "tokenizer.json")
    with open(path, "w") as f:
        json.dump(said, f)
    own = token_counts.tokenizer_of(path)
    some = [(k, t + ("ab" * 60 + " ") * 9) for k, t in sorted(texts.items()) if len(t) > 600][:120]
    df = spark.createDataFrame(some, "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, path, chunk_chars=600, overlap_chars=200).collect()}
    assert got == {k: len(own.encode(t, add_special_tokens=False)) for k, t in some}


def test_huge_texts(spark, plain):
    """Beyond a slice of 4 MB and a block of 16 MB, with the default sizes."""
    rnd = random.Random(9)
    words = [w + str(k) for w in WORDS for k in range(40)]
    huge = " ".join(rnd.choice(words) for _ in range(700_000))
    odd = huge[:2_000_000] + "x" * 60_000 + " " * 3_000 + huge[:1_900_000] + " token=Own3r0nlyS3cret bob@mail.example.org"
    rows = [(1, huge), (2, odd), (3, odd), (4, huge[:-7]), (5, "short")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).withColumn("source", F.lit("s"))
    path = common.vocabulary_path(registry.VOCABULARY)
    ids = {k: plain.encode(t, add_special_tokens=False).ids for k, t in rows}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, path).collect()} == {k: len(x) for k, x in ids.items()}
    got = by_id(word_bpe.encode_and_decode(df, path).collect())
    assert all((got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids[k]), brute.sha(",".join(map(str, ids[k]))), brute.sha(t)) for k, t in rows)
    assert {r.doc_id: r.fingerprint for r in simhash.simhash_components(df.where("doc_id <> 3")).collect()} == {k: f"{simhash.fingerprint(t):016x}" for k, t in rows if k != 3}
    want = brute.repeats(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(df, texts=False).collect()} == want
    found = by_id(pii.find_personal_data(df).collect())
    assert found[2].n_email == 1 and found[2].base_sha256 == brute.pii(odd)[4]
    assert by_id(secret_scan.scan_secrets(df).collect())[3].base_sha256 == brute.secrets(odd)[3]


# ---- 2: costs by trying all ways


def test_chat_costs(spark):
    rnd = random.Random(8)
    talks = [[rnd.choice(["system", "user", "assistant", "tool", None]) for _ in range(rnd.randrange(1, 8))] for _ in range(150)]
    df = spark.createDataFrame([(k, t, r, "x") for k, roles in enumerate(talks) for t, r in enumerate(roles)], "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r.cost for r in chat.render(chat.repair_roles(df)).collect()}
    assert got == {k: brute.role_repair_cost(roles) for k, roles in enumerate(talks)}


# ---- 3: canonical forms

KILOS = "Then the clerk Ada packed 12 boxes weighing 40 kg each while her friend Tom counted 15 labels before lunch began and left."


def test_contamination_forms(spark):
    """Units joined or apart, names of two words, values that merge, a changed word in the middle."""
    lead = "Some other words stand here. "
    rows = [
        (1, lead + KILOS.replace("40 kg", "55kg")), (2, lead + KILOS.replace("Tom", "Mary Ann")), (3, lead + KILOS.replace("40 kg", "40kg")),
        (4, lead + KILOS.replace("40 kg", "55 pounds").replace("Ada", "Mary Ann Lee")), (5, lead + KILOS.replace("her friend", "a colleague")), (6, lead + KILOS),
        (7, lead + KILOS.replace("12", "7").replace("15", "7").replace("Tom", "Ada")), (8, lead + KILOS.replace("40 kg", "40 %")),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(10, KILOS)], "item_id bigint, text string")
    got = by_id(decontaminate.contamination(df, bench).collect())
    assert {k: r.verdict for k, r in got.items()} == {1: "reparameterised", 2: "reparameterised", 3: "verbatim", 4: "reparameterised", 5: "reparameterised", 6: "verbatim", 8: "reparameterised"}
    assert all(got[k].n_matched == got[k].n_windows for k in (6,)) and got[1].n_changed == 1 and got[2].n_changed == 1


def plain_contamination(docs, items, window=8, literals=4, least=6, conflicts=0.2):
    """{(doc, item): (n_matched, n_windows, n_changed, verdict)}: each document with each item, each alignment."""
    edges = brute.EDGES + "«»“”…"
    low, high = {}, {}
    for text in [*docs.values(), *items.values()]:  # who stands in lower case, and who with a capital inside a sentence
        words = brute.WORD.findall(text)
        inner = [w.strip(edges) for before, w in zip(words, words[1:], strict=False) if not any(c in ".!?" for c in before[len(before.rstrip(edges)) :])]
        for table, some in ((low, {w.strip(edges) for w in words}), (high, inner)):
            for w in {w.lower() for w in some if w and (w[0].islower() if table is low else w[0].isupper())}:
                table[w] = table.get(w, 0) + 1
    rules = (decontaminate.UNITS, decontaminate.SPELLED, decontaminate.NO_NAMES | {w for w, n in low.items() if n >= 2 * high.get(w, 0)})
    exact = lambda t: [(w.strip(edges) or w).lower() for w in brute.WORD.findall(t)]

    def windows(words):
        out = [(k, words[k : k + window]) for k in range(len(words) - window + 1)]
        return [(k, w) for k, w in out if sum(x[0] == "" for x in w) >= literals]

    shape = lambda w: tuple(x[0] or ("", x[1]) for x in w)
    values = lambda w: [f"{x[0]}={x[1]}" for x in w if x[0]]
    result = {}
    for item, text in items.items():
        reading = [windows(brute.template(text, named, *rules)) for named in (False, True)]
        bare = exact(text)
        covered = {w[0][2] for _, w in reading[0]}
        places = [k for k in range(len(bare) - window + 1) if k not in covered]
        all_plain, all_named = (len({w[0][2] for _, w in r}) for r in reading)
        total = len({w[0][2] for r in reading for _, w in r} | set(places)) or (1 if bare else 0)
        for doc, body in docs.items():
            matched, by_way, changed, clean = set(), [set(), set()], set(), set()
            words = exact(body)
            if len(bare) < window:
                matched |= {0} if bare and any(words[k : k + len(bare)] == bare for k in range(len(words) - len(bare) + 1)) else set()
            else:
                seen = {tuple(words[k : k + window]) for k in range(len(words) - window + 1)}
                matched |= {k for k in places if tuple(bare[k : k + window]) in seen}
            clean |= matched
            for way in range(2):
                for mine in (windows(brute.template(body, named, *rules)) for named in (False, True)):
                    lines: dict = {}
                    table: dict = {}
                    for at, w in mine:
                        table.setdefault(shape(w), []).append((at, w))
                    for at, w in reading[way]:
                        for there, other in table.get(shape(w), []):
                            line = lines.setdefault(there - at, (set(), set(), set()))
                            line[0].add(w[0][2])
                            if values(w) == values(other):
                                line[2].add(w[0][2])
                            line[1].update(zip(values(w), values(other), strict=True))
                    for spots, pairs, same in lines.values():
                        bad = max(len(pairs) - len({p[side] for p in pairs}) for side in (0, 1))
                        if bad <= conflicts * len(pairs):
                            matched |= spots
                            clean |= same
                            by_way[way] |= spots
                            changed |= {p for p in pairs if p[0] != p[1]}
            enough = bool(matched) and len(matched) >= min(total, least)
            enough |= all_plain > 0 and len(by_way[0]) >= min(all_plain, least)
            enough |= all_named > 0 and len(by_way[1]) >= min(all_named, least) and 2 * len(by_way[1]) >= min(all_plain, least)
            if enough and matched:
                begins = {t[2] for t in brute.template(text, False, *rules)} if len(bare) >= window else {0}
                every = ({w[0][2] for r in reading for _, w in r} | set(places)) & begins
                whole = all(p in clean for p in every if min(matched) <= p <= max(matched))
                verdict = "mention" if len(bare) < window and words != bare else "verbatim" if whole else "reparameterised"
                result[doc, item] = len(matched), total, 0 if whole else len(changed), verdict
    return result


def test_contamination_table(spark):
    """Items with values, changed and planted by rule in real texts, against all pairs tried."""
    rnd = random.Random(4)
    names, things = ["Tom", "Ada", "Mary Ann", "Bert", "Carla Diaz", "Ivo"], ["boxes", "crates", "lamps", "tickets"]
    some = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    forms = [
        "{a} has {n} {t} that weigh {m} kg each. {a} gives {k} of them to {b}. How many {t} does {a} keep at home now?",
        "When {a} left the town with {n} {t} and {b} followed after {k} hours, the road was {m} km long and empty in the rain.",
        "{b} sold three {t} for {m} dollars and {a} paid {n} more. What did the {t} cost in all that week at the market?",
    ]
    fill = lambda f: f.format(a=rnd.choice(names[:3]), b=rnd.choice(names[3:]), t=rnd.choice(things), n=rnd.randrange(2, 90), m=rnd.randrange(2, 90), k=rnd.randrange(2, 90))
    items = {k: fill(forms[k % 3]) for k in range(9)} | {20: "What is five plus five?", 21: some[3][:150]}
    swap = lambda t: re.sub(r"\b\d+ kg\b", lambda m: f"{rnd.randrange(2, 99)}kg", t)
    docs = {k: (" ".join(t.split()[:80]) + " " + rnd.choice([fill(forms[k % 3]), swap(items[k % 9]), items[k % 9].lower(), items[20], ""]) + " " + " ".join(t.split()[80:160])) for k, t in enumerate(some)}
    got = decontaminate.contamination(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), spark.createDataFrame(list(items.items()), "item_id bigint, text string")).collect()
    want = plain_contamination(docs, items)
    assert {(r.doc_id, r.item_id): (r.n_matched, r.n_windows, r.n_changed, r.verdict) for r in got} == want
    assert {v[-1] for v in want.values()} == {"verbatim", "reparameterised", "mention"}


def test_verbatim_beside_a_name(spark):
    """A copy that stands right behind a capitalised word is no re-parameterised one."""
    df = spark.createDataFrame([(1, "Some words. Bob Ada" + KILOS[18:]), (2, "Then Bob " + TWO)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(10, "Ada" + KILOS[18:]), (11, TWO)], "item_id bigint, text string")
    got = decontaminate.contamination(df, bench, any_case=True).collect()
    assert {(r.doc_id, r.item_id): (r.verdict, r.n_changed) for r in got} == {(1, 10): ("verbatim", 0), (2, 11): ("verbatim", 0)}


TWO = "Lena walks along the wide river every single morning before the other people of the village wake up."


# ---- 5: levels


@pytest.mark.parametrize("first,full", [(10, 0.2), (5, 0.2), (10, -1.0)])
def test_repeats_levels(spark, texts, first, full, monkeypatch):
    """Two doublings, and the exact table beside a filter that is too full."""
    monkeypatch.setattr(repeats, "FULL", full)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(df, first=first, texts=False).collect()}
    assert got == brute.repeats(list(texts.items()))


def test_repeat_levels_until_none(spark):
    rnd = random.Random(2)
    word = iter(f"w{k}" for k in range(100_000))
    fresh = lambda n: [next(word) for _ in range(n)]
    shared = {n: fresh(n) for n in (12, 25, 45, 90, 330)}
    rows = [(10 * n + k, " ".join(fresh(rnd.randrange(30)) + shared[n] + fresh(30))) for n in shared for k in range(2)] + [(1, " ".join(fresh(200))), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.length for r in repeats.repeat_levels(df, first=5).collect()}
    for n in shared:
        least = max(5 * 2**j for j in range(10) if 5 * 2 ** (j + 1) <= n) if n >= 10 else 0
        assert all(least <= got[10 * n + k] <= n for k in range(2)), n
    assert not {1, 2, 3} & got.keys() and repeats.repeat_levels(df.where("doc_id < 4")).count() == 0


# ---- 8: owners


def test_secret_owners_apart(spark):
    """A null owner isn't the owner ''; repositories count beside owners."""
    rows = [(1, "token=Null0rEmpty1", ""), (2, "token=Null0rEmpty1", None), (3, "token=Null0rEmpty1", "o")]
    rows += [(100 + k, "token=ManyRepos12", f"o{k % 2}") for k in range(20)] + [(200 + k, "token=OneOwner123", "o9") for k in range(40)]
    found = by_id(secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect())
    verdict = lambda k: [(c.n_owners, c.n_repos, c.verdict) for c in found[k].found]
    assert verdict(1) == verdict(2) == [(3, 3, "example")]
    assert verdict(100) == [(2, 20, "example")] and verdict(200) == [(1, 40, "live")]


# ---- 7


@pytest.mark.parametrize("block", [None, 4096])
def test_chains_against_a_walk(spark, tmp_path, block):
    """Records and whole or broken records in payloads: what a walk from the start by lengths finds."""
    rnd = random.Random(11)
    record = lambda body, said=None: b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body) if said is None else said, body)

    def payload(depth):
        parts = [b"x" * rnd.randrange(300)]
        while depth and rnd.random() < 0.6:
            inner = payload(depth - 1)
            parts += [record(inner, rnd.choice([None, len(inner) + 7, 0, 90_000])), b"WARC/1.1\r\n" * rnd.randrange(3), b"y" * rnd.randrange(40)]
        return b"".join(parts)

    want = {}
    for name in ("a", "b"):
        bodies = [payload(3) for _ in range(60)]
        data, starts = b"", []
        for body in bodies:
            starts.append(len(data))
            data += record(body)
        (tmp_path / f"{name}.warc").write_bytes(data)
        want[name] = starts
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if block:
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        found = common.written(warc.candidates(spark, str(tmp_path)))
        if block:
            assert found.select("file", "block").distinct().count() > 4
        got = {}
        for r in warc.reachable(found).collect():
            got.setdefault(r.file, []).append(r.start)
        assert found.count() > 2 * sum(map(len, want.values()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    assert sorted(sorted(x) for x in got.values()) == sorted(want.values())


def test_spread(spark, tmp_path):
    """A table of one row group is dealt out, one of many files stays."""
    few, many = str(tmp_path / "few"), str(tmp_path / "many")
    cores = spark.sparkContext.defaultParallelism
    spark.range(1000).coalesce(1).write.parquet(few)
    spark.range(1000).repartition(cores).write.parquet(many)
    dealt = common.spread(spark.read.parquet(few))
    assert dealt.select(F.spark_partition_id().alias("p")).distinct().count() > 1 or cores == 1
    assert sorted(r.id for r in dealt.collect()) == list(range(1000))
    table = spark.read.parquet(many)
    assert common.spread(table) is table
    assert common.spread(spark.read.parquet(few).limit(0)).count() == 0


# ---- 9 and the pipeline's stages


def stage_rows(spark, rows):
    return spark.createDataFrame([(k, t, "en", s, len(t or ""), "clash", 1) for k, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, __sig string, __row int")


def test_near_duplicates_keep_one(spark):
    a, b, c = (" ".join(f"{w}{x}" for w in WORDS * 4) for x in "abc")
    rows = [(2, b, "s"), (5, a, "s"), (5, b, "s"), (5, a, "s"), (None, c, "s"), (None, c, "t"), (None, a, "s"), (9, None, "s"), (8, "", "s")]
    kept = corpus_pipeline.near_duplicates(spark, stage_rows(spark, rows), SMALL)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(2, b), (5, a), (0, c), (8, "")])


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_odd_rows(spark, stage):
    """Empty tables, nulls, repeated rows and columns named like the stages' own."""
    name, work = stage
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(HARD)] + [(5, HARD[5], "s2"), (5, HARD[5], "s2"), (5, HARD[8], None), (None, HARD[8], None), (None, None, None)]
    docs = stage_rows(spark, rows)
    assert work(spark, docs.limit(0), SMALL).count() == 0
    out = work(spark, docs, SMALL)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.dtypes == docs.dtypes
        assert {r["__sig"] for r in out.collect()} <= {"clash"} and {r["__row"] for r in out.collect()} <= {1}
    kept = sorted(((r.doc_id or -1) for r in out.collect()))
    every = sorted((k or -1 if k != 0 else -1) for k, _, _ in rows)
    if name == "quality_rules":
        assert kept == sorted((k if k else -1) for k, t, _ in rows if not brute.quality(t)[-1])
    elif name == "simhash_near_dedup":
        prints = [int(brute.simhash(t), 16) for _, t, _ in rows]
        assert len(kept) == len({c for c in brute.components({k: f"{p:016x}" for k, p in enumerate(prints)}).values()})
    else:
        assert kept == every


def test_folders_go_with_the_driver(tmp_path):
    import subprocess
    import sys

    code = "from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', '%s').getOrCreate(); from loomatrix.llm.common import written; print(written(s.range(3)).count()); s.stop()" % tmp_path
    said = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.abspath(corpus_pipeline.__file__)), capture_output=True, text=True)
    assert said.stdout.split()[-1] == "3" and not [d for d in os.listdir(tmp_path) if d.startswith("loomatrix")], said.stderr
