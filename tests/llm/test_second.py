"""Operators 2, 3, 5 and 10, the pipeline and the registered queries."""

import hashlib
import itertools
import random

import brute
import pytest
from pyspark.sql import functions as F
from test_first import DOCS, HARD, WORDS

import corpus_pipeline
from loomatrix.llm import chat, common, decontaminate, oracles, registry, repeats, spans, token_counts, word_bpe

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 3}", "clash", 1, "t") for k, t in enumerate(HARD)]
    return spark.createDataFrame([*rows, (5, HARD[5], "en", "s0", "clash", 2, "t"), (None, "null id text", None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- 2: role repair


def plain_cost(roles):
    """Least cost over all ways, by dynamic programming over whole conversations."""
    best = {chat.START: 0}
    for role in roles:
        after = {}
        for q, cost in best.items():
            for a, to, c, _ in chat.moves(role if role in chat.ROLES else None):
                if a == q:
                    after[to] = min(after.get(to, 1 << 60), cost + c)
        best = after
    return min(best.values())


def legal(roles):
    rest = roles[1:] if roles and roles[0] == "system" else roles
    return all(r == ("user", "assistant")[k % 2] for k, r in enumerate(rest))


@pytest.mark.parametrize("segment", [3, 1024])
def test_chat(spark, segment, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    some = ["system", "user", "assistant", "tool", None]
    rnd = random.Random(3)
    talks = [list(x) for n in (1, 2, 3) for x in itertools.product(["system", "user", "assistant", None], repeat=n)] + [[rnd.choice(some) for _ in range(rnd.randrange(4, 25))] for _ in range(40)]
    rows = [(k, t, r, f"text {k} {t}", "clash") for k, roles in enumerate(talks) for t, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, part string")
    parts = chat.render(chat.repair_roles(df)).collect()
    said = {k: "".join(p.rendered for p in sorted((p for p in parts if p.conv_id == k), key=lambda p: p.part)) for k in range(len(talks))}
    for k, roles in enumerate(talks):
        mine = [p for p in parts if p.conv_id == k]
        assert sum(p.cost for p in mine) == plain_cost(roles), roles
        assert all(p.n_turns == len(roles) for p in mine) and sum(p.n_kept + p.n_merged + p.n_inserted + p.n_relabelled for p in mine) == len(roles)
        blocks = said[k].split("<|end|>\n")
        assert blocks.pop() == "" and legal([b.split("|>")[0][2:] for b in blocks])
        assert [x.removesuffix("<|end|>") for x in said[k].split("\n") if x.startswith("text")] == [f"text {k} {t}" for t in range(len(roles))]


def test_chat_odd_rows(spark):
    rows = [(1, 0, "USER ", "a"), (1, 0, "USER ", "a"), (1, None, "assistant", None), (None, 3, "assistant", "x"), (2, 1, "", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r.rendered for r in chat.render(chat.repair_roles(df)).collect()}
    assert got == {1: "<|user|>\na\na<|end|>\n<|assistant|>\n<|end|>\n", None: "<|user|>\n<|end|>\n<|assistant|>\nx<|end|>\n", 2: "<|user|>\n<|end|>\n"} or got[2].startswith("<|")
    assert chat.render(chat.repair_roles(df.limit(0))).count() == 0


# ---- 3: decontamination

ITEM = "Then the clerk Ada packed 12 boxes weighing 40 kg each while her friend Ada counted 12 labels before lunch began and left."


def test_contamination(spark, docs, empty):
    changed = ITEM.replace("Ada", "Bob").replace("12", "77").replace("40", "9")
    mixed = ITEM.replace("clerk Ada", "clerk Bob").replace("12 boxes", "3 boxes").replace("12 labels", "4 labels")
    lead = "Some other words stand here. "
    rows = [(1, lead + ITEM + " And more."), (2, lead + changed), (3, lead + mixed), (4, lead * 5), (5, None), (6, ""), (7, lead + ITEM.lower()), (1, lead + ITEM + " And more.")]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id bigint, text string, item_id string, h int")
    bench = spark.createDataFrame([(10, ITEM, "clash"), (11, "too short", "x"), (12, None, None), (10, ITEM, "clash")], "item_id bigint, text string, slots string")
    got = {(r.doc_id, r.item_id): r.verdict for r in decontaminate.contamination(df, bench, max_conflicts=0.0).collect()}
    assert got == {(1, 10): "verbatim", (2, 10): "reparameterised"}
    kept = decontaminate.drop_contaminated(df, decontaminate.contamination(df, bench))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7] or sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7]
    assert kept.columns == df.columns
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.contamination(df, bench.limit(0)).count() == 0
    assert decontaminate.contamination(docs, bench).count() == 0


TOM = "Tom has 5 apples. Tom buys 3 more. Tom eats 2. How many apples does Tom have?"


def test_contamination_opening_names(spark):
    """Names that open sentences and spelled-out numbers may change; other openings stay literal."""
    spelled = "In the morning three boys from town carried five heavy crates to the old barn and twenty-five more to the mill"
    lead = "some other words stand here, and then: "
    rows = [(1, TOM.replace("Tom", "Ann")), (2, lead + TOM.replace("Tom", "Ann").replace("5", "8") + " And more."), (3, TOM), (4, lead + spelled.replace("three", "nine").replace("five", "seven")), (5, lead + spelled.replace("three", "3"))]
    rows += [(6, "Ann. Ben. Carl. Dora. Emil. Fred. Gus. Hal. Ida. " * 3), (7, TOM.replace("Tom has", "Ann has").replace("Tom buys", "Ben buys").replace("Tom eats", "Carl eats").replace("does Tom", "does Dora"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(20, TOM), (21, spelled)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.verdict for r in decontaminate.contamination(df, bench).collect()}
    assert got == {(1, 20): "reparameterised", (2, 20): "reparameterised", (3, 20): "verbatim", (4, 21): "reparameterised", (5, 21): "verbatim"}


def test_contamination_without_plain_words(spark):
    """Title case, capitals, arithmetic, lists and short items are found as they stand."""
    title = "Annual Report Of Green Valley Water Board Lists Seven Broken Pumps Near Harbour Road Bridge"
    sums = "12, 7, 19, 30, 4, 26, 8, 9, 72, 5, 55, 10"
    items = [(30, title), (31, title.upper().replace("PUMPS", "WELLS")), (32, sums), (33, "Who wrote Hamlet?"), (34, "Anna Bert Cora Dora Emil Fritz Gerda Hans")]
    lead, end = "some other words stand here and ", " and more words follow."
    rows = [(k, lead + t + end) for k, t in items] + [(40, lead + title.lower() + end), (41, lead + sums.replace("30", "31") + end), (42, "who wrote the letter to hamlet"), (43, lead + "Anna Bert Cora Dora Emil Fritz Gerda Hugo" + end)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contamination(df, bench).collect()}
    assert set(got) == {(k, k) for k, _ in items} | {(40, 30)} and all(r.verdict == ("mention" if k == (33, 33) else "verbatim") for k, r in got.items())
    assert all(got[k, k].n_matched == got[k, k].n_windows == max(1, len(t.split()) - 7) for k, t in items)


def test_contamination_any_case(spark, tmp_path):
    """Copies in lower case and capitals, by the registered query and the pipeline's stage."""
    short = "Where did Ada and Bob leave the blue box yesterday evening"
    rows = [(1, "Some words. " + ITEM.lower()), (2, ITEM.upper() + " AND MORE"), (3, "they asked: " + short + " before"), (4, short.lower()), (5, "Some other words stand here. " * 5)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, ITEM), (11, short)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.verdict for r in registry.op3_decontamination(spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys([(1, 10), (2, 10), (3, 11), (4, 11)], "verbatim")
    docs = common.table(spark, str(tmp_path), "documents")
    assert [r.doc_id for r in corpus_pipeline.benchmark_leaks(spark, docs, str(tmp_path)).collect()] == [5]


def test_spelled_numbers():
    said = {"five": "5", "twenty-five": "25", "three-hundred-two": "302", "hundred": "100", "two-thousand-six": "2006", "twenty-foo": None, "-": None, "": None}
    assert {w: decontaminate._spelled(w) for w in said} == said


# ---- 5: repeats


def test_repeats(spark, docs, empty):
    rnd = random.Random(5)
    word = lambda: rnd.choice(WORDS) + str(rnd.randrange(30))
    shared = [[word() for _ in range(n)] for n in (19, 20, 21, 33, 60, 200)]
    rows = []
    for k in range(60):
        parts = [[word() for _ in range(rnd.randrange(0, 30))] for _ in range(4)] + [rnd.choice(shared)[rnd.randrange(3) :] for _ in range(rnd.randrange(4))]
        rnd.shuffle(parts)
        rows.append((k, " ".join(w for p in parts for w in p)))
    rows += [(100, "a b c d " * 40), (101, "z " * 50), (102, None), (103, ""), (104, rows[3][1]), (105, "\n".join(shared[4])), (106, "q " * 19)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, h string, tag int")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(df).collect()}
    assert got == brute.repeats(rows)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in repeats.remove_repeats(df).collect())
    assert repeats.remove_repeats(empty).count() == 0
    # a repeated row is one document: it removes nothing from itself
    twice = repeats.remove_repeats(docs).where("doc_id = 5").collect()
    assert len(twice) == 2 and all(r.n_removed == 0 for r in twice)
    assert repeats.remove_repeats(docs).count() == docs.count()


# ---- 10: encoding and decoding


def test_word_bpe(spark, docs, empty):
    path = common.vocabulary_path(registry.VOCABULARY)
    plain = token_counts.tokenizer_of(path)
    extra = spark.createDataFrame([(50, " leading", None, None, None, None, None), (51, "trailing ", None, None, None, None, None), (52, "a b  c  d\n e \n\nf", None, None, None, None, None), (53, "x\x00y \x1c z", None, None, None, None, None)], DOCS)
    every = docs.unionByName(extra)
    got = word_bpe.encode_and_decode(every, path, with_ids=True)
    want = []
    for r in every.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(plain.decode(ids, skip_special_tokens=False)), ids, r.text or ""))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    back = {r.doc_id: r.decoded for r in word_bpe.decode(got, path).collect()}
    assert back == {r.doc_id: r.text or "" for r in every.collect()}
    assert word_bpe.encode_and_decode(empty, path).count() == 0


# ---- the pipeline and the registry


def test_pipeline(spark):
    """Against a plain version; so few labels stand in this table that no cutoff passes."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    docs = {r.doc_id: r.text for r in rows if not brute.quality(r.text)[-1]}
    prints = {k: brute.simhash(t) for k, t in docs.items()}
    docs = {k: t for k, t in docs.items() if brute.components(prints)[k] == k} if len(docs) < 2 else {k: docs[k] for k, c in brute.components(prints).items() if c == k}
    items = [brute.WORD.findall(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bare = lambda words: " ".join(w.strip(".,").lower() for w in words)
    docs = {k: t for k, t in docs.items() if not any(bare(i[1:]) in bare(brute.WORD.findall(t)) for i in items)}
    owners: dict = {}
    source = {r.doc_id: r.source for r in rows}
    from loomatrix.llm import secret_scan

    for k, t in docs.items():
        for _, _, _, value in secret_scan.candidates(t):
            owners.setdefault(value, set()).add(source[k])
    plain = token_counts.tokenizer_of(common.vocabulary_path(registry.VOCABULARY))
    want = {}
    for k, t in docs.items():
        out, at = "", 0
        for _, s, e, value in sorted(secret_scan.candidates(t), key=lambda x: (x[1], -x[2])):
            if len(owners[value]) < 3:
                if s >= at:
                    out += t[at:s] + "[SECRET]"
                at = max(at, e)
        text = out + t[at:]
        ids = plain.encode(text, add_special_tokens=False).ids
        want[k] = len(ids), brute.sha(",".join(map(str, ids))), brute.sha(text)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got.keys() == want.keys() and got == want


def test_stages_keep_columns(spark):
    docs = common.table(spark, SMALL, "documents").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).dtypes == docs.dtypes


def test_registry():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
    assert set(oracles.oracle_sql()) <= set(names)


def test_rewrite(spark):
    df = spark.createDataFrame([(1, "abcdef"), (2, None), (3, "x")], "doc_id bigint, text string")
    cuts = df.select("doc_id", F.xxhash64("text").alias("sig"), F.expr("array(named_struct('start', 1L, 'end', 3L, 'put', '-'), named_struct('start', 2L, 'end', 5L, 'put', '+'))").alias("cuts")).where("doc_id = 1")
    got = {r.doc_id: r.text for r in spans.rewrite(df, cuts, id_col="doc_id", text_col="text").collect()}
    assert got == {1: "a-f", 2: None, 3: "x"}
