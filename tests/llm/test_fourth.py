"""Operators 11, 12 and 13 against plain versions: random texts, odd rows, ties and whole tables."""

import hashlib
import itertools
import json
import pathlib
import random
import re
import time

import brute
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from test_first import DOCS, HARD
from tokenizers import Tokenizer

from loomatrix.llm import chat, common, decontaminate, fill_in_middle, filter_audit, minhash, pii, registry, secret_scan, simhash, word_bpe

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", None if k % 4 == 0 else f"s{k % 3}", "clash", 1, "t") for k, t in enumerate(HARD)]
    rows += [(5, HARD[5], "en", "s2", "clash", 2, "t"), (None, "null id text", "en", "", None, None, None), (None, "one", "en", "", None, None, None), (99, "one", "en", "", None, None, None), (99, "one\ntwo <P> three", "en", "", None, None, None)]
    rows += [(200 + k, "first line\nsecond line here\n\nlast" + "\n" * (k % 3), "en", "s1", "clash", 1, "t") for k in range(40)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def strings(seed, n, alphabet, most):
    dice = random.Random(seed)
    return ["".join(dice.choice(alphabet) for _ in range(dice.randrange(most))) for _ in range(n)]


# ---- filter audit


def audit(rows, labels):
    """{(part, order, step): counts}, each order and step played through document by document."""
    marks = {}
    for key, quality, toxic in labels:
        old = marks.get(key, (False, False))
        marks[key] = (old[0] or quality == 1, old[1] or toxic == 1)
    least = {}
    for key, text, _ in rows:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    fails = []
    for key, text, part in rows:
        t = text or ""
        w = WORD.findall(t)
        said = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": key is not None and key > least[t]}
        fails.append((part or "", {f for f in said if said[f]}, *(marks.get(key, (False, False)) if key is not None else (False, False))))
    out, shares = {}, {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            kept = mine
            for step, name in enumerate(order, 1):
                gone = [f for f in kept if name in f[1]]
                kept = [f for f in kept if name not in f[1]]
                failing = sum(name in f[1] for f in mine)
                out[part, order, step] = [len(kept), len(gone), failing - len(gone), sum(f[1] == {name} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                shares[part, name] = shares.get((part, name), 0) + len(gone)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def said(rows):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def test_filter_audit(spark, docs, empty):
    marks = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (5, 1, 1), (203, 1, 1), (204, None, 1), (None, 1, 1), (999, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    want = audit([(r.doc_id, r.text, r.source) for r in docs.collect()], marks)
    got = filter_audit.filter_audit(docs, labels).collect()
    assert len(got) == len(want) and said(got) == want
    assert filter_audit.filter_audit(empty, labels).count() == 0
    assert filter_audit.filter_audit(docs, labels.limit(0)).count() == len(want)


def test_op11_table(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()]
    assert said(registry.op11_filter_audit(spark, SMALL).collect()) == audit(rows, labels)


@pytest.mark.parametrize("step", [7, 64, 1 << 20])
def test_measures(step, monkeypatch):
    """Random texts over block borders; a hash that gives few values is found out by the bytes."""
    monkeypatch.setattr(filter_audit, "STEP", step)
    monkeypatch.setattr(filter_audit, "POWERS", filter_audit.POWERS[:step])
    monkeypatch.setattr(filter_audit, "INVERSES", filter_audit.INVERSES[:step])
    texts = [None, "", "é" * 70 + " " + "é" * 69 + "e", *strings(1, 300, "aB é#\n\t東", 60), *strings(2, 20, "ab", 300), " ".join(["x" * 100, "x" * 100, "x" * 99 + "y"])]
    for seed in (None, 3):
        if seed:
            monkeypatch.setattr(filter_audit, "mixed", lambda x: x & np.uint64(7))
        got = filter_audit.measure(pa.array([t or "" for t in texts], pa.large_string()))
        for k, t in enumerate(texts):
            w = WORD.findall(t or "")
            assert [got[c][k] for c in ("words", "distinct", "capitals", "symbols", "chars")] == [len(w), len(set(w)), len(re.findall("[A-Z]", t or "")), len(re.findall("[#$%&*|]", t or "")), len(t or "")]


# ---- fill-in-middle


def middles(key, text, share=100):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= share:
        return key, len(lines), "plain", None, None, text, text
    if h[3] % 100 < 50:
        return key, len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return key, len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


@pytest.mark.parametrize("share", [100, 40])
def test_fill_in_middle(spark, docs, empty, share):
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate([*strings(5, 400, "a<P>SM\n\n é東😀", 40), "\n", "\n\n", "a\n", "\na", "<", "<\n<P", "x" * 200_000 + "\n" + "é\n" * 90_000])], "doc_id bigint, text string")
    both = docs.select("doc_id", "text", "n").unionByName(more, allowMissingColumns=True)
    done = fill_in_middle.fill_in_middle(both, share=share)
    got = [tuple(r) for r in done.select("*", fill_in_middle.restored(done.output, done.form).alias("text")).collect()]
    want = [middles(r.doc_id, r.text, share) for r in both.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(empty).count() == 0


def test_rank_and_select():
    dice = np.random.default_rng(1)
    for n, share in ((0, 0), (1, 1), (511, 0.5), (512, 1), (513, 0.01), (5000, 0.002), (4096, 0.9)):
        flags = dice.random(n) < share
        bits, ones = fill_in_middle.Bits(flags), np.flatnonzero(flags)
        assert (bits.rank(np.arange(n + 1)) == np.concatenate([[0], np.cumsum(flags)])).all()
        assert (bits.select(np.arange(len(ones))) == ones).all()


def test_op12_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r.doc_id: r for r in registry.op12_fill_in_middle(spark, SMALL).collect()}
    for r in rows:
        key, n, form, prefix, middle, output, text = middles(r.doc_id, r.text)
        g = got[key]
        assert (g.n, g.form, g.prefix_chars, g.middle_chars, g.output_sha256, g.restored_sha256) == (n, form, prefix, middle, brute.sha(output), brute.sha(text))
    assert len(got) == len(rows)


# ---- 2: which of equal repairs


def test_rendered_repairs(spark):
    """Actions and texts against the best of all ways, one conversation of more than SEGMENT turns beside."""
    dice = random.Random(12)
    roles = ["system", "user", "assistant", "tool", None]
    talks = [list(x) for n in (1, 2, 3) for x in itertools.product(roles, repeat=n)] + [[dice.choice(roles) for _ in range(dice.choice([4, 5]))] for _ in range(60)]
    rows = [(k, t, r, f"text {k} {t}") for k, talk in enumerate(talks) for t, r in enumerate(talk)]
    rows += [(5000, t, ("user", "assistant")[t % 2], f"long {t}") for t in range(2 * chat.SEGMENT + 5)]
    dice.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    repaired = chat.repair_roles(df).collect()
    said = {}
    for r in sorted(repaired, key=lambda r: (r.conv_id, r.at)):
        said.setdefault(r.conv_id, []).append((r.action, r.new_role))
    text = {}
    for r in sorted(chat.render(chat.repair_roles(df)).collect(), key=lambda r: (r.conv_id, r.part)):
        text[r.conv_id] = text.get(r.conv_id, "") + r.rendered
    for k, talk in enumerate(talks):
        want = brute.role_repair(talk)
        assert said[k] == want, talk
        assert text[k] == brute.rendered_chat([f"text {k} {t}" for t in range(len(talk))], want)
    assert said[5000] == [("keep", ("user", "assistant")[t % 2]) for t in range(2 * chat.SEGMENT + 5)] and text[5000].count("<|end|>") == len(said[5000])


# ---- 4: patterns in linear time, bounds


def test_base_patterns_on_short_strings():
    """Against the patterns themselves, on strings of the characters that matter."""
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for t in [*strings(11, 4000, "a@.-_ ", 24), *strings(12, 4000, "a@.b", 16), *strings(13, 3000, "12.0 ", 40), *strings(14, 500, "9.", 60)]:
        assert pii.emails(t) == [m.span() for m in email.finditer(t)]
        assert pii.addresses(t) == [m.span() for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    for t in strings(15, 3000, "12 -+(.", 30):
        assert [m.span() for m in pii.CARD.finditer(t)] == [m.span() for m in card.finditer(t)]
        assert [m.span() for m in pii.PHONE.finditer(t)] == [m.span() for m in phone.finditer(t)]


@pytest.mark.parametrize("scan", [pii.base_spans, secret_scan.candidates])
@pytest.mark.parametrize("run", ["1", "a", "b-", "a.", "1.", "1.2.3.", "+1 ", "a@", "@", "a@b-", "password ", "token=", "f0", "AKIA", " ", "0"])
def test_long_runs(scan, run):
    """1 MB of one repeated piece, beside what starts the patterns, in seconds."""
    text = "1.2 a@ +1 token: " + run * (1_000_000 // len(run)) + " a@b.c"
    began = time.perf_counter()
    scan(text)
    assert time.perf_counter() - began < 10


def test_bound_on_disclosure(spark):
    """One document is a coincidence, five without an exception name the entity."""
    rows = [(1, "please write to a.b@x.org about the zebrafish before noon"), *[(k, f"ask kermet for card 4111 1111 1111 1111 in room number{k}") for k in range(10, 15)], *[(k, f"see tolvok at 10.1.2.3 number{k} ok") for k in range(20, 23)]]
    rows += [(k, f"some other words please about for the number{k} in a room see ask card before noon") for k in range(100, 300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = pii.find_personal_data(df)
    said = {r.doc_id: [(dict(rows)[r.doc_id][c.start : c.end], c.action) for c in r.found if c.kind == "term"] for r in found.collect()}
    assert said[1] == [] and said[10] == [("kermet", "remove")] and said[20] == [("tolvok", "generalise")]
    texts = {r.doc_id: r.text for r in pii.sanitised(df, found).collect()}
    assert texts[10] == "ask  for card [CARD] in room number10" and texts[20] == "see [TERM] at [IP] number20 ok" and set(texts) == {1, *range(10, 15), *range(20, 23)}


# ---- 3: evidence from the corpus, shared windows, short items

FRAMES = {
    "de": ("Der {0} fährt mit dem {1} in die {2} und sieht dort das {3} an der alten {4}. Was denkt der {0} dann über das {3} in der {2}?", "Lehrer Bus Schule Buch Mauer Minister Panzer Wahl Flugzeug Grenze".split()),
    "fr": ("Le {0} part avec le {1} vers la {2} et voit là le {3} de la vieille {4}. Que pense le {0} alors du {3} dans la {2}?", "maître bus école livre porte ministre tank ville avion route".split()),
    "es": ("El {0} viaja con el {1} a la {2} y mira allí el {3} de la vieja {4}. ¿Qué piensa el {0} entonces del {3} en la {2}?", "maestro autobús escuela libro puerta ministro tanque ciudad avión frontera".split()),
    "en": ("The {0} goes with the {1} to the {2} and sees there the {3} by the old {4}. What does the {0} think then of the {3} in the {2}?", "teacher bus school book wall minister tank town plane border".split()),
}


def test_nouns_are_no_names(spark):
    """A frame of function words with other nouns is another text, in each language; other numbers and names are copies."""
    dice = random.Random(6)
    fill = {lang: [w for w in re.sub(r"\{\d\}", "", f).split() if w.strip("¿?.")] for lang, (f, _) in FRAMES.items()}
    rows = []
    for lang, (_, nouns) in FRAMES.items():
        for _ in range(150):
            said = [dice.choice(nouns) if k % 4 == 3 else dice.choice(fill[lang]).lower().strip("¿?.") for k in range(300)]
            rows.append((len(rows), " ".join(said), lang))
    items, planted = [], {}
    for n, (lang, (frame, nouns)) in enumerate(FRAMES.items()):
        items.append((n, frame.format(*nouns[:5])))
        more = f" {{0}} hat 12 {nouns[0]}xyz in {nouns[1]}abc gesehen, dann 30 {nouns[2]}qrs neben {nouns[3]}uvw gezählt, und wieder 7 {nouns[4]}klm im {nouns[0]}nop."
        items.append((10 + n, more.format("Ada")))
        rows += [(9000 + n, frame.format(*nouns[5:]), lang), (9100 + n, frame.format(*nouns[:5]), lang), (9200 + n, more.format("Ada").replace("12", "45").replace("30", "81"), lang)]
        planted |= {(9100 + n, n): "verbatim", (9200 + n, 10 + n): "reparameterised"}
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = decontaminate.contamination(df, spark.createDataFrame(items, "item_id bigint, text string"), any_case=True, lang_col="lang").collect()
    assert {(r.doc_id, r.item_id): r.verdict for r in found} == planted


def test_shared_instructions(spark):
    """An instruction before every question is no question; with a question of its own an item is found."""
    lead = "Read the following passage with care, think step by step about what it says, and then answer the question below in one short sentence only."
    ask = lambda k: f"Which of the q{k}a and q{k}b rivers did captain q{k}c cross before the q{k}d winter of the q{k}e war began?"
    items = [(k, f"{lead} {ask(k)}") for k in range(40)] + [(90, lead)]
    rows = [(k, f"w{k} {lead} other{k} words{k} follow{k}") for k in range(60)] + [(100 + k, f"{lead} {ask(k)}") for k in range(5)] + [(200, f"so, {ask(7)}")]
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    said = {(r.doc_id, r.item_id): r for r in got}
    alone = {k for k in said if k[1] == 90}
    assert set(said) - alone == {(100 + k, k) for k in range(5)} | {(200, 7)} and {k[0] for k in alone} == {*range(60), *range(100, 105)}
    assert all(said[100 + k, k].n_matched == said[100 + k, k].n_windows for k in range(5))


def test_short_items(spark):
    """A short item is a finding where it is a line or the text, else a mention that removes nothing."""
    rows = [(1, "yes"), (2, "he said yes to it"), (3, "one line\n Yes! \nanother line"), (4, "one line\nyes it is\nanother"), (5, "no"), (6, "then\nwho wrote it?\n"), (7, "who wrote it? nobody"), (8, "a yes\nyes")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = decontaminate.contamination(df, spark.createDataFrame([(1, "Yes"), (2, "Who wrote it?")], "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id): r.verdict for r in found.collect()} == {(1, 1): "verbatim", (2, 1): "mention", (3, 1): "verbatim", (4, 1): "mention", (6, 2): "verbatim", (7, 2): "mention", (8, 1): "verbatim"}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(df, found).collect()) == [2, 4, 5, 7]


# ---- near duplicates


def near(rows, similarity=85):
    """[(id, size, component, kept)] by comparing all sets."""
    sets = []
    for _, text in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            root[top(b)] = top(a)
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[top(k)] = min(key, least.get(top(k), key))
    of = lambda k: least.get(top(k)) if sets[k] else rows[k][0]
    return [(key, len(sets[k]), of(k), key == of(k)) for k, (key, _) in enumerate(rows)]


def edited(words, n, dice):
    out = list(words)
    for k in dice.sample(range(len(out)), n):
        out[k] = f"w{dice.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def copies():
    """A text with copies edited so little that some link, chains of edits, a frequent passage, exact copies in other case."""
    dice = random.Random(4)
    base = [f"b{dice.randrange(5000)}" for _ in range(200)]
    texts = [edited(base, n, dice) for n in [0] * 3 + [1, 2, 3, 4] * 12]
    for _ in range(15):
        texts.append(edited(texts[-1], 2, dice))
    passage = [f"p{k}" for k in range(60)]
    texts += [passage + [f"u{dice.randrange(10**6)}" for _ in range(n)] for n in range(40)]
    texts += [[f"r{dice.randrange(10**6)}" for _ in range(80)] for _ in range(30)]
    texts += [[w] * n for w in ("a", "b") for n in (1, 2, 4, 5, 6, 30)]
    said = [" ".join(t) for t in texts]
    said += [said[0].upper(), said[5].title().replace(" ", "\n\t"), *HARD]
    dice.shuffle(said)
    rows = [(k, t) for k, t in enumerate(said)]
    return [*rows, (3, said[3]), (3, said[40]), (None, said[7]), (None, "all alone here with null"), (None, "all alone here with null")]


@pytest.mark.parametrize("block", [4, 1024])
def test_minhash(spark, empty, copies, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    df = spark.createDataFrame([(k, t, "x") for k, t in copies], "doc_id bigint, text string, node string").repartition(6)
    got = [tuple(r) for r in minhash.minhash_components(df).collect()]
    want = [(k, n, c, kept if k is not None else c is None) for k, n, c, kept in near(copies)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert minhash.minhash_components(empty).count() == 0


def test_minhash_without_a_hub(spark, monkeypatch):
    """Copies of an original that isn't there: most pairs are short of a link, so blocks find the few."""
    dice = random.Random(9)
    base = [f"b{k}" for k in range(150)]
    rows = [(k, " ".join(edited(base, dice.choice([1, 2, 3, 4]), dice))) for k in range(70)]
    monkeypatch.setattr(minhash, "BLOCK", 16)
    got = [tuple(r) for r in minhash.minhash_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got) == sorted(near(rows))


def test_slices_of_batches():
    """Slices begin anywhere in Arrow's buffers; results are those of the texts by themselves."""
    texts = [None, "Ab C", "", "É X y", *strings(8, 50, "Ab é\n#", 30)]
    for n in (0, 1, 3, 20):
        some = pa.array(["before", *texts]).slice(1)[n:]
        assert common.lower_ascii(some).to_pylist() == [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts[n:]]
        whole = filter_audit.measure(pc.fill_null(some.cast(pa.large_string()), ""))
        assert whole["words"].tolist() == [len(WORD.findall(t or "")) for t in texts[n:]]
        got = minhash.shingle_sets(some, 2)
        assert [x.tolist() for x in got] == [minhash.shingle_sets(pa.array([t], pa.string()), 2)[0].tolist() for t in texts[n:]]
        drawn = fill_in_middle.draws(list(range(len(some))), "7")
        at = fill_in_middle.cuts(pc.fill_null(some.cast(pa.large_string()), ""), drawn)
        assert [(int(a), int(p), int(m)) for a, p, m in zip(at[0], at[3], at[4], strict=True)] == [cut(t or "", d) for t, d in zip(texts[n:], drawn.tolist(), strict=True)]


def cut(text, drawn):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted(x % (len(lines) + 1) for x in drawn[:2])
    return len(lines), len("".join(lines[:a])), len("".join(lines[a:b]))


def test_sketches():
    """All bins are filled for sets of any size; equal bins estimate the similarity."""
    dice = np.random.default_rng(2)
    some = [dice.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 2, 5, 50, 3000)]
    assert (minhash.sketches(some, 160) != minhash.EMPTY).all()
    for share in (0.5, 0.85):
        agree = []
        for n in (100, 2000):
            both, k = dice.integers(0, 1 << 63, 3 * n).astype(np.uint64), int(n * share / (1 + share) * 2) or 1
            a, b = both[:n], np.concatenate([both[:k], both[n : 2 * n - k]])
            one, other = minhash.sketches([a, b], 160)
            agree.append(abs((one == other).mean() - k / (2 * n - k)))
        assert max(agree) < 0.15
    assert (minhash.sketches([np.zeros(0, np.uint64)], 160) == minhash.EMPTY).all()


def test_op13_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, registry.op13_minhash(spark, SMALL).collect())) == sorted(near(rows))




def test_simhash_with_maps(spark):
    """Columns that nest a map can't be hashed; the other columns go through, equal rows are one."""
    df = spark.createDataFrame([(1, "a b c d e", [{"k": 1}], ({"x": 2},), {"z": 1}), (1, "a b c d e", [{"k": 2}], ({"x": 2},), {"z": 1}), (1, "a b c d e", [{"k": 1}], ({"x": 2},), {"z": 1}), (2, "quite another text here", None, None, None)], "doc_id bigint, text string, meta array<map<string,int>>, deep struct<m:map<string,int>>, flat map<string,int>")
    got = simhash.simhash_components(df).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (1, 1), (2, 2)]
    kept = simhash.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2] and kept[0].asDict().keys() == set(df.columns)


# ---- 10: other tokenizers


@pytest.mark.parametrize("change", ["prefix space", "lower case", "no byte decoder", "metaspace", "as it is"])
def test_word_bpe_of_other_tokenizers(spark, tmp_path, change):
    """Encoding and decoding are the library's, also where decoding doesn't give the text back."""
    said = json.loads(pathlib.Path(common.vocabulary_path(registry.VOCABULARY)).read_text())
    if change == "prefix space":
        said["pre_tokenizer"]["add_prefix_space"] = True
    elif change == "lower case":
        said["normalizer"] = {"type": "Lowercase"}
    elif change == "no byte decoder":
        said["decoder"] = None
    elif change == "metaspace":
        said["pre_tokenizer"] = {"type": "Metaspace", "replacement": "Ġ", "prepend_scheme": "always", "split": True}
        said["decoder"] = {"type": "Metaspace", "replacement": "Ġ", "prepend_scheme": "always", "split": True}
    path = str(tmp_path / "t.json")
    pathlib.Path(path).write_text(json.dumps(said))
    plain = Tokenizer.from_file(path)
    rows = [(k, t) for k, t in enumerate([*HARD, "It's  A Café\n\nwith SOME words", " leading", "trailing "])]
    rows += [(3, rows[3][1]), (None, "null id text")]
    got = word_bpe.encode_and_decode(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), path, with_ids=True).collect()
    want = []
    for k, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        text = plain.decode(ids, skip_special_tokens=False)
        want.append((k, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(text), ids, text))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
